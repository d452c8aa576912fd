"""Per-document text statistics, and the kind of texts that are no natural prose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.words import COMMON

#: Characters in a chunk of a long text, and how far a word may reach into the next chunk.
CHUNK, HALO = 262_144, 64

#: What is counted of each line; every count is a sum over its characters or words, so parts of a line add up.
SUMS = ["chars", "letters", "foreign", "digits", "spaces", "symbols", "words", "common", "word_chars", "pipes", "tabs", "semicolons", "slashes", "commas", "gaps", "inner", "mixed", "coded", "ends", *(f"same{d}" for d in range(1, 9))]
KINDS = ["prose", "list", "table", "junk"]

SPACE, LETTER, DIGIT, STOP, COMMA, PIPE, BULLET, CLOSER, SYMBOL, LINE = range(10)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(256, SYMBOL, np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        if c.isalpha():
            kind[b] = LETTER
            lower[b] = ord(c.lower())
        elif c.isdigit():
            kind[b] = DIGIT
        elif c.isspace() or b < 32 or b == 127:
            kind[b] = SPACE
    for group, k in ((".!?", STOP), (",;:", COMMA), ("|", PIPE), ("-*>", BULLET), ("\"')]}", CLOSER)):
        for c in group:
            kind[ord(c)] = k
    kind[10] = LINE
    kind[0xC3:0xE2] = LETTER
    kind[0xE3:0xF0] = LETTER
    powers = np.cumprod(np.concatenate([[1], np.full(HALO - 1, 1099511628211)]).astype(np.uint64))
    return kind, lower, powers


_KIND, _LOWER, _POWERS = _tables()


def _classes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte's character and whether the byte is a character's first."""
    lead = (raw & 0xC0) != 0x80
    kind = _KIND[raw]
    at = np.flatnonzero(raw >= 0xC2)
    at = at[at + 2 < len(raw)]
    two = raw[at + 1]
    c2, e2 = raw[at] == 0xC2, raw[at] == 0xE2
    kind[at[c2 & (two == 0xA0)]] = SPACE
    kind[at[c2 & (two == 0xBB)]] = CLOSER
    kind[at[c2 & ((two == 0xB7))]] = BULLET
    kind[at[c2 & ((two == 0xAA) | (two == 0xBA) | (two == 0xB5))]] = LETTER
    third = raw[at + 2]
    e280 = e2 & (two == 0x80)
    kind[at[e280 & ((third == 0x99) | (third == 0x9D))]] = CLOSER
    kind[at[e280 & (third == 0xA6)]] = STOP
    kind[at[((raw[at] == 0xE3) & (two == 0x80) & (third == 0x82)) | ((raw[at] == 0xEF) & (two == 0xBC) & np.isin(third, [0x81, 0x8E, 0x9F]))]] = STOP  # full-width ones
    kind[at[e280 & ((third == 0xA2) | (third == 0x93) | (third == 0x94))]] = BULLET
    kind[at[e280 & ((third < 0x90) | (third == 0xAF))]] = SPACE
    kind[at[e2 & ((two == 0x96) | (two == 0x97)) & (third >= 0xA0)]] = BULLET
    if not lead.all():
        own = np.maximum.accumulate(np.where(lead, np.arange(len(raw), dtype=np.int32), 0))
        kind = kind[own]
    return kind, lead


def _word_hashes(raw: np.ndarray, letter: np.ndarray, starts: np.ndarray) -> np.ndarray:
    low = _LOWER[raw]
    up = (raw >= 0x80) & (raw <= 0x9E) & (np.concatenate([[0], raw[:-1]]) == 0xC3)
    low[up] += 0x20
    begin = np.zeros(len(raw), np.int32)
    begin[starts] = starts
    begin = np.maximum.accumulate(begin)
    place = np.minimum(np.arange(len(raw), dtype=np.int32) - begin, HALO - 1)
    value = low.astype(np.uint64) * _POWERS[place]
    value[~letter] = 0
    return np.add.reduceat(value, starts) if len(starts) else np.zeros(0, np.uint64)


def _hash_words(words: list[str]) -> np.ndarray:
    made = set()
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8).astype(np.uint64)
        made.add(int((b * _POWERS[: len(b)]).sum(dtype=np.uint64)))
    return np.array(sorted(made), np.uint64)


_COMMON = _hash_words([w for words in COMMON.values() for w in words])


def _behind(mask: np.ndarray, n: int, edge: bool) -> np.ndarray:
    """The mask n places further on."""
    return np.concatenate([np.full(n, edge), mask[:-n]])[: len(mask)] if len(mask) > n else np.full(len(mask), edge)


def line_counts(texts: list[bytes]) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Lines of texts: the text each belongs to, its SUMS, and what its first and last signs say.

    The signs are ``terminal`` (it ends a sentence), ``bullet`` (it starts with a bullet or number) and ``cell`` (a
    figure is its first sign).
    """
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lines)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind, lead = _classes(raw)
    ends = np.flatnonzero(kind == LINE)
    starts = np.concatenate([[0], ends[:-1] + 1])

    n = len(ends)
    line_of = np.repeat(np.arange(n, dtype=np.int64), ends - starts + 1)
    tally = np.bincount((line_of * 10 + kind)[lead], minlength=10 * n).reshape(n, 10)

    def per_line(mask: np.ndarray) -> np.ndarray:
        """Of a mask with few hits."""
        return np.bincount(line_of[np.flatnonzero(mask)], minlength=n)

    letter, digit, space = kind == LETTER, kind == DIGIT, kind == SPACE
    before = np.concatenate([[LINE], kind[:-1]])
    out = {"chars": tally.sum(axis=1) - tally[:, LINE], "letters": tally[:, LETTER], "digits": tally[:, DIGIT], "spaces": tally[:, SPACE]}
    # letters beyond Latin, by the first byte of a character; U+1E00 to U+1EFF are Latin
    beyond = letter & lead & (raw >= 0xCD) & (raw < 0xF0)
    beyond &= ~((raw == 0xE1) & np.isin(np.concatenate([raw[1:], [0]]), [0xB8, 0xB9, 0xBA, 0xBB]))
    out["foreign"] = per_line(beyond)
    out["symbols"] = tally[:, SYMBOL] + tally[:, PIPE] + tally[:, BULLET]
    begin = np.flatnonzero(letter & (before != LETTER))
    hashes = _word_hashes(raw, letter, begin)
    of = line_of[begin]
    out["words"] = np.bincount(of, minlength=n)
    out["word_chars"] = out["letters"]
    spot = np.minimum(np.searchsorted(_COMMON, hashes), len(_COMMON) - 1)
    out["common"] = np.bincount(of[_COMMON[spot] == hashes], minlength=n)
    out["pipes"], out["tabs"], out["semicolons"] = tally[:, PIPE], per_line(raw == 9), per_line(raw == 0x3B)
    slash = np.flatnonzero(raw == 0x2F)
    spaced = slash[(before[slash] == SPACE) & np.isin(kind[np.minimum(slash + 1, len(raw) - 1)], [SPACE, LINE])]
    out["slashes"] = np.bincount(line_of[spaced], minlength=n)
    out["commas"] = per_line(raw == 0x2C)
    wide = space & lead & (before == SPACE)
    out["gaps"] = per_line(wide & _behind(kind == SPACE, 2, False) & ~_behind(kind == SPACE, 3, True))
    after = np.concatenate([kind[1:], [LINE]])
    point = (kind == COMMA) | (raw == 0x2E) | (raw == 0x3F) | (raw == 0x21)
    out["inner"] = per_line(point & (before == LETTER) & (after == LETTER))
    big = (raw >= 65) & (raw <= 90)
    small_before = np.concatenate([[False], (raw[:-1] >= 97) & (raw[:-1] <= 122)])
    out["mixed"] = per_line(big & small_before)
    out["coded"] = per_line((letter & (before == DIGIT)) | (digit & (before == LETTER)))
    out["ends"] = per_line((kind == STOP) & lead & (after != STOP))
    for d in range(1, 9):
        same = np.flatnonzero((hashes[d:] == hashes[:-d]) & (of[d:] == of[:-d])) + d
        out[f"same{d}"] = np.bincount(of[same], minlength=n)
    place = np.arange(len(raw), dtype=np.int64)
    seen = lead & (kind != LINE) & (kind != SPACE)
    last = np.maximum.reduceat(np.where(seen & (kind != CLOSER), place, -1), starts)
    last = np.where(last >= starts, last, -1)
    first = np.minimum.reduceat(np.where(seen, place, len(raw)), starts)
    first = np.where(first < ends, first, 0)
    has = first >= starts
    sign = {"terminal": (last >= 0) & (kind[last] == STOP)}
    number = has & (kind[first] == DIGIT)
    mark = np.zeros(n, bool)
    for step in (1, 2, 3):
        there = np.minimum(first + step, len(raw) - 1)
        mark |= number & np.isin(raw[there], [0x2E, 0x29]) & (kind[np.minimum(there + 1, len(raw) - 1)] == SPACE) & (kind[there - 1] == DIGIT)
    sign["bullet"] = has & ((kind[first] == BULLET) | mark)
    sign["cell"] = number & ~mark
    return owner, out, sign


def line_kinds(x: dict[str, np.ndarray], sign: dict[str, np.ndarray]) -> np.ndarray:
    """Index into KINDS for each line."""
    solid = np.maximum(x["chars"] - x["spaces"], 1)
    words = np.maximum(x["words"], 1)
    # the dictionaries are of languages in Latin script; in others the share of common words says nothing
    foreign = x["foreign"] > 0.5 * np.maximum(x["letters"], 1)
    share = np.where(foreign, 0.3, x["common"] / words)
    repeated = np.max([x[f"same{d}"] for d in range(1, 9)], axis=0)
    odd = x["inner"] + x["mixed"]
    cells = np.maximum.reduce([x["pipes"], x["tabs"], x["semicolons"], x["slashes"], x["gaps"]])
    junk = (x["words"] >= 6) & (repeated > 0.55 * words)
    junk |= (x["symbols"] > 0.5 * solid) & (x["letters"] + x["digits"] < 0.35 * solid) & (solid >= 8)
    junk |= (x["coded"] > 0.12 * solid) & (x["words"] >= 3) & (cells == 0)
    junk |= (x["letters"] > 0.5 * solid) & (x["word_chars"] > 18 * words) & (solid >= 24) & ~foreign
    rows = (x["semicolons"] >= 2) & (x["commas"] == 0) & (x["inner"] <= x["semicolons"]) & (x["mixed"] == 0)
    junk |= (odd > 0.08 * words) & (odd >= 2) & (share < 0.38) & ~rows
    junk |= (x["words"] >= 8) & (share < 0.08) & (cells == 0) & (x["commas"] < 0.15 * words) & (x["letters"] > 0.8 * solid)
    prose = (share >= 0.15) & (x["words"] >= 4) & (sign["terminal"] | ((x["words"] >= 12) & (x["commas"] < 0.18 * words)))
    prose |= foreign & (x["letters"] >= 12) & sign["terminal"] & (x["letters"] > 0.6 * solid)  # some scripts don't part words
    prose &= ~(sign["bullet"] & (x["words"] <= 6) & ~sign["terminal"])
    table = (cells >= 1) & (share < 0.3) & (cells != x["semicolons"])
    table |= cells >= 2
    table |= (x["digits"] > 0.4 * solid) & sign["cell"] & (share < 0.3)
    out = np.full(len(solid), KINDS.index("list"))
    out[prose] = KINDS.index("prose")
    out[table & ~prose] = KINDS.index("table")
    out[junk] = KINDS.index("junk")
    return out


#: Per document: sums of the lines' counts, and characters by kind of line.
DOCUMENT = ["lines", "filled", "terminal", "bullets", "chars", "letters", "digits", "spaces", "symbols", "words", "common", *(f"{k}_chars" for k in KINDS)]


def _document_rows(owner: np.ndarray, n: int, x: dict, sign: dict, skip: np.ndarray) -> dict[str, np.ndarray]:
    kinds = line_kinds(x, sign)
    solid = x["chars"] - x["spaces"]
    sums = {"lines": np.ones(len(owner)), "filled": solid > 0, "terminal": sign["terminal"], "bullets": sign["bullet"] & (solid > 0)}
    sums |= {c: x[c] for c in DOCUMENT[4:11]}
    sums |= {f"{k}_chars": np.where((kinds == i) & ~skip, solid, 0) for i, k in enumerate(KINDS)}
    return {c: np.bincount(owner, weights=v, minlength=n).astype(np.int64) for c, v in sums.items()}


def blocks(batch: pa.RecordBatch, size: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text, which the arrays made from them fit a CPU's cache."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("text"))))
    cuts = [*np.flatnonzero(np.diff(ends // size)) + 1, batch.num_rows]
    for a, b in zip([0, *cuts], cuts):
        yield batch.slice(a, b - a)


def _short(ident: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in blocks(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                owner, x, sign = line_counts(texts)
                skip = np.zeros(len(owner), bool)
                left = part.column("repeated")
                sizes = left.value_lengths().to_numpy()
                start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])[:-1]
                skip[np.repeat(start, sizes) + left.flatten().to_numpy()] = True
                made = _document_rows(owner, len(texts), x, sign, skip)
                yield pa.RecordBatch.from_arrays([part.column(ident), *(pa.array(made[c]) for c in DOCUMENT)], names=[ident, *DOCUMENT])

    return run


STATE = ["part", "line", *SUMS, "terminal", "bullet", "cell", "blank"]


def _chunks(ident: str, chunk: int):
    """Cut long texts. A chunk ends behind the word it is in, if that is within HALO, so that no word is cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, repeated in zip(batch[ident], batch["text"], batch["repeated"]):
                at = part = line = 0
                while at < len(text) or not part:
                    end = min(at + chunk, len(text))
                    stop = next((i for i in range(end, min(end + HALO, len(text))) if not text[i].isalnum()), end)
                    piece = text[at:stop]
                    yield pd.DataFrame({ident: [key], "part": [part], "line": [line], "text": [piece], "repeated": [list(repeated)]})
                    at, part, line = stop, part + 1, line + piece.count("\n")

    return run


def _parts(ident: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            owner, x, sign = line_counts(texts)
            first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])[:-1]
            line = np.arange(len(owner)) - first[owner] + batch.column("line").to_numpy()[owner]
            left = [set(v) for v in batch.column("repeated").to_pylist()]
            skip = np.fromiter((n in left[o] for n, o in zip(line.tolist(), owner.tolist())), bool, len(line))
            cols = {"part": batch.column("part").to_numpy()[owner], "line": line, **{c: x[c] for c in SUMS}}
            cols |= {"terminal": sign["terminal"], "bullet": sign["bullet"], "cell": sign["cell"], "blank": x["chars"] == x["spaces"]}
            keys = batch.column(ident).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(np.asarray(cols[c]).astype(np.int64)) for c in STATE), pa.array(skip)], names=[ident, *STATE, "skip"]
            )

    return run


def _lines_to_rows(ident: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = {c: batch[c].to_numpy() for c in SUMS}
            sign = {c: batch[c].to_numpy().astype(bool) for c in ("terminal", "bullet", "cell")}
            made = _document_rows(np.arange(len(batch)), len(batch), x, sign, batch["skip"].to_numpy().astype(bool))
            yield pd.DataFrame({ident: batch[ident], **made})

    return run


def counts(df: DataFrame, ident: str, text: str = "text", repeated: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(ident, DOCUMENT...): sums over the lines of each text that isn't null; ident must be unique.

    ``repeated`` may name a list of line numbers whose characters don't count for the kinds. Texts of up to a chunk
    are counted where they are read, without a shuffle. Longer ones are cut into chunks that are counted in parallel:
    a chunk's state is the counts of each of its lines, the sign that its first part starts with and its last part
    ends with. States of one line are merged by sums (``first`` and ``last`` for the signs), combined before the
    shuffle, so the counts are those of the whole text.
    """
    marks = F.col(repeated) if repeated else F.array().cast("array<int>")
    rows = df.where(F.col(text).isNotNull()).select(ident, F.col(text).alias("text"), marks.alias("repeated"))
    key = T.StructField(ident, df.schema[ident].dataType)
    longs = lambda names: [T.StructField(c, T.LongType()) for c in names]
    result = T.StructType([key, *longs(DOCUMENT)])
    short = rows.where(F.length("text") <= chunk).mapInArrow(_short(ident), result)
    cut_schema = T.StructType([key, *longs(["part", "line"]), T.StructField("text", T.StringType()), T.StructField("repeated", T.ArrayType(T.IntegerType()))])
    chunks = rows.where(F.length("text") > chunk).mapInPandas(_chunks(ident, chunk), cut_schema).repartition(F.col(ident), F.col("part"))
    parts = chunks.mapInArrow(_parts(ident), T.StructType([key, *longs(STATE), T.StructField("skip", T.BooleanType())]))
    ahead = F.when(F.col("blank") == 0, F.col("part"))
    lines = parts.groupBy(ident, "line").agg(
        *(F.sum(c).alias(c) for c in SUMS),
        # the last part that isn't blank tells how the line ends, the first one how it starts
        F.max(F.struct(ahead.alias("p"), "terminal"))["terminal"].alias("terminal"),
        F.min(F.struct(F.coalesce(ahead, F.lit(2**62)).alias("p"), "bullet"))["bullet"].alias("bullet"),
        F.min(F.struct(F.coalesce(ahead, F.lit(2**62)).alias("p"), "cell"))["cell"].alias("cell"),
        F.max("skip").alias("skip"),
    )
    merged = lines.mapInPandas(_lines_to_rows(ident), result).groupBy(ident).agg(*(F.sum(c).alias(c) for c in DOCUMENT))
    return short.unionByName(merged)


def statistics(df: DataFrame, ident: str, text: str = "text", repeated: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each text that isn't null: counts, ratios, and ``kind``.

    Ratios are null where their denominator is 0. ``kind`` is list, table or junk where more than half of the text's
    characters, white space and repeated lines apart, stand in lines that are no natural prose, by the kind with the
    most characters (ties: junk before table before list), else null. Blank texts have the kind null.
    """
    c = counts(df, ident, text, repeated, chunk)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    other = F.col("list_chars") + F.col("table_chars") + F.col("junk_chars")
    most = F.greatest("list_chars", "table_chars", "junk_chars")
    kind = F.when(F.col("junk_chars") == most, "junk").when(F.col("table_chars") == most, "table").otherwise("list")
    return c.select(
        ident,
        *DOCUMENT,
        ratio("letters", "words").alias("mean_word_length"),
        ratio("symbols", "chars").alias("symbol_ratio"),
        ratio("digits", "chars").alias("digit_ratio"),
        ratio("terminal", "filled").alias("terminal_line_ratio"),
        ratio("bullets", "filled").alias("bullet_line_ratio"),
        ratio("common", "words").alias("common_word_ratio"),
        F.when(other * 2 > other + F.col("prose_chars"), kind).alias("kind"),
    )

"""Text that was decoded with the wrong character encoding: where it is, and what it was."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings whose characters UTF-8 bytes may have been taken for, in order of preference on equal evidence.
SHOWN_AS = ["cp1252", "cp1250", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp1253", "cp1254", "iso8859_15", "iso8859_2"]
#: One-byte encodings that may have been taken for one another.
SINGLE = ["cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "koi8_r", "cp866", "cp1253"]
#: Those of them whose letters are no Latin ones.
OTHER_SCRIPTS = {"cp1251", "koi8_r", "cp1253"}
#: Rounds of decoding, for text that went wrong more than once.
ROUNDS = 4
#: What a stretch of words must gain, in nats, when read in another one-byte encoding, and what a pair of characters on average.
LEAST_GAIN, LEAST_MEAN_GAIN = 8.0, 2.0
#: Pairs of characters beyond this code point aren't counted: no one-byte encoding has them.
LAST_CODE = 0x2600

_TWO = re.compile(r"[^\x00-\x7f](?=([^\x00-\x7f]))")
_LOST = "�"
_QUOTE = re.compile(r"[«“„\"‹'‘`][\s  ]*([^«»“”„\"‹›\n]{1,40}?)[\s  ]*[»”“\"›'’`]")


@lru_cache(None)
def to_byte(codec: str) -> dict[str, int]:
    """The byte from 0x80 on of each character of a legacy encoding; C1 controls stand for bytes it leaves open."""
    table = {bytes([b]).decode(codec): b for b in range(0x80, 0x100) if bytes([b]).decode(codec, "ignore")}
    if codec.startswith(("cp125", "iso8859")):
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


def _class(codec: str, low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in to_byte(codec).items() if low <= b <= high) + "]"


@lru_cache(None)
def automaton(codec: str) -> re.Pattern | None:
    """Matches maximal runs of characters whose legacy bytes are well-formed multi-byte UTF-8 sequences."""
    c = lambda low, high=None: _class(codec, low, high or low)
    tail = c(0x80, 0xBF)
    parts = [
        (c(0xC2, 0xDF), tail), (c(0xE0), c(0xA0, 0xBF), tail), (c(0xE1, 0xEC), tail, tail), (c(0xED), c(0x80, 0x9F), tail),
        (c(0xEE, 0xEF), tail, tail), (c(0xF0), c(0x90, 0xBF), tail, tail), (c(0xF1, 0xF3), tail, tail, tail), (c(0xF4), c(0x80, 0x8F), tail, tail),
    ]
    return re.compile("(?:" + "|".join("".join(p) for p in parts if "[]" not in p) + ")+")


@lru_cache(None)
def beginnings(codec: str) -> frozenset[str]:
    """The first two characters of the sequences that the automaton takes."""
    table = to_byte(codec)
    tails = [c for c, b in table.items() if b < 0xC0]
    return frozenset(c + t for c, b in table.items() if 0xC2 <= b <= 0xF4 for t in tails)


#: Combining accents of decomposed Latin letters.
MARKS = {0x300, 0x301, 0x302, 0x303, 0x308, 0x327}
_SCRIPTS = ((0x386, 0x3CE, "greek"), (0x400, 0x45F, "cyrillic"), (0x590, 0x5FF, "hebrew"), (0x600, 0x6FF, "arabic"), (0x3040, 0x30FF, "cjk"), (0x4E00, 0x9FFF, "cjk"), (0xAC00, 0xD7AF, "cjk"))


def _kind(c: str) -> str:
    """latin for the letters and signs of Latin-1, extended for further Latin letters, sign, a script, or odd."""
    o = ord(c)
    category = unicodedata.category(c)
    if category in ("Cc", "Cn", "Co", "Cs"):
        return "odd"
    if 0xA0 <= o <= 0xFF:
        return "latin"
    if 0x100 <= o <= 0x17F or 0x1E00 <= o <= 0x1EFF:
        return "extended"
    if 0x2010 <= o <= 0x20CF or 0x2100 <= o <= 0x22FF or o == 0xFEFF or o >= 0x1F300 or 0x2600 <= o <= 0x27BF:
        return "sign"
    if o in MARKS:
        return "mark"
    return next((name for low, high, name in _SCRIPTS if low <= o <= high), "odd")


def _plausible(text: str, start: int, end: int, decoded: str, codec: str) -> bool:
    if re.search("[\x80-\x9f]", decoded):  # bytes of text that went wrong twice
        rest = decoded
        for m in automaton("cp1252").finditer(decoded):
            inner = bytes(to_byte("cp1252")[c] for c in m.group()).decode("utf-8", "replace")
            if not {_kind(c) for c in inner} <= {"latin", "extended", "sign"}:
                return False
            rest = rest.replace(m.group(), "")
        return not re.search("[\x80-\x9f]", rest)
    kinds = {_kind(c) for c in decoded}
    before, after = text[start - 1 : start], text[end : end + 1]
    if codec in OTHER_SCRIPTS and kinds & {"latin", "extended", "sign"} and not (before + after).isascii():
        return False
    if "mark" in kinds:  # a decomposed accent stands behind its letter, and comes as the bytes CC or CD show
        return kinds == {"mark"} and before.isascii() and before.isalpha() and codec in ("cp1252", "cp437", "cp850")
    if "odd" in kinds or len(kinds - {"latin", "sign", "extended"}) > 1:
        return False
    if kinds <= {"latin", "sign"}:
        # an upper-case word that ends in such a letter, before a closing quotation mark or a no-break space
        return not (before.isupper() and end - start == 2 and text[end - 1] in "» " and not after.islower())
    if kinds <= {"latin", "sign", "extended"}:
        return len(decoded) > 1 or before.islower() or after.islower()
    return len(decoded) > 1


def _quoted(text: str, start: int, end: int, decoded: str) -> bool:
    """Whether a span only stands in quotation marks, as an example, while the text also has what it stands for."""
    for m in _QUOTE.finditer(text, max(0, start - 45), min(len(text), end + 45)):
        if m.start(1) <= start and end <= m.end(1) and len(m.group(1).split()) <= 3:
            meant = m.group(1)[: start - m.start(1)] + decoded + m.group(1)[end - m.start(1) :]
            return meant in text
    return False


def spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """Plausible maximal runs of UTF-8 shown in ``codec``: start, end, and what they decode to."""
    table = to_byte(codec)
    out = []
    for m in automaton(codec).finditer(text):
        decoded = bytes(table[c] for c in m.group()).decode("utf-8", "replace")
        if _plausible(text, m.start(), m.end(), decoded, codec):
            out.append((m.start(), m.end(), decoded))
    # letters of another script stand beside one another by chance
    return out if codec not in OTHER_SCRIPTS or sum(len(d) for _, _, d in out) > 2 else []


def _weight(found: list[tuple[int, int, str]]) -> int:
    """Characters that spans explain, those that become Latin letters and signs of Latin-1 twice."""
    return sum((b - a) * (2 if all(_kind(c) == "latin" for c in decoded) else 1) for a, b, decoded in found)


def decode_spans(text: str) -> tuple[str, int, list[str]]:
    """text with its garbled UTF-8 spans decoded, their number, and the encodings they had been shown in.

    Spans that a text quotes as its subject stay. Each round takes the encoding that explains the most characters;
    later rounds undo what went wrong twice.
    """
    total, how = 0, []
    for _ in range(ROUNDS):
        pairs = {m.group() + m.group(1) for m in _TWO.finditer(text)}
        if not pairs:
            break
        best: list[tuple[int, int, str]] = []
        name = ""
        for codec in SHOWN_AS:
            if pairs.isdisjoint(beginnings(codec)):
                continue
            found = [s for s in spans(text, codec) if not _quoted(text, *s)]
            if _weight(found) > _weight(best):
                best, name = found, codec
        if not best:
            break
        parts, at = [], 0
        for a, b, decoded in best:
            parts += [text[at:a], decoded]
            at = b
        text = "".join([*parts, text[at:]])
        if "Ã " in text and name in ("cp1252", "iso8859_15"):  # its second character had become a space
            text = re.sub(r"Ã (?= )", "à", text)
        total += len(best)
        how.append(name)
    return text, total, how


@lru_cache(None)
def _swaps() -> list[tuple[str, str, frozenset[int], np.ndarray]]:
    """(shown as, was, characters that change, translation) between one-byte encodings."""
    out = []
    for shown in SINGLE:
        for was in SINGLE:
            if shown != was:
                back = {b: c for c, b in to_byte(was).items() if not (b < 0xA0 and ord(c) == b)}
                table = {ord(c): ord(back[b]) for c, b in to_byte(shown).items() if b in back and back[b] != c}
                array = np.arange(LAST_CODE + 1, dtype=np.uint32)
                for k, v in table.items():
                    if k < LAST_CODE and v < LAST_CODE:
                        array[k] = v
                out.append((shown, was, frozenset(table), array))
    return out


@lru_cache(None)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(LAST_CODE + 1)])


#: Where one-byte encodings were mixed up, some character is out of place: no small letter behind a small letter, a
#: run of accented letters, two scripts in a word, a capital within a word, a letter from beyond Latin-1.
_PLACED = "ß-öø-ÿœ’‘“”…—–«»°·½²³\u00a0\u00ad\u0300-\u036f\u2000-\u200f\u202f\u2060\ufeff\U0001f000-\U0001faff"
_MISPLACED = re.compile(
    rf"[^\x00-\x7f](?:(?<=[a-zß-öø-ÿ][^\x00-\x7f{_PLACED}])|(?<=[À-ÖØ-öø-ÿ])[À-ÖØ-öø-ÿ]{{3}}|(?<=[a-zA-Z][Ͱ-ӿ])|(?<=[Ͱ-ӿ])(?=[a-zA-Z])|(?<=[а-яё][А-ЯЁ])|(?<=[Ā-őŔ-ſ\x80-\x9f]))"
)


def pair_codes(text: str) -> np.ndarray:
    """Codes of the pairs of neighbouring characters of which one is beyond ASCII and both are under LAST_CODE."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = ((points[:-1] > 127) | (points[1:] > 127)) & (points[:-1] < LAST_CODE) & (points[1:] < LAST_CODE)
    at = np.flatnonzero(keep)
    return points[at].astype(np.int64) << 16 | points[at + 1]


class Pairs:
    """Log frequencies of character pairs, fitted on all texts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order].astype(float)
        self.floor = 0.5

    def log(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.log(np.where(self.codes[at] == codes, self.counts[at], 0) + self.floor)


def swap_spans(text: str, model: Pairs) -> tuple[str, int, list[str]]:
    """As :func:`decode_spans` for one-byte encodings taken for one another.

    For each two encodings, what the pairs of letters would gain is added up along the text, and the stretches with the
    largest sums are read anew where that gains enough, until none does. A character is read anew ROUNDS times at most,
    which ends it.
    """
    how: list[str] = []
    if not len(model.codes) or not _MISPLACED.search(text):
        return text, 0, how
    letters = _letters()
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    times = np.zeros(len(points), np.uint8)
    while True:
        low = np.minimum(points, LAST_CODE)
        at = np.flatnonzero((low[:-1] > 127) | (low[1:] > 127))
        x, y = low[at], low[at + 1]
        old = model.log(x.astype(np.int64) << 16 | y)
        both = letters[x] & letters[y]
        often = times >= ROUNDS
        present = set(np.unique(low[(low > 127) & ~often]).tolist())
        better: list[tuple[float, int, int, str, np.ndarray]] = []
        for shown, was, changes, table in _swaps():
            if present.isdisjoint(changes):
                continue
            u, v = np.where(often[at], x, table[x]), np.where(often[at + 1], y, table[y])
            gain = np.where(letters[u] & letters[v], model.log(u.astype(np.int64) << 16 | v) - old, np.where(both, -3.0, 0.0))
            gain[(u == x) & (v == y)] = 0
            better += [(total, first, last, f"{was}>{shown}", table) for total, first, last in _stretches(gain, at)]
        taken = np.zeros(len(points) + 1, bool)
        for _, first, last, name, table in sorted(better, key=lambda s: -s[0]):
            if taken[first - 1 if first else 0 : last + 1].any():  # beside one that is read anew now: the next round tells
                continue
            taken[first:last] = True
            part = points[first:last]
            new = np.where((part < LAST_CODE) & ~often[first:last], table[np.minimum(part, LAST_CODE)], part)
            times[first:last] += new != part
            points[first:last] = new
            how.append(name)
        if not better:
            break
    return points[1:-1].tobytes().decode("utf-32-le", "surrogatepass"), len(how), how


def _stretches(gain: np.ndarray, at: np.ndarray) -> list[tuple[float, int, int]]:
    """(gain, start, end) of the stretches of characters that gain enough: one between any two new lows of the sum."""
    sums = np.concatenate([[0], np.cumsum(gain)])
    least = np.minimum.accumulate(sums)
    over = sums - least
    if over.max() <= LEAST_GAIN:
        return []
    lows = np.flatnonzero(sums == least)
    out = []
    for k in np.flatnonzero(np.maximum.reduceat(over, lows) > LEAST_GAIN):
        i, end = int(lows[k]), int(lows[k + 1]) if k + 1 < len(lows) else len(sums)
        j = i + int(np.argmax(over[i:end]))
        total = float(over[j])
        if total < LEAST_MEAN_GAIN * np.count_nonzero(gain[i:j]):
            continue
        while i and gain[i - 1] == 0:
            i -= 1
        while j < len(gain) and gain[j] == 0:
            j += 1
        out.append((total, int(at[i]), int(at[j - 1]) + 2))
    return out


def inspect(text: str, model: Pairs) -> tuple[bool, str | None, int, str | None]:
    """(garbled, original text or null where part of it is lost, spans, how it went wrong)."""
    lost = any(not _quoted(text, m.start(), m.end(), _LOST) for m in re.finditer(_LOST, text))
    fixed, n, how = decode_spans(text)
    fixed, m, more = swap_spans(fixed, model)
    if not (n or m or lost):
        return False, None, 0, None
    return True, None if lost else fixed, n + m + text.count(_LOST), ",".join([*how, *more, *(["lost"] * lost)])


def fit_pairs(df: DataFrame, text: str = "text") -> Pairs:
    """Count the pairs of all texts. There are at most as many different ones as pairs of characters of the encodings'
    repertoires, which bounds what comes to the driver whatever the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t and not t.isascii()]
            for i in range(0, len(texts), 500):
                held.append(np.stack(np.unique(pair_codes(" ".join(texts[i : i + 500])), return_counts=True)))
        if held:
            both = np.concatenate(held, axis=1)
            codes, at = np.unique(both[0], return_inverse=True)
            sums = np.bincount(at, both[1], len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["code", "n"])

    repertoire = sorted({ord(c) for codec in SINGLE for c in to_byte(codec)} | set(range(128)))
    counted = df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "code long, n long")
    inside = lambda c: c.isin(repertoire)
    counted = counted.where(inside(F.shiftright("code", 16)) & inside(F.col("code").bitwiseAND(0xFFFF)))
    rows = counted.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > 1).toPandas()
    return Pairs(rows["code"].to_numpy(), rows["n"].to_numpy())


def inspected(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, garbled, original, spans, how) of each text; a null text isn't garbled and has no original.

    ``original`` is the restored text of a garbled one, null where characters are lost (U+FFFD), and null for text
    that isn't garbled. ``how`` names the encodings a span was shown in, as was>shown for one-byte ones, or lost.
    """
    model = df.sparkSession.sparkContext.broadcast(fit_pairs(df, text))
    schema = T.StructType(
        [
            T.StructField(ident, df.schema[ident].dataType), T.StructField("garbled", T.BooleanType()), T.StructField("original", T.StringType()),
            T.StructField("spans", T.IntegerType()), T.StructField("how", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = model.value
        for batch in batches:
            rows = [(False, None, 0, None) if not t or t.isascii() else inspect(t, pairs) for t in batch[text]]
            out = pd.DataFrame(rows, columns=["garbled", "original", "spans", "how"])
            out.insert(0, ident, batch[ident].to_numpy())
            yield out

    return df.select(ident, text).mapInPandas(run, schema)

"""Audit of a tokenizer on probe texts, totals and by domain, and comparison with another one."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import MARKERS
from lexiloom.operators.shards import FIRST_BYTE, byte_count

Codec = tuple[Callable[[str], list[int]], Callable[[list[int]], str]]


def byte_codec() -> Codec:
    """The byte vocabulary: a token for each byte, behind the three markers."""

    def decode(ids: list[int]) -> str:
        out = b"".join(MARKERS[i].encode() if i < FIRST_BYTE else bytes([i - FIRST_BYTE]) for i in ids)
        return out.decode("utf-8", "replace")

    def encode(text: str) -> list[int]:
        out, at = [], 0
        while at < len(text):
            found = min(((i, k) for k, m in enumerate(MARKERS) if (i := text.find(m, at)) >= 0), default=(len(text), -1))
            out += [b + FIRST_BYTE for b in text[at : found[0]].encode("utf-8", "replace")]
            out += [found[1]] if found[1] >= 0 else []
            at = found[0] + (len(MARKERS[found[1]]) if found[1] >= 0 else 0)
        return out

    return encode, decode


def file_codec(path: str) -> Codec:
    """A tokenizer.json file, without added special tokens."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return (lambda text: made.encode(text, add_special_tokens=False).ids), (lambda ids: made.decode(ids, skip_special_tokens=False))


def file_problems(path: str) -> list[str]:
    """Markers that a tokenizer file doesn't have as one token each."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return [m for m in MARKERS if (i := made.token_to_id(m)) is None or made.encode(m, add_special_tokens=False).ids != [i]]


def unknown_id(path: str) -> int | None:
    """Id of the unknown token of a tokenizer file; None if it has none."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    name = model.get("unk_token")
    return model["vocab"].get(name) if name is not None else None


def vocabulary_sha(path: str) -> str:
    """SHA-256 of the vocabulary as sorted JSON."""
    import hashlib

    from tokenizers import Tokenizer

    return hashlib.sha256(json.dumps(Tokenizer.from_file(path).get_vocab(), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def missing_bytes(vocabulary: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of the byte alphabet (symbol) that the vocabulary (symbol) lacks."""
    return symbols.select("symbol").distinct().join(vocabulary.select("symbol").distinct(), "symbol", "left_anti")


def measured(df: DataFrame, codec: Callable[[], Codec], ident: str, text: str = "text", unknown: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ident, keep..., tokens, exact, unknown) of each text that isn't null; ``codec`` is called in the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, decode = codec()
        for batch in batches:
            ids = [encode(t) for t in batch[text]]
            out = batch.drop(columns=[text])
            out["bytes"] = [len(t.encode("utf-8", "replace")) for t in batch[text]]
            out["chars"] = [len(t) for t in batch[text]]
            out["tokens"] = [len(i) for i in ids]
            out["exact"] = [int(decode(i) == t) for i, t in zip(ids, batch[text])]
            out["unknown"] = [sum(x == unknown for x in i) for i in ids]
            yield out

    longs = [T.StructField(c, T.LongType()) for c in ("bytes", "chars", "tokens", "exact", "unknown")]
    schema = T.StructType([df.schema[ident], *(df.schema[k] for k in keep), *longs])
    return df.where(F.col(text).isNotNull()).select(ident, *keep, text).mapInPandas(run, schema)


def byte_measured(df: DataFrame, ident: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`measured` with the byte vocabulary, without Python."""
    rows = df.where(F.col(text).isNotNull())
    tokens = byte_count(F.col(text)).cast("long")
    return rows.select(
        ident, *keep, F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("chars"), tokens.alias("tokens"),
        F.lit(1).cast("long").alias("exact"), F.lit(0).cast("long").alias("unknown"),
    )


def report(rows: DataFrame, domain: str = "domain", has_unknown: bool = False) -> DataFrame:
    """domain (null for the total), samples, bytes, chars, tokens, exact, unknown (null without such a token), ratios."""
    sums = rows.rollup(domain).agg(
        F.count(F.lit(1)).alias("samples"), *(F.sum(c).alias(c) for c in ("bytes", "chars", "tokens", "exact", "unknown")), F.grouping(domain).alias("total")
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    out = sums if has_unknown else sums.withColumn("unknown", F.lit(None).cast("long"))
    return out.withColumn("bytes_per_token", ratio("bytes", "tokens")).withColumn("tokens_per_char", ratio("tokens", "chars"))


def compared(candidate: DataFrame, baseline: DataFrame, domain: str = "domain") -> DataFrame:
    """domain, total, tokens of both, their difference and ratio, for each row of the candidate's report."""
    b = baseline.select(F.col(domain).alias("__d"), F.col("total").alias("__t"), F.col("tokens").alias("baseline_tokens"))
    c = candidate.select(domain, "total", "tokens")
    joined = c.join(b, c[domain].eqNullSafe(F.col("__d")) & (c["total"] == F.col("__t")), "left")
    return joined.select(
        domain, "total", "tokens", "baseline_tokens", (F.col("tokens") - F.col("baseline_tokens")).alias("difference"),
        F.try_divide(F.col("tokens").cast("double"), F.col("baseline_tokens").cast("double")).alias("ratio"),
    )

"""Token streams: byte tokens, positions, shards of fixed size, windows, checks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import hashing
from lexiloom.functions import text as tx
from lexiloom.runtime import ranges

#: Ids of the markers in the byte vocabulary; the 256 bytes follow them.
USER_ID, ASSISTANT_ID, END_ID, FIRST_BYTE = 0, 1, 2, 3


MARKER = r"<\|(?:user|assistant|end)\|>"


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def byte_ids(text: pd.Series) -> pd.Series:
    """The byte vocabulary's ids of a text: its UTF-8 bytes behind the three markers, which are one id each."""
    marks = {tx.USER: [USER_ID], tx.ASSISTANT: [ASSISTANT_ID], tx.END: [END_ID]}

    def ids(t: str) -> np.ndarray:
        parts = [t] if "<|" not in t else re.split(f"({MARKER})", t)
        arrays = [np.array(marks[p], np.int32) if p in marks else np.frombuffer(p.encode("utf-8", "replace"), np.uint8).astype(np.int32) + FIRST_BYTE for p in parts]
        return arrays[0] if len(arrays) == 1 else np.concatenate(arrays)

    return pd.Series([None if t is None else ids(t) for t in text])


def byte_count(text: Column) -> Column:
    """The number of ids that :func:`byte_ids` gives, without building them."""
    return F.octet_length(F.regexp_replace(text, MARKER, "x"))


def document_ids(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``ids``: of its trimmed text, the end marker and a line feed. Encoded one by one, documents give the
    same ids as their concatenation. A null text is an empty one."""
    return df.withColumn("ids", byte_ids(_record(text)))


def _record(text: str) -> Column:
    return F.concat(tx.trimmed(tx.unix_lines(F.coalesce(F.col(text), F.lit("")))), F.lit(f"{tx.END}\n"))


def document_size(text: str = "text") -> Column:
    """The number of ids that :func:`document_ids` gives a row."""
    return byte_count(_record(text))


def positions(df: DataFrame, split: str, pos: str, size: Column, buckets: int = 256) -> DataFrame:
    """df with ``start``: the sizes of the split's rows before each row in the order of ``pos`` (unique, a number).

    Sums of ranges of ``pos`` come first, then running sums within each range: a split that holds nearly all rows is
    spread over ``buckets`` tasks.
    """
    low, high = df.agg(F.min(pos), F.max(pos)).first()
    low, high = (0, 0) if low is None else (low, high)
    wide = df.withColumn("__n", size.cast("long")).withColumn("__b", ranges(F.col(pos), low, high, buckets))
    sums = wide.groupBy(split, "__b").agg(F.sum("__n").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(split).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(split).alias("__split"), F.col("__b").alias("__c"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum("__n").over(Window.partitionBy(split, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    placed = wide.withColumn("__within", F.coalesce(within, F.lit(0)))
    # as many rows as splits and buckets
    joined = placed.join(F.broadcast(sums), (F.col(split).eqNullSafe(F.col("__split"))) & (F.col("__b") == F.col("__c")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__within")).alias("start"))


def shards(df: DataFrame, split: str, shard_tokens: int, ids: str = "ids", start: str = "start") -> DataFrame:
    """(split, shard, tokens): the split's stream cut every ``shard_tokens`` ids; only the last shard may be shorter.

    Each row is cut at the bounds of the shards that it reaches into, so what is gathered is one shard at a time.
    """
    n = F.size(ids)
    first, last = F.floor(F.col(start) / shard_tokens), F.floor((F.col(start) + n - 1) / shard_tokens)
    parts = df.where(n > 0).select(
        F.col(split).alias("split"), F.col(ids).alias("__ids"), F.col(start).alias("__start"), F.explode(F.sequence(first, last)).alias("shard")
    )
    low = F.greatest(F.lit(0), F.col("shard") * shard_tokens - F.col("__start"))
    high = F.least(F.size("__ids"), (F.col("shard") + 1) * shard_tokens - F.col("__start"))
    cut = parts.select("split", "shard", F.col("__start").alias("at"), F.slice("__ids", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]))
    return cut.groupBy("split", "shard").agg(tokens.alias("tokens"))


def manifest(shard_rows: DataFrame) -> DataFrame:
    """(split, shard, name, tokens, bytes, checksum) of each shard."""
    n = F.size("tokens").cast("long")
    return shard_rows.select("split", "shard", hashing.shard_name(F.col("split"), F.col("shard")).alias("name"), n.alias("tokens"), (n * 4).alias("bytes"), hashing.checksum(F.col("tokens")).alias("checksum"))


def manifest_problems(files: DataFrame, shard_tokens: int) -> DataFrame:
    """(split, problem): missing split, gap in the numbering, wrong name, wrong size in bytes, short shard before the last, empty or too long shard."""
    expected = files.sparkSession.createDataFrame([(s,) for s in hashing.SPLITS], "split string")
    missing = expected.join(files, "split", "left_anti").select("split", F.lit("missing").alias("problem"))
    by = Window.partitionBy("split")
    seen = files.withColumn("__last", F.max("shard").over(by)).withColumn("__row", F.row_number().over(by.orderBy("shard")) - 1)
    checks = {
        "numbering": F.col("shard") != F.col("__row"),
        "name": F.col("name") != hashing.shard_name(F.col("split"), F.col("shard")),
        "bytes": F.col("bytes") != F.col("tokens") * 4,
        "size": (F.col("tokens") <= 0) | (F.col("tokens") > shard_tokens) | ((F.col("shard") < F.col("__last")) & (F.col("tokens") != shard_tokens)),
    }
    found = seen.select("split", F.explode(F.array(*[F.when(c, name) for name, c in checks.items()])).alias("problem")).where("problem is not null")
    return missing.unionByName(found.distinct())


def unknown_ids(shard_rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, occurrences) of the ids of shards that the vocabulary (id) lacks. Counted before they meet it."""
    used = shard_rows.select(F.explode("tokens").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("occurrences"))
    return used.join(vocabulary.select("id").distinct(), "id", "left_anti")


def file_problems(found: DataFrame, expected: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(split, shard, problem) of shard files (split, shard, tokens, bytes, sha256) against their manifest (split, shard,
    bytes, sha256) and the vocabulary (id): missing, unexpected, bytes, sha256, alignment, ids.

    Ids are counted per shard before they meet the vocabulary, so a shard sends as many rows as it has different ids.
    """
    e, f = expected.select("split", "shard", F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha")), found.withColumn("__there", F.lit(True))
    joined = e.withColumn("__listed", F.lit(True)).join(f, ["split", "shard"], "full")
    checks = {
        "missing": F.col("__there").isNull(),
        "unexpected": F.col("__listed").isNull(),
        "bytes": F.col("bytes") != F.col("__bytes"),
        "sha256": F.col("sha256") != F.col("__sha"),
        "alignment": F.col("__there") & F.col("tokens").isNull(),
    }
    of_files = joined.select("split", "shard", F.explode(F.array(*[F.when(c, name) for name, c in checks.items()])).alias("problem")).where("problem is not null")
    ids = found.select("split", "shard", F.explode(F.array_distinct("tokens")).alias("id")).join(vocabulary.select("id").distinct(), "id", "left_anti")
    return of_files.unionByName(ids.select("split", "shard", F.lit("ids").alias("problem")).distinct())


def verified(found: DataFrame, expected: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The shard files, if they are as the manifest and the vocabulary say; else an error. Only then are windows read."""
    if problems := file_problems(found, expected, vocabulary).limit(20).collect():
        raise ValueError("; ".join(f"{r['split']} {r['shard']}: {r['problem']}" for r in problems))
    return found


def windows(shard_rows: DataFrame, wanted: DataFrame, shard_tokens: int) -> DataFrame:
    """(split, start, len, tokens) of the windows (split, start, len) that are wanted; windows must lie in the stream.

    A window meets the shards that it reaches into by their number, an equality, and takes its part of each. A window
    that reaches beyond the end comes out shorter, which :func:`out_of_range` tells.
    """
    ends = F.col("start") + F.greatest("len", F.lit(1)) - 1
    spread = wanted.distinct().select("split", "start", "len", F.explode(F.sequence(F.floor(F.col("start") / shard_tokens), F.floor(ends / shard_tokens))).alias("shard"))
    joined = spread.join(shard_rows, ["split", "shard"], "left")
    low = F.greatest(F.lit(0), F.col("start") - F.col("shard") * shard_tokens)
    high = F.least(F.coalesce(F.size("tokens"), F.lit(0)), F.col("start") + F.col("len") - F.col("shard") * shard_tokens)
    part = F.when((high > low) & F.col("tokens").isNotNull(), F.slice("tokens", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = joined.select("split", "start", "len", "shard", part.alias("part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shard", "part"))), lambda x: x["part"]))
    return parts.groupBy("split", "start", "len").agg(whole.alias("tokens"))


def out_of_range(read: DataFrame) -> DataFrame:
    return read.where(F.size("tokens") != F.col("len"))


def evaluation_starts(spark, tokens: int, sequence: int, count: int) -> DataFrame:
    """(i, start): evenly spread starts of up to ``count`` windows of sequence + 1 tokens, the last one at the end."""
    span = tokens - sequence - 1
    if span < 0:
        raise ValueError("fewer tokens than a window needs")
    n = min(count, span + 1)
    return spark.range(n).select(F.col("id").alias("i"), F.floor(F.col("id") * span / max(n - 1, 1)).alias("start")) if span < 2**40 else spark.range(n).select(
        F.col("id").alias("i"), (F.col("id").cast("decimal(30,0)") * span / max(n - 1, 1)).cast("long").alias("start")
    )


def training_starts(spark, tokens: int, sequence: int, batch: int, steps: int, seed: int) -> DataFrame:
    """(step, row, start): random starts in [0, tokens - sequence) that depend on the seed, the step and the row only."""
    if tokens <= sequence:
        raise ValueError("fewer tokens than a window needs")
    rows = spark.range(steps * batch).select(F.floor(F.col("id") / batch).alias("step"), (F.col("id") % batch).alias("row"))
    drawn = hashing.step_seed(F.lit(seed), F.col("step") * batch + F.col("row"))
    return rows.select("step", "row", (drawn % F.lit(tokens - sequence).cast("decimal(20,0)")).cast("long").alias("start"))


def training_pairs(read: DataFrame) -> DataFrame:
    """df of windows with ``input`` and ``target``, the latter one token ahead."""
    n = F.size("tokens")
    return read.withColumn("input", F.slice("tokens", F.lit(1), n - 1)).withColumn("target", F.slice("tokens", F.lit(2), n - 1))

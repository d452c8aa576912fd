"""Byte quotas of domains: fragments, sizing, selection, order."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAGMENT_BYTES = 4096


def config_problems(config: Mapping) -> list[str]:
    """What is wrong with a mix: budget, percentages, sources, partitions, files, hashes."""
    out = []
    if not 100 <= config.get("max_text_bytes", 0) <= 256 * 2**20:
        out.append("max_text_bytes")
    shares = config.get("percentages", [])
    if len(shares) != 3 or sum(shares) != 100 or any(not 1 <= p <= 98 for p in shares):
        out.append("percentages")
    sources = config.get("sources", [])
    if not 1 <= len(sources) <= 10_000 or len({s["id"] for s in sources}) != len(sources):
        out.append("sources")
    for s in sources:
        stem = s["file"].replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if s["partition"] != "train" or stem in ("test", "validation"):
            out.append(f"partition of {s['id']}")
        if len(s["sha256"]) != 64 or any(c not in "0123456789abcdef" for c in s["sha256"].lower()):
            out.append(f"sha256 of {s['id']}")
    return out


def cut_places(data: bytes, size: int = FRAGMENT_BYTES) -> list[tuple[int, int]]:
    """Offsets and lengths of pieces of at most ``size`` bytes that end between characters and leave no gap."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((at, end - at))
        at = end
    return out


def fragments(df: DataFrame, ident: str, text: str, size: int = FRAGMENT_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ident, keep..., offset, bytes, fragment) of each text; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                data = row[1].encode("utf-8", "replace")
                rows += [(row[0], *row[2:], at, n, data[at : at + n].decode("utf-8")) for at, n in cut_places(data, size)]
            yield pd.DataFrame(rows, columns=[ident, *keep, "offset", "bytes", "fragment"])

    fields = [df.schema[ident], *(df.schema[k] for k in keep)]
    schema = T.StructType([*fields, T.StructField("offset", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("fragment", T.StringType())])
    return df.where(F.col(text).isNotNull()).select(ident, text, *keep).mapInPandas(run, schema)


def sizing(pool: DataFrame, percentages: Mapping[str, int], most_bytes: int, sources: int, domain: str = "domain") -> DataFrame:
    """(domain, percentage, available, effective, target): bytes of each domain in a mix of at most ``most_bytes``.

    A reserve for line feeds goes first; the mix is then as large as the scarcest domain allows. All divisions are of
    whole numbers. One row per domain that has a percentage; a domain without text makes the mix empty.
    """
    spark = pool.sparkSession
    shares = spark.createDataFrame(sorted(percentages.items()), f"`{domain}` string, percentage int")
    reserve = sources + -(-most_bytes // 4093) + 3
    have = pool.groupBy(domain).agg(F.sum("bytes").cast("long").alias("available"))
    rows = shares.join(have, domain, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    room = F.expr("available * 100 div percentage")
    least = F.least(F.lit(max(0, most_bytes - reserve)).cast("long"), F.min(room).over(Window.partitionBy()))
    return rows.withColumn("effective", least).withColumn("target", F.expr("effective * percentage div 100"))


def select(pool: DataFrame, targets: DataFrame, seed: int, ident: str, domain: str = "domain", buckets: int = 64) -> DataFrame:
    """The pool's rows (ident, domain, offset, bytes) that are taken, with ``taken`` bytes of each.

    The fragments of a domain come in the order of a seeded hash until its target is reached; of the last one only
    what is left of it is taken, which a text cut (:func:`clipped`) then ends between characters. No fragment comes twice.
    The running sum goes over ranges of the hash first, so that a domain isn't in one task.
    """
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(ident).cast("string"), F.col("offset").cast("string")), 256)
    rows = pool.join(F.broadcast(targets.select(domain, "target")), domain).withColumn("__h", order)  # a row per domain
    rows = rows.withColumn("__b", (F.conv(F.substring("__h", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    sums = rows.groupBy(domain, "__b").agg(F.sum("bytes").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(domain).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(domain, "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum("bytes").over(Window.partitionBy(domain, "__b").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("__w", F.coalesce(within, F.lit(0))).join(F.broadcast(sums), [domain, "__b"])
    taken = F.greatest(F.lit(0), F.least(F.col("bytes"), F.col("target") - F.col("__before") - F.col("__w")))
    return placed.withColumn("taken", taken.cast("long")).where("taken > 0").select(*pool.columns, "taken")


@F.pandas_udf(T.StringType())
def clipped(text: pd.Series, size: pd.Series) -> pd.Series:
    """The first ``size`` bytes of a text, less what would split a character."""
    return pd.Series([None if t is None else t.encode("utf-8", "replace")[: int(n)].decode("utf-8", "ignore") for t, n in zip(text, size)])


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """df in the order of a seeded hash of its keys."""
    return df.orderBy(shuffle_key(seed, *keys))


def shuffle_key(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(f"shuffle {seed}"), *[F.col(k).cast("string") for k in keys]), 256)


def retained(chosen: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, fragments, bytes, percent) of what was taken."""
    sums = chosen.groupBy(domain).agg(F.count(F.lit(1)).alias("fragments"), F.sum("taken").cast("long").alias("bytes"))
    return sums.withColumn("percent", F.try_divide(F.col("bytes") * 100.0, F.sum("bytes").over(Window.partitionBy()).cast("double")))


def rehearsal(web: DataFrame, old: DataFrame, text: str = "text") -> DataFrame:
    """(part, repeat, text): web rows once, old rows as often as it takes to weigh as much in bytes, at least once."""
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0))).first()[0]
    weight = size(old)
    times = max(1, -(-size(web) // weight)) if weight else 1
    again = old.select(F.lit("old").alias("part"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("repeat"), F.col(text).alias("text"))
    return web.select(F.lit("web").alias("part"), F.lit(1).alias("repeat"), F.col(text).alias("text")).unionByName(again)

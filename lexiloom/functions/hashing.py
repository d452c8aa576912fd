"""Hashes, hash-based splits and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DecimalType

from lexiloom.functions.text import trimmed

SPLITS = ("train", "validation", "test")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def trimmed_sha(text: Column) -> Column:
    return sha(trimmed(text))


def unsigned_prefix(text: Column) -> Column:
    """The first eight bytes of the SHA-256, big-endian, as decimal digits (an unsigned number fits no Spark type)."""
    return F.conv(F.substring(sha(text), 1, 16), 16, 10)


def _split(bucket: Column) -> Column:
    return F.when(bucket.isNull(), None).when(bucket == 0, "test").when(bucket == 1, "validation").otherwise("train")


def split_of(key: Column) -> Column:
    """Split of a key by its hash: a tenth test, a tenth validation, the rest train. The remainder of ten is the last digit."""
    return _split(F.substring(unsigned_prefix(key), -1, 1).cast("int"))


def split_of_unit(key: Column) -> Column:
    """The same by the first byte of the hash alone, as curriculum units are split."""
    return _split(F.pmod(F.conv(F.substring(sha(key), 1, 2), 16, 10).cast("int"), F.lit(10)))


def article_key(language: Column, ident: Column) -> Column:
    return F.concat(language, F.lit(":"), ident.cast("string"))


def signed_little_endian(text: Column) -> Column:
    """The first eight bytes of the SHA-256, little-endian, as the bit pattern of a BIGINT."""
    h = sha(text)
    turned = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(turned, 16, -10).cast("long")


def distance(a: Column, b: Column) -> Column:
    """Bits in which two BIGINTs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def checksum(ids: Column) -> Column:
    """Fold c = 31 c + id modulo 2**64 over a list of numbers, as DECIMAL(20, 0); a null list gives null."""
    big = "decimal(38,0)"
    step = lambda c, x: ((c.cast("decimal(20,0)") * F.lit(31) + x) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast(big)
    return F.aggregate(ids, F.lit(0).cast(big), step).cast("decimal(20,0)")


@pandas_udf(DecimalType(20, 0))
def _mixed(seed, step):
    import decimal

    import numpy as np
    import pandas as pd

    # fixed values: the constants of splitmix64
    golden, first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    x = seed.to_numpy().astype(np.uint64) + step.to_numpy().astype(np.uint64) * golden + golden
    x = (x ^ (x >> np.uint64(30))) * first
    x = (x ^ (x >> np.uint64(27))) * second
    return pd.Series([decimal.Decimal(int(v)) for v in x ^ (x >> np.uint64(31))])


def step_seed(seed: Column, step: Column) -> Column:
    """splitmix64 of a seed at a step, as DECIMAL(20, 0); both must not be null."""
    return _mixed(seed.cast("long"), step.cast("long"))


def shard_name(split: Column, index: Column) -> Column:
    return F.format_string("%s/shard-%06d.u32", split, index.cast("int"))


def article_path(language: Column, identity: Column, revision: Column, text_sha: Column) -> Column:
    """Content-addressed place of a stored article."""
    return F.concat(F.lit("articles/"), language, F.lit("/"), F.substring(identity, 1, 2), F.lit("/"), identity, F.lit("/"), revision.cast("string"), F.lit("-"), text_sha, F.lit(".json"))

"""Token budget per source, language and domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import tokens as tok
from lexiloom.runtime import small_side_join

#: Language codes of three letters and the two-letter codes that name the same languages.
LANGUAGES = {"fra": "fr", "fre": "fr", "eng": "en", "deu": "de", "ger": "de", "spa": "es", "por": "pt", "rus": "ru", "ell": "el", "gre": "el", "ita": "it", "nld": "nl", "und": None}


def language(code: Column) -> Column:
    """A code in lower case and two letters where the language has such a code; blank, unknown and null give null."""
    plain = F.lower(F.trim(code))
    plain = F.when(plain == "", None).otherwise(F.regexp_extract(plain, "^[a-z]+", 0))
    out = plain
    for long, short in LANGUAGES.items():
        out = F.when(plain == long, F.lit(short)).otherwise(out)
    return F.when(out == "", None).otherwise(out)


def source(name: Column) -> Column:
    """A source's name without the outer space and capitals it may be misspelled with; blank gives null."""
    plain = F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))
    return F.when(plain == "", None).otherwise(plain)


def small_side(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """rows left joined with the few rows of ``small``, which has unique keys."""
    return small_side_join(rows, small, [key], "left")


def fingerprint(text: Column) -> Column:
    """128 bits of a whole text; null for null."""
    return F.unhex(F.md5(text))


def distinct_tokens(df: DataFrame, text: str = "text", **tokenizer) -> DataFrame:
    """(digest, tokens): each distinct text, tokenised once. Null texts have no row.

    Copies are merged before the shuffle, so a text that is a third of all rows travels once per map task.
    """
    distinct = df.where(F.col(text).isNotNull()).select(fingerprint(F.col(text)).alias("digest"), F.col(text).alias("text"))
    distinct = distinct.groupBy("digest").agg(F.first("text").alias("text"))
    return tok.count_tokens(distinct, "digest", "text", **tokenizer)


def document_tokens(df: DataFrame, keys: list[str], text: str = "text", **tokenizer) -> DataFrame:
    """keys and tokens of each row of df; a null text has 0 tokens, as an empty one."""
    counts = distinct_tokens(df, text, **tokenizer)
    rows = df.select(*keys, fingerprint(F.col(text)).alias("digest"))
    # the counts have one row per digest; hot digests on the other side are split by AQE's skew join
    joined = rows.where(F.col("digest").isNotNull()).join(counts, "digest").select(*keys, F.col("tokens").cast("long").alias("tokens"))
    return joined.unionByName(rows.where(F.col("digest").isNull()).select(*keys, F.lit(0).cast("long").alias("tokens")))


def totals(df: DataFrame, by: list[str], text: str = "text", **tokenizer) -> DataFrame:
    """by, documents, distinct_texts, tokens, distinct_tokens over each combination of ``by``.

    Rows are counted per digest and combination before they meet the counts: what is joined has at most one row per
    distinct text and combination, whatever the number of copies. ``tokens`` counts every copy, ``distinct_tokens``
    each text once in its combination.
    """
    counts = distinct_tokens(df, text, **tokenizer)
    grouped = df.groupBy(*by, fingerprint(F.col(text)).alias("digest")).agg(F.count(F.lit(1)).alias("copies"))
    n = F.coalesce("tokens", F.lit(0))
    return (
        grouped.join(counts, "digest", "left")
        .groupBy(*by)
        .agg(
            F.sum("copies").alias("documents"),
            F.count("digest").alias("distinct_texts"),
            F.sum(n * F.col("copies")).cast("long").alias("tokens"),
            F.sum(n).cast("long").alias("distinct_tokens"),
        )
    )


def slices(combined: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value and sums of ``combined`` for each dimension alone and, as dimension total, for everything."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("documents", "tokens")]
    spread = F.explode(
        F.array(
            F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value")),
            *(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions),
        )
    )
    return combined.select(spread.alias("x"), "documents", "tokens").groupBy("x.dimension", "x.value").agg(*sums)

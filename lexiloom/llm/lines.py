"""Lines that a site repeats in many of its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.runtime import cut, small_side_join

#: A line is repeated excessively from so many records and so large a share of its site's records on.
LEAST_RECORDS, LEAST_PERCENT = 5, 20


def site(url: Column) -> Column:
    """Host of a URL in lower case without user, port, final dot and leading ``www.``; null for null and blank."""
    host = F.lower(F.regexp_extract(url, r"(?U)^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/?#:\s]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host == "", None).otherwise(host)


def line_hashes(text: Column) -> Column:
    """For each line of text (split at ``\\n``) a 128-bit hash of its normal form, null where nothing is left of it.

    White space runs become one space, outer space goes, letters are lower case, digit runs become ``0``.
    """
    plain = F.regexp_replace(text, r"(?U)[^\S\n]+|[\x1c-\x1f]+", " ")
    plain = F.regexp_replace(F.lower(plain), "[0-9]+", "0")
    plain = F.regexp_replace(plain, r"(?m)^ +| +$", "")
    return F.transform(
        F.split(plain, "\n", -1),
        lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))),
    )


def frequent_lines(
    df: DataFrame, ident: str = "record_id", text: str = "text", url: str = "url", records: int = LEAST_RECORDS, percent: int = LEAST_PERCENT
) -> DataFrame:
    """(site, frequent): for each site that has any, the hashes of its excessively repeated lines.

    A record counts a line once. The counts per (site, hash) are combined before the shuffle and a busy site spreads
    over the hashes of its lines. A site has at most 100 / ``percent`` times as many frequent lines as a record of it
    has lines on average, so the list of a site is bounded by its texts, not by its number of records.
    """
    rows = df.select(site(F.col(url)).alias("site"), F.col(text).alias("text")).where(F.col("site").isNotNull())
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    once = F.array_distinct(F.filter(line_hashes(F.col("text")), lambda x: x.isNotNull()))
    counts = rows.where(F.col("text").isNotNull()).select("site", F.explode_outer(once).alias("line")).where(F.col("line").isNotNull()).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where(F.col("n") >= records).join(totals, "site").where(F.col("n") * 100 >= F.col("total") * percent)
    return kept.groupBy("site").agg(F.collect_list("line").alias("frequent"))


def marked(df: DataFrame, text: str = "text", url: str = "url", frequent: DataFrame | None = None, **limits) -> DataFrame:
    """df with ``repeated``: the numbers, from 0, of each text's excessively repeated lines, in order.

    The list is empty for records without text, without URL or of sites without such lines. Rows are not moved while
    the sites' lists are few enough to broadcast; otherwise the join is salted, as one site may hold a third of all.
    """
    frequent = frequent_lines(df, text=text, url=url, **limits) if frequent is None else frequent
    base = df.withColumn("__site", site(F.col(url)))
    joined = small_side_join(base, frequent.select(F.col("site").alias("__site"), F.col("frequent").alias("__frequent")), ["__site"], "left")
    numbered = F.transform(line_hashes(F.col(text)), lambda x, i: F.when(F.array_contains(F.col("__frequent"), x), i))
    hits = F.when(F.col("__frequent").isNotNull(), F.filter(numbered, lambda i: i.isNotNull()))
    return joined.select(*df.columns, F.coalesce(hits, F.array().cast("array<int>")).alias("repeated"))


def found(df: DataFrame, ident: str = "record_id", text: str = "text", url: str = "url", **limits) -> DataFrame:
    """(ident, line_no) of every excessively repeated line."""
    rows = marked(df.select(ident, text, url), text, url, **limits)
    # the plain explode would be preceded by a filter that computes the list a second time
    return rows.select(ident, F.explode_outer("repeated").alias("line_no")).where(F.col("line_no").isNotNull())


def cleaned(df: DataFrame, text: str = "text", url: str = "url", **limits) -> DataFrame:
    """df with ``text`` rebuilt without its excessively repeated lines, the others byte for byte, and ``removed``, their number."""
    rows = marked(df, text, url, **limits)
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col("repeated"), i))
    rebuilt = F.when(F.size("repeated") == 0, F.col(text)).otherwise(F.array_join(kept, "\n"))
    return rows.withColumn(text, rebuilt).withColumn("removed", F.size("repeated")).drop("repeated")

"""Removal of passages that a split of higher rank has too, and the check that none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import hashing
from lexiloom.functions import text as tx
from lexiloom.operators import dedup
from lexiloom.runtime import cut

def reserved_hashes(df: DataFrame, text: str = "text") -> DataFrame:
    """(sha) of all significant lines and blocks, once each."""
    hashes = F.array_distinct(F.transform(tx.fragments(F.col(text)), hashing.sha))
    return df.where(F.col(text).isNotNull()).select(F.explode(hashes).alias("sha")).distinct()


def cleaned(df: DataFrame, reserved: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, text, removed): each text without reserved blocks, then without reserved lines, and how many went.

    Line ends become ``\\n`` first; blank blocks vanish, blocks are joined by one blank line. Significant pieces meet
    the reserved hashes in one join by hash; the hashes found in a text come back to it as a list, which is no longer
    than the text's own pieces. Null texts stay null.
    """
    rows = df.select(ident, tx.unix_lines(F.col(text)).alias("t"))
    wanted = F.array_distinct(F.transform(tx.fragments(F.col("t")), hashing.sha))
    hits = rows.select(ident, F.explode(wanted).alias("sha")).join(reserved.select("sha").distinct(), "sha").groupBy(ident).agg(F.collect_set("sha").alias("hit"))
    joined = rows.join(hits, ident, "left").withColumn("hit", F.coalesce("hit", F.array().cast("array<string>")))
    # most texts have no hit: then nothing is hashed again
    gone = lambda x: (F.size("hit") > 0) & (F.length(x) >= tx.SIGNIFICANT_CHARS) & tx.is_significant(tx.trimmed(x)) & F.array_contains(F.col("hit"), hashing.trimmed_sha(x))
    split = tx.blocks(F.col("t"))
    kept_blocks = F.filter(split, lambda b: ~gone(b))
    kept = F.filter(F.transform(kept_blocks, lambda b: F.array_join(F.filter(tx.lines(b), lambda y: ~gone(y)), "\n")), lambda b: tx.trimmed(b) != "")
    removed_lines = F.aggregate(kept_blocks, F.lit(0), lambda n, b: n + F.size(F.filter(tx.lines(b), gone)))
    removed = F.size(F.filter(split, gone)) + removed_lines
    untouched = F.col("t").isNull()
    return joined.select(
        ident, F.when(untouched, None).otherwise(F.array_join(kept, "\n\n")).alias("text"), F.when(untouched, 0).otherwise(removed).alias("removed")
    )


def curate(df: DataFrame, ident: str, text: str = "text", split: str = "split") -> DataFrame:
    """(ident, split, text, removed): test as it is, validation without passages of test, train without those of test
    and of the cleaned validation.

    Passages are sought within each document; a text that loses all of it comes out empty. Rows without split are left out.
    """
    rows = df.select(ident, F.col(text).alias("text"), F.col(split).alias("split"))
    test = rows.where("split = 'test'").select(ident, "split", "text", F.lit(0).alias("removed"))
    of_test = cut(reserved_hashes(test))
    validation = cut(cleaned(rows.where("split = 'validation'"), of_test, ident))
    of_both = of_test.unionByName(reserved_hashes(validation))
    train = cleaned(rows.where("split = 'train'"), of_both, ident)
    name = lambda d, s: d.select(ident, F.lit(s).alias("split"), "text", "removed")
    return test.unionByName(name(validation, "validation")).unionByName(name(train, "train"))


def leaks(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """(kind, sha, splits): whole texts and significant fragments, end-marked records included, of several splits."""
    whole = (
        df.where(F.col(text).isNotNull() & F.col(split).isNotNull())
        .select(hashing.sha(tx.unix_lines(F.col(text))).alias("sha"), F.col(split).alias("s"))
        .distinct()
        .groupBy("sha")
        .agg(F.count(F.lit(1)).alias("splits"))
        .where("splits > 1")
        .select(F.lit("text").alias("kind"), "sha", "splits")
    )
    parts = dedup.shared_fragments(df, split, text, records=True).select(F.lit("fragment").alias("kind"), F.col("fragment_sha").alias("sha"), "splits")
    return whole.unionByName(parts)

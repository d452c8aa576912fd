"""Assignment of rows to train, validation and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import hashing
from lexiloom.functions.text import trimmed


def with_split(df: DataFrame, key: Column, unit: bool = False, name: str = "split") -> DataFrame:
    """df with the split of each row by a key; ``unit`` for the rule of curriculum units. A null key gives null."""
    return df.withColumn(name, (hashing.split_of_unit if unit else hashing.split_of)(key))


def split_sizes(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """split, documents, chars, bytes; a null text has none."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("documents"), zero(F.length(text)).alias("chars"), zero(F.octet_length(text)).alias("bytes"))


def unit_problems(units: DataFrame) -> DataFrame:
    """(problem, rows) of course units (id, topic, text): blank, repeated_id, repeated_text, and splits that stay empty."""
    blank = lambda c: F.coalesce(trimmed(F.col(c)), F.lit("")) == ""
    kinds = [units.where(blank("id") | blank("text")).select(F.lit("blank").alias("problem"))]
    for column in ("id", "text"):
        kinds.append(units.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").select(F.lit(f"repeated_{column}").alias("problem")))
    filled = with_split(units, F.col("id"), unit=True).where("split is not null").select("split").distinct()
    wanted = units.sparkSession.createDataFrame([(s,) for s in hashing.SPLITS], "split string")
    kinds.append(wanted.join(filled, "split", "left_anti").select(F.concat(F.lit("empty_"), "split").alias("problem")))
    found = kinds[0]
    for k in kinds[1:]:
        found = found.unionByName(k)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


def unit_summary(units: DataFrame) -> DataFrame:
    """(split, topic, units, bytes): what each split of the units holds, split as whole units by their id."""
    return with_split(units, F.col("id"), unit=True).groupBy("split", "topic").agg(F.count(F.lit(1)).alias("units"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))

"""Dialogue examples: duplicates, rendering, encoded exchanges, supervised positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators.shards import ASSISTANT_ID, END_ID, USER_ID, byte_ids


def rendered(question: Column, answer: Column) -> Column:
    """One exchange between markers, with question and answer trimmed, and a line feed."""
    return F.concat(F.lit(tx.USER), tx.trimmed(question), F.lit(tx.ASSISTANT), tx.trimmed(answer), F.lit(f"{tx.END}\n"))


def duplicate_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """(key, rows) of questions asked more than once, in whatever case and spacing, over all splits."""
    keyed = df.where(F.col(question).isNotNull()).select(tx.question_key(F.col(question)).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def exchanges(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """df with ``ids`` of the rendered exchange without its line feed, and ``assistant``, the place of that marker."""
    ids = byte_ids(F.regexp_replace(rendered(F.col(question), F.col(answer)), r"\n\z", ""))
    made = df.withColumn("ids", ids)
    return made.withColumn("assistant", (F.array_position("ids", ASSISTANT_ID) - 1).cast("int"))


def exchange_problem(ids: Column, sequence: int) -> Column:
    """Why an encoded exchange can't be trained on: length, ends, markers, question or answer; null if it can."""
    count = lambda m: F.size(F.filter(ids, lambda x: x == m))
    at = F.array_position(ids, ASSISTANT_ID) - 1
    return (
        F.when(ids.isNull(), "length")
        .when(~F.size(ids).between(5, sequence + 1), "length")
        .when((F.element_at(ids, 1) != USER_ID) | (F.element_at(ids, -1) != END_ID), "ends")
        .when((count(USER_ID) != 1) | (count(ASSISTANT_ID) != 1) | (count(END_ID) != 1), "markers")
        .when(at <= 1, "question")
        .when(F.size(ids) - at <= 2, "answer")
    )


def supervised(ids: Column, assistant: Column) -> tuple[Column, Column]:
    """Targets (the answer's ids and the end marker) and the input places that predict them."""
    n = F.size(ids)
    return F.slice(ids, assistant + 2, n - assistant - 1), F.sequence(assistant, n - 2)


def batch(df: DataFrame, order: str, width: int | None = None) -> DataFrame:
    """One row: inputs padded with the end marker to a common width, targets and places in the flattened batch.

    ``df`` has ids and assistant and is one training batch, whose few rows are what is gathered.
    """
    longest = df.agg(F.max(F.size("ids"))).first()[0]
    size = width or (longest - 1 if longest else 0)
    targets, places = supervised(F.col("ids"), F.col("assistant"))
    padded = F.concat(F.slice("ids", F.lit(1), F.size("ids") - 1), F.array_repeat(F.lit(END_ID), F.lit(size) - (F.size("ids") - 1)))
    rows = df.select(F.struct(F.col(order).alias("o"), padded.alias("input"), targets.alias("t"), places.alias("p")).alias("x"))
    ordered = F.array_sort(F.collect_list("x"))
    return rows.agg(ordered.alias("x")).select(
        F.transform("x", lambda r: r["input"]).alias("input"),
        F.flatten(F.transform("x", lambda r: r["t"])).alias("target"),
        F.flatten(F.transform("x", lambda r, i: F.transform(r["p"], lambda v: v + i * size))).alias("places"),
    )


def spread_examples(spark, n: int, count: int) -> DataFrame:
    """(i, example): ``count`` places spread evenly over n examples."""
    k = min(n, count)
    return spark.range(k).select(F.col("id").alias("i"), F.floor(F.col("id") * (n - 1) / max(k - 1, 1)).alias("example"))


def weighted_loss(df: DataFrame, loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """Mean loss per token over examples."""
    return df.agg(F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens)).alias("loss"))

"""Continuous ingestion: articles into the library, first copies of texts, events into a journal."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.functions import hashing
from lexiloom.operators import library
from lexiloom.runtime import cut, shared_folder
from lexiloom.sources.files import JOURNAL

MOST_ERRORS = 10


def journal_line(event: str, cycle: int, message: str, unix: int | None = None) -> str:
    """An event as one line of JSON, whatever its message holds."""
    return json.dumps({"unix": int(time.time()) if unix is None else unix, "event": event, "cycle": cycle, "message": message}, ensure_ascii=True) + "\n"


class Journal:
    """An append-only log of one writer, the driver."""

    def __init__(self, path: str):
        self.path = Path(path)

    def write(self, event: str, cycle: int, message: str) -> None:
        with self.path.open("a", encoding="utf-8") as file:
            file.write(journal_line(event, cycle, message))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL).json(path)


def ingest_articles(
    articles: DataFrame, library_path: str, checkpoint: str, journal: Journal | None = None, hook: Callable[[DataFrame, int], None] | None = None,
    order: str = "record_id", most_errors: int = MOST_ERRORS,
) -> StreamingQuery:
    """Add the articles of a stream to the library of stored ones, micro-batch by micro-batch, until the source is drained.

    The library is the state: within a batch articles come in the order of a column, and what the library or an
    earlier article has is left out. A batch that is run again after a failure finds its articles in the library and
    adds none twice. ``hook`` gets each batch's new articles. More than ``most_errors`` errors of the hook end the query.
    """
    errors = 0

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal errors
        spark = rows.sparkSession
        incoming = library.stored(rows)
        incoming = incoming.withColumn("__order", F.struct(F.col("article.fetched_at_unix"), F.col("article.id"), F.col("article.revision_id"), F.col("text_sha256")))
        held = spark.read.parquet(library_path) if exists(spark, library_path) else incoming.limit(0)
        new = cut(library.new_articles(incoming.dropDuplicates(["identity_sha256", "article", "text_sha256"]), held, "__order").drop("__order"))
        new.write.mode("append").parquet(library_path)
        if journal:
            journal.write("batch", number, f"{new.count()} articles added")
        if hook:
            try:
                hook(new, number)
            except Exception as error:
                errors += 1
                if journal:
                    journal.write("error", number, str(error))
                if errors >= most_errors:
                    raise

    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_texts(rows: DataFrame, text: str = "text", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each text of a stream. With an event time, texts are remembered as long as the delay only;
    without one, for ever."""
    keyed = rows.withColumn("text_sha256", hashing.sha(F.col(text)))
    if event_time is None:
        return keyed.dropDuplicates(["text_sha256"])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["text_sha256"])


def event_counts(events: DataFrame, event_time: str = "ts", kind: str = "event_type", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, kind, events): rows per kind and window; of a stream, rows later than the delay are left out."""
    kept = events.withWatermark(event_time, delay) if events.isStreaming else events
    return kept.groupBy(F.window(event_time, width).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), kind, "events")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream's source holds now, taken through the stream in append mode to a table in the checkpoint folder.

    Windows that the watermark hasn't passed are not among it.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    run_until(query)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_until(query: StreamingQuery, stop_file: str | None = None, seconds: float | None = None, poll: float = 0.2) -> str:
    """Wait for a query's end, a STOP file or the time budget; returns end_of_source, STOP or time_budget."""
    began = time.monotonic()
    while query.isActive:
        if stop_file and Path(stop_file).exists():
            query.stop()
            return "STOP"
        if seconds is not None and time.monotonic() - began > seconds:
            query.stop()
            return "time_budget"
        query.awaitTermination(poll)
    if query.exception():
        raise query.exception()
    return "end_of_source"

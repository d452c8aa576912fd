"""File sources: split corpora, stored articles, dialogue files, probes, token shards, pinned sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = "struct<id:bigint,revision_id:bigint,title:string,url:string,language:string,text:string,license:string,fetched_at_unix:bigint>"
STORED = f"schema_version int, identity_sha256 string, text_sha256 string, article {ARTICLE}"
DOCUMENT = "id string, text string, url string, language string, language_script string, language_score double, quality_score double, date string, dump string"
BOOK = "file_id string, ocr string, title string, date string, author string, complete_text string, page_count bigint, word_count bigint"
EXAMPLE = "question string, answer string"
PROBE = "id string, domain string, text string"
JOURNAL = "unix bigint, event string, cycle int, message string"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(split, text): each train.txt, validation.txt and test.txt of a folder as one text, line ends kept."""
    rows = spark.read.text(f"{path}/*.txt", wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("f"))
    return rows.select(F.regexp_replace("f", r"\.txt$", "").alias("split"), "text").where(F.col("split").isin("train", "validation", "test"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): lines split at ``\\n`` only, so that a carriage return stays part of its line."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def strict_json(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """Rows of JSON files (an object or an array of objects each) with their ``file``; fails on fields that the schema lacks.

    The reader itself would drop such fields without a word.
    """
    wanted = T.StructType.fromDDL(schema)
    read = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    found = read.json(path).schema
    extra = sorted(set(found.names) - set(wanted.names) - {"_corrupt_record"})
    if extra or "_corrupt_record" in found.names:
        raise ValueError(f"unexpected fields: {', '.join(extra)}" if extra else "a file is no JSON")
    return read.schema(wanted).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_path"))


def stored_articles(spark: SparkSession, path: str) -> DataFrame:
    """The library's articles with their ``path`` inside it."""
    rows = spark.read.schema(STORED).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{path}/articles")
    return rows.withColumn("path", F.concat(F.lit("articles/"), F.regexp_extract(F.col("_metadata.file_path"), r"/articles/(.+)$", 1)))


def dialogue_examples(spark: SparkSession, path: str) -> DataFrame:
    """question, answer, file, split of dialogue files, the split being that of their folder or name."""
    rows = strict_json(spark, path, EXAMPLE)
    return rows.withColumn("split", F.regexp_extract("file", r"/(train|validation|test)(?:/[^/]+|(?:[-_.][^/]*)?\.json)$", 1))


def probes(spark: SparkSession, path: str) -> DataFrame:
    return strict_json(spark, path, PROBE, "*").drop("file")


@F.pandas_udf(T.ArrayType(T.LongType()))
def unpacked(content):
    """Little-endian unsigned 32-bit numbers of a file's bytes; null if they don't come in fours."""
    import numpy as np
    import pandas as pd

    return pd.Series([None if len(c) % 4 else np.frombuffer(c, "<u4").astype("int64") for c in content])


def token_shards(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(split, shard, tokens, bytes, sha256) of a split's .u32 files; other splits' files aren't opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.u32").load(f"{path}/{split}")
    number = F.regexp_extract("path", r"shard-(\d+)\.u32$", 1).cast("long")
    return files.select(F.lit(split).alias("split"), number.alias("shard"), unpacked("content").alias("tokens"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pinned_texts(spark: SparkSession, sources: DataFrame, root: str) -> DataFrame:
    """sources (id, domain, file, sha256, ...) with ``text`` and ``found_sha256``; a missing file has a null text.

    ``file`` is the path inside ``root``; a file of the same name elsewhere is another one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    read = files.select("path", F.sha2("content", 256).alias("found_sha256"), F.decode("content", "UTF-8").alias("text"))
    return sources.join(read.withColumn("file", inside("path", root)).drop("path"), "file", "left")


def inside(path: str, root: str) -> Column:
    """The path of a file inside a folder, for joins by equality. Both may be given with or without a scheme."""
    plain = lambda p: F.regexp_replace(F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:(?://[^/]*)?", "")
    return F.substr(plain(F.col(path)), F.length(plain(F.lit(root.rstrip("/")))) + 2)


def in_order(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``pos``: its rows' order by file name and place within the file."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    names = rows.select("__file").distinct().select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).cast("long").alias("__k"))  # one row a file
    return rows.join(names, "__file").withColumn("pos", F.shiftleft("__k", 40) + F.col("__row")).drop("__file", "__row", "__k")

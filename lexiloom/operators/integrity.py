"""Checks of files and streams: contained paths, pinned hashes, equal streams, resume signatures."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.files import inside


def contained(root: str, relative: str) -> str:
    """The joined path; fails if it leaves the root."""
    path = PurePosixPath(relative.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts or not path.parts or ":" in path.parts[0]:
        raise ValueError(f"{relative} is not inside its root")
    return f"{root.rstrip('/')}/{path}"


def file_hashes(spark, path: str, pattern: str = "*") -> DataFrame:
    """(path, file, bytes, sha256) of the files under a folder, ``file`` being the path inside it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", inside("path", path).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def unpinned(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, problem): expected files (file, bytes, sha256) that are missing or differ; ``files`` is of :func:`file_hashes`."""
    joined = expected.alias("e").join(files.alias("f"), F.col("f.file") == F.col("e.file"), "left")
    problem = F.when(F.col("f.path").isNull(), "missing").when(F.col("f.bytes") != F.col("e.bytes"), "bytes").when(F.col("f.sha256") != F.col("e.sha256"), "sha256")
    return joined.select(F.col("e.file").alias("file"), problem.alias("problem")).where("problem is not null")


def fingerprint(rows: DataFrame, split: str = "split", order: str = "shard", checksum: str = "checksum") -> DataFrame:
    """(split, fingerprint) of a stream by the ordered checksums of its shards, of which there are few."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, checksum))), lambda x: F.concat_ws(":", x[order].cast("string"), x[checksum].cast("string"))), ",")
    return rows.groupBy(split).agg(F.sha2(listed, 256).alias("fingerprint"))


def used_bytes(spark, path: str) -> int:
    """Bytes of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def signature(settings: Mapping, fingerprints: Mapping[str, str], tokenizer_sha: str) -> str:
    """What a run must have in common with the one it resumes."""
    return hashlib.sha256(json.dumps([dict(settings), dict(fingerprints), tokenizer_sha], sort_keys=True).encode()).hexdigest()

"""File sinks: split texts, manifests, token shards, stored articles, reports, pointers."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import hashing
from lexiloom.functions.hashing import SPLITS
from lexiloom.functions.text import END
from lexiloom.operators import library


def record(text: Column) -> Column:
    """A document as it stands in a split file, without the line feed."""
    return F.concat(text, F.lit(END))


def write_splits(df: DataFrame, path: str, text: str = "text", split: str = "split", order: str | None = None) -> None:
    """Text files under split=train and so on, ordered within each file; fails if the folder is there."""
    rows = df.select(F.col(split).alias("split"), *([order] if order else []), F.col(text).alias("value"))
    rows = rows.repartitionByRange("split", order).sortWithinPartitions("split", order).drop(order) if order else rows
    rows.write.mode("errorifexists").partitionBy("split").option("lineSep", "\n").text(path)


def import_state(counts: Mapping[str, int], stopped: str, error: str | None = None) -> dict:
    """The manifest's end: complete only without error, with all splits filled, and not stopped by hand or by time."""
    complete = error is None and all(counts.get(s, 0) > 0 for s in SPLITS) and stopped not in ("STOP", "time_budget")
    return {"complete": complete, "stopped": stopped, "error": error, "documents": {s: counts.get(s, 0) for s in SPLITS}}


def write_new(path: str, data: bytes | str) -> None:
    """A new small file on the driver, whole or not at all."""
    target = Path(path)
    part = target.with_name(f".{target.name}.{os.getpid()}.part")
    part.write_bytes(data.encode() if isinstance(data, str) else data)
    try:
        os.link(part, target)
    finally:
        part.unlink()


def write_manifest(folder: str, manifest: Mapping) -> str:
    """manifest.json, or incomplete-manifest.json for an import that isn't complete; returns the name."""
    name = "manifest.json" if manifest.get("complete", True) else "incomplete-manifest.json"
    write_new(f"{folder}/{name}", json.dumps(dict(manifest), ensure_ascii=False, indent=2, sort_keys=True))
    return name


def point(folder: str, name: str, value: Mapping) -> None:
    """A pointer file that is replaced in one step."""
    following = Path(folder, f"{name}.next.json")
    following.write_text(json.dumps(dict(value), sort_keys=True), encoding="utf-8")
    following.replace(Path(folder, f"{name}.json"))


def write_shards(shard_rows: DataFrame, path: str) -> DataFrame:
    """(split, shard, name, bytes, sha256): each shard as little-endian 32-bit numbers in its own new file, through
    PyArrow's file system of the path's URI, written where the shard is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        for batch in batches:
            out = []
            for split, shard, tokens in zip(*(batch.column(c).to_pylist() for c in ("split", "shard", "tokens"))):
                data = np.array(tokens, "<u4").tobytes()
                name = f"{split}/shard-{shard:06d}.u32"
                if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    held = system.open_input_stream(f"{root}/{name}").read()
                    if held != data:  # a task that runs again finds its own file
                        raise FileExistsError(name)
                else:
                    system.create_dir(f"{root}/{split}")
                    with system.open_output_stream(f"{root}/{name}.part-{os.getpid()}") as file:
                        file.write(data)
                    system.move(f"{root}/{name}.part-{os.getpid()}", f"{root}/{name}")
                out.append((split, shard, name, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["split", "shard", "name", "bytes", "sha256"])

    return shard_rows.select("split", F.col("shard").cast("long").alias("shard"), "tokens").mapInArrow(run, "split string, shard long, name string, bytes long, sha256 string")


class TooLittle(ValueError):
    """A split has no article or too little text for a window."""


def write_export(articles: DataFrame, path: str, context: int) -> dict:
    """The latest revisions of articles as split texts and a table of their sources, with a manifest; returns its summary.

    Fails with :class:`TooLittle` before anything is written, and if the folder is there.
    """
    rows = library.export_text(articles.withColumn("record_id", F.xxhash64("language", "id", "revision_id", "text")))
    rows = rows.withColumn("identity_sha256", hashing.sha(hashing.article_key(F.col("language"), F.col("id")))).withColumn("text_sha256", hashing.sha(F.col("text")))
    sizes = {r["split"]: r for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.octet_length("document")).alias("bytes"), F.sum(F.length("document")).alias("chars")).collect()}
    for split in SPLITS:
        if split not in sizes or sizes[split]["chars"] <= context:
            raise TooLittle(f"{split} has {sizes[split]['chars'] if split in sizes else 0} characters, a window {context}")
    # each document ends in a blank line: the writer adds the second line feed
    body = rows.withColumn("value", F.expr("left(document, length(document) - 1)")).withColumn("place", F.concat_ws(":", "language", F.lpad(F.col("id").cast("string"), 20, "0")))
    write_splits(body, f"{path}/corpus", text="value", order="place")
    names = ["id", "revision_id", "title", "url", "language", "license", "fetched_at_unix", "identity_sha256", "text_sha256", "split"]
    rows.select(*names).orderBy("language", "id").write.mode("errorifexists").json(f"{path}/sources")
    summary = {"articles": sum(r["articles"] for r in sizes.values())} | {f"{s}_bytes": sizes[s]["bytes"] for s in SPLITS}
    write_manifest(path, {"schema_version": 1, "summary": summary, "minimum_context_characters": context, "counts": {s: sizes[s]["articles"] for s in SPLITS}})
    return summary


def append_articles(stored: DataFrame, path: str) -> None:
    """New stored articles as a Parquet table, appended; duplicates are left out before by operators.library."""
    stored.write.mode("append").partitionBy("schema_version").parquet(path)

import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import integrity, library, shards
from lexiloom.runtime import checkpoint_dir
from lexiloom.sinks import files as sinks
from lexiloom.sources import files, paged
from lexiloom.streaming import ingest


def test_pages(spark, tmp_path):
    row = lambda i: {"id": f"d{i}", "text": f"texte {i}", "url": "https://a", "language": "fra", "embedding": [1, 2]}
    for offset in (0, 2, 4):
        rows = [{"row_idx": i, "row": row(i), "truncated_cells": ["text"] * (i == 3)} for i in range(offset, min(offset + 2, 5))]
        (tmp_path / f"{offset}.json").write_text(json.dumps({"rows": rows, "num_rows_total": 5, "partial": False}))
    spark.dataSource.register(paged.PagedSource)
    got = spark.read.format("paged").options(url=f"file://{tmp_path}/{{offset}}.json", rows="5", page="2").load().orderBy("row_idx").collect()
    assert [r["id"] for r in got] == ["d0", "d1", "d2", "d3", "d4"] and [r["truncated_cells"] for r in got] == [0, 0, 0, 1, 0] and got[0]["dump"] is None


def test_page_rows_are_checked():
    page = {"rows": [{"row_idx": 7, "row": {}}], "partial": True}
    with pytest.raises(ValueError, match="partial"):
        list(paged.page_rows(json.dumps(page).encode(), 7, []))
    with pytest.raises(ValueError, match="came where"):
        list(paged.page_rows(json.dumps(page).encode(), 6, [], partial=True))
    with pytest.raises(ValueError, match="https"):
        paged.fetch("http://a.test")


def test_encyclopedia_answers(rows):
    page = {"pageid": 5, "ns": 0, "title": "Moulin", "extract": "Un texte.", "revisions": [{"revid": 9}]}
    bodies = [{"query": {"pages": [page]}}, {"error": {"code": "x"}}, {"query": {"pages": [page | {"pageid": 6}]}}, {"query": {"pages": [page | {"missing": True}]}}, {"query": {"pages": [page | {"ns": 1}]}}, {"query": {"pages": [page | {"extract": " \n"}]}}, {"query": {"pages": [page | {"revisions": []}]}}]
    df = rows([(i, json.dumps(b), 5, "fr", 77) for i, b in enumerate(bodies)], "i int, body string, wanted long, lang string, at long")
    got = paged.parsed_articles(df, "body", "wanted", "lang", "at").orderBy("i").collect()
    assert [r["problem"] for r in got] == [None, "error", "page", "missing", "namespace", "blank", "revision"]
    assert got[0]["article"]["revision_id"] == 9 and got[1]["article"] is None
    found = rows([(json.dumps({"query": {"search": [{"pageid": 3, "ns": 0}, {"pageid": 4, "ns": 1}]}}),)], "b string").select(paged.search_ids(F.col("b")).alias("x"))
    assert found.first()["x"] == [3]


def test_split_files(spark, rows, tmp_path):
    df = rows([(2, "b\r\nc", "train"), (1, "a", "train"), (3, "d", "test"), (4, "e", "validation")], "pos int, text string, split string").withColumn("text", sinks.record(F.col("text")))
    sinks.write_splits(df, f"{tmp_path}/out", order="pos")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out/split=train").glob("*.txt")))
    assert text == "a<|end|>\nb\r\nc<|end|>\n"
    with pytest.raises(Exception, match="already exists"):
        sinks.write_splits(df, f"{tmp_path}/out", order="pos")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/train.txt").write_bytes(b"a\r\nb")
    (tmp_path / "in/other.txt").write_bytes(b"x")
    assert [tuple(r) for r in files.whole_texts(spark, f"{tmp_path}/in").collect()] == [("train", "a\r\nb")]
    assert sorted(r["text"] for r in files.text_lines(spark, f"{tmp_path}/in/train.txt").collect()) == ["a\r", "b"]


def test_strict_json(spark, tmp_path):
    (tmp_path / "train.json").write_text(json.dumps([{"question": "q", "answer": "a"}]))
    assert files.dialogue_examples(spark, str(tmp_path)).select("question", "split").collect()[0] == ("q", "train")
    (tmp_path / "test.json").write_text(json.dumps([{"question": "q", "answer": "a", "note": 1}]))
    with pytest.raises(ValueError, match="note"):
        files.dialogue_examples(spark, str(tmp_path))


def test_shard_files(spark, rows, tmp_path):
    made = rows([("train", 0, [1, 2, 2**31 - 1]), ("train", 1, [3]), ("test", 0, [4])], "split string, shard long, tokens array<int>")
    out = str(tmp_path / "shards")
    written = sinks.write_shards(made, out).collect()
    assert {r["name"] for r in written} == {"train/shard-000000.u32", "train/shard-000001.u32", "test/shard-000000.u32"}
    read = files.token_shards(spark, out, "train").orderBy("shard").collect()
    assert [r["tokens"] for r in read] == [[1, 2, 2**31 - 1], [3]] and {r["sha256"] for r in read} == {r["sha256"] for r in written if r["split"] == "train"}
    hashes = integrity.file_hashes(spark, out)
    expected = spark.createDataFrame([(r["name"], r["bytes"], r["sha256"]) for r in written], "file string, bytes long, sha256 string")
    assert integrity.unpinned(hashes, expected).count() == 0 and integrity.used_bytes(spark, out) == 20
    (tmp_path / "shards/test/shard-000000.u32").write_bytes(b"\x05\x00\x00\x00")
    assert [tuple(r) for r in integrity.unpinned(integrity.file_hashes(spark, out), expected).collect()] == [("test/shard-000000.u32", "sha256")]
    with pytest.raises(Exception, match="shard-000000"):
        sinks.write_shards(made, out).collect()
    assert shards.unknown_ids(files.token_shards(spark, out, "train"), spark.range(4)).first()["id"] == 2**31 - 1


def test_new_files(tmp_path):
    sinks.write_new(f"{tmp_path}/a", "x")
    with pytest.raises(FileExistsError):
        sinks.write_new(f"{tmp_path}/a", "y")
    assert (tmp_path / "a").read_text() == "x" and [p.name for p in tmp_path.iterdir()] == ["a"]
    full = {"train": 1, "validation": 1, "test": 1}
    assert sinks.write_manifest(str(tmp_path), sinks.import_state(full, "row_limit")) == "manifest.json"
    assert sinks.write_manifest(str(tmp_path), sinks.import_state({"train": 1}, "row_limit")) == "incomplete-manifest.json"
    assert not sinks.import_state(full, "STOP")["complete"] and not sinks.import_state(full, "row_limit", "x")["complete"]
    sinks.point(str(tmp_path), "latest", {"step": 1})
    sinks.point(str(tmp_path), "latest", {"step": 2})
    assert json.loads((tmp_path / "latest.json").read_text()) == {"step": 2}


def test_signature():
    a = integrity.signature({"lr": 1}, {"train": "x"}, "t")
    assert a == integrity.signature({"lr": 1}, {"train": "x"}, "t") != integrity.signature({"lr": 2}, {"train": "x"}, "t")


ARTICLE = "record_id long, id long, revision_id long, title string, url string, language string, text string, license string, fetched_at_unix long"


def test_ingestion(spark, rows, tmp_path):
    make = lambda n, *a: rows([(i, *x, "t", "u", "fr", text, "CC", n) for i, (*x, text) in enumerate(a)], ARTICLE).write.parquet(f"{tmp_path}/in/{n}")
    make(1, (1, 1, "a"), (2, 1, "b"), (3, 1, "a"))
    stream = lambda: spark.readStream.schema(ARTICLE).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    journal, seen = ingest.Journal(f"{tmp_path}/journal.jsonl"), []
    run = lambda: ingest.run_until(ingest.ingest_articles(stream(), f"{tmp_path}/lib", f"{tmp_path}/cp", journal, lambda df, n: seen.append(df.count())), seconds=120)
    assert run() == "end_of_source" and spark.read.parquet(f"{tmp_path}/lib").count() == 2
    make(2, (1, 2, "c"), (1, 1, "d"), (4, 1, "b"))
    run()
    held = spark.read.parquet(f"{tmp_path}/lib")
    assert held.count() == 3 and seen == [2, 1] and library.broken(held).count() == 0
    assert [r["event"] for r in ingest.read_journal(spark, f"{tmp_path}/journal.jsonl").collect()] == ["batch", "batch"]


def test_journal_lines():
    line = ingest.journal_line("x", 1, "a\nb\x1b", 5)
    assert line.count("\n") == 1 and "\x1b" not in line and json.loads(line)["message"] == "a\nb\x1b"


def test_stream_operators(spark, tmp_path):
    spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "a", f"t{h % 2}") for h in range(4)], "s string, event_type string, text string").selectExpr("cast(s as timestamp) ts", "event_type", "text").write.parquet(f"{tmp_path}/e")
    source = lambda: spark.readStream.schema("ts timestamp, event_type string, text string").parquet(f"{tmp_path}/e")
    for name, made in (("first", ingest.first_texts(source())), ("late", ingest.first_texts(source(), event_time="ts"))):
        made.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(name).count() == 2
    counts = ingest.event_counts(source()).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("counts").count() == 4


def test_stop_file(spark, tmp_path):
    (tmp_path / "STOP").touch()
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").start()
    assert ingest.run_until(query, str(tmp_path / "STOP")) == "STOP" and not query.isActive


def test_checkpoint_folder(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)

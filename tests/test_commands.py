import hashlib
import json

import pytest

from lexiloom.__main__ import main
from lexiloom.sources import files
from lexiloom.streaming import research

LONG = "Le moulin de la colline garde encore ses vieilles pierres, et chacun vient y chercher la farine du matin avant la fête. "


def test_corpus_commands(spark, tmp_path, capsys):
    rows = [(i, f"Texte {i}. " + LONG * 3 + f"Fin {i * 7919}.", f"https://site{i}.fr/p", "fra", "Latn", 0.9) for i in range(60)]
    rows += [(100, rows[0][1], "https://autre.fr", "fra", "Latn", 0.9), (101, "court", "https://autre.fr", "fra", "Latn", 0.9)]
    spark.createDataFrame(rows, "record_id long, text string, url string, language string, language_script string, language_score double").write.parquet(f"{tmp_path}/web")
    (tmp_path / "imported").mkdir()
    code = main(["import", f"{tmp_path}/web", "--out", f"{tmp_path}/imported"])
    manifest = json.loads(next((tmp_path / "imported").glob("*manifest.json")).read_text())
    assert manifest["rejected"]["length"] == 1 and sum(manifest["documents"].values()) >= 1 and code == (0 if manifest["complete"] else 1)

    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/test.txt").write_text(LONG)
    (tmp_path / "texts/validation.txt").write_text("Un autre texte.\n\n" + LONG)
    (tmp_path / "texts/train.txt").write_text("Le texte du train.\n\n" + LONG)
    assert main(["forge-build", f"{tmp_path}/texts", "--out", f"{tmp_path}/no"]) == 1 and not (tmp_path / "no").exists()
    assert main(["curate-text", f"{tmp_path}/texts", "--out", f"{tmp_path}/curated"]) == 0
    (tmp_path / "clean").mkdir()
    for s in ("train", "validation", "test"):
        (tmp_path / f"clean/{s}.txt").write_text("".join(p.read_text() for p in (tmp_path / f"curated/corpus/split={s}").glob("*.txt")))
    assert main(["forge-build", f"{tmp_path}/clean", "--out", f"{tmp_path}/built", "--shard-tokens", "50"]) == 0
    assert main(["forge-info", f"{tmp_path}/built"]) == 0
    capsys.readouterr()
    assert main(["stream-check", f"{tmp_path}/built", "--split", "test", "--sequence", "20", "--windows", "3"]) == 0
    assert json.loads(capsys.readouterr().out)["windows"] == 3
    next((tmp_path / "built/shards/test").glob("*.u32")).write_bytes(b"\xff" * 200)
    assert main(["stream-check", f"{tmp_path}/built", "--split", "test", "--sequence", "20", "--windows", "3"]) == 1
    assert "ids" in capsys.readouterr().out
    next((tmp_path / "built/shards/train").glob("*.u32")).write_bytes(b"1234")
    assert main(["forge-info", f"{tmp_path}/built"]) == 1


def test_books_are_imported_in_the_order_of_their_table(spark, tmp_path):
    text = "\n\n".join(f"{LONG} Chapitre {i}." for i in range(30))
    rows = [(f"livre-{9 - i}", "95", f"Titre {i}", f"{text}{i * 7919}" if i != 3 else f"{text}0", 10, 900) for i in range(6)] + [("court", "95", "t", "court", 1, 1)]
    spark.createDataFrame(rows, "file_id string, ocr string, title string, complete_text string, page_count long, word_count long").coalesce(1).write.parquet(f"{tmp_path}/books")
    (tmp_path / "out").mkdir()
    main(["import", f"{tmp_path}/books", "--kind", "books", "--out", f"{tmp_path}/out"])
    manifest = json.loads(next((tmp_path / "out").glob("*manifest.json")).read_text())
    assert manifest["rejected"]["exact_duplicate"] == 1 and sum(manifest["documents"].values()) >= 1
    ordered = files.in_order(spark, f"{tmp_path}/books").orderBy("pos").select("file_id").collect()
    assert [r["file_id"] for r in ordered] == [r[0] for r in rows]


def test_articles_are_collected_by_topic(spark, tmp_path, capsys):
    pages = list(range(1, 41))
    for offset in (0, 20, 40):
        (tmp_path / f"search-moulin-{offset}.json").write_text(json.dumps({"query": {"search": [{"pageid": i, "ns": 0} for i in pages[offset : offset + 20]]}}))
        (tmp_path / f"search-four-{offset}.json").write_text("{}" if offset else json.dumps({"query": {"search": [{"pageid": 1, "ns": 0}]}}))
    for i in pages:
        body = {"query": {"pages": [{"pageid": i, "ns": 0, "title": f"Page {i}", "extract": f"Texte {i}. " + LONG * 2, "revisions": [{"revid": 100 + i}]}]}}
        (tmp_path / f"page-{i}.json").write_text(json.dumps(body))
    config = {"topics": ["moulin", "four"], "cycles": 2, "pages_per_topic": 20, "interval_seconds": 1, "max_minutes": 5, "language": "fr", "max_library_bytes": 10**7}
    (tmp_path / "s").mkdir()
    waits, hooked = [], []
    session = research.Session(spark, f"{tmp_path}/lib", f"{tmp_path}/s", f"file://{tmp_path}/search-{{topic}}-{{offset}}.json", f"file://{tmp_path}/page-{{id}}.json", wait=waits.append)
    assert research.collect(session, config, lambda out, cycle: hooked.append(cycle)) == "finished"
    stored = spark.read.parquet(f"{tmp_path}/lib")
    assert stored.count() == 40 and [r["id"] for r in research.articles(stored).collect()] == pages and set(waits) == {1}
    events = [json.loads(x)["event"] for x in (tmp_path / "s/events.jsonl").read_text().splitlines()]
    assert events.count("stored") == 40 and events.count("network_error") == 1 and events[-1] == "finished" and hooked and hooked[-1] == 2
    assert main(["export-library", f"{tmp_path}/lib", "--out", f"{tmp_path}/exported"]) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "exported/corpus").glob("split=*/*.txt")))
    assert text.count("# Page ") == 40 and text.endswith("\n\n")
    assert main(["export-library", f"{tmp_path}/lib", "--out", f"{tmp_path}/never", "--context", "1000000"]) == 1 and not (tmp_path / "never").exists()
    (tmp_path / "s/STOP").write_text("")
    assert research.collect(session, config) == "STOP"
    assert research.config_problems(config | {"topics": [" "], "cycles": 0, "language": "FR"}) == ["topics", "cycles", "language"]
    (tmp_path / "s/STOP").unlink()
    broken = research.Session(spark, f"{tmp_path}/lib2", f"{tmp_path}/s", "file:///nowhere/{topic}", wait=waits.append)
    with pytest.raises(RuntimeError):
        research.collect(broken, config | {"cycles": 20})


def test_course_units(spark, tmp_path, capsys):
    (tmp_path / "units.json").write_text(json.dumps([{"id": f"u{i}", "topic": "langue", "text": f"Leçon {i}.<|end|>"} for i in range(60)]))
    (tmp_path / "seed").mkdir()
    assert main(["prepare-seed", f"{tmp_path}/units.json", "--out", f"{tmp_path}/seed"]) == 0
    assert json.loads((tmp_path / "seed/manifest.json").read_text())["unit_count"] == 60
    (tmp_path / "units.json").write_text(json.dumps([{"id": "a", "topic": "x", "text": "t"}, {"id": "a", "topic": "x", "text": "t"}]))
    assert main(["prepare-seed", f"{tmp_path}/units.json", "--out", f"{tmp_path}/no"]) == 1


def test_tokenizer_commands(spark, tmp_path, capsys):
    (tmp_path / "probes.json").write_text(json.dumps([{"id": "a", "domain": "x", "text": "été"}, {"id": "b", "domain": "y", "text": "🦀"}]))
    assert main(["tokenizer-audit", f"{tmp_path}/probes.json", "--baseline", ""]) == 0
    out = json.loads(capsys.readouterr().out)
    assert {r["tokens"] for r in out["report"]} == {9, 5, 4} and all(r["difference"] == 0 for r in out["comparison"])
    (tmp_path / "src").mkdir()
    sources = []
    for d in ("french", "english", "code"):
        data = f"{d} ligne é\n".encode() * 300
        (tmp_path / f"src/{d}.txt").write_bytes(data)
        sources.append({"id": d, "domain": d, "partition": "train", "file": f"{d}.txt", "sha256": hashlib.sha256(data).hexdigest()})
    config = {"seed": 42, "max_text_bytes": 3000, "percentages": [70, 15, 15], "sources": sources}
    (tmp_path / "mix.json").write_text(json.dumps(config))
    assert main(["tokenizer-mix", f"{tmp_path}/mix.json", "--root", f"{tmp_path}/src", "--out", f"{tmp_path}/mixed"]) == 0
    text = "".join(p.read_text() for p in (tmp_path / "mixed/corpus").glob("*.txt"))
    assert 2900 < len(text.encode()) <= 3000
    sources[0]["sha256"] = "0" * 64
    (tmp_path / "mix.json").write_text(json.dumps(config))
    assert main(["tokenizer-mix", f"{tmp_path}/mix.json", "--root", f"{tmp_path}/src", "--out", f"{tmp_path}/bad"]) == 1 and not (tmp_path / "bad").exists()


def test_dialogue_and_library_commands(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/train.json").write_text(json.dumps([{"question": " q ", "answer": "a"}, {"question": "r", "answer": "b"}]))
    assert main(["prepare-dialogue", f"{tmp_path}/d", "--out", f"{tmp_path}/o"]) == 0
    assert "".join(p.read_text() for p in (tmp_path / "o/corpus/split=train").glob("*.txt")) == "<|user|>q<|assistant|>a<|end|>\n<|user|>r<|assistant|>b<|end|>\n"
    (tmp_path / "d/test.json").write_text(json.dumps([{"question": "Q", "answer": "c"}]))
    assert main(["prepare-dialogue", f"{tmp_path}/d", "--out", f"{tmp_path}/o2"]) == 1
    spark.createDataFrame([(1, 1, 1, "Le moulin", "u", "fr", "texte", "CC", 1)], "record_id long, id long, revision_id long, title string, url string, language string, text string, license string, fetched_at_unix long").write.parquet(f"{tmp_path}/in")
    assert main(["research", f"{tmp_path}/in", "--library", f"{tmp_path}/lib", "--checkpoint", f"{tmp_path}/cp", "--journal", f"{tmp_path}/j"]) == 0
    capsys.readouterr()
    assert main(["search", f"{tmp_path}/lib", "moulin"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["score"] == 6
    assert main(["info"]) == 0

"""Command line: ``python -m lexiloom COMMAND ...``. Each command reads tables or files and writes to a new folder."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import runtime
from lexiloom.functions import hashing, training, urls
from lexiloom.functions import text as tx
from lexiloom.operators import audit, curation, dedup, dialogue, integrity, library, mix, quality, shards, splits
from lexiloom.sinks import files as sinks
from lexiloom.sources import files, paged
from lexiloom.streaming import ingest, research


def _show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _import(spark: SparkSession, a: argparse.Namespace) -> int:
    """Filter, split and deduplicate web documents (Parquet with record_id, or a paged source) or books into split files."""
    if a.kind == "books":
        rows = quality.book_reasons(files.in_order(spark, a.source), a.min_ocr)
        rows = rows.withColumn("key", F.col("file_id")).withColumn("page", F.col("file_id")).withColumn("text", F.col("complete_text"))
    elif a.pages:
        spark.dataSource.register(paged.PagedSource)
        read = spark.read.format("paged").options(url=a.source, rows=str(a.pages * paged.PAGE)).load()
        rows = quality.web_reasons(read).withColumn("pos", F.col("row_idx"))
        rows = rows.withColumn("reason", F.when(F.col("truncated_cells") > 0, "truncated_row").otherwise(F.col("reason"))).withColumn("key", F.col("host")).withColumn("page", urls.without_fragment(F.col("url")))
    else:
        rows = quality.web_reasons(spark.read.parquet(a.source)).withColumn("pos", F.col("record_id")).withColumn("key", F.col("host")).withColumn("page", urls.without_fragment(F.col("url")))
    rows = runtime.cut(splits.with_split(rows.select("pos", "key", "page", "text", "reason"), F.col("key")))
    told = runtime.cut(dedup.accept(rows.where("reason is null"), "pos", url="page"))
    sized = rows.where("reason is null").join(told.withColumnRenamed("reason", "dropped"), "pos").withColumn("size", F.octet_length("text") + len(tx.END) + 1).withColumn("accepted", F.col("dropped").isNull())
    kept = runtime.cut(dedup.within_budget(sized, "pos", "size", "accepted", a.budget))
    stopped = "text_budget" if kept.count() < sized.count() else "end_of_source"
    last = kept.agg(F.max("pos")).first()[0] if stopped == "text_budget" else None
    seen = rows.where(F.col("pos") <= last) if last is not None else rows
    sinks.write_splits(kept.where("accepted").withColumn("text", sinks.record(F.col("text"))), f"{a.out}/corpus", order="pos")
    counts = {r["split"]: r["n"] for r in kept.where("accepted").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    rejected = quality.reject_counts(seen).unionByName(quality.reject_counts(kept, "dropped").withColumnRenamed("dropped", "reason"))
    state = sinks.import_state(counts, stopped)
    name = sinks.write_manifest(a.out, state | {"rejected": {r["reason"]: r["rows"] for r in rejected.orderBy("reason").collect()}})
    _show({"manifest": name} | state)
    return 0 if state["complete"] else 1


def _curate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Remove from train and validation what validation and test have; a file is one text."""
    made = runtime.cut(curation.curate(files.whole_texts(spark, a.source).withColumn("name", F.col("split")), "name"))
    if made.where("trim(text) = ''").limit(1).count():
        raise SystemExit("a split would be empty")
    sinks.write_splits(made, f"{a.out}/corpus")
    sinks.write_manifest(a.out, {"removed": {r["split"]: r["removed"] for r in made.collect()}})
    return 0


def _build(spark: SparkSession, a: argparse.Namespace) -> int:
    """Token shards of split files by the byte vocabulary; fails on leaks between splits."""
    texts = files.whole_texts(spark, a.source)
    if leaks := _rows(curation.leaks(texts).limit(20)):
        _show({"leaks": leaks})
        return 1
    rows = shards.positions(texts.withColumn("pos", F.lit(0)).withColumn("ids", shards.byte_ids(tx.unix_lines(F.col("text")))), "split", "pos", F.size("ids"))
    made = runtime.cut(shards.shards(rows, "split", a.shard_tokens))
    written = sinks.write_shards(made, f"{a.out}/shards").collect()
    manifest = shards.manifest(made)
    sinks.write_manifest(a.out, {"shard_tokens": a.shard_tokens, "files": [r.asDict() for r in written], "fingerprints": {r["split"]: r["fingerprint"] for r in integrity.fingerprint(manifest).collect()}})
    return 0


BYTE_VOCABULARY = 259


def _listed(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(r["split"], r["shard"], r["name"], r["bytes"] // 4, r["bytes"], r["sha256"]) for r in manifest["files"]]
    return spark.createDataFrame(rows, "split string, shard long, name string, tokens long, bytes long, sha256 string")


def _info(spark: SparkSession, a: argparse.Namespace) -> int:
    """Problems of a built folder against its manifest."""
    manifest = json.loads(spark.read.text(f"{a.source}/manifest.json", wholetext=True).first()[0])
    expected = spark.createDataFrame([(r["name"], r["bytes"], r["sha256"]) for r in manifest["files"]], "file string, bytes long, sha256 string")
    problems = _rows(integrity.unpinned(integrity.file_hashes(spark, f"{a.source}/shards", "*.u32"), expected))
    listed = _listed(spark, manifest)
    problems += _rows(shards.manifest_problems(listed, manifest["shard_tokens"]))
    vocabulary = spark.range(BYTE_VOCABULARY)
    for split in hashing.SPLITS:
        found = files.token_shards(spark, f"{a.source}/shards", split)
        problems += _rows(shards.file_problems(found, listed.where(F.col("split") == split), vocabulary).where(F.col("problem").isin("ids", "alignment", "unexpected")))
    _show({"shard_tokens": manifest["shard_tokens"], "files": len(manifest["files"]), "problems": problems})
    return 1 if problems else 0


def _stream_check(spark: SparkSession, a: argparse.Namespace) -> int:
    """Evenly spread windows of one split and their checksum, after a check of its files; other splits aren't read."""
    manifest = json.loads(spark.read.text(f"{a.source}/manifest.json", wholetext=True).first()[0])
    total = sum(r["bytes"] // 4 for r in manifest["files"] if r["split"] == a.split)
    starts = shards.evaluation_starts(spark, total, a.sequence, a.windows)
    wanted = starts.select(F.lit(a.split).alias("split"), "start", F.lit(a.sequence + 1).cast("long").alias("len"))
    listed = _listed(spark, manifest).where(F.col("split") == a.split)
    try:
        found = shards.verified(files.token_shards(spark, f"{a.source}/shards", a.split), listed, spark.range(BYTE_VOCABULARY))
    except ValueError as error:
        _show({"problems": str(error)})
        return 1
    read = shards.windows(found, wanted, manifest["shard_tokens"])
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "tokens"))), lambda x: x["tokens"]))
    row = read.agg(F.count(F.lit(1)).alias("windows"), hashing.checksum(whole).alias("checksum"), F.sum((F.size("tokens") != F.col("len")).cast("int")).alias("short")).first()
    _show(row.asDict())
    return 1 if row["short"] else 0


def _mix(spark: SparkSession, a: argparse.Namespace) -> int:
    """A text of fragments by byte quotas of domains, from pinned source files."""
    config = json.loads(spark.read.text(a.source, wholetext=True).first()[0])
    if problems := mix.config_problems(config):
        _show({"problems": problems})
        return 1
    sources = spark.createDataFrame([(s["id"], s["domain"], s["file"], s["sha256"].lower()) for s in config["sources"]], "id string, domain string, file string, sha256 string")
    texts = runtime.cut(files.pinned_texts(spark, sources, a.root))
    bad = _rows(texts.where("text is null or sha256 <> found_sha256").select("id"))
    bad += _rows(texts.groupBy("found_sha256").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if bad:
        _show({"problems": bad})
        return 1
    pool = mix.fragments(texts, "id", "text", keep=("domain",))
    targets = mix.sizing(pool, dict(zip(("french", "english", "code"), config["percentages"])), config["max_text_bytes"], len(config["sources"]))
    chosen = mix.select(pool, targets, config["seed"], "id")
    ordered = chosen.select(mix.clipped("fragment", "taken").alias("value"), mix.shuffle_key(config["seed"], "id", "offset").alias("k")).orderBy("k").drop("k")
    ordered.write.mode("errorifexists").option("lineSep", "\n").text(f"{a.out}/corpus")
    sinks.write_manifest(a.out, {"domains": _rows(mix.retained(chosen)), "targets": _rows(targets)})
    return 0


def _audit(spark: SparkSession, a: argparse.Namespace) -> int:
    """Counters of a tokenizer file, or of the byte vocabulary, over probes, against a baseline if one is given."""
    probes = files.probes(spark, a.source)
    if problems := _rows(quality.probe_problems(probes)):
        _show({"problems": problems})
        return 1

    def report(path: str | None) -> DataFrame:
        if not path:
            return audit.report(audit.byte_measured(probes, "id", keep=("domain",)))
        unknown = audit.unknown_id(path)
        return audit.report(audit.measured(probes, lambda: audit.file_codec(path), "id", unknown=unknown, keep=("domain",)), has_unknown=unknown is not None)

    made = report(a.tokenizer)
    out = {"report": _rows(made), "vocabulary_sha256": audit.vocabulary_sha(a.tokenizer) if a.tokenizer else None, "split_markers": audit.file_problems(a.tokenizer) if a.tokenizer else []}
    if a.baseline is not None:
        out["comparison"] = _rows(audit.compared(made, report(a.baseline or None)))
    if a.out:
        sinks.write_new(a.out, json.dumps(out, ensure_ascii=False, indent=2, default=str))
    _show(out)
    return 0


def _dialogue(spark: SparkSession, a: argparse.Namespace) -> int:
    """Split files of dialogue examples; fails on blank, marked or repeated questions."""
    rows = quality.dialogue_problem(files.dialogue_examples(spark, a.source))
    problems = _rows(rows.where("problem is not null").groupBy("problem").count()) + _rows(dialogue.duplicate_questions(rows).limit(20))
    if problems:
        _show({"problems": problems})
        return 1
    text = F.regexp_replace(dialogue.rendered(F.col("question"), F.col("answer")), r"\n\z", "")
    sinks.write_splits(rows.withColumn("text", text).withColumn("pos", F.concat_ws("\x00", "file", "question")), f"{a.out}/corpus", order="pos")
    return 0


def _research(spark: SparkSession, a: argparse.Namespace) -> int:
    """Take new article files of a landing folder into the library until it is drained, stopped or out of time."""
    schema = spark.read.parquet(a.source).schema
    stream = spark.readStream.schema(schema).parquet(a.source)
    query = ingest.ingest_articles(stream, a.library, a.checkpoint, ingest.Journal(a.journal) if a.journal else None)
    _show({"stopped": ingest.run_until(query, a.stop, a.seconds)})
    return 0


def _research_topic(spark: SparkSession, a: argparse.Namespace) -> int:
    """Collect articles by topic from the encyclopedia, as a configuration says, with exports of its cycles."""
    config = json.loads(spark.read.text(a.source, wholetext=True).first()[0])
    if problems := research.config_problems(config):
        _show({"problems": problems})
        return 1
    addresses = {k: v for k, v in (("search", a.search_url), ("page", a.page_url)) if v}
    _show({"stopped": research.collect(research.Session(spark, a.library, a.session, **addresses), config, context=a.context)})
    return 0


def _export(spark: SparkSession, a: argparse.Namespace) -> int:
    """The latest revisions of a library as split files; fails while a split has too little text."""
    try:
        _show(sinks.write_export(spark.read.parquet(a.library).select("article.*"), a.out, a.context))
    except sinks.TooLittle as error:
        _show({"problem": str(error)})
        return 1
    return 0


def _list(spark: SparkSession, a: argparse.Namespace) -> int:
    """All revisions of a library by language, page and revision, as a table of JSON lines."""
    research.articles(spark.read.parquet(a.library)).write.mode("errorifexists").json(a.out)
    return 0


def _seed(spark: SparkSession, a: argparse.Namespace) -> int:
    """Split files of course units (id, topic, text); fails on repeated ids or texts and on empty splits."""
    units = files.strict_json(spark, a.source, "id string, topic string, text string").drop("file")
    if problems := _rows(splits.unit_problems(units)):
        _show({"problems": problems})
        return 1
    summary = _rows(splits.unit_summary(units).orderBy("split", "topic"))
    sinks.write_splits(splits.with_split(units, F.col("id"), unit=True), f"{a.out}/corpus", order="id")
    splits.with_split(units, F.col("id"), unit=True).select("split", "id", "topic").orderBy("split", "id").write.mode("errorifexists").json(f"{a.out}/units")
    sinks.write_manifest(a.out, {"format_version": 1, "partitions": summary, "unit_count": sum(r["units"] for r in summary)})
    return 0


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = spark.read.parquet(a.library).select("article.*").withColumn("record_id", F.xxhash64("language", "id", "revision_id"))
    _show(_rows(library.search(library.latest(rows), a.query, a.limit).select("score", "title", "url", tx.excerpt(F.col("text")).alias("excerpt"))))
    return 0


def _parameters(spark: SparkSession | None, a: argparse.Namespace) -> int:
    _show({"parameters": training.parameter_count(a.vocabulary, a.width, a.layers, a.heads, a.kv_heads, a.inner)})
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments: tuple[str, dict]) -> None:
        c = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for flag, options in arguments:
            c.add_argument(flag, **options)
        c.set_defaults(run=run)

    source, out = ("source", {}), ("--out", {"required": True})
    number = lambda flag, default: (flag, {"type": int, "default": default})
    add("import", _import, source, out, ("--kind", {"choices": ["web", "books"], "default": "web"}), number("--budget", 2**40), number("--min-ocr", 60), number("--pages", 0))
    add("curate-text", _curate, source, out)
    add("forge-build", _build, source, out, number("--shard-tokens", 100_000))
    add("forge-info", _info, source)
    add("stream-check", _stream_check, source, ("--split", {"default": "validation"}), number("--sequence", 128), number("--windows", 64))
    add("tokenizer-mix", _mix, source, out, ("--root", {"required": True}))
    add("tokenizer-audit", _audit, source, ("--tokenizer", {}), ("--baseline", {}), ("--out", {}))
    add("prepare-dialogue", _dialogue, source, out)
    add("research", _research, source, ("--library", {"required": True}), ("--checkpoint", {"required": True}), ("--journal", {}), ("--stop", {}), ("--seconds", {"type": float}))
    add("research-topic", _research_topic, source, ("--library", {"required": True}), ("--session", {"required": True}), ("--search-url", {}), ("--page-url", {}), number("--context", 128))
    add("export-library", _export, ("library", {}), out, number("--context", 128))
    add("list-library", _list, ("library", {}), out)
    add("prepare-seed", _seed, source, out)
    add("search", _search, ("library", {}), ("query", {}), number("--limit", 10))
    add("info", _parameters, *(number(f"--{n}", d) for n, d in (("vocabulary", 32_000), ("width", 768), ("layers", 12), ("heads", 12), ("kv-heads", 4), ("inner", 2_048))))
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "info":
        return a.run(None, a)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("lexiloom").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())

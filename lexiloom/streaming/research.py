"""Collection of encyclopedia articles by topic: cycles of searches and pages, with an error budget, a STOP file and a time limit."""

from __future__ import annotations

import time
import urllib.parse
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import library
from lexiloom.runtime import cut
from lexiloom.sinks import files as sinks
from lexiloom.sources import paged
from lexiloom.streaming.ingest import MOST_ERRORS, Journal, exists

#: Bytes of an answer that are read at most.
MOST_ANSWER = 2 * 2**20
#: Addresses of the encyclopedia's interface, for a search and for a page.
SEARCH = "https://{language}.wikipedia.org/w/api.php?action=query&format=json&formatversion=2&list=search&srnamespace=0&srsearch={topic}&srlimit={limit}&sroffset={offset}"
PAGE = "https://{language}.wikipedia.org/w/api.php?action=query&format=json&formatversion=2&prop=extracts%7Crevisions&explaintext=1&rvprop=ids&pageids={id}"
#: Bounds of a configuration.
BOUNDS = {"cycles": (1, 100_000), "pages_per_topic": (1, 50), "interval_seconds": (1, 3_600), "max_minutes": (1, 10_080)}


def config_problems(config: Mapping) -> list[str]:
    """What is wrong with a configuration: topics, cycles, pages_per_topic, interval_seconds, max_minutes, language, max_library_bytes."""
    topics = config.get("topics", [])
    out = [] if 1 <= len(topics) <= 100 and all(t.strip() and len(t) <= 512 for t in topics) else ["topics"]
    out += [name for name, (low, high) in BOUNDS.items() if not isinstance(config.get(name), int) or not low <= config[name] <= high]
    language = config.get("language", "")
    if not language or not all(c.isascii() and (c.islower() or c == "-") for c in language):
        out.append("language")
    return out + (["max_library_bytes"] if config.get("max_library_bytes", 0) <= 0 else [])


@dataclass
class Session:
    """What a collection has at hand; ``fetch`` and ``wait`` can be replaced."""

    spark: SparkSession
    library: str
    folder: str
    search: str = SEARCH
    page: str = PAGE
    fetch: Callable[[str], bytes] = lambda url: paged.fetch(url, MOST_ANSWER)
    wait: Callable[[float], None] = time.sleep
    began: float = field(default_factory=time.monotonic)
    errors: int = 0

    def __post_init__(self) -> None:
        self.journal = Journal(f"{self.folder}/events.jsonl")

    def stopped(self, config: Mapping) -> str | None:
        if Path(self.folder, "STOP").exists():
            return "STOP"
        return "time_budget" if time.monotonic() - self.began > 60 * config["max_minutes"] else None

    def failed(self, cycle: int, error: Exception) -> None:
        """Note an error; the tenth ends the collection."""
        self.errors += 1
        self.journal.write("network_error", cycle, str(error))
        if self.errors >= MOST_ERRORS:
            raise RuntimeError(f"{MOST_ERRORS} requests have failed") from error


def collect(session: Session, config: Mapping, hook: Callable[[str, int], None] | None = None, context: int = 128) -> str:
    """For each cycle and topic the next pages of the search; returns finished, STOP or time_budget.

    Requests are made one after the other with a pause between them, as the service wants it. The answers of a cycle
    are parsed, checked and added to the library as one table. A cycle that brought articles is exported to a folder of
    its own, which ``hook`` gets; while a split has too little text the export waits for further cycles.
    """
    if problems := config_problems(config):
        raise ValueError(f"wrong in the configuration: {', '.join(problems)}")
    first = True
    session.journal.write("started", 0, f"{len(config['topics'])} topics, at most {config['cycles']} cycles")
    for cycle in range(1, config["cycles"] + 1):
        answers: list[Row] = []
        offset = (cycle - 1) * config["pages_per_topic"]

        def body(address: str, cycle: int = cycle) -> str | None:
            nonlocal first
            if not first:
                session.wait(config["interval_seconds"])
            first = False
            try:
                return session.fetch(address).decode()
            except Exception as error:
                session.failed(cycle, error)
                return None

        reason = None
        for topic in config["topics"]:
            if reason := session.stopped(config):
                break
            session.journal.write("search", cycle, f"topic={topic!r} offset={offset}")
            found = body(session.search.format(language=config["language"], topic=urllib.parse.quote(topic), limit=config["pages_per_topic"], offset=offset))
            for ident in _ids(session, found, cycle) if found is not None else []:
                if reason := session.stopped(config):
                    break
                if (page := body(session.page.format(language=config["language"], id=ident))) is not None:
                    answers.append(Row(wanted=ident, body=page, language=config["language"], fetched=int(time.time())))
        added = _store(session, answers, cycle, config["max_library_bytes"]) if answers else 0
        if reason := reason or session.stopped(config):
            session.journal.write("stopped", cycle, reason)
            return reason
        session.journal.write("cycle_finished", cycle, f"{added} new articles")
        if added:
            _export(session, cycle, hook, context)
    session.journal.write("finished", 0, "all cycles done")
    return "finished"


def _ids(session: Session, answer: str, cycle: int) -> list[int]:
    ids = session.spark.range(1).select(paged.search_ids(F.lit(answer)).alias("ids")).first()["ids"]
    if ids is None:
        session.failed(cycle, ValueError("the search gave no list of pages"))
    return ids or []


def _store(session: Session, answers: list[Row], cycle: int, most_bytes: int) -> int:
    spark = session.spark
    rows = spark.createDataFrame(answers, "wanted long, body string, language string, fetched long").withColumn("record_id", F.monotonically_increasing_id())
    parsed = cut(paged.parsed_articles(rows, "body", "wanted", "language", "fetched"))
    for bad in parsed.where("problem is not null").select("wanted", "problem").collect():
        session.failed(cycle, ValueError(f"page {bad['wanted']}: {bad['problem']}"))
    incoming = library.stored(parsed.where("problem is null").select("record_id", "article.*")).withColumn("__order", F.struct("article.fetched_at_unix", "article.id", "article.revision_id"))
    held = spark.read.parquet(session.library) if exists(spark, session.library) else incoming.limit(0)
    new = cut(library.new_articles(incoming.dropDuplicates(["path"]), held, "__order").drop("__order"))
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("article.text")), F.lit(0))).first()[0]
    if size(held) + size(new) > most_bytes:
        raise RuntimeError(f"the library would hold more than {most_bytes} bytes of text")
    new.write.mode("append").parquet(session.library)
    for r in new.select("article.url", "article.revision_id").collect():
        session.journal.write("stored", cycle, f"{r['url']} revision={r['revision_id']}")
    return new.count()


def _export(session: Session, cycle: int, hook: Callable[[str, int], None] | None, context: int) -> None:
    out = f"{session.folder}/datasets/cycle-{cycle:04d}"
    try:
        summary = sinks.write_export(session.spark.read.parquet(session.library).select("article.*"), out, context)
    except sinks.TooLittle as waiting:
        session.journal.write("export_waiting", cycle, str(waiting))
        return
    session.journal.write("exported", cycle, str(summary))
    if hook:
        hook(out, cycle)
        session.journal.write("hook_completed", cycle, out)


def articles(df: DataFrame) -> DataFrame:
    """All revisions of stored articles, by language, page and revision."""
    return df.select("article.*").orderBy("language", "id", "revision_id")

"""The queries pN_... over the tables of a scale folder, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import books, budget, encoding, lines, mixing, overlap, pairs, quality, tokens
from lexiloom.runtime import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(read(spark, d, "dialogue_examples")).where(F.col("defect").isNotNull())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.found(read(spark, d, "web_documents"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.cleaned(read(spark, d, "web_documents").select("record_id", "url", "text")).select("record_id", "text", "removed")


def _records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Web documents and articles together; their record_id is unique across both."""
    names = ["record_id", "partition_name", *columns]
    return read(spark, d, "web_documents").select(*names).unionByName(read(spark, d, "articles").select(*names))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs_ = overlap.overlaps(_records(spark, d, "text"))
    return pairs_.select(F.least("train", "evaluation").alias("record_a"), F.greatest("train", "evaluation").alias("record_b"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records per split and source, those of them found in another split, the pairs they are in, and of train records
    the maximal spans and the words that stand in evaluation records."""
    pairs_ = overlap.overlaps(_records(spark, d, "text"))
    sides = F.array(F.struct(F.col("train").alias("record_id"), "spans", "words"), F.struct(F.col("evaluation").alias("record_id"), F.lit(None).cast("int").alias("spans"), F.lit(None).cast("int").alias("words")))
    found = pairs_.select(F.explode(sides).alias("s")).groupBy("s.record_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s.spans").alias("spans"), F.sum("s.words").alias("words"))
    records = _records(spark, d, "source_id").where(F.col("partition_name").isin(overlap.TRAIN, *overlap.EVALUATION))
    joined = records.join(found, "record_id", "left")
    return joined.groupBy("partition_name", "source_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count("n").alias("found"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"),
        F.sum("spans").alias("spans"),
        F.sum("words").alias("words"),
    )


def _token_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents and web documents under one set of columns, with canonical source, language and domain."""
    documents = read(spark, d, "documents").select(F.lit("documents").alias("table"), F.col("doc_id").alias("id"), "text", F.col("lang").alias("l"), F.col("source").alias("s"))
    web = read(spark, d, "web_documents").select(F.lit("web_documents").alias("table"), F.col("record_id").alias("id"), "text", F.col("language").alias("l"), F.col("source_id").alias("s"))
    rows = documents.unionByName(web).select("table", "id", "text", budget.source(F.col("s")).alias("source"), budget.language(F.col("l")).alias("language"))
    domains = read(spark, d, "sources").select(budget.source(F.col("source_id")).alias("source"), "domain").dropDuplicates(["source"])
    return budget.small_side(rows, domains, "source")


def p4_token_totals(spark: SparkSession, d: str) -> DataFrame:
    return budget.slices(budget.totals(_token_rows(spark, d), ["table", "source", "language", "domain"]), ["table", "source", "language", "domain"])


def p4_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return budget.document_tokens(_token_rows(spark, d), ["table", "id", "source", "language", "domain"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return books.affected_lines(read(spark, d, "books"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return books.paragraphs(read(spark, d, "books"))


def _with_repeated(spark: SparkSession, d: str) -> DataFrame:
    return lines.marked(read(spark, d, "web_documents").select("record_id", "url", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = quality.statistics(_with_repeated(spark, d), "record_id", "text", "repeated")
    return found.where(F.col("kind").isNotNull()).select("record_id", "kind")


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its quality_score (null where it isn't a number from 0 to 1) and figures (null without text)."""
    score = F.when(F.col("quality_score").between(0.0, 1.0) & ~F.isnan("quality_score"), F.col("quality_score"))
    base = read(spark, d, "web_documents").select("record_id", score.alias("quality_score"))
    return base.join(quality.statistics(_with_repeated(spark, d), "record_id", "text", "repeated"), "record_id", "left")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"), "doc_id", "text")


def _mix_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with canonical source, language and topic (the domain of the source), and the targets."""
    domains = read(spark, d, "sources").select(budget.source(F.col("source_id")).alias("source"), F.col("domain").alias("topic")).dropDuplicates(["source"])
    rows = read(spark, d, "documents").select("doc_id", "text", budget.source(F.col("source")).alias("source"), budget.language(F.col("lang")).alias("language"))
    targets = read(spark, d, "mix_targets").select(budget.source(F.col("source_id")).alias("source"), "target_share", "max_repeats")
    return budget.small_side(rows, domains, "source"), targets


#: Shares of the mix's tokens by topic, beside the targets of the sources; languages keep what those imply.
TOPICS = {"french": 0.7, "english": 0.12, "code": 0.1, "other": 0.08}


def _languages(inputs: tuple[DataFrame, DataFrame]) -> dict[str | None, float]:
    """Shares by language of the characters of the texts with a target, to the power of 0.9, which gives small
    languages more. Languages are few: a row for each is collected."""
    documents, targets = inputs
    rows = documents.join(F.broadcast(targets.select("source")), "source").where("text <> ''").groupBy("language").agg(F.sum(F.length("text")).alias("n")).collect()
    weight = {r["language"]: r["n"] ** 0.9 for r in rows}
    return {language: w / sum(weight.values()) for language, w in weight.items()}


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: each chosen document, its tokens, and how often it is used."""
    return mixing.mix(*_mix_inputs(spark, d)).select("doc_id", "source", "language", "tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix_inputs(spark, d))


def p8_raked_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each language and topic gets in a mix that is raked to marginals of sources, languages and topics."""
    inputs = _mix_inputs(spark, d)
    return mixing.marginal_shares(*inputs, marginals={"language": _languages(inputs), "topic": TOPICS})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.inspected(read(spark, d, "documents")).where("garbled").select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.inspected(read(spark, d, "documents")).where("garbled").select("doc_id", "original", "spans", "how")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_clean, p3_found, p3_counts, p4_token_totals, p4_document_tokens, p5_found, p5_paragraphs, p6_found, p6_statistics, p7_ids, p8_mix, p8_shares, p8_raked_shares, p9_found, p9_restored)}

# DuckDB's \s knows no white space beyond ASCII, so the class is spelled out.
_WHITE = r"[\t\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_P2 = rf"""
with doc as (
  select record_id, text, regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/?#:\s]*)', 1)), '^www\.', '') as site
  from web_documents
), line as (
  select record_id, site, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as line_no
  from doc where site <> '' and text is not null
), plain as (
  select record_id, site, line_no, regexp_replace(lower(trim(regexp_replace(raw, '{_WHITE}', ' ', 'g'))), '[0-9]+', '0', 'g') as line from line
), often as (
  select site, line from plain where line <> '' group by site, line
  having count(distinct record_id) >= 5 and count(distinct record_id) * 5 >= any_value((select count(*) from doc d where d.site = plain.site))
)
"""
ORACLE_SQL = {
    "p2_found": _P2 + "select record_id, line_no::int as line_no from plain join often using (site, line)",
    "p2_clean": _P2
    + """, hit as (select record_id, list(line_no) as gone from plain join often using (site, line) group by record_id)
select record_id, case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as text,
  coalesce(len(gone), 0)::int as removed
from doc left join hit using (record_id)""",
}

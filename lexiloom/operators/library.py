"""The article library: identities, insertion, latest revisions, ranked search, export."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import hashing
from lexiloom.functions import text as tx
from lexiloom.operators import quality

TITLE_CHARS, BODY_CHARS, QUERY_CHARS, MOST_RESULTS = 512, 100_000, 512, 100
TITLE_WEIGHT = 6
#: Undecided rows of an insertion that one task goes through in order.
ONE_TASK = 500_000


def stored(df: DataFrame, version: int = 1) -> DataFrame:
    """Valid articles as stored ones: version, hashes of identity and text, path, and the article itself."""
    names = ["id", "revision_id", "title", "url", "language", "text", "license", "fetched_at_unix"]
    identity = hashing.sha(hashing.article_key(F.col("language"), F.col("id")))
    made = quality.article_problem(df).where("problem is null").select(
        F.lit(version).alias("schema_version"), identity.alias("identity_sha256"), hashing.sha(F.col("text")).alias("text_sha256"), F.struct(*names).alias("article")
    )
    return made.withColumn("path", hashing.article_path(F.col("article.language"), F.col("identity_sha256"), F.col("article.revision_id"), F.col("text_sha256")))


def broken(stored_articles: DataFrame) -> DataFrame:
    """Stored articles with ``problem``, of those whose hashes or path don't fit the article, or that stand twice."""
    a = F.col("article")
    identity = hashing.sha(hashing.article_key(a["language"], a["id"]))
    twice = F.count(F.lit(1)).over(Window.partitionBy("identity_sha256", "article.revision_id"))
    problem = (
        F.when(F.col("identity_sha256") != identity, "identity")
        .when(F.col("text_sha256") != hashing.sha(a["text"]), "text")
        .when(F.col("path") != hashing.article_path(a["language"], identity, a["revision_id"], F.col("text_sha256")), "path")
        .when(twice > 1, "duplicate")
    )
    return stored_articles.withColumn("problem", problem).where("problem is not null")


def new_articles(incoming: DataFrame, library: DataFrame, order: str) -> DataFrame:
    """The stored articles of ``incoming`` that insertion one by one, in the order of a column, would add.

    An article is a duplicate if the library, or an article added before it, has its text or its identity and
    revision. Among the incoming ones the first of each text is kept first, then the first of each revision: a text
    whose first copy falls for its revision alone may come in with a later one, which :func:`insert_exactly` covers.
    """
    fresh = incoming.join(library.select("text_sha256").distinct(), "text_sha256", "left_anti")
    known = library.select("identity_sha256", F.col("article.revision_id").alias("__r")).distinct()
    fresh = fresh.withColumn("__r", F.col("article.revision_id")).join(known, ["identity_sha256", "__r"], "left_anti")
    return insert_exactly(fresh, order).drop("__r")


def insert_exactly(fresh: DataFrame, order: str, rounds: int = 100) -> DataFrame:
    """Rows that stand in the order of ``order`` (unique) if a row falls where an earlier standing one has its text or revision.

    In rounds: a row that is the first undecided one under both of its keys stands, and what shares a key with a
    standing earlier row falls. Each round groups by key, with the least position only. The first undecided row stands
    in each round, so they end; what long chains leave undecided after ``rounds`` of them, one task goes through in
    order if it is at most ONE_TASK rows. A row without text never stands.
    """
    from lexiloom.runtime import cut

    rows = cut(fresh.select(F.col(order).alias("p"), F.col("text_sha256").alias("t"), F.concat_ws(":", "identity_sha256", F.col("article.revision_id").cast("string")).alias("r")).where("t is not null"))
    kept: DataFrame | None = None
    for done in count(1):
        first_t, first_r = rows.groupBy("t").agg(F.min("p").alias("pt")), rows.groupBy("r").agg(F.min("p").alias("pr"))
        stands = cut(rows.join(first_t, "t").join(first_r, "r").where("p = pt and p = pr").select("p", "t", "r"))
        kept = stands.select("p") if kept is None else kept.unionByName(stands.select("p"))
        rows = cut(rows.join(stands.select("t"), "t", "left_anti").join(stands.select("r").distinct(), "r", "left_anti"))
        if rows.limit(1).count() == 0:
            break
        if done >= rounds and rows.limit(ONE_TASK + 1).count() <= ONE_TASK:
            kept = kept.unionByName(rows.coalesce(1).mapInPandas(_one_by_one, f"p {rows.schema['p'].dataType.simpleString()}"))
            break
    return fresh.join(kept.select(F.col("p").alias(order)), order, "left_semi")


def _one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts, texts, revisions = list(batches), set(), set()
    if not parts:
        return
    rows = pd.concat(parts).sort_values("p")
    stands = []
    for t, r in zip(rows["t"], rows["r"]):
        stands.append(t not in texts and r not in revisions)
        if stands[-1]:
            texts.add(t)
            revisions.add(r)
    yield rows.loc[stands, ["p"]]


def latest(df: DataFrame, ident: str = "record_id") -> DataFrame:
    """The row of the highest revision of each (language, id); of equal ones that of the least ``ident``.

    The maximum of a struct is combined before the shuffle; no page's revisions are collected.
    """
    best = F.max(F.struct(F.col("revision_id"), (-F.col(ident)).alias("turned"))).alias("m")
    keys = df.groupBy("language", "id").agg(best).select((-F.col("m.turned")).alias(ident))
    return df.join(keys, ident, "left_semi")


def search(df: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Articles with ``score``, the best first: six for each query word in the title, one for each in the body.

    Ties are ordered by title, language and id. A limit of 0 gives no row; queries are at most QUERY_CHARS long and
    have at least one word.
    """
    if len(query) > QUERY_CHARS or not 0 <= limit <= MOST_RESULTS:
        raise ValueError(f"a query has at most {QUERY_CHARS} characters, a result at most {MOST_RESULTS} rows")
    wanted = tx.word_set(F.lit(query))
    if not any(c.isalnum() for c in query):
        raise ValueError("the query has no word")
    count = lambda c, n: F.coalesce(F.size(F.array_intersect(tx.word_set(F.substring(F.col(c), 1, n)), wanted)), F.lit(0))
    scored = df.withColumn("score", F.greatest(count("title", TITLE_CHARS), F.lit(0)) * TITLE_WEIGHT + F.greatest(count("text", BODY_CHARS), F.lit(0)))
    return scored.where("score > 0").orderBy(F.desc("score"), "title", "language", "id").limit(limit)


def export_text(df: DataFrame) -> DataFrame:
    """The latest revisions with their split and ``document``, as they stand in an exported file."""
    document = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    return latest(df).withColumn("split", hashing.split_of(hashing.article_key(F.col("language"), F.col("id")))).withColumn("document", document)


def export_summary(df: DataFrame, context: int = 128) -> DataFrame:
    """split, articles, bytes, chars, ready: of the export of valid articles, and whether a split has text enough."""
    valid = quality.article_problem(df).where("problem is null")
    sums = export_text(valid).groupBy("split").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.octet_length("document")).alias("bytes"), F.sum(F.length("document")).alias("chars"))
    return sums.withColumn("ready", F.col("chars") > context)

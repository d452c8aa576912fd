"""Quality rules. Each gives the reason of the first rule that rejects a row, null for rows that pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.functions import urls

LEAST_LANGUAGE_SCORE = 0.8
DOCUMENT_CHARS = (200, 200_000)
BOOK_CHARS = (2_000, 3_000_000)
BOOK_WORDS, BOOK_OCR = 500, 60


def _repeats(text: Column) -> Column:
    """Among at least five lines of 40 characters or more, fewer than six in ten are different."""
    long = F.filter(F.transform(tx.lines(text), tx.trimmed), lambda x: F.length(x) >= 40)
    return (F.size(long) >= 5) & (F.size(F.array_distinct(long)) * 10 < F.size(long) * 6)


def text_reason(text: Column) -> Column:
    """Reason by the text alone. Nulls count as empty texts."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(~F.length(t).between(*DOCUMENT_CHARS), "length")
        .when(tx.has_corrupted(t), "corrupted_characters")
        .when(tx.alphabetic(t) * 10 < F.length(t) * 4, "low_text_ratio")
        .when(tx.has_reserved(t), "markup_or_reserved_tokens")
        .when(_repeats(t), "repeated_lines")
    )


def language_reason(language: Column, script: Column, score: Column, wanted: str = "fra", wanted_script: str = "Latn", least: float = LEAST_LANGUAGE_SCORE) -> Column:
    fine = (language == wanted) & (script == wanted_script) & ~F.isnan(score) & (F.abs(score) != float("inf")) & (score >= least)
    return F.when(~F.coalesce(fine, F.lit(False)), "language")


def web_reasons(df: DataFrame, text: str = "text", url: str = "url", truncated: str | None = None, language: bool = True) -> DataFrame:
    """df with its text normalised, ``host`` and ``reason``.

    Rules in order: truncated_row (only with a column of truncated cells), language, length, corrupted_characters,
    low_text_ratio, markup_or_reserved_tokens, repeated_lines, invalid_url. ``language`` may be switched off for
    tables without those columns. A null text is an empty one, a null URL an invalid one.
    """
    t = tx.normalized(F.col(text))
    reasons = [F.when(F.size(F.col(truncated)) > 0, "truncated_row")] if truncated else []
    reasons += [language_reason(F.col("language"), F.col("language_script"), F.col("language_score"))] if language else []
    host = urls.web_host(F.col(url))
    # the columns below read the text after normalisation
    reasons += [text_reason(F.col(text)), F.when(host.isNull(), "invalid_url")]
    return df.withColumn(text, t).withColumn("host", host).withColumn("reason", F.coalesce(*reasons))


def number(text: Column) -> Column:
    """A decimal number with outer white space; null for anything else, such as Java's ``1d``."""
    bare = tx.trimmed(text)
    return F.when(bare.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), bare.try_cast("double"))


def book_reasons(df: DataFrame, least_ocr: float = BOOK_OCR) -> DataFrame:
    """df with its text normalised, and ``reason``: ocr_field_invalid, low_ocr_score, too_few_words, length,
    corrupted_characters, markup_or_reserved_tokens. A null score is invalid, a null word count no words."""
    t = tx.normalized(F.col("complete_text"))
    ocr, filled = number(F.col("ocr")), F.coalesce(F.col("complete_text"), F.lit(""))  # the text after normalisation
    reason = (
        F.when(ocr.isNull(), "ocr_field_invalid")
        .when(~ocr.between(0.0, 100.0) | (ocr < least_ocr), "low_ocr_score")
        .when(F.coalesce(F.col("word_count"), F.lit(0)) < BOOK_WORDS, "too_few_words")
        .when(~F.length(filled).between(*BOOK_CHARS), "length")
        .when(tx.has_corrupted(filled), "corrupted_characters")
        .when(tx.has_reserved(filled), "markup_or_reserved_tokens")
    )
    return df.withColumn("complete_text", t).withColumn("reason", reason)


def article_problem(df: DataFrame) -> DataFrame:
    """df with ``problem``: the first field that a stored article may not have so, null for valid ones."""
    blank = lambda c: F.coalesce(tx.trimmed(F.col(c)), F.lit("")) == ""
    problem = (
        F.when(F.coalesce(F.col("id") <= 0, F.lit(True)), "id")
        .when(F.coalesce(F.col("revision_id") <= 0, F.lit(True)), "revision_id")
        .when(~F.coalesce(F.col("language").rlike("^[a-z-]+$"), F.lit(False)), "language")
    )
    for c in ("title", "text", "url", "license"):
        problem = problem.when(blank(c), c)
    return df.withColumn("problem", problem)


def dialogue_problem(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """df with ``problem``: blank or reserved_marker, or null."""
    blank = lambda c: F.coalesce(tx.trimmed(F.col(c)), F.lit("")) == ""
    marked = tx.has_reserved(F.col(question), markup=False) | tx.has_reserved(F.col(answer), markup=False)
    return df.withColumn("problem", F.when(blank(question) | blank(answer), "blank").when(marked, "reserved_marker"))


def probe_problems(df: DataFrame, most_rows: int = 10_000, most_bytes: int = 65_536) -> DataFrame:
    """problem and rows of a set of probes (id, domain, text): id, domain, text, marker, duplicate_id, duplicate_text,
    and, for the whole set, empty or too_many."""
    label = lambda c: F.col(c).isNull() | (F.col(c) == "") | (F.col(c) != tx.trimmed(F.col(c))) | (F.octet_length(c) > 128)
    text = F.col("text").isNull() | ~F.octet_length("text").between(1, most_bytes)
    row = F.filter(
        F.array(
            F.when(label("id"), "id"), F.when(label("domain"), "domain"), F.when(text, "text"),
            F.when(F.coalesce(tx.has_reserved(F.col("text"), markup=False), F.lit(False)), "marker"),
        ),
        lambda x: x.isNotNull(),
    )
    bad = df.select(F.explode(row).alias("problem"))
    for c in ("id", "text"):
        bad = bad.unionByName(df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").select(F.lit(f"duplicate_{c}").alias("problem")))
    size = df.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == 0, "empty").when(F.col("n") > most_rows, "too_many").alias("problem")).where("problem is not null")
    return bad.unionByName(size).groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


def reject_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """reason and rows of the rejected rows."""
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))

"""Text expressions. White space is Unicode's White_Space throughout; lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reserved dialogue markers.
USER, ASSISTANT, END = "<|user|>", "<|assistant|>", "<|end|>"
MARKERS = (USER, ASSISTANT, END)
#: Beginnings of markup that no plain text has.
MARKUP = ("<script", "<html")

SIGNIFICANT_CHARS, SIGNIFICANT_WORDS = 64, 8
#: The characters of Unicode's White_Space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def unix_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def normalized(text: Column) -> Column:
    """Line ends as ``\\n`` and no outer white space."""
    return trimmed(unix_lines(text))


def lines(text: Column) -> Column:
    """Lines without their ends: split at ``\\n``, one final ``\\r`` dropped, no empty line after a final ``\\n``."""
    parts = F.split(text, "\n", -1)
    full = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(full, lambda x: F.when(F.endswith(x, F.lit("\r")), F.left(x, F.length(x) - 1)).otherwise(x))


def blocks(text: Column) -> Column:
    """Parts between blank lines, i.e. split at each ``\\n\\n``; empty ones stay."""
    return F.split(text, "\n\n", -1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def word_set(text: Column) -> Column:
    """Distinct runs of letters and digits in lower case, in the order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", -1), lambda w: w != ""))


def trigrams(text: Column) -> Column:
    """Three words in a row of the text in lower case, each joined by a space; empty for fewer than three words."""
    w = words(F.lower(text))
    n = F.size(w) - 2
    join = lambda x, y: F.concat_ws(" ", x, y)
    part = lambda i: F.slice(w, F.lit(i), n)
    # three shifted lists side by side: a lambda that took each trigram out of the list would split the text for each
    return F.when(n > 0, F.zip_with(F.zip_with(part(1), part(2), join), part(3), join)).otherwise(F.array().cast("array<string>"))


def is_significant(fragment: Column) -> Column:
    """Of a trimmed fragment: long enough to be told from a phrase that anybody may write."""
    return (F.length(fragment) >= SIGNIFICANT_CHARS) & F.rlike(fragment, F.lit(rf"(?U)\A(?:\S+\s+){{{SIGNIFICANT_WORDS - 1}}}\S"))


def fragments(text: Column, records: bool = False) -> Column:
    """Trimmed significant lines and blocks of a text, with ``records`` also what stands between end markers."""
    parts = [lines(text), blocks(text), *([F.split(text, r"<\|end\|>", -1)] if records else [])]
    long = F.filter(F.concat(*parts), lambda x: F.length(x) >= SIGNIFICANT_CHARS)  # most lines end here
    return F.filter(F.transform(long, trimmed), is_significant)


def has_corrupted(text: Column) -> Column:
    """A replacement character, or a control character that is no white space."""
    return text.rlike(r"[\x{fffd}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")


def alphabetic(text: Column) -> Column:
    """Number of alphabetic characters."""
    return F.length(F.regexp_replace(text, r"\P{IsAlphabetic}+", ""))


def has_reserved(text: Column, markup: bool = True) -> Column:
    found = F.lit(False)
    for x in (*(MARKUP if markup else ()), *MARKERS):
        found = found | F.contains(text, F.lit(x))
    return found


def displayed(text: Column) -> Column:
    """Control characters but line feed and tab shown as U+FFFD."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "�")


def excerpt(text: Column, size: int = 420) -> Column:
    """The first characters, without control characters that are no white space."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]", ""), 1, size)


def question_key(text: Column) -> Column:
    """What questions are compared by: words in lower case, one space between."""
    return F.lower(F.array_join(words(text), " "))

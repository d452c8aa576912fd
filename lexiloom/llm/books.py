"""Text of scanned pages: headers, page numbers, broken words and misread characters, and its repair."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.runtime import cut, shared_folder, small_side_join

#: How much more frequent a form must be to stand for a rare one of the same skeleton: alone, and where its neighbours
#: in the text also stand beside it elsewhere.
RATIO_ALONE, RATIO_IN_CONTEXT = 25, 3
#: Occurrences from which a form is frequent on its own.
FREQUENT = 20
#: Likeness from which a line is taken for the title, the author or a chapter's name.
LIKE = 0.84
#: Bytes of a row group of parsed books, packed, and the rows after which its size is looked at. It changes no result.
ROW_GROUP = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "4"}

#: Glyphs that scanning takes for one another, as class and members; what is read, and what it may come from.
GLYPHS = {"c": "ce6€", "o": "o0", "r": "rvy", "t": "tfs5$", "n": "nu", "i": "il1!|", "g": "gq9", "b": "bh8"}
PAIRS = {"rn": ["m"], "cl": ["d"], "li": ["h", "u"], "ii": ["u"], "vv": ["w"], "lc": ["k"], "m": ["in", "ni", "nn", "rn"], "u": ["ll", "li", "ii"], "h": ["li"], "d": ["cl"], "w": ["vv"], "f": ["e"]}
HYPHENS = "-‐‑¬­"

_CLASS = {ord(m): c for c, members in GLYPHS.items() for m in members}
_TOKEN = re.compile(r"(?:[^\W_]|[̀-ͯ]|[!|$€](?=[^\W_]))+[!|]?['’]?|[!|1]['’](?=[^\W\d_])")
_ROMAN = re.compile(r"(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_ORDINAL = re.compile(r"(?i)^\d+(?:er|ère|re|e|ème|eme|nd|nde|de|st|th|rd|s|h|°)$")
_PAGE_SIGNS = re.compile("[\r\f\x0b\u2028]")
_CHAPTER = re.compile(r"(?i)^(?:chap[i1l!]tre|livre|partie|chapter)\b|^[cç]hap\.")


_MARKS, _BEYOND = re.compile("[\u0300-\u036f]+"), re.compile("[\u0483-\U0010ffff]")  # no other marks below


def _bare(text: str) -> str:
    low = text.lower()
    if low.isascii():
        return low
    made = _MARKS.sub("", unicodedata.normalize("NFKD", low))
    return "".join(c for c in made if not unicodedata.combining(c)) if _BEYOND.search(made) else made


@lru_cache(200_000)
def skeleton(word: str) -> str:
    """The word with each glyph replaced by the class of those it may be taken for; accents don't count."""
    return _bare(word).translate(_CLASS)


def skeletons(word: str) -> list[str]:
    """The skeleton of the word, and those of it with a pair of glyphs read as the one they may come from."""
    bare, out = _bare(word), {skeleton(word)}
    for pair, ones in PAIRS.items():
        at = bare.find(pair)
        while at >= 0:
            for one in ones:
                out.add((bare[:at] + one + bare[at + len(pair) :]).translate(_CLASS))
            at = bare.find(pair, at + 1)
    return sorted(out)


def _number(text: str) -> int | None:
    """The value of a page number, in figures or Roman numerals, with figures taken for letters."""
    figures = text.translate(str.maketrans("lIiOoQSsBbgqZz!|éG", "111000558899221166"))
    if len(text) < 7 and figures.isdigit() and (any(c.isdigit() for c in text) or text in ("l", "I", "i", "lO", "IO", "ll", "II")):
        return int(figures)
    if text and _ROMAN.match(text):
        values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in text.lower()]
        return sum(-v if any(w > v for w in values[i + 1 :]) else v for i, v in enumerate(values))
    return None


_ALONE = re.compile(r"^[\W_]*(?:(?:page|pag|p|pg|folio|f°)[.\s]*)?([\w!|]{1,9})[\W_]*$", re.I)
_BESIDE = re.compile(r"^(?:([\w!|]{1,9})\s{2,}(.+?)|(.+?)\s{2,}([\w!|]{1,9}))$")


def page_numbers(lines: list[str]) -> dict[int, int]:
    """Lines that hold only a number, and its value, where it goes up with the pages as the others do.

    The lines a page takes come from the slopes between candidates, those next to a number beside a header included.
    A year or the like in a line of its own doesn't lie on that slope.
    """
    alone, points = {}, {}
    for i, line in enumerate(lines):
        text = line.strip()
        if (m := _ALONE.match(text)) and (v := _number(m.group(1))) is not None:
            alone[i] = points[i] = v
        elif (m := _BESIDE.match(text)) and (v := _number(m.group(1) or m.group(4))) is not None:
            points[i] = v
    if len(points) < 2:
        return {}
    at = sorted(points)
    slopes = Counter()
    for a, i in enumerate(at):
        for j in at[a + 1 : a + 12]:
            gap = points[j] - points[i]
            if 0 < gap <= 12 and 8 <= (slope := (j - i) / gap) <= 120:
                slopes[round(slope)] += 1
    if not slopes:
        return {}
    near = lambda s: sum(n for k, n in slopes.items() if abs(k - s) <= max(2, 0.08 * s))
    best = max(slopes, key=lambda s: (near(s), slopes[s], s))

    def fits(i: int, j: int) -> bool:
        gap = points[j] - points[i]
        return gap != 0 and abs((j - i) / gap - best) <= max(3, 0.2 * best) / min(abs(gap), 3)

    support = {i: sum(fits(i, j) for j in at if j != i) for i in at}
    most = max(support.values())
    kept = {i: v for i, v in alone.items() if support[i] >= max(1, 0.3 * most)}
    # pages at the ends may be shorter, others longer: a number in its order between the sure ones fits too
    sure = sorted(i for i in at if support[i] >= max(1, 0.3 * most))
    for i, v in alone.items():
        left, right = max((j for j in sure if j < i), default=None), min((j for j in sure if j > i), default=None)
        reach = lambda j: abs(i - j) / best * 1.5 + 1
        if (left is None or 0 < v - points[left] <= reach(left)) and (right is None or 0 < points[right] - v <= reach(right)):
            kept[i] = v
    return kept


def _like(a: str, b: str) -> bool:
    if not a or not b or abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)) + 1:
        return False
    # no more letters can match than both have
    return a == b or 2 * sum((_letters(a) & _letters(b)).values()) >= LIKE * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= LIKE


@lru_cache(10_000)
def _letters(text: str) -> Counter:
    return Counter(text)


def layout(text: str, title: str | None, author: str | None) -> tuple[list[str], dict[int, str], set[int]]:
    """Lines, the lines that are running headers or page numbers, and those that open a chapter."""
    lines = text.split("\n")
    plain = [_PAGE_SIGNS.sub("", x).strip() for x in lines]
    filled = [i for i, x in enumerate(plain) if x]
    kinds = {i: "page_number" for i in page_numbers([_PAGE_SIGNS.sub("", x) for x in lines])}
    opening, names = set(), {}
    following = dict(zip(filled, filled[1:]))
    for i in filled:
        if _CHAPTER.match(plain[i]) and len(plain[i]) < 40:
            opening.add(i)
            j = following.get(i)
            while j is not None and kinds.get(j) == "page_number":
                j = following.get(j)
            if j is not None and len(plain[j]) < 60 and not re.search(r"[.,;:!?»]$", plain[j]):
                opening.add(j)
                names[skeleton(plain[j])] = j
    known = [skeleton(x) for x in (title, author) if x and x.strip()] + list(names)
    cores = {}
    for i in filled:
        if i in kinds or i in opening:
            continue
        core, m = plain[i], _BESIDE.match(plain[i])
        if m and _number(m.group(1) or m.group(4)) is not None:
            core = m.group(2) or m.group(3)
        core = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", core)
        if 3 < len(core) < 90:
            cores[i] = skeleton(core)
    # digits are masked by taking the figures off, equal lines are then counted by their skeleton
    repeated = Counter(cores.values())
    for i, core in cores.items():
        told = core in known or (repeated[core] > 1 or _edge(i, lines, plain, kinds)) and any(_like(core, k) for k in known)
        if told:
            kinds[i] = "running_header"
    # a name that the row doesn't have, as where the author is null: a line without final sign at the edges of pages only
    for core in {c for i, c in cores.items() if repeated[c] > 2 and i not in kinds}:
        places = [i for i, c in cores.items() if c == core and i not in kinds]
        if all(_edge(i, lines, plain, kinds) and not re.search(r"[.,;:!?»…]$", plain[i]) for i in places):
            kinds |= dict.fromkeys(places, "running_header")
    return lines, kinds, opening


def _edge(i: int, lines: list[str], plain: list[str], kinds: dict[int, str]) -> bool:
    """Whether a line stands at the edge of a page or apart from the text around it."""
    beside = [j for j in (i - 1, i + 1) if 0 <= j < len(lines)]
    return "\f" in lines[i] or len(beside) < 2 or any(not plain[j] or kinds.get(j) == "page_number" or "\f" in lines[j] for j in beside) or plain[i].isupper()


@dataclass
class Words:
    """Words of the text lines of a book, column by column: the line, the line that a broken one goes on in (else -1), the
    word, its letters in the first line, and its place: the words of the line before it, parts of broken ones included.
    Besides the compounds that stand within a line, and head and tail of the broken ones."""

    line: list[int] = field(default_factory=list)
    after: list[int] = field(default_factory=list)
    word: list[str] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    compounds: list[str] = field(default_factory=list)
    broken: list[tuple[int, str, str]] = field(default_factory=list)

    def add(self, line: int, words: list[str], first: int = 0) -> None:
        self.line += [line] * len(words)
        self.after += [-1] * len(words)
        self.word += words
        self.size += map(len, words)
        self.place += range(first, first + len(words))

    def join(self, line: int, after: int, head: str, tail: str, place: int) -> None:
        for column, value in zip((self.line, self.after, self.word, self.size, self.place), (line, after, head + tail, len(head), place)):
            column.append(value)
        self.broken.append((line, _low(head), _low(tail)))


_BREAK = re.compile(rf"([^\W\d_]|['’\d])[{HYPHENS}]\s*$")
_COMPOUND = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?[-‐‑][^\W\d_]+")


def _low(word: str) -> str:
    return word.replace("’", "'").lower()


def tokens(lines: list[str], kinds: dict[int, str]) -> tuple[set[int], Words]:
    """Lines that end within a word, and the words of text lines. A broken word comes as one, without its hyphen."""
    texts = [(i, _PAGE_SIGNS.sub(" ", x).strip()) for i, x in enumerate(lines) if kinds.get(i) not in ("running_header", "page_number")]
    texts = [(i, x) for i, x in texts if x]
    broken, out, carry = set(), Words(), None
    for k, (i, x) in enumerate(texts):
        found, first = _TOKEN.findall(x), 0
        if carry:
            line, head, place = carry
            if found and _TOKEN.match(x):
                out.join(line, i, head, found[0], place)
                found, first = found[1:], 1
            else:
                out.add(line, [head], place)
            carry = None
        last = _BREAK.search(x) if x[-1] in HYPHENS else None
        if last and re.match(r"[^\W_]|[!|]", texts[k + 1][1] if k + 1 < len(texts) else ""):
            broken.add(i)
            if found and [m.end() for m in _TOKEN.finditer(x)][-1] >= last.start():
                carry = (i, found[-1], first + len(found) - 1)
                found = found[:-1]
        if "-" in x or "‐" in x or "‑" in x:
            out.compounds += [_low(c).replace("‐", "-").replace("‑", "-") for c in _COMPOUND.findall(x)]
        out.add(i, found, first)
    if carry:
        out.add(carry[0], [carry[1]], carry[2])
    return broken, out


_ARRAYS = {"line": "int", "after": "int", "word": "string", "low": "string", "size": "int", "place": "int"}


def parsed(df: DataFrame, ident: str = "file_id", title: str = "title", author: str = "author", text: str = "complete_text", raw: bool = False) -> DataFrame:
    """One row for each book with text: its lines of a kind and those that open a chapter, its words as arrays side by
    side, its compounds and broken words, with ``raw`` its lines too.

    It is written to a table in the checkpoint folder, packed: the texts are laid out once, and what follows explodes
    arrays where they are read. Its row groups are small (ROW_GROUP), as Spark reads up to 4096 rows of one at once, and
    so many books at once don't fit an executor.
    """
    names = [ident, "special", "opening", "raw", *_ARRAYS, "compounds", "broken"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, t, a, x in zip(batch[ident], batch[title], batch[author], batch[text]):
                lines, kinds, opening = layout(x, t, a)
                broken, w = tokens(lines, kinds)
                special = [(i, kinds.get(i) or "hyphen_break") for i in sorted({*kinds, *broken})]
                yield pd.DataFrame(
                    [(key, special, sorted(opening), lines if raw else None, w.line, w.after, w.word, [_low(x) for x in w.word], w.size, w.place, w.compounds, w.broken)], columns=names
                )

    key = df.schema[ident].dataType.simpleString()
    arrays = ", ".join(f"`{c}` array<{t}>" for c, t in _ARRAYS.items())
    schema = f"`{ident}` {key}, special array<struct<line_no:int,kind:string>>, opening array<int>, raw array<string>, {arrays}, compounds array<string>, broken array<struct<line_no:int,head:string,tail:string>>"
    rows = df.where(F.col(text).isNotNull()).select(ident, title, author, text)
    folder = shared_folder(df.sparkSession, "books")
    made = rows.mapInPandas(run, schema)
    made.write.options(**ROW_GROUP).option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(made.schema).parquet(folder)


def _mixed(word: Column) -> Column:
    """Figures or signs among the letters of a word, which no frequency has to tell."""
    bare = F.regexp_replace(word, "['’]+$", "")
    letter = r"[\p{L}\p{M}]"
    signs = bare.rlike(rf"{letter}[!|$€]{letter}") | (bare.isin("1", "!", "|") & (bare != word))
    figures = bare.rlike(r"\p{Nd}") & bare.rlike(letter) & ~bare.rlike(_ORDINAL.pattern.replace("(?i)", "(?iu)")) & ~bare.rlike(_ROMAN.pattern)
    return word.rlike(r"[\d!|$€]") & ~word.rlike(r"^\d+$") & (signs | figures)


def _skeleton_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(w, n, s, k == skeleton(w)) for w, n in zip(batch["__low"], batch["n"]) for k in skeletons(w) for s in [k]]
        yield pd.DataFrame(rows, columns=["__low", "n", "__skeleton", "own"])


def word_counts(books: DataFrame) -> DataFrame:
    """(__low, n, whole) of the words of parsed books: how often each stands, and how often on one line."""
    each = books.select(F.explode(F.arrays_zip("low", "after")).alias("w")).select(F.col("w.low").alias("__low"), (F.col("w.after") < 0).cast("int").alias("whole"))
    return each.groupBy("__low").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole"))


def misread_words(books: DataFrame, ident: str, counts: DataFrame) -> DataFrame:
    """Place, word and ``meant`` of the words of parsed books that have a misread character.

    All words are counted over all books and grouped by skeleton. The forms of a group that are RATIO_IN_CONTEXT times
    as frequent as a rare one are compared in each place by how often they stand beside the word before and the word
    behind elsewhere; the best supported one is meant, of equal ones the most frequent. Where none is supported the
    most frequent one is, if it is RATIO_ALONE times as frequent. Words with figures among their letters need no such
    form; ``meant`` is null then. Only suspects leave the arrays that they stand in, and only pairs of words that a
    suspect asks for are counted.
    """
    n = F.size("low")
    none = F.array(F.lit(None).cast("string"))
    sides_ = F.arrays_zip("line", "after", "word", "size", "place", "low", F.concat(none, F.slice("low", F.lit(1), n - 1)).alias("before"), F.concat(F.slice("low", F.lit(2), n - 1), none).alias("next"))
    filled = books.where(n > 0)
    rows = filled.select(ident, F.posexplode(sides_).alias("__k", "w")).select(
        ident, F.col("w.line").alias("line_no"), "__k", F.col("w.after").alias("__after"), F.col("w.word").alias("__word"), F.col("w.size").alias("__size"),
        F.col("w.place").alias("__place"), F.col("w.low").alias("__low"), F.col("w.before").alias("__before"), F.col("w.next").alias("__next"),
    )
    shaped = counts.where((F.length("__low") >= 2) & ~F.col("__low").rlike(r"^\d+$")).mapInPandas(
        _skeleton_rows, "__low string, n long, __skeleton string, own boolean"
    )
    forms = shaped.where(F.col("own") & (F.col("n") >= RATIO_IN_CONTEXT) & ~F.col("__low").rlike(r"\d|!")).select("__skeleton", F.col("n").alias("__m"), F.col("__low").alias("meant"))
    better = (
        shaped.join(forms, "__skeleton")
        .where((F.col("meant") != F.col("__low")) & (F.col("__m") >= F.col("n") * RATIO_IN_CONTEXT))
        .groupBy("__low")
        .agg(F.max("n").alias("__n"), F.collect_set(F.struct("__m", "meant")).alias("__forms"))
    )
    odd = counts.where(_mixed(F.col("__low"))).select("__low", F.lit(True).alias("__odd"))
    wanted = better.join(odd, "__low", "full").select("__low", "__n", "__forms", F.coalesce("__odd", F.lit(False)).alias("__odd"))
    suspects = cut(small_side_join(rows, wanted, ["__low"]))
    place = [ident, "line_no", "__k"]
    each = suspects.select(*place, "__before", "__next", F.explode("__forms").alias("__form"))
    sides = each.select(*place, "__form", F.col("__before").alias("__a"), F.col("__form.meant").alias("__b")).unionByName(
        each.select(*place, "__form", F.col("__form.meant").alias("__a"), F.col("__next").alias("__b"))
    )
    beside = F.zip_with(F.slice("low", F.lit(1), n - 1), F.slice("low", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("__a"), b.alias("__b")))
    asked = sides.where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).select("__a", "__b").distinct()
    pairs = small_side_join(filled.select(F.explode(beside).alias("p")).select("p.*"), asked, ["__a", "__b"], "left_semi").groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__pairs"))
    # the product of the counts of both sides: one frequent neighbour alone doesn't settle it against two
    backed = sides.join(pairs, ["__a", "__b"]).groupBy(*place, "__form").agg(F.sum(F.log1p("__pairs")).alias("__support"))
    chosen = backed.groupBy(*place).agg(F.max(F.struct("__support", "__form")).alias("__best"))
    form = F.coalesce("__best.__form", F.array_max("__forms"))
    told = suspects.join(chosen, place, "left").withColumn("__m", form["__m"]).withColumn("meant", form["meant"])
    alone = (F.col("__m") >= F.col("__n") * RATIO_ALONE) & (F.col("__m") >= FREQUENT)
    return told.where(F.col("__odd") | alone | F.col("__best").isNotNull()).drop("__forms", "__best")


def _places(ident: str):
    """The line in which the misread character stands, of words broken over two lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = []
            for line, after, size, word, meant in zip(batch["line_no"], batch["__after"], batch["__size"], batch["__word"], batch["meant"]):
                if after < 0:
                    at.append(line)
                    continue
                if meant:
                    first = next((i for i, (x, y) in enumerate(zip(word.lower(), meant)) if x != y), min(len(word), len(meant)))
                else:
                    first = next((i for i, c in enumerate(word) if not c.isalpha()), 0)
                at.append(line if first < size else after)
            yield pd.DataFrame({ident: batch[ident], "line_no": at, "__word": batch["__word"], "meant": batch["meant"], "__place": batch["__place"].where(batch["__after"] < 0)})

    return run


def affected_lines(df: DataFrame, ident: str = "file_id", title: str = "title", author: str = "author", text: str = "complete_text") -> DataFrame:
    """(ident, line_no, kind): running_header, page_number, hyphen_break and misread lines; a line may have two kinds."""
    books = parsed(df, ident, title, author, text)
    lines = books.select(ident, F.inline("special"))
    key = df.schema[ident].dataType.simpleString()
    places = misread_words(books, ident, cut(word_counts(books))).mapInPandas(_places(ident), f"`{ident}` {key}, line_no int, __word string, meant string, __place int")
    return lines.unionByName(places.select(ident, "line_no", F.lit("misread").alias("kind")).distinct())


def paragraphs(df: DataFrame, ident: str = "file_id", title: str = "title", author: str = "author", text: str = "complete_text") -> DataFrame:
    """(ident, paragraph, text): the books as continuous paragraphs.

    Headers and page numbers go, words broken over lines are joined (the hyphen stays where the joined word is rarer
    in the books than the one with it), misread words get the form that stands for them, and lines run on to the next
    blank line, indentation or chapter. A paragraph that runs over a page break stays one.
    """
    books = parsed(df, ident, title, author, text, raw=True)
    counts = cut(word_counts(books))
    key = df.schema[ident].dataType.simpleString()
    wrong = misread_words(books, ident, counts).mapInPandas(_places(ident), f"`{ident}` {key}, line_no int, __word string, meant string, __place int")
    fixes = wrong.where(F.col("meant").isNotNull() & F.col("__place").isNotNull()).groupBy(ident, "line_no").agg(F.collect_list(F.struct("__place", "__word", "meant")).alias("__fixes"))
    told = F.map_from_entries(F.transform("special", lambda x: F.struct(x["line_no"], x["kind"])))
    place = F.transform("raw", lambda x, i: F.struct(i.cast("int").alias("line_no"), x.alias("raw"), F.try_element_at(told, i.cast("int")).alias("kind"), F.array_contains("opening", i.cast("int")).alias("opening")))
    lines = books.select(ident, F.inline(place)).join(fixes, [ident, "line_no"], "left").join(_hyphened(books, ident, counts), [ident, "line_no"], "left")
    clean = F.regexp_replace("raw", r"[\r\f\x0b ]", "")
    order = Window.partitionBy(ident).orderBy("line_no")
    text_line = ~F.coalesce(F.col("kind").isin("running_header", "page_number"), F.lit(False))
    lines = lines.where(text_line).withColumn("__text", clean)
    blank = F.trim("__text") == ""
    # a blank line beside a removed header belongs to the page's edge, not to the text
    lines = lines.withColumn("__gap", F.col("line_no") - F.lag("line_no", 1, -1).over(order) > 1).withColumn("__ahead", F.lead("line_no").over(order) - F.col("line_no") > 1)
    lines = lines.where(~(blank & (F.col("__gap") | F.coalesce("__ahead", F.lit(False)))))
    before_blank = F.lag(blank, 1, True).over(order)
    starts = blank | before_blank | F.col("__text").rlike(r"^\s{2,}\S") | F.col("opening") | F.lag("opening", 1, False).over(order)
    numbered = lines.select(ident, "line_no", "kind", "raw", "__fixes", "__hyphen", F.sum(F.when(starts, 1).otherwise(0)).over(order).alias("__p"), blank.alias("__blank"))
    numbered = numbered.where(~F.col("__blank"))

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, fixes_, kind, hyphen in zip(batch["raw"], batch["__fixes"], batch["kind"], batch["__hyphen"]):
                plain = _PAGE_SIGNS.sub(" ", x)  # as the words were told apart
                start = len(plain) - len(plain.lstrip())
                found = [m.span() for m in _TOKEN.finditer(plain.strip())] if fixes_ is not None else []
                for fix in sorted(fixes_ if fixes_ is not None else [], key=lambda f: -f["__place"]):
                    (a, b), word, meant = found[fix["__place"]], fix["__word"], fix["meant"]
                    x = x[: start + a] + (meant.capitalize() if word[:1].isupper() else meant) + x[start + b :]
                x = _PAGE_SIGNS.sub("", x).strip()
                if kind == "hyphen_break":
                    x = re.sub(rf"[{HYPHENS}]\s*$", "-\x00" if hyphen == True and re.search(r"[-‐‑]\s*$", x) else "\x00", x)  # noqa: E712
                out.append(x)
            yield pd.DataFrame({ident: batch[ident], "line_no": batch["line_no"], "__p": batch["__p"], "__text": out})

    mended = numbered.mapInPandas(mend, f"`{ident}` {key}, line_no int, __p long, __text string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "__text"))), lambda x: x["__text"]), "\n")
    made = mended.groupBy(ident, "__p").agg(F.min("line_no").alias("__first"), joined.alias("text"))
    made = made.withColumn("text", F.regexp_replace("text", "\x00\n", "")).withColumn("text", F.trim(F.regexp_replace("text", r"\s*\n\s*", " ")))
    number = F.row_number().over(Window.partitionBy(ident).orderBy("__first")).alias("paragraph")
    return made.select(ident, number, F.regexp_replace("text", "-?\x00", "-").alias("text"))


#: Heads of compounds, for those that stand nowhere else in the books, neither with hyphen nor joined.
COMPOUND_HEADS = ("au", "par", "là", "ci", "non", "demi", "contre", "avant", "arrière", "sous", "vice", "grand", "quelques", "vis", "peut", "c'est", "celui", "celle", "ceux")


def _hyphened(books: DataFrame, ident: str, counts: DataFrame) -> DataFrame:
    """(ident, line_no, __hyphen) of lines that end within a word: whether the hyphen is the word's own, because the
    compound stands more often within the lines of all books than the joined word does."""
    broken = cut(books.select(ident, F.inline("broken")).withColumn("__low", F.concat("head", "tail")).withColumn("__compound", F.concat_ws("-", "head", "tail")))
    joined = counts.join(broken.select("__low").distinct(), "__low", "left_semi").select("__low", "whole")
    wanted = broken.select("__compound").distinct()
    compounds = small_side_join(books.select(F.explode("compounds").alias("__compound")), wanted, ["__compound"], "left_semi").groupBy("__compound").agg(F.count(F.lit(1)).alias("__n"))
    both = small_side_join(small_side_join(broken, joined, ["__low"], "left"), compounds, ["__compound"], "left")
    with_, without = F.coalesce("__n", F.lit(0)), F.coalesce("whole", F.lit(0))
    own = F.when((with_ == 0) & (without == 0), F.col("head").isin(*COMPOUND_HEADS)).otherwise(with_ > without)
    return both.groupBy(ident, "line_no").agg(F.max(own).alias("__hyphen"))

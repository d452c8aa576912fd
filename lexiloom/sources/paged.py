"""Remote rows that come in pages, and answers of an encyclopedia's interface."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, MOST_PAGE, MOST_BODY = 100, 100, 16 * 2**20
RETRIED, PAUSES = (502, 503, 504), (5.0, 15.0)


@dataclass
class Page(InputPartition):
    offset: int
    length: int

    def __init__(self, offset: int, length: int):
        super().__init__(None)
        self.offset, self.length = offset, length


def fetch(url: str, most: int = MOST_BODY, pauses: tuple[float, ...] = PAUSES) -> bytes:
    """Body of an https or file URL, of at most ``most`` bytes; gateway errors are retried, redirects refused."""
    if urllib.parse.urlsplit(url).scheme not in ("https", "file"):
        raise ValueError("only https and file URLs are read")

    class Refuse(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args, **kwargs):
            return None

    for pause in (*pauses, None):
        try:
            with urllib.request.build_opener(Refuse).open(url, timeout=60) as answer:
                body = answer.read(most + 1)
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED or pause is None:
                raise
            time.sleep(pause)
            continue
        if len(body) > most:
            raise ValueError(f"the body has more than {most} bytes")
        return body
    raise AssertionError


def page_rows(body: bytes, offset: int, columns: list[str], partial: bool = False) -> Iterator[tuple]:
    """Rows of a page {rows: [{row_idx, row, truncated_cells}], num_rows_total, partial}; their numbers must follow the offset."""
    page = json.loads(body)
    if page.get("partial") and not partial:
        raise ValueError("the source says that it is partial")
    for i, item in enumerate(page["rows"]):
        if item["row_idx"] != offset + i:
            raise ValueError(f"row {item['row_idx']} came where {offset + i} was asked for")
        yield (item["row_idx"], len(item.get("truncated_cells", [])), *(item["row"].get(c) for c in columns))


class PagedSource(DataSource):
    """``spark.read.format("paged")``: a partition for each page of a rows service.

    Options: url (with {offset} and {length} for the page), rows (how many to read), page (rows in one, at most 100),
    allow_partial. The schema is row_idx, truncated_cells and then the row's columns; other columns are dropped.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        from lexiloom.sources.files import DOCUMENT

        return f"row_idx bigint, truncated_cells int, {DOCUMENT}"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options, schema):
        self.url, self.total = options["url"], int(options["rows"])
        self.page = min(int(options.get("page", PAGE)), MOST_PAGE)
        self.partial = options.get("allow_partial", "false") == "true"
        self.columns = schema.names[2:]

    def partitions(self) -> list[Page]:
        return [Page(i, min(self.page, self.total - i)) for i in range(0, self.total, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        body = fetch(self.url.format(offset=partition.offset, length=partition.length))
        yield from page_rows(body, partition.offset, self.columns, self.partial)


_PAGE = "struct<pageid:bigint,ns:int,missing:boolean,title:string,extract:string,revisions:array<struct<revid:bigint>>>"
_ANSWER = f"struct<error:struct<code:string>,query:struct<pages:array<{_PAGE}>,search:array<struct<pageid:bigint,ns:int>>>>"


def search_ids(body: Column) -> Column:
    """Page ids of an answer to a search, null for an error or no JSON."""
    a = F.from_json(body, _ANSWER)
    return F.when(a["error"].isNull(), F.transform(F.filter(a["query"]["search"], lambda x: x["ns"] == 0), lambda x: x["pageid"]))


def parsed_articles(df: DataFrame, body: str, wanted: str, language: str, fetched: str, license_name: str = "CC BY-SA 4.0") -> DataFrame:
    """df with ``article``, or ``problem``: error, page, missing, namespace, blank, revision, of answers to page requests."""
    a = F.from_json(F.col(body), _ANSWER)
    page = F.try_element_at(F.filter(a["query"]["pages"], lambda p: p["pageid"] == F.col(wanted)), F.lit(1))
    rows = df.withColumn("__a", a).withColumn("__p", page)
    p = F.col("__p")
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)\s", ""), F.lit("")) == ""
    revision = F.try_element_at(p["revisions"], F.lit(1))["revid"]
    problem = (
        F.when(F.col("__a").isNull() | F.col("__a.error").isNotNull(), "error")
        .when(p.isNull(), "page")
        .when(F.coalesce(p["missing"], F.lit(False)), "missing")
        .when(F.coalesce(p["ns"], F.lit(-1)) != 0, "namespace")
        .when(blank(p["title"]) | blank(p["extract"]), "blank")
        .when(F.coalesce(revision, F.lit(0)) <= 0, "revision")
    )
    url = F.concat(F.lit("https://"), F.col(language), F.lit(".wikipedia.org/?curid="), p["pageid"].cast("string"))
    article = F.struct(
        p["pageid"].alias("id"), revision.alias("revision_id"), p["title"].alias("title"), url.alias("url"), F.col(language).alias("language"),
        p["extract"].alias("text"), F.lit(license_name).alias("license"), F.col(fetched).cast("long").alias("fetched_at_unix"),
    )
    return rows.withColumn("problem", problem).withColumn("article", F.when(F.col("problem").isNull(), article)).drop("__a", "__p")

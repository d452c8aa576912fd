"""The queries over the tables of a scale folder, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import hashing, training
from lexiloom.functions import text as tx
from lexiloom.functions import urls
from lexiloom.operators import audit, curation, dedup, dialogue, integrity, library, mix, quality, sampling, shards, splits
from lexiloom.runtime import cut, read
from lexiloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SHARD_TOKENS = 50_000
QUESTION = "histoire de la clairière ancienne et du moulin"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- fragments of SQL ------------------------------------------------------------------------------------------------

_W = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _unix(x: str) -> str:
    return f"replace({x}, chr(13) || chr(10), chr(10))"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_W}+'), lambda w: w <> '')"


def _significant(x: str) -> str:
    return f"(length({x}) >= 64 and len({_words(x)}) >= 8)"


def _lines(x: str) -> str:
    parts = f"string_split({x}, chr(10))"
    return f"list_transform(case when list_extract({parts}, -1) = '' then list_slice({parts}, 1, len({parts}) - 1) else {parts} end, lambda l: regexp_replace(l, '\\r$', ''))"


def _blocks(x: str) -> str:
    return f"string_split({x}, chr(10) || chr(10))"


def _fragments(x: str, records: bool = False) -> str:
    parts = f"list_concat({_lines(x)}, {_blocks(x)})"
    if records:
        parts = f"list_concat({parts}, string_split({x}, '<|end|>'))"
    return f"list_filter(list_transform({parts}, lambda q: {_trim('q')}), lambda s: {_significant('s')})"


def _split(key: str) -> str:
    n = f"('0x' || substr(sha256({key}), 1, 16))::UBIGINT % 10"
    return f"case when {key} is null then null when {n} = 0 then 'test' when {n} = 1 then 'validation' else 'train' end"


_BAD = r"[\x{FFFD}\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}]"
_HOST = r"nullif(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(?::\d*)?(?:[/?#]|$)', 1)), '')"


def _reserved(x: str, markup: bool = True) -> str:
    found = [*(["<script", "<html"] if markup else []), "<|user|>", "<|assistant|>", "<|end|>"]
    return "(" + " or ".join(f"contains({x}, '{m}')" for m in found) + ")"


def _text_reason(x: str) -> str:
    long = f"list_filter(list_transform({_lines(x)}, lambda q: {_trim('q')}), lambda l: length(l) >= 40)"
    return f"""case when length({x}) not between 200 and 200000 then 'length'
      when regexp_matches({x}, '{_BAD}') then 'corrupted_characters'
      when length(regexp_replace({x}, '\\P{{L}}+', '', 'g')) * 10 < length({x}) * 4 then 'low_text_ratio'
      when {_reserved(x)} then 'markup_or_reserved_tokens'
      when len({long}) >= 5 and len(list_distinct({long})) * 10 < len({long}) * 6 then 'repeated_lines' end"""


# --- splits and quality ----------------------------------------------------------------------------------------------


@query(f"""
select split, count(*) as documents, coalesce(sum(length(text)), 0)::bigint as chars, coalesce(sum(strlen(text)), 0)::bigint as bytes
from (select {_split(_HOST)} as split, text from web_documents) group by split""")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_sizes(splits.with_split(read(spark, d, "web_documents"), urls.web_host(F.col("url"))))


@query(f"select file_id, {_split('file_id')} as split from books")
def split_books(spark: SparkSession, d: str) -> DataFrame:
    return splits.with_split(read(spark, d, "books").select("file_id"), F.col("file_id"))


@query(f"select record_id, {_split("(language || ':' || id)")} as split from articles")
def split_articles(spark: SparkSession, d: str) -> DataFrame:
    return splits.with_split(read(spark, d, "articles"), hashing.article_key(F.col("language"), F.col("id"))).select("record_id", "split")


@query("""
with b as (select topic, ('0x' || substr(sha256(example_id::varchar), 1, 2))::int % 10 as n from dialogue_examples)
select case when n = 0 then 'test' when n = 1 then 'validation' else 'train' end as split, topic, count(*) as units from b group by all""")
def split_units(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.with_split(read(spark, d, "dialogue_examples"), F.col("example_id").cast("string"), unit=True)
    return rows.groupBy("split", "topic").agg(F.count(F.lit(1)).alias("units"))


@query(f"select doc_id, sha256({_trim(_unix('text'))}) as sha from documents")
def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", hashing.sha(tx.normalized(F.col("text"))).alias("sha"))


_WEB_REASON = f"""
select record_id, text, {_HOST} as host, coalesce(
    case when language = 'fra' and language_script = 'Latn' and isfinite(language_score) and language_score >= 0.8 then null else 'language' end,
    {_text_reason('t')}, case when {_HOST} is null then 'invalid_url' end) as reason
from (select *, coalesce({_trim(_unix('text'))}, '') as t from web_documents)"""


@query(f"select record_id, host, reason from ({_WEB_REASON})")
def web_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.web_reasons(read(spark, d, "web_documents")).select("record_id", "host", "reason")


@query(f"select reason, count(*) as rows from ({_WEB_REASON}) where reason is not null group by reason")
def web_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.reject_counts(quality.web_reasons(read(spark, d, "web_documents")))


_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


@query(f"""
select file_id, case when score is null then 'ocr_field_invalid' when score not between 0 and 100 or score < 60 then 'low_ocr_score'
  when coalesce(word_count, 0) < 500 then 'too_few_words' when length(t) not between 2000 and 3000000 then 'length'
  when regexp_matches(t, '{_BAD}') then 'corrupted_characters' when {_reserved('t')} then 'markup_or_reserved_tokens' end as reason
from (select file_id, word_count, coalesce({_trim(_unix('complete_text'))}, '') as t,
  case when regexp_matches({_trim('ocr')}, '{_NUMBER}') then try_cast({_trim('ocr')} as double) end as score from books)""")
def book_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.book_reasons(read(spark, d, "books")).select("file_id", "reason")


def _blank(c: str) -> str:
    return f"coalesce({_trim(c)}, '') = ''"


_ARTICLE_PROBLEM = f"""case when coalesce(id <= 0, true) then 'id' when coalesce(revision_id <= 0, true) then 'revision_id'
  when not coalesce(regexp_matches(language, '^[a-z-]+$'), false) then 'language'
  when {_blank('title')} then 'title' when {_blank('text')} then 'text' when {_blank('url')} then 'url' when {_blank('license')} then 'license' end"""


@query(f"select record_id, {_ARTICLE_PROBLEM} as problem from articles")
def article_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.article_problem(read(spark, d, "articles")).select("record_id", "problem")


@query(f"""
select example_id, case when {_blank('question')} or {_blank('answer')} then 'blank'
  when {_reserved('question', False)} or {_reserved('answer', False)} then 'reserved_marker' end as problem from dialogue_examples""")
def dialogue_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.dialogue_problem(read(spark, d, "dialogue_examples")).select("example_id", "problem")


@query(f"""
select key, count(*) as rows from (select lower(array_to_string({_words('question')}, ' ')) as key from dialogue_examples where question is not null)
group by key having count(*) > 1""")
def dialogue_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.duplicate_questions(read(spark, d, "dialogue_examples"))


@query(f"""
with p as (select example_id::varchar as id, topic as domain, question as text from dialogue_examples),
label as (select *, id is null or id = '' or id <> {_trim('id')} or strlen(id) > 128 as bad_id,
  domain is null or domain = '' or domain <> {_trim('domain')} or strlen(domain) > 128 as bad_domain from p),
bad as (
  select 'id' as problem from label where bad_id union all select 'domain' from label where bad_domain
  union all select 'text' from p where text is null or strlen(text) not between 1 and 65536
  union all select 'marker' from p where {_reserved('text', False)}
  union all select 'duplicate_id' from p where id is not null group by id having count(*) > 1
  union all select 'duplicate_text' from p where text is not null group by text having count(*) > 1
  union all select 'too_many' from p having count(*) > 10000)
select problem, count(*) as rows from bad group by problem""")
def probe_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "dialogue_examples").select(F.col("example_id").cast("string").alias("id"), F.col("topic").alias("domain"), F.col("question").alias("text"))
    return quality.probe_problems(rows)


# --- projections -----------------------------------------------------------------------------------------------------


@query(f"""
select record_id, len({_fragments(_unix('text'))}) as fragments, len(list_distinct({_fragments(_unix('text'), True)})) as with_records
from web_documents where text is not null""")
def text_fragments(spark: SparkSession, d: str) -> DataFrame:
    text = tx.unix_lines(F.col("text"))
    rows = read(spark, d, "web_documents").where(F.col("text").isNotNull())
    return rows.select("record_id", F.size(tx.fragments(text)).cast("long").alias("fragments"), F.size(F.array_distinct(tx.fragments(text, records=True))).cast("long").alias("with_records"))


@query(f"""
with w as (select doc_id, {_words('lower(text)')} as w from documents where text is not null)
select doc_id, greatest(len(w) - 2, 0) as trigrams,
  sha256(array_to_string(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) else []::varchar[] end, chr(10))) as sha
from w""")
def word_trigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", tx.trigrams(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("trigrams"), hashing.sha(F.array_join("t", "\n")).alias("sha"))


@query(r"""
select record_id, len(s) as words, array_to_string(list_sort(s), ' ') as joined
from (select record_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as s from articles where title is not null)""")
def word_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "articles").where(F.col("title").isNotNull()).select("record_id", tx.word_set(F.col("title")).alias("s"))
    return rows.select("record_id", F.size("s").cast("long").alias("words"), F.array_join(F.array_sort("s"), " ").alias("joined"))


@query(rf"""
select doc_id, substring(regexp_replace(text, '[\x{{0}}-\x{{8}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{84}}\x{{86}}-\x{{9F}}]', '', 'g'), 1, 420) as excerpt,
  sha256(regexp_replace(text, '[\x{{0}}-\x{{8}}\x{{B}}-\x{{1F}}\x{{7F}}-\x{{9F}}]', chr(65533), 'g')) as displayed from documents""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", tx.excerpt(t).alias("excerpt"), hashing.sha(tx.displayed(t)).alias("displayed"))


# Where a piece ends: 4096 bytes on, or before the character that would be split there (at most three bytes back).
_END_AT = f"""case when p + 4096 >= n then n else p + 4096 - list_position(list_transform(range(4), lambda i: ('0x' || substr(h, (2 * (p + 4096 - i) + 1)::int, 2))::int & 192 <> 128), true) + 1 end"""
_CHUNKS = f"""
src as (select doc_id, {{}} hex(encode(text)) as h, strlen(text) as n from {{}} where text is not null and text <> ''),
chunk as (select *, 0::bigint as p from src union all select * replace ({_END_AT} as p) from chunk where ({_END_AT}) < n),
piece as (select * exclude (h, n, p), p as "offset", ({_END_AT}) - p as bytes from chunk)"""


@query(f"""with recursive {_CHUNKS.format('', 'documents')} select doc_id, "offset", bytes from piece""")
def utf8_chunks(spark: SparkSession, d: str) -> DataFrame:
    return mix.fragments(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "offset", "bytes")


@query(f"select record_id, {_HOST} as host, regexp_replace(url, '#.*$', '') as page from web_documents")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "web_documents").select("record_id", urls.web_host(F.col("url")).alias("host"), urls.without_fragment(F.col("url")).alias("page"))


# --- duplicates ------------------------------------------------------------------------------------------------------

_SKETCH = f"""
gram as (select record_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) else []::varchar[] end) as g
  from (select record_id, {_words('lower(text)')} as w from web_documents where text is not null)),
vote as (select record_id, sha256(g) as h from gram),
bits as (select record_id, k, sum(case when (('0x' || substr(h, (2 * (k // 8) + 1)::int, 2))::int >> (k % 8)::int) & 1 = 1 then 1 else -1 end) as v
  from vote, range(64) t(k) group by record_id, k),
sketch as (select d.record_id, coalesce((select sum(case when v > 0 then case when k = 63 then -9223372036854775808::hugeint else (1::hugeint << k::int) end else 0 end) from bits b where b.record_id = d.record_id), 0)::bigint as sketch
  from web_documents d where text is not null)"""


@query(f"with {_SKETCH} select record_id, sketch from sketch")
def simhash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.sketches(read(spark, d, "web_documents").where(F.col("text").isNotNull()), "record_id")


@query(f"""with {_SKETCH}, s as (select distinct sketch from sketch)
select a.sketch as a, b.sketch as b, bit_count(xor(a.sketch, b.sketch))::int as distance from s a, s b where a.sketch < b.sketch and bit_count(xor(a.sketch, b.sketch)) <= 3""")
def near_sketches(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_sketches(dedup.sketches(read(spark, d, "web_documents").where(F.col("text").isNotNull()), "record_id"))


def _flip(steps: int, count: int) -> str:
    return " | ".join(f"(1::bigint << ((record_id * 7 + {steps * 9 * j}) % 63)::int)" for j in range(count))


@query(f"""with {_SKETCH}, planted as (select sketch from sketch union {' union '.join(f"select xor(sketch, {_flip(1, n)}) from sketch" for n in (1, 2, 3, 4))})
select a.sketch as a, b.sketch as b, bit_count(xor(a.sketch, b.sketch))::int as distance from planted a, planted b where a.sketch < b.sketch and bit_count(xor(a.sketch, b.sketch)) <= 3""")
def near_sketches_planted(spark: SparkSession, d: str) -> DataFrame:
    """Near sketches among the tables' own and copies of all of them with one to four bits turned."""
    own = cut(dedup.sketches(read(spark, d, "web_documents").where(F.col("text").isNotNull()), "record_id"))
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("record_id") * 7 + 9 * j) % 63).cast("int"))
    planted = own.select("sketch")
    for n in (1, 2, 3, 4):
        mask = bit(0)
        for j in range(1, n):
            mask = mask.bitwiseOR(bit(j))
        planted = planted.unionByName(own.select(F.col("sketch").bitwiseXOR(mask).alias("sketch")))
    return dedup.near_sketches(planted)


@query("""
select doc_id, min(doc_id) over w as class_id, count(*) over w as copies from documents where text is not null window w as (partition by text)""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_classes(read(spark, d, "documents"), "doc_id")


_PER_SPLIT = f"""
f as (select distinct record_id, partition_name as s, unnest({_fragments(_unix('text'))}) as q from web_documents where text is not null and partition_name is not null)"""


@query(f"with {_PER_SPLIT} select sha256(q) as fragment_sha, count(distinct s) as splits, count(*) as rows from f group by q having count(distinct s) > 1")
def cross_split_fragments(spark: SparkSession, d: str) -> DataFrame:
    return dedup.shared_fragments(read(spark, d, "web_documents"), "partition_name")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.with_split(quality.web_reasons(read(spark, d, "web_documents"), language=False), F.col("host"))
    return rows.withColumn("page", urls.without_fragment(F.col("url")))


# Row by row: what the accepted rows have (pages, texts, sketches, pairs of fragment and split), and the reason of each row.
_ACCEPT = f"""
cand as materialized (select w.record_id, {_split('host')} as split, regexp_replace(url, '#.*$', '') as page, t, {_text_reason('t')} as bad, host from
  (select *, {_HOST} as host, {_trim(_unix('text'))} as t from web_documents) w),
rule as materialized (select record_id, split, page, t, coalesce(case when t is null then 'length' else bad end, case when host is null then 'invalid_url' end) as reason from cand),
{_SKETCH.replace("web_documents", "(select record_id, t as text from rule where reason is null)")},
good as materialized (select row_number() over (order by record_id) as k, record_id, split, 'u' || page as u, 't' || sha256(t) as x, sketch, list_distinct(list_transform({_fragments('t')}, lambda f: hash(f))) as f
  from rule join sketch using (record_id) where reason is null),
near as materialized (select a.k, list(b.k) as earlier from good a join good b on b.k < a.k and bit_count(xor(a.sketch, b.sketch)) <= 3 group by a.k),
hot as (select g from (select split, unnest(f) as g from good) group by g having count(distinct split) > 1),
slim as (select k, list(g) as f from (select k, unnest(f) as g from good) join hot using (g) group by k),
one as materialized (select good.* exclude (f), coalesce(earlier, []) as earlier, coalesce(slim.f, []) as f, slim.f is not null as any_f from good left join near using (k) left join slim using (k)),
step as (
  select 0::bigint as k, []::varchar[] as keys, []::bigint[] as kept, []::ubigint[] as ftrain, []::ubigint[] as fvalidation, []::ubigint[] as ftest, null::varchar as reason, null::bigint as record_id
  union all
  select k, case when r is null then keys || [u, x] else keys end, case when r is null then list_append(kept, k) else kept end,
    case when r is null and split = 'train' then list_concat(ftrain, f) else ftrain end, case when r is null and split = 'validation' then list_concat(fvalidation, f) else fvalidation end,
    case when r is null and split = 'test' then list_concat(ftest, f) else ftest end, r, record_id
  from (select o.*, s.* exclude (k, reason, record_id), case when list_contains(keys, u) or list_contains(keys, x) then 'exact_duplicate' when list_has_any(kept, earlier) then 'near_duplicate_simhash'
      when (o.split <> 'train' and list_has_any(ftrain, o.f)) or (o.split <> 'validation' and list_has_any(fvalidation, o.f)) or (o.split <> 'test' and list_has_any(ftest, o.f)) then 'cross_partition_fragment' end as r
    from step s join one o on o.k = s.k + 1)),
told as (select rule.record_id, rule.split, coalesce(rule.reason, step.reason) as reason, t from rule left join step on step.record_id = rule.record_id)"""


def _accept_rounds(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d)
    told = dedup.accept(rows.where(F.col("reason").isNull()), "record_id", url="page", one_task=0)
    return rows.join(told.select(F.col("pos").alias("record_id"), F.col("reason").alias("dropped")), "record_id", "left").select("record_id", "split", F.coalesce("reason", "dropped").alias("reason"))


@query(f"with recursive {_ACCEPT} select record_id, split, reason from told")
def dedup_accept_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same as dedup_accept by rounds of aggregations, as beyond what one task may hold."""
    return _accept_rounds(spark, d)


@query(f"with recursive {_ACCEPT} select record_id, split, reason from told")
def dedup_accept(spark: SparkSession, d: str) -> DataFrame:
    """Reason of each row of the import: of quality, else of the greedy choice."""
    rows = _candidates(spark, d)
    told = dedup.accept(rows.where(F.col("reason").isNull()), "record_id", url="page").withColumnRenamed("reason", "dropped")
    joined = rows.join(told.withColumnRenamed("pos", "record_id").hint("merge"), "record_id", "left")
    return joined.select("record_id", "split", F.coalesce("reason", "dropped").alias("reason"))


@query(f"""with recursive {_ACCEPT},
sized as (select record_id, reason is null as accepted, coalesce(strlen(t), 0) + 8 as size from told where reason is null or reason in {dedup.REASONS}),
run as (select *, coalesce(sum(case when accepted then size else 0 end) over (order by record_id rows between unbounded preceding and 1 preceding), 0) + size > 2000000 as over from sized),
first as (select min(record_id) as stop from run where over)
select accepted, count(*) as rows, sum(size)::bigint as bytes from run, first where stop is null or record_id < stop group by accepted""")
def budget_cut(spark: SparkSession, d: str) -> DataFrame:
    """The rows that an import of two million bytes takes in or rejects."""
    rows = dedup_accept(spark, d).join(read(spark, d, "web_documents").select("record_id", F.octet_length(tx.normalized(F.col("text"))).alias("n")).hint("merge"), "record_id")
    passing = rows.where(F.coalesce("reason", F.lit("")).isin("", *dedup.REASONS)).withColumn("size", F.coalesce("n", F.lit(0)) + len(tx.END) + 1).withColumn("accepted", F.col("reason").isNull())
    return dedup.within_budget(passing, "record_id", "size", "accepted", 2_000_000).groupBy("accepted").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


# --- curation --------------------------------------------------------------------------------------------------------


def _clean_sql(source: str, reserved: str) -> str:
    gone = f"lambda x: {_significant(_trim('x'))} and list_contains(hit, sha256({_trim('x')}))"
    keep = f"lambda x: not ({_significant(_trim('x'))} and list_contains(hit, sha256({_trim('x')})))"
    blocks = f"list_filter({_blocks('t')}, {keep})"
    pieces = f"list_concat({_blocks('t')}, flatten(list_transform({_blocks('t')}, lambda b: {_lines('b')})))"
    return f"""(select record_id, array_to_string(list_filter(list_transform({blocks}, lambda b: array_to_string(list_filter({_lines('b')}, {keep}), chr(10))), lambda b: {_trim('b')} <> ''), chr(10) || chr(10)) as text,
    (len(list_filter({_blocks('t')}, {gone})) + list_sum(list_transform({blocks}, lambda b: len(list_filter({_lines('b')}, {gone})))))::int as removed
  from (select record_id, {_unix('text')} as t, coalesce((select list(sha) from {reserved} where list_contains(list_transform({pieces.replace("string_split(t,", "string_split(" + _unix('text') + ",")}, lambda x: sha256({_trim('x')})), sha)), []) as hit from {source}))"""


_CURATE = f"""
part as (select record_id, partition_name as split, text from web_documents where text is not null and partition_name is not null),
r0 as (select distinct sha256(q) as sha from (select unnest({_fragments('text')}) as q from part where split = 'test')),
v as (select * from {_clean_sql("(select * from part where split = 'validation')", 'r0')}),
r1 as (select sha from r0 union select sha256(q) from (select unnest({_fragments('text')}) as q from v)),
t as (select * from {_clean_sql("(select * from part where split = 'train')", 'r1')})"""


@query(f"""with {_CURATE}
select record_id, 'test' as split, sha256(text) as sha, 0 as removed from part where split = 'test'
union all select record_id, 'validation', sha256(text), coalesce(removed, 0) from v union all select record_id, 'train', sha256(text), coalesce(removed, 0) from t""")
def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "web_documents").where(F.col("text").isNotNull())
    return curation.curate(rows, "record_id", split="partition_name").select("record_id", "split", hashing.sha(F.col("text")).alias("sha"), "removed")


@query(f"""
with f as (select distinct partition_name as s, unnest({_fragments(_unix('text'), True)}) as q from web_documents where text is not null and partition_name is not null)
select 'fragment' as kind, sha256(q) as sha, count(*) as splits from f group by q having count(*) > 1
union all select 'text', sha256(t), count(distinct s) from (select {_unix('text')} as t, partition_name as s from web_documents where text is not null and partition_name is not null)
group by t having count(distinct s) > 1""")
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    return curation.leaks(read(spark, d, "web_documents"), split="partition_name")


# --- library ---------------------------------------------------------------------------------------------------------

_LATEST = "(select * from articles qualify row_number() over (partition by language, id order by revision_id desc, record_id) = 1)"


@query(f"select language, id, revision_id, record_id from {_LATEST}")
def latest_revisions(spark: SparkSession, d: str) -> DataFrame:
    return library.latest(read(spark, d, "articles")).select("language", "id", "revision_id", "record_id")


def _set(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""
select record_id, score from (select *, (coalesce(len(list_intersect({_set("substring(title, 1, 512)")}, q)), 0) * 6 + coalesce(len(list_intersect({_set("substring(text, 1, 100000)")}, q)), 0))::int as score
  from {_LATEST}, (select {_set("'" + QUESTION + "'")} as q)) where score > 0 order by score desc, title, language, id limit 20""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return library.search(library.latest(read(spark, d, "articles")), QUESTION, 20).select("record_id", "score")


@query(f"""
select {_split("(language || ':' || id)")} as split, count(*) as articles, sum(strlen(doc))::bigint as bytes, sum(length(doc))::bigint as chars, sum(length(doc)) > 128 as ready
from (select *, '# ' || title || chr(10) || chr(10) || text || chr(10) || chr(10) as doc from (select * from articles where {_ARTICLE_PROBLEM} is null)
  qualify row_number() over (partition by language, id order by revision_id desc, record_id) = 1) group by 1""")
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    return library.export_summary(read(spark, d, "articles"))


@query(f"""
with recursive good as (select row_number() over (order by record_id) as k, record_id, sha256(text) as t, sha256(language || ':' || id) as i, revision_id as r from articles where {_ARTICLE_PROBLEM} is null),
step as (select 0::bigint as k, []::varchar[] as had, false as stands union all
  select good.k, case when new then had || [t, i || r] else had end, new from (select s.k, s.had, not list_has_any(had, [g.t, g.i || g.r]) as new from step s join good g on g.k = s.k + 1) s join good on good.k = s.k + 1)
select record_id, i as identity_sha256, t as text_sha256 from good join step using (k) where stands""")
def library_insert(spark: SparkSession, d: str) -> DataFrame:
    """Articles that the library takes in one by one, in the order of record_id."""
    rows = quality.article_problem(read(spark, d, "articles")).where("problem is null")
    keyed = rows.select("record_id", hashing.sha(F.col("text")).alias("text_sha256"), hashing.sha(hashing.article_key(F.col("language"), F.col("id"))).alias("identity_sha256"), F.struct("revision_id").alias("article"))
    return library.insert_exactly(keyed, "record_id").select("record_id", "identity_sha256", "text_sha256")


# --- mixes -----------------------------------------------------------------------------------------------------------

PERCENTAGES, MIX_BYTES, SEED = {"french": 70, "english": 15, "code": 15}, 400_000, 42


def _pool(spark: SparkSession, d: str) -> DataFrame:
    domains = read(spark, d, "sources").select(F.col("source_id").alias("source"), "domain")
    rows = read(spark, d, "documents").join(F.broadcast(domains), "source").where(F.col("domain").isin(*PERCENTAGES))  # the fixed table of sources
    return mix.fragments(rows, "doc_id", "text", keep=("domain",))


_SIZED = """
have as (select domain, sum(strlen(text))::bigint as available from documents d join sources s on d.source = s.source_id where domain in ('french', 'english', 'code') and text is not null group by domain),
share as (select * from (values ('french', 70), ('english', 15), ('code', 15)) v(domain, percentage)),
both_ as (select share.domain, percentage, coalesce(available, 0) as available from share left join have using (domain)),
sized as (select *, least((400000 - (40 + (400000 + 4092) // 4093 + 3))::bigint, (select min(available * 100 // percentage) from both_)) as effective from both_)"""


@query(f"with {_SIZED} select domain, percentage, available, effective, effective * percentage // 100 as target from sized")
def mix_sizing(spark: SparkSession, d: str) -> DataFrame:
    return mix.sizing(_pool(spark, d), PERCENTAGES, MIX_BYTES, 40)


@query(f"""with recursive {_SIZED}, {_CHUNKS.format('domain,', 'documents join sources on source = source_id')},
hashed as (select *, sha256('{SEED}:' || doc_id || ':' || "offset") as h from piece join (select domain, effective * percentage // 100 as target from sized) using (domain)),
run as (select *, coalesce(sum(bytes) over (partition by domain order by h rows between unbounded preceding and 1 preceding), 0) as before from hashed)
select doc_id, domain, "offset", least(bytes, target - before)::bigint as taken from run where before < target""")
def mix_selection(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    return mix.select(pool, mix.sizing(pool, PERCENTAGES, MIX_BYTES, 40), SEED, "doc_id").select("doc_id", "domain", "offset", "taken")


@query(f"with {_SIZED} select domain, effective * percentage // 100 as bytes from sized")
def mix_retained(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    return mix.retained(mix.select(pool, mix.sizing(pool, PERCENTAGES, MIX_BYTES, 40), SEED, "doc_id")).select("domain", "bytes")


@query("""
with size as (select (select sum(strlen(question) + 1) from dialogue_examples) as w, (select sum(strlen(title) + 1) from articles) as o)
select 'web' as part, 1 as repeat, count(*) as rows from dialogue_examples union all
select 'old', unnest(range(1, greatest(1, ceil(w / o)::int) + 1))::int, (select count(*) from articles) from size""")
def rehearsal_mix(spark: SparkSession, d: str) -> DataFrame:
    web = read(spark, d, "dialogue_examples").select(F.col("question").alias("text"))
    old = read(spark, d, "articles").select(F.col("title").alias("text"))
    return mix.rehearsal(web, old).groupBy("part", "repeat").agg(F.count(F.lit(1)).alias("rows"))


# --- tokens ----------------------------------------------------------------------------------------------------------

_BYTES = "strlen(text) - 7 * ((length(text) - length(replace(text, '<|user|>', ''))) // 8) - 12 * ((length(text) - length(replace(text, '<|assistant|>', ''))) // 13) - 6 * ((length(text) - length(replace(text, '<|end|>', ''))) // 7)"


@query(f"""
select lang as domain, grouping(lang)::int as total, count(*) as samples, sum(strlen(text))::bigint as bytes, sum(length(text))::bigint as chars, sum({_BYTES})::bigint as tokens,
  count(*) as exact, null::bigint as unknown, sum(strlen(text)) / sum({_BYTES}) as bytes_per_token, sum({_BYTES}) / sum(length(text)) as tokens_per_char
from documents where text is not null group by rollup (lang)""")
def byte_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = audit.measured(read(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("domain")), audit.byte_codec, "doc_id", keep=("domain",))
    out = audit.report(rows)
    return out.withColumn("total", F.col("total").cast("int"))


@query("""
with a as (select topic as domain, grouping(topic)::int as total, sum(length(answer))::bigint as tokens from dialogue_examples where answer is not null group by rollup (topic)),
b as (select topic as domain, grouping(topic)::int as total, sum(strlen(answer))::bigint as tokens from dialogue_examples where answer is not null group by rollup (topic))
select a.domain, a.total, a.tokens, b.tokens as baseline_tokens, a.tokens - b.tokens as difference, a.tokens / b.tokens as ratio
from a left join b on a.domain is not distinct from b.domain and a.total = b.total""")
def audit_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A tokenizer of one token a character against the byte vocabulary."""
    rows = audit.byte_measured(read(spark, d, "dialogue_examples").select("example_id", F.col("answer").alias("text"), F.col("topic").alias("domain")), "example_id", keep=("domain",))
    chars = audit.report(rows.withColumn("tokens", F.col("chars")))
    return audit.compared(chars, audit.report(rows)).withColumn("total", F.col("total").cast("int"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "articles").where(F.col("partition_name").isNotNull()).select("record_id", "partition_name", "text")
    placed = shards.positions(rows.withColumn("n", shards.document_size()), "partition_name", "record_id", F.col("n"))
    return shards.document_ids(placed)


_LEN = f"(strlen(replace(replace(replace({_trim(_unix("coalesce(text, '')"))}, '<|user|>', 'u'), '<|assistant|>', 'a'), '<|end|>', 'e')) + 2)"
_START = f"select record_id, partition_name, {_LEN}::int as n, coalesce(sum({_LEN}) over (partition by partition_name order by record_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from articles where partition_name is not null"


@query(_START)
def token_positions(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d).select("record_id", "partition_name", "n", "start")


def _hex(x: str) -> str:
    return f"hex(encode({x}))"


_WHOLE = f"{_trim(_unix("coalesce(text, '')"))}"


# Bytes as "3C 7C ", in which the markers are found at bytes' bounds only.
_PAIRED = f"regexp_replace({_hex('t')}, '(..)', '\\1 ', 'g')"
for _id, _marker in enumerate(tx.MARKERS):
    _PAIRED = f"replace({_PAIRED}, '{_marker.encode().hex(' ').upper()} ', '#{_id} ')"


_TOKENS = f"""
i as (select split, start, list_concat(list_transform(list_filter(string_split({_PAIRED}, ' '), lambda x: x <> ''), lambda x: case when x[1] = '#' then x[2]::int else ('0x' || x)::int + 3 end), [2, 13]) as ids from d),
t as (select split, start + unnest(range(len(ids))) as pos, unnest(ids) as token from i)"""


def _shards(spark: SparkSession, d: str) -> DataFrame:
    return shards.shards(_stream(spark, d), "partition_name", SHARD_TOKENS)


@query(f"""
with total as (select partition_name as split, sum(n)::bigint as n from ({_START}) group by 1),
s as (select split, n, unnest(range((n + {SHARD_TOKENS - 1}) // {SHARD_TOKENS})) as shard from total)
select split, shard::bigint as shard, printf('%s/shard-%06d.u32', split, shard) as name, least({SHARD_TOKENS}, n - shard * {SHARD_TOKENS})::bigint as tokens, (least({SHARD_TOKENS}, n - shard * {SHARD_TOKENS}) * 4)::bigint as bytes from s""")
def shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    return shards.manifest(_shards(spark, d)).select("split", "shard", "name", "tokens", "bytes")


@query("select null::varchar as split, null::varchar as problem where false")
def shard_problems(spark: SparkSession, d: str) -> DataFrame:
    return shards.manifest_problems(shards.manifest(_shards(spark, d)), SHARD_TOKENS)


# Every third shard misnamed, the last shard of each split with a wrong size in bytes, train's first shard left out, and validation gone.
_BROKEN = """
select split, shard, case when shard % 3 = 2 then 'x' else name end as name, tokens, case when shard = top then bytes + 1 else bytes end as bytes
from (select *, max(shard) over (partition by split) as top from m) where split <> 'validation' and not (split = 'train' and shard = 0)"""


@query(f"""
with total as (select partition_name as split, sum(n)::bigint as n from ({_START}) group by 1),
s as (select split, n, unnest(range((n + {SHARD_TOKENS - 1}) // {SHARD_TOKENS})) as shard from total),
m as (select split, shard, printf('%s/shard-%06d.u32', split, shard) as name, least({SHARD_TOKENS}, n - shard * {SHARD_TOKENS}) as tokens, least({SHARD_TOKENS}, n - shard * {SHARD_TOKENS}) * 4 as bytes from s),
b as ({_BROKEN}), r as (select *, row_number() over (partition by split order by shard) - 1 as row, max(shard) over (partition by split) as top from b)
select distinct split, problem from (
  select unnest(['train', 'validation', 'test']) as split, 'missing' as problem except select split, 'missing' from b
  union all select split, 'numbering' from r where shard <> row union all select split, 'name' from r where name <> printf('%s/shard-%06d.u32', split, shard)
  union all select split, 'bytes' from r where bytes <> tokens * 4 union all select split, 'size' from r where tokens <= 0 or tokens > {SHARD_TOKENS} or (shard < top and tokens <> {SHARD_TOKENS}))""")
def shard_problems_planted(spark: SparkSession, d: str) -> DataFrame:
    """The problems of a manifest that is wrong in several ways."""
    m = shards.manifest(_shards(spark, d)).withColumn("top", F.max("shard").over(Window.partitionBy("split")))
    m = m.where("split <> 'validation' and not (split = 'train' and shard = 0)")
    m = m.withColumn("name", F.when(F.col("shard") % 3 == 2, "x").otherwise(F.col("name"))).withColumn("bytes", F.when(F.col("shard") == F.col("top"), F.col("bytes") + 1).otherwise(F.col("bytes")))
    return shards.manifest_problems(m.drop("top"), SHARD_TOKENS)


@query(f"""
with s as ({_START}), d as (select s.partition_name as split, s.start, {_WHOLE} as t from s join articles using (record_id)), {_TOKENS}
select token::int as id, count(*) as occurrences from t where token >= 103 group by token""")
def unknown_tokens_planted(spark: SparkSession, d: str) -> DataFrame:
    """Ids beyond the first 103, were the vocabulary no larger."""
    return shards.unknown_ids(_shards(spark, d), spark.range(103).select(F.col("id").cast("int").alias("id")))


@query("select null::int as id, null::bigint as occurrences where false")
def unknown_tokens(spark: SparkSession, d: str) -> DataFrame:
    return shards.unknown_ids(_shards(spark, d), spark.range(259).select(F.col("id").cast("int").alias("id")))


@query(f"""
with recursive s as ({_START}), d as (select s.partition_name as split, s.start, {_WHOLE} as t from s join articles using (record_id)), {_TOKENS},
p as (select 0 as e, 1::hugeint as f union all select e + 1, f * 31 % 18446744073709551616::hugeint from p where e + 1 < {SHARD_TOKENS}),
c as (select split, pos // {SHARD_TOKENS} as shard, pos, token, max(pos) over (partition by split, pos // {SHARD_TOKENS}) as top from t),
m as (select split, shard, (sum(token * f) % 18446744073709551616::hugeint)::hugeint as checksum from c join p on e = top - pos group by split, shard)
select split, sha256(string_agg(shard || ':' || checksum, ',' order by shard)) as fingerprint from m group by split""")
def stream_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return integrity.fingerprint(shards.manifest(_shards(spark, d)))


@query(f"""
with s as ({_START}), one as (select s.partition_name as split, s.start + 3 as start, 9 as len, {_WHOLE} as t, n from s join articles using (record_id) where n > 40)
select split, start::bigint as start, len::bigint as len, list_transform(range(4, 13), lambda i: ('0x' || substr({_hex('t')}, (2 * i - 1)::int, 2))::int + 3)::int[] as tokens from one""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Nine tokens from the third byte on of each article of more than 40 tokens."""
    at = _stream(spark, d).where(F.col("n") > 40)
    wanted = at.select(F.col("partition_name").alias("split"), (F.col("start") + 3).alias("start"), F.lit(9).cast("long").alias("len"))
    return shards.windows(_shards(spark, d), wanted, SHARD_TOKENS)


SEQUENCE = 1024
@query(f"""
with s as ({_START}), d as (select s.partition_name as split, s.start, {_WHOLE} as t from s join articles using (record_id)),
{_TOKENS},
w as (select split, pos // {SEQUENCE} as k, pos, token from t union all select split, pos // {SEQUENCE} - 1, pos, token from t where pos > 0 and pos % {SEQUENCE} = 0)
select split, (k * {SEQUENCE})::bigint as start, count(*)::bigint as len, list(token order by pos)::int[] as tokens from w group by split, k having count(*) = {SEQUENCE + 1}""")
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    """A sequence and the token behind it at each multiple of the sequence, over the whole stream of each split."""
    stream = _stream(spark, d)
    ends = stream.groupBy(F.col("partition_name").alias("split")).agg(F.max(F.col("start") + F.col("n")).alias("end")).where(F.col("end") > SEQUENCE)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - SEQUENCE - 1, F.lit(SEQUENCE).cast("long")))
    wanted = ends.select("split", starts.alias("start"), F.lit(SEQUENCE + 1).cast("long").alias("len"))
    return shards.windows(shards.shards(stream, "partition_name", SHARD_TOKENS), wanted, SHARD_TOKENS)


@query("""
with t as (select 1453862 as n, 1024 as seq, 256 as k) select i, (i * (n - seq - 1) // (k - 1))::bigint as start from t, range(256) r(i)""")
def evaluation_starts(spark: SparkSession, d: str) -> DataFrame:
    return shards.evaluation_starts(spark, 1_453_862, 1024, 256)


# splitmix64 in numbers of 128 bits: products are taken in two halves.
_M64 = "18446744073709551616::hugeint"


def _times(x: str, y: int) -> str:
    return f"((({x}) * {y & 0xFFFFFFFF}::hugeint) % {_M64} + ((({x}) * {y >> 32}::hugeint) % 4294967296::hugeint) * 4294967296::hugeint) % {_M64}"


@query(f"""
with i as (select i, {SEED}::hugeint as seed from range(1600) r(i)), a as (select i, (seed + {_times('i::hugeint', 0x9E3779B97F4A7C15)} + {0x9E3779B97F4A7C15}::hugeint) % {_M64} as x from i),
b as (select i, {_times('xor(x, x >> 30)', 0xBF58476D1CE4E5B9)} as x from a), c as (select i, {_times('xor(x, x >> 27)', 0x94D049BB133111EB)} as x from b)
select (i // 8)::bigint as step, (i % 8)::bigint as row, (xor(x, x >> 31) % (1453862 - 1024))::bigint as start from c""")
def training_starts(spark: SparkSession, d: str) -> DataFrame:
    return shards.training_starts(spark, 1_453_862, 1024, 8, 200, SEED)


@query("""
with recursive c(example_id, k, v, ids) as (
  select example_id, 0, 0::hugeint, list_transform(range(1, strlen(question) + 1), lambda i: ('0x' || substr(hex(encode(question)), (2 * i - 1)::int, 2))::int + 3) from dialogue_examples where question is not null
  union all select example_id, k + 1, (v * 31 + ids[k + 1]) % 18446744073709551616::hugeint, ids from c where k < len(ids))
select example_id, v::decimal(20, 0) as checksum from c where k = len(ids)""")
def token_checksums(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "dialogue_examples").where(F.col("question").isNotNull())
    return rows.select("example_id", hashing.checksum(shards.byte_ids(F.col("question"))).alias("checksum"))


# --- dialogues, decoding, training -----------------------------------------------------------------------------------


@query(f"""
select example_id, '<|user|>' || {_trim('question')} || '<|assistant|>' || {_trim('answer')} || '<|end|>' || chr(10) as rendered from dialogue_examples""")
def rendered_dialogues(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "dialogue_examples").select("example_id", dialogue.rendered(F.col("question"), F.col("answer")).alias("rendered"))


@query(f"""
select example_id, (strlen(q) + 1)::int as assistant, (strlen(q) + strlen(a) + 3)::int as n, (strlen(a) + 1)::int as targets,
  case when strlen(q) + strlen(a) + 3 not between 5 and 257 then 'length' when strlen(q) < 1 then 'question' when strlen(a) < 1 then 'answer' end as problem
from (select example_id, {_trim('question')} as q, {_trim('answer')} as a from dialogue_examples
  where question is not null and answer is not null and not {_reserved('question', False)} and not {_reserved('answer', False)})""")
def encoded_dialogues(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.dialogue_problem(read(spark, d, "dialogue_examples")).where("question is not null and answer is not null and coalesce(problem, '') <> 'reserved_marker'")
    made = dialogue.exchanges(rows)
    targets, _ = dialogue.supervised(F.col("ids"), F.col("assistant"))
    return made.select("example_id", "assistant", F.size("ids").alias("n"), F.size(targets).alias("targets"), dialogue.exchange_problem(F.col("ids"), 256).alias("problem"))


def _logits(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("context"), F.posexplode("embedding").alias("id", "logit"))
    return rows.withColumn("logit", F.col("logit").cast("double") * 10)


_LOGITS = """
l as (select vec_id as context, i - 1 as id, embedding[i]::double * 10 as logit from embeddings, range(1, 4097) r(i) where i <= len(embedding)),
r as (select *, row_number() over (partition by context order by logit desc, id) as rank from l),
k as (select *, exp((logit - max(logit) over (partition by context)) / 0.7) as e from r where rank <= 20),
p as (select *, e / sum(e) over (partition by context) as p from k),
c as (select *, coalesce(sum(p) over (partition by context order by rank rows between unbounded preceding and 1 preceding), 0) as before from p),
dist as (select context, rank::int as rank, id::int as id, p / sum(p) over (partition by context) as probability from c where before < 0.9)"""


@query(f"with {_LOGITS} select context, rank, id, round(probability, 9) as probability from dist")
def next_token_distribution(spark: SparkSession, d: str) -> DataFrame:
    return sampling.distribution(_logits(spark, d), 20, 0.9, 0.7).select("context", "rank", "id", F.round("probability", 9).alias("probability"))


@query(f"""with {_LOGITS}, s as (select *, sum(probability) over (partition by context order by rank) as run from dist)
select context, coalesce(arg_min(id, rank) filter (run > (context * 37 % 100) / 100.0 + 0.005), arg_max(id, rank)) as id from s group by context""")
def drawn_tokens(spark: SparkSession, d: str) -> DataFrame:
    dist = sampling.distribution(_logits(spark, d), 20, 0.9, 0.7)
    draws = read(spark, d, "embeddings").select(F.col("vec_id").alias("context"), (F.col("vec_id") * 37 % 100 / 100.0 + 0.005).alias("draw"))
    return sampling.choose(dist, draws)


@query("""
with l as (select vec_id as context, unnest(range(len(embedding))) as id, unnest(embedding)::double * 10 as logit from embeddings),
h as (select distinct vec_id as context, (vec_id * 31 + j * 17) % len(embedding) as id, true as seen from embeddings, range(6) r(j) where len(embedding) > 0)
select context, id::int as id, round(case when seen is null then logit when logit < 0 then logit * 1.2 else logit / 1.2 end, 9) as logit from l left join h using (context, id)""")
def repetition_penalty_all_ids(spark: SparkSession, d: str) -> DataFrame:
    """The penalty over whole vectors, with up to six ids from all of them in each history."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: ((F.col("vec_id") * 31 + j * 17) % F.size("embedding")).cast("int")))
    history = read(spark, d, "embeddings").where(F.size("embedding") > 0).select(F.col("vec_id").alias("context"), at.alias("id"))
    return sampling.penalised(_logits(spark, d), history, 1.2).select("context", "id", F.round("logit", 9).alias("logit"))


@query("""
with l as (select vec_id as context, unnest(range(len(embedding))) as id, unnest(embedding)::double * 10 as logit from embeddings),
m as (select context, max(logit) as most from l group by context)
select context, round(ln(sum(exp(logit - most))) + any_value(most) - max(case when id = context % 64 then logit end), 9) as loss from l join m using (context) group by context""")
def window_losses(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "embeddings").select(F.col("vec_id").alias("context"), (F.col("vec_id") % 64).cast("int").alias("id"))
    return sampling.target_losses(_logits(spark, d), targets).select("context", F.round("loss", 9).alias("loss"))


@query("""
with g as (select vec_id as context, unnest(range(len(embedding))) as id, unnest(embedding)::double * 10 as value from embeddings),
n as (select sqrt(sum(value * value)) as norm from g)
select context, id::int as id, round(value * (1.0 / (norm + 1e-12)), 9) as value from g, n""")
def gradient_clip(spark: SparkSession, d: str) -> DataFrame:
    """Logits taken for gradients, clipped to a global norm of one."""
    scaled, _ = sampling.clipped(_logits(spark, d).withColumnRenamed("logit", "value"), 1.0)
    return scaled.select("context", "id", F.round("value", 9).alias("value"))


_UNITS = "u as (select example_id::varchar as id, coalesce(topic, 'none') as topic, question as text from dialogue_examples)"


@query(f"""
with {_UNITS}, s as (select case when n = 0 then 'test' when n = 1 then 'validation' else 'train' end as split from (select ('0x' || substr(sha256(id), 1, 2))::int % 10 as n from u)),
bad as (select 'blank' as problem from u where {_blank('id')} or {_blank('text')} union all select 'repeated_id' from u where id is not null group by id having count(*) > 1
  union all select 'repeated_text' from u where text is not null group by text having count(*) > 1
  union all select 'empty_' || split from (select unnest(['train', 'validation', 'test']) as split except select split from s))
select problem, count(*) as rows from bad group by problem""")
def unit_problems(spark: SparkSession, d: str) -> DataFrame:
    return splits.unit_problems(_units(spark, d))


@query(f"""
with {_UNITS} select case when n = 0 then 'test' when n = 1 then 'validation' else 'train' end as split, topic, count(*) as units, sum(strlen(text))::bigint as bytes
from (select *, ('0x' || substr(sha256(id), 1, 2))::int % 10 as n from u) group by all""")
def unit_summary(spark: SparkSession, d: str) -> DataFrame:
    return splits.unit_summary(_units(spark, d))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "dialogue_examples").select(F.col("example_id").cast("string").alias("id"), F.coalesce("topic", F.lit("none")).alias("topic"), F.col("question").alias("text"))


@query("""
with s as (select i as step from range(0, 1001) r(i))
select step::bigint as step, round(case when step < 100 then 0.0003 * step / 100 else 0.0003 * (0.1 + 0.9 * (1 + cos(pi() * least(1.0, (step - 100) / 900.0))) / 2) end, 12) as rate from s""")
def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = training.learning_rate(F.col("id"), 1000, 100, 3e-4, 0.1)
    return spark.range(1001).select(F.col("id").alias("step"), F.round(rate, 12).alias("rate"))


@query("""
with s as (select c_custkey, c_acctbal, lead(c_acctbal) over (order by c_custkey) as next from customer)
select c_custkey, coalesce(next / 1000 + 0.0001 < c_acctbal / 1000 and next <= c_acctbal * 1.02 and next <= 5000 * 1.02, false) as accepted from s where c_acctbal > 0 and (next > 0 or next is null)""")
def promotions(spark: SparkSession, d: str) -> DataFrame:
    """The promotion rule over made-up scores: balances of customers and of those after them."""
    # a self-join by rank instead of a window over the whole table
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("web"))
    after = rows.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("web").alias("next"))
    joined = rows.join(after, "c_custkey", "left").where("web > 0 and (next > 0 or next is null)")
    told = training.accepts(F.lit(5000.0), F.col("web") / 1000, F.col("web"), F.col("next") / 1000, F.col("next"))
    return joined.select("c_custkey", told.alias("accepted"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as events from events group by all")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.event_counts(read(spark, d, "events"))


@query("""
select record_id from (select record_id, row_number() over (partition by text order by record_id) as n from articles where text is not null) where n = 1""")
def first_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "articles").where(F.col("text").isNotNull())
    return rows.groupBy(hashing.sha(F.col("text"))).agg(F.min("record_id").alias("record_id")).select("record_id")


@query("select distinct sha256(text) as text_sha256 from articles where text is not null")
def first_texts_stream(spark: SparkSession, d: str) -> DataFrame:
    """Texts that a stream of articles lets through."""
    source = read(spark, d, "articles")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/articles.parquet*").where(F.col("text").isNotNull())
    return ingest.drained(ingest.first_texts(stream).select("text_sha256"), "first-texts")


@query("""
select date_trunc('hour', ts) as start, event_type, count(*) as events from events
where date_trunc('hour', ts) + interval 2 hour <= (select date_trunc('millisecond', max(ts)) from events) group by all""")
def event_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind of a stream, of the hours that its watermark has passed at the end."""
    source = read(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = ingest.drained(ingest.event_counts(stream), "event-counts")
    return counted.withColumn("start", F.col("start").cast(source.schema["ts"].dataType))

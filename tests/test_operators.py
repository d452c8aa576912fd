import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import audit, curation, dedup, dialogue, integrity, library, mix, quality, sampling, shards
from lexiloom.runtime import small_side_join

LONG = "Le moulin de la colline garde encore ses vieilles pierres, et chacun vient y chercher la farine du matin avant la fête. "
WEB = "id long, text string, url string, language string, language_script string, language_score double, extra string"


def web(rows, *items):
    return rows([(i, t, u, "fra", "Latn", s, "x") for i, (t, u, s) in enumerate(items)], WEB)


def test_web_reasons_in_order(rows):
    fine = LONG * 3
    repeated = "\n".join([LONG.strip()] * 6)
    got = quality.web_reasons(
        web(
            rows, (fine, "https://A.fr/x", 0.9), (fine, "https://a.fr", 0.5), (fine, "https://a.fr", float("nan")), ("court", "https://a.fr", 0.9), (fine + "\x01", "https://a.fr", 0.9),
            ("12345 " * 60, "https://a.fr", 0.9), (fine + "<|end|>", "https://a.fr", 0.9), (repeated, "https://a.fr", 0.9), (fine, "ftp://a.fr", 0.9), (None, None, None), (f"\r\n{fine}\r\n", "http://b", 1.0),
        )
    ).orderBy("id").collect()
    assert [r["reason"] for r in got] == [None, "language", "language", "length", "corrupted_characters", "low_text_ratio", "markup_or_reserved_tokens", "repeated_lines", "invalid_url", "language", None]
    assert got[0]["host"] == "a.fr" and got[10]["text"] == fine.strip() and got[0]["extra"] == "x"


def test_quality_of_empty_table(rows):
    assert quality.web_reasons(rows([], WEB)).count() == 0
    assert quality.reject_counts(quality.web_reasons(rows([], WEB))).count() == 0


def test_book_reasons(rows):
    t = LONG * 40
    data = [("90", 600, t), (" 61.5 ", 600, t), ("abc", 600, t), ("1d", 600, t), (None, 600, t), ("-1", 600, t), ("59", 600, t), ("90", 499, t), ("90", None, t), ("90", 600, "court"), ("90", 600, None), ("90", 600, t + "\ufffd"), ("90", 600, t + "<html")]
    got = quality.book_reasons(rows([(i, *x) for i, x in enumerate(data)], "i int, ocr string, word_count long, complete_text string")).orderBy("i").collect()
    assert [r["reason"] for r in got] == [None, None, "ocr_field_invalid", "ocr_field_invalid", "ocr_field_invalid", "low_ocr_score", "low_ocr_score", "too_few_words", "too_few_words", "length", "length", "corrupted_characters", "markup_or_reserved_tokens"]


def test_probes(rows):
    bad = quality.probe_problems(rows([("a", "d", "x"), ("a", " ", "x"), (" b", "d", ""), ("c", "d", "a<|end|>")], "id string, domain string, text string"))
    assert {r["problem"]: r["rows"] for r in bad.collect()} == {"domain": 1, "id": 1, "text": 1, "marker": 1, "duplicate_id": 1, "duplicate_text": 1}
    assert [r["problem"] for r in quality.probe_problems(rows([], "id string, domain string, text string")).collect()] == ["empty"]


def sequential(data):
    """The choice row by row, in plain Python."""
    import hashlib

    def sketch(t):
        w = t.lower().split()
        votes = [0] * 64
        for g in zip(w, w[1:], w[2:]):
            h = int.from_bytes(hashlib.sha256(" ".join(g).encode()).digest()[:8], "little")
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        return sum(1 << b for b in range(64) if votes[b] > 0)

    def parts(t):
        return {s.strip() for s in [*t.split("\n"), *t.split("\n\n")] if len(s.strip()) >= 64 and len(s.split()) >= 8}

    texts, pages, sketches, owner, out = set(), set(), [], {}, {}
    for pos, t, u, s in sorted(data):
        if u in pages or t in texts:
            out[pos] = "exact_duplicate"
        elif any((sketch(t) ^ x).bit_count() <= 3 for x in sketches):
            out[pos] = "near_duplicate_simhash"
        elif any(owner.get(f, s) != s for f in parts(t)):
            out[pos] = "cross_partition_fragment"
        else:
            out[pos] = None
            texts.add(t), pages.add(u), sketches.append(sketch(t))
            owner.update({f: s for f in parts(t)})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_accept_is_the_sequential_choice(rows, seed):
    r = random.Random(seed)
    passages = [" ".join(r.choice("moulin pierre farine colline matin rivière jardin école fête pain".split()) for _ in range(14)) for _ in range(8)]
    data = [(i, "\n".join(r.sample(passages, r.randint(1, 3))) + (f"\n{r.random()}" if r.random() < 0.5 else ""), f"u{r.randint(0, 30)}", r.choice(["train", "validation", "test"])) for i in range(40)]
    df = rows(data, "pos long, text string, url string, split string").repartition(5)
    wanted = sequential(data)
    assert {x["pos"]: x["reason"] for x in dedup.accept(df, "pos").collect()} == wanted
    if not seed:
        assert {x["pos"]: x["reason"] for x in dedup.accept(df, "pos", one_task=0).collect()} == wanted


def test_accept_decides_long_chains(rows):
    # each row shares its page with the one before and its text with the one after
    text = lambda k: " ".join(f"m{(k * 7919 + j * 104729) % 99991}" for j in range(12))
    data = [(i, text(i // 2), f"page {(i + 1) // 2}", "train") for i in range(300)]
    df = rows(data, "pos long, text string, url string, split string").repartition(3)
    wanted = {i: "exact_duplicate" if i % 2 else None for i in range(300)}
    assert {x["pos"]: x["reason"] for x in dedup.accept(df, "pos").collect()} == wanted
    assert {x["pos"]: x["reason"] for x in dedup.accept(df, "pos", most_rounds=2, one_task=1_150).collect()} == wanted


def test_sums_over_positions_as_far_apart_as_hashes(rows):
    data = [(-(2**63), 5), (-(2**62), 6), (0, 7), (2**62, 8), (2**63 - 1, 9)]
    df = rows(data, "pos long, n long").withColumn("ok", F.lit(True)).withColumn("s", F.lit("x"))
    assert [r["pos"] for r in dedup.within_budget(df, "pos", "n", "ok", 20).orderBy("pos").collect()] == [p for p, _ in data[:3]]
    got = {r["pos"]: r["start"] for r in shards.positions(df, "s", "pos", F.col("n")).collect()}
    assert [got[p] for p, _ in data] == [0, 5, 11, 18, 26]


def test_accept_takes_nulls_and_no_rows(rows):
    schema = "pos long, text string, url string, split string"
    assert dedup.accept(rows([], schema), "pos").count() == 0
    got = dedup.accept(rows([(1, None, None, None), (2, None, None, None), (3, "", "u", "train")], schema), "pos").collect()
    assert all(r["reason"] is None for r in got)


def test_near_sketches_are_all_pairs(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 5))) for b in base]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = {(x["a"], x["b"]) for x in dedup.near_sketches(spark.createDataFrame([(v,) for v in signed], "sketch long")).collect()}
    wanted = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == wanted and wanted


def test_budget(rows):
    df = rows([(i, 10, i != 2) for i in range(8)], "pos long, size long, ok boolean")
    got = {r["pos"] for r in dedup.within_budget(df, "pos", "size", "ok", 35, buckets=3).collect()}
    assert got == {0, 1, 2, 3}  # 0, 1, 3 fill 30; 4 would be over, and 2 before the cut stays
    assert dedup.within_budget(df, "pos", "size", "ok", 10**6).count() == 8
    assert dedup.within_budget(df.limit(0), "pos", "size", "ok", 5).count() == 0


def test_curation(rows):
    p = (LONG * 2).strip()
    q = LONG.replace("moulin", "four").strip()
    data = [(1, p, "test"), (2, f"A\r\n\r\n{p}\r\n\r\nB\n{q}", "validation"), (3, f"{q}\n\nC\n{p}\n\n\n\nB\n{q}", "train"), (4, p, "train"), (5, "seul", None), (6, "", "train")]
    got = {r["id"]: (r["text"], r["removed"]) for r in curation.curate(rows(data, "id long, text string, split string"), "id").collect()}
    assert got == {1: (p, 0), 2: (f"A\n\nB\n{q}", 1), 3: ("C", 3), 4: ("", 1), 6: ("", 0)}


def test_leaks(rows):
    data = [(f"x\n{LONG}", "train"), (LONG.strip(), "test"), ("a", "train"), ("a", "test"), ("a", "test"), (None, "test")]
    got = sorted((r["kind"], r["splits"]) for r in curation.leaks(rows(data, "text string, split string")).collect())
    assert got == [("fragment", 2), ("text", 2)]


ARTICLE = "record_id long, id long, revision_id long, title string, url string, language string, text string, license string, fetched_at_unix long"


def article(i, ident, revision, title, text, language="fr"):
    return (i, ident, revision, title, "https://x", language, text, "CC", 1)


def test_library(rows):
    data = [article(1, 1, 1, "Le moulin", "a"), article(2, 1, 2, "Le moulin", "b"), article(3, 2, 1, "Autre", "a"), article(4, 1, 2, "Le moulin", "c"), article(5, 3, 1, " ", "d"), article(6, 4, 1, "Un four", "le moulin et le four")]
    df = rows(data, ARTICLE)
    assert sorted(r["record_id"] for r in library.latest(df).collect()) == [2, 3, 5, 6]
    made = library.stored(df)
    assert made.count() == 5 and library.broken(made.where("article.id <> 1")).count() == 0
    tampered = made.where("article.id = 4").withColumn("article", F.col("article").withField("text", F.lit("faux")))
    assert [r["problem"] for r in library.broken(tampered).collect()] == ["text"]
    with_order = made.withColumn("o", F.struct("article.revision_id", "article.id", "text_sha256"))
    kept = library.new_articles(with_order, made.limit(0), "o").collect()
    assert len(kept) == 3  # page 1 in one text for each revision, page 4; page 2 has a text of page 1
    assert library.new_articles(with_order, made, "o").count() == 0


def test_search(rows):
    df = rows([article(1, 1, 1, "Le moulin", "four"), article(2, 2, 1, "Four", "moulin moulin"), article(3, 3, 1, "Rien", "rien")], ARTICLE)
    assert [(r["record_id"], r["score"]) for r in library.search(df, "MOULIN, four!", 5).collect()] == [(2, 7), (1, 7)]
    assert library.search(df, "moulin", 0).count() == 0
    for query, limit in (("?!", 5), ("a" * 513, 5), ("a", 101)):
        with pytest.raises(ValueError):
            library.search(df, query, limit)


def test_mix(rows, spark):
    assert mix.cut_places("aé🦀".encode(), 4) == [(0, 3), (3, 4)]
    df = rows([(i, "é" * 3000, d) for i, d in enumerate(["french"] * 6 + ["english"] * 2 + ["code"] * 2)] + [(99, None, "code"), (98, "", "code")], "id long, text string, domain string")
    pool = mix.fragments(df, "id", "text", keep=("domain",))
    assert pool.count() == 20 and {r["bytes"] for r in pool.collect()} == {4096, 1904}
    targets = mix.sizing(pool, {"french": 70, "english": 15, "code": 15}, 30_000, 3)
    chosen = mix.select(pool, targets, 42, "id")
    sums = {r["domain"]: r["bytes"] for r in mix.retained(chosen).collect()}
    assert sums == {r["domain"]: r["target"] for r in targets.collect()}
    assert chosen.select("id", "offset").distinct().count() == chosen.count()
    again = sorted(map(tuple, mix.select(pool.repartition(7), targets, 42, "id").select("id", "offset", "taken").collect()))
    assert again == sorted(map(tuple, chosen.select("id", "offset", "taken").collect()))
    assert spark.createDataFrame([("aé", 2)], "t string, n int").select(mix.clipped("t", "n")).first()[0] == "a"


def test_mix_config():
    source = {"id": "a", "domain": "french", "partition": "train", "file": "x/train.txt", "sha256": "0" * 64}
    config = {"max_text_bytes": 1000, "percentages": [70, 15, 15], "sources": [source]}
    assert mix.config_problems(config) == []
    assert mix.config_problems({**config, "percentages": [70, 15, 16], "max_text_bytes": 1, "sources": [source | {"file": "test.txt"}, source]}) == ["max_text_bytes", "percentages", "sources", "partition of a"]


def test_rehearsal(rows):
    got = mix.rehearsal(rows([("x" * 99,)], "text string"), rows([("y" * 29,)], "text string")).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in got} == {"web": 1, "old": 4}


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_chains_are_inserted_whole(rows, monkeypatch, one_task):
    monkeypatch.setattr(library, "ONE_TASK", one_task, raising=False)
    # row i has its text with row i - 1 and its revision with row i + 1, or the other way round, so every second one stands
    chain = [(i, f"t{i // 2}", "a", ((i + 1) // 2,)) for i in range(16)] + [(99, "t99", "b", (1,))]
    fresh = rows(chain, "o long, text_sha256 string, identity_sha256 string, article struct<revision_id:int>")
    assert sorted(r["o"] for r in library.insert_exactly(fresh, "o", rounds=2).collect()) == [*range(0, 16, 2), 99]


@pytest.mark.parametrize("size", [13, 1000])
def test_shards_and_windows(rows, spark, size):
    texts = ["un deux", "", None, "é🦀", "<|user|>a<|assistant|>b", "x" * 40]
    df = rows([(i, t, "train" if i % 3 else "test") for i, t in enumerate(texts)], "pos long, text string, split string")
    placed = shards.positions(shards.document_ids(df), "split", "pos", F.size("ids"), buckets=3)
    encode, decode = audit.byte_codec()
    streams = {s: [x for i, t in enumerate(texts) if ("train" if i % 3 else "test") == s for x in encode((t or "").strip() + "<|end|>\n")] for s in ("train", "test")}
    made = shards.shards(placed, "split", size)
    for s, stream in streams.items():
        got = sorted((r["shard"], r["tokens"]) for r in made.where(F.col("split") == s).collect())
        assert [x for _, part in got for x in part] == stream and all(len(p) == size for _, p in got[:-1])
    n = len(streams["train"])
    wanted = [("train", a, b) for a, b in ((0, 8), (2, 0), (n - 5, 5), (5, 30), (n, 0), (n - 2, 9))]
    read = shards.windows(made, spark.createDataFrame(wanted, "split string, start long, len long"), size)
    assert {(r["start"], r["len"]): r["tokens"] for r in read.collect()} == {(a, b): streams["train"][a : a + b] for _, a, b in wanted}
    assert [r["start"] for r in shards.out_of_range(read).collect()] == [n - 2]
    files = shards.manifest(made)
    assert {(r["split"], r["problem"]) for r in shards.manifest_problems(files, size).collect()} == {("validation", "missing")}
    wrong = files.withColumn("bytes", F.col("bytes") + (F.col("shard") == 0).cast("int"))
    assert ("train", "bytes") in {(r["split"], r["problem"]) for r in shards.manifest_problems(wrong, size).collect()}
    assert {r["id"] for r in shards.unknown_ids(made, spark.range(3, 259)).collect()} == {0, 1, 2}


def test_sequence_windows_cover_the_streams(rows, spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["un deux <|user|>é<|end|>" * 5000, "x" * 1022, "", None, "y" * 1023, "z" * 9]
    splits = ["train", "test", "train", "train", "validation", None]
    data = [(i, s, t) for i, (s, t) in enumerate(zip(splits, texts))]
    rows(data, "record_id long, partition_name string, text string").write.parquet(f"{tmp_path}/articles.parquet")
    encode, _ = audit.byte_codec()
    streams = {s: [x for z, t in zip(splits, texts) if z == s for x in encode((t or "").strip() + "<|end|>\n")] for s in ("train", "test", "validation")}
    got = {(r["split"], r["start"]): r["tokens"] for r in entry.queries()["sequence_windows"](spark, str(tmp_path)).collect()}
    assert got == {(s, a): x[a : a + 1025] for s, x in streams.items() for a in range(0, len(x) - 1024, 1024)}
    assert len(streams["test"]) == 1024 and ("validation", 0) in got and any(a // 50_000 != (a + 1024) // 50_000 for _, a in got)


def test_starts(spark):
    assert [r["start"] for r in shards.evaluation_starts(spark, 20, 9, 3).orderBy("i").collect()] == [0, 5, 10]
    assert shards.evaluation_starts(spark, 10, 9, 3).count() == 1
    with pytest.raises(ValueError):
        shards.evaluation_starts(spark, 9, 9, 3)
    starts = [r["start"] for r in shards.training_starts(spark, 1000, 10, 4, 50, 7).collect()]
    assert starts == [r["start"] for r in shards.training_starts(spark, 1000, 10, 4, 50, 7).collect()] and 0 <= min(starts) and max(starts) < 990 and len(set(starts)) > 100


def test_dialogue(rows):
    df = rows([(1, "  q ", " a\n", "x"), (2, "é", "", "x"), (3, None, "a", "x")], "id long, question string, answer string, ids string").drop("ids")
    got = {r["id"]: r for r in dialogue.exchanges(df).collect()}
    encode, _ = audit.byte_codec()
    assert got[1]["ids"] == encode("<|user|>q<|assistant|>a<|end|>") and got[1]["assistant"] == 2 and got[3]["ids"] is None
    problems = {r["id"]: r["p"] for r in dialogue.exchanges(df).select("id", dialogue.exchange_problem(F.col("ids"), 20).alias("p")).collect()}
    assert problems == {1: None, 2: "answer", 3: "length"}
    one = dialogue.batch(rows([(1, [0, 10, 11, 1, 20, 21, 2], 3), (2, [0, 12, 1, 22, 2], 2)], "o int, ids array<int>, assistant int"), "o").first()
    assert one["target"] == [20, 21, 2, 22, 2] and one["places"] == [3, 4, 5, 8, 9] and one["input"] == [[0, 10, 11, 1, 20, 21], [0, 12, 1, 22, 2, 2]]


def test_sampling(rows):
    logits = rows([(0, i, x) for i, x in enumerate([1.0, 3.0, 2.0])], "context int, id int, logit double")
    ids = lambda **k: [(r["id"], round(r["probability"], 6)) for r in sampling.distribution(logits, **k).orderBy("rank").collect()]
    assert [i for i, _ in ids(top_k=2, top_p=0.9, temperature=1.0)] == [1, 2]
    assert ids(top_k=2, top_p=0.1, temperature=1.0) == [(1, 1.0)] and ids(top_k=2, top_p=0.9, temperature=0.0) == [(1, 1.0)]
    two = rows([(0, 0, 2.0), (0, 1, 3.0)], "context int, id int, logit double")
    bent = sampling.penalised(two, rows([(0, 1)], "context int, id int"), 2.0)
    assert [r["id"] for r in sampling.distribution(bent, 2, 0.1, 1.0).collect()] == [0]
    dist = sampling.distribution(logits, 3, 1.0, 1.0)
    draw = lambda x: sampling.choose(dist, rows([(0, x)], "context int, draw double")).first()["id"]
    assert (draw(0.0), draw(0.7), draw(0.999999)) == (1, 2, 0)
    assert [r["id"] for r in sampling.strongest(logits, 1, end=0).orderBy("rank").collect()] == [1, 0]


def test_penalty_query_covers_all_ids(spark, tmp_path):
    import __spark_entry__ as entry

    vectors = [(c, [(-1.0) ** i * (i + 1) for i in range(64)]) for c in (0, 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["context"], r["id"]): r["logit"] for r in entry.queries()["repetition_penalty_all_ids"](spark, str(tmp_path)).collect()}
    seen = {(c, (c * 31 + j * 17) % 64) for c in (0, 7) for j in range(6)}
    bent = lambda x: x * 1.2 if x < 0 else x / 1.2
    assert got == {(c, i): round(bent(x * 10) if (c, i) in seen else x * 10, 9) for c, v in vectors for i, x in enumerate(v)}


def test_audit(rows):
    df = rows([("a", "x", "aé"), ("b", "x", "<|end|>"), ("c", "y", "🦀\x00"), ("d", "y", None)], "id string, domain string, text string")
    by_bytes = audit.byte_measured(df, "id", keep=("domain",))
    in_python = audit.measured(df, audit.byte_codec, "id", keep=("domain",))
    assert sorted(map(tuple, by_bytes.collect())) == sorted(map(tuple, in_python.collect()))
    total = audit.report(by_bytes).where("total = 1").first()
    assert (total["samples"], total["tokens"], total["bytes"], total["exact"], total["unknown"]) == (3, 9, 15, 3, None)
    compared = audit.compared(audit.report(by_bytes), audit.report(by_bytes)).collect()
    assert len(compared) == 3 and all(r["difference"] == 0 for r in compared)


def test_contained():
    assert integrity.contained("/r", "a/b.txt") == "/r/a/b.txt"
    for bad in ("../x", "/x", "a/../../x", "C:/x", ""):
        with pytest.raises(ValueError):
            integrity.contained("/r", bad)


def test_small_side_join_both_ways(rows):
    big = rows([(i % 3, i) for i in range(60)] + [(None, 99)], "k int, v int")
    small = rows([(0, "a"), (1, "b")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, small_side_join(big, small, ["k"], how).collect()))
        assert a == sorted(map(str, small_side_join(big, small, ["k"], how, rows=0).collect())) and a


def test_audit_query_measures_exactness(rows, spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    encode, decode = audit.byte_codec()
    rows([(1, "é<|end|>", "fr"), (2, "lost", "fr"), (3, None, "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(audit, "byte_codec", lambda: (encode, lambda ids: decode(ids).replace("lost", "")))
    total = entry.queries()["byte_audit"](spark, str(tmp_path)).where("total = 1").first()
    assert (total["samples"], total["exact"]) == (2, 1)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_near_sketches_are_never_broadcast(spark):
    values = spark.range(100).withColumnRenamed("id", "sketch")
    found = dedup.near_sketches(values)
    assert found.count() > 0 and "Broadcast" not in _plan(found)


def test_sketches_are_made_once(rows):
    found = dedup.near_sketches(dedup.sketches(rows([(1, "un deux trois quatre"), (2, None)], "i int, text string"), "i"))
    assert "ArrowEvalPython" not in _plan(found)  # they stand in the checkpoint folder


def test_sizes_dont_grow_with_the_rounds(rows):
    chain = rows([(i, f"un deux {(i + 1) // 2}", f"u{i // 2}", "train") for i in range(12)], "pos long, text string, url string, split string")
    told = dedup.accept(chain, "pos", one_task=0)
    size = told._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size).bit_length() < 2000
    assert [r["pos"] for r in told.where("reason is null").orderBy("pos").collect()] == [0, 2, 4, 6, 8, 10]


def test_accept_joins_near_sketches_once_and_never_broadcasts_them(rows, monkeypatch):
    plans, write = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    data = [(1, "un deux trois quatre", "a", "train"), (2, "un deux trois quatre", "b", "train"), (3, "cinq six sept", "c", "train")]
    told = dedup.accept(rows(data, "pos long, text string, url string, split string"), "pos")
    near = [p for p in plans if "bit_count" in p]
    assert len(near) == 1 and near[0].count("SortMergeJoin") == 1 and "Broadcast" not in near[0]
    assert {r["pos"]: r["reason"] for r in told.collect()} == {1: None, 2: "exact_duplicate", 3: None}


def test_budget_cut_broadcasts_no_sketches(spark, monkeypatch):
    from lexiloom.plans import catalog

    plans, write = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    made = catalog.QUERIES["budget_cut"](spark, "/root/testdata/sf0.001")
    near = [p for p in plans if "bit_count" in p]
    assert near and not any("BroadcastHashJoin" in p for p in near) and made.count() == 2


@pytest.mark.parametrize("one_task", [0, dedup.ONE_TASK])
def test_accept_broadcasts_no_positions_and_carries_no_long_keys(rows, monkeypatch, one_task):
    plans, links = [], []
    told_plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    cut, rewritten = dedup.cut, dedup.rewritten
    monkeypatch.setattr(dedup, "cut", lambda df: links.append(cut(told_plan(df))) or links[-1])
    monkeypatch.setattr(dedup, "rewritten", lambda df, *before: rewritten(told_plan(df), *before))
    line = "une ligne assez longue pour compter comme fragment partagé entre deux parties du corpus"
    data = [(1, f"{line}\nun", "a", "train"), (2, f"{line}\nun", "b", "train"), (3, f"{line}\ndeux autres mots ici", "c", "test"), (4, "cinq six sept", "d", "test")]
    told = dedup.accept(rows(data, "pos long, text string, url string, split string"), "pos", one_task=one_task)
    told_plan(told)
    assert {r["pos"]: r["reason"] for r in told.collect()} == {1: None, 2: "exact_duplicate", 3: "cross_partition_fragment", 4: None}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    kept = [r["key"] for x in links if x.columns == ["rank", "key", "pos", "s"] for r in x.collect()]
    assert kept and all(k.isdigit() and len(k) < 20 for k in kept)


def test_budget_cut_broadcasts_no_sizes(spark, monkeypatch):
    from lexiloom.plans import catalog

    plans, write = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    catalog.QUERIES["budget_cut"](spark, "/root/testdata/sf0.001")
    sized = [p for p in plans if "octet_length" in p]
    assert sized and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in sized)

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import hashing, training, urls
from lexiloom.functions import text as tx

SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2003\u2028\u2029\u202f\u205f\u3000"


def one(rows, value, expression, kind="string"):
    return rows([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()[0]


def test_trim_takes_unicode_space_and_no_controls(rows):
    assert one(rows, f"{SPACE}a b{SPACE}", tx.trimmed) == "a b"
    assert one(rows, "\x1ca\x1f", tx.trimmed) == "\x1ca\x1f"
    assert one(rows, None, tx.trimmed) is None


def test_lines(rows):
    assert one(rows, "a\r\nb\rc\n", tx.lines) == ["a", "b\rc"]
    assert one(rows, "", tx.lines) == []
    assert one(rows, "\n\n", tx.lines) == ["", ""]
    assert one(rows, "a\n\nb\n\n\nc", tx.blocks) == ["a", "b", "\nc"]


def test_trigrams(rows):
    assert one(rows, "Un  deux\u2003trois Quatre", tx.trigrams) == ["un deux trois", "deux trois quatre"]
    assert one(rows, "un deux", tx.trigrams) == []


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé \n\r\t\u3000<|end>x9", max_size=120), min_size=1, max_size=8))
def test_text_against_python(rows, texts):
    df = rows([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.words(F.col("t")).alias("w"), tx.normalized(F.col("t")).alias("n"), tx.word_set(F.col("t")).alias("s"))
    for r in df.collect():
        t = texts[r["i"]]
        assert r["w"] == t.split()
        assert r["n"] == t.replace("\r\n", "\n").strip()
        assert sorted(r["s"]) == sorted(set("".join(c if c.isalnum() else " " for c in t.lower()).split()))


def test_significant_fragments(rows):
    long = "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze"
    assert one(rows, f"{long}\nkurz", tx.fragments) == [long, f"{long}\nkurz"]
    assert one(rows, "x" * 100, tx.fragments) == []
    assert f"{long}" in one(rows, f"a<|end|>{long}<|end|>", lambda c: tx.fragments(c, records=True))


def test_corrupted(rows):
    assert [one(rows, t, tx.has_corrupted) for t in ("a\x85b\t", "a\x01", "\ufffd", "é")] == [False, True, True, False]


def test_hashes(rows):
    digest = hashlib.sha256(b"exemple.fr").digest()
    assert one(rows, "exemple.fr", hashing.unsigned_prefix) == str(int.from_bytes(digest[:8], "big"))
    assert one(rows, "exemple.fr", hashing.signed_little_endian) == int.from_bytes(digest[:8], "little", signed=True)
    n = int.from_bytes(digest[:8], "big") % 10
    assert one(rows, "exemple.fr", hashing.split_of) == ("test" if n == 0 else "validation" if n == 1 else "train")
    assert one(rows, None, hashing.split_of) is None


def test_splits_take_all_values(rows):
    found = rows([(f"fr:{i}",) for i in range(100)], "k string").select(hashing.split_of(F.col("k")).alias("a"), hashing.split_of_unit(F.col("k")).alias("b"))
    assert {r["a"] for r in found.collect()} == {r["b"] for r in found.collect()} == {"train", "validation", "test"}


def test_checksum_wraps(rows):
    ids = [2**31 - 1] * 40
    c = 0
    for i in ids:
        c = (c * 31 + i) % 2**64
    assert int(one(rows, ids, hashing.checksum, "array<int>")) == c
    assert one(rows, [], hashing.checksum, "array<int>") == 0


def test_step_seed(rows):
    def mixed(seed, step):
        m = 2**64
        x = (seed + step * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ x >> 27) * 0x94D049BB133111EB % m
        return x ^ x >> 31

    got = rows([(42, 0), (42, 1), (7, 10**6)], "a long, b long").select(hashing.step_seed(F.col("a"), F.col("b")).alias("x")).collect()
    assert [int(r["x"]) for r in got] == [mixed(42, 0), mixed(42, 1), mixed(7, 10**6)]


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://Exemple.FR:443/a#b", "exemple.fr"), ("http://u@h.test", "h.test"), ("ftp://h.test/", None), ("exemple.fr", None), ("", None), (None, None), ("https://", None)],
)
def test_host(rows, url, host):
    assert one(rows, url, urls.web_host) == host


def test_learning_rate(spark):
    r = {x["id"]: x["r"] for x in spark.range(101).select("id", training.learning_rate(F.col("id"), 100, 10, 1e-3, 0.1).alias("r")).collect()}
    assert r[10] == pytest.approx(1e-3) and r[100] == pytest.approx(1e-4) and all(r[i] >= r[i + 1] for i in range(10, 100)) and r[5] == pytest.approx(5e-4)


def test_promotion(rows):
    c = [(1.0, 0.9, 1.0), (1.0, 0.9, 1.5), (1.0, float("nan"), 1.0), (1.0, 1.0, 1.0), (1.0, None, 1.0)]
    got = rows(c, "cw double, nw double, nf double").select(training.accepts(F.lit(1.0), F.col("cw"), F.lit(1.0), F.col("nw"), F.col("nf")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, False, False, False]


def test_parameters():
    assert training.parameter_count(10, 4, 1, 2, 1, 8) == 40 + (32 + 16 + 96 + 8) + 4
    with pytest.raises(ValueError):
        training.parameter_count(10, 5, 1, 2, 1, 8)


def test_display(rows):
    assert one(rows, "a\x1b[0m\n\tb\r", tx.displayed) == "a\ufffd[0m\n\tb\ufffd"
    assert one(rows, "\x01" + "é" * 500, tx.excerpt) == "é" * 420
    assert one(rows, "  Bonjour   à TOI ", tx.question_key) == "bonjour à toi"

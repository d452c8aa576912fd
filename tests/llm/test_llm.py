import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import books, budget, encoding, languages, lines, mixing, overlap, pairs, quality, tokens

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(TOKENIZER)
    made.encode_special_tokens = True
    return lambda t: made.encode(t, add_special_tokens=False).ids


# --- tokens ----------------------------------------------------------------------------------------------------------


def texts():
    r = random.Random(5)
    words = ["l'été", "moulin", " ", "  ", "\n", "\n\n", "\t", "don't", "42", "1999", "été", "日本語", "🦀", "…", "--", "<|endoftext|>", " ", "a" * 40]
    made = ["".join(r.choice(words) + (" " if r.random() < 0.6 else "") for _ in range(n)) for n in (0, 1, 5, 50, 400, 900)]
    return [*made, None, "", " ", "x" * 3000, " " * 700, "\n" * 700, "é" * 2500, "ab " * 900, "a  \n" * 300]


def test_ids_of_short_and_long_texts(rows, reference):
    data = [(i, t, "x") for i, t in enumerate(texts())]
    df = rows(data, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "doc_id", "text", chunk=300, overlap=60).collect()}
    assert got == {i: reference(t) if t else [] for i, t, _ in data}
    counted = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df, "doc_id", "text", chunk=300, overlap=60).collect()}
    assert counted == {i: len(x) for i, x in got.items()}
    whole = tokens.encode(df, "doc_id", "text")
    assert {r["doc_id"]: r["ids"] for r in whole.collect()} == got
    assert {r["doc_id"]: r["text"] for r in tokens.decode(whole, "doc_id").collect()} == {i: t or "" for i, t, _ in data}


def test_no_texts(rows):
    empty = rows([], "doc_id long, text string")
    assert tokens.encode(empty, "doc_id", "text").count() == 0 and tokens.count_tokens(empty, "doc_id", "text").count() == 0


def test_budget(rows, reference):
    data = [("a", "fr", "un moulin"), ("a", "fr", "un moulin"), ("a", None, "un four"), ("b", "en", ""), (None, "en", None), ("b", "en", "un moulin")] + [("hot", "fr", "le même texte")] * 30
    df = rows([(i, *x) for i, x in enumerate(data)], "id long, source string, language string, text string").repartition(4)
    n = {t: len(reference(t)) if t else 0 for *_, t in data}
    got = {(r["source"], r["language"]): (r["documents"], r["distinct_texts"], r["tokens"], r["distinct_tokens"]) for r in budget.totals(df, ["source", "language"]).collect()}
    assert got[("a", "fr")] == (2, 1, 2 * n["un moulin"], n["un moulin"]) and got[("hot", "fr")] == (30, 1, 30 * n["le même texte"], n["le même texte"])
    assert got[("b", "en")] == (2, 2, n["un moulin"], n["un moulin"]) and got[(None, "en")] == (1, 0, 0, 0)
    each = budget.document_tokens(df, ["id"]).collect()
    assert {r["id"]: r["tokens"] for r in each} == {i: n[t] for i, (*_, t) in enumerate(data)}
    total = budget.slices(budget.totals(df, ["source", "language"]), ["source"]).where("dimension = 'total'").first()
    assert (total["documents"], total["tokens"]) == (len(data), sum(n[t] for *_, t in data))
    codes = rows([("FRA",), ("fr",), ("fr-FR",), (" ",), (None,), ("und",)], "c string").select(budget.language(F.col("c")).alias("x"))
    assert [r["x"] for r in codes.collect()] == ["fr", "fr", "fr", None, None, None]


# --- pairs -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("Que sais-tu ?", None, "empty"), ("Que sais-tu ?", "​ ﻿", "empty"), ("Que sais-tu ?", "(sans réponse)", "empty"), ("Que sais-tu ?", "N/A", "empty"), ("Que sais-tu ?", "« … »", "empty"),
        ("Décris un moulin ancien.", "DÉCRIS UN MOULIN ANCIEN", "copy"), ("Décris un moulin ancien.", "Question : décris  un moulin ancien. Décris un moulin ancien.", "copy"),
        ("Répète après moi : le moulin tourne.", "Le moulin tourne.", None), ("734 + 573 =", "734 + 573 = 1307.", None), ("Décris un moulin.", "Un moulin est grand.", None),
        ("Décris un moulin.", "Je regrette, je ne peux pas répondre à cette demande.", "refusal"), ("Describe a mill.", "I'm sorry, but I can't help with that.", "refusal"),
        ("Comment refuser ?", "On peut dire : « Désolé, je ne peux pas répondre à cette question ».", None), ("Peux-tu dormir ?", "Non, un programme ne dort pas.", None),
        ("Describe un molino.", "Lo siento, prefiero no tratar ese tema.", "refusal"), ("Was weißt du?", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
        ("Décris le moulin de la colline.", "The mill is on the hill and it was built by the miller.", "other_language"), ("Traduis en anglais : le moulin est là.", "The mill is there and it is old.", None),
        ("What is on the hill?", "Le moulin est sur la colline avec le meunier.", "other_language"), ("Donne le mot anglais pour clef.", "Key.", None), (None, "Un moulin est grand.", None),
        ("Décris un moulin.", "Le moulin tourne. Il a une gran-", "truncated"), ("Décris un moulin.", "Le moulin tourne « dans la", "truncated"), ("Trois idées ?", "1. Le moulin tourne.\n2.", "truncated"), ("Où ?", "Brilorville", None),
    ],
)
def test_rules_of_pairs(question, answer, defect):
    rows_ = next(pairs._first_look("i", "q", "a", "fr")(iter([__import__("pandas").DataFrame({"i": [1], "q": [question], "a": [answer]})])))
    assert rows_["defect"][0] == defect


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("Décris un moulin ancien.", "Décris un mouiln ancien !", "copy"), ("Question utile : décris un moulin ancien.", "Réponse : question utile : décris un moulin ancien", "copy"), ("Combien font 12 + 34 ?", "Question : combien font 12 + 34 ?", "copy"),
        ("Combien font 12 + 34 ?", "Combien font 12 + 35 ?", None), ("Décris un moulin ancien.", "Décris un moulin récent.", None), ("Qui aime le vieux moulin ?", "Qui aime le vieux moulin ? Paul.", None),
        ("Describe a fragile ledger.", "The fragile ledger was with the old miller.", None), ("Describe un cuaderno último.", "El cuaderno está en la casa de los abuelos.", None), ("Describe a mill.", "Le moulin est sur la colline avec le meunier.", None),
        ("Décris le moulin de la colline.", "Мельница стоит на холме.", "other_language"), ("Traduis en russe : le moulin est là.", "Мельница там.", None), ("水車小屋はどこですか。", "丘の上にあります。", None), ("97 + 113 =", "Das ist nicht die richtige Antwort.", "other_language"),
        ("Descreva o moinho.", "Desculpe, não posso responder a essa pergunta.", "refusal"), ("Descrivi il mulino.", "Mi dispiace, non posso rispondere a questa domanda.", "refusal"),
    ],
)
def test_near_copies_and_languages_without_a_sample(question, answer, defect):
    assert ("copy" if pairs.is_copy(question, answer) else "refusal" if pairs.is_refusal(answer) else "other_language" if pairs.is_other_language(question, answer) else None) == defect


def test_languages_learn_content_words(rows):
    r = random.Random(4)
    nouns = {"fr": ["moulin", "jardin", "chemin", "sentier"], "en": ["mill", "garden", "ledger", "barn"]}
    made = {"fr": "Le {} est près du {} et il ne dort pas.", "en": "The {} is with the {} and it does not sleep."}
    texts_ = [made[k].format(*r.sample(nouns[k], 2)) for k in ("fr", "en") for _ in range(200)]
    model = languages.fit(texts_)
    assert model.possible("Describe ledger barn", "fr") == {"en"} and model.possible("12 + 13", "fr") == {"fr"} and languages.fit([]).weights is None
    data = [(i, "Describe a garden." if i % 2 else "Décris un jardin.", texts_[200 + i] if i % 2 else texts_[i]) for i in range(100)] + [(500, "Describe a ledger, a barn, a garden.", texts_[0]), (501, "Décris un sentier.", texts_[300]), (502, None, texts_[300]), (503, None, None)]
    got = {x["example_id"]: x["defect"] for x in pairs.defects(rows(data, "example_id long, question string, answer string")).collect() if x["defect"]}
    assert got == {500: "other_language", 501: "other_language", 502: "other_language", 503: "empty"}


def test_truncated_by_context(rows):
    r = random.Random(2)
    nouns, adjectives, verbs = ["le moulin", "la ferme", "le four", "la rivière", "le jardin"], ["voisin", "rouge", "paisible", "calme"], ["regarde", "entoure", "traverse", "longe"]
    sentence = lambda: f"{r.choice(nouns).capitalize()} {r.choice(adjectives)} {r.choice(verbs)} {r.choice(nouns)} {r.choice(adjectives)}"
    data = [(i, "Décris le lieu.", f"{sentence()}. {sentence()}.") for i in range(400)]
    data += [(1000, "Décris le lieu.", f"{sentence()}. {sentence()}"), (1001, "Décris le lieu.", f"{sentence()}. Le moulin rouge traverse le"), (1002, "Décris le lieu.", f"{sentence()}. Le moulin rouge entoure la riv"), (1003, "Décris le lieu.", f"{sentence()}. Le moulin voisin")]
    got = {x["example_id"]: x["defect"] for x in pairs.defects(rows(data, "example_id long, question string, answer string")).collect()}
    assert len(got) == len(data) and {i: d for i, d in got.items() if d} == {1001: "truncated", 1002: "truncated", 1003: "truncated"}
    assert pairs.defects(rows([], "example_id long, question string, answer string")).count() == 0


# --- lines -----------------------------------------------------------------------------------------------------------


def test_repeated_lines(rows):
    schema = "record_id long, url string, text string, repeated string"
    note = ["Mentions   légales | 2020", "mentions légales | 2021 ", "MENTIONS LÉGALES | 7"]
    data = [(i, ["https://www.A.fr:443/x", "http://a.fr", "//a.fr/y"][i % 3], f"ligne {chr(97 + i)}\n{note[i % 3]}\n\n{note[0]}", "x") for i in range(5)]
    data += [(i, "https://a.fr/z", None, "x") for i in range(5, 25)] + [(30, None, note[0], "x"), (31, "https://b.fr", note[0], "x")]
    got = sorted((r["record_id"], r["line_no"]) for r in lines.found(rows(data, schema).drop("repeated")).collect())
    assert got == [(i, n) for i in range(5) for n in (1, 3)]  # 5 of 25 records of the site
    assert lines.found(rows(data + [(40, "https://a.fr", "", "x")], schema).drop("repeated")).count() == 0
    clean = {r["record_id"]: (r["text"], r["removed"]) for r in lines.cleaned(rows(data, schema).drop("repeated")).collect()}
    assert clean[0] == ("ligne a\n", 2) and clean[31] == (note[0], 0) and clean[7] == (None, 0) and len(clean) == len(data)
    assert lines.found(rows([], schema)).count() == 0


# --- overlaps --------------------------------------------------------------------------------------------------------


def words(t):
    u = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return "".join(c if c.isalnum() else " " for c in u).split()


def test_word_hashes_follow_the_words():
    samples = ["L'été, déjà !", "ﬁn ½ ™ Ⅷ ²", "ét́é", "한국어 日本語", "", "a_b-c", "İstanbul ß"]
    hashes, sizes = overlap.word_hashes(samples)
    assert sizes.tolist() == [len(words(s)) for s in samples]
    again, _ = overlap.word_hashes(["lete deja", "ETE ete"])
    plain, _ = overlap.word_hashes([" ".join(words(s)) for s in samples])
    assert (plain == hashes).all() and again[2] == again[3]


@pytest.mark.parametrize("shard_words", [10**7, 400])
def test_overlaps_are_all_pairs(rows, shard_words):
    r = random.Random(9)
    vocabulary = [f"mot{i}é" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(15, 120))] for _ in range(25)]
    data = []
    for i, w in enumerate(base):
        for split in ("train", "train", "test", "validation", None):
            v = [r.choice(vocabulary) if r.random() < r.choice([0, 0.02, 0.06, 0.12]) else x for x in w]
            if r.random() < 0.3:
                v = v[len(v) // 2 :] + v[: len(v) // 2]
            data.append((len(data), (" " if r.random() < 0.5 else ", ").join(v).upper(), split))
    data += [(900, None, "train"), (901, "", "test"), (902, data[2][1], "train"), (903, data[2][1], "test")]
    tri = {i: set(zip(w, w[1:], w[2:])) for i, t, s in data if t and s and len(w := words(t)) >= 20}
    wanted = {(i, j) for i in tri for j in tri if data_split(data, i) == "train" and data_split(data, j) != "train" and 2 * len(tri[i] & tri[j]) >= len(tri[i] | tri[j])}
    df = rows(data, "record_id long, text string, partition_name string").repartition(4)
    got = {(x["train"], x["evaluation"]) for x in overlap.overlaps(df, shard_words=shard_words).collect()}
    assert got == wanted and len(wanted) > 30


def data_split(data, i):
    return next(s for k, _, s in data if k == i)


def test_prose_in_other_scripts_is_no_junk(rows):
    texts_ = ["Мельница стоит на холме, и каждое утро мельник открывает её старую дверь. Потом он мелет зерно.", "Ο μύλος στέκεται στον λόφο και κάθε πρωί ο μυλωνάς ανοίγει την παλιά πόρτα του.", "水車小屋は丘の上にあり、毎朝粉屋が古い扉を開けて麦を挽いている。"]
    data = [(i, t) for i, t in enumerate(texts_)] + [(9, "xq7 zz9k 4tt8 qq1w 8hj3 pp0x z7z7 k2k2 " * 4)]
    got = {r["record_id"]: r["kind"] for r in quality.statistics(rows(data, "record_id long, text string"), "record_id").collect()}
    assert got == {0: None, 1: None, 2: None, 9: "junk"}


def test_hyphens_that_are_a_words_own(rows):
    text = "Un porte-plume est là. Le porte-plume est vieux.\nOn aime le porte-\nplume du maître et le jar-\ndin du moulin.\nLe jardin est vert. Un beau jardin."
    made = " ".join(r["text"] for r in books.paragraphs(book(rows, ("T", "A", text, "x"))).collect())
    assert "le porte-plume du maître" in made and "le jardin du moulin" in made


def test_overlaps_of_nothing(rows):
    schema = "record_id long, text string, partition_name string"
    assert overlap.overlaps(rows([], schema)).count() == 0
    assert overlap.overlaps(rows([(1, "a " * 30, "train")], schema).unionByName(rows([(2, None, "test")], schema))).count() == 0


def test_backward_search_finds_all_occurrences():
    r = np.random.default_rng(1)
    texts_ = [r.integers(1, 4, 60).astype(np.uint64) for _ in range(5)]
    index = overlap.Index(**overlap.build(texts_))
    query = np.concatenate([r.integers(1, 5, 10), texts_[2][10:40], r.integers(1, 4, 10)]).astype(np.uint64)
    block = overlap.Block.make(query, np.array([len(query)]))
    low, high = index.search(block)
    joined = [t.tolist() for t in texts_]
    for i, g in enumerate(block.places):
        part = query[i : i + 3].tolist()
        assert high[g] - low[g] == sum(part == t[k : k + 3] for t in joined for k in range(len(t)))
        assert sorted(index.posts[index.at[low[g]] : index.at[high[g]]]) == [k for k, t in enumerate(joined) if any(part == t[j : j + 3] for j in range(len(t)))]


def test_sorted_numbers_with_and_without_packing():
    for top in (50, 1 << 61):
        x = np.random.default_rng(2).integers(0, top, 300)
        ordered, order = overlap._sorted(x)
        assert (ordered == np.sort(x)).all() and (order == np.argsort(x, kind="stable")).all()
        codes, distinct = overlap._numbered(x)
        assert (distinct[codes] == x).all() and (distinct == np.unique(x)).all()


def test_overlaps_of_frequent_texts_and_their_spans(rows):
    text = [f"w{i}" for i in range(40)]
    near = [*text[:12], "x", *text[13:]]
    far = [*text[:20], *[f"z{i}" for i in range(20)]]
    data = [(i, " ".join(text), s) for i, s in enumerate(["train"] * 6 + ["test"] * 30 + ["validation"] * 30)]
    data += [(100, " ".join(near), "train"), (101, " ".join(far), "train"), (102, "\U00030000\U00030001 " * 15, "train"), (103, "\U00030000\U00030001 " * 15, "test")]
    df = rows(data, "record_id long, text string, partition_name string").withColumn("words", F.lit("a clash")).repartition(3)
    got = {(x["train"], x["evaluation"]): (x["share"], x["spans"], x["words"]) for x in overlap.overlaps(df).collect()}
    assert len(got) == 7 * 60 and all(got[i, j] == (1.0, 1, 40) for i in range(6) for j in range(6, 66))
    assert {x for (i, _), x in got.items() if i == 100} == {(35 / 41, 2, 39)}
    many = [(1000, " ".join(["y"] * 30), "train"), (1001, " ".join(["y"] * 50), "test"), (1002, " ".join(f"{'abc'[i % 3]}" for i in range(30)), "test")]
    assert {(x["train"], x["evaluation"]) for x in overlap.overlaps(rows(many, "record_id long, text string, partition_name string")).collect()} == {(1000, 1001)}


# --- books -----------------------------------------------------------------------------------------------------------


def test_page_numbers():
    page = lambda n, form: [form.format(n), *["du texte de la page"] * 20]
    lines_ = sum((page(n, "— {} —") for n in range(7, 14)), []) + ["1871", "du texte"]
    lines_[30] = "1866."
    assert sorted(books.page_numbers(lines_)) == [21 * i for i in range(7)]
    assert books.page_numbers(["1871", "texte"]) == {} and books.page_numbers([]) == {}


def test_skeletons():
    for wrong, right in (("rnoulin", "moulin"), ("mou1in", "moulin"), ("pctit", "petit"), ("clieval", "cheval"), ("matm", "matin"), ("couine", "colline"), ("jour5", "jours"), ("tempéte", "tempête")):
        assert books.skeleton(right) in books.skeletons(wrong), wrong


def book(rows, *items):
    return rows([(f"b{i}", *x) for i, x in enumerate(items)], "file_id string, title string, author string, complete_text string, kind string")


def test_books(rows):
    body = "Le moulin de la colline garde ses pierres.\nLa ferme de la colline garde ses pierres.\n" * 60
    pages = "".join(f"{n}        LE MOULIN ANCIEN\nLe moulin de la col-\nline garde ses pierres.\n\n" + "La ferme garde encore ses pierres.\n" * 18 for n in range(3, 9))
    text = f"CHAPITRE I\nLe moulin ancien\n\n{body}{pages}Le rnoulin de la colline garde ses pierres.\nLe moulin garde ses 1ettres.\n"
    got = books.affected_lines(book(rows, ("Le moulin ancien", "A. Meunier", text, "x"), ("T", None, None, "x"), (None, None, "", "x"), ("T", "A", " \n", "x"))).collect()
    lines_ = text.split("\n")
    by = {}
    for r in got:
        assert r["file_id"] == "b0"
        by.setdefault(r["kind"], []).append(lines_[r["line_no"]])
    assert len(by["running_header"]) == 6 and all("LE MOULIN" in x for x in by["running_header"])
    assert by["hyphen_break"] == ["Le moulin de la col-"] * 6 and sorted(by["misread"]) == ["Le moulin garde ses 1ettres.", "Le rnoulin de la colline garde ses pierres."]
    made = [r["text"] for r in books.paragraphs(book(rows, ("Le moulin ancien", "A. Meunier", text, "x"))).orderBy("paragraph").collect()]
    assert made[:2] == ["CHAPITRE I", "Le moulin ancien"] and not any("LE MOULIN" in x or "col-" in x or "rnoulin" in x for x in made) and any("de la colline garde" in x for x in made)
    assert books.affected_lines(book(rows, ("T", "A", None, "x"))).count() == 0


def test_neighbours_choose_the_form(rows):
    body = "La colline est abrité par le mur.\n" * 190 + "Un toit qui abrite encore les bêtes.\n" * 180
    wrong = "Un toit qui abritc encore les bêtes.\nLa colline est abritc par le mur.\nDemain abritc jamais.\nIl est abritc par un toit qui abritc encore.\n"
    made = " ".join(r["text"] for r in books.paragraphs(book(rows, ("T", "A", body + wrong, "x"))).collect())
    # the form that stands beside both neighbours, the most frequent one where none does, and either in one line
    assert made.endswith("Un toit qui abrite encore les bêtes. La colline est abrité par le mur. Demain abrité jamais. Il est abrité par un toit qui abrite encore.")


# --- quality ---------------------------------------------------------------------------------------------------------

PROSE = "Le moulin de la colline garde encore ses vieilles pierres, et chacun vient y chercher la farine du matin. "
KINDS = {
    None: [PROSE * 8, "\n".join([PROSE] * 4 + ["- un moulin"]), "", " \n ", "The mill on the hill keeps its old stones, and everyone comes to fetch the flour of the morning. " * 4],
    "list": ["\n".join(f"- un moulin {i}" for i in "abcdefgh"), "\n".join(f"{i}. une ferme rouge" for i in range(1, 12)), "un four, une ferme, un jardin, une rivière, un moulin, une école\n" * 4],
    "table": ["\n".join(f"| {i} | oui | Brilor | {i * 7} |" for i in range(100, 110)), "\n".join(f"{i}\tBrilor\t{i * 3}" for i in range(100, 110)), "\n".join(f"{i};oui;Brilor;non" for i in range(9))],
    "junk": ["moulin ferme moulin ferme moulin ferme moulin ferme moulin ferme\n" * 4, "83 a2 1f 61 4b 93 2e 11 09 e8 7d 2d\n" * 5, "*@=}$+°|> # ^* <= >}*§{{ %# ~%\n" * 5, "eTh orsty fo the eryg matprra,w ceoelms htat fo eth ndsedu lkc.oc hT e\n" * 4],
}


def test_kinds(rows):
    cases = [(i, kind, t) for i, (kind, t) in enumerate((k, t) for k, ts in KINDS.items() for t in ts)]
    got = {r["record_id"]: r["kind"] for r in quality.statistics(rows([(i, t, "x") for i, _, t in cases] + [(99, None, "x")], "record_id long, text string, lines string"), "record_id").collect()}
    assert got == {i: kind for i, kind, _ in cases}


def test_chunks_change_nothing(rows):
    r = random.Random(4)
    whole = [t for ts in KINDS.values() for t in ts]
    data = [(i, "\n".join(r.sample(whole, 3)), [0, 2]) for i in range(12)] + [(50, "é" * 900 + " " + "mot " * 300, []), (51, "\n" * 300, [1]), (52, "mot\n", [])]
    df = rows(data, "record_id long, text string, gone array<int>")
    short = sorted(map(tuple, quality.counts(df, "record_id", "text", "gone").collect()))
    long = sorted(map(tuple, quality.counts(df, "record_id", "text", "gone", chunk=100).collect()))
    # a word longer than the halo is cut, which only the text of one such word has
    assert [x for x in short if x[0] != 50] == [x for x in long if x[0] != 50]
    assert quality.counts(df.limit(0), "record_id", "text", "gone").count() == 0


def test_statistics(rows):
    s = quality.statistics(rows([(1, "Le moulin tourne.\n\nUn four ; 12 !"), (2, "")], "record_id long, text string"), "record_id").orderBy("record_id").collect()
    assert (s[0]["lines"], s[0]["filled"], s[0]["words"], s[0]["terminal"], s[0]["digits"]) == (3, 2, 5, 2, 2) and s[1]["mean_word_length"] is None and s[1]["words"] == 0


# --- encoding --------------------------------------------------------------------------------------------------------


def test_spans_come_back():
    original = "« L’été à la forêt », dit-elle : œuvre, naïf, 12 €… “Ça va” – voilà."
    for codec in ("cp1252", "mac_roman", "cp437", "cp850"):
        table = {b: c for c, b in encoding.to_byte(codec).items()}
        shown = "".join(table.get(b, chr(b)) for b in original.encode())
        assert encoding.decode_spans(shown)[0] == original, codec
    twice = original
    for _ in range(2):
        table = {b: c for c, b in encoding.to_byte("cp1252").items()}
        twice = "".join(table.get(b, chr(b)) for b in twice.encode())
    assert encoding.decode_spans(f"Intact : déjà. {twice}")[0] == f"Intact : déjà. {original}"


@pytest.mark.parametrize("text", ["Élève, café : « ÇÀ ET LÀ » — ALLÉE.", "La suite « prÃ©au » apparaît à la place de « préau ».", "Молодой гончар украшает тёплый хлеб. СССР»", "Το μικρό σχολείο", "São João, ação", "日本語の例", "ENSOLEILLÉ »"])
def test_right_text_stays(text):
    assert encoding.decode_spans(text) == (text, 0, [])


def test_inspected(rows):
    fine = "La forêt ensoleillée précède l'été léger. "
    data = [(i, fine * 3, "x") for i in range(200)] + [(500, (fine * 3).encode("cp1252").decode("mac_roman"), "x"), (501, "La forêt ensoleill�e", "x"), (502, None, "x"), (503, "", "x"), (504, fine + fine.encode().decode("cp1252"), "x")]
    got = {r["doc_id"]: r for r in encoding.inspected(rows(data, "doc_id long, text string, spans string")).collect()}
    assert {i for i, r in got.items() if r["garbled"]} == {500, 501, 504} and len(got) == len(data)
    assert got[500]["original"] == fine * 3 and got[501]["original"] is None and got[501]["how"] == "lost" and got[504]["original"] == fine * 2
    assert encoding.inspected(rows([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("passages", [4, 5, 12])
def test_every_passage_is_restored(rows, passages):
    fine = "La forêt ensoleillée précède l'été léger. "
    text = (fine + fine.encode("cp1252").decode("mac_roman")) * passages
    got = encoding.inspected(rows([(i, fine * 3) for i in range(200)] + [(500, text)], "doc_id long, text string")).where("doc_id = 500").collect()
    assert got[0]["original"] == fine * 2 * passages and got[0]["spans"] >= passages


def test_rereading_ends():
    class Fickle(encoding.Pairs):  # likes every reading more than the last one
        def log(self, codes):
            self.calls = getattr(self, "calls", 0) + 1
            return np.full(len(codes), 20.0 * self.calls)

    text, n, how = encoding.swap_spans("forêt ensoleillée " * 3 + "forÍt", Fickle(np.array([1]), np.array([1])))
    assert n == len(how) and len(text) == 59


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_fit_meets_marginals():
    cells = {(s, t): 100.0 for s in "ab" for t in "xy"}
    got = mixing.fit(cells, [{"a": 300.0, "b": 100.0}, {"x": 250.0, "y": 150.0}], {k: 1000.0 for k in cells})
    assert sum(v for k, v in got.items() if k[0] == "a") == pytest.approx(300) and sum(v for k, v in got.items() if k[1] == "x") == pytest.approx(250)
    capped = mixing.fit({("a", "x"): 10.0, ("a", "y"): 90.0}, [{"a": 150.0}, {}], {("a", "x"): 12.0, ("a", "y"): 180.0})
    assert capped[("a", "x")] <= 12.0 and sum(capped.values()) == pytest.approx(150)
    assert mixing.fit({}, [{}], {}) == {}
    # sides that can't be met together: the last one holds
    torn = mixing.fit({("a", "x"): 50.0, ("b", "y"): 50.0}, [{"a": 80.0, "b": 20.0}, {"x": 30.0, "y": 70.0}], {("a", "x"): 1000.0, ("b", "y"): 1000.0})
    assert round(torn["a", "x"], 6) == 30 and round(torn["b", "y"], 6) == 70


def test_mix(rows, reference):
    r = random.Random(3)
    data = [(i, " ".join(r.choice(["moulin", "four", "jardin", "rivière"]) for _ in range(r.randint(3, 30))) + f" {i}", s, "fr", "t", "x") for i, s in enumerate(["big"] * 300 + ["small"] * 40 + ["tiny"] * 5)]
    data += [(900, data[0][1], "big", "fr", "t", "x"), (901, None, "big", None, "t", "x"), (902, "", "big", None, None, "x"), (903, "autre", "other", "fr", "t", "x")]
    documents = rows(data, "doc_id long, text string, source string, language string, topic string, copies string").drop("copies")
    targets = rows([("big", 0.5, 1), ("small", 0.4, 8), ("tiny", 0.05, 2), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    size = 4000
    mixed = mixing.mix(documents, targets, total=size).collect()
    assert len({(x["doc_id"], x["source"]) for x in mixed}) == len(mixed) and 900 not in {x["doc_id"] for x in mixed}
    sums = {s: sum(x["tokens"] * x["copies"] for x in mixed if x["source"] == s) for s in ("big", "small", "tiny")}
    available = {s: sum(len(reference(t)) for i, t, z, *_ in data if z == s and t and i < 900) for s in sums}
    assert abs(sums["big"] - 2000) <= 30 and abs(sums["small"] - min(1600, 8 * available["small"])) <= 30 and abs(sums["tiny"] - min(200, 2 * available["tiny"])) <= 30
    for s, cap in (("big", 1), ("small", 8), ("tiny", 2)):
        assert max(x["copies"] for x in mixed if x["source"] == s) <= cap
    shares = {x["source"]: x for x in mixing.shares(documents, targets, total=size).collect()}
    assert shares["none"]["mix_tokens"] == 0 and not shares["none"]["reached"] and shares["big"]["reached"] and shares["big"]["available_texts"] == 300
    again = mixing.mix(documents.repartition(5), targets, total=size).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed))
    assert mixing.mix(documents.limit(0), targets).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6, 9)} | {"p7_ids", "p4_token_totals", "p8_mix"} <= names and set(entry.oracle_sql()) <= names
    json.dumps(sorted(names))


def test_building_a_shard_takes_few_bytes_a_word():
    import tracemalloc

    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 20_000, 400).astype(np.uint64) * np.uint64(7919) for _ in range(500)]
    overlap.build(texts[:2])
    tracemalloc.start()
    overlap._stored(overlap.build(texts), shard=0)
    peak = tracemalloc.get_traced_memory()[1] / sum(map(len, texts))
    tracemalloc.stop()
    assert peak < 80  # 116 before


def test_parsed_books_come_in_small_row_groups(rows, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(books, "ROW_GROUP", books.ROW_GROUP | {"parquet.block.size": str(1 << 16)})
    text = "\n".join(" ".join(f"mot{i * 7 % 1000 + j}" for j in range(8)) for i in range(60))
    made = books.parsed(rows([(f"b{k}", "T", "A", text) for k in range(40)], "file_id string, title string, author string, complete_text string").coalesce(1))
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in made.inputFiles()]
    assert max(groups) >= 4 and made.count() == 40

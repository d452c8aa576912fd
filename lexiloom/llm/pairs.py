"""Broken prompt and response pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm import languages
from lexiloom.llm.words import COMMON
from lexiloom.runtime import cut

#: Rows that the terminal-context model is fitted on at most, by the order of a hash of the answer.
SAMPLE_ROWS = 8_000
#: Weights of the terminal-context model, and the probability below which a context is not the end of a sentence.
WEIGHTS, LEAST_TERMINAL = 1 << 18, 0.5
#: Bytes that a copied answer may need beyond its prompt as dictionary: this many and this share of its length.
COPY_BYTES, COPY_SHARE = 16, 0.25

#: What stands in for a missing answer, in lower case without brackets and outer punctuation.
STANDINS = {
    "n/a", "na", "n.a", "nan", "none", "null", "nil", "undefined", "todo", "tbd", "vide", "empty", "blank", "vacío", "leer", "missing", "pending",
    "sans réponse", "pas de réponse", "aucune réponse", "réponse manquante", "réponse vide", "no answer", "no response", "empty answer",
    "sin respuesta", "respuesta vacía", "keine antwort", "ohne antwort", "à compléter", "à venir", "non renseigné", "non disponible",
    "not available", "no disponible", "nicht verfügbar",
}

#: Refusals by language, as what can't or won't be done and, behind it, what it is about.
REFUSALS = [
    (
        r"(?:ne (?:peux|puis|pourrai|saurais|dois|souhaite|veux)(?: malheureusement)? pas|ne (?:puis|saurais)|ne suis pas (?:en mesure|capable|autorisée?|habilitée?|programmée?)|"
        r"n'ai pas le droit|(?:est|m'est|serait) (?:impossible|interdit)|dois (?:décliner|refuser)|préfère (?:ne pas|m'abstenir)|refuse (?:de|d')|décline|sort de ce que je suis)",
        r"(?:répondre|réponse|t'aider|vous aider|aider|traiter|aborder|sujet|demande|question|requête|discuter|donner suite|autorisée?|m'est permis|fournir)",
    ),
    (
        r"(?:can(?:no|')?t|can not|unable|not able|not (?:allowed|permitted|authori[sz]ed)|won't|will not|must (?:decline|refuse)|have to (?:decline|refuse)|prefer not|rather not|decline|refuse|outside (?:of )?what)",
        r"(?:help|assist|answer|discuss|respond|request|question|topic|subject|provide|comply|address|allowed)",
    ),
    (
        r"(?:no (?:puedo|podré|debo|quiero)|no (?:me )?es posible|(?:me es|resulta) imposible|imposible|no estoy (?:autorizad|en condiciones)|no (?:me )?está permitido|prefiero no|debo (?:rechazar|declinar)|tengo que (?:rechazar|declinar)|rechazo|fuera de lo que)",
        r"(?:ayudar|responder|contestar|tratar|tema|petición|pregunta|solicitud|hablar|atender|permitido|autorizad)",
    ),
    (
        r"(?:kann|darf|möchte|werde|muss|bin|ist (?:es )?mir|lehne|außerhalb)",
        r"(?:nicht (?:beantworten|helfen|antworten|behandeln|besprechen|eingehen|erfüllen|bearbeiten|sprechen|weiterhelfen|in der lage|befugt|berechtigt)|ablehnen|nicht möglich|unmöglich|nicht erlaubt|nicht gestattet|nicht dabei helfen|dessen, was)",
    ),
    (
        r"(?:não (?:posso|poderei|devo|quero|consigo|estou autorizad[oa]|me é (?:possível|permitido))|prefiro não|recuso|devo recusar|é-me impossível)",
        r"(?:ajudar|responder|tratar|tema|pedido|pergunta|solicitação|falar|atender)",
    ),
    (
        r"(?:non (?:posso|potrò|devo|voglio|sono (?:in grado|autorizzat[oa])|mi è (?:possibile|permesso))|preferisco non|rifiuto|devo rifiutare|mi è impossibile)",
        r"(?:aiutar|rispondere|trattare|argomento|richiesta|domanda|parlare|discutere)",
    ),
    (
        r"(?:kan|mag|wil|zal|ben) (?:u |je |hier |daar |helaas )*niet|niet in staat|weiger|liever niet",
        r"(?:helpen|beantwoorden|antwoorden|bespreken|ingaan|vraag|verzoek|onderwerp)",
    ),
]
_REFUSALS = [re.compile(rf"{a}[^.!?\n]{{0,60}}?{b}", re.I) for a, b in REFUSALS]

#: Names of languages in a request for one.
ASKED = {
    "fr": r"fran[çc]ais|french|franc[ée]s|franz[öo]sisch",
    "en": r"anglais|english|ingl[ée]s|englisch",
    "de": r"allemand|german|alem[áa]n|deutsch",
    "es": r"espagnol|spanish|espa[ñn]ol|spanisch|castellano",
    "pt": r"portugais|portuguese|portugu[ée]s|portugiesisch",
    "it": r"italien|italian|italiano|italienisch",
    "nl": r"n[ée]erlandais|dutch|neerland[ée]s|niederl[äa]ndisch|nederlands",
    "pl": r"polonais|polish|polaco|polnisch|polski",
    "sv": r"su[ée]dois|swedish|sueco|schwedisch|svenska",
    "da": r"danois|danish|dan[ée]s|d[äa]nisch|dansk",
    "ro": r"roumain|romanian|rumano|rum[äa]nisch",
    "cs": r"tch[èe]que|czech|checo|tschechisch",
    "tr": r"turc|turkish|turco|t[üu]rkisch",
    "greek": r"grec|greek|griego|griechisch",
    "cyrillic": r"russe|russian|ruso|russisch|ukrainien|ukrainian|bulgare|bulgarian",
    "hebrew": r"h[ée]breu|hebrew|hebreo|hebr[äa]isch",
    "arabic": r"arabe|arabic|[áa]rabe|arabisch|persan|persian|ourdou|urdu",
    "devanagari": r"hindi",
    "thai": r"tha[iï]|thail[äa]ndisch",
    "hangul": r"cor[ée]en|korean|coreano|koreanisch",
    "kana": r"japonais|japanese|japon[ée]s|japanisch",
    "han": r"chinois|chinese|chino|chinesisch|mandarin",
}
_ASKED = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in ASKED.items()}

_INVISIBLE = re.compile(r"[\s­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿\x00-\x1f\x7f-\x9f]+")
_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"\n]*\"")
_LABEL = {"question", "q", "frage", "f", "pregunta", "p", "prompt", "réponse", "reponse", "r", "answer", "a", "antwort", "respuesta"}
_END = re.compile(r"[.!?…][\"'»”’)\]\s]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n+")


def is_empty(answer: str | None) -> bool:
    """Nothing visible, only punctuation, or a stand-in."""
    if answer is None:
        return True
    seen = _INVISIBLE.sub(" ", answer).strip().lower()
    core = re.sub(r"^[^\w]+|[^\w]+$", "", seen)
    return not core or core in STANDINS


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


@lru_cache(1)
def _parameters():  # noqa: ANN202
    import zstandard as z

    return z.ZstdCompressionParameters.from_level(3, format=z.FORMAT_ZSTD1_MAGICLESS, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)


def copy_bytes(question: str, answer: str) -> int:
    """Compressed bytes of the answer with the question as dictionary."""
    import zstandard as z

    held = z.ZstdCompressionDict(question.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
    return len(z.ZstdCompressor(dict_data=held, compression_params=_parameters()).compress(answer.encode()))


def _mistyped(a: str, b: str) -> bool:
    """Whether a word is another one but for one letter, or two letters that changed places, in words of four or more."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 or a.isdigit() or b.isdigit():
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    swapped = len(a) == len(b) and a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]
    return swapped or a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def is_copy(question: str | None, answer: str) -> bool:
    """The whole question, once or more, and nothing besides but for a label, stray signs or mistyped letters.

    The compressed size decides: a copy costs next to nothing beyond its question as zstandard dictionary, as a multiple
    of it, and the question next to nothing beyond the copy. What is as cheap and yet no copy has a word of its own (a
    sum's result), or lacks one: the words are compared last. Questions of under 8 bytes of words, for which a
    dictionary says nothing, are compared by words alone.
    """
    if not question:
        return False
    q, a = _tokens(question), _tokens(answer)
    while a and a[0] in _LABEL and a[: len(q)] != q:
        a = a[1:]
    own = [w for w in a if w not in _LABEL or w in q]
    if not q or len(own) < len(q):
        return False
    plain, copied = " ".join(q), " ".join(own)
    if len(plain) >= 8 and any(copy_bytes(x, y) > COPY_BYTES + COPY_SHARE * len(y.encode()) for x, y in ((plain, copied), (copied, plain))):
        return False
    times, rest = divmod(len(own), len(q))
    return not rest and all(x == y or _mistyped(x, y) for x, y in zip(own, q * times))


def is_refusal(answer: str) -> bool:
    """A refusal in the answer's own words: what stands in quotation marks is left out."""
    own = _QUOTED.sub(" ", answer.replace("’", "'"))
    return any(p.search(own) for p in _REFUSALS)


_SMALL = {w for language in COMMON.values() for w in language}


def is_other_language(question: str | None, answer: str, default: str = "fr", model: languages.Languages | None = None) -> bool:
    """The answer is clearly in a language that its question can't be in, and that it doesn't ask for.

    A question may be in several languages as far as its words tell; then none of them is another one. One without any
    evidence counts as ``default``, the language most pairs are in. What stands in quotation marks is left out.
    """
    model = model or languages.Languages()
    question = question or ""
    own = _QUOTED.sub(" ", answer)
    if 2 * len(_tokens(own)) < len(_tokens(answer)):
        own = answer
    bare = _QUOTED.sub(" ", question)
    other = model.clearly_other(own, model.possible(bare, default))
    return other is not None and other not in [k for k, p in _ASKED.items() if p.search(bare)]


def tail(answer: str) -> str | None:
    """What follows the last complete sentence or line of an answer that doesn't end a sentence; null if it ends one."""
    text = _INVISIBLE.sub(lambda m: "\n" if "\n" in m.group() else " ", answer).strip()
    last = text.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:\d+[.)]|[-–•*—])", last) and last != text:
        return last
    return None if _END.search(text) else _SENTENCE.split(text)[-1].strip()


def _breaks_off(text: str, end: str) -> bool | None:
    """Whether signs alone show that a tail breaks off; null if the words have to tell."""
    if re.fullmatch(r"(?:\d+[.)]|[-–•*—])", end):
        return True
    if re.search(r"[,;:(\[«“„—–]$|\w[-‐­]$", end):
        return True
    last = text.rsplit("\n", 1)[-1]
    if last.count("«") > last.count("»") or last.count("“") > last.count("”") or last.count("(") > last.count(")"):
        return True
    if len(end.split()) <= 3 and end == text.strip():
        return False
    return None


def _shape(word: str) -> str:
    bare = word.strip("«»“”\"'().,;:!?…")
    if bare[:1].isdigit():
        return "0"
    return f"A{bare[-3:]}" if bare[:1].isupper() else bare.lower()


def context(words: list[str], i: int) -> list[int]:
    """Hashed features of the sentence up to its word i."""
    shape = [_shape(w) for w in words[max(0, i - 24) : i + 1]]
    w, p = shape[-1], shape[-2] if len(shape) > 1 else "^"
    opening = " ".join(x.lower() if not x[:1].isdigit() else "0" for x in words[: min(2, i + 1)])
    small = [(i - j, x) for j, x in enumerate(words[: i + 1]) if (x.lower().strip("«»“”(),") in _SMALL and len(x) < 7) or x.endswith(",")][-4:]
    out = ["b", f"w {w}", f"s {w[-3:]}", f"p {p} {w}", f"q {p[-3:]} {w[-3:]}", f"r {p[-2:]} {w[-2:]}", f"n {min(i, 24)}", f"o {opening} {min(i, 24)}", f"z {opening} {w[-3:]}"]
    out += [f"t {x.lower()} {min(d, 8)}" for d, x in small]
    out += [f"u {' '.join(x.lower() for _, x in small[-k:])} {min(small[-1][0], 6)}" for k in (2, 3, 4) if len(small) >= k]
    out += [f"v {small[-1][1].lower()} {min(small[-1][0], 6)} {w[-2:]}"] if small else []
    out += [f"x {len(shape) > 1 and p[:1] == 'A'} {w[:1] == 'A'}", f"c {words[i].endswith(',')}"]
    return [zlib.crc32(x.encode()) & (WEIGHTS - 1) for x in out]


@dataclass
class Terminal:
    """Terminal-context model: weights of contexts, and counts of name endings."""

    weights: np.ndarray
    endings: dict[str, tuple[int, int]]

    def ends_sentence(self, words: list[str]) -> float:
        return float(1 / (1 + np.exp(-self.weights[context(words, len(words) - 1)].sum())))

    def ends_name(self, name: str) -> float:
        """Probability that a capitalised word is complete, by its last four letters or, if they are too rare, three."""
        for n in (4, 3):
            yes, no = self.endings.get(name.lower()[-n:], (0, 0))
            if yes + no >= 4:
                return yes / (yes + no)
        return 0.0


def sentences(answer: str) -> list[list[str]]:
    """Complete sentences of an answer, as words without their final sign."""
    out = []
    for s in _SENTENCE.split(_INVISIBLE.sub(lambda m: "\n" if "\n" in m.group() else " ", answer).strip()):
        if _END.search(s) and len(words := _END.sub("", re.sub(r"^\s*(?:\d+[.)]|[-–•*])\s+", "", s)).split()) >= 4:
            out.append(words)
    return out


def fit_terminal(answers: list[str], epochs: int = 4, seed: int = 7) -> Terminal:
    """Fit the model on the sentences of answers: their ends against all places within them."""
    rows, labels, endings = [], [], Counter()
    for answer in answers:
        for words in sentences(answer):
            for i in range(len(words)):
                rows.append(context(words, i))
                labels.append(i == len(words) - 1)
            for w in words[1:]:
                bare = w.strip("«»“”\"'().,;:!?…").lower()
                if w[:1].isupper() and len(bare) > 4:
                    for j in range(3, len(bare) + 1):
                        for n in (4, 3):
                            endings[bare[max(0, j - n) : j], j == len(bare)] += 1
    weights = np.zeros(WEIGHTS)
    if rows:
        width = max(map(len, rows))
        table = np.full((len(rows), width), WEIGHTS, np.int64)
        for k, r in enumerate(rows):
            table[k, : len(r)] = r
        y = np.array(labels, float)
        weights, squares = np.zeros(WEIGHTS + 1), np.full(WEIGHTS + 1, 1e-6)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 512)):
                x = table[part]
                error = 1 / (1 + np.exp(-weights[x].sum(axis=1))) - y[part]
                slope = np.bincount(x.ravel(), np.repeat(error, width), minlength=WEIGHTS + 1)
                slope[WEIGHTS] = 0
                squares += slope**2
                weights -= 0.3 * slope / np.sqrt(squares)
        weights = weights[:WEIGHTS]
    return Terminal(weights.astype(np.float32), {s: (endings[s, True], endings[s, False]) for s, _ in endings})


def _first_look(ident: str, question: str, answer: str, default: str, model: languages.Languages | None = None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, q, a in zip(batch[ident], batch[question], batch[answer]):
                end = word = None
                if is_empty(a):
                    defect = "empty"
                elif is_copy(q, a):
                    defect = "copy"
                elif is_refusal(a):
                    defect = "refusal"
                elif is_other_language(q, a, default, model):
                    defect = "other_language"
                else:
                    defect = None
                    if (end := tail(a)) is not None:
                        broken = _breaks_off(_INVISIBLE.sub(lambda m: "\n" if "\n" in m.group() else " ", a), end)
                        defect, end = ("truncated" if broken else None), (end if broken is None else None)
                    if end:
                        word = (_WORD.findall(end) or [None])[-1]
                out.append((key, defect, end, word))
            yield pd.DataFrame(out, columns=[ident, "defect", "__tail", "__word"])

    return run


def defects(
    df: DataFrame, ident: str = "example_id", question: str = "question", answer: str = "answer", sample_rows: int = SAMPLE_ROWS, default_language: str = "fr"
) -> DataFrame:
    """(ident, defect) of each pair, defect null where there is none; ident must be unique.

    empty, copy, refusal and other_language are told row by row, in this order. Answers left that don't end in a
    sentence's final sign are truncated if a sign shows it (a hyphen, a comma, an open quotation or bracket, a bare
    list number), if their last word is no word, i.e. stands nowhere in the table but at an unfinished end, or if the
    terminal-context model, fitted on at most ``sample_rows`` answers, finds no sentence's end there. A null question
    leaves empty, refusal, truncated and other_language (against the default language). Answers of up to three words
    are complete.
    """
    rows = df.select(ident, question, answer)
    texts = rows.where(F.col(answer).isNotNull()).select(F.col(answer).alias("a"))
    sample = [r["a"] for r in texts.orderBy(F.xxhash64("a"), "a").limit(sample_rows).collect()]
    model, spoken = fit_terminal(sample), languages.fit(sample)
    key = T.StructField(ident, df.schema[ident].dataType)
    string = lambda c: T.StructField(c, T.StringType())
    seen = cut(rows.mapInPandas(_first_look(ident, question, answer, default_language, spoken), T.StructType([key, string("defect"), string("__tail"), string("__word")])))
    # words that stand before another word somewhere, counted over all texts
    words = F.expr(f"regexp_extract_all(lower(concat_ws(' \\n ', `{question}`, `{answer}`)), '([\\\\p{{L}}\\\\p{{N}}]+)(?=[^\\\\p{{L}}\\\\p{{N}}\\n]+[\\\\p{{L}}\\\\p{{N}}])', 1)")
    known = rows.select(F.explode(F.array_distinct(words)).alias("__known")).groupBy("__known").agg(F.count(F.lit(1)).alias("__n"))
    open_ends = seen.where(F.col("__tail").isNotNull())
    wanted = open_ends.select(F.lower("__word").alias("__known")).distinct()
    known = known.join(wanted, "__known").where(F.col("__n") >= 2)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for end, word, n in zip(batch["__tail"], batch["__word"], batch["__n"]):
                words = end.split()
                broken = len(words) == 1 or model.ends_sentence(words) < LEAST_TERMINAL
                if word and pd.isna(n) and not word.isdigit() and not (word.isupper() and len(word) > 1):
                    broken |= not word[:1].isupper() or model.ends_name(word) < LEAST_TERMINAL
                out.append("truncated" if broken else None)
            yield pd.DataFrame({ident: batch[ident], "defect": out})

    joined = open_ends.join(known, F.lower("__word") == F.col("__known"), "left").select(ident, "__tail", "__word", "__n")
    told = joined.mapInPandas(judge, T.StructType([key, string("defect")]))
    return seen.where(F.col("__tail").isNull()).select(ident, "defect").unionByName(told)

"""Languages of short texts: dictionaries of frequent words, scripts, and word weights learned from a sample of texts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np

from lexiloom.llm.words import COMMON

LANGUAGES = tuple(COMMON)
#: Scripts by the ranges of their letters. A language of its own here is its script.
SCRIPTS = {
    "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ", "armenian": "԰-֏", "hebrew": "֐-׿", "arabic": "؀-ۿݐ-ݿ", "devanagari": "ऀ-ॿ", "bengali": "ঀ-৿", "tamil": "஀-௿",
    "thai": "฀-๿", "georgian": "Ⴀ-ჿ", "hangul": "ᄀ-ᇿ가-힯", "kana": "぀-ヿ", "han": "㐀-䶿一-鿿",
}
#: Letters and signs that tell languages of the Latin script.
HINTS = {"es": "ñ¿¡", "de": "ßäöü", "fr": "çèêàùœîûâ", "pt": "ãõ", "pl": "ąęłśźż", "sv": "åäö", "tr": "ğşı", "ro": "ășț", "cs": "ěřůčž"}
#: Logit of each dictionary word or tell-tale letter; probability from which a language is a possible one of a question.
EVIDENCE, POSSIBLE = 1.5, 0.05
#: Weights of a model, and features of a word: itself, its first and its last three letters.
WEIGHTS, FEATURES = 1 << 16, 3
#: Words of the snippets that weights are learned from: as few as short questions have.
SNIPPET = (3, 4, 6, 10)

_HINTS = {LANGUAGES.index(k): frozenset(v) for k, v in HINTS.items()}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2e80-\uffef\U00020000-\U0003ffff]")
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(1)
def _dictionary() -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, language in enumerate(LANGUAGES):
        for w in dict.fromkeys(COMMON[language]):
            out.setdefault(w, []).append(k)
    return out


def script(text: str) -> str | None:
    """The script other than Latin that most letters are of; kana anywhere among Han letters makes kana; else null."""
    if not _BEYOND_LATIN.search(text):
        return None
    found = Counter({k: len(p.findall(text)) for k, p in _SCRIPTS.items()})
    if found["kana"]:
        found["kana"] += found.pop("han", 0)
    name, n = found.most_common(1)[0]
    return name if n and 2 * n >= sum(map(len, _LETTERS.findall(text))) else None


def words_of(text: str) -> list[str]:
    """Distinct words in lower case, in order; a text that is mostly spelled out is left without its single letters."""
    words = _LETTERS.findall(text.lower())
    if sum(len(w) == 1 for w in words) > 0.6 * len(words):
        words = [w for w in words if len(w) > 1]
    return list(dict.fromkeys(words))


def evidence(text: str, words: list[str]) -> np.ndarray:
    """For each language the dictionary words and tell-tale letters (two at most) of a text."""
    out = np.zeros(len(LANGUAGES))
    for w in words:
        for k in _dictionary().get(w, ()):
            out[k] += 1
    if not text.isascii():
        signs = re.findall("[^\x00-\x7f]", text.lower())
        for k, letters in _HINTS.items():
            out[k] += min(2, sum(c in letters for c in signs))
    return out


@lru_cache(100_000)
def _features(word: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(x.encode()) & (WEIGHTS - 1) for x in (f"w{word}", f"^{word[:3]}", f"{word[-3:]}$"))


class Languages:
    """Probabilities of the languages of a text: dictionary evidence plus learned weights of its words."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights

    def logits(self, text: str) -> np.ndarray:
        words = words_of(text)
        out = EVIDENCE * evidence(text, words)
        if self.weights is not None and words:
            out += self.weights[[f for w in words for f in _features(w)]].sum(axis=0)
        return out

    @staticmethod
    def _shares(logits: np.ndarray) -> np.ndarray:
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def possible(self, text: str, default: str) -> set[str]:
        """Every language that a text may well be in; the default one if nothing tells it. Ties are no evidence: a text
        whose words are of several languages alike may be in each of them."""
        if other := script(text):
            return {other}
        logits = self.logits(text)
        if logits.max() - logits.min() < 0.5:
            return {default}
        return {LANGUAGES[k] for k in np.flatnonzero(self._shares(logits) >= POSSIBLE)}

    def clearly_other(self, text: str, possible: set[str]) -> str | None:
        """The language of a text if it is clearly none of the possible ones."""
        if other := script(text):
            return None if other in possible else other
        if len(words_of(text)) < 2:
            return None
        logits = self.logits(text)
        inside = [k for k, language in enumerate(LANGUAGES) if language in possible]
        best = int(logits.argmax())
        margin = logits[best] - max((logits[k] for k in inside), default=0.0)
        return LANGUAGES[best] if best not in inside and margin >= 2 * EVIDENCE else None


def fit(texts: list[str], epochs: int = 3, seed: int = 7) -> Languages:
    """Learn word weights from texts whose language their dictionary words tell: at least three of them, and twice as
    many as of any other language. The snippets show a text's content words with and without their dictionary words,
    so that these alone come to tell the language. Without such texts the dictionaries decide alone.
    """
    rows, labels, priors = [], [], []
    pick = np.random.default_rng(seed)
    for text in texts:
        words = words_of(text)
        found = evidence(text, words)
        order = np.argsort(found)
        if len(words) < 3 or found[order[-1]] < 3 or found[order[-1]] < 2 * found[order[-2]]:
            continue
        for size in SNIPPET:
            at = int(pick.integers(0, max(1, len(words) - size + 1)))
            part = words[at : at + size]
            rows.append([f for w in part for f in _features(w)])
            labels.append(int(order[-1]))
            priors.append(evidence(" ".join(part), part) if pick.random() < 0.5 else np.zeros(len(LANGUAGES)))
    if not rows:
        return Languages()
    width = max(map(len, rows))
    table = np.full((len(rows), width), WEIGHTS, np.int64)
    for k, r in enumerate(rows):
        table[k, : len(r)] = r
    wanted, prior = np.eye(len(LANGUAGES))[labels], EVIDENCE * np.array(priors)
    weights, squares = np.zeros((WEIGHTS + 1, len(LANGUAGES))), np.full((WEIGHTS + 1, len(LANGUAGES)), 1e-6)
    for _ in range(epochs):
        for part in np.array_split(pick.permutation(len(rows)), max(16, len(rows) // 512)):
            x = table[part]
            logits = prior[part] + weights[x].sum(axis=1)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = p / p.sum(axis=1, keepdims=True) - wanted[part]
            used, place = np.unique(x, return_inverse=True)
            place = place.reshape(x.shape)
            slope = np.stack([np.bincount(place.ravel(), np.repeat(error[:, k], width), len(used)) for k in range(len(LANGUAGES))], axis=1)
            slope[used == WEIGHTS] = 0
            squares[used] += slope**2
            weights[used] -= 0.3 * slope / np.sqrt(squares[used])
    return Languages(weights[:WEIGHTS].astype(np.float32))

"""Toxicity from a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents and zero-width characters, maps homoglyphs
(Cyrillic, Greek, full-width) and digit or sign substitutions to Latin letters,
so ``1d!0t`` and its Cyrillic twin read ``idiot``. Signs and digits are folded
only inside words that also have letters.

The lexicon is learnt from labelled documents: whole words and word prefixes
(stems that take endings) are picked greedily, each the one that covers most
toxic documents not covered yet while hardly occurring in clean ones; weights
are smoothed log odds. Exception phrases, given or learnt as neighbouring words
under which a term occurs in clean documents only, cancel a match. The summed
weights, and the sum divided by a power of the length, enter a logistic curve.

One automaton holds all terms with a boundary before them and, for whole words,
after. Null and empty texts get the score of a text without matches. Repeated
rows, and rows of a null id, get the same score each; nothing is learnt from a
null id or from one labelled both ways. Without labels of both classes the
lexicon is empty. A column named like a result is replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import unicodedata

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from strandlake.llm.flat import appended

#: Training: at most this many documents of each class, and characters in total.
TRAIN_PER_CLASS, TRAIN_CHARS = 2000, 7_000_000
#: Terms of the lexicon, prefix lengths tried, and the smallest log odds and number of documents of a term.
TERMS, PREFIXES, LEAST_ODDS, LEAST_DOCS = 400, (4, 5, 6, 7, 8), 3.0, 4
#: Log odds from which a term is taken though other terms cover its documents.
STRONG_ODDS = 4.0

# Homoglyphs of Latin letters
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y",
    "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v",
    "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ʟ": "l", "ø": "o", "ł": "l",
}
# Digits and signs that stand for letters
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}
# Characters without width
INVISIBLE = "­​‌‍⁠﻿"
# Phrases in which a term is not abuse
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pond scum", "soap scum", "dummy variable")


def _plain(ch: str) -> str:
    """Letters and digits a character folds to."""
    low = ch.lower()
    if low in HOMOGLYPHS:
        return HOMOGLYPHS[low]
    parts = unicodedata.normalize("NFKD", low)
    kept = "".join(HOMOGLYPHS.get(c, c) for c in parts if not unicodedata.combining(c))
    return kept


class _Fold(dict):
    """str.translate table filled on demand: words keep letters, digits and substitute signs, all else is a space."""

    def __missing__(self, cp: int):
        ch = chr(cp)
        if ch in INVISIBLE:
            out = ""
        else:
            kept = _plain(ch)
            out = "".join(c if c.isalnum() or c in SUBSTITUTES else " " for c in kept)
            if unicodedata.combining(ch):
                out = ""
        self[cp] = out
        return out


_FOLD = _Fold()
_SIGNS = str.maketrans({k: v for k, v in SUBSTITUTES.items()})
_ENDS = "".join(k for k in SUBSTITUTES if not k.isalnum())


def fold(text: str | None) -> str:
    """Folded words with one space around each."""
    words = (text or "").translate(_FOLD).split()
    out = []
    for w in words:
        if w.isalpha():
            out.append(w)
            continue
        core = w.rstrip(_ENDS)  # trailing signs are punctuation
        if not any(map(str.isalpha, core)):
            continue
        out.append(core.translate(_SIGNS))
    return f" {' '.join(out)} "


class Lexicon:
    """Terms with weights, exceptions and the curve that scores a text."""

    def __init__(self, terms: dict[str, float], exceptions=EXCEPTIONS, curve=(-4.0, 1.0, 0.0)):
        """``terms``: a word, or a prefix with a trailing ``*``, and its weight."""
        self.terms, self.exceptions, self.curve = dict(terms), tuple(exceptions), tuple(curve)
        self._automaton = None

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            found: dict[str, tuple[str, float]] = {}
            for term, weight in self.terms.items():
                core = fold(term.rstrip("*")).strip()
                if core:
                    for form in {core, core.replace("l", "i")}:  # 1 may stand for l as well
                        key = f" {form}" if term.endswith("*") else f" {form} "
                        found[key] = max(found.get(key, (term, -math.inf)), (term, weight), key=lambda x: x[1])
            for key, value in found.items():
                a.add_word(key, ("term", len(key), *value))
            for phrase in self.exceptions:
                key = fold(phrase)
                if key.strip():
                    a.add_word(key, ("except", len(key), phrase, 0.0))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, text: str | None) -> tuple[list[tuple[int, int, str, float]], int]:
        """(start, end, term, weight) in the folded text, none inside an exception phrase; number of words."""
        folded = fold(text)
        if not len(self.automaton):
            return [], folded.count(" ") - 1
        hits, free = {}, []
        for end, (kind, size, term, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if kind == "except":
                free.append((start, end))
            elif start not in hits or weight > hits[start][3]:
                hits[start] = (start, end, term, weight)
        # one sweep in order of starts: a hit is inside a phrase if the furthest end of those begun so far is not before its own
        free.sort()
        out, at, reach = [], 0, -1
        for hit in sorted(hits.values()):
            while at < len(free) and free[at][0] <= hit[0]:
                reach = max(reach, free[at][1])
                at += 1
            if reach < hit[1]:
                out.append(hit)
        return out, max(folded.count(" ") - 1, 0)

    def features(self, texts: list) -> np.ndarray:
        rows = []
        for text in texts:
            found, n = self.matches(text)
            total = sum(h[3] for h in found)
            rows.append((1.0, math.log1p(total), total / (1 + n) ** 0.5))
        return np.array(rows).reshape(len(rows), 3)

    def score(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.curve), -30, 30)))

    def fit_curve(self, texts: list, toxic: np.ndarray) -> Lexicon:
        x, w = self.features(texts), np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
            w = w + np.clip(np.linalg.solve(hess, x.T @ (toxic - p) - 0.05 * w), -3, 3)
        self.curve = tuple(float(v) for v in w)
        return self


def learn(texts: list[str], toxic: np.ndarray, exceptions=EXCEPTIONS) -> Lexicon:
    """Greedy lexicon, learnt exceptions and curve from labelled texts."""
    yes, no = int(toxic.sum()), int((1 - toxic).sum())
    if not yes or not no:
        return Lexicon({}, exceptions, (math.log((yes + 0.5) / (no + 0.5)) if yes + no else -4.0, 0.0, 0.0))
    where: dict[str, set[int]] = {}
    clean: dict[str, int] = {}
    beside: dict[str, set[str]] = {}
    for i, text in enumerate(texts):
        line = fold(text).split()
        words = {w for w in line if 2 < len(w) < 40}
        found = words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) >= k}
        if toxic[i]:
            for term in found:
                where.setdefault(term, set()).add(i)
            for before, w in zip(["", *line], line, strict=False):
                for term in (w, *(f"{w[:k]}*" for k in PREFIXES if len(w) >= k)):
                    beside.setdefault(term, set()).add(before)
        else:
            for term in found:
                clean[term] = clean.get(term, 0) + 1

    def odds(term: str) -> float:
        return math.log((len(where[term]) + 0.5) / (yes + 1)) - math.log((clean.get(term, 0) + 0.5) / (no + 1))

    def varied(term: str, least: int) -> bool:
        """Whether enough different words stand before the term; in copies of one document the same one does."""
        return len(beside.get(term, ())) >= max(least, 0.4 * len(where[term]))

    def narrowed(term: str) -> str:
        """The longest stem, or the word, that is in nearly all documents of a stem: short stems hit harmless words."""
        if not term.endswith("*"):
            return term
        core, most = term[:-1], 0.95 * len(where[term])
        inner = [t for t, ids in where.items() if t.startswith(core) and len(ids) >= most]
        return max(inner, key=lambda t: (not t.endswith("*"), len(t), t))

    fewest = min(LEAST_DOCS, max(3, yes // 50))
    pool = {t for t, ids in where.items() if len(ids) >= fewest and odds(t) >= LEAST_ODDS and varied(t, 3)}
    terms: dict[str, float] = {}
    covered: set[int] = set()
    while pool and len(terms) < TERMS:
        # of equal cover the longer stem, and a whole word before a stem
        best = max(pool, key=lambda t: (len(where[t] - covered) * min(odds(t), 8), not t.endswith("*"), len(t), t))
        gain = len(where[best] - covered)
        if gain < 2:
            break
        best = narrowed(best)
        terms[best] = odds(best)
        covered |= where[best]
        pool = {t for t in pool if t != best and len(where[t] - covered) >= 2}
    # terms that always stood beside chosen ones need stronger evidence
    strong = [t for t in where if t not in terms and odds(t) >= STRONG_ODDS and varied(t, 12)]
    for term in sorted(strong, key=lambda t: (-len(where[t]), t.endswith("*"), -len(t), t)):
        core = term.rstrip("*")
        kin = any(core.startswith(c.rstrip("*")) if c.endswith("*") else term.endswith("*") and c.startswith(core) for c in terms)
        longer = term.endswith("*") and any(c.endswith("*") and c.startswith(core) for c in terms)
        if not kin and not longer and len(terms) < TERMS:
            term = narrowed(term)
            terms[term] = odds(term)
    # a clean document with a term shows phrases in which the term is harmless
    lexicon = Lexicon(terms, exceptions)
    harmless: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        folded = fold(text)
        for start, end, _, _ in lexicon.matches(text)[0]:
            stop = folded.find(" ", max(end, start + 1))
            word = folded[start + 1 : stop if stop > 0 else end]
            before = folded[:start].rsplit(" ", 1)[-1]
            after = folded[stop + 1 :].split(" ", 1)[0] if stop > 0 else ""
            for phrase in (f"{before} {word}", f"{word} {after}"):
                if " " in phrase.strip():
                    harmless.setdefault(phrase, [0, 0])[int(toxic[i])] += 1
    learnt = sorted(p for p, (c, t) in harmless.items() if c >= 3 and t == 0)
    return Lexicon(terms, [*exceptions, *learnt]).fit_curve(texts, toxic)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Lexicon:
    """Learn from labelled documents outside the held-out fold (a bounded sample, see the constants)."""
    from strandlake.llm.sampling import training_rows

    rows = training_rows(docs, labels, "toxic", modulus, held_out, TRAIN_PER_CLASS, TRAIN_CHARS)
    return learn(list(rows["text"]), rows["label"].to_numpy(dtype=np.int64))


def classify(docs: DataFrame, lexicon: Lexicon, terms: bool = False, keep_text: bool = False) -> DataFrame:
    """Adds score (and the terms matched) to the columns of ``docs``; the text goes unless ``keep_text``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make(texts):
        found = [[h[2] for h in shared.value.matches(t)[0]] for t in texts] if terms else None
        return {"score": shared.value.score(texts), "terms": found}

    return appended(docs, "text", make, "score double" + ", terms array<string>" * terms, drop=not keep_text)

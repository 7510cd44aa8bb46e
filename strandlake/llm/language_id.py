"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text of a language recognises exactly the
substrings of that text. Parsing a text greedily into longest matches gives
phrases; text of the same language has longer matches and so fewer phrases per
character (the cross-parsing of Ziv and Merhav, 1993). The language whose
automaton needs the fewest phrases wins; the score is a softmax of the phrase
counts, so 1 means that no other language comes near.

The automaton is a dense table over a small alphabet: letters of the training
text (in several scripts each language's commonest, the rest hashed to a few
symbols), space and one symbol for everything else. Entry (state, symbol)
holds the next state, and a flag if no transition exists and a new phrase
begins with that symbol. Texts are parsed in lanes: each step moves all lanes of
a batch by one symbol with array operations. Lanes are pieces of ``LANE``
characters of a text, so long texts don't hold up short ones; a phrase ends at
the end of a lane. Texts are parsed whole.

Null texts and texts without a letter get ``und`` and score 0. With nothing to
learn from, every text gets ``und``. Ties go to the language that sorts first.
Repeated rows, and rows of a null id, get the same result each, and nothing is
learnt from a null id. A column named like a result is replaced; others stay.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.flat import appended
from strandlake.llm.sampling import fold
from strandlake.plans.lineage import cut, spent

#: Characters of training text per language and of all languages, the largest alphabet, and characters of a lane.
TRAIN_CHARS, TOTAL_CHARS, SYMBOLS, LANE = 60_000, 900_000, 56, 1024
#: Of the alphabet, the symbols shared by letters that have none of their own.
HASHED = 16
#: Languages with fewer training documents than this are left out; the documents of a language and characters of each looked at.
MIN_DOCS, TRAIN_DOCS, DOC_CHARS = 3, 600, 15_000
UNKNOWN = "und"


def alphabet(*languages: list[str]) -> dict[int, int]:
    """Code point to symbol of the letters in the texts of each language: 0 is space, 1 any other character.

    Where letters outnumber the symbols, languages choose their commonest in
    turn, and the rest are hashed to the last HASHED symbols.
    """
    ranked, total = [], {}
    for texts in languages:
        counts: dict[str, int] = {}
        for text in texts:
            for ch in text.lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        ranked.append(sorted(counts, key=lambda c: (-counts[c], c)))
        for c, n in counts.items():
            total[c] = total.get(c, 0) + n
    common = sorted(total, key=lambda c: (-total[c], c))
    if len(common) <= SYMBOLS - 2:
        return {ord(c): i + 2 for i, c in enumerate(common)}
    own = SYMBOLS - 2 - HASHED
    turns = dict.fromkeys(row[i] for i in range(own) for row in ranked if i < len(row))
    out = {ord(c): i + 2 for i, c in enumerate([*turns][:own])}
    return {ord(c): own + 2 + (ord(c) * 2654435761 % 2**32 >> 16) % HASHED for c in common} | out


def symbol_table(letters: dict[int, int]) -> np.ndarray:
    """Symbol of every code point; runs of what isn't a letter become one space later."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for cp in range(len(table)):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = letters.get(ord(low[0]), 1)
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text with each run of spaces reduced to one, and one at both ends."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = table[points]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def suffix_automaton(text: np.ndarray, size: int) -> np.ndarray:
    """Transitions (states, size) of the suffix automaton of ``text``; -1 where there is none."""
    n = len(text)
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), size), -1, dtype=np.int32)
    for state, row in enumerate(nxt):
        for c, target in row.items():
            table[state, c] = target
    assert len(nxt) <= 2 * n + 1
    return table


def steps(automaton: np.ndarray) -> np.ndarray:
    """Flat step table: 2 * (next state * symbols) + 1 if a new phrase begins here.

    One state is added, the last: between phrases. A lane begins there, and it
    follows a symbol that the text doesn't have, which is a phrase of its own.
    """
    states, width = automaton.shape
    root = automaton[0]
    again = np.where(root >= 0, root, states).astype(np.int64) * width * 2 + 1
    table = np.where(automaton >= 0, automaton.astype(np.int64) * width * 2, again[None, :])
    return np.ascontiguousarray(np.concatenate((table, again[None, :])).reshape(-1), dtype=np.int32)


def phrases(lanes: np.ndarray, sizes: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Phrases of each lane. ``lanes`` is (LANE, n), ``sizes`` are lane lengths in descending order."""
    n = len(sizes)
    state, count = np.full(n, len(table) - width, dtype=np.int32), np.zeros(n, dtype=np.int64)
    live = n
    for t in range(int(sizes[0]) if n else 0):
        while live and sizes[live - 1] <= t:
            live -= 1
        moved = table.take(state[:live] + lanes[t, :live])
        count[:live] += moved & 1
        state[:live] = moved >> 1
    return count


class Model:
    """Languages, the symbol table and one step table per language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        letters = alphabet(*(samples[name] for name in self.names))
        self.table = symbol_table(letters)
        self.width = width = max(letters.values(), default=1) + 1
        self.steps = []
        for name in self.names:
            text = np.concatenate([symbols(t, self.table) for t in samples[name]])[: min(TRAIN_CHARS, TOTAL_CHARS // len(self.names))]
            self.steps.append(steps(suffix_automaton(text, width)))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Phrases (texts, languages)."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            s = symbols(text, self.table)
            for a in range(0, len(s), LANE):
                pieces.append(s[a : a + LANE])
                owner.append(i)
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        if not pieces:
            return out
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        lanes = np.zeros((int(sizes.max()), len(pieces)), dtype=np.int32)
        for k, i in enumerate(order):
            lanes[: sizes[i], k] = pieces[i]
        who = np.array(owner)[order]
        for j, table in enumerate(self.steps):
            out[:, j] = np.bincount(who, weights=phrases(lanes, sizes[order], table, self.width), minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.names or not lettered:
            return names, scores
        counts = self.counts([texts[i] for i in lettered])
        for i, row in zip(lettered, counts, strict=True):
            best = int(np.argmin(row))
            names[i] = self.names[best]
            scores[i] = float(1 / np.exp(np.minimum(0.5 * (row[best] - row), 0)).sum())
        return names, scores


def samples_of(docs: DataFrame, modulus: int, held_out: int) -> dict[str, list[str]]:
    """Training texts of each language: documents of any length, first by a hash of the id.

    Every language with MIN_DOCS training documents that have a letter is learnt,
    however many languages there are and however many of its rows are null, empty
    or held out. Bounded for each by TRAIN_DOCS documents, the first DOC_CHARS
    characters of a document and TRAIN_CHARS in all (TOTAL_CHARS over all
    languages, and a third of a language's part of that for a document): sizes
    are summed before any text moves to the driver. Equal texts count once.
    """
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.substring(F.col("text").cast("string"), 1, DOC_CHARS).alias("text"),
    ).where("lang is not null and doc_id is not null").where(F.col("text").rlike("\\p{L}"))
    known = known.where(F.pmod(fold(), F.lit(modulus)) != held_out)
    # a language's documents are thinned by their hash to about twice what is wanted, so no task sorts more than that
    per = known.groupBy("lang").agg(F.count("*").alias("n"))
    wide = per.where(F.col("n") >= MIN_DOCS).collect()
    if not wide:
        return {}
    least = [(r["lang"], min(2 * TRAIN_DOCS / r["n"], 1.0)) for r in wide]
    share = docs.sparkSession.createDataFrame([(n, -(2**63) + min(int(x * 2**64), 2**64 - 1)) for n, x in least], "lang string, most long")
    keyed = known.select("lang", "doc_id", F.length("text").alias("size"), F.xxhash64("doc_id").alias("h")).join(F.broadcast(share), "lang").where("h <= most")
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "size")
    few = cut(keyed.drop("most").withColumn("r", F.row_number().over(first)).where(F.col("r") <= TRAIN_DOCS))
    names = sorted(r["lang"] for r in few.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).collect())
    chosen: dict[str, dict[int, int]] = {}
    if names:
        most = min(TRAIN_CHARS, max(TOTAL_CHARS // len(names), MIN_DOCS))
        clip = min(DOC_CHARS, max(most // MIN_DOCS, 1))
        running = Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        enough = few.where(F.col("lang").isin(names)).withColumn("before", F.coalesce(F.sum(F.least("size", F.lit(clip))).over(running), F.lit(0)))
        for r in enough.where((F.col("before") < most) | (F.col("r") <= MIN_DOCS)).select("lang", "doc_id", "r").collect():
            chosen.setdefault(r["lang"], {})[r["doc_id"]] = r["r"]
    spent(few)
    if not chosen:
        return {}
    rows = [(name, i, r) for name, ids in chosen.items() for i, r in ids.items()]
    picked = docs.sparkSession.createDataFrame(rows, "lang string, doc_id long, r int")
    texts = known.join(F.broadcast(picked), ["lang", "doc_id"]).select("lang", "r", F.substring("text", 1, clip).alias("text")).toPandas()
    texts = texts.sort_values(["lang", "r", "text"]).drop_duplicates(["lang", "text"])
    return {name: list(group["text"]) for name, group in texts.groupby("lang")}


def classify(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """Adds lang_pred and score to the columns of ``docs``; the text goes unless ``keep_text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        names, scores = shared.value.predict(texts)
        return {"lang_pred": names, "score": scores}

    return appended(docs, "text", make, "lang_pred string, score double", drop=not keep_text)


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> Model:
    """Learn from (doc_id, text, lang) rows outside the held-out fold."""
    return Model(samples_of(docs, modulus, held_out))

"""The language model and the source audit against plain versions, and their edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import TABLES, needs_tables
from strandlake.llm import maxent_lm, queries, source_audit
from strandlake.llm.words import LETTERS, SPACED, split

ROWS = [
    (0, "the cat sat on the mat.", "en", "a"), (1, "The dog sat on the log.", "en", "b"), (2, None, None, "a"), (3, "", "en", None),
    (4, "the cat and the dog", None, None), (4, "the cat and the dog", None, None), (None, "die Katze saß auf der Matte", "de", "a"),
    (6, "Ünder DER Ünder der", "de", "b"), (7, "x\x0by\x1cz 12 the-cat", "en", "c"), (2**60 + 1, "### 42", "xx", "only"),
]


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return made.select("*", *[F.lit("x").alias(c) for c in ("score", "_key", "term", "count", "rank", "value", "token", "rest")]).repartition(3).cache()


def test_split():
    words, sizes = split(pa.array(["  Ab\tcÉ\x1cd ", None, "", "é!A9"])[1:], LETTERS)
    assert (words.to_pylist(), sizes.tolist()) == (["é", "a"], [0, 0, 2])
    words, sizes = split(pa.array(["  Ab\tcÉ\x1cd ", "x\r\ny"]), SPACED)
    assert (words.to_pylist(), sizes.tolist()) == (["ab", "cÉ\x1cd", "x", "y"], [2, 2])


def plain_base(rows, held):
    count = Counter()
    for i, text in rows:
        if not held(i):
            count.update(tokens(text))
    n, v = sum(count.values()), len(count)
    scale = math.log10(n + 0.5 * (v + 1))
    return n, count, lambda t: sum(math.log10(count[w] + 0.5) - scale for w in tokens(t))


@needs_tables
def test_base_scores_and_fold(spark):
    got = queries.QUERIES["op11_maxent_lm"](spark, str(TABLES)).toPandas()
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    n, count, base = plain_base(rows, held)
    assert list(got.columns) == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    text = dict(rows)
    assert len(got) == len(rows) and (got["train_tokens"] == n).all()
    for r in got.itertuples():
        words = tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known) == (held(r.doc_id), len(words), sum(count[w] > 0 for w in words))
        assert r.base_score == pytest.approx(base(text[r.doc_id]), abs=1e-6) and r.score < 0
    out = got[got["held_out"]]
    assert out["score"].sum() > out["base_score"].sum() * 0.98  # nearer to zero


def test_chances_sum_to_one(spark, docs):
    """Over every token, seen or not, after any words."""
    model = maxent_lm.fit(docs)
    for before in ([], ["the"], ["the", "cat"], ["nowhere", "seen", "the"]):
        known = model.listed.to_pylist()
        total = 0.0
        for word in [*known, "zzq", "\n"]:
            words = pa.array([*before, *([] if word == "\n" else [word])], pa.large_string())
            ids, place = model.ids(words)
            found = maxent_lm.log_chances(model, ids, np.array([len(words)]))[len(before)]
            total += 10**found * (1.0 if word == "\n" or 0 <= place[-1] < maxent_lm.HEAD - 1 else 0.0)
        # the classes of all other tokens: none is seen beside the head here, so each is its one unseen token
        for ending in range(maxent_lm.ENDINGS):
            assert model.mass[ending] == 0.5
        ids, _ = model.ids(pa.array([*before, "q"], pa.large_string()))
        toks, hashes = maxent_lm._contexts(ids, np.array([len(ids)]))
        p = maxent_lm._chances(model.bias, model.weights[0], maxent_lm._rows(hashes))[len(before)]
        assert total + p[maxent_lm.HEAD // maxent_lm.WORDS :].sum() == pytest.approx(1, abs=1e-4)


def test_context_lowers_surprise(spark):
    """What always follows is likelier than by its frequency."""
    rows = [(i, "alpha beta gamma delta " * 20 + ("beta alpha " if i % 2 else "delta gamma ") * 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = maxent_lm.score(docs, maxent_lm.fit(docs)).toPandas()
    assert (found["score"] > 0.6 * found["base_score"]).all()


def test_model_edge_cases(spark, docs, monkeypatch):
    monkeypatch.setattr(maxent_lm, "LISTED", 4)  # most tokens are joined
    n, count, base = plain_base([(r[0], r[1]) for r in ROWS], lambda i: i == 1)
    model = maxent_lm.fit(docs, F.coalesce(F.col("doc_id") == 1, F.lit(False)))
    got = maxent_lm.score(docs, model).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((r[0] is None, r[0]) for r in ROWS)
    text = {r[0]: r[1] for r in ROWS}
    for r in got:
        words = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base(text[r.doc_id])) and math.isfinite(r.score)
    same = [r.score for r in got if r.doc_id == 4]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])


def test_model_of_nothing(spark, docs):
    none = docs.where("doc_id = -5")
    assert maxent_lm.score(none, maxent_lm.fit(none)).count() == 0
    got = maxent_lm.score(docs, maxent_lm.fit(docs, F.lit(True))).collect()
    assert len(got) == len(ROWS) and all(abs(r.base_score) < 1e-12 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def test_long_text_is_one_sum(spark):
    """A text of many blocks scores as its parts do, but for the contexts at their seams and their ends."""
    words = " ".join(f"w{i * i % 977}" for i in range(60_000))
    docs = spark.createDataFrame([(1, words), (2, "w1 w4 w9")], "doc_id long, text string")
    n, _, base = plain_base([(1, words), (2, "w1 w4 w9")], lambda i: False)
    got = {r.doc_id: r for r in maxent_lm.score(docs, maxent_lm.fit(docs)).collect()}
    assert got[1].n_tokens == 60_001 and got[1].train_tokens == n and got[1].base_score == pytest.approx(base(words))


# -- the audit ------------------------------------------------------------


def plain_audit(rows, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    groups, seen = {}, {}
    for _, text, lang, source in rows:
        found = Counter(terms(text))
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(found)
        seen.setdefault(lang or "", Counter()).update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = Counter()
        for c in sources.values():
            whole.update(c)

        def share(c, kept=kept):
            size = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // size for t in kept}

        q, p = share(whole), {s: share(c) for s, c in sources.items()}
        for s, c in sources.items():
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            more = [("term", t, p[s][t] - q[t]) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, limit in ((pairs, None), (more, top)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit]
                out += [(lang, s, kind, item, value, k) for k, (kind, item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(1, 50), (2, 1), (99, 50)])
def test_audit_against_plain_version(spark, docs, least, top):
    got = sorted(tuple(r) for r in source_audit.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(ROWS, least, top)


def test_audit_flushes_and_deals(spark, monkeypatch):
    """Sums that a task lets go early, many sources and a source with most rows."""
    monkeypatch.setattr(source_audit, "HELD", 50)
    rows = [(i, f"w{chr(97 + i % 26)} common {chr(97 + i % 7) * 3}", "en", "big" if i % 3 else f"s{i % 30}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = sorted(tuple(r) for r in source_audit.audit(docs, 30, 5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 30, 5)


def test_audit_of_nothing(spark, docs):
    assert source_audit.audit(docs.where("doc_id = -5")).count() == 0


def test_shares_of_counts_beyond_long(spark):
    """1e9 times a count may not fit a long; the share is exact all the same."""
    count, size = 9 * 10**15 + 7, 10**17 + 3
    got = spark.range(1).select(source_audit._share(F.lit(count), F.lit(size)).cast("long")).first()[0]
    assert got == 1 + 10**9 * (count + 5) // size

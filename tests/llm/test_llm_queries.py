"""Queries against SQL, and the pipeline against a brute-force version."""

from __future__ import annotations

import math
import re
import zlib

import pytest

import corpus_pipeline
from conftest import TABLES, canonical, needs_tables
from strandlake.llm import decontaminate, language_id, line_crf, page_diff, queries, toxicity

pytestmark = needs_tables


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(TABLES)).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


COLUMNS = {
    "op2_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op4_length_buckets": ["doc_id", "n_tokens", "bucket", "bound", "batch_id", "slot"],
    "op5_page_differencing": ["page_id", "url", "text", "n_chars"], "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contracts(spark, name):
    got = queries.QUERIES[name](spark, str(TABLES))
    rows = got.toPandas()
    assert got.columns == COLUMNS[name]
    assert len(rows) == spark.read.parquet(f"{TABLES}/{'pages' if name[2] == '5' else 'documents'}.parquet").count()
    if "held_out" in rows:
        modulus, rest = (5, 0) if name.startswith("op9") else (4, 2)
        assert all(h == (zlib.crc32(str(i).encode()) % modulus == rest) for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))
        assert rows["score"].between(0, 1).all()


def test_buckets_against_brute_force(spark):
    """Padding of the whole table is that of the best bounds, up to the width of bins above 1024; batches are full but for one a shard."""
    got = queries.QUERIES["op4_length_buckets"](spark, str(TABLES)).toPandas()
    texts = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").toPandas()
    sizes = {i: len([w for w in re.split("[\\x20\\x09-\\x0D]+", t or "") if w]) for i, t in zip(texts["doc_id"], texts["text"], strict=True)}
    assert dict(zip(got["doc_id"], got["n_tokens"], strict=True)) == sizes
    assert (got.groupby("bucket")["n_tokens"].max() == got.groupby("bucket")["bound"].first()).all()
    lengths = sorted(v for v in sizes.values() if v)
    tops = sorted(set(lengths))
    below = {t: sum(v <= t for v in lengths) for t in tops}
    best = {t: t * below[t] for t in tops}  # padded size with one bucket, then with one more each round
    for _ in range(15):
        best = {t: min([best[t]] + [best[s] + t * (below[t] - below[s]) for s in tops if s < t]) for t in tops}
    full = got[got["n_tokens"] > 0]
    assert best[tops[-1]] <= full["bound"].sum() <= best[tops[-1]] * (1 + 1 / 512)
    per = got.groupby(["bucket", "batch_id"]).agg(n=("slot", "size"), bound=("bound", "first"), last=("slot", "max"))
    assert ((per["n"] * per["bound"] <= 16_384) | (per["n"] == 1)).all() and (per["last"] == per["n"] - 1).all()


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_pages_against_brute_force(spark):
    """Every page with a neighbour is compared with it, line by line; what is left is the query's text."""
    pages = spark.read.parquet(f"{TABLES}/pages.parquet").toPandas()
    rows = []
    for r in pages.itertuples():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match("[^/?#]*", rest).group().lower()
        rows.append((host, re.match("[^/?#]*([^?#]*)", rest).group(1), r.page_id, r.url, page_diff.blocks(r.html)))
    rows.sort(key=lambda r: (r[0].encode(), r[1].encode(), r[2]))
    want, compared, shared_lines = {}, 0, 0
    for k, (host, _, page_id, _, lines) in enumerate(rows):
        article = any(kind == page_diff.OWN for _, kind in lines)
        gone, inner = set(), []
        for other in (rows[k - 1] if k else None, rows[k + 1] if k + 1 < len(rows) else None):
            if not other or not host or other[0] != host:
                continue
            compared += 1
            same = longest_common([t for t, _ in lines], [t for t, _ in other[4]])
            shared_lines += len(same)

            def own(x):
                with_article = any(kind == page_diff.OWN for _, kind in x)
                return sum(len(t) for t, kind in x if kind == page_diff.OWN or not with_article)

            mine = {i for i in same if lines[i][1] == page_diff.OWN}
            near_copy = 2 * sum(len(lines[i][0]) for i in mine) > min(own(lines), own(other[4]))
            inner.append(set() if near_copy else mine)
            gone |= set(same) - mine
        if len(inner) == 2:  # an article's line goes if both neighbours have it
            gone |= inner[0] & inner[1]
        inside = [i for i, (_, kind) in enumerate(lines) if kind != page_diff.OPEN or not article]
        keep = [i for i in inside if i not in gone] or [i for i in inside if lines[i][1] == page_diff.OWN or not article]
        want[page_id] = " ".join(lines[i][0] for i in keep)
    got = queries.QUERIES["op5_page_differencing"](spark, str(TABLES)).toPandas()
    assert compared > 1.8 * len(rows) - 2 * len({r[0] for r in rows}) and shared_lines > 0
    texts = dict(zip(got["page_id"], got["text"], strict=True))
    whole = {page_id: " ".join(t for t, kind in lines if kind == page_diff.OWN) for _, _, page_id, _, lines in rows}
    assert texts == want == whole and (got["n_chars"] == got["text"].str.len()).all()


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language_id(spark, str(TABLES)).where("held_out").join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def line_numbers(line: bytes, before: bytes | None) -> list[float]:
    """The features of one line, counted one by one."""
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?", b".,", b"\"'()+-/:;=@[\\]^_`{}~"]
    n = [sum(c in k for c in line) for k in kinds] + [sum(c >= 128 for c in line)]
    words, size = line.split(), max(len(line), 1)
    w, letters = len(words), max(n[0] + n[1] + n[7] / 2, 1)
    return [
        math.log1p(len(line)) / 5, math.log1p(w) / 4, n[0] / letters, n[2] / size, math.sqrt(n[3] / size), math.sqrt(n[4] / size), n[5] / w,
        n[6] / size, 1 - len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        sum(x[-1] in kinds[3] + kinds[4] for x in words) / w, min(sum(map(len, words)) / w, 30) / 10, words[0][0] in kinds[0], line[-1] in kinds[5],
        before is not None and before.split() == words, w <= 3,
    ]


def test_quality_scores_against_brute_force(spark):
    """Features line by line, forward-backward cell by cell."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r.score for r in queries.QUERIES["op2_quality_classifier"](spark, str(TABLES)).collect()}

    def lse(a, b):
        top = max(a, b)
        return top + math.log(math.exp(a - top) + math.exp(b - top))

    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode().split(b"\n")
        at = [i for i, x in enumerate(raw) if x.split()]
        own = [line_numbers(raw[i], raw[i - 1] if i else None) for i in at]
        if not own:
            assert got[r.doc_id] == 0
            continue
        none = [0.0] * 16
        unary = []
        for i, x in enumerate(own):
            row = [1.0, *x, *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none)]
            bad = sum((v - m) / d * g for v, m, d, g in zip(row, model.mean, model.scale, model.weights, strict=True))
            unary.append((-bad / 2, bad / 2))
        t = model.trans
        ahead, back = [unary[0]], [(0.0, 0.0)]
        for u in unary[1:]:
            a = ahead[-1]
            ahead.append(tuple(lse(a[0] + t[0][k], a[1] + t[1][k]) + u[k] for k in (0, 1)))
        for u in reversed(unary[1:]):
            b = back[-1]
            back.append(tuple(lse(t[k][0] + u[0] + b[0], t[k][1] + u[1] + b[1]) for k in (0, 1)))
        weight = [len(raw[i]) for i in at]
        bad = [1 / (1 + math.exp(min(a[0] + b[0] - a[1] - b[1], 700))) for a, b in zip(ahead, reversed(back), strict=True)]
        mean = sum(x * y for x, y in zip(weight, bad, strict=True)) / sum(weight)
        want = 1 / (1 + math.exp(-max(min(model.curve[0] + model.curve[1] * mean, 30), -30)))
        assert got[r.doc_id] == pytest.approx(want, abs=1e-6)


def test_languages_against_brute_force(spark):
    """Phrases by searching the training text itself, for documents of up to 1 500 characters."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang")
    samples = language_id.samples_of(docs, 4, 2)
    model = language_id.Model(samples)
    trained = {n: b"".join(language_id.symbols(t, model.table).tobytes() for t in samples[n])[: language_id.TRAIN_CHARS] for n in model.names}
    got = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, str(TABLES)).collect()}
    looked_at = 0
    for r in docs.collect():
        if not r.text or len(r.text) > 1500 or not any(map(str.isalpha, r.text)):
            continue
        looked_at += 1
        text = language_id.symbols(r.text, model.table).tobytes()
        counts = []
        for name in model.names:
            n = 0
            for a in range(0, len(text), language_id.LANE):
                lane, i = text[a : a + language_id.LANE], 0
                while i < len(lane):
                    j = i
                    while j < len(lane) and lane[i : j + 1] in trained[name]:
                        j += 1
                    n, i = n + 1, max(j, i + 1)
            counts.append(n)
        best = min(range(len(counts)), key=lambda k: (counts[k], k))
        assert got[r.doc_id].lang_pred == model.names[best]
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(min(0.5 * (counts[best] - c), 0)) for c in counts), abs=1e-9)
    assert looked_at > 50


def test_toxicity_against_brute_force(spark):
    """Every term tried at every word."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r.score for r in queries.QUERIES["op9_toxicity"](spark, str(TABLES)).collect()}
    forms = {}
    for term, weight in lexicon.terms.items():
        core = toxicity.fold(term.rstrip("*")).strip()
        for form in {core, core.replace("l", "i")} - {""}:
            key = f" {form}" if term.endswith("*") else f" {form} "
            forms[key] = max(forms.get(key, weight), weight)
    phrases = [k for k in map(toxicity.fold, lexicon.exceptions) if k.strip()]
    for r in docs.select("doc_id", "text").collect():
        folded = toxicity.fold(r.text)
        total = 0.0
        for i in (i for i, c in enumerate(folded) if c == " "):
            free = max((i + len(p) - 1 for p in phrases if folded.startswith(p, i)), default=-1)
            found = [(w, i + len(k) - 1) for k, w in forms.items() if folded.startswith(k, i)]
            if found:
                weight, end = max(found)
                covered = any(folded.startswith(p, a) and a + len(p) - 1 >= end for a in range(max(0, i - 60), i + 1) for p in phrases)
                total += 0.0 if covered or free >= end else weight
        n = max(folded.count(" ") - 1, 0)
        z = sum(c * x for c, x in zip(lexicon.curve, (1.0, math.log1p(total), total / math.sqrt(1 + n)), strict=True))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(min(z, 30), -30))), abs=1e-9)


def test_pipeline_against_brute_force(spark):
    got = corpus_pipeline.run(spark, str(TABLES)).toPandas()
    frame = spark.read.parquet(f"{TABLES}/documents.parquet")
    texts = {r.doc_id: r.text for r in frame.collect()}
    model = language_id.fit(frame)
    names, _ = model.predict(list(texts.values()))
    texts = {i: t for (i, t), n in zip(texts.items(), names, strict=True) if n != "und"}
    field = line_crf.fit(frame.where(frame.doc_id.isin(list(texts))), spark.read.parquet(f"{TABLES}/labels.parquet"))
    texts = {i: t for (i, t), s in zip(texts.items(), field.score(list(texts.values()))[0], strict=True) if s >= corpus_pipeline.QUALITY_SCORE}

    def grams(t):
        w = "".join(c.lower() if c < "\x80" else c for c in t).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in sorted(texts.items())}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    kept = [i for i in ids if find(i) == i]
    bench = {w for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect() for w in decontaminate.windows_of(r.text, 10)}
    kept = [i for i in kept if not any(f" {w} " in f" {' '.join(x.decode() for x in decontaminate.normal_words(texts[i]))} " for w in bench)]
    assert sorted(got["doc_id"]) == kept
    assert {r.doc_id: r.n_tokens for r in got.itertuples()} == {i: len(texts[i].split()) for i in kept}
    assert (got["n_tokens"] <= got["bound"]).all() and not got.duplicated(["batch_id", "slot"]).any()

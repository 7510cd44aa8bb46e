"""Each method against a brute-force version or on held-out cases."""

from __future__ import annotations

import itertools
import math
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import (
    decontaminate, divergence, language_id, licenses, line_crf, near_dedup, packing, page_diff, toxicity, url_reputation,
)
from strandlake.llm.flat import Flat
from strandlake.llm.shingles import distinct_shingles
from strandlake.llm.superminhash import signatures

RNG = random.Random(42)
SYLLABLES = {"en": "the er in th on ing ed re", "fr": "eau ou ai é tion le qu ment", "de": "sch ung ein er ü zu keit ge"}


def words(lang, n, rng=RNG):
    parts = SYLLABLES[lang].split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def shingle_set(text, width):
    w = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


# --- words, shingles, signatures


def test_flat_words():
    flat = Flat(["a b\tbb", None, "", " é  a\n"], lower=True)
    assert list(flat.doc) == [0, 0, 0, 3, 3] and list(flat.words) == [3, 0, 0, 2]
    h = flat.hashes()
    assert h[0] == h[4] and len(set(h)) == 4
    assert Flat(["x " * 10 + "a"]).hashes()[10] == h[0]


def test_shingles_and_signatures():
    base = words("en", 300)
    texts = [" ".join(base[:200]), " ".join(base[20:220]), " ".join(base[100:300]), "one", "", "One"]
    doc, value = distinct_shingles(texts, 4)
    sets = [shingle_set(t, 4) for t in texts]
    assert list(np.bincount(doc, minlength=6)) == [len(s) for s in sets]
    sig = signatures(doc, value, 6, 400)
    for i, j in itertools.combinations(range(3), 2):
        exact = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert abs((sig[i] == sig[j]).mean() - exact) < 0.09
    assert (sig[3] == sig[5]).all() and not sig[4].any()


def test_superminhash_is_a_permutation_per_element():
    # with one element every component gets a rank of its own: all values differ
    sig = signatures(np.array([0]), np.array([12345], dtype=np.uint64), 1, 64)
    assert len(set(sig[0])) == 64


# --- near duplicates


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(4):
        base = words("en", 120, rng)
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 10])):
                w[rng.randrange(len(w))] = "x" + str(rng.random())
            texts.append(" ".join(w))
    texts += ["short text", "Short text", "another", None, ""]
    rng.shuffle(texts)
    sets = [shingle_set(t, 4) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (16, 512):  # blocks far smaller than a group, and larger
        got = near_dedup.near_duplicates(docs, width=4, block=block).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(texts))}
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in enumerate(sets)}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def near_copies(n, rng, size=300, most=14):
    base = words("en", size, rng)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = "x" + str(rng.random())
        out.append(" ".join(w))
    return out


def test_a_group_of_near_copies_ships_each_text_about_once(spark, monkeypatch):
    rng = random.Random(9)
    texts = near_copies(600, rng, most=5) + [" ".join(words("fr", 60, rng)) for _ in range(100)]
    shipped = []

    def counted(make):
        def run(*a):
            made = make(*a)
            units = made[0] if isinstance(made, tuple) else made
            shipped.append(units.count() if units is not None else 0)
            return made
        return run

    for name in ("_first_units", "_other_units"):
        monkeypatch.setattr(near_dedup, name, counted(getattr(near_dedup, name)))
    monkeypatch.setattr("strandlake.plans.skew.lookup.__defaults__", (None, None, 4, 20, None))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, block=32).collect()}
    assert got == {i: 0 if i < 600 else i for i in range(700)}
    assert shipped[0] <= 600 + 600 / 32 * 3 and sum(shipped[1:]) <= 2 * 600


def test_strays_and_rows_of_one_id(spark):
    """Chains of groups beside each other, and ids that repeat with different texts, against all pairs."""
    rng = random.Random(12)
    texts = [t for _ in range(6) for t in near_copies(40, rng, size=150, most=22)]
    ids = list(range(len(texts)))
    ids[50], ids[130], ids[7] = 10, 200, 7
    rows = [*zip(ids, texts, strict=True), (7, texts[7]), (None, texts[3]), (None, "all alone here")]
    sets = [shingle_set(t, 5) for t in texts]
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 80 * len(sets[i] | sets[j]):
            a, b = find(ids[i]), find(ids[j])
            up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 128):
        got = near_dedup.near_duplicates(docs, block=block).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(i, find(i)) for i in ids}
        alone = {r.n_shingles: r for r in got if r.doc_id is None}
        assert alone[1].component_id is None and not any(r.kept for n, r in alone.items() if n > 1)


# --- benchmark windows


def test_spans_map_to_the_original():
    item = "Alpha, beta GAMMA delta one two three four five six seven."
    automaton = decontaminate.build([("q", item), ("s", "tiny item")], 10)
    text = "Été: ALPHA beta-gamma...Delta one TWO three four five six; and a Tiny\nitem."
    words_ = decontaminate.normal_words(text)
    ranges, found = decontaminate.scan(automaton, words_)
    spans = decontaminate.word_spans(text)
    assert found == {"q", "s"} and len(spans) == len(words_)
    assert [text[spans[a][0] : spans[b - 1][1]] for a, b in ranges] == ["ALPHA beta-gamma...Delta one TWO three four five six", "Tiny\nitem"]


def test_windows_against_brute_force():
    rng = random.Random(9)
    items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.choice([3, 10, 13])))) for i in range(5)]
    automaton = decontaminate.build(items, 10)
    for _ in range(60):
        w = [rng.choice("abc") for _ in range(80)]
        hit, who = set(), set()
        for name, text in items:
            for win in decontaminate.windows_of(text, 10):
                p = win.split()
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit |= set(range(i, i + len(p)))
                        who.add(name)
        ranges, found = decontaminate.scan(automaton, [x.encode() for x in w])
        assert found == who and {k for a, b in ranges for k in range(a, b)} == hit


# --- language


def test_automaton_and_phrases_against_brute_force():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 3, 400).astype(np.uint8)
    table = language_id.suffix_automaton(text, 4)
    whole = bytes(text)

    def greedy(s):
        n = i = 0
        while i < len(s):
            j = i
            while j < len(s) and bytes(s[i : j + 1]) in whole:
                j += 1
            n, i = n + 1, max(j, i + 1)
        return n

    lanes = [rng.integers(0, 4 if k % 2 else 3, int(n)).astype(np.uint8) for k, n in enumerate((60, 40, 40, 7, 1))]
    grid = np.zeros((60, 5), dtype=np.int32)
    for k, lane in enumerate(lanes):
        grid[: len(lane), k] = lane
    got = language_id.phrases(grid, np.array([len(x) for x in lanes]), language_id.steps(table), 4)
    # a symbol the text lacks is a phrase of its own
    assert list(got) == [greedy(lane) for lane in lanes]


def test_languages_are_told_apart():
    train = {k: [" ".join(words(k, 300)) for _ in range(5)] for k in SYLLABLES}
    model = language_id.Model(train)
    texts = [(k, " ".join(words(k, n))) for k in SYLLABLES for n in (5, 50, 2000)]
    names, scores = model.predict([t for _, t in texts] + ["", None, "123 !?"])
    assert names[:-3] == [k for k, _ in texts] and names[-3:] == ["und"] * 3
    assert all(0 <= s <= 1 for s in scores) and scores[2] > 0.99
    # a long text is parsed whole: the second half decides as well
    mixed = " ".join(words("en", 1000) + words("fr", 3000))
    assert model.predict([mixed])[0] == ["fr"]


def test_languages_of_short_texts_are_learnt(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words("en", 400, rng)), "en") for i in range(30)] + [(100 + i, " ".join(words("fr", 6, rng)), "fr") for i in range(200)]
    rows += [(400 + i, " ".join(words("de", 20_000, rng)), "de") for i in range(5)] + [(500, "solo un", "it"), (None, "sch ung", "xx")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["de", "en", "fr"]
    assert model.predict([" ".join(words(k, 60, rng)) for k in model.names])[0] == model.names


def test_training_rows_are_bounded_and_unambiguous(spark):
    from strandlake.llm.sampling import training_rows

    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(60)] + [(3, "another text of three"), (50, "x" * 5000)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)] + [(7, 0), (7, 1), (8, 0), (8, 0), (None, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int").repartition(3)
    got = training_rows(docs, frame, "quality", 4, 2, 12, 4000)
    again = training_rows(docs.repartition(5), frame.repartition(1), "quality", 4, 2, 12, 4000)
    assert got.equals(again) and got["text"].str.len().sum() <= 4000 and got["text"].str.len().max() <= 400
    assert set(got["label"]) == {0, 1} and not got["text"].str.startswith("text 7 ").any()
    assert training_rows(docs, frame.limit(0), "quality", 4, 2, 12, 4000).empty


# --- quality


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 0, 2, 5, 5])
    unary, trans = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    marginal, moves, total = line_crf.forward_backward(unary, trans, doc)
    want, want_moves, want_total = np.zeros((7, 2)), np.zeros((2, 2)), 0.0
    for d in (0, 2, 5):
        rows = np.flatnonzero(doc == d)
        weights = {}
        for path in itertools.product((0, 1), repeat=len(rows)):
            s = sum(unary[r, k] for r, k in zip(rows, path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
            weights[path] = math.exp(s)
        z = sum(weights.values())
        want_total += math.log(z)
        for path, w in weights.items():
            for r, k in zip(rows, path):
                want[r, k] += w / z
            for a, b in itertools.pairwise(path):
                want_moves[a, b] += w / z
    assert np.allclose(marginal, want) and np.allclose(moves, want_moves) and math.isclose(total, want_total)


def test_quality_held_out():
    rng = random.Random(8)

    def line():
        w = words("en", rng.randint(5, 25), rng)
        return " ".join(w).capitalize() + "."

    def junk():
        return " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words("en", 12, rng))

    good = ["\n".join(line() for _ in range(rng.randint(1, 8))) for _ in range(150)]
    bad = ["\n".join([line()] + [junk() for _ in range(rng.randint(2, 8))]) for _ in range(150)]
    texts, y = good[:100] + bad[:100], np.array([1] * 100 + [0] * 100)
    model = line_crf.LineField().fit(texts, y)
    score, lines = model.score(good[100:] + bad[100:])
    assert ((score >= 0.7) == np.array([1] * 50 + [0] * 50)).mean() > 0.97
    # the good first line of a bad document is told from the rest
    first, rest = np.mean([m[0] for m in lines[50:]]), np.mean([m[1:].mean() for m in lines[50:]])
    assert rest > 0.8 and first < rest


# --- toxicity


def test_folding():
    assert toxicity.fold("1d!0t ІDIОT ＩＤＩＯＴ idi​ot îdiot! 12 3.5 $$$").split() == ["idiot"] * 5
    assert toxicity.fold(None).strip() == toxicity.fold(" .,- ").strip() == ""


def test_exceptions_and_boundaries():
    lexicon = toxicity.Lexicon({"trash": 3.0, "lowei*": 2.0, "loser": 1.0}, ("trash can",))
    assert [h[2] for h in lexicon.matches("Trash! trash can, trashy, xtrash tr4sh")[0]] == ["trash", "trash"]
    assert [h[2] for h in lexicon.matches("loweischaft 1oser LOSER")[0]] == ["lowei*", "loser", "loser"]
    assert lexicon.matches("")[0] == []


def test_matches_against_brute_force():
    rng = random.Random(21)
    lexicon = toxicity.Lexicon({"ab*": 1.0, "ba": 2.0, "aab": 4.0, "b*": 0.5}, exceptions=("ab ba", "ba a", "aab b aab"))

    def plain(text):
        folded = toxicity.fold(text)
        spaces = [i for i, c in enumerate(folded) if c == " "]
        hits = {}
        for i in spaces:
            for term, weight in lexicon.terms.items():
                key = f" {term[:-1]}" if term.endswith("*") else f" {term} "
                if folded.startswith(key, i) and weight > hits.get(i, (0, "", 0.0))[2]:
                    hits[i] = (i + len(key) - 1, term, weight)
        free = [(i, i + len(f" {p} ") - 1) for i in spaces for p in lexicon.exceptions if folded.startswith(f" {p} ", i)]
        return sorted((i, e, t, w) for i, (e, t, w) in hits.items() if not any(a <= i and e <= b for a, b in free))

    for _ in range(300):
        text = " ".join("".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 25)))
        assert sorted(lexicon.matches(text)[0]) == plain(text)
    import time

    began = time.time()
    assert lexicon.matches("ab ba " * 100_000)[0] == []
    assert time.time() - began < 5


def test_toxicity_held_out():
    rng = random.Random(2)
    abuse = ["blarg", "zonkhead", "frub", "frubig", "frubus"]

    def make(toxic):
        w = words("en", rng.randint(10, 200), rng)
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(abuse))
        return " ".join(w)

    y = np.array([i % 3 == 0 for i in range(900)]).astype(int)
    texts = [make(t) for t in y]
    lexicon = toxicity.learn(texts[:600], y[:600])
    assert ((lexicon.score(texts[600:]) >= 0.5) == y[600:]).mean() > 0.99
    assert lexicon.score(["you z0nkh3ad"])[0] > 0.5 > lexicon.score([""])[0]


# --- packing


def test_bounds_against_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        n, k = rng.randint(1, 7), rng.randint(1, 4)
        lengths = sorted(rng.sample(range(1, 60), n))
        counts = [rng.randint(1, 9) for _ in lengths]
        totals = [a * b for a, b in zip(lengths, counts, strict=True)]

        def cost(bounds):
            return sum(c * next(b for b in bounds if b >= v) - t for v, c, t in zip(lengths, counts, totals, strict=True))

        best = min(cost([*s, lengths[-1]]) for m in range(min(k, n)) for s in itertools.combinations(lengths[:-1], m))
        got = packing.optimal_bounds(lengths, counts, totals, k)
        assert cost(got) == best and len(got) <= k and got[-1] == lengths[-1]
    assert packing.optimal_bounds([], [], [], 3) == []


def test_batches(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 300 + F.when(F.col("id") % 3 == 0, 5000).otherwise(0)).cast("int")).alias("text"))
    got = packing.pack(docs, n_buckets=8, budget=8192)
    per = got.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("bound").alias("bound"), F.countDistinct("bucket").alias("b"), F.max("slot").alias("slot"))
    assert per.where("b > 1 or slot <> n - 1 or (n > 1 and n * bound > 8192)").count() == 0
    assert got.count() == 20_000 and got.where("n_tokens > bound").count() == 0
    assert got.select("bucket").distinct().count() <= 9
    # a third of all rows has nearly one length: its bucket is dealt into shards
    shards = got.groupBy("bucket").agg(F.countDistinct(F.split("batch_id", "-")[1]).alias("s"), F.count("*").alias("n"))
    assert shards.where("n > 2 * 4096 and s < 2").count() == 0


def test_bins(spark):
    rows = spark.range(1, 200_000, 7).select("id", packing.bin_of(F.col("id")).alias("bin"))
    assert rows.where("bin < id or bin > id * (1 + 1.0 / 512) + 1").count() == 0
    assert rows.where("id <= 1024 and bin <> id").count() == 0
    assert rows.select("bin").distinct().count() < 8 * 1024


# --- pages


def test_lines_against_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = sorted(page_diff.shared_lines(a, b))
        assert len(got) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div><header>Top</header><!-- <p>no</p> -->
<article class="post"><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;line<br>next<p>Second&#33;
<div class="ad">Buy</div><form><input>x</form><aside>side</aside><ul class="share-buttons"><li>s</li></ul>
<section id="comments"><p>reader</p></section></article><footer>&copy;</footer></body></html>"""


def test_markup():
    assert page_diff.main_text(*map(list, zip(*page_diff.blocks(PAGE), strict=True)), [], []) == "Title & more First bold line next Second!"
    assert page_diff.blocks("<p>a < b &lt;c&gt;</p>")[0][0] == "a < b <c>"
    wide = '<div class="layout has-sidebar"><p>kept</p><div class="user-comments">gone</div></div>'
    assert page_diff.blocks(wide) == [("kept", page_diff.OPEN)]
    assert page_diff.blocks('<div class="widget"><p>all there is</p></div><nav>menu</nav>') == [("all there is", page_diff.OPEN)]
    assert page_diff.blocks("<div>unclosed <span>text")[0][0] == "unclosed text"


def test_rows_without_an_id_are_dealt_over_shards(spark):
    docs = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("one two "), F.col("id")).alias("text")
    )
    got = packing.pack(docs, n_buckets=1, budget=300)
    assert got.count() == 20_000
    shards = got.where("doc_id is null").groupBy(F.split("batch_id", "-")[1].alias("s")).count().collect()
    assert len(shards) == 5 and max(r["count"] for r in shards) < 2_400


def test_languages_beside_unusable_rows_are_learnt(spark):
    """A language's null, empty, letterless and held-out rows don't count against its texts; no number of languages leaves one out."""
    few = spark.createDataFrame(
        [(i, "hei på deg og takk for sist", "no") for i in range(40)] + [(100 + i, "the words of an english text", "en") for i in range(40)],
        "doc_id long, text string, lang string",
    )
    bare = spark.range(1_000, 201_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "12 34").alias("text"), F.lit("no").alias("lang"))
    assert sorted(language_id.samples_of(few.union(bare), 4, 2)) == ["en", "no"]
    many = spark.range(400 * 12).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 400).cast("string")).alias("lang")
    )
    usable = [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(k, 400 * 12, 400)) for k in range(400)]
    assert sum(n >= 3 for n in usable) > 300
    assert {name: len(texts) for name, texts in language_id.samples_of(many, 4, 2).items()} == {f"l{k}": n for k, n in enumerate(usable) if n >= 3}


def test_shared_lines_go(spark):
    def page(body):
        return f"<html><body><div>Home</div><div>About us</div><div>{body}</div><div>Imprint of the site</div></body></html>"

    rows = [(i, f"https://h.example.com/a/{i:03d}", page(f"story number {i}")) for i in range(60)]
    rows += [(100, "https://other.example.com/", page("alone")), (101, "https://h.example.com/a/010", page("story number 10"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for big in (10, 1000):  # with and without ranges within the host
        got = {r.page_id: r.text for r in page_diff.extract(pages, big_host=big).collect()}
        assert all(got[i] == f"story number {i}" for i in range(60) if i != 10)
        assert got[100] == "Home About us alone Imprint of the site" and got[101] == got[10]


def test_shared_lines_of_articles_go(spark):
    def page(i, body):
        return f"<body><p>Home</p><article><h1>Story {i}</h1><p>Sent to you by the desk</p><p>{body}</p><p>All rights reserved</p></article></body>"

    bodies = [f"what happened on day {i} and why it is told at such length here, page {i}" for i in range(6)]
    rows = [(i, f"https://h.example.com/{i}", page(i, b)) for i, b in enumerate(bodies)]
    # copies beside each other, and near copies, keep their text
    rows += [(10 + i, f"https://copy.example.com/{i}", page(i // 3, bodies[0])) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_diff.extract(pages).collect()}
    assert all(got[i] == f"Story {i} {b}" for i, b in enumerate(bodies) if 0 < i < 5)
    # one neighbour is no evidence against an article's line
    assert all(got[i] == f"Story {i} Sent to you by the desk {bodies[i]} All rights reserved" for i in (0, 5))
    assert all(bodies[0] in got[10 + i] for i in range(5))


def test_pages_without_an_id_keep_their_neighbours(spark):
    rows = [(None if i % 2 else i, f"https://h.example.com/{i:03d}", f"<div>Home</div><div>story {i}</div><div>Imprint</div>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for big in (3, 1000):
        got = page_diff.extract(pages, big_host=big).collect()
        assert sorted(r.text for r in got) == sorted(f"story {i}" for i in range(60))


@pytest.mark.parametrize("stride", [4, 64])
def test_ranges_lose_no_neighbour(spark, monkeypatch, stride):
    monkeypatch.setattr(page_diff, "STRIDE", stride)

    def page(body):
        return f"<body><div>Home</div><div>{body}</div><div>Imprint of the site</div></body>"

    rows = [(i, f"https://h.example.com/story/{i:03d}/index.html", page(f"story number {i}")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for big in (1, 7, 1000):
        got = {r.page_id: r.text for r in page_diff.extract(pages, big_host=big).collect()}
        assert got == {i: f"story number {i}" for i in range(40)}


def test_long_lists_of_lines_align_whole(monkeypatch):
    own, other = [-1, *range(1, 2001), -2], [-3, *range(401, 1601), *range(1, 401), -4]
    assert page_diff.shared_lines(own, other) == set(range(401, 1601))
    lists = [[RNG.randint(1, 9) for _ in range(60)] for _ in range(20)]
    whole = [len(page_diff.shared_lines(a, b)) for a, b in zip(lists, lists[1:])]
    monkeypatch.setattr(page_diff, "CELLS", 30)
    assert [len(page_diff.shared_lines(a, b)) for a, b in zip(lists, lists[1:])] == whole


def test_equal_rows_get_equal_texts(spark):
    def page(*lines):
        return "".join(f"<div>{x}</div>" for x in lines)

    rows = [(1, "http://h.example.com/a", page("menu one", "own text of a", "menu two"))] + [(2, "http://h.example.com/b", page("menu one", "own text of b", "menu two"))] * 3
    rows += [(3, "http://h.example.com/c", page("menu two", "own text of c")), (None, None, page("x", "y")), (None, None, page("x", "y"))]
    rows += [(None, "http://h.example.com/d", page("own text of c", "d"))] * 2
    for big in (1, 1000):
        got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), big_host=big).collect()
        assert sorted((r.page_id or 0, r.text) for r in got) == sorted(
            [(1, "own text of a")] + [(2, "own text of b")] * 3 + [(3, "menu two own text of c")] + [(0, "x y")] * 2 + [(0, "d")] * 2
        )


def test_broken_markup_takes_linear_time():
    import time

    for page in ("<a \"" * 250_000, "<a href='" * 110_000, "<script" * 140_000, "<!--" * 250_000, "<" * 1_000_000, "</x>" * 250_000,
                 "<div>" * 100_000 + "</p>" * 100_000, "<div><p>" * 120_000, "<a \"<b" * 140_000, "<![CDATA[" * 110_000, "<a '\"<b '\"" * 90_000,
                 "<span>" * 160_000 + "</b>" * 10):
        began = time.time()
        page_diff.blocks(page)
        assert time.time() - began < 3, page[:20]
    assert page_diff.blocks("<p title='a > b' data-x=\"<i>\">text <b class=x\">bold</b> don't</p>") == [("text bold don't", page_diff.OPEN)]
    assert page_diff.blocks(f"<img src='data:image/png;base64,{'A' * 200_000}'>after")[0][0] == "after"


# --- scripts


def test_scripts_are_told_apart():
    rng = random.Random(9)
    pools = {"zh": range(0x4E00, 0x4E40), "ja": range(0x3042, 0x3082), "ko": range(0xAC00, 0xAC40), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA)}
    lexicon = {n: ["".join(chr(rng.choice(p)) for _ in range(rng.randint(2, 4))) for _ in range(60)] for n, p in pools.items()}

    def text(name, n):
        return " ".join(rng.choice(lexicon[name]) for _ in range(n))

    model = language_id.Model({n: [text(n, 300) for _ in range(5)] for n in pools})
    assert model.width <= language_id.SYMBOLS
    tests = [(n, text(n, 30)) for n in pools for _ in range(10)]
    assert model.predict([t for _, t in tests])[0] == [n for n, _ in tests]
    assert language_id.Model({"zh": [text("zh", 99)], "ja": [text("ja", 99)]}).predict([text("ja", 20), "。、！"])[0] == ["ja", "und"]


# --- urls


def test_rules(spark):
    urls = {
        "http://net/x": "net/", "http://a.net": None, "http://a.net/": "net/", "http://example.net/en/1": "example.net/en/", "http://example.net/en": "net/",
        "http://x.example.com/de/a": "example.com/de/", "http://badexample.com/de/a": None, "http://EXAMPLE.ORG/fr/?q": "org/fr/", "http://example.org/FR/": None,
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.url: r.rule for r in url_reputation.filter_urls(rows, none).collect()}
    assert got == {u: (r if u != "http://a.net" else None) for u, r in urls.items()}


def test_reputation_shrinks(spark):
    rows = [(f"good{i}.example.org", 0) for i in range(30) for _ in range(20)]
    rows += [("spam.example.biz", 1)] * 40 + [("new.example.biz", 1)] + [("fresh.example.org", 1)] + [(f"s{i}.example.biz", 1) for i in range(20) for _ in range(10)]
    got = {r.host: r for r in url_reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["spam.example.biz"].bound > 0.5 and got["new.example.biz"].bound > 0.5  # the domain speaks for it
    assert got["fresh.example.org"].bound < 0.5 and got["good1.example.org"].rate < 0.2  # one outcome doesn't
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    pages = spark.createDataFrame([(1, "http://spam.example.biz/a"), (2, "http://good1.example.org/a")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_reputation.filter_urls(pages, outcomes).collect()} == {1: "block", 2: "allow"}


def test_suffixes_and_domains(spark):
    want = {
        "www.a.co.uk": ("co.uk", "a.co.uk"), "x.b.com.mx": ("com.mx", "b.com.mx"), "me.github.io": ("github.io", "me.github.io"),
        "deep.me.github.io": ("github.io", "me.github.io"), "a.example.com:8080": ("com", "example.com"), "10.0.0.1": ("ip", "10.0.0.1"),
        "me@a.example.org.": ("org", "example.org"), "localhost": ("localhost", "localhost"), "co.uk": ("co.uk", "co.uk"), "x.y.de": ("de", "y.de"),
    }
    got = url_reputation.with_domains(spark.createDataFrame([(h,) for h in want], "host string")).collect()
    assert {r.host: (r.suffix, r.domain) for r in got} == want


def test_outcomes_of_all_scripts_and_broken_markup(spark):
    """Ordinary pages of any script are good; signs, shouting and empty pages are bad; unclosed markup takes linear time."""
    import time

    good = [
        "<p>Обычная страница о погоде в городе.</p>", "<p>Μια συνηθισμένη σελίδα για τον καιρό.</p>", "<p>صفحة عادية عن الطقس في المدينة</p>",
        "<p>这是一个关于城市天气的普通页面。</p>", "<p>これは天気についての普通のページです。</p>", "<p>날씨에 관한 평범한 페이지입니다 오늘은</p>",
        "<p>An ordinary page&nbsp;&amp;&nbsp;more of it.</p>", "<script>#### $$$ !!!!</script>Plain words after a script.",
    ]
    bad = ["", None, "<p>$$$ !!! ### buy now !!! $$$</p>", "<p>1 2 3</p>", "<script>only a script with many letters"]
    broken = ["<script" * 150_000, "<" * 1_000_000, "<script>" * 120_000, "&" * 1_000_000]
    rows = [(f"h{i}", t) for i, t in enumerate(good + bad + broken)]
    pages = spark.createDataFrame([(f"http://{h}/x", t) for h, t in rows], "url string, html string")
    began = time.time()
    got = {r.host: r.bad for r in url_reputation.content_outcomes(pages).collect()}
    assert time.time() - began < 30
    assert [got[f"h{i}"] for i in range(len(good))] == [0] * len(good)
    assert [got[f"h{len(good) + i}"] for i in range(len(bad))] == [1] * len(bad)


def test_a_hot_host_is_looked_up_like_any_other(spark, monkeypatch):
    monkeypatch.setattr("strandlake.plans.skew.lookup.__defaults__", (None, None, 4, 5, None))
    urls = ["http://hot.example.com/a"] * 40 + [f"http://h{i}.example.com/" for i in range(20)] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("hot.example.com", 1)] * 50 + [("h1.example.com", 0)] * 50, "host string, bad int")
    got = {r.page_id: r for r in url_reputation.filter_urls(pages, outcomes).collect()}
    assert len(got) == 62 and all(got[i].verdict == "block" for i in range(40))
    assert got[41].verdict == "allow" and got[41].bound is not None and got[40].bound is None


# --- rules and licences


def test_divergence_tells_foreign_text(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(w if rng.random() < 0.8 else "the" for w in words("en", 200, rng)), "en") for i in range(60)]
    rows += [(100, " ".join(f"{rng.random():.9f}" for _ in range(200)), None), (101, " ".join(words("en", 30, rng)), None)]
    got = {r.doc_id: r for r in divergence.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(60)) and not got[100].kept and not got[100].base_failed
    assert got[101].kept and got[101].word_distance is None


def test_licences(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    wrapped = "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))
    texts = {
        1: "Intro words here\nReleased under the MIT License.\nmore", 2: wrapped, 3: "Readme first.\n\n" + mit.replace("Software", "Program", 2) + "\n\nend",
        4: "the license of the software", 5: "ALL RIGHTS RESERVED", 6: "licensed under cc by nc 4 0",
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "Proprietary", 6: "CC-BY-NC-4.0"}
    assert got[1].dice == 1.0 and 0.8 <= got[3].dice < 1


def test_near_variants_of_every_long_template(spark):
    """A few words changed, wrapped in other lines: still the same licence; a third changed: none."""
    long = [(n, t) for n, t in licenses.TEMPLATES if len(licenses.bigrams(t)) >= 30]
    rows = []
    for k, (_, t) in enumerate(long):
        w = t.split()
        few = ["changed" if i % 25 == 5 else x for i, x in enumerate(w)]
        rows.append((2 * k, "A first line.\n\n" + "\n".join(" ".join(few[i : i + 11]) for i in range(0, len(few), 11)) + "\n\nThe end."))
        rows.append((2 * k + 1, "\n".join(" ".join("other" if i % 3 == 0 else x for i, x in enumerate(w))[j : j + 70] for j in range(0, len(t), 70))))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, t) in enumerate(long):
        assert name in got[2 * k].licenses and 0.8 <= got[2 * k].dice < 1, name
        assert got[2 * k + 1].license is None, name


BSD_FILE = """Copyright (c) 2019, A. Writer
All rights reserved here by nobody.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_whole_licence_files_are_named_right(spark):
    """A file of a licence, wrapped, under a copyright line, is named by its own licence although others are much alike."""
    whole = {}
    for name, text in licenses.TEMPLATES:
        if len(licenses.bigrams(text)) >= 25:
            whole[name] = max(whole.get(name, ""), text, key=len)
    assert {"BSD-2-Clause", "BSD-3-Clause", "MIT", "MIT-0", "ISC", "0BSD", "PostgreSQL", "Unlicense", "WTFPL", "Zlib", "LGPL-2.1", "LGPL-3.0"} <= set(whole)
    third = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    texts = {f"{n} file": f"Copyright (c) 2020 A. Writer\n\n{textwrap.fill(t, 72)}\n" for n, t in whole.items()}
    texts |= {"BSD-2-Clause own": BSD_FILE.format(third=""), "BSD-3-Clause own": BSD_FILE.format(third=third)}
    names = list(texts)
    docs = spark.createDataFrame([(i, texts[n]) for i, n in enumerate(names)], "doc_id long, text string")
    got = {names[r.doc_id]: r.license for r in licenses.scan(docs).collect()}
    assert got == {n: n.split()[0] for n in names}


def test_bounds_and_telling_words():
    for n in range(1, 60):
        low, high = licenses._bounds(n, 0.8)
        for a in range(1, 150):
            assert (2 * min(a, n) >= 0.8 * (a + n)) == (low <= a <= high)
    for _, text in licenses.TEMPLATES:
        grams = licenses.bigrams(text)
        low, high = licenses._bounds(len(grams), 0.8)
        telling = licenses.telling_words(grams, low, high, 0.8)
        free = [g for g in grams if not set(g.split()) & telling]
        # sharing only bigrams without a telling word can't reach the threshold at any size
        assert all(2 * len(free) < 0.8 * (a + len(grams)) for a in range(low, high + 1))


@pytest.mark.parametrize("a, b", [(0.5, 0.5), (0.0, 0.7), (1.0, 0.0)])
def test_distance(spark, a, b):
    p, q = [a, 1 - a], [b, 1 - b]
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]

    def kl(x):
        return sum(v * math.log2(v / w) for v, w in zip(x, m, strict=True) if v)

    want = math.sqrt(max(0, (kl(p) + kl(q)) / 2))
    row = spark.range(1).select(
        divergence._least_dense_distance([F.lit(p[0]), F.lit(p[1])], [q]).alias("dense"),
        divergence._least_distance(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("p")) for i, x in enumerate(p) if x]), [q]).alias("sparse"),
    ).first()
    assert row.dense == pytest.approx(want, abs=1e-7) and row.sparse == pytest.approx(want / (divergence.lacking(q) or 1), abs=1e-7)


def test_having_no_common_word_is_distance_one(spark):
    q = [0.1, 0.06, 0.04, 0.8]
    bins = F.array(F.struct(F.lit(3).alias("i"), F.lit(1.0).alias("p")))
    assert spark.range(1).select(divergence._least_distance(bins, [q]).alias("d")).first().d == pytest.approx(1, abs=1e-9)


def test_small_languages_and_word_salad(spark):
    """The same ten documents are judged alike in a small and in a large table; a text without common words goes."""
    rng = random.Random(8)
    small = [(i, " ".join(words("de", 250, rng)), "de") for i in range(10)]
    rare = [(20, " ".join(words("fr", 150, rng)), "fr")]  # too few words for a reference: nothing to compare with
    salad = [(21, " ".join(f"{''.join(rng.choices('bcdfgklmnprst', k=4))}a{i}" for i in range(200)), "en"), (22, " ".join(words("fr", 200, rng)), None)]
    for n in (60, 600):
        many = [(100 + i, " ".join(words("en", 120, rng)), "en") for i in range(n)]
        table = spark.createDataFrame([*small, *rare, *salad, *many], "doc_id long, text string, lang string")
        got = {r.doc_id: r for r in divergence.quality_rules(table).collect()}
        assert all(got[i].kept for i in range(10)) and got[20].kept and all(got[r[0]].kept for r in many)
        assert not got[21].kept and not got[21].base_failed and got[21].word_distance > 0.97

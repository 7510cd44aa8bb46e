"""Minimum spanning forests against Kruskal's, samples by hash and sketches."""

from __future__ import annotations

import hashlib
import random

import pytest

from strandlake.operators import explore, forest, kmers
from strandlake.operators.graph import linkage_clusters


def kruskal(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for d, a, b in sorted({(d, min(a, b), max(a, b)) for a, b, d in edges if None not in (a, b, d) and a != b}):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.append((a, b, d))
    return sorted(out)


def graphs():
    rng = random.Random(8)
    yield "ties", [(rng.randrange(40), rng.randrange(40), rng.randrange(4)) for _ in range(150)]
    yield "star", [(0, i, i % 7) for i in range(1, 200)] + [(i, i + 1, 3) for i in range(1, 60)]
    yield "path", [(i, i + 1, (i * 37) % 64) for i in range(64)]
    yield "odd", [(1, 1, 0), (None, 2, 1), (3, None, 1), (4, 5, None), (6, 7, 5), (7, 6, 2), (6, 7, 2)]
    yield "none", []


@pytest.mark.parametrize(("name", "edges"), list(graphs()))
def test_forest(spark, name, edges):
    df = spark.createDataFrame(edges, "src long, dst long, distance long").repartition(3)
    found = forest.minimum_forest(df)
    assert sorted(tuple(r) for r in found.collect()) == kruskal(edges)
    nodes = sorted({x for a, b, _ in edges for x in (a, b) if x is not None} | {999})
    vertices = spark.createDataFrame([(n,) for n in nodes], "node long")
    at = forest.clusters_at(found, [2, 4], vertices).collect()
    for cutoff in (2, 4):
        want = {(r.node, r.component) for r in linkage_clusters(df.where("src <> dst"), cutoff, vertices).collect()}
        assert {(r.node, r.component) for r in at if r.cutoff == cutoff} == want
    counts = {r.cutoff: r.n_clusters for r in forest.cluster_counts(found, len(nodes), [0, 2, 4]).collect()}
    assert counts == {0: len(nodes)} | {c: len({r.component for r in at if r.cutoff == c}) for c in (2, 4)}


def test_hash_sample(spark):
    rows = [(i if i % 50 else None, str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b string")
    got = {tuple(r) for r in explore.hash_sample(df, "a", "b", most=300).collect()}
    want = {r for r in rows if int(hashlib.md5(f"{'' if r[0] is None else r[0]},{r[1]}".encode()).hexdigest()[:8], 16) < (300 << 32) // 3000}
    assert got == want and 220 < len(got) < 380
    assert {tuple(r) for r in explore.hash_sample(df.repartition(7), "a", "b", most=300).collect()} == got
    assert {tuple(r) for r in explore.hash_sample(df, "a", "b", most=200).collect()} < got
    assert explore.hash_sample(df, "a", "b", most=3000).count() == 3000 and explore.hash_sample(df.limit(0), "a").count() == 0


def test_sketches_are_near_the_counts(spark):
    rng = random.Random(9)
    reads = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=149)) + "N" + "acgt" * (i % 9)) for i in range(300)], "read_id long, sequence string")
    sizes = [1, 5, 12, 31, 32]
    exact = {r.k: r.n_kmers for r in kmers.kmer_variability(reads, sizes).collect()}
    found = {r.k: r.estimate for r in kmers.kmer_sketches(reads, sizes).collect()}
    assert set(found) == set(exact) and all(abs(found[k] - exact[k]) <= max(1, 0.03 * exact[k]) for k in sizes)
    one, two = (kmers.kmer_sketches(reads.where(f"read_id % 2 = {i}"), [12]) for i in (0, 1))
    merged = one.union(two).selectExpr("hll_sketch_estimate(hll_union_agg(sketch)) AS n").first().n
    assert merged == found[12]

"""Distinct k-mers of many sizes, told apart in one pass."""

from __future__ import annotations

import random

from strandlake.operators import kmers


def test_distinct_kmers_of_all_sizes(spark):
    rng = random.Random(6)
    base = "".join(rng.choices("ACGT", k=200))
    texts = [base[a : a + rng.randrange(1, 90)] for a in rng.choices(range(190), k=60)]
    texts += ["T" * 40, "T" * 13, "ACGTN" + base[:33].lower() + "n", base[:12], base[:12] + "T", base[:12] + "TT", "", None]
    reads = spark.createDataFrame([(t,) for t in texts], "sequence string")
    for sizes in (range(1, 33), [1, 2, 4, 8, 12, 16, 24, 32], range(1, 13), [13], [5, 40]):
        want = {}
        for k in sizes:
            seen = {t[i : i + k].upper() for t in texts if t for i in range(len(t) - k + 1)}
            n = sum(not set(w) - set("ACGT") for w in seen)
            if n:
                want[k] = n
        assert {r.k: r.n_kmers for r in kmers.kmer_variability(reads, sizes).collect()} == want


def test_a_start_is_one_row_whatever_the_sizes(spark):
    reads = spark.createDataFrame([("ACGTTGCAAC" * 20,)], "sequence string")
    plan = kmers.kmer_variability(reads, range(1, 13))._jdf.queryExecution().optimizedPlan().toString()
    first = plan.splitlines()[-8:]
    assert kmers.kmer_variability(reads, range(1, 13)).count() == 12 and not any("flatten" in line for line in plan.splitlines()), first

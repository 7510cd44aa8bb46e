"""Windows looked up and counted a batch at a time, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F
from strandlake.functions import codec
from strandlake.operators import dictionary, kmers


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return [*("".join(rng.choices("ACGTacgNé", k=rng.randrange(60))) for _ in range(60)), "", None, "TTTT" * 9]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("longest", [False, True])
def test_keys_are_found_a_batch_at_a_time(spark, texts, longest):
    keys = [(5, "TT"), (3, "ACG"), (9, "AC"), (2, "acgt"), (7, "AC"), (1, "AN")]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id int, sequence string").coalesce(1)
    found = dictionary.window_matches(reads, spark.createDataFrame([(i, f"a{i}", b) for i, b in keys], "adaptor_idx int, name string, bases string"), longest)
    want = set()
    for r, t in enumerate(texts):
        for p in range(len(t or "")):
            fits = [(-len(b) if longest else 0, i) for i, b in keys if b != "AN" and t.upper()[p:].startswith(b.upper())]
            if fits:
                want.add((r, p, min(fits)[1]))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert "MapInArrow" in optimized(found)


def test_totals_of_places_need_no_lists(spark, texts):
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, sequence string").coalesce(1)
    for k in (2, 20):
        n, total = Counter(), Counter()
        for t in texts:
            for p in range(len(t or "") - k + 1):
                w = t[p : p + k].upper()
                if not set(w) - set("ACGT"):
                    n[w] += 1
                    total[w] += p
        assert sorted(map(tuple, kmers.position_totals(reads, k).collect())) == sorted((w, n[w], total[w]) for w in n)


def test_compatible_windows_look_for_the_bad_base_once_a_read(spark, texts):
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, sequence string")
    alone = optimized(reads.select(codec.reported_bad_base(F.col("sequence")).alias("bad")))
    assert optimized(kmers.windows(reads, 5, compat=True)).count("regexp_extract") <= alone.count("regexp_extract")

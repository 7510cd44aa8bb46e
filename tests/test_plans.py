"""Joins that deal hot keys out, tables between steps, components."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandlake.plans import lineage
from strandlake.plans.components import connected_components
from strandlake.plans.skew import lookup


def test_lookup_equals_a_left_join(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["hot"] * 6 + [None, "none", *"abcdefgh"])) for i in range(600)]
    table = [(k, f"v{k}", None if k == "a" else 1) for k in ["hot", *"abcdefgh"]]
    left, right = spark.createDataFrame(rows, "i int, k string"), spark.createDataFrame(table, "k string, v string, n int")
    known = {k: (v, n) for k, v, n in table}
    for least in (10, 10_000):
        got = lookup(left, right, "k", share=4, least=least).collect()
        assert len(got) == len(rows)
        assert {tuple(r) for r in got} == {(i, k, *known.get(k, (None, None))) for i, k in rows}


def test_lookup_by_arrays_of_which_some_are_hot(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice([[5, 2**40]] * 6 + [[7]] * 4 + [[], None, [1, 2], [7, 7]])) for i in range(600)]
    known = {(5, 2**40): "a", (7,): "b", (): "c", (1, 2): "d"}
    left, right = spark.createDataFrame(rows, "i int, k array<long>"), spark.createDataFrame([(list(k), v) for k, v in known.items()], "k array<long>, v string")
    got = lookup(left, right, "k", share=4, least=10).collect()
    assert sorted((r.i, r.v) for r in got) == [(i, known.get(None if k is None else tuple(k))) for i, k in rows]


@pytest.mark.parametrize("hub", [False, True])
def test_components_against_union_find(spark, hub, monkeypatch):
    monkeypatch.setattr("strandlake.plans.skew.lookup.__defaults__", (None, None, 4, 20, None))
    draw = random.Random(hub)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(7, i) for i in range(200, 300)] * hub + [(9, 9), (None, 3)]
    up = list(range(310))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    nodes = spark.range(310).withColumnRenamed("id", "node")
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), nodes).collect()
    assert sorted(map(tuple, got)) == [(i, find(i)) for i in range(310)]
    some = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    ends = {x for e in edges if None not in e for x in e}
    assert sorted(map(tuple, some)) == sorted((i, find(i)) for i in ends)


def test_spent_tables_are_deleted(spark):
    import os

    top = lineage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(top))
    one = lineage.cut(spark.range(5))
    made = set(os.listdir(top)) - before
    assert len(made) == 1 and one.count() == 5 and lineage.total(one) == 5 and lineage.total(spark.range(5)) is None
    summed = lineage.cut(spark.range(5), all=F.sum("id"))
    assert lineage.total(summed, "all") == 10
    lineage.spent(summed)
    lineage.spent(one, None, spark.range(2))
    assert set(os.listdir(top)) == before
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}
    assert len(set(os.listdir(top)) - before) <= 2


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Session())

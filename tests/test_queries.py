"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from conftest import TABLES, canonical, needs_tables
from strandlake.plans import registry

pytestmark = needs_tables


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(TABLES)).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, str(TABLES)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_paired_queries_find_themselves(spark):
    got = registry.QUERIES["paired_alignment"](spark, str(TABLES)).where("mate = 1").toPandas()
    nowhere = got["pair_id"] % 5 == 0
    assert got[nowhere]["chr_id"].isna().all() and got[~nowhere]["chr_id"].notna().all()
    assert (got[~nowhere]["probability"] > 0.5).all() and (got[~nowhere]["strand"] == "+").mean() > 0.95

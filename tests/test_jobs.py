"""Both jobs over growing input, repeated runs, failures in between, and their command line."""

from __future__ import annotations

import json
import logging

import pytest
from pyspark.sql import functions as F

from conftest import ROOT, TABLES, canonical, needs_tables
from jobs import genome_index, queries, sort_reads
from strandlake.operators import dictionary
from strandlake.operators import genome_index as stored
from strandlake.operators.paired import chunked, kmer_index, seeds
from strandlake.plans.bridge import adaptors_of, reads_of


@pytest.fixture
def parts(spark, tmp_path):
    """The documents in two parts by id, which tests add to a folder one after the other."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    folder = str(tmp_path / "texts")
    return folder, [lambda a=a, b=b: docs.where(F.col("doc_id").between(a, b)).write.mode("append").parquet(folder) for a, b in ((0, 79), (80, 10**9))]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(TABLES)).toPandas()
    assert canonical(got) == canonical(duck.sql(queries.ORACLE_SQL[name]).df())


@needs_tables
def test_sort_reads_grows(spark, parts, tmp_path, caplog):
    folder, (first, second) = parts
    out, bench = str(tmp_path / "out"), f"{TABLES}/benchmark.parquet"
    caplog.set_level(logging.INFO, logger="sort_reads")
    first()
    one = rows(sort_reads.run(spark, folder, bench, out))
    assert "read 80 texts" in caplog.text
    before = rows(sort_reads.run(spark, folder, bench, out))
    assert before == one and {r[4] for r in one} == {0}  # nothing new, nothing changed
    caplog.clear()
    second()
    both = rows(sort_reads.run(spark, folder, bench, out))
    assert "read 120 texts" in caplog.text and "read 80 texts" not in caplog.text
    assert [r for r in both if r[4] == 0] == one and {r[4] for r in both} == {0, 1}
    whole = rows(sort_reads.run(spark, folder, bench, str(tmp_path / "whole")))
    assert [r[:4] + r[5:] for r in both] == [r[:4] + r[5:] for r in whole]
    sums = {r.adaptor: r for r in spark.read.parquet(f"{out}/summary").collect()}
    assert sum(r.n_reads for r in sums.values()) == len(both) and sums["noBarCode"].n_batches == 2
    assert len(sums) == adaptors_of(spark.read.parquet(bench)).count() + 1


@needs_tables
def test_sort_reads_repeats_a_batch_that_was_not_committed(spark, parts, tmp_path):
    folder, (first, _) = parts
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    first()
    one = rows(sort_reads.run(spark, folder, f"{TABLES}/benchmark.parquet", out, mark))
    for file in (tmp_path / "mark" / "commits").iterdir():  # as if the driver had died after writing
        file.unlink()
    assert rows(sort_reads.run(spark, folder, f"{TABLES}/benchmark.parquet", out, mark)) == one


def test_sort_reads_edge_cases(spark, tmp_path):
    """Null, empty and repeated texts, null ids and sources, no adaptor that is valid."""
    texts, items = str(tmp_path / "t"), str(tmp_path / "i")
    made = [(1, "ACGTACGTTTTT", "a"), (1, "ACGTACGTTTTT", "a"), (2, None, None), (3, "", "b"), (None, "TTACGTACGTXX", None), (4, "gattaca", "a")]
    spark.createDataFrame(made, "doc_id long, text string, source string").write.parquet(texts)
    spark.createDataFrame([(7, "ACGTACGT"), (9, "ACGTACGT"), (3, "XXXXXXXX"), (4, None)], "item_id long, text string").write.parquet(items)
    got = sort_reads.run(spark, texts, items, str(tmp_path / "o")).select("read_id", "source", "pos", "sequence", "adaptor")
    want = [(100000, "a", 0, "ACGTACGTTTTT", "a7")] * 2 + [(400000, "a", None, "GATTACA", "noBarCode"), (None, None, 2, "TTACGTACGTNN", "a7")]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    none = sort_reads.run(spark, texts, items, str(tmp_path / "n"), adaptor_length=40)
    assert {r.adaptor for r in none.collect()} == {"noBarCode"}


@needs_tables
def test_first_matches_of_large_dictionaries(spark, monkeypatch):
    reads = reads_of(spark.read.parquet(f"{TABLES}/documents.parquet"))
    keys = adaptors_of(spark.read.parquet(f"{TABLES}/benchmark.parquet"), 5)
    within = rows(dictionary.first_matches(reads, keys).na.fill(-1))
    monkeypatch.setattr(dictionary, "LITERAL_KEYS", 1)
    assert rows(dictionary.first_matches(reads, keys).na.fill(-1)) == within


@needs_tables
def test_genome_index_grows(spark, parts, tmp_path, caplog):
    folder, (first, second) = parts
    out = str(tmp_path / "it's out")
    caplog.set_level(logging.INFO, logger="genome_index")
    first()
    one = rows(genome_index.run(spark, folder, out))
    assert "80 new texts" in caplog.text and rows(genome_index.run(spark, folder, out)) == one and "0 new texts" in caplog.text
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "it's out/index").rglob("*.parquet")}
    caplog.clear()
    second()
    both = rows(genome_index.run(spark, folder, out))
    assert "120 new texts" in caplog.text and {r[3] for r in both} == {1, 2}
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())  # the first load wasn't written again
    whole = rows(genome_index.run(spark, folder, str(tmp_path / "whole")))
    assert [r[:3] for r in both] == [r[:3] for r in whole]
    assert sum(r[2] for r in one) != sum(r[2] for r in both if r[3] == 1)  # places stopped being unique


@needs_tables
def test_genome_index_after_a_failure(spark, parts, tmp_path, monkeypatch):
    """A run that ends before its mark is moved is done again under the same number."""
    folder, (first, second) = parts
    out = str(tmp_path / "out")
    first()

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(genome_index, "put", fail)
        with pytest.raises(RuntimeError, match="lost"):
            genome_index.run(spark, folder, out)
    second()
    got = rows(genome_index.run(spark, folder, out))
    assert {r[3] for r in got} == {1} and got == rows(genome_index.run(spark, folder, str(tmp_path / "whole")))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("t_")]


def test_genome_index_edge_cases(spark, tmp_path):
    texts = str(tmp_path / "t")
    long = "ACGTTGCA" * 10
    spark.createDataFrame([(1, long), (2, None), (3, ""), (None, long), (4, "ACG"), (5, "N" * 90)], "doc_id long, text string").write.parquet(texts)
    got = rows(genome_index.run(spark, texts, str(tmp_path / "o"), step=10))
    assert got == [(1, 6, 2, 1)]  # starts 0, 10, … 50 have the period 8
    empty = str(tmp_path / "e")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(empty)
    assert rows(genome_index.run(spark, empty, str(tmp_path / "p"))) == []


def test_stored_index_is_joined_where_it_lies(spark, tmp_path):
    """No exchange stands above the index, whether it is joined or summed up by code."""
    genome = spark.createDataFrame([(1, "ACGTTGCATTGACCA" * 40), (2, "GATTACAGATTTACA" * 40)], "chr_id long, sequence string")
    pairs = spark.createDataFrame([(1, "m", "ACGTTGCATTGACCA" * 3, "m", "GATTACAGATTTACA" * 3)], "pair_id long, name1 string, seq1 string, name2 string, seq2 string")
    index = kmer_index(chunked(genome), step=10)
    with stored.opened(spark, str(tmp_path / "index"), stored.INDEX, 4) as name:
        stored.add(name, 1, index, 4)
        spark.catalog.refreshTable(name)
        table = spark.table(name)
        joined = seeds(pairs, step=10).hint("shuffle_merge").join(table.drop("load"), "code")
        assert rows(joined.select("read_pos", "ref_pos")) == rows(seeds(pairs, step=10).join(index, "code").select("read_pos", "ref_pos"))

        def above_scan(df):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            at = max(i for i, x in enumerate(lines) if name in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
            found, level = [], depth(lines[at])
            for x in reversed(lines[:at]):
                if depth(x) < level:
                    level = depth(x)
                    found.append(x)
            return "".join(found)

        assert "Exchange" not in above_scan(joined) and "Join" in above_scan(joined)
        assert "Exchange" not in above_scan(stored.code_counts(table))


@needs_tables
def test_command_line(tmp_path):
    import os
    import subprocess
    import sys

    config = tmp_path / "c.json"
    config.write_text(json.dumps({"texts": f"{TABLES}/documents.parquet", "out": "nowhere", "step": 30}))
    done = subprocess.run(
        [sys.executable, "-m", "jobs.genome_index", "--config", str(config), "--out", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True,
        env=os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.warehouse.dir={tmp_path}/w pyspark-shell"},
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "200 new texts" in done.stderr and (tmp_path / "out/mappability").exists() and not (tmp_path / "nowhere").exists()

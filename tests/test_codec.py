"""Micro goldens and properties of the codec and quality functions."""

from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import codec, quality


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("seq", "code"), [("T", 0), ("G", 1), ("A", 2), ("C", 3), ("TGAC", 228), ("ACGT", 30), ("AAGACTCGGC", 881562), ("acgt", 30), ("ANGT", 18), ("", 0)])
def test_encode(spark, seq, code):
    assert one(spark, codec.encode("s"), s=seq) == code


def test_encode_wide(spark):
    assert one(spark, codec.encode("s", wide=True), s="C" * 32) == Decimal(18446744073709551615)
    assert one(spark, codec.code_bits("s"), s="C" * 32) == -1
    assert one(spark, codec.encode("s", wide=True), s="C" * 33) == 0
    assert one(spark, codec.decode(codec.code_bits("s"), 32), s="C" * 32) == "C" * 32
    assert one(spark, codec.encode("s"), s="A") == one(spark, codec.encode("s"), s="ATT") == 2


def test_decode_and_view(spark):
    assert one(spark, codec.decode(F.lit(228), 4), s="") == "TGAC"
    assert one(spark, codec.decode(F.lit(2), 3), s="") == "ATT"
    assert one(spark, codec.decode(F.lit(2), 33), s="") is None
    assert one(spark, codec.view("s", 1, 3), s="TGAC") == 1 + 2 * 4 + 3 * 16
    assert one(spark, codec.view("s", 3, 4), s="TGAC") == 3
    assert one(spark, codec.view("s", 4, 2), s="TGAC") == 0
    assert one(spark, codec.view("s", 0, 33), s="TGAC") == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGT", min_size=1, max_size=31), min_size=1, max_size=40))
def test_round_trip(spark, seqs):
    rows = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = rows.select("s", codec.decode(codec.encode("s"), F.length("s")).alias("d"), codec.reverse_complement(codec.reverse_complement("s")).alias("r")).collect()
    assert all(r.s == r.d == r.r for r in got)


def test_reverse_complement(spark):
    assert one(spark, codec.reverse_complement("s"), s="ACGTN") == "NACGT"
    assert one(spark, codec.reverse_complement("s"), s="acg") == "cgt"
    assert one(spark, codec.reverse_complement("s"), s="A-xZé") == "nnnNT"[0:2] + "nNT"


def test_bad_bases(spark):
    seq = "A" * 10 + "N" + "A" * 4 + "N" + "A" * 30 + "N"
    assert one(spark, codec.first_bad_base("s"), s=seq) == 11
    assert one(spark, codec.reported_bad_base("s"), s=seq) == 16
    assert one(spark, codec.first_bad_base("s"), s="ACGT") == 0
    assert one(spark, codec.reported_bad_base("s"), s="ACGT") == 0


def test_quality(spark):
    assert one(spark, F.round(quality.accuracy(quality.phred("q")), 8), q="IIII") == 0.99960006
    assert one(spark, quality.accuracy(quality.phred("q")), q="II!I") == 0
    assert one(spark, quality.adjusted_mean("q"), q="II!II") == 32.0
    assert one(spark, quality.adjusted_mean("q"), q="") == -1
    assert one(spark, quality.adjusted_sd("q"), q="II!II") == pytest.approx(16.0)
    assert one(spark, F.round(quality.alignment_probability(F.lit(0), F.lit(0)), 6), q="") == 0.512735
    assert one(spark, F.round(quality.alignment_probability(F.lit(1), F.lit(0)), 6), q="") == 0.250580


def test_header(spark):
    got = one(spark, quality.parse_header("h"), h="@ID7 rank=0000016 x=176.0 y=10.0 length=108")
    assert (got.id, got.rank, got.x, got.y, got.length) == ("ID7", 16, 176.0, 10.0, 108)
    assert one(spark, quality.parse_header("h"), h="@only").rank is None

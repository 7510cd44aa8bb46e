"""Scans and writers on files written by the tests."""

from __future__ import annotations

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from strandlake.operators import kmers, paired
from strandlake.sources import sff, sinks
from strandlake.sources.fastq import fasta_pieces, genome_pieces, read_fasta, read_fastq, read_genome, read_mates
from strandlake.sources.lines import numbered_lines
from strandlake.sources.tables import read_adaptors, read_edges, read_headers, read_statistics
from strandlake.streaming.kmers import stream_fastq, stream_reads, streaming_kmer_counts


def test_numbered_lines_over_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = numbered_lines(spark, str(path))
        assert got.rdd.getNumPartitions() > 3
        assert got.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
        assert got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq(spark, tmp_path):
    good = "@a rank=1 x=1.5 y=2.5 length=4\r\nACGT\r\n+a\r\nIIII\r\n@b\nAC\n+\n@I\n"
    (tmp_path / "a.fastq").write_text(good + "broken\nAC\n+\nII\n@c\nA\n+\nI\n")
    rows = read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("read_id").collect()
    assert [(r.read_id, r.sequence, r.quality) for r in rows] == [(0, "ACGT", "IIII"), (1, "AC", "@I")]
    assert read_fastq(spark, str(tmp_path / "a.fastq"), "drop").count() == 3
    with pytest.raises(Exception, match="malformed record 2"):
        read_fastq(spark, str(tmp_path / "a.fastq"), "fail").collect()
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(good + "@cut\nAC\n")
    assert read_fastq(spark, str(tmp_path / "b.fastq.gz")).count() == 2
    heads = read_headers(read_fastq(spark, str(tmp_path / "a.fastq")), run="a").collect()
    assert [(h.ID, h.rank, h.x, h.len) for h in heads] == [("", 1, 1.5, 4)]


def test_fastq_sink(spark, tmp_path):
    rows = spark.createDataFrame([(0, "@a", "ACGT", "IIII", "x"), (1, "@b", "AC", "II", "y")], "read_id long, identifier string, sequence string, quality string, bucket string")
    sinks.write_fastq(rows, str(tmp_path / "out"))
    back = read_fastq(spark, str(tmp_path / "out" / "bucket=x"))
    assert [(r.identifier, r.sequence, r.quality) for r in back.collect()] == [("@a", "ACGT", "IIII")]


def test_fasta(spark, tmp_path):
    (tmp_path / "c1.fa").write_text(">one\r\nACGT\r\nAC\r\n>two\r\nGG\r\n")
    rows = {r.name: r.sequence for r in read_fasta(spark, str(tmp_path / "c1.fa")).collect()}
    assert rows == {"one": "ACGTAC", "two": "GG"}
    genome = read_genome(spark, {3: str(tmp_path / "c1.fa")}).collect()
    assert [(g.chr_id, g.sequence) for g in genome] == [(3, "ACGTACGG")]
    (tmp_path / "m.fa1").write_text(">p1\nAC\n>p2\nGG\n")
    (tmp_path / "m.fa2").write_text(">p1\nTT\n")
    mates = read_mates(spark, str(tmp_path / "m.fa1"), str(tmp_path / "m.fa2")).collect()
    assert [(m.pair_id, m.name1, m.seq1, m.seq2) for m in mates] == [(0, "p1", "AC", "TT")]


def test_fasta_over_splits(spark, tmp_path):
    path = tmp_path / "many.fa"
    path.write_text("".join(f">s{i}\n" + f"{'ACGT' * 5}\n" * (i % 7) for i in range(900)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r.name: r.sequence for r in read_fasta(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"s{i}": "ACGT" * 5 * (i % 7) for i in range(900)}


def test_tables(spark, tmp_path):
    (tmp_path / "bc.txt").write_text("IX1\tACGT\nIX2  GGTT\n\nIX3\tAA\n")
    got = read_adaptors(spark, str(tmp_path / "bc.txt")).orderBy("adaptor_idx").collect()
    assert [(r.adaptor_idx, r.name, r.bases) for r in got] == [(0, "IX1", "ACGT"), (1, "IX2", "GGTT")]
    (tmp_path / "w.csv").write_text("0,1,8\n1,2,100\n2,3,99\n")
    assert read_edges(spark, str(tmp_path / "w.csv")).count() == 2
    reads = spark.createDataFrame([(0, "ACGTAC", "IIIIII")], "read_id long, sequence string, quality string")
    sinks.write_kmers(kmers.kmer_statistics(reads, 3), str(tmp_path / "k"))
    back = read_statistics(spark, str(tmp_path / "k")).collect()
    assert {r.label: r["count"] for r in back} == {"ACG": 1, "CGT": 1, "GTA": 1, "TAC": 1}


def sff_bytes(reads):
    key, flows = b"TCAG", 8
    header = 31 + flows + len(key)
    padded = -(-header // 8) * 8
    out = struct.pack(">IIQIIHHHB", 0x2E736666, 1, 0, 0, len(reads), padded, len(key), flows, 1) + b"TACGTACG" + key
    out = out.ljust(padded, b"\0")
    for name, bases, (left, right) in reads:
        head = -(-(16 + len(name)) // 8) * 8
        out += (struct.pack(">HHIHHHH", head, len(name), len(bases), left, right, 0, 0) + name.encode()).ljust(head, b"\0")
        body = b"\0" * (2 * flows) + bytes(len(bases)) + bases.encode() + bytes(range(20, 20 + len(bases)))
        out += body.ljust(-(-len(body) // 8) * 8, b"\0")
    return out


def test_sff(spark, tmp_path):
    data = sff_bytes([("r1", "TCAGACGTAA", (5, 8)), ("read2", "TCAGGG", (5, 0))])
    (tmp_path / "in.sff").write_bytes(data)
    rows = sff.read_sff(spark, str(tmp_path / "in.sff")).orderBy("read_id").collect()
    assert [(r.name, r.sequence, r.quality) for r in rows] == [("r1", "ACGT", "".join(chr(33 + q) for q in range(24, 28))), ("read2", "GG", "9:")]
    whole = sff.read_sff(spark, str(tmp_path / "in.sff"), trim=False).orderBy("read_id").first()
    assert whole.sequence == "TCAGACGTAA"
    header = sff.common_header(spark, str(tmp_path / "in.sff"))
    marked = sff.read_sff(spark, str(tmp_path / "in.sff")).select(F.when(F.col("read_id") == 0, "a").otherwise("noBarCode").alias("bucket"), "raw")
    sff.write_sff(marked, str(tmp_path / "out"), header)
    back = sff.read_sff(spark, str(tmp_path / "out" / "bucket=a")).collect()
    assert [(r.name, r.sequence) for r in back] == [("r1", "ACGT")]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "reads")
    reads = spark.createDataFrame([(0, "@a", "ACGTA", "IIIII"), (1, "@b", "ACG", "III")], "read_id long, identifier string, sequence string, quality string")
    reads.write.parquet(source)
    query = streaming_kmer_counts(stream_reads(spark, source), 3).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    query.processAllAvailable()
    query.stop()
    assert {r.label: r["count"] for r in spark.table("kmers").collect()} == {"ACG": 2, "CGT": 1, "GTA": 1}


def test_stream_of_fastq_files(spark, tmp_path):
    source = tmp_path / "reads"
    source.mkdir()
    (source / "one.fastq").write_text("@a\nACGTA\n+\nIIIII\nbroken\nA\n+\nI\n@b\nACG\n+b\nIII\n")
    (source / "two.fastq").write_text("@c\r\nTACGT\r\n+\r\n@IIII\r\n")
    (source / "three.fastq").write_text("")
    query = streaming_kmer_counts(stream_fastq(spark, str(source), 1), 3).writeStream.outputMode("complete").format("memory").queryName("fastq_kmers").start()
    query.processAllAvailable()
    query.stop()
    assert {r.label: r["count"] for r in spark.table("fastq_kmers").collect()} == {"ACG": 3, "CGT": 2, "GTA": 1, "TAC": 1}


def small_splits(spark, size):
    import contextlib

    @contextlib.contextmanager
    def held():
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            yield
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)

    return held()


def test_fastq_over_splits_and_files(spark, tmp_path):
    """Records that splits cut in two are put together again, quality lines that begin with @ or + included."""
    want = {}
    for k in range(3):
        rows = [(i, f"@r{k}.{i}", "ACGT" * (i % 9), "@+I!" * (i % 9)) for i in range(400)]
        (tmp_path / f"f{k}.fastq").write_text("".join(f"{h}\n{s}\n+{h}\n{q}\n" for _, h, s, q in rows))
        want |= {(f"f{k}.fastq", i): (h, s, q) for i, h, s, q in rows}
    with small_splits(spark, "2k"):
        got = read_fastq(spark, str(tmp_path)).collect()
    assert {(r.file.rsplit("/", 1)[1], r.read_id): (r.identifier, r.sequence, r.quality) for r in got} == want and len(got) == len(want)


def test_fasta_pieces_over_splits(spark, tmp_path):
    """Records longer than splits and pieces, empty ones and lines before the first header keep their places."""
    import random

    rng = random.Random(7)
    spelled = {f"s{i}": "".join(rng.choices("ACGT", k=rng.choice([0, 3, 61, 700, 5000]))) for i in range(30)}

    def lines(s):
        return "".join(f"{s[i : i + 60]}\n" for i in range(0, len(s), 60))

    (tmp_path / "x.fa").write_text("AC\nGT\n" + "".join(f">{n}\n{lines(s)}" for n, s in spelled.items()))
    for split, size in (("1k", 100), ("128m", 777), ("3k", 100_000)):
        with small_splits(spark, split):
            pieces = fasta_pieces(spark, str(tmp_path / "x.fa"), size=size).collect()
            whole = {r.name: r.sequence for r in read_fasta(spark, str(tmp_path / "x.fa")).collect()}
            rows = genome_pieces(spark, {1: str(tmp_path / "x.fa")}, size=size)
            chunks = paired.chunked(rows, size=1000, margin=30).orderBy("chunk").collect()
        assert whole == {None: "ACGT"} | spelled
        found = {}
        for r in sorted(pieces, key=lambda r: (r.record, r.offset)):
            assert len(found.get(r.name, "")) == r.offset and len(r.sequence) < size + 60
            found[r.name] = found.get(r.name, "") + r.sequence
        assert found == whole
        genome = "ACGT" + "".join(spelled.values())
        assert [(c.start, c.own, c.sequence) for c in chunks] == [
            (max(o - 30, 0), o, genome[max(o - 30, 0) : o + 1030]) for o in range(0, len(genome), 1000)
        ]
        assert all(c.length == len(genome) for c in chunks)


def test_sff_writer_bounds_files_and_commits(spark, tmp_path, monkeypatch):
    made = [(b, sff.record(f"r{i}", "TCAG" + "ACGT" * i, bytes([30] * (4 + 4 * i)), 4, 5, 4 + 4 * i)) for i in range(1, 30) for b in (f"b{i % 2}",)]
    rows = spark.createDataFrame(made, "bucket string, raw binary").repartition(3)
    out = str(tmp_path / "sff")
    sff.write_sff(rows, out, sff.header())
    sff.write_sff(rows.limit(0), out, sff.header())
    back = sff.read_sff(spark, f"{out}/*").collect()
    assert sorted(r.name for r in back) == sorted(f"r{i}" for i in range(1, 30)) and all(len(r.sequence) == 4 * int(r.name[1:]) for r in back)
    assert not [p for p in (tmp_path / "sff").iterdir() if p.name.startswith("_")]
    sff.write_sff(rows.where("bucket = 'b1'"), out, sff.header(), mode="overwrite")
    assert {p.name for p in (tmp_path / "sff").iterdir()} == {"bucket=b1"}

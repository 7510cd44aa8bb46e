"""Operators on small hand-made reads, and compatible modes."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment, mapping
from strandlake.operators import demux, dictionary, explore, graph, kmers, overlap, paired
from strandlake.plans.components import connected_components


def reads(spark, *seqs, quality=None):
    rows = [(i, f"@r{i} rank={i} x=1.0 y=2.0 length={len(s)}", s, quality or "I" * len(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "read_id long, identifier string, sequence string, quality string")


def starts(df):
    return sorted(r.pos for r in df.collect())


def test_windows(spark):
    assert starts(kmers.windows(reads(spark, "ACGTA"), 3)) == [0, 1, 2]
    assert starts(kmers.windows(reads(spark, "ACGTA"), 3, compat=True)) == [1]
    assert starts(kmers.windows(reads(spark, "", "AC", "ACG"), 3)) == [0]
    bad = "A" * 14 + "N" + "A" * 20
    assert starts(kmers.windows(reads(spark, bad), 10)) == [*range(5), *range(15, 26)]
    assert starts(kmers.windows(reads(spark, bad), 10, compat=True)) == [*range(6), *range(16, 25)]
    assert starts(kmers.windows(reads(spark, "A" * 20), 10, prefix=12)) == [0, 1]
    assert starts(kmers.windows(reads(spark, "A" * 20), 10, prefix=12, inclusive=True)) == [0, 1, 2]
    assert starts(kmers.windows(reads(spark, "A" * 11), 10, prefix=12)) == []
    assert [r.kmer for r in kmers.windows(reads(spark, "acgt"), 4).collect()] == ["ACGT"]


def test_counts(spark):
    rows = reads(spark, "ACGTACGT", "ACGT", "NNNN")
    got = {r.label: r["count"] for r in kmers.kmer_counts(rows, 4).collect()}
    assert got == {"ACGT": 3, "CGTA": 1, "GTAC": 1, "TACG": 1}
    assert kmers.top_kmers(rows, 4).first().label == "ACGT"
    stats = {r.label: r for r in kmers.kmer_statistics(rows, 4).collect()}
    assert stats["ACGT"].mean_qual == 40 and stats["ACGT"].sd_qual == 0
    assert stats["ACGT"].accuracy == pytest.approx(0.99960006)
    assert {r.k: r.n_kmers for r in kmers.kmer_variability(rows, [1, 4]).collect()} == {1: 4, 4: 4}
    assert kmers.pattern_qualities(rows, "ACGT").count() == 3
    assert kmers.pattern_qualities(rows, "TTTT").count() == 0 and kmers.pattern_qualities(rows, "ANGT").count() == 0
    assert {r.label: list(r.positions) for r in kmers.collected(rows, 4).collect()}["ACGT"] == [0, 0, 4]


def test_errors(spark):
    got = kmers.read_errors(reads(spark, "ACNT", "ACGT")).collect()
    assert [(r.read_id, r.id, r.len, r.rec, r.symb, r.qual) for r in got] == [(0, "r0", 4, 3, "N", 40)]


def test_dictionary(spark):
    keys = spark.createDataFrame([(0, "a", "ACG"), (1, "b", "ACGT"), (2, "c", "ANA"), (3, "d", "GGG")], "adaptor_idx int, name string, bases string")
    rows = reads(spark, "ACGTA", "TTTTT", "GGGGG")
    assert {(r.read_id, r.adaptor_idx) for r in dictionary.assign(rows, keys).collect()} == {(0, 0), (2, 3)}
    assert {(r.read_id, r.adaptor_idx) for r in dictionary.assign(rows, keys, longest=True).collect()} == {(0, 1), (2, 3)}
    assert dictionary.assign(rows, keys, every_window=True).count() == 4
    counts = {r.name: r.n_reads for r in dictionary.adaptor_counts(rows, keys).collect()}
    assert counts == {"a": 1, "b": 0, "c": 0, "d": 1, "noBarCode": 1}
    assert {r.bases: r.n_reads for r in dictionary.barcode_counts(rows, keys).collect()} == {"ACG": 1, "ACGT": 1, "GGG": 1}
    assert dictionary.barcode_regex_hits(rows, ["AC.T", "^T"]).count() == 2
    assert dictionary.length_spread(keys) == (3, 4) and dictionary.dictionary_size(keys) == 3


def test_alignment():
    assert list(alignment.scores(["ACGT", "A", ""], ["ACT", "C", "ACG"])) == [5, 10, 15]
    assert list(alignment.scores(["A", "ACGT"], ["C", "ACT"], 25, 13)) == [13, 25]
    assert alignment.align(["A"], ["C"])[0][1:] == ("A", "C")
    rng = random.Random(3)
    pairs = [("".join(rng.choices("ACGT", k=rng.randint(0, 20))), "".join(rng.choices("ACGT", k=rng.randint(0, 20)))) for _ in range(200)]
    forward = alignment.scores([a for a, _ in pairs], [b for _, b in pairs])
    assert list(forward) == list(alignment.scores([b for _, b in pairs], [a for a, _ in pairs]))
    for (a, b), s, (t, x, y) in zip(pairs, forward, alignment.align([a for a, _ in pairs], [b for _, b in pairs]), strict=True):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert s == t == 5 * (len(a) + len(b) - 2 * table[-1][-1])
        assert x.replace("-", "") == a and y.replace("-", "") == b
        assert s == sum(5 if "-" in (p, q) else 10 * (p != q) for p, q in zip(x, y, strict=True))


def test_overlap_trimming():
    assert alignment.overlap("--ACGT", "TTACCT") == (4, 1)
    assert alignment.overlap("ACGT--", "ACGTTT") == (4, 0)
    assert alignment.overlap("ACGT--", "ACGTTT", trim_trailing=False) == (6, 2)


def seeded(ref, p, read, q):
    found = mapping.extended([ref], [p], [read], [q])[0]
    return None if found[0] < 0 else tuple(map(int, found))


def fitted(ref, read):
    found = mapping.fitted([ref], [read])[0]
    return None if found[0] < 0 else tuple(map(int, found))


def test_seeded_alignment():
    rng = random.Random(5)
    ref = "".join(rng.choices("ACGT", k=400))
    assert seeded(ref, 160, ref[100:250], 60) == (0, 100, 250, 0, 0)
    read = list(ref[100:250])
    read[10] = "A" if read[10] != "A" else "C"
    assert seeded(ref, 160, "".join(read), 60) == (13, 100, 250, 1, 0)
    assert seeded(ref, 160, "".join(rng.choices("ACGT", k=60)) + ref[160:190] + "".join(rng.choices("ACGT", k=60)), 60) is None


def test_overlap_pairs(spark):
    rng = random.Random(1)
    s = "".join(rng.choices("ACGT", k=80))
    rows = reads(spark, s[:50], s[15:80], "".join(rng.choices("ACGT", k=60)))
    pairs = overlap.shared_kmer_pairs(rows, 31)
    assert [(r.read1, r.read2) for r in pairs.collect()] == [(0, 1)]
    assert {r.read: r.n_matches for r in overlap.overlap_degree(rows, pairs).collect()} == {0: 1, 1: 0, 2: 0}
    got = overlap.overlaps(pairs, rows).first()
    score, x, y = alignment.align([s[:50]], [s[15:80]])[0]
    assert (got.len1, got.len2, got.score) == (50, 65, score)
    assert (got.overlap, got.overlap_score) == alignment.overlap(x, y)
    assert overlap.shared_kmer_pairs(rows, 31, max_frequency=1).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(9, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df, spark.range(600).withColumnRenamed("id", "node")).collect()}
    up = list(range(600))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(600)}
    empty = spark.createDataFrame([], "src long, dst long")
    assert connected_components(empty).count() == 0
    shuffled = df.repartition(7, F.rand(1))
    assert {r.node: r.component for r in connected_components(shuffled).collect()}.items() <= got.items()


def test_linkage(spark):
    edges = spark.createDataFrame([(0, 1, 8), (1, 2, 9), (3, 4, 1), (4, 5, 2)], "src long, dst long, distance int")
    clusters = graph.linkage_clusters(edges, 9)
    assert {r.node: r.component for r in clusters.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 3}
    got = {r.member: r.distance for r in graph.with_seed_distance(clusters, edges).collect()}
    assert got == {0: 0, 1: 8, 2: 0, 3: 0, 4: 1, 5: None}
    assert {r.member: r.distance for r in graph.with_seed_distance(clusters, edges, compat=True).collect()}[5] == 0
    assert {r.leader: r["size"] for r in graph.component_sizes(clusters).collect()} == {0: 2, 2: 1, 3: 3}


def test_demux(spark):
    a, b = "ACGTACGGTCAATT", "GGGTTTCCCAAAGT"
    rows = reads(spark, a, "C" + a[:12], a[1:] + "GG", b, "AC", b.lower())
    clusters = demux.demux_clusters(rows)
    assert {r.node: r.component for r in clusters.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 3}
    buckets = {r.read_id: r.bucket for r in demux.demux_reads(rows, clusters, 3).collect()}
    assert buckets == {0: "output0", 1: "output0", 2: "output0", 3: "ungrouped", 4: "ungrouped", 5: "ungrouped"}
    assert demux.demux_reads(rows, clusters, 3, rest=None).count() == 3
    with pytest.raises(ValueError):
        demux.demux_clusters(rows, 10, 10)


def test_explore(spark):
    df = spark.range(101).select(F.col("id").alias("v"), (F.col("id") * 2.0).alias("accuracy"))
    kept = explore.percent_range_filter(df, {"v": (0, 100)})
    assert kept.agg(F.min("v"), F.max("v")).first() == (1, 99)
    assert explore.percent_range_filter(df, {"acc": (50, 60)}).count() == 9
    assert explore.percent_range_filter(df.limit(0), {"v": (0, 100)}).count() == 0
    assert explore.event_message(df)[1].startswith("101 events captured, sampling") and explore.event_message(kept)[1].endswith("shown below")
    assert {r.bin: r["count"] for r in explore.histogram(df, "v", 50).collect()} == {0: 50, 1: 50, 2: 1}
    assert 0 < explore.sample_events(spark.range(5000)).count() < 250
    assert explore.nth_read(reads(spark, "A", "C"), 2).first().sequence == "C"


def test_mates(spark):
    found = spark.createDataFrame(
        [(0, "+", 1, 1, 1000, 0), (0, "+", 2, 1, 1699, 0), (0, "+", 2, 1, 1700, 0), (0, "+", 2, 1, 301, 0), (0, "+", 2, 1, 300, 0), (0, "-", 2, 1, 1000, 0)],
        "pair_id long, strand string, mate int, chr_id int, ref_pos int, read_pos int",
    )
    assert sorted(r.ref2 for r in paired.mate_pairs(found).collect()) == [301, 1699]


def test_candidates_within_reach_are_those_of_pairs(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(3), rng.choice("+-"), rng.choice([1, 2]), rng.randrange(2), rng.randrange(6000), rng.randrange(3)) for _ in range(150)})
    found = spark.createDataFrame(rows, "pair_id long, strand string, mate int, chr_id int, ref_pos int, read_pos int")
    want = {r for r in rows if any(o[2] != r[2] and o[:2] == r[:2] and o[3] == r[3] and abs(o[4] - r[4]) < 300 for o in rows)}
    got = [tuple(r) for r in paired.within_reach(found, 300).collect()]
    assert set(got) == want and len(got) == len(want) < len(rows)


def test_paired_alignment(spark):
    rng = random.Random(11)
    genome = ["".join(rng.choices("ACGT", k=3000)) for _ in range(2)]
    table = str.maketrans("ACGT", "TGCA")

    def rc(s):
        return s[::-1].translate(table)

    rows, want = [], {}
    for i in range(12):
        c, at = i % 2, rng.randrange(0, 2400)
        one, two = genome[c][at : at + 150], genome[c][at + 300 : at + 450]
        one = one[:70] + ("A" if one[70] != "A" else "C") + one[71:]
        rows.append((i, "a", rc(two), "b", one) if i % 3 == 0 else (i, "a", one, "b", rc(two)))
        want[i] = ((c, at + 301, at + 450, "-"), (c, at + 1, at + 150, "+")) if i % 3 == 0 else ((c, at + 1, at + 150, "+"), (c, at + 301, at + 450, "-"))
    rows.append((99, "a", "".join(rng.choices("ACGT", k=150)), "b", "".join(rng.choices("ACGT", k=150))))
    pairs = spark.createDataFrame(rows, "pair_id long, name1 string, seq1 string, name2 string, seq2 string")
    ref = spark.createDataFrame([(0, genome[0]), (1, genome[1])], "chr_id int, sequence string")
    got = paired.align_pairs(pairs, ref, step=10, chunk=1000)
    seen = {(r.pair_id, r.mate): (r.chr_id, r.begin, r.end, r.strand) for r in got.collect()}
    assert {i: (seen[i, 1], seen[i, 2]) for i in want} == want
    assert seen[99, 1] == (None,) * 4
    lines = [r.value for r in paired.report_lines(got.where("pair_id = 99"), missing_chr=1).collect()]
    assert sorted(lines) == ["a,1,1,2,+,0.000000", "b,1,1,2,-,0.000000"]


def test_fitted_alignment(spark):
    rng = random.Random(6)
    ref = "".join(rng.choices("ACGT", k=300))
    assert fitted(ref, ref[50:200]) == (0, 50, 200, 0, 0)
    assert fitted(ref, ref[50:100] + ref[101:200]) == (25, 50, 200, 0, 1)
    assert fitted(ref, "".join(rng.choices("ACGT", k=100))) is None
    assert fitted("", "A") is None
    genome = spark.createDataFrame([(7, ref * 4)], "chr_id int, sequence string")
    assert paired.reference_slice(genome, 7, 3, 5).first()[0] == ref[3:8]
    mates = spark.createDataFrame([(0, "a", ref[10:160], "b", ref[140:290])], "pair_id long, name1 string, seq1 string, name2 string, seq2 string")
    mates = mates.withColumn("seq2", F.translate(F.reverse("seq2"), "ACGT", "TGCA"))
    one = spark.createDataFrame([(7, ref)], "chr_id int, sequence string")
    for mode in ("fast", "accurate"):
        got = paired.Aligner(1).pass_reference_genome(one).get_alignment(mates, mode=mode).orderBy("mate").collect()
        assert [(r.begin, r.end, r.strand) for r in got] == [(11, 160, "+"), (141, 290, "-")]
    assert paired.Aligner(2).pass_reference_genome(one).index().count() == 10
    with pytest.raises(ValueError):
        dictionary.check_spread(spark.createDataFrame([(0, "a", "AC"), (1, "b", "ACACACAC")], "adaptor_idx int, name string, bases string"))


def test_window_quality_of_every_size(spark):
    """Against sums and products one by one; quality strings may be shorter than the read, empty or null."""
    rows = [(0, "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACG", "".join(chr(35 + i) for i in range(39))), (1, "ACGTACG", "IIII"), (2, "ACGTACG", ""), (3, "ACGTACG", None)]
    frame = spark.createDataFrame(rows, "read_id long, sequence string, quality string")
    for k in (1, 2, 3, 7, 10, 32):
        got = {(r.read_id, r.pos): (r.kmer, r.qual, r.acc) for r in kmers.window_quality(frame, k).collect()}
        assert len(got) == sum(max(len(s) - k + 1, 0) for _, s, _ in rows)
        for (read_id, pos), (kmer, qual, acc) in got.items():
            _, sequence, quality = rows[read_id]
            scores = [ord(c) - 33 for c in (quality or "")[pos : pos + k]]
            assert kmer == sequence[pos : pos + k]
            assert qual == pytest.approx(sum(scores) / len(scores) if scores else -1)
            assert acc == pytest.approx(math.prod(1 - 10 ** (-x / 10) for x in scores) if scores else -1)

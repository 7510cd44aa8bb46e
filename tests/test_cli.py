"""The command line end to end on small files."""

from __future__ import annotations

import random

from strandlake.cli import main


def fastq(path, seqs):
    path.write_text("".join(f"@r{i} rank={i} x=1.0 y=1.0 length={len(s)}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)))
    return str(path)


def test_kmers_and_demux(spark, tmp_path):
    rng = random.Random(1)
    barcode = "".join(rng.choices("ACGT", k=12))
    path = fastq(tmp_path / "r.fastq", [barcode + "".join(rng.choices("ACGT", k=60)) for _ in range(6)] + ["ACGTN" * 10])
    out = str(tmp_path / "out")
    main(["kmers", path, out, "-k", "10", "--statistics", "--pattern", barcode[:10]])
    top = spark.read.csv(f"{out}/kmers", header=True).where("count = 6")
    assert top.count() == 3 and spark.read.csv(f"{out}/errors", header=True).count() == 1
    assert spark.read.csv(f"{out}/pattern", header=True).count() == 6
    main(["prefix-kmers", path, out + "2"])
    assert spark.read.csv(f"{out}2/kmers", header=True).count() == 2
    main(["demux", path, out, "-t", "5"])
    assert spark.read.text(f"{out}/reads/bucket=output0").count() == 24
    assert spark.read.text(f"{out}/reads/bucket=ungrouped").count() == 4


def test_overlaps_and_clusters(spark, tmp_path):
    rng = random.Random(2)
    s = "".join(rng.choices("ACGT", k=100))
    path = fastq(tmp_path / "r.fastq", [s[:70], s[20:], "".join(rng.choices("ACGT", k=60))])
    out = str(tmp_path / "out")
    main(["overlaps", path, out])
    assert spark.read.csv(f"{out}/overlaps", header=True).count() == 1 and spark.read.csv(f"{out}/degrees", header=True).count() == 3
    (tmp_path / "w.csv").write_text("0,1,3\n1,2,50\n")
    main(["cluster", str(tmp_path / "w.csv"), out, "9", "--nodes", "4"])
    assert sorted((r._c0, r._c1) for r in spark.read.csv(f"{out}/sizes").collect()) == [("0", "2"), ("2", "1"), ("3", "1")]


def test_align_and_search(spark, tmp_path, capfd):
    rng = random.Random(3)
    g = "".join(rng.choices("ACGT", k=2000))
    back = g[600:750][::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "c.fa").write_text(">c\n" + "\n".join(g[i : i + 50] for i in range(0, 2000, 50)) + "\n")
    (tmp_path / "a.fa").write_text(f">p/1\n{g[200:350]}\n")
    (tmp_path / "b.fa").write_text(f">p/2\n{back}\n")
    main(["align", str(tmp_path / "a.fa"), str(tmp_path / "b.fa"), str(tmp_path / "out"), "--genome", f"20={tmp_path / 'c.fa'}"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["p/1,20,201,350,+,0.512735", "p/2,20,601,750,-,0.512735"]
    (tmp_path / "bc.txt").write_text("x\tACGTACGT\n")
    main(["search", fastq(tmp_path / "r.fastq", ["GACGTACGTCCCCCCC", "T" * 20]), str(tmp_path / "bc.txt")])
    assert "|ACGTACGT|1" in capfd.readouterr().out

"""Command line: one subcommand per tool, reading and writing files through Spark.

    python -m strandlake.cli kmers reads.fastq out -k 10 --statistics
    python -m strandlake.cli demux reads.fastq out -w 12 -l 10 -t 1000
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.operators import demux, dictionary, graph, kmers, overlap, paired
from strandlake.plans.shipping import ship
from strandlake.sources import sff, sinks
from strandlake.sources.fastq import genome_pieces, read_fastq, read_mates
from strandlake.sources.tables import read_adaptors, read_edges


def _kmers(spark, a):
    reads = read_fastq(spark, a.reads)
    how = {"compat": a.compat}
    table = kmers.kmer_statistics(reads, a.k, **how) if a.statistics else kmers.kmer_counts(reads, a.k, **how)
    sinks.write_kmers(table, f"{a.out}/kmers")
    sinks.write_table(kmers.read_errors(reads), f"{a.out}/errors")
    if a.pattern:
        sinks.write_table(kmers.pattern_qualities(reads, a.pattern).select("qual"), f"{a.out}/pattern")


def _prefix(spark, a):
    sinks.write_kmers(kmers.kmer_counts(read_fastq(spark, a.reads), a.l, prefix=a.w), f"{a.out}/kmers")


def _overlaps(spark, a):
    ship(spark)
    reads = read_fastq(spark, a.reads).drop("file")
    pairs = overlap.shared_kmer_pairs(reads, a.k)
    if a.iteration is not None:  # slices of reads, as successive runs take them
        first = overlap.read_range(reads, a.iteration * a.slice, (a.iteration + 1) * a.slice).select(F.col("read_id").alias("read1"))
        pairs = pairs.join(first, "read1", "left_semi")
    sinks.write_table(overlap.overlap_degree(reads, pairs), f"{a.out}/degrees")
    sinks.write_table(overlap.overlaps(pairs, reads, trim_trailing=not a.compat), f"{a.out}/overlaps")


def _cluster(spark, a):
    edges = read_edges(spark, a.edges)
    nodes = None if a.nodes is None else spark.range(a.nodes).select(F.col("id").cast("int").alias("node"))
    clusters = graph.linkage_clusters(edges, a.cutoff, nodes)
    sinks.write_table(graph.with_seed_distance(clusters, edges, a.compat), f"{a.out}/clusters")
    sinks.write_table(graph.component_sizes(clusters), f"{a.out}/sizes", header=False)


def _demux(spark, a):
    reads = read_fastq(spark, a.reads).drop("file")
    clusters = demux.demux_clusters(reads, a.w, a.l)
    sinks.write_table(graph.component_sizes(clusters), f"{a.out}/clustering", header=False)
    sinks.write_fastq(demux.demux_reads(reads, clusters, a.t), f"{a.out}/reads")


def _split(spark, a):
    ship(spark)
    keys = read_adaptors(spark, a.adaptors)
    dictionary.check_spread(keys)
    records = sff.read_sff(spark, a.sff)
    reads = records.select(F.col("read_id"), "sequence")
    found = dictionary.assign(reads, keys).join(keys.select("adaptor_idx", "name"), "adaptor_idx").select("read_id", F.col("name").alias("bucket"))
    rest = dictionary.unmatched(reads, found).select("read_id", F.lit("noBarCode").alias("bucket"))
    marked = records.join(found.unionByName(rest), "read_id")
    sff.write_sff(marked, a.out, sff.common_header(spark, a.sff))
    dictionary.adaptor_counts(reads, keys).show(1_000_000, False)


def _search(spark, a):
    dictionary.barcode_counts(read_fastq(spark, a.reads), read_adaptors(spark, a.adaptors)).orderBy("bases").show(1_000_000, False)


def _align(spark, a):
    ship(spark)
    genome = genome_pieces(spark, {int(k): v for k, v in (x.split("=", 1) for x in a.genome)})
    rows = paired.Aligner(a.difficulty).pass_reference_genome(genome).get_alignment(read_mates(spark, a.first, a.second), a.n, a.mode)
    sinks.write_lines(paired.report_lines(rows, a.compat), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="tool", required=True)

    def tool(name, run, *places):
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place)
        p.set_defaults(run=run)
        p.add_argument("--compat", action="store_true", help="fixed quirks of established outputs")
        return p

    p = tool("kmers", _kmers, "reads", "out")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--statistics", action="store_true")
    p.add_argument("--pattern")
    p = tool("prefix-kmers", _prefix, "reads", "out")
    p.add_argument("-w", type=int, default=12)
    p.add_argument("-l", type=int, default=10)
    p = tool("overlaps", _overlaps, "reads", "out")
    p.add_argument("-k", type=int, default=31)
    p.add_argument("--iteration", type=int)
    p.add_argument("--slice", type=int, default=400)
    p = tool("cluster", _cluster, "edges", "out")
    p.add_argument("cutoff", type=float)
    p.add_argument("--nodes", type=int)
    p = tool("demux", _demux, "reads", "out")
    p.add_argument("-w", type=int, default=12)
    p.add_argument("-l", type=int, default=10)
    p.add_argument("-t", type=int, default=1000)
    tool("split-sff", _split, "sff", "adaptors", "out")
    tool("search", _search, "reads", "adaptors")
    p = tool("align", _align, "first", "second", "out")
    p.add_argument("--genome", nargs="+", required=True, help="id=file of each chromosome")
    p.add_argument("--difficulty", type=int, choices=[0, 1, 2], default=0)
    p.add_argument("--mode", choices=["fast", "accurate"], default="fast")
    p.add_argument("-n", type=int)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName(f"strandlake {args.tool}").getOrCreate(), args)


if __name__ == "__main__":
    main()

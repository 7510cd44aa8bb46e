"""Unsupervised demultiplexing: reads that share a prefix k-mer belong together.

Reads of equal prefix k-mers are of one kind, and the smallest stands for it. Kinds
and k-mers form a bipartite graph, one edge per kind and k-mer; its components
are those of the read graph without any pair of reads being made. There are no
more kinds than different prefixes, so the rounds don't grow with the reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.codec import encode, is_clean
from strandlake.operators.kmers import windows
from strandlake.plans.components import connected_components
from strandlake.plans.lineage import cut, total
from strandlake.plans.skew import lookup


def demux_clusters(reads: DataFrame, width: int = 12, k: int = 10, inclusive: bool = False) -> DataFrame:
    """(node, component) of every read; reads shorter than ``width`` are alone."""
    if width <= k:
        raise ValueError("width must be larger than k")
    last, n = width - k - (0 if inclusive else 1), F.length("sequence")
    made = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.upper(F.substring("sequence", i + 1, F.lit(k))))
    made = F.transform(F.filter(made, is_clean), lambda w: encode(w) if k <= 31 else w)
    rows = reads.where("read_id is not null").select("read_id", F.when(n >= width, made).otherwise(F.slice(made, 1, 0)).alias("kmers"))
    # a read is a row, repeated ids too; the texts aren't read again
    rows = cut(rows.groupBy("read_id").agg(F.array_distinct(F.flatten(F.collect_set("kmers"))).alias("kmers")))
    kinds = rows.where(F.size("kmers") > 0).groupBy("kmers").agg(F.min("read_id").alias("id"), F.count("*").alias("count"))
    kinds = cut(kinds)
    each = kinds.select("id", F.explode("kmers").alias("kmer"))
    heads = cut(each.groupBy("kmer").agg(F.min("id").alias("head"), F.count("*").alias("count")))
    # every kind of a k-mer is tied to the smallest: components stay the same, and k-mers need no node
    tied = lookup(each, heads.select("kmer", "head"), "kmer", counts=heads.select("kmer", "count"))
    found = connected_components(tied.select(F.col("id").alias("src"), F.col("head").alias("dst")))
    labels = cut(kinds.join(found, kinds["id"] == found["node"]).select("kmers", "component"))
    some = rows.where(F.size("kmers") > 0)
    named = lookup(some, labels, "kmers", counts=kinds.select("kmers", "count")) if total(kinds) else some.withColumn("component", F.col("read_id"))
    alone = rows.where(F.size("kmers") == 0).select(F.col("read_id").alias("node"), F.col("read_id").alias("component"))
    return named.select(F.col("read_id").alias("node"), "component").unionByName(alone)


def cluster_buckets(clusters: DataFrame, threshold: int = 1000, rest: str | None = "ungrouped") -> DataFrame:
    """(read_id, bucket): ``output<leader>`` for clusters of at least ``threshold`` reads, else ``rest``.

    With ``rest`` None the others are left out.
    """
    # a component may hold most reads: it is dealt out, and its size broadcast
    sizes = cut(clusters.groupBy("component").agg(F.count("*").alias("size")))
    met = lookup(clusters.select("node", "component"), sizes, "component", counts=sizes.select("component", F.col("size").alias("count")))
    named = met.select(
        F.col("node").alias("read_id"),
        F.when(F.col("size") >= threshold, F.concat(F.lit("output"), F.col("component").cast("string")))
        .otherwise(F.lit(rest)).alias("bucket"),
    )
    return named.where(F.col("bucket").isNotNull())


def demux_reads(reads: DataFrame, clusters: DataFrame, threshold: int = 1000, rest: str | None = "ungrouped") -> DataFrame:
    """Reads with the bucket they go to."""
    return reads.join(cluster_buckets(clusters, threshold, rest), "read_id")


def top_barcodes(reads: DataFrame, buckets: DataFrame, width: int = 12, k: int = 9) -> DataFrame:
    """(bucket, label, count): the most frequent prefix k-mer of each bucket; ties go to the smaller code."""
    rows = windows(reads.join(buckets, "read_id").select("read_id", "sequence", "bucket"), k, prefix=width)
    per = rows.groupBy("bucket", F.col("kmer").alias("label")).agg(F.count("*").alias("count"))
    best = F.min_by(F.struct("label", "count"), F.struct(-F.col("count"), encode("label", wide=True)))
    return per.groupBy("bucket").agg(best.alias("b")).select("bucket", "b.label", "b.count")

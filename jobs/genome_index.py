"""Keeps the k-mer index of a growing genome, and tells how much of each chromosome it can place.

An aligner looks k-mers of its reads up in an index of the genome; a k-mer that
occurs in several places says little. Each run of this job takes the chromosomes
above the high-water mark, the largest id indexed so far, adds their k-mers to
``out/index`` (bucketed by code, partitioned by load), moves the mark in
``out/marks``, and makes ``out/mappability`` anew, partitioned by load: for each
chromosome the number of its indexed k-mers and of those found nowhere else.

A load's number follows from the mark, and the mark is moved last. A run that
fails before that is repeated under the same number and overwrites what it had
written. A run without new chromosomes leaves everything as it was.
Chromosomes without an id can't be told from one another and are left out, which
the log says; ids must grow with time.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.genome_index import BUCKETS, INDEX, add, mappability, opened, put
from strandlake.operators.paired import chunked, kmer_index
from strandlake.plans.bridge import bases

MARKS = "high BIGINT, chromosomes BIGINT"
RESULT = "chr_id long, n_kmers long, n_unique long, load int"

log = logging.getLogger("genome_index")


def chromosomes(texts: DataFrame) -> DataFrame:
    """(chr_id, sequence) of texts (doc_id, text); a text without bases is none."""
    return texts.select(F.col("doc_id").cast("long").alias("chr_id"), bases().alias("sequence")).where(F.length("sequence") > 0)


def read_mappability(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(RESULT).parquet(f"{out}/mappability")


def run(spark: SparkSession, texts: str, out: str, step: int = 10, buckets: int = BUCKETS) -> DataFrame:
    """Index the chromosomes above the mark, and tell how many k-mers of each are unique in the genome so far.

    ``texts`` is a table (doc_id, text) whose letters spell chromosomes; every
    ``step``-th start is indexed. Returns the mappability of all chromosomes.
    """
    with opened(spark, f"{out}/marks", MARKS) as marks, opened(spark, f"{out}/index", INDEX, int(buckets)) as index:
        before = spark.table(marks).agg(F.max("load").alias("load"), F.max("high").alias("high")).first()
        table = spark.read.parquet(texts).select("doc_id", "text")
        fresh = table.where(F.col("doc_id").isNotNull() if before["high"] is None else F.col("doc_id") > before["high"])
        seen = fresh.agg(F.count("*").alias("n"), F.max("doc_id").alias("high")).first()
        log.info("mark at %s: %d new texts in %s, %d without an id", before["high"], seen["n"], texts, table.where("doc_id is null").count())
        load = (before["load"] or 0) + 1
        if seen["n"]:
            # what arrives meanwhile is above the new mark, and waits for the next run
            genome = chromosomes(fresh.where(F.col("doc_id") <= seen["high"]))
            add(index, load, kmer_index(chunked(genome), step=int(step)), int(buckets))
        spark.catalog.refreshTable(index)
        mappability(spark.table(index)).write.mode("overwrite").partitionBy("load").parquet(f"{out}/mappability")
        if seen["n"]:
            put(marks, load, spark.range(1).select(F.lit(int(seen["high"])).cast("long").alias("high"), F.lit(int(seen["n"])).cast("long").alias("chromosomes")))
        found = read_mappability(spark, out)
        total = found.agg(F.count("*"), F.coalesce(F.sum("n_kmers"), F.lit(0)), F.coalesce(F.sum("n_unique"), F.lit(0))).first()
        log.info("%s: %d chromosomes, %d k-mers in %s/index, %d unique, in %s/mappability", f"load {load}" if seen["n"] else "no load", *total[:2], out, total[2], out)
    return found


if __name__ == "__main__":
    from jobs.command import main

    main("genome_index", run, {"texts": "table of texts", "out": "folder of the results", "step": "distance of indexed starts"})

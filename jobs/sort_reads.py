"""Sorts arriving reads by adaptor.

A sequencing run delivers its reads in files, and those of many samples together;
the adaptor at a read's beginning tells which it is. Each run of this job takes
the files that have come since the last one, finds in every read the first place
where an adaptor stands, and adds the reads to ``out/reads``, partitioned by
batch and adaptor (``noBarCode`` for the rest). Then ``out/summary`` is made anew
from all reads sorted so far: one row for each adaptor, those without reads too.

What is new is told by the checkpoint of a file stream. A batch that is repeated
after a failure consists of the same files and overwrites its own partitions, so
nothing is lost or doubled; a run without new files leaves everything as it was.
Reads stay where the adaptors of their run put them.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.dictionary import first_matches, small
from strandlake.plans.bridge import adaptors_of, reads_of

REST = "noBarCode"
SORTED = "read_id long, source string, pos int, sequence string, batch long, adaptor string"

log = logging.getLogger("sort_reads")


def sorted_reads(reads: DataFrame, adaptors: DataFrame) -> DataFrame:
    """(read_id, source, pos, sequence, adaptor): each read with its first adaptor."""
    found = first_matches(reads, adaptors).join(small(adaptors.select("adaptor_idx", "name")), "adaptor_idx", "left")
    return found.select("read_id", "source", F.col("pos").cast("int").alias("pos"), "sequence", F.coalesce("name", F.lit(REST)).alias("adaptor"))


def summary(sorted_: DataFrame, adaptors: DataFrame) -> DataFrame:
    """(adaptor, n_reads, n_bases, n_bad, n_batches) of every adaptor and of the rest."""
    per = sorted_.groupBy("adaptor").agg(
        F.count("*").alias("n_reads"), F.sum(F.length("sequence")).alias("n_bases"),
        F.count_if(F.col("sequence").contains("N")).alias("n_bad"), F.countDistinct("batch").alias("n_batches"),
    )
    names = adaptors.select(F.col("name").alias("adaptor")).unionByName(adaptors.sparkSession.range(1).select(F.lit(REST).alias("adaptor")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_reads", "n_bases", "n_bad", "n_batches")]
    return names.join(per, "adaptor", "left").select("adaptor", *counts)


def read_sorted(spark: SparkSession, out: str) -> DataFrame:
    """All reads sorted so far."""
    return spark.read.schema(SORTED).parquet(f"{out}/reads")


def run(spark: SparkSession, texts: str, adaptors: str, out: str, checkpoint: str | None = None, adaptor_length: int = 8, files_per_batch: int = 1000) -> DataFrame:
    """Sort the reads of files that are new since the last run by adaptor, and sum up all so far.

    ``texts`` is a folder of Parquet files (doc_id, text, source), or a pattern
    for such; the letters of a text spell reads. ``adaptors`` is a table
    (item_id, text). Returns all reads sorted so far.
    """
    keys = adaptors_of(spark.read.parquet(adaptors), int(adaptor_length))
    schema = spark.read.parquet(texts).select("doc_id", "text", "source").schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_batch)).parquet(texts)

    def work(batch: DataFrame, number: int) -> None:
        rows = sorted_reads(reads_of(batch, "source"), keys).withColumn("batch", F.lit(number).cast("long"))
        # tasks write few, large files: partitions go by adaptor, and large adaptors are split
        rows.hint("rebalance", "adaptor").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "adaptor").parquet(f"{out}/reads")

    stream = arriving.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{out}/checkpoint").foreachBatch(work).start()
    stream.awaitTermination()
    for step in stream.recentProgress:
        if step.numInputRows:
            log.info("batch %d: read %d texts from %s", step.batchId, step.numInputRows, texts)
    found = read_sorted(spark, out)
    summary(found, keys).write.mode("overwrite").parquet(f"{out}/summary")
    for row in spark.read.parquet(f"{out}/summary").orderBy(F.desc("n_reads"), "adaptor").limit(10).collect():
        log.info("%s: %d reads, %d bases, %d with a bad base, in %d batches, in %s/reads", *row, out)
    return found


if __name__ == "__main__":
    from jobs.command import main

    main("sort_reads", run, {
        "texts": "folder of texts", "adaptors": "table of adaptors", "out": "folder of the results", "checkpoint": "folder of the stream's checkpoint",
    })

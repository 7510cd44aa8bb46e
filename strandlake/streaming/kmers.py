"""K-mer counts over reads that keep arriving, and demultiplexing of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.kmers import windows

READS = "read_id long, identifier string, sequence string, quality string"


def stream_reads(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of reads as they appear in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_fastq(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """(file, read_id, identifier, sequence, quality) of FASTQ files as they appear in a folder.

    A file that arrives is complete, so it is one row of text and its records are
    cut within the row; malformed ones are left out. Files larger than a row may
    be should arrive in parts.
    """
    text = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    rows = text.select(F.col("_metadata.file_path").alias("file"), lines.alias("_l")).where(F.size("_l") >= 4)
    starts = F.sequence(F.lit(0).cast("long"), F.floor(F.size("_l") / 4) - 1)

    def line(i, k):
        return F.get("_l", (4 * i + k).cast("int"))

    made = F.transform(starts, lambda i: F.struct(
        i.alias("read_id"), line(i, 0).alias("identifier"), line(i, 1).alias("sequence"), line(i, 2).alias("_plus"), line(i, 3).alias("quality"),
    ))
    good = F.startswith("identifier", F.lit("@")) & F.startswith("_plus", F.lit("+"))
    return rows.select("file", F.inline(made)).where(good).drop("_plus")


def streaming_kmer_counts(reads: DataFrame, k: int, **how) -> DataFrame:
    """(label, count); state is one row per k-mer. Use output mode ``update`` or ``complete``."""
    return windows(reads.select("sequence"), k, **how).groupBy(F.col("kmer").alias("label")).agg(F.count("*").alias("count"))


def for_each_batch(reads: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch operator, such as demultiplexing, on every micro-batch; returns the started query."""
    return reads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).start()

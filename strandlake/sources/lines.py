"""Text files as numbered lines, without a shuffle and from any store Spark reads.

Rows of a file split are contiguous within a partition, so a line's number is
the count of lines in the splits before it plus its distance from the split's
first row. Only one row per split is aggregated and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, block, line_no, value): 0-based numbers in file order; a trailing carriage return is removed.

    ``block`` is where the line's split begins in the file.
    """
    text = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, list) else [paths])
    rows = text.select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    )
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file split: bounded by the input's size over the split size
    offsets = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(offsets), ["file", "block"]).select("file", "block", (F.col("row") + F.col("shift")).alias("line_no"), "value")

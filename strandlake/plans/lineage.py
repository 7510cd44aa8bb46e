"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: WeakKeyDictionary[DataFrame, tuple[str, dict]] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between steps: what ``spark.checkpoint.dir`` names, or the context's checkpoint folder.

    Where both are unset, a local master gets a temporary folder; on a cluster
    that would leave each machine's files to itself, so it is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    store, where = _place(spark, path)
    store.delete(where, True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    store, where = _place(spark, path)
    store.deleteOnExit(where)
    return path


def cut(df: DataFrame, **totals: Column) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it from there.

    The table goes with :func:`spent`, or when the application ends. Its number
    of rows, and aggregates given as ``totals``, are observed while it is
    written, so :func:`total` needs no job of its own.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in totals.items()]).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = (path, seen.get)
    return out


def total(df: DataFrame, name: str = "rows"):
    """What :func:`cut` observed of a frame that it returned; None for other frames."""
    known = _written.get(df)
    return known[1].get(name) if known else None


def spent(*frames: DataFrame | None) -> None:
    """Delete the tables of frames from :func:`cut` that nothing will read again; other frames are ignored."""
    for df in frames:
        known = _written.pop(df, None) if df is not None else None
        if known is not None:
            forget(df.sparkSession, known[0])


def swept(spark: SparkSession) -> None:
    """Let go of shuffles that no frame needs any more: Spark deletes their files when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

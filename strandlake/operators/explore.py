"""Exploration: percent-range filters, histograms, length statistics, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.plans.lineage import cut


def column_range(df: DataFrame, column: str) -> DataFrame:
    """(low, high, range) of a column, one row."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"), (F.max(column) - F.min(column)).alias("range"))


def percent_range_filter(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows strictly between two percentages of each column's range; 0 and 100 exclude the extremes themselves.

    ``accuracy`` and ``acc`` name the same column. The frame is written once;
    its extremes, one row, are aggregated from there and enter the filter as
    literals, which reach the scan of what was written.
    """
    df = cut(df)
    alias = {"acc": "accuracy", "accuracy": "acc"}
    named = {c if c in df.columns else alias.get(c, c): b for c, b in bounds.items()}
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in named for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for c, (low, high) in named.items():
        least, most = ends[f"lo_{c}"], ends[f"hi_{c}"]
        if least is None:
            return df.limit(0)
        span = most - least
        df = df.where((F.col(c) > least + low / 100.0 * span) & (F.col(c) < least + high / 100.0 * span))
    return df


def event_message(df: DataFrame, most: int = 100) -> tuple[int, str]:
    """(count, message) of the rows that a filter left."""
    n = df.count()
    tail = f"sampling {most} random events below" if n > most else "all are shown below"
    return n, f"{n} events captured, {tail}"


def sample_events(df: DataFrame, most: int = 100, seed: int = 0) -> DataFrame:
    """A Bernoulli sample of about ``most`` rows if there are more."""
    n = df.count()
    return df.sample(False, most / n, seed) if n > most else df


def hash_sample(df: DataFrame, *keys: str, most: int = 100) -> DataFrame:
    """About ``most`` rows if there are more: those whose key has a small hash, the same ones each time and on any cluster.

    A row is chosen by the first 32 bits of the MD5 of its key (columns as text,
    joined by commas; a null is empty), so rows of equal keys go together, and a
    sample of more rows holds that of fewer. The threshold is floor(2^32 * most / n).
    """
    n = df.count()
    if n <= most:
        return df
    text = F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.where(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < (most << 32) // n)


def histogram(df: DataFrame, column: str, width: float, low: float = 0.0) -> DataFrame:
    """(bin, lower, count): bin is ``floor((value - low) / width)``."""
    index = F.floor((F.col(column) - low) / width).cast("long")
    rows = df.where(F.col(column).isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("count"))
    return rows.select("bin", (F.lit(float(low)) + F.col("bin") * float(width)).alias("lower"), "count")


def length_statistics(reads: DataFrame) -> DataFrame:
    """(n_reads, mean_length, sd_length), the sample standard deviation."""
    n = F.length("sequence")
    return reads.agg(F.count("*").alias("n_reads"), F.avg(n).alias("mean_length"), F.stddev_samp(n).alias("sd_length"))


def nth_read(reads: DataFrame, n: int) -> DataFrame:
    """The n-th record, from 1, of reads numbered from 0."""
    return reads.where(F.col("read_id") == n - 1)

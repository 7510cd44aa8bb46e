"""Left joins that no hot key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than LEAST rows and more than one row in SHARE, so there are fewer hot keys than SHARE.
SHARE, LEAST = 500, 5_000


def lookup(
    rows: DataFrame, table: DataFrame, key: str, named: str | None = None, counts: DataFrame | None = None, share: int = SHARE,
    least: int = LEAST, size: int | None = None,
) -> DataFrame:
    """``rows`` left join ``table`` on ``key`` (called ``named`` in the table), whose keys there are unique and not null.

    Hot keys are found by a partial count (``counts``, key and count, if that
    is known already), unless all rows (``size``, if known) are too few for one;
    they are fewer than ``share``, so their part of the table
    is broadcast. All other keys are joined as Spark chooses, with the rows of
    hot keys dealt out by a hash over keys that match nothing.
    """
    named = named or key
    plain = table.withColumnRenamed(named, "_key")
    if size is not None and size <= least:
        return rows.join(plain, F.col(key) == F.col("_key"), "left").drop("_key")
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")) if counts is None else counts
    total, top = counts.agg(F.sum("count"), F.max("count")).first()
    if not total or top <= least or top * share <= total:
        return rows.join(plain, F.col(key) == F.col("_key"), "left").drop("_key")
    many = counts.where((F.col("count") > least) & (F.col("count") * share > total)).select(key).collect()
    hot = [F.lit(r[0]).cast(counts.schema[key].dataType) for r in many]  # isin by itself makes no literal of an array
    values = [c for c in plain.columns if c != "_key"]
    part = F.broadcast(plain.where(F.col("_key").isin(hot)).select("_key", F.struct(*values).alias("_hot")))
    found = rows.join(part, F.col(key) == F.col("_key"), "left").drop("_key")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = found.withColumns({
        "_near": F.when(~is_hot, F.col(key)),
        "_spread": F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(4 * share))).otherwise(F.lit(-1).cast("long")),
    })
    cold = plain.where(~F.col("_key").isin(hot)).select("_key", F.lit(-1).cast("long").alias("_none"), F.struct(*values).alias("_cold"))
    joined = dealt.join(cold, F.col("_near").eqNullSafe(F.col("_key")) & (F.col("_spread") == F.col("_none")), "left")
    out = [F.coalesce(F.col("_hot").getField(c), F.col("_cold").getField(c)).alias(c) for c in values]
    return joined.select(*rows.columns, *out)

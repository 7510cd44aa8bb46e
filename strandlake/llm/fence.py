"""Keeping filters from being inlined into expensive expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with a boundary that filters on the result don't cross.

    The optimiser pushes a filter through projections by substituting every
    column with its definition, again and again; where definitions use each
    other several times the filter becomes exponentially large. It doesn't push
    through a projection that isn't deterministic, and a condition on the number
    of the partition, which always holds, makes one.
    """
    return df.withColumns({c: F.when(F.spark_partition_id() >= 0, F.col(c)) for c in columns})

"""Reads, adaptors, genome and mates derived from the text tables, for queries and benchmarks.

Letters of a text that are bases spell its sequence (X plays N); the whole
sequence is cut into consecutive reads of ``READ`` bases. All steps exist in SQL
as well, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ = 150


def bases(text: str = "text"):
    """Base letters of a text, upper case."""
    return F.regexp_replace(F.translate(F.upper(F.coalesce(F.col(text), F.lit(""))), "NX", "¤N"), "[^ACGTN]+", "")


def reads_of(docs: DataFrame, *keep: str, quality: bool = False) -> DataFrame:
    """(read_id, *keep, sequence[, quality]) of texts (doc_id, text, *keep); read_id is doc_id * 100000 plus the read's place in its text.

    The pieces of a text are an array made within the row, so the text itself
    isn't repeated for each of its reads. The generator is an outer one, as the
    optimiser else tests the array's size in a filter and so makes it twice.
    """
    starts = F.sequence(F.lit(0), F.length("s") - 1, F.lit(READ))
    pieces = F.transform(starts, lambda at, i: F.struct(i.alias("part"), F.substring("s", at + 1, F.lit(READ)).alias("sequence")))
    rows = docs.select("doc_id", *keep, bases().alias("s")).select("doc_id", *keep, F.when(F.length("s") > 0, pieces).alias("pieces"))
    rows = rows.select("doc_id", *keep, F.inline_outer("pieces")).where(F.col("sequence").isNotNull()).select((F.col("doc_id") * 100000 + F.col("part")).alias("read_id"), *keep, "sequence")
    if not quality:
        return rows
    score = F.transform(
        F.split("sequence", ""),
        lambda c, i: F.when(c == "N", "!").otherwise(F.chr((33 + (7 * F.ascii(c) + 3 * i + F.col("read_id")) % 41).cast("long"))),
    )
    return rows.withColumn("quality", F.array_join(score, ""))


def reads(spark: SparkSession, sf_dir: str, quality: bool = False) -> DataFrame:
    """Reads of all documents, see :func:`reads_of`."""
    return reads_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality=quality)


def adaptors(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """(adaptor_idx, name, bases): the first bases of each benchmark item, equal ones once."""
    return adaptors_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size)


def adaptors_of(items: DataFrame, size: int = 8) -> DataFrame:
    """The same of a table (item_id, text)."""
    items = items.select("item_id", F.substring(bases(), 1, size).alias("bases"))
    rows = items.where((F.length("bases") == size) & ~F.col("bases").contains("N")).groupBy("bases").agg(F.min("item_id").alias("adaptor_idx"))
    return rows.select("adaptor_idx", F.concat(F.lit("a"), F.col("adaptor_idx").cast("string")).alias("name"), "bases")


READS_SQL = """
docs AS (SELECT doc_id, regexp_replace(translate(upper(coalesce(text, '')), 'NX', '¤N'), '[^ACGTN]', '', 'g') AS s FROM documents),
reads AS (
  SELECT doc_id * 100000 + i AS read_id, substr(s, CAST(i * 150 + 1 AS INT), 150) AS sequence
  FROM (SELECT doc_id, s, unnest(range((length(s) + 149) // 150)) AS i FROM docs WHERE length(s) > 0)
)"""
QUALITY_SQL = READS_SQL + """,
scored AS (
  SELECT read_id, sequence, list_transform(range(length(sequence)), lambda i:
    CASE WHEN sequence[i + 1] = 'N' THEN 0 ELSE (7 * ascii(sequence[i + 1]) + 3 * i + read_id) % 41 END) AS q
  FROM reads
)"""
ADAPTORS_SQL = """
items AS (SELECT item_id, substr(regexp_replace(translate(upper(text), 'NX', '¤N'), '[^ACGTN]', '', 'g'), 1, 8) AS bases FROM benchmark),
adaptors AS (
  SELECT min(item_id) AS adaptor_idx, 'a' || min(item_id) AS name, bases FROM items
  WHERE length(bases) = 8 AND NOT contains(bases, 'N') GROUP BY bases
)"""

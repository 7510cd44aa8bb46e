"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, language_id, line_crf, near_dedup, packing
from strandlake.plans.lineage import cut, forget, shared_folder
from strandlake.plans.shipping import ship

#: The smallest quality with which a document stays.
QUALITY_SCORE = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """The text, and all other columns in one struct, so that no name can clash with an operator's."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a frame made of :func:`_carried`."""
    return found.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not ``und``. Scores of short texts are low, however clean, so none is asked for."""
    ship(spark)
    model = language_id.fit(docs)
    found = language_id.classify(_carried(docs), model, keep_text=True)
    return _restored(found.where(F.col("lang_pred") != language_id.UNKNOWN), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY_SCORE."""
    ship(spark)
    model = line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(line_crf.classify(_carried(docs), model, keep_text=True).where(F.col("score") >= QUALITY_SCORE), docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """:func:`_carried` with ``_n``: a number for each pair of id and text, in the order of ids; null beside a null id."""
    rows = _carried(docs).withColumn("_id", F.col("_row.doc_id").cast("long"))
    rows = rows.withColumn("_print", F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit("")))
    pairs = rows.where("_id is not null").select("_id", "_print").distinct().orderBy("_id", "_print")
    # partitions of a sorted frame are ranges in order, so these ids rise with the pairs; the table makes them last
    numbers = cut(pairs.withColumn("_n", F.monotonically_increasing_id()))
    return rows.join(numbers, ["_id", "_print"], "left").select("text", "_row", "_n")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each near-duplicate group (5-word shingles, similarity 0.8).

    Where ids repeat, rows of one id and different texts are documents of their
    own, and of equal rows one stays. Documents without an id all stay.
    """
    ship(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = near_dedup.near_duplicates(docs)
        gone = found.where(~F.col("kept")).select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = _numbered(docs)
    found = near_dedup.near_duplicates(rows.select(F.col("_n").alias("doc_id"), "text"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_n")).distinct()
    kept = rows.join(gone, "_n", "left_anti").select("text", "_row", "_n")
    return _restored(kept.where("_n is not null").dropDuplicates(["_n"]).unionByName(kept.where("_n is null")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    ship(spark)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_leaks(_carried(docs), bench, size=10, spans=False, keep_text=True)
    return _restored(found.where(~F.col("contaminated")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return packing.pack(docs)


STAGES = [
    ("language", language), ("quality", quality), ("near-dedup", dedup), ("decontamination", decontamination), ("packing", packed),
]
#: The models of the first two stages can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ship(spark)
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path = f"{top}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            forget(spark, before)
        before = path
    return docs

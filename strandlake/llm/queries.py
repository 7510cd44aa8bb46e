"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.sql import ORACLE_SQL
from strandlake.plans.shipping import ship

__all__ = ["ORACLE_SQL", "QUERIES"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _held(modulus: int, remainder: int):
    """Whether a row is of the held-out fold; a row without an id is not, as no label can be of it."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and Jensen-Shannon distances to language references for every document."""
    from strandlake.llm.divergence import quality_rules

    found = quality_rules(_read(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("word_distance", "char_distance")})


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from a linear-chain field over its lines."""
    from strandlake.llm import line_crf

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.fit(docs, _read(spark, sf_dir, "labels"))
    return line_crf.classify(docs, model).select(
        "doc_id", _held(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation for every page's url; outcomes come from the pages' content."""
    from strandlake.llm.url_reputation import content_outcomes, filter_urls

    pages = _read(spark, sf_dir, "pages")
    return filter_urls(pages, content_outcomes(pages)).select("page_id", "host", "path", "rule", "verdict", F.round("bound", 9).alias("bound"))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets of least padding and token-budget batches of all documents."""
    from strandlake.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from strandlake.llm.page_diff import extract

    return extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing against suffix automata."""
    from strandlake.llm import language_id

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.classify(docs.drop("lang"), language_id.fit(docs))
    return found.select("doc_id", _held(4, 2).alias("held_out"), "lang_pred", "score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a similarity of 0.8 or more."""
    from strandlake.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), width=4, threshold=(80, 100))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-word windows of benchmark items in documents."""
    from strandlake.llm.decontaminate import find_leaks

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, _read(spark, sf_dir, "benchmark"), size=10, spans=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document from a learnt lexicon."""
    from strandlake.llm import toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.classify(docs, lexicon).select(
        "doc_id", _held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts in every document."""
    from strandlake.llm.licenses import scan

    found = scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("dice", 9).alias("dice"), F.array_join("licenses", ",").alias("licenses"), "n_units")


def op11_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and unigram scores of every document."""
    from strandlake.llm import maxent_lm

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = maxent_lm.score(docs, maxent_lm.fit(docs, _held(5, 1)))
    return found.select("doc_id", _held(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its terms above the language's share."""
    from strandlake.llm.source_audit import audit

    return audit(_read(spark, sf_dir, "documents"), least=30, top=50)


QUERIES = {
    "op1_distribution_divergence": op1_distribution_divergence,
    "op3_url_reputation": op3_url_reputation,
    "op4_length_buckets": op4_length_buckets,
    "op10_license_scan": op10_license_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op5_page_differencing": op5_page_differencing,
    "op6_language_id": op6_language_id,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op11_maxent_lm": op11_maxent_lm,
    "op12_source_audit": op12_source_audit,
}

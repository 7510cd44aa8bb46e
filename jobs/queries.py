"""The jobs as registered queries: each runs twice into a new shared folder, and its whole output is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import genome_index, sort_reads
from strandlake.plans.bridge import ADAPTORS_SQL, READS_SQL
from strandlake.plans.lineage import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_sort_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of all documents, sorted by adaptor as a stream of files; the second run finds nothing new."""
    out = _folder(spark, "sort_reads")
    for _ in range(2):
        found = sort_reads.run(spark, f"{sf_dir}/documents.parquet*", f"{sf_dir}/benchmark.parquet", out)
    return found.select("read_id", "source", F.col("pos").cast("long").alias("pos"), "sequence", "adaptor")


def job2_genome_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of all documents as chromosomes, and what it can place; the second run finds nothing above the mark."""
    out = _folder(spark, "genome_index")
    for _ in range(2):
        found = genome_index.run(spark, f"{sf_dir}/documents.parquet", out)
    return found.select("chr_id", "n_kmers", "n_unique", F.col("load").cast("long").alias("load"))


QUERIES = {"job1_sort_reads": job1_sort_reads, "job2_genome_index": job2_genome_index}
ORACLE_SQL = {
    "job1_sort_reads": f"""WITH {READS_SQL},{ADAPTORS_SQL},
hit AS (SELECT r.read_id, strpos(sequence, bases) - 1 AS pos, name, adaptor_idx FROM reads r JOIN adaptors ON contains(sequence, bases)),
first AS (SELECT read_id, pos, name FROM hit QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY pos, adaptor_idx) = 1)
SELECT read_id, source, CAST(pos AS BIGINT) AS pos, sequence, coalesce(name, 'noBarCode') AS adaptor
FROM reads LEFT JOIN first USING (read_id) JOIN documents ON doc_id = read_id // 100000""",
    "job2_genome_index": f"""WITH {READS_SQL},
idx AS (
  SELECT chr_id, kmer FROM (
    SELECT doc_id AS chr_id, substr(s, CAST(10 * i + 1 AS INT), 30) AS kmer FROM (SELECT doc_id, s, unnest(range((greatest(length(s) - 29, 0) + 9) // 10)) AS i FROM docs)
  ) WHERE NOT regexp_matches(kmer, '[^ACGT]')
),
counted AS (SELECT chr_id, count(*) OVER (PARTITION BY kmer) AS n FROM idx)
SELECT chr_id, count(*) AS n_kmers, CAST(count(*) FILTER (n = 1) AS BIGINT) AS n_unique, CAST(1 AS BIGINT) AS load FROM counted GROUP BY chr_id""",
}

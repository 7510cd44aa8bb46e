"""Registered queries of the paired aligner, of read pairs and of dictionaries of mixed lengths, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import codec
from strandlake.operators import demux, dictionary, explore, graph, kmers, overlap, paired
from strandlake.plans.bridge import READS_SQL, bases, reads
from strandlake.plans.shipping import ship
from strandlake.sources import sinks

#: Stride of the genome's index in these queries; a read whose id it divides by SCRAMBLED gets mates from nowhere.
STEP, SCRAMBLED = 2, 5
NOWHERE = "ACGGT" * 9


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr_id, sequence): the bases of every text as a chromosome."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chr_id"), bases().alias("sequence"))
    return docs.where(F.length("sequence") > 0)


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates of 45 bases of every read that has them without N, the second as its reverse complement; some from nowhere."""
    rows = reads(ship(spark), sf_dir).where(F.length("sequence") >= 135)
    none = F.col("read_id") % SCRAMBLED == 0
    cut = rows.select(
        F.col("read_id").alias("pair_id"), F.lit("m1").alias("name1"), F.when(none, NOWHERE).otherwise(F.substring("sequence", 11, 45)).alias("seq1"),
        F.lit("m2").alias("name2"), F.when(none, NOWHERE).otherwise(codec.reverse_complement(F.substring("sequence", 91, 45))).alias("seq2"),
    )
    return cut.where(codec.is_clean("seq1") & codec.is_clean("seq2"))


def genome_kmers(spark, sf_dir):
    """The genome's index of 30-mers at every tenth base."""
    rows = paired.kmer_index(paired.chunked(genome(spark, sf_dir)))
    return rows.select("chr_id", F.col("ref_pos").cast("long").alias("ref_pos"), "code")


def mate_seeds(spark, sf_dir):
    """Seeds of both mates under both hypotheses."""
    rows = paired.seeds(mates(spark, sf_dir), step=STEP)
    return rows.select("pair_id", "strand", F.col("mate").cast("long").alias("mate"), F.col("read_pos").cast("long").alias("read_pos"), "code")


def _candidates(spark, sf_dir) -> DataFrame:
    return paired.all_candidates(mates(spark, sf_dir), paired.chunked(genome(spark, sf_dir)), step=STEP)


def seed_candidates(spark, sf_dir):
    """Hits of the seeds in the genome, one for each diagonal."""
    return _candidates(spark, sf_dir).select(
        "pair_id", "strand", F.col("mate").cast("long").alias("mate"), "chr_id", F.col("ref_pos").cast("long").alias("ref_pos"),
        F.col("read_pos").cast("long").alias("read_pos"),
    )


def pair_ranking(spark, sf_dir):
    """The best pair of candidates of each read pair under a made score."""
    pairs, chunks = mates(spark, sf_dir), paired.chunked(genome(spark, sf_dir))

    def score(ref, read, mate):
        return (ref * 7 + read * 3 + mate) % 101

    if paired.plain(pairs, chunks, STEP):
        best = paired.ranked_pairs(pairs, chunks, score, step=STEP)
        return best.select("pair_id", "chr_id", "strand", "total", "first1", "first2")
    found = _candidates(spark, sf_dir)
    first = F.col("ref_pos") - F.col("read_pos")
    scored = found.select(
        "*", score(F.col("ref_pos"), F.col("read_pos"), F.col("mate")).cast("int").alias("score"), first.alias("first"), (first + 45).alias("last"), F.lit(0).alias("mismatches"), F.lit(0).alias("indels"), F.lit(45).alias("len")
    )
    best = paired.best_pairs(scored)
    return best.select(
        "pair_id", "chr_id", "strand", F.col("total").cast("long").alias("total"), F.col("m1.first").cast("long").alias("first1"),
        F.col("m2.first").cast("long").alias("first2"),
    )


def _alignments(spark, sf_dir) -> DataFrame:
    return paired.align_pairs(mates(spark, sf_dir), genome(spark, sf_dir), step=STEP)


def paired_alignment(spark, sf_dir):
    """Mates cut from every read aligned to the genome of all texts (H: X4, X5, J9, J10, L2, L4, L6, A20, F15)."""
    return _alignments(spark, sf_dir).select(
        "pair_id", F.col("mate").cast("long").alias("mate"), "name", "chr_id", "begin", "end", "strand", F.round("probability", 9).alias("probability")
    )


def alignment_report(spark, sf_dir):
    """The same as lines, pairs without an alignment included, counted."""
    return paired.report_lines(_alignments(spark, sf_dir)).groupBy("value").agg(F.count("*").alias("n"))


def reference_slice(spark, sf_dir):
    """40 bases of one chromosome."""
    return paired.reference_slice(genome(spark, sf_dir), 3, 10, 40)


def mixed_adaptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(adaptor_idx, name, bases): the first 4 to 8 bases of each benchmark item, N's included, prefixes of one another too."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = items.select(F.col("item_id").alias("adaptor_idx"), F.substring(bases(), F.lit(1), F.lit(4) + (F.col("item_id") % 5).cast("int")).alias("bases"))
    return rows.select("adaptor_idx", F.concat(F.lit("a"), F.col("adaptor_idx").cast("string")).alias("name"), "bases")


def dictionary_windows(spark, sf_dir):
    """Windows of all reads by the key that begins them, of several keys the first."""
    found = dictionary.window_matches(reads(spark, sf_dir), mixed_adaptors(spark, sf_dir))
    return found.groupBy("adaptor_idx").agg(F.count("*").alias("n_windows"), F.countDistinct("read_id").alias("n_reads"), F.sum("pos").alias("positions"))


def dictionary_longest(spark, sf_dir):
    """The same with the longest key."""
    found = dictionary.window_matches(reads(spark, sf_dir), mixed_adaptors(spark, sf_dir), longest=True)
    return found.groupBy("adaptor_idx").agg(F.count("*").alias("n_windows"), F.sum("pos").alias("positions"))


def dictionary_profile(spark, sf_dir):
    """Size, key lengths and collisions of that dictionary."""
    rows = dictionary.dictionary_profile(mixed_adaptors(spark, sf_dir))
    return rows.select(*[F.col(c).cast("long").alias(c) for c in rows.columns])


def barcode_patterns(spark, sf_dir):
    """Reads by regular expressions found in their first 15 bases."""
    found = dictionary.barcode_regex_hits(reads(spark, sf_dir), list(PATTERNS))
    return found.groupBy("bases").agg(F.count("*").alias("n_reads"))


#: Expressions of :func:`barcode_patterns`.
PATTERNS = ("^TT", "A[CG]T", "GA+T$", "(AC){2}", "N")


def head_motif(spark, sf_dir):
    """Heads of 15 bases that contain a motif."""
    rows = reads(spark, sf_dir).select("read_id", F.substring("sequence", 1, 15).alias("head"))
    return rows.where(F.contains("head", F.lit("TTA")))


def read_slice(spark, sf_dir):
    """A range of read ids, and the one record of a number."""
    rows = reads(spark, sf_dir)
    one = explore.nth_read(rows, 300_002)
    return overlap.read_range(rows, 100_000, 700_000).select("read_id", F.lit("range").alias("part")).unionByName(one.select("read_id", F.lit("one").alias("part")))


def filter_message(spark, sf_dir):
    """How many k-mers two filters leave, and what is said of them."""
    spark = ship(spark)
    stats = kmers.kmer_counts(reads(spark, sf_dir), 6)
    made = [(name, *explore.event_message(explore.percent_range_filter(stats, {"count": bounds}))) for name, bounds in MESSAGES.items()]
    return spark.createDataFrame(made, "name string, n long, message string")


#: Percentages of the range of counts by :func:`filter_message`.
MESSAGES = {"low": (0, 40), "high": (80, 100)}


def pattern_log2(spark, sf_dir):
    """Binary logarithm of the number of distinct k-mers by k."""
    rows = kmers.pattern_log2(reads(spark, sf_dir), range(1, 13))
    return rows.select(F.col("k").cast("long").alias("k"), "n_kmers", F.round("log2", 9).alias("log2"), "shown")


def run_summary(spark, sf_dir):
    """Counts of a run in one row: reads, reads with a bad base, bases, distinct prefix 10-mers and clusters."""
    rows = reads(spark, sf_dir)
    counts = sinks.summary(rows, n_bad=F.count_if(codec.first_bad_base("sequence") > 0), n_bases=F.sum(F.length("sequence")))
    n_kmers = kmers.windows(rows, 10, prefix=12).select("kmer").distinct().count()
    n_clusters = graph.component_sizes(demux.demux_clusters(rows)).count()
    made = [(counts["n_reads"], counts["n_bad"], counts["n_bases"], n_kmers, n_clusters)]
    return spark.createDataFrame(made, "n_reads long, n_bad long, n_bases long, n_kmers long, n_clusters long")


def view_codes(spark, sf_dir):
    """Codes of 20 bases from the 100th of each read, past the end too."""
    rows = reads(spark, sf_dir)
    return rows.select("read_id", codec.view("sequence", 100, 20).cast("string").alias("code"), codec.first_bad_base("sequence").cast("long").alias("bad"))


def edge_columns(spark, sf_dir):
    """Unequal columns of the overlap of each pair as an edge list."""
    rows = reads(ship(spark), sf_dir)
    return overlap.shared_kmer_overlaps(rows, 31).select("read1", "read2", "overlap_score")


QUERIES = {f.__name__: f for f in (
    genome_kmers, mate_seeds, seed_candidates, pair_ranking, paired_alignment, alignment_report, reference_slice, dictionary_windows,
    dictionary_longest, dictionary_profile, barcode_patterns, head_motif, read_slice, filter_message, pattern_log2, run_summary, view_codes,
    edge_columns,
)}


def _code(kmer: str, k: int) -> str:
    return f"list_sum(list_transform(range({k}), lambda j: CAST(strpos('TGAC', {kmer}[j + 1]) - 1 AS HUGEINT) * (CAST(1 AS HUGEINT) << (2 * j))))"


def _rc(s: str) -> str:
    return f"translate(reverse({s}), 'ACGT', 'TGCA')"


def _grid(step: int) -> str:
    return f"""idx AS (
  SELECT chr_id, ref_pos, kmer FROM (SELECT chr_id, p AS ref_pos, substr(s, CAST(p + 1 AS INT), 30) AS kmer
    FROM (SELECT doc_id AS chr_id, s, unnest(range(0, greatest(length(s) - 29, 0), {step})) AS p FROM docs))
  WHERE NOT regexp_matches(kmer, '[^ACGT]')
)"""


_MATES = f"""mates AS (
  SELECT * FROM (SELECT read_id AS pair_id, CASE WHEN read_id % {SCRAMBLED} = 0 THEN '{NOWHERE}' ELSE substr(sequence, 11, 45) END AS seq1,
    CASE WHEN read_id % {SCRAMBLED} = 0 THEN '{NOWHERE}' ELSE {_rc('substr(sequence, 91, 45)')} END AS seq2 FROM reads WHERE length(sequence) >= 135)
  WHERE NOT regexp_matches(seq1 || seq2, '[^ACGT]')
),
sides AS (
  SELECT pair_id, '+' AS strand, 1 AS mate, seq1 AS seq FROM mates UNION ALL SELECT pair_id, '+', 2, {_rc('seq2')} FROM mates
  UNION ALL SELECT pair_id, '-', 1, {_rc('seq1')} FROM mates UNION ALL SELECT pair_id, '-', 2, seq2 FROM mates
),
starts AS (SELECT DISTINCT p + q AS r FROM range(0, 16, 15) a(p), range(0, {STEP}) b(q) WHERE p + q <= 15),
seeds AS (SELECT pair_id, strand, mate, seq, r AS read_pos, substr(seq, CAST(r + 1 AS INT), 30) AS kmer FROM sides, starts)"""
_CANDIDATES = f"""{READS_SQL},{_MATES},{_grid(STEP)},
cand AS (
  SELECT pair_id, strand, mate, chr_id, ref_pos - read_pos AS diagonal, min(read_pos) AS read_pos, any_value(seq) AS seq
  FROM seeds JOIN idx USING (kmer) GROUP BY 1, 2, 3, 4, 5
)"""
_BEST = f"""{_CANDIDATES},
hits AS (
  SELECT pair_id, strand, mate, chr_id, diagonal AS first, diagonal + read_pos AS ref FROM cand JOIN docs ON doc_id = chr_id
  WHERE diagonal >= 0 AND substr(s, CAST(diagonal + 1 AS INT), 45) = seq
),
best AS (
  SELECT a.pair_id, a.chr_id, a.strand, a.first AS f1, b.first AS f2
  FROM hits a JOIN hits b ON a.pair_id = b.pair_id AND a.strand = b.strand AND a.chr_id = b.chr_id AND a.mate = 1 AND b.mate = 2 AND abs(a.ref - b.ref) < 700
  QUALIFY row_number() OVER (PARTITION BY a.pair_id ORDER BY a.chr_id, a.strand, a.ref, b.ref, a.first, b.first) = 1
),
chance AS (
  SELECT pow((1 - 1.0::DOUBLE / 800) * (1 - 1.0::DOUBLE / 500), 150) * pow((1 - 1.0::DOUBLE / 1000) * (1 - 1.0::DOUBLE / 5000), 150) AS p
),
found AS (
  SELECT pair_id, 1 AS mate, 'm1' AS name, chr_id, f1 + 1 AS begin, f1 + 45 AS "end", strand, CASE WHEN chr_id IS NOT NULL THEN p END AS probability
  FROM mates LEFT JOIN best USING (pair_id), chance
  UNION ALL
  SELECT pair_id, 2, 'm2', chr_id, f2 + 1, f2 + 45, translate(strand, '+-', '-+'), CASE WHEN chr_id IS NOT NULL THEN p END
  FROM mates LEFT JOIN best USING (pair_id), chance
)"""
_MIXED = """mixed AS (
  SELECT item_id AS adaptor_idx, substr(regexp_replace(translate(upper(text), 'NX', '¤N'), '[^ACGTN]', '', 'g'), 1, CAST(4 + item_id % 5 AS INT)) AS bases FROM benchmark
),
valid AS (SELECT bases, min(adaptor_idx) AS adaptor_idx FROM mixed WHERE length(bases) > 0 AND NOT regexp_matches(bases, '[^ACGT]') GROUP BY bases)"""


def _prefixes(best: str) -> str:
    return f"""WITH {READS_SQL},{_MIXED},
sizes AS (SELECT DISTINCT length(bases) AS n FROM valid),
w AS (SELECT read_id, i, n, substr(sequence, CAST(i + 1 AS INT), CAST(n AS INT)) AS kmer FROM (SELECT *, unnest(range(length(sequence))) AS i FROM reads), sizes),
hit AS (SELECT read_id, i, {best} AS adaptor_idx FROM w JOIN valid ON kmer = bases GROUP BY 1, 2)"""


def overlap_sql(gap: int, mismatch: int, columns: str) -> str:
    """All pairs that share a 31-mer, aligned: a table's rows follow one another, its cells are found by windows.

    ``cols`` and ``uneq`` count the columns since the first one without a gap
    and the unequal ones of them, ``lc`` and ``lu`` the same up to the last one
    without a gap. A run of gaps in the first text carries on from the last cell
    of the row that was reached in another way.
    """
    return f"""WITH RECURSIVE {READS_SQL},
k31 AS (
  SELECT DISTINCT read_id, kmer FROM (SELECT read_id, substr(sequence, CAST(i + 1 AS INT), 31) AS kmer FROM
    (SELECT *, unnest(range(greatest(length(sequence) - 30, 0))) AS i FROM reads)) WHERE NOT regexp_matches(kmer, '[^ACGT]')
),
pairs AS (SELECT DISTINCT a.read_id AS read1, b.read_id AS read2 FROM k31 a JOIN k31 b ON a.kmer = b.kmer AND a.read_id < b.read_id),
texts AS (
  SELECT row_number() OVER () AS t, s1, s2
  FROM (SELECT DISTINCT x.sequence AS s1, y.sequence AS s2 FROM pairs JOIN reads x ON x.read_id = read1 JOIN reads y ON y.read_id = read2)
),
cells(t, j, i, d, cols, uneq, lc, lu) USING KEY (t, j) AS (
  SELECT t, j, 0::BIGINT, j * {gap}, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM texts, range(151) r(j) WHERE j <= length(s2)
  UNION
  SELECT t, j, i, d, CASE WHEN k.cols > 0 THEN k.cols + j - k.j ELSE 0 END, CASE WHEN k.cols > 0 THEN k.uneq + j - k.j ELSE 0 END, k.lc, k.lu FROM (
    SELECT t, j, i, d, last_value(own IGNORE NULLS) OVER (PARTITION BY t ORDER BY j ROWS UNBOUNDED PRECEDING) AS k FROM (
      SELECT t, j, i, d, CASE WHEN diag = d THEN {{'j': j, 'cols': b.cols + 1, 'uneq': b.uneq + c, 'lc': b.cols + 1, 'lu': b.uneq + c}}
        WHEN up = d THEN {{'j': j, 'cols': CASE WHEN cols > 0 THEN cols + 1 ELSE 0 END, 'uneq': CASE WHEN cols > 0 THEN uneq + 1 ELSE 0 END, 'lc': lc, 'lu': lu}} END AS own
      FROM (
        SELECT *, min(least(coalesce(diag, up), up) - j * {gap}) OVER (PARTITION BY t ORDER BY j ROWS UNBOUNDED PRECEDING) + j * {gap} AS d FROM (
          SELECT *, b.d + {mismatch} * c AS diag FROM (
            SELECT t, j, i + 1 AS i, d + {gap} AS up, cols, uneq, lc, lu, CAST(s1[i + 1] <> s2[j] AS BIGINT) AS c,
              lag({{'d': d, 'cols': cols, 'uneq': uneq}}) OVER (PARTITION BY t ORDER BY j) AS b
            FROM cells JOIN texts USING (t) WHERE i < length(s1)
          )
        )
      )
    )
  )
)
SELECT read1, read2, {columns} FROM pairs JOIN reads x ON x.read_id = read1 JOIN reads y ON y.read_id = read2
JOIN texts ON s1 = x.sequence AND s2 = y.sequence JOIN cells USING (t) WHERE j = length(s2)"""


_ALL = "d AS score, CAST(length(s1) AS BIGINT) AS len1, CAST(length(s2) AS BIGINT) AS len2, lc AS overlap, lu AS overlap_score"
ORACLE_SQL = {
    "genome_kmers": f"WITH {READS_SQL},{_grid(10)} SELECT chr_id, ref_pos, CAST({_code('kmer', 30)} AS BIGINT) AS code FROM idx",
    "mate_seeds": f"""WITH {READS_SQL},{_MATES}, c AS (SELECT kmer, CAST({_code('kmer', 30)} AS BIGINT) AS code FROM (SELECT DISTINCT kmer FROM seeds))
SELECT pair_id, strand, CAST(mate AS BIGINT) AS mate, read_pos, code FROM seeds JOIN c USING (kmer)""",
    "seed_candidates": f"""WITH {_CANDIDATES}
SELECT pair_id, strand, CAST(mate AS BIGINT) AS mate, chr_id, diagonal + read_pos AS ref_pos, read_pos FROM cand""",
    "pair_ranking": f"""WITH {_CANDIDATES}, s AS (SELECT *, diagonal + read_pos AS ref, ((diagonal + read_pos) * 7 + read_pos * 3 + mate) % 101 AS score FROM cand)
SELECT a.pair_id, a.chr_id, a.strand, CAST(a.score + b.score AS BIGINT) AS total, a.diagonal AS first1, b.diagonal AS first2
FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.strand = b.strand AND a.chr_id = b.chr_id AND a.mate = 1 AND b.mate = 2 AND abs(a.ref - b.ref) < 700
QUALIFY row_number() OVER (PARTITION BY a.pair_id ORDER BY a.score + b.score, a.chr_id, a.strand, a.ref, b.ref, a.score, a.diagonal, b.score, b.diagonal) = 1""",
    "paired_alignment": f"WITH {_BEST} SELECT pair_id, CAST(mate AS BIGINT) AS mate, name, chr_id, begin, \"end\", strand, round(probability, 9) AS probability FROM found",
    "alignment_report": f"""WITH {_BEST}
SELECT printf('%s,%d,%d,%d,%s,%f', name, coalesce(chr_id, 20), coalesce(begin, 1), coalesce("end", 2),
  coalesce(strand, CASE WHEN mate = 1 THEN '+' ELSE '-' END), coalesce(probability, 0.0::DOUBLE)) AS value, count(*) AS n FROM found GROUP BY 1""",
    "reference_slice": f"WITH {READS_SQL} SELECT substr(s, 11, 40) AS value FROM docs WHERE doc_id = 3 AND length(s) > 0",
    "dictionary_windows": _prefixes("min(adaptor_idx)") + """
SELECT adaptor_idx, count(*) AS n_windows, count(DISTINCT read_id) AS n_reads, CAST(sum(i) AS BIGINT) AS positions FROM hit GROUP BY 1""",
    "dictionary_longest": _prefixes("arg_max(adaptor_idx, n * 1000000000 - adaptor_idx)") + """
SELECT adaptor_idx, count(*) AS n_windows, CAST(sum(i) AS BIGINT) AS positions FROM hit GROUP BY 1""",
    "dictionary_profile": f"""WITH {_MIXED}, c AS (SELECT length(bases) AS n, CAST({_code('bases', '(length(bases))')} AS BIGINT) % 301 AS b FROM valid_all),
p AS (SELECT b, count(*) AS n, min(n) AS low, max(n) AS high FROM c GROUP BY b)
SELECT CAST(sum(n) AS BIGINT) AS n_keys, min(low) AS shortest, max(high) AS longest, CAST(sum(n - 1) AS BIGINT) AS collisions, max(n) AS fullest FROM p""".replace(
        "valid_all", "(SELECT bases FROM mixed WHERE length(bases) > 0 AND NOT regexp_matches(bases, '[^ACGT]'))"),
    "barcode_patterns": f"""WITH {READS_SQL}, p AS (SELECT unnest({list(PATTERNS)}) AS bases)
SELECT bases, count(*) AS n_reads FROM reads, p WHERE regexp_matches(substr(sequence, 1, 15), bases) GROUP BY bases""",
    "head_motif": f"WITH {READS_SQL} SELECT read_id, substr(sequence, 1, 15) AS head FROM reads WHERE contains(substr(sequence, 1, 15), 'TTA')",
    "read_slice": f"""WITH {READS_SQL} SELECT read_id, 'range' AS part FROM reads WHERE read_id >= 100000 AND read_id < 700000
UNION ALL SELECT read_id, 'one' FROM reads WHERE read_id = 300001""",
    "filter_message": f"""WITH {READS_SQL}, c AS (SELECT kmer, count(*) AS count FROM
  (SELECT substr(sequence, CAST(i + 1 AS INT), 6) AS kmer FROM (SELECT *, unnest(range(greatest(length(sequence) - 5, 0))) AS i FROM reads))
  WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY kmer),
r AS (SELECT min(count) AS c0, max(count) - min(count) AS cr FROM c),
b AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {a}, {z})" for k, (a, z) in MESSAGES.items())}) v(name, lo, hi)),
n AS (SELECT name, count(c.kmer) AS n FROM b CROSS JOIN r LEFT JOIN c ON count > c0 + lo / 100.0 * cr AND count < c0 + hi / 100.0 * cr GROUP BY name)
SELECT name, n, n || ' events captured, ' || CASE WHEN n > 100 THEN 'sampling 100 random events below' ELSE 'all are shown below' END AS message FROM n""",
    "pattern_log2": f"WITH {READS_SQL}, c AS (" + " UNION ALL ".join(
        f"""SELECT CAST({k} AS BIGINT) AS k, count(DISTINCT kmer) AS n_kmers FROM (SELECT substr(sequence, CAST(i + 1 AS INT), {k}) AS kmer FROM
  (SELECT *, unnest(range(greatest(length(sequence) - {k - 1}, 0))) AS i FROM reads)) WHERE NOT regexp_matches(kmer, '[^ACGT]')""" for k in range(1, 13)
    ) + ") SELECT k, n_kmers, round(log2(n_kmers), 9) AS log2, printf('%.2f', log2(n_kmers)) AS shown FROM c",
    "view_codes": f"""WITH {READS_SQL}, v AS (SELECT read_id, sequence, substr(sequence, 101, 20) AS w FROM reads)
SELECT read_id, CASE WHEN length(w) = 0 THEN '0' ELSE CAST({_code("translate(w, 'N', 'T')", '(length(w))')} AS VARCHAR) END AS code,
  CAST(strpos(sequence, 'N') AS BIGINT) AS bad FROM v""",
    "overlap_scores": overlap_sql(5, 10, _ALL),
    "edge_columns": overlap_sql(5, 10, "lu AS overlap_score"),
    "nw_score": overlap_sql(5, 10, "d AS score"),
    "nw_score_paired": overlap_sql(25, 13, "d AS score"),
}

"""Packing into optimal length buckets and token-budget batches.

1. The global histogram of document lengths (in tokens: words by default) is
   counted by partial aggregation. Lengths up to ``EXACT`` have a bin each, above
   that a bin is one part in ``EXACT`` of its size, so the histogram has a bounded
   number of bins (a few thousand for any length). A bin carries its documents,
   their tokens and the longest of them.
2. Dynamic programming over the bins chooses at most ``n_buckets`` upper bounds
   so that padding every document to its bucket's bound costs least. A bound is
   the length of the longest document that it holds, never a bin's end.
3. Inside a bucket, batches hold as many documents as the token budget admits at
   the bucket's bound (one at least). Buckets are dealt by a hash of id, length and text into
   shards of about ``SHARD`` documents, whose number follows from the histogram;
   batches form within a shard. No shard holds a hot bucket, and a shard leaves
   at most one batch that is not full.

Null and empty texts have length 0 and a bucket of their own at bound 0. Every
row is kept, repeated rows and rows of a null id too: documents of one id, or of
none, are dealt by their texts, and only rows equal in both share a shard. The
shards' order is by that hash, then id and length, so equal rows are
interchangeable. Without a text column, id and length are hashed. Other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths with a bin of their own, documents of a shard, and documents of a batch at most.
EXACT, SHARD, MAX_DOCS = 1024, 4096, 1024


def token_count(text: str = "text") -> Column:
    """Words of a text: runs of characters other than white space."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def bin_of(length: Column) -> Column:
    """Upper end of a length's bin, which names it."""
    exponent = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / EXACT)) + 1
    step = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(0))).cast("long")
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def optimal_bounds(lengths, counts, totals, n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least padding.

    ``lengths`` are the longest lengths of the bins in ascending order, ``counts``
    their documents and ``totals`` their tokens. Among equal costs the one with fewer
    buckets wins.
    """
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate(([0], np.cumsum(np.asarray(counts, dtype=np.float64))))
    t = np.concatenate(([0], np.cumsum(np.asarray(totals, dtype=np.float64))))
    top = np.asarray(lengths, dtype=np.float64)
    ends = np.arange(1, n + 1)
    best = top * c[ends] - t[ends]  # one bucket over the first e bins
    choice = [np.zeros(n, dtype=np.int64)]
    costs = [best]
    for _ in range(1, min(n_buckets, n)):
        new, pick = np.empty(n), np.zeros(n, dtype=np.int64)
        padded = np.concatenate(([0.0], best))
        for e in range(1, n + 1):
            start = np.arange(e)
            cost = padded[start] + top[e - 1] * (c[e] - c[start]) - (t[e] - t[start])
            pick[e - 1] = int(np.argmin(cost))
            new[e - 1] = cost[pick[e - 1]]
        best = np.minimum(new, best)
        choice.append(pick)
        costs.append(new)
    final = np.array([x[-1] for x in costs])
    k = int(np.argmin(final))
    bounds, e = [], n
    while e > 0:
        bounds.append(int(lengths[e - 1]))
        e = int(choice[k][e - 1]) if k else 0
        # fewer buckets may do as well for what is left
        k = int(np.argmin([x[e - 1] for x in costs[: max(k, 1)]])) if e else 0
    return bounds[::-1]


def pack(
    docs: DataFrame, n_buckets: int = 16, budget: int = 16_384, length: Column | None = None, max_docs: int = MAX_DOCS
) -> DataFrame:
    """Batches of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_tokens, bucket (number from 0), bound (padded length),
    batch_id (text, unique over all batches) and slot (place in the batch).
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (token_count() if length is None else length).alias("n_tokens"),
        (F.xxhash64(F.col("text").cast("string")) if "text" in docs.columns else F.lit(0).cast("long")).alias("_print"),
    )
    rows = rows.withColumn("_bin", bin_of(F.col("n_tokens")))
    found = rows.groupBy("_bin").agg(F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("total")).collect()
    histogram = sorted((r["top"], r["n"], r["total"]) for r in found)
    full = [h for h in histogram if h[0] > 0]
    bounds = [0] * (len(full) < len(histogram)) + optimal_bounds(*(list(x) for x in zip(*full, strict=True)), n_buckets) if full else [0]
    held = [sum(h[1] for h in histogram if (bounds[i - 1] if i else -1) < h[0] <= b) for i, b in enumerate(bounds)]
    shards = [max(1, -(-n // SHARD)) for n in held]
    per = [max(1, min(max_docs, budget // b if b else max_docs)) for b in bounds]
    bucket = F.array_position(F.transform(F.array(*map(F.lit, bounds)), lambda b: F.col("n_tokens") <= b), F.lit(True)) - 1

    def of(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)

    dealt = rows.withColumn("bucket", bucket.cast("int")).withColumn("_h", F.xxhash64("doc_id", "n_tokens", "_print")).withColumn(
        "_shard", F.pmod(F.col("_h"), of(shards)).cast("int")
    )
    by = Window.partitionBy("bucket", "_shard").orderBy("_h", "doc_id", "n_tokens")
    at = F.row_number().over(by) - 1
    placed = dealt.withColumn("_at", at).withColumn("_per", of(per))
    return placed.select(
        "doc_id", "n_tokens", "bucket", of(bounds).cast("long").alias("bound"),
        F.format_string("%d-%d-%d", "bucket", "_shard", F.floor(F.col("_at") / F.col("_per")).cast("int")).alias("batch_id"),
        (F.col("_at") % F.col("_per")).cast("int").alias("slot"),
    )

"""Joins of reads with a dictionary of short sequences (barcodes, adaptors).

A dictionary has adaptor_idx, name and bases. It is broadcast only if its
counted size is within ``BROADCAST_ROWS``; a larger one is joined on the window
by shuffle. Keys with a base other than A, C, G, T are skipped.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import codec, minimizers
from strandlake.operators.kmers import windows
from strandlake.plans.lineage import cut
from strandlake.plans.shipping import ship

#: Rows up to which a dictionary is broadcast, after counting them, and keys up to which it is looked up within the row.
BROADCAST_ROWS, LITERAL_KEYS = 100_000, 2_000
#: First bases by which keys looked up within the row are told apart.
SLOT_BASES = 4


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows, which are counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def valid_keys(dictionary: DataFrame) -> DataFrame:
    return dictionary.where(F.col("bases").isNotNull() & (F.length("bases") > 0) & codec.is_clean("bases")).withColumn(
        "bases", F.upper("bases")
    )


def dictionary_size(dictionary: DataFrame) -> int:
    return valid_keys(dictionary).count()


def length_spread(dictionary: DataFrame) -> tuple[int, int]:
    """Shortest and longest key."""
    row = valid_keys(dictionary).agg(F.min(F.length("bases")), F.max(F.length("bases"))).first()
    return row[0] or 0, row[1] or 0


def check_spread(dictionary: DataFrame, most: int = 4) -> None:
    """Raise if the lengths of keys differ by more than ``most``, as adaptors of one kit never do."""
    low, high = length_spread(dictionary)
    if high - low > most:
        raise ValueError(f"adaptor lengths {low} to {high} differ by more than {most}")


def barcode_hits(reads: DataFrame, barcodes: DataFrame, prefix: int = 15) -> DataFrame:
    """(read_id, bases): each barcode that occurs in the first ``prefix`` bases of a read.

    The windows of a prefix are joined by equality, one class of lengths at a
    time, instead of testing every read against every barcode.
    """
    keys = barcodes.where(F.col("bases").isNotNull() & (F.length("bases") > 0)).select("bases").distinct()
    lengths = [r[0] for r in keys.select(F.length("bases")).distinct().collect() if r[0] <= prefix]
    head = reads.select("read_id", F.substring("sequence", 1, prefix).alias("sequence"))
    out = None
    for n in sorted(lengths):
        made = windows(head, n, clean=False).select("read_id", F.col("kmer").alias("bases")).distinct()
        found = made.join(small(keys.where(F.length("bases") == n)), "bases").select("read_id", "bases")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else reads.select("read_id", F.lit("").alias("bases")).limit(0)


def barcode_regex_hits(reads: DataFrame, patterns: list[str], prefix: int = 15) -> DataFrame:
    """(read_id, bases): each regular expression found in the first ``prefix`` bases; a fixed list of patterns."""
    head = F.substring("sequence", 1, prefix)
    found = F.filter(F.array(*[F.when(head.rlike(p), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())
    return reads.select("read_id", F.explode(found).alias("bases"))


def barcode_counts(reads: DataFrame, barcodes: DataFrame, prefix: int = 15) -> DataFrame:
    """(bases, n_reads) of the barcodes seen."""
    return barcode_hits(reads, barcodes, prefix).groupBy("bases").agg(F.count("*").alias("n_reads"))


def _hits(few: list, longest: bool) -> tuple[Column, Column]:
    """(places of column ``_s`` where keys stand, as structs pos and adaptor_idx; whether it is long enough for any)."""
    shortest = min(len(r["bases"]) for r in few)
    depth = min(shortest, SLOT_BASES)
    slots: list[list[dict]] = [[] for _ in range(4**depth)]
    for r in sorted(few, key=lambda r: (-len(r["bases"]) if longest else 0, r["adaptor_idx"])):
        digits = r["bases"][:depth].translate(str.maketrans(codec.BASES, codec.DIGITS))
        slots[int(digits, 4)].append({"b": r["bases"], "i": r["adaptor_idx"]})
    # one literal: the keys of each slot in order of preference, so the first that is a prefix wins
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<b: string, i: bigint>>>")

    def find(i):
        slot = F.conv(F.translate(F.substring("_s", i + 1, F.lit(depth)), codec.BASES, codec.DIGITS), 4, 10).cast("int")
        fits = F.filter(F.get(table, slot), lambda k: F.substring("_s", i + 1, F.length(k["b"])) == k["b"])
        return F.struct(i.alias("pos"), F.get(fits, F.lit(0))["i"].alias("adaptor_idx"))

    starts = F.sequence(F.lit(0), F.length("_s") - shortest)
    return F.filter(F.transform(starts, find), lambda h: h["adaptor_idx"].isNotNull()), F.length("_s") >= shortest


def _found(reads: DataFrame, few: list, longest: bool) -> DataFrame:
    """(read_id, pos, adaptor_idx): keys of up to 31 bases looked up by their numbers in all windows of a batch together."""
    keys = {}
    for r in few:
        code = int(r["bases"].translate(str.maketrans(codec.BASES, codec.DIGITS)), 4)
        keys.setdefault(len(r["bases"]), []).append((code, r["adaptor_idx"]))
    tables = {n: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for n, v in keys.items()}

    def run(batches):
        for batch in batches:
            ids, made = batch.column(0), []
            for n, (text, pos, code) in zip(tables, minimizers.words(batch.column(1), list(tables)), strict=True):
                codes, idx = tables[n]
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                made.append((text[hit], pos[hit], idx[at[hit]], np.full(int(hit.sum()), -n if longest else 0)))
            text, pos, idx, size = map(np.concatenate, zip(*made, strict=True))
            order = np.lexsort([idx, size, pos, text])
            text, pos, idx = text[order], pos[order], idx[order]
            first = np.ones(len(text), bool)
            first[1:] = (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(text[first])), pa.array(pos[first].astype(np.int32)), pa.array(idx[first])], names=["read_id", "pos", "adaptor_idx"]
            )

    ship(reads.sparkSession)
    kind = reads.schema["read_id"].dataType.simpleString()
    plain = reads.select("read_id", F.regexp_replace("sequence", "[^ACGTacgt]", "N").alias("sequence"))
    return plain.mapInArrow(run, f"read_id {kind}, pos int, adaptor_idx long")


def window_matches(reads: DataFrame, dictionary: DataFrame, longest: bool = False) -> DataFrame:
    """(read_id, pos, adaptor_idx): the key that is a prefix of the read from ``pos``.

    If several are, the smallest adaptor_idx wins, or the longest key with
    ``longest``. A dictionary of at most LITERAL_KEYS keys is looked up by
    their numbers, a batch of reads at a time; only hits leave the batch. A larger one is joined on the windows.
    """
    keys = valid_keys(dictionary).groupBy("bases").agg(F.min("adaptor_idx").cast("long").alias("adaptor_idx"))
    few = keys.limit(LITERAL_KEYS + 1).collect()
    rows = reads.select("read_id", F.upper("sequence").alias("_s"))
    if not few:
        return rows.select("read_id", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("adaptor_idx")).limit(0)
    if len(few) <= LITERAL_KEYS and max(len(r["bases"]) for r in few) <= 31:
        return _found(reads, few, longest)
    lengths = sorted(r[0] for r in keys.select(F.length("bases")).distinct().collect())
    out = None
    for n in lengths:
        made = windows(reads.select("read_id", "sequence"), n).select("read_id", "pos", F.col("kmer").alias("bases"))
        found = made.join(small(keys.where(F.length("bases") == n)), "bases").select(
            "read_id", "pos", "adaptor_idx", F.lit(n).alias("size")
        )
        out = found if out is None else out.unionByName(found)
    best = F.min_by("adaptor_idx", F.struct(-F.col("size"), "adaptor_idx")) if longest else F.min("adaptor_idx")
    return out.groupBy("read_id", "pos").agg(best.alias("adaptor_idx"))


def first_matches(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds pos and adaptor_idx of the first place in each read where a key stands, null where none does.

    Of several keys there the smallest adaptor_idx wins. Every row of ``reads``
    stays, repeated ids and null ones too. With a dictionary of at most
    LITERAL_KEYS keys no read is shuffled.
    """
    keys = valid_keys(dictionary).groupBy("bases").agg(F.min("adaptor_idx").cast("long").alias("adaptor_idx"))
    few = keys.limit(LITERAL_KEYS + 1).collect()
    none = F.lit(None)
    if not few:
        return reads.select("*", none.cast("int").alias("pos"), none.cast("long").alias("adaptor_idx"))
    if len(few) <= LITERAL_KEYS:
        hits, enough = _hits(few, False)
        found = reads.withColumn("_s", F.upper("sequence")).withColumn("_m", F.when(enough, F.get(hits, F.lit(0))))
        return found.select(*reads.columns, "_m.pos", "_m.adaptor_idx")
    found = window_matches(reads.where("read_id is not null").select("read_id", "sequence").distinct(), dictionary)
    best = found.groupBy("read_id").agg(F.min(F.struct("pos", "adaptor_idx")).alias("_m")).select("read_id", "_m.pos", "_m.adaptor_idx")
    return reads.join(best, "read_id", "left").select(*reads.columns, "pos", "adaptor_idx")


def assign(reads: DataFrame, dictionary: DataFrame, every_window: bool = False, longest: bool = False) -> DataFrame:
    """(read_id, adaptor_idx): once per read and adaptor, or once per matching window."""
    found = window_matches(reads, dictionary, longest).select("read_id", "adaptor_idx")
    return found if every_window else found.distinct()


def unmatched(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    """Reads without any adaptor."""
    return reads.join(assigned.select("read_id"), "read_id", "left_anti")


def adaptor_counts(reads: DataFrame, dictionary: DataFrame, rest: str = "noBarCode") -> DataFrame:
    """(name, n_reads) of every adaptor, those without reads too, and of the rest.

    The assignment is made once: the rest are all reads less those with an
    adaptor. read_id is unique.
    """
    found = cut(assign(reads, dictionary))
    per = found.groupBy("adaptor_idx").agg(F.count("*").alias("n_reads"))
    named = dictionary.join(per, "adaptor_idx", "left").select("name", F.coalesce("n_reads", F.lit(0)).cast("long").alias("n_reads"))
    with_one = found.agg(F.countDistinct("read_id")).first()[0]
    none = reads.agg((F.count("*") - with_one).alias("n_reads")).select(F.lit(rest).alias("name"), "n_reads")
    return named.unionByName(none)


def dictionary_profile(dictionary: DataFrame, buckets: int = 301) -> DataFrame:
    """(n_keys, shortest, longest, collisions, fullest) of the valid keys, one row.

    ``collisions`` counts keys beyond the first of each bucket when codes are
    dealt by their remainder, ``fullest`` is the largest bucket.
    """
    keys = valid_keys(dictionary).select(F.length("bases").alias("n"), (codec.encode("bases") % buckets).alias("bucket"))
    per = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("n").alias("low"), F.max("n").alias("high"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.min("low").alias("shortest"), F.max("high").alias("longest"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"), F.max("n").alias("fullest"),
    )


def intersects(left: DataFrame, right: DataFrame, key: str = "kmer") -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return left.join(right.select(key), key, "left_semi")

"""FASTQ, FASTA and paired FASTA scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.plans.lineage import cut
from strandlake.sources.lines import numbered_lines

#: Files that end early up to which they are named in the plan; more are joined.
LITERAL_FILES = 100
_FIELDS = ("identifier", "sequence", "plus", "quality")
_RECORD = "file string, read_id long, identifier string, sequence string, plus string, quality string, whole boolean"
_TYPES = {"file": pa.string(), "read_id": pa.int64(), **dict.fromkeys(_FIELDS, pa.string()), "whole": pa.bool_()}


def _runs(files, numbers):
    """(start, stop) of runs of consecutive lines of one file in a batch."""
    new = np.flatnonzero((np.diff(numbers) != 1) | (files[1:] != files[:-1])) + 1
    edges = [0, *new.tolist(), len(numbers)]
    return zip(edges[:-1], edges[1:], strict=True)


def _records(batches):
    """Lines in file order to records by array slices; what a split's or a batch's ends leave over goes out line by line."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, numbers = batch.column("file"), batch.column("line_no").to_numpy(zero_copy_only=False)
        values = batch.column("value")
        coded = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        for start, stop in _runs(coded, numbers):
            lead = min(int(-numbers[start] % 4), stop - start)
            n = (stop - start - lead) // 4
            if n:
                at = start + lead + 4 * np.arange(n)
                parts = [values.take(pa.array(at + k)) for k in range(4)]
                made = [files.take(pa.array(at)), pa.array(numbers[at] // 4), *parts, pa.array(np.ones(n, dtype=bool))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(made, _TYPES.values(), strict=True)], names=list(_TYPES))
            rest = [*range(start, start + lead), *range(start + lead + 4 * n, stop)]
            if rest:
                made = {"file": files.take(pa.array(rest)), "read_id": pa.array(numbers[rest] // 4), "whole": pa.array([False] * len(rest))}
                for k, name in enumerate(_FIELDS):
                    made[name] = pa.array([values[i].as_py() if numbers[i] % 4 == k else None for i in rest], pa.string())
                yield pa.RecordBatch.from_arrays([made[c].cast(t) for c, t in _TYPES.items()], names=list(_TYPES))


def read_fastq(spark: SparkSession, paths, mode: str = "stop") -> DataFrame:
    """(file, read_id, identifier, sequence, quality), read_id 0-based in file order.

    A record is four lines, the first starting with ``@`` and the third with
    ``+``. ``mode`` says what a malformed one does: ``stop`` ends its file there,
    ``drop`` leaves it out, ``fail`` raises. Gzip is read as it is. Records are
    put together where their lines are read; only those that a split or a batch
    cuts in two are shuffled.
    """
    made = numbered_lines(spark, paths).mapInArrow(_records, _RECORD)
    pieces = made.where("not whole").groupBy("file", "read_id").agg(*[F.max(c).alias(c) for c in _FIELDS])
    records = made.where("whole").drop("whole").unionByName(pieces)
    good = F.coalesce(
        F.startswith("identifier", F.lit("@")) & F.startswith("plus", F.lit("+")) & F.col("sequence").isNotNull(), F.lit(False)
    )
    columns = ["file", "read_id", "identifier", "sequence", F.coalesce("quality", F.lit("")).alias("quality")]
    if mode == "fail":
        bad = F.raise_error(F.concat(F.lit("malformed record "), F.col("read_id").cast("string"), F.lit(" of "), F.col("file")))
        # blank lines at the end of a file are no record
        blank = F.trim(F.concat_ws("", *_FIELDS)) == ""
        return records.where(~blank).where(F.when(good, True).otherwise(bad.cast("boolean"))).select(*columns)
    if mode == "stop":
        ends = records.where(~good).groupBy("file").agg(F.min("read_id").alias("_end"))
        few = {r["file"]: r["_end"] for r in ends.limit(LITERAL_FILES + 1).collect()}
        if len(few) > LITERAL_FILES:
            records = records.join(ends, "file", "left").where(F.col("_end").isNull() | (F.col("read_id") < F.col("_end")))
        elif few:
            end = F.coalesce(*[F.when(F.col("file") == name, F.lit(n)) for name, n in few.items()])
            records = records.where(F.coalesce(F.col("read_id") < end, F.lit(True)))
    return records.where(good).select(*columns)


def fasta_pieces(spark: SparkSession, paths, drop_last: bool = False, size: int = 100_000) -> DataFrame:
    """(file, record, name, offset, sequence): records of any length in pieces of at most about ``size`` bases, in order by ``offset``.

    A record begins with a ``>`` line; lines before the first have name null.
    ``drop_last`` removes the last character of every sequence line instead of a
    carriage return only. Neither a line's nor a record's place needs a row of
    the record's length: lines are counted by split, and only the splits' sums
    meet. Lines with their place in the split are written once and read from there.
    """
    lines = numbered_lines(spark, paths).withColumn("_head", F.startswith("value", F.lit(">")))
    body = F.expr("substring(value, 1, length(value) - 1)") if drop_last else F.col("value")
    lines = lines.withColumn("_n", F.when(F.col("_head"), F.lit(0)).otherwise(F.length(body)))
    inside = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # a line's record is the number of headers so far, its offset the bases since the last header
    rows = cut(lines.withColumn("_in", F.count_if("_head").over(inside)).withColumn("_sum", F.sum("_n").over(inside) - F.col("_n")))
    starts = rows.where("_head").select("file", "block", F.col("_in").alias("_from"), F.col("_sum").alias("_base"))
    per = rows.groupBy("file", "block").agg(F.count_if("_head").alias("_heads"), F.sum("_n").alias("_bases"))
    last = starts.groupBy("file", "block").agg(F.max(F.struct("_from", "_base")).alias("l"))
    per = per.join(last, ["file", "block"], "left").select("file", "block", "_heads", (F.col("_bases") - F.coalesce("l._base", F.lit(0))).alias("_tail"))
    # what is open at a split's begin was begun in an earlier one: its bases so far are the tails of the splits from there on
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_heads").over(earlier), F.lit(0))).withColumn("_open", F.col("_before") + F.col("_heads"))
    same = Window.partitionBy("file", "_open").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_sofar", F.coalesce(F.sum("_tail").over(same), F.lit(0)))
    closed = per.groupBy("file", F.col("_open").alias("_before")).agg(F.sum("_tail").alias("_whole"))
    carry = F.when(F.col("_heads") == 0, F.col("_sofar")).otherwise(F.coalesce("_whole", F.lit(0)))
    places = per.join(closed, ["file", "_before"], "left").select("file", "block", "_before", carry.alias("_carry"))
    first = starts.select("file", "block", F.col("_from").alias("_in"), "_base")
    placed = rows.join(places, ["file", "block"]).join(first, ["file", "block", "_in"], "left")
    offset = F.when(F.col("_in") == 0, F.col("_carry") + F.col("_sum")).otherwise(F.col("_sum") - F.col("_base"))
    record = (F.col("_before") + F.col("_in")).alias("record")
    placed = placed.select(
        "file", record, "line_no", F.when(F.col("_head"), 0).otherwise(offset).alias("offset"), F.when(F.col("_head"), F.lit("")).otherwise(body).alias("text")
    )
    names = rows.where("_head").join(places, ["file", "block"]).select("file", record, F.substring("value", F.lit(2), F.length("value")).alias("name"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "")
    pieces = placed.groupBy("file", "record", F.floor(F.col("offset") / size).alias("piece")).agg(F.min("offset").alias("offset"), text.alias("sequence"))
    return pieces.join(names, ["file", "record"], "left").select("file", "record", "name", "offset", "sequence")


def _joined(pieces: DataFrame, *keys: str) -> DataFrame:
    """Sequences of pieces put together in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "sequence")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["sequence"]), "").alias("sequence"))


def read_fasta(spark: SparkSession, paths, drop_last: bool = False) -> DataFrame:
    """(file, record, name, sequence): whole records, for those that fit a row; :func:`fasta_pieces` has any length."""
    return _joined(fasta_pieces(spark, paths, drop_last), "file", "record", "name")


def genome_pieces(spark: SparkSession, paths_by_chr: dict[int, str], drop_last: bool = False, size: int = 100_000) -> DataFrame:
    """(chr_id, offset, sequence): a chromosome per file, all its records one after another, in pieces of about ``size`` bases.

    :func:`~strandlake.operators.paired.chunked` takes the pieces as they are, so no row holds a chromosome.
    """
    out = None
    for chr_id, path in sorted(paths_by_chr.items()):
        rows = fasta_pieces(spark, path, drop_last, size).where(F.length("sequence") > 0).select("record", "offset", "sequence")
        sizes = rows.groupBy("record").agg(F.sum(F.length("sequence")).alias("n"))
        earlier = Window.partitionBy(F.lit(chr_id)).orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.select("record", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
        rows = rows.join(before, "record").select(F.lit(chr_id).alias("chr_id"), (F.col("offset") + F.col("_before")).alias("offset"), "sequence")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_genome(spark: SparkSession, paths_by_chr: dict[int, str], drop_last: bool = False) -> DataFrame:
    """(chr_id, sequence) with a whole chromosome in a row, for genomes whose chromosomes fit one; see :func:`genome_pieces`."""
    return _joined(genome_pieces(spark, paths_by_chr, drop_last), "chr_id")


def read_mates(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(pair_id, name1, seq1, name2, seq2) of two two-line FASTA files in the same order; stops with the shorter."""

    def side(path, n):
        lines = numbered_lines(spark, path).withColumn("pair_id", F.floor(F.col("line_no") / 2).cast("long"))
        name = F.max(F.when(F.col("line_no") % 2 == 0, F.regexp_replace("value", "^>", "")))
        return lines.groupBy("pair_id").agg(name.alias(f"name{n}"), F.max(F.when(F.col("line_no") % 2 == 1, F.col("value"))).alias(f"seq{n}"))

    rows = side(first, 1).join(side(second, 2), "pair_id")
    return rows.where("seq1 is not null and seq2 is not null")

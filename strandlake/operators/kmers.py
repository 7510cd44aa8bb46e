"""K-mer windows, counts and quality statistics of reads.

Reads are DataFrames with read_id, sequence and, for quality, quality. Windows
are made by higher-order functions within the row and only then exploded; counts
are partial aggregates, so a shuffle carries one row per task and k-mer.

``compat`` reproduces the documented quirks of fixed outputs: whole-read
windows leave out the last start, and starts that touch the reported bad base
are chosen one too high (for clean reads that drops start 0).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import codec, minimizers, quality
from strandlake.plans.lineage import cut
from strandlake.plans.shipping import ship
from strandlake.plans.skew import lookup


def _bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with the value computed once, however often it is used: as a column it could be inlined in every use."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _sliding(values: Column, k: int, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over each ``k`` neighbours of an array, by their first; null where fewer follow.

    Windows of doubled width are made of two, and that of ``k`` of those of its
    binary digits, so a read takes about 2 log2(k) passes and not ``k``.
    """
    def beside(one: Column, two: Column, by: int) -> Column:
        return F.zip_with(one, F.slice(two, F.lit(by + 1), F.size(two)), op)

    def widened(v: Column, width: int, rest: int, done: Column | None, covered: int) -> Column:
        if rest & 1:
            done, covered = v if done is None else beside(done, v, covered), covered + width
        if rest == 1:
            return done
        return _bound(beside(v, v, width), lambda w: widened(w, 2 * width, rest >> 1, done, covered))

    return _bound(values, lambda v: widened(v, 1, k, None, 0))


def windows(
    reads: DataFrame, k: int, prefix: int | None = None, inclusive: bool | None = None, step: int = 1, clean: bool = True,
    compat: bool = False, beside: tuple[Column, Callable[[Column, Column], list[Column]]] | None = None,
) -> DataFrame:
    """Adds pos (0-based) and kmer to the columns of ``reads``, one row per window.

    ``beside`` is a value made once a read, and a function of it and a start that
    gives further fields of the window there.

    ``prefix`` limits starts to windows of the first so many bases: starts
    ``0 .. prefix - k - 1``, or one more with ``inclusive``; reads shorter than
    the prefix have none. Without it, starts go to ``length - k`` (``inclusive``,
    the default). ``clean`` drops windows with a base other than A, C, G, T.
    """
    n = F.length("sequence")
    if inclusive is None:
        inclusive = prefix is None and not compat
    last = (n if prefix is None else F.lit(prefix)) - k - (0 if inclusive else 1)
    enough = (last >= 0) & (n >= (k if prefix is None else prefix))

    def at(value: Column | None) -> Column:
        more = beside[1] if beside else lambda value, i: []
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda i: F.struct(i.alias("pos"), F.upper(F.substring("sequence", i + 1, F.lit(k))).alias("kmer"), *more(value, i)),
        )

    made = _bound(beside[0], at) if beside else at(None)
    if compat:  # the bad base and the bases without it are found once a read and not once a window
        once = F.struct(codec.reported_bad_base("sequence").alias("bad"), F.upper(F.regexp_replace("sequence", "[^ACGTacgt]", "T")).alias("text"))
        made = _bound(once, lambda o: F.transform(
            F.filter(made, lambda w: ~((w["pos"] > o["bad"] - k) & (w["pos"] <= o["bad"]))),
            lambda w: w.withField("kmer", F.substring(o["text"], w["pos"] + 1, F.lit(k))),
        ))
    elif clean:  # most reads are clean as a whole, which is tested once and not for each window
        made = F.when(codec.is_clean("sequence"), made).otherwise(F.filter(made, lambda w: ~w["kmer"].rlike("[^ACGT]")))
    return reads.where(enough).select(*reads.columns, F.inline(made))


def kmer_counts(reads: DataFrame, k: int, **how) -> DataFrame:
    """(id, label, count) of every k-mer; id as DECIMAL(20,0)."""
    counted = windows(reads.select("sequence"), k, **how).groupBy(F.col("kmer").alias("label")).agg(F.count("*").alias("count"))
    return counted.select(codec.encode("label", wide=True).alias("id"), "label", "count")


def window_quality(reads: DataFrame, k: int, **how) -> DataFrame:
    """(read_id, pos, kmer, qual, acc) of every window: mean score and probability of no error.

    All windows of a read are summed and multiplied together by :func:`_sliding`;
    a window that the quality string doesn't cover is taken over what there is.
    """
    right = _bound(quality.phred("quality"), lambda q: F.struct(
        q.alias("scores"), _sliding(q, k, lambda a, b: a + b).alias("sums"),
        _sliding(F.transform(q, lambda x: 1 - F.pow(F.lit(10.0), -x / F.lit(10.0))), k, lambda a, b: a * b).alias("right"),
    ))

    def fields(v: Column, i: Column) -> list[Column]:
        part = F.slice(v["scores"], i + 1, F.lit(k))
        return [
            F.coalesce(F.get(v["sums"], i) / F.lit(k), quality.mean(part)).alias("qual"),
            F.coalesce(F.get(v["right"], i), quality.accuracy(part)).alias("acc"),
        ]

    made = windows(reads.select("read_id", "sequence", "quality"), k, beside=(right, fields), **how)
    return made.select("read_id", "pos", "kmer", "qual", "acc")


def kmer_statistics(reads: DataFrame, k: int, **how) -> DataFrame:
    """(id, label, count, mean_qual, sd_qual, accuracy) of every k-mer."""
    found = window_quality(reads, k, **how).groupBy(F.col("kmer").alias("label")).agg(
        F.count("*").alias("count"), F.avg("qual").alias("mean_qual"), F.stddev_pop("qual").alias("sd_qual"),
        F.avg("acc").alias("accuracy"),
    )
    return found.select(codec.encode("label", wide=True).alias("id"), "label", "count", "mean_qual", "sd_qual", "accuracy")


def kmer_sketches(reads: DataFrame, sizes, lg_config: int = 14) -> DataFrame:
    """(k, estimate, sketch) of the distinct clean k-mers of each size: :func:`kmer_variability` in constant memory.

    HyperLogLog sketches of 2^lg_config registers; the relative standard error is
    about 1.04 / sqrt(2^lg_config), 0.8 % by default. Sketches of parts of the
    reads are merged by ``hll_union_agg``, so they can be kept and added to. No
    k-mer is shuffled: each task holds a sketch a size.
    """
    runs = reads.select(F.explode(F.split(F.upper("sequence"), "[^ACGT]+")).alias("run"))

    def of(k: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.length("run") - k), lambda i: F.struct(F.lit(k).alias("k"), F.substring("run", i + 1, F.lit(k)).alias("kmer")))
        return F.when(F.length("run") >= k, made).otherwise(F.array().cast("array<struct<k: int, kmer: string>>"))

    rows = runs.select(F.inline(F.flatten(F.array(*map(of, sizes)))))
    per = rows.groupBy("k").agg(F.hll_sketch_agg("kmer", lg_config).alias("sketch"))
    return per.select("k", F.hll_sketch_estimate("sketch").alias("estimate"), "sketch")


#: First bases of the groups in which longer k-mers are told apart.
HEAD = 12


def kmer_variability(reads: DataFrame, sizes) -> DataFrame:
    """(k, n_kmers) distinct k-mers for each size, all sizes in one scan.

    Reads are split at bad bases first, so no window is tested. Up to 32 bases
    each start gives one row for all sizes together, the bases from there on as a
    number. Rows of equal first HEAD bases come together in order, so a k-mer is
    new if the last row that is as long begins otherwise; shorter sizes are told
    apart among the heads, which are at most 4^HEAD whatever the reads.
    """
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1 or sizes[-1] > 32:
        return _variability(reads, sizes)
    runs = reads.select(F.explode(F.split(F.upper("sequence"), "[^ACGT]+")).alias("run")).where(F.length("run") >= sizes[0])
    runs = runs.select(F.translate("run", codec.BASES, codec.DIGITS).alias("_d"))
    pieces = F.transform(F.sequence(F.lit(0), F.length("_d") - sizes[0]), lambda i: F.substring("_d", i + 1, F.lit(sizes[-1])))
    # an outer generator, else the optimiser makes the array twice
    rows = runs.select(F.explode_outer(pieces).alias("_p")).where(F.col("_p").isNotNull()).select(F.length("_p").alias("n"), F.rpad("_p", 32, "0").alias("_p"))

    def number(at: int, size: int) -> Column:
        return F.conv(F.substring("_p", at, size), 4, 10).cast("long")

    head, short = number(1, HEAD).alias("head"), F.least("n", F.lit(HEAD)).alias("short")
    longer = [k for k in sizes if k > HEAD]
    if longer:
        rows = rows.select("n", head, number(HEAD + 1, 32 - HEAD).alias("rest"))
        by = Window.partitionBy("head").orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)
        new = {}
        for k in longer:
            own = F.when(F.col("n") >= k, F.shiftrightunsigned("rest", 2 * (32 - k)))
            new[f"_{k}"] = F.when(own.isNotNull() & ~own.eqNullSafe(F.last(own, ignorenulls=True).over(by)), 1).otherwise(0)
        rows = rows.select("n", "head", *[c.alias(n) for n, c in new.items()])
        heads = cut(rows.groupBy("head", short).agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in longer]))
    else:
        heads = rows.select(head, short).distinct()
    out = None
    if sizes[0] <= HEAD:
        parts = [
            F.when(F.col("short") >= k, F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("head", 2 * (HEAD - k)).alias("code")))
            for k in sizes if k <= HEAD
        ]
        out = heads.select(F.explode(F.array(*parts)).alias("w")).where("w is not null").select("w.*").distinct().groupBy("k").agg(F.count("*").alias("n_kmers"))
    if longer:
        sums = heads.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias("n_kmers")) for k in longer]).alias("a"))
        sums = sums.select(F.inline("a")).where("n_kmers > 0")
        out = sums if out is None else out.unionByName(sums)
    return out


def _variability(reads: DataFrame, sizes) -> DataFrame:
    """The same for sizes of any length, one row for each start and size."""
    runs = reads.select(F.explode(F.split(F.upper("sequence"), "[^ACGT]+")).alias("run")).where(F.length("run") >= min(sizes))
    runs = runs.select("run", F.translate("run", codec.BASES, codec.DIGITS).alias("_digits"))

    def of(k: int) -> Column:
        starts = F.when(F.length("run") >= k, F.sequence(F.lit(0), F.length("run") - k))
        if k > 31:
            made = F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("code"), F.substring("run", i + 1, F.lit(k)).alias("kmer")))
        else:
            made = F.transform(starts, lambda i: F.struct(
                F.lit(k).alias("k"), F.conv(F.substring("_digits", i + 1, F.lit(k)), 4, 10).cast("long").alias("code"), F.lit("").alias("kmer")
            ))
        return F.coalesce(made, F.array().cast("array<struct<k: int, code: bigint, kmer: string>>"))

    rows = runs.select(F.inline(F.flatten(F.array(*map(of, sizes)))))
    return rows.distinct().groupBy("k").agg(F.count("*").alias("n_kmers"))


def pattern_log2(reads: DataFrame, sizes) -> DataFrame:
    """(k, n_kmers, log2): binary logarithm of the distinct k-mers by k, and as text with two decimals."""
    rows = kmer_variability(reads, sizes)
    return rows.select("k", "n_kmers", F.log2("n_kmers").alias("log2"), F.format_string("%.2f", F.log2("n_kmers")).alias("shown"))


def top_kmers(reads: DataFrame, k: int, n: int = 1, **how) -> DataFrame:
    """The ``n`` most frequent k-mers; of equal counts the smaller id first."""
    return kmer_counts(reads, k, **how).orderBy(F.desc("count"), "id").limit(n)


def pattern_qualities(reads: DataFrame, pattern: str, **how) -> DataFrame:
    """(read_id, pos, qual) of each occurrence of a pattern.

    Empty if the pattern has a base other than A, C, G, T or only T's (code 0).
    """
    asked = pattern.upper()
    found = window_quality(reads, len(asked), **how).where(F.col("kmer") == asked).select("read_id", "pos", "qual")
    return found if set(asked) <= set("ACGT") and set(asked) - {"T"} else found.limit(0)


def position_totals(reads: DataFrame, k: int) -> DataFrame:
    """(label, n, total): how often each clean k-mer of up to 31 bases occurs, and the sum of its places, without a list of them."""
    def run(batches):
        for batch in batches:
            for _, pos, code in minimizers.words(batch.column(0), [k]):
                for s in range(0, len(pos), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(code[s : s + 100_000]), pa.array(pos[s : s + 100_000])], names=["code", "pos"])

    if not 1 <= k <= 31:
        raise ValueError("k is 1 to 31")
    ship(reads.sparkSession)
    plain = reads.select(F.regexp_replace("sequence", "[^ACGTacgt]", "N").alias("sequence"))
    per = plain.mapInArrow(run, "code long, pos long").groupBy("code").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))
    label = F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0"), codec.DIGITS, codec.BASES)
    return per.select(label.alias("label"), "n", "total")


def collected(reads: DataFrame, k: int, most: int = 100_000, **how) -> DataFrame:
    """(label, part, positions) of every k-mer: where it occurs, in order within each part.

    A k-mer of more than ``most`` occurrences has several parts, dealt by a hash
    of the read, so no list grows with the table.
    """
    rows = windows(reads.select("read_id", "sequence"), k, **how).select("read_id", "pos", F.col("kmer").alias("label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("count")).where(F.col("count") > most)
    parted = rows.withColumn("part", F.lit(0))
    if not counts.isEmpty():
        hot = counts.select("label", F.ceil(F.col("count") / most).cast("int").alias("parts"))
        parted = lookup(rows, hot, "label", counts=counts).withColumn("part", F.coalesce(F.pmod(F.xxhash64("read_id"), F.col("parts")).cast("int"), F.lit(0)))
    return parted.groupBy("label", "part").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def read_errors(reads: DataFrame) -> DataFrame:
    """First bad base of each read that has one.

    (read_id, id, rank, x, y, len, rec, symb, qual) with rec the 1-based
    position, symb the character there and qual its score; header fields are
    null if there is no identifier.
    """
    name = F.col("identifier") if "identifier" in reads.columns else F.lit(None).cast("string")
    at = codec.first_bad_base("sequence")
    head = quality.parse_header(name)
    return reads.where(at > 0).select(
        "read_id", head["id"].alias("id"), head["rank"].alias("rank"), head["x"].alias("x"), head["y"].alias("y"),
        F.length("sequence").alias("len"), at.alias("rec"), F.substring("sequence", at, F.lit(1)).alias("symb"),
        (F.ascii(F.substring("quality", at, F.lit(1))) - 33).alias("qual"),
    )

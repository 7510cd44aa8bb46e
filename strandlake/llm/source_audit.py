"""How far the sources of a language diverge from each other and from the language, by smoothed term shares.

A group is a (lang, source) with its own counts of the language's kept terms,
those in at least ``least`` of its documents. A term's share in a group is
``1 + floor(SCALE * (count + 5) / (N + 5 V))``, N being the group's sum of
counts and V the number of kept terms; the language has shares of its own
counts. All of it is integer arithmetic.

The distance of two groups sums |p - q| over all V terms, but no group is ever
spelled out over all of them. A term that a group lacks has the same share
``zero`` whatever the term, so by inclusion and exclusion over the two supports::

    sum over a's support of |p - zero_b|      from a's histogram of counts
  + sum over b's support of |zero_a - q|      from b's histogram of counts
  + sum over both supports of
      |p - q| - |p - zero_b| - |zero_a - q| + |zero_a - zero_b|
  + (V - |a's support| - |b's support|) * |zero_a - zero_b|

The third line alone needs the terms: a join of postings on (lang, term), where
a term has a row per source at most, whatever the corpus's size. Pairs of
sources are as many as the result has rows.

Counting is done in Arrow batches and leaves a task already summed by group and
term; a hot source or term is thus some rows a task. Everything after is Spark
SQL over the counts.

Nulls in text, lang or source are read as empty. A text without terms counts as
a document of its group, which appears even if it has none at all. Repeated rows
count each; long texts are cut in pieces of a batch but never shortened; ties go
by the item's UTF-8 bytes. An empty table gives an empty result. Other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.flat import pieces
from strandlake.llm.words import LETTERS, split
from strandlake.plans.lineage import cut, spent

#: Shares are in units of 1 / SCALE; ADDED is what every term's count is raised by.
SCALE, ADDED = 1_000_000_000, 5
#: Rows that a task sums up before it lets them go, and ways in which pairs of a language's sources are dealt out.
HELD, SPREAD = 300_000, 16

_COUNTS = "lang string, source string, term string, count long, docs long"
_KEYS = ["lang", "source", "term"]


def _encoded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = pc.fill_null(column.cast(pa.string()), "").dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _summed(batch: pa.RecordBatch) -> pa.Table:
    """Counts and document counts of a batch by (lang, source, term), and a row without a term for each group."""
    lang, langs = _encoded(batch.column("lang"))
    source, sources = _encoded(batch.column("source"))
    words, sizes = split(batch.column("text"), LETTERS)
    group = lang * max(len(sources), 1) + source
    seen = np.unique(group)
    found = words.dictionary_encode()
    n = max(len(found.dictionary), 1)
    in_doc, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
    pair, where = np.unique(group[in_doc // n] * n + in_doc % n, return_inverse=True)
    count = np.bincount(where, weights=times, minlength=len(pair)).astype(np.int64)
    docs = np.bincount(where, minlength=len(pair)).astype(np.int64)
    of = np.concatenate([pair // n, seen])
    term = pa.concat_arrays([found.dictionary.take(pa.array(pair % n)).cast(pa.string()), pa.nulls(len(seen), pa.string())])
    none = np.zeros(len(seen), np.int64)
    return pa.table({
        "lang": langs.take(pa.array(of // max(len(sources), 1))), "source": sources.take(pa.array(of % max(len(sources), 1))),
        "term": term, "count": np.concatenate([count, none]), "docs": np.concatenate([docs, none]),
    })


def _counted(batches):
    held: list[pa.Table] = []
    for batch in batches:
        for piece in pieces(batch, "text", 16_000_000):
            held.append(_summed(piece))
            if sum(t.num_rows for t in held) > HELD:
                held = [_merged(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from _merged(held).to_batches()


def _merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_KEYS).aggregate([("count", "sum"), ("docs", "sum")])
    return out.select([*_KEYS, "count_sum", "docs_sum"]).rename_columns([*_KEYS, "count", "docs"])


def postings(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, source, term, count, everywhere, lead) of kept terms, and a row with a null term for each group.

    ``everywhere`` is the term's count in the language; ``lead`` marks one row of
    each term.
    """
    texts = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    counts = texts.mapInArrow(_counted, _COUNTS).groupBy(*_KEYS).agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    all_of = counts.withColumns({
        "everywhere": F.sum("count").over(term), "_docs": F.sum("docs").over(term), "lead": F.col("source") == F.min("source").over(term),
    })
    kept = all_of.where(F.col("term").isNull() | (F.col("_docs") >= least))
    return kept.select(*_KEYS, "count", "everywhere", (F.col("lead") & F.col("term").isNotNull()).alias("lead"))


def _share(count: Column, size: Column) -> Column:
    """A term's share; ``size`` is N + 5 V. Exact for counts of any size: products are decimals."""
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)"), size.cast("decimal(20,0)"))
    return F.when(size > 0, whole + 1)


def _groups(posts: DataFrame) -> DataFrame:
    """(lang, source, size, support, zero, terms, lang_size) of every group."""
    own = posts.groupBy("lang", "source").agg(F.sum("count").alias("_n"), F.count("term").alias("support"))
    langs = posts.groupBy("lang").agg(F.sum("count").alias("_all"), F.sum(F.col("lead").cast("long")).alias("terms"))
    size = F.col("_n") + ADDED * F.col("terms")
    return own.join(langs, "lang").select(
        "lang", "source", size.alias("size"), "support", F.coalesce(_share(F.lit(0), size), F.lit(0)).alias("zero"), "terms",
        (F.col("_all") + ADDED * F.col("terms")).alias("lang_size"),
    )


def _pairs(groups: DataFrame) -> DataFrame:
    """(lang, source, other, …) of every two sources of a language, both ways; a language's pairs are dealt out by its sources."""
    one = groups.withColumn("_deal", F.pmod(F.xxhash64("source"), F.lit(SPREAD)).cast("int"))
    two = groups.select(
        "lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.col("support").alias("other_support"),
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_deal"),
    )
    return one.join(two, ["lang", "_deal"]).where("source <> other")


def _distances(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language."""
    pairs = _pairs(groups)
    key = ["lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")]
    histogram = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("_n"))
    one_sided = histogram.join(pairs.select("lang", "source", "other", "other_zero"), ["lang", "source"]).select(
        *key, (F.col("_n") * F.abs(F.col("p") - F.col("other_zero"))).alias("value")
    )
    neither = F.col("terms") - F.col("support") - F.col("other_support")
    constant = pairs.where("source < other").select(*key, (neither * F.abs(F.col("zero") - F.col("other_zero"))).alias("value"))
    mine = shared.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    theirs = shared.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    overlap = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zb")) - F.abs(F.col("za") - F.col("pb")) + F.abs(F.col("za") - F.col("zb"))
    both = mine.join(theirs, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(overlap).alias("value"))
    return one_sided.unionByName(constant).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms a source has more of than its language.

    Part ``pair`` has a row for each other source of the language, part ``term``
    the ``top`` kept terms of the group whose share is above the language's, by
    the difference. ``docs`` has text, lang and source.
    """
    posts = cut(postings(docs, least))
    groups = cut(_groups(posts))
    shared = posts.where("term is not null").join(groups.select("lang", "source", "size", "zero", "lang_size"), ["lang", "source"])
    shared = shared.withColumns({"p": _share(F.col("count"), F.col("size")), "q": _share(F.col("everywhere"), F.col("lang_size"))})
    shared = cut(shared.select(*_KEYS, "p", "q", "zero"))
    spent(posts)
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pair = _distances(shared, groups).select("lang", "value", F.inline(ends)).withColumn("part", F.lit("pair"))
    term = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = ["lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")]
    return pair.select(*out).unionByName(term.select(*out).where(F.col("rank") <= top))

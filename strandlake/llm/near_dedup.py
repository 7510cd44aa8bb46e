"""MinHash near-duplicate detection: SuperMinHash, banding, verification, union-find.

1. One Arrow pass over the texts makes each document's set of distinct word
   shingles and keeps a 128-bit fingerprint of the set, its size and the
   SuperMinHash signature.
2. Documents of equal sets collapse to the smallest id; only these go on, so
   thousands of copies cost no more than one.
3. Bands of the signature make candidates: two sets that share a band share a
   bucket. The smallest id of a bucket is its head.
4. First every candidate goes to one group only, that of its smallest head. A
   group is dealt into blocks of bounded rows and shingles, each with a copy of
   the head, and all pairs of a block are looked at: signatures are compared as
   matrices, and pairs that may reach the threshold and that union-find hasn't
   joined yet are verified on their full shingle sets. So a group of near copies,
   however large, ships each of its texts once.
5. Components of these links are classes. Buckets whose members are all of one
   class are done, and so are those whose members met in one block of the first
   round; buckets of equal members count once. What is left is whole
   again: pairs of different classes within a bucket. The largest class of a
   bucket is not compared with itself, so work and shipping follow the rows
   outside of it. Every pair of blocks is a unit of its own.
6. Components of classes, min id as the label, spread to the copies.

A link is lost only if two sets of similarity 0.8 share none of 40 bands of 5
rows (1.2e-7 at exactly 0.8, falling steeply above) or if their estimate from
200 components is below 0.66 (5 standard deviations).

Rows without words, or with null text, are linked with nothing. Repeated rows
get the same result each; rows of one id and different texts are one document,
linked with whatever one of them is linked with. A row with a null id links
nothing: it takes the component of rows of an equal set, and is then not kept,
else a null component. Extra columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.flat import appended, mix
from strandlake.llm.shingles import distinct_shingles
from strandlake.llm.superminhash import signatures
from strandlake.plans.components import connected_components
from strandlake.plans.lineage import cut, spent
from strandlake.plans.skew import lookup

_U = np.uint64
BANDS, ROWS = 40, 5
#: Rows of a block on average in the first and, times SECOND, in the second round, and its shingles; a unit of the second holds two blocks.
BLOCK, SECOND, BLOCK_SHINGLES = 64, 4, 2_000_000
#: Verify if the estimated similarity is at most this far below the threshold.
SLACK = 0.14


_SALT = 0x2545F4914F6CDD1D


def _fingerprints(doc: np.ndarray, value: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Sum of the scrambled elements of each set."""
    total = np.zeros(n, dtype=_U)
    np.add.at(total, doc, mix(value ^ _U(salt)))
    return total.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    def make(texts):
        doc, value = distinct_shingles(texts, width)
        out = {"n_shingles": np.bincount(doc, minlength=len(texts))}
        out["sig"] = [s.tobytes() for s in signatures(doc, value, len(texts), bands * rows)]
        for name, salt in (("f1", _SALT), ("f2", 0x9FB21C651E98DF25)):
            out[name] = _fingerprints(doc, value, len(texts), salt)
        return out

    return make


def _find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def links_between(ids, sigs, sets, left: int, threshold: tuple[int, int], slack: float, same: bool):
    """Links among the rows that join what isn't joined yet; rows before ``left`` are the first block.

    With ``same`` all pairs of the rows are looked at, else those of a row of
    the first block and one of the second. Rows of equal ``ids`` are joined.
    """
    n, m = len(ids), sigs.shape[1]
    least = threshold[0] / threshold[1]
    size = np.array([len(s) for s in sets])
    seen: dict = {}
    up, out = [seen.setdefault(x, i) for i, x in enumerate(ids)], []
    found = []
    columns = np.arange(n)
    for i in range(n if same else left):
        others = columns[i + 1 :] if same else columns[left:]
        if not len(others):
            continue
        fit = others[
            np.minimum(size[others], size[i]) * threshold[1] >= np.maximum(size[others], size[i]) * threshold[0]
        ]
        if not len(fit):
            continue
        alike = (sigs[fit] == sigs[i]).sum(axis=1) / m
        near = alike >= least - slack
        found.append(np.column_stack((np.full(near.sum(), i), fit[near], np.round(alike[near] * m))))
    if not found:
        return out
    found = np.concatenate(found).astype(np.int64)
    for i, j, _ in found[np.argsort(-found[:, 2], kind="stable")]:
        a, b = _find(up, i), _find(up, j)
        if a == b:
            continue
        x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        at = np.searchsorted(y, x)
        common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        if threshold[1] * common >= threshold[0] * (len(x) + len(y) - common):
            up[a] = b
            out.append((ids[i], ids[j]))
    return out


def _verify(width: int, threshold: tuple[int, int], slack: float, m: int):
    """Units of work (group, x, y) arrive sorted; rows of one may be spread over several frames.

    Rows are (group, x, y, own, class, id, f1, sig, text): links are between classes.
    """

    def unit(rows: list[tuple]) -> list[tuple]:
        same = rows[0][1] == rows[0][2]
        rows.sort(key=lambda r: (r[3] != r[1], r[5], r[6]))
        sets, at, right = [], 0, []
        while at < len(rows):  # texts in pieces, so that flat arrays stay small
            stop, chars = at, 0
            while stop < len(rows) and (stop == at or chars + len(rows[stop][8]) < 4_000_000):
                chars += len(rows[stop][8])
                stop += 1
            doc, value = distinct_shingles([r[8] for r in rows[at:stop]], width)
            sets += np.split(value, np.searchsorted(doc, np.arange(1, stop - at)))
            prints = _fingerprints(doc, value, stop - at, _SALT)
            # of several texts of one id the one that the signature is of
            right += [prints[i - at] == rows[i][6] for i in range(at, stop)]
            at = stop
        sets = [s for s, ok in zip(sets, right, strict=True) if ok]
        rows = [r for r, ok in zip(rows, right, strict=True) if ok]
        left = sum(r[3] == r[1] for r in rows)
        if len(rows) < 2 or not same and left in (0, len(rows)):
            return []
        sigs = np.frombuffer(b"".join(r[7] for r in rows), dtype=np.uint16).reshape(len(rows), m)
        return links_between([r[4] for r in rows], sigs, sets, left, threshold, slack, same)

    def run(frames):
        held: list[tuple] = []
        key = None
        out: list[tuple] = []
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if (row[0], row[1], row[2]) != key:
                    if len(held) > 1:
                        out += unit(held)
                    held, key = [], (row[0], row[1], row[2])
                held.append(row)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["src", "dst"])
                out = []
        if len(held) > 1:
            out += unit(held)
        yield pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return run


def _blocks(n: str, shingles: str, block: int):
    """Blocks for so many rows and shingles."""
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _dealt(blocks):
    return F.pmod(F.xxhash64("rep", "f1"), blocks).cast("int")


def _first_units(shared: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(group, x, y, own, class, rep, f1): every candidate once, beside the head of its group; and (rep, f1, home, own), the place of each."""
    home = cut(shared.groupBy("rep", "f1", "n").agg(F.min("head").alias("home")))
    members = home.where("rep <> home")
    sizes = cut(members.groupBy("home").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")))
    sized = sizes.select("home", F.col("rows").alias("count"), _blocks("rows", "shingles", block).alias("blocks"))
    own = lookup(members, sized.select("home", "blocks"), "home", counts=sized.select("home", "count"))
    own = cut(own.select("rep", "f1", "home", _dealt(F.col("blocks")).alias("own")))
    heads = home.select("rep", "f1").join(sized.select(F.col("home").alias("rep"), "blocks"), "rep").select(
        F.col("rep").alias("home"), "rep", "f1", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own")
    )
    rows = own.select("home", "rep", "f1", "own").unionByName(heads)
    units = rows.select(F.col("home").alias("group"), F.col("own").alias("x"), F.col("own").alias("y"), "own", F.col("rep").alias("class"), "rep", "f1")
    return units, own


def _other_units(marked: DataFrame, block: int) -> DataFrame | None:
    """The same for pairs of different classes in a bucket; None if no bucket has any.

    Done is a bucket whose members but the head were all in one block of the
    first round, with the head beside them: there all its pairs were looked at.
    """
    other = F.col("rep") != F.col("head")
    cell = F.struct("home", "own")
    met = marked.groupBy("key").agg(
        F.min(F.when(other, cell)).alias("low"), F.max(F.when(other, cell)).alias("high"), F.min(F.when(~other, cell)).alias("of_head"), F.min("head").alias("head"),
    )
    open_ = met.where(~(F.col("low").eqNullSafe(F.col("high")) & ((F.col("low.home") == F.col("head")) | F.col("low").eqNullSafe(F.col("of_head")))))
    marked = cut(marked.join(open_.select("key"), "key", "left_semi").select("key", "rep", "f1", "n", "class"))
    by_class = marked.groupBy("key", "class").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("rep", "f1")).alias("print"))
    per = by_class.groupBy("key").agg(
        F.count("*").alias("classes"), F.max(F.struct("rows", "class", "shingles")).alias("main"), F.sum("rows").alias("rows"),
        F.sum("shingles").alias("shingles"), F.bit_xor("print").alias("print"),
    ).where("classes > 1")
    # buckets of equal members are one
    per = per.groupBy("rows", "print").agg(F.min(F.struct("key", "main", "shingles")).alias("b")).select("rows", "b.*")
    per = per.select(
        "key", F.col("main.class").alias("main"), F.col("rows").alias("count"), (F.col("rows") - F.col("main.rows")).alias("few"),
        (F.col("shingles") - F.col("main.shingles")).alias("few_shingles"), F.col("main.rows").alias("most"), F.col("main.shingles").alias("most_shingles"),
    )
    per = cut(per.select("key", "main", "count", _blocks("few", "few_shingles", block).alias("r"), _blocks("most", "most_shingles", block).alias("m")))
    if per.isEmpty():
        spent(per)
        return None
    rows = lookup(marked, per.drop("count"), "key", counts=per.select("key", "count")).where("main is not null")
    is_main = F.col("class") == F.col("main")
    rows = rows.withColumn("own", F.when(is_main, F.col("r") + _dealt(F.col("m"))).otherwise(_dealt(F.col("r"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("r") - 1).otherwise(F.col("r") + F.col("m") - 1))))
    return rows.select(
        F.col("key").alias("group"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class", "rep", "f1"
    )


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (80, 100),
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    slack: float = SLACK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of
    ``width``-word shingles is at least ``threshold`` (a fraction). A component
    is named after its smallest id, whose row is the one ``kept``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = cut(appended(texts, "text", _sketch(width, bands, rows), "n_shingles long, f1 long, f2 long, sig binary"))
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "sig")).alias("m")
    sets = cut(full.groupBy("f1", "f2", "n_shingles").agg(first).select("f1", "f2", "n_shingles", F.col("m.doc_id").alias("rep"), "m.sig"))
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 2 * rows * b + 1, 2 * rows)) for b in range(bands)])
    bucket = sets.select("rep", F.explode(keys).alias("key"))
    heads = cut(bucket.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("count")).where("count > 1"))
    met = lookup(bucket, heads.select("key", "head"), "key", counts=heads.select("key", "count")).where("head is not null")
    repeats = _repeats(full)
    shared = cut((met.distinct() if repeats else met).join(sets.select("rep", "f1", F.col("n_shingles").alias("n")), "rep"))
    spent(heads)
    few = shared.select("rep", "f1").distinct().join(sets.select("rep", "f1", "sig"), ["rep", "f1"])
    wanted = texts.where("text is not null").withColumnRenamed("doc_id", "rep").join(few, "rep").select("rep", "f1", "sig", "text")
    wanted = cut(wanted.distinct() if repeats else wanted)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def verified(units: DataFrame) -> DataFrame:
        with_text = units.join(wanted, ["rep", "f1"]).select("group", "x", "y", "own", "class", "rep", "f1", "sig", "text")
        sorted_ = with_text.repartition(parts, "group", "x", "y").sortWithinPartitions("group", "x", "y")
        return sorted_.mapInPandas(_verify(width, threshold, slack, bands * rows), "src long, dst long")

    first_units, places = _first_units(shared, block)
    links = verified(first_units)
    if repeats:  # sets of one id belong together
        rep_of = full.join(sets.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"]).select("doc_id", "rep").distinct()
        least = rep_of.groupBy("doc_id").agg(F.min("rep").alias("dst"), F.max("rep").alias("_most")).where("dst <> _most")
        links = links.unionByName(rep_of.join(least, "doc_id").select(F.col("rep").alias("src"), "dst"))
    links = cut(links)
    classes = connected_components(links, node="rep", component="class")
    marked = cut(shared.join(classes, "rep", "left").join(places, ["rep", "f1"], "left").withColumn("class", F.coalesce("class", "rep")))
    units = _other_units(marked, SECOND * block)
    spread = sets.select("f1", "f2", "n_shingles", "rep").join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    if units is None:
        spread = spread.withColumnRenamed("class", "component_id")
    else:
        joined = cut(connected_components(cut(verified(units)), node="class", component="component_id"))
        spread = spread.join(joined, "class", "left").withColumn("component_id", F.coalesce("component_id", "class"))
    spread = cut(spread.select("f1", "f2", "n_shingles", "component_id"))
    spent(shared, marked, links, wanted, places)
    return (
        sketch.select("doc_id", "n_shingles", "f1", "f2").join(spread, ["f1", "f2", "n_shingles"], "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))
    )


def _repeats(full: DataFrame) -> bool:
    """Whether ids repeat, told from the narrow sketch, to spare the wide deduplication."""
    return not full.groupBy("doc_id").count().where("count > 1").isEmpty()

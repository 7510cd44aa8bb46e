"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words (A-Z lower-cased, runs of letters, digits
and non-ASCII characters) and cut into windows of consecutive words; an item of
fewer words, but not none, is one window. All windows form one automaton, which
scans each document's normalised text once. Matches are mapped to word numbers
and from there to character offsets of the original text.

The benchmark is read to the driver only behind a check of its size: the items
are dealt, by a hash, into as many blocks as keep each automaton about under
``BLOCK_CHARS`` characters of window text, and no item is left out. The first
block's scan passes all documents through. Further blocks return texts with hits
only, once for equal texts, and these few are looked up by a digest of the text.

Null and empty texts have no words and are never contaminated. Repeated rows,
and rows of a null id, get the same result each; items of equal text are all
named. An item without an id contaminates like any other but can't be named; one
without words has no windows. A column of ``docs`` with the name of a result is
replaced by it, all others pass through. Empty tables give no rows, and an empty
benchmark no matches.
"""

from __future__ import annotations

import hashlib
import json
import math

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.flat import appended
from strandlake.plans.lineage import cut
from strandlake.plans.skew import lookup

#: Window text of one automaton, in characters; about 40 bytes of memory each at most.
BLOCK_CHARS = 8_000_000

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Bytes of words stay (A-Z lower-cased); every other ASCII byte becomes a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or b in _WORD else 0x20 for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(text: str | None, size: int) -> list[str]:
    words = [w.decode("utf-8", "surrogatepass") for w in normal_words(text)]
    return [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets (start, end) of each word in the original text."""
    spans, start = [], -1
    for i, ch in enumerate(text):
        inside = ord(ch) >= 0x80 or (_FOLD[ord(ch)] != 0x20)
        if inside and start < 0:
            start = i
        elif not inside and start >= 0:
            spans.append((start, i))
            start = -1
    return [*spans, (start, len(text))] if start >= 0 else spans


def build(items: list[tuple[str, str]], size: int) -> ahocorasick.Automaton:
    """Automaton of the windows of (id, text) items; a match carries (words, ids)."""
    owners: dict[str, set[str]] = {}
    for item, text in items:
        for window in windows_of(text, size):
            owners.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        automaton.add_word(f" {window} ", (window.count(" ") + 1, sorted(i for i in ids if i is not None)))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged ranges (first, past last) of word numbers inside matches, and the items found."""
    ranges: list[list[int]] = []
    found: set[str] = set()
    if not words or not len(automaton):
        return [], found
    text = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    at = word = 0
    for end, (length, ids) in automaton.iter(text):
        word += text.count(" ", at, end)  # words that end before the match's last space
        at = end
        first = word - length
        found.update(ids)
        while ranges and first <= ranges[-1][0]:
            ranges.pop()
        if ranges and first <= ranges[-1][1]:
            ranges[-1][1] = word
        else:
            ranges.append([first, word])
    return [(a, b) for a, b in ranges], found


#: Column of a text's digest while several blocks are put together.
_DIGEST = "_leak_text_digest"
_built: dict[str, ahocorasick.Automaton] = {}


def _scanner(shared, name: str, size: int, spans: bool, digest: bool):
    def make(texts):
        if name not in _built:
            _built.clear()
            _built[name] = build(json.loads(shared.value), size)
        out = {"n_words": [], "ranges": [], "items": [], "spans": []}
        for text in texts:
            words = normal_words(text)
            ranges, found = scan(_built[name], words)
            where = word_spans(text) if spans and ranges else []
            out["n_words"].append(len(words))
            out["ranges"].append([{"a": a, "b": b} for a, b in ranges])
            out["items"].append(sorted(found))
            out["spans"].append([{"start": where[a][0], "end": where[b - 1][1]} for a, b in ranges] if where else [])
        if digest:
            out[_DIGEST] = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
        return out

    return make


_SCHEMA = (
    "n_words long, ranges array<struct<a: long, b: long>>, items array<string>, spans array<struct<start: long, end: long>>"
)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, spans: bool = True, block_chars: int = BLOCK_CHARS,
    keep_text: bool = False,
) -> DataFrame:
    """Matches of benchmark windows in every row of ``docs`` (text and any other columns).

    Returns the other columns of ``docs`` (and its text with ``keep_text``; those
    with the name of a result are replaced), n_words, n_hit (words inside any match), items (sorted ids),
    spans (character offsets in the original text, per block of items merged)
    and contaminated.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    bench = bench.where("text is not null")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total * size / block_chars))
    rows = docs.withColumn("text", F.col("text").cast("string")).drop("n_words", "n_hit", "ranges", "items", "spans", "contaminated", _DIGEST)
    others = [c for c in rows.columns if c != "text" or keep_text]
    schema = _SCHEMA + f", {_DIGEST} binary" * (blocks > 1)

    def scanned(df: DataFrame, block: int, drop: bool) -> DataFrame:
        mine = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = json.dumps(sorted(((r[0], r[1]) for r in mine.toLocalIterator()), key=lambda r: (r[0] or "", r[1])))
        name = hashlib.sha256(f"{size}\n{items}".encode()).hexdigest()
        return appended(df, "text", _scanner(spark.sparkContext.broadcast(items), name, size, spans, blocks > 1), schema, drop=drop)

    found = scanned(rows, 0, not keep_text)
    if blocks > 1:
        lists = ("ranges", "items", "spans")
        hits = None
        for block in range(1, blocks):
            some = scanned(rows.select("text"), block, True).where(F.size("ranges") > 0).select(_DIGEST, *lists).dropDuplicates([_DIGEST])
            hits = some if hits is None else hits.unionByName(some)
        more = cut(hits.groupBy(_DIGEST).agg(*[F.flatten(F.collect_list(c)).alias(f"_more_{c}") for c in lists]))
        found = lookup(found, more, _DIGEST)
        found = found.withColumns({c: F.when(F.col(f"_more_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"_more_{c}")) for c in lists})
    state = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    hit = F.aggregate(
        F.array_sort("ranges"), state,
        lambda s, r: F.struct(
            (s["total"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["reach"]))).alias("total"),
            F.greatest(s["reach"], r["b"]).alias("reach"),
        ),
        lambda s: s["total"],
    )
    return found.select(
        *others, "n_words", hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans",
        (F.size("ranges") > 0).alias("contaminated"),
    )

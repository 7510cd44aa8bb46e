"""Main text of web pages by nearest-URL page differencing.

1. A tokeniser splits each page into blocks of text and marks where each stands:
   inside an element that says it is no content (menus, headers, footers,
   asides, forms, and classes, ids or roles for adverts, notices, comments and
   the like), inside an ``article`` or ``main`` element, or neither.
2. Within each host pages are ordered by URL path; the pages before and after
   are the nearest in URL. The order of all pages is cut into ranges of up to
   about ``BIG_HOST`` pages, wherever hosts begin, so no host is one group. The
   last page of a range also goes to the next one and the first to the one
   before, so every page sees both its neighbours.
3. All lines that stand in no such element are aligned with the neighbour's by
   longest common subsequence; shared lines are deleted. A range is sorted and
   streamed, so a task holds three pages at a time.

Articles repeat sentences of each other, so one neighbour is no evidence against
an article's line: of these go lines that are mostly links, and those that both
neighbours share (bylines, share bars). A neighbour that shares more than half the characters of the shorter article is
a copy and deletes none but lines of links. If a page
has an article, what stands outside is no content. A pair that shares all its
lines tells template from text as little as a copy does, so the deletion is
dropped if it would empty the page.

Null html gives an empty text; a null url has no host and no neighbour. Equal
rows are one page with one text: their neighbours are the nearest pages that
differ from them. Rows of one page_id, or of a null one, that differ are pages of
their own. Extra columns are ignored, whatever their names; an empty table gives
no rows. Broken markup costs no more than its length: an unclosed quote, tag,
comment or script is looked for once.
"""

from __future__ import annotations

import html as _html
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of a range at most, and at least while there are fewer ranges than shuffle partitions; the most ranges, and pages sampled for each.
BIG_HOST, SMALL_RANGE, RANGES, SAMPLED = 20_000, 500, 4096, 32
#: Beginnings of ranges that are looked through at a time.
STRIDE = 64
#: Cells of a table held at a time; longer lists of lines are halved until their parts fit.
CELLS = 640_000

# Elements that are no content, elements that begin a block, elements without an end tag, elements of raw text
DROPPED = frozenset(
    "nav header footer aside form script style noscript template head title iframe object embed svg canvas math button select "
    "option textarea input label fieldset dialog menu menuitem audio video map applet frame frameset".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = "script style noscript template textarea title iframe svg math xmp"
# Words in classes, ids and roles that mark what is no content
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|"
    r"nav\w*|menu\w*|breadcrumb\w*|pagination|pager|sidebar\w*|side|widget\w*|footer\w*|header|masthead|topbar|toolbar|comment\w*|"
    r"disqus|respond|repl(?:y|ies)|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|newsletter|subscri\w*|signup|login|"
    r"search\w*|form|contentinfo|complementary|navigation|dialog|hidden|skip\w*|legal|copyright|disclaimer|tags?|outbrain|taboola)"
    r"(?=$|[\s_-])",
    re.I,
)
_TAG = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r"[<>\"']")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split()}
_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_GONE = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: Class names that tell about other parts of the page, such as ``has-sidebar``.
_ABOUT = re.compile(r"(?:has|with|no|without|is|not)[-_]", re.I)

OWN, OPEN, LINKS = 0, 1, 2


def _marked(rest: str) -> bool:
    """Whether an element's attributes say that it is no content."""
    names = (name for groups in _ATTR.findall(rest) for name in " ".join(groups).split())
    return any(MARKS.search(name) and not _ABOUT.match(name) for name in names) or bool(_GONE.search(rest))


def tokens(page: str):
    """(text, None, None, False) and ("", tag, attributes, whether it closes) in page order; comments, declarations and raw text are left out.

    A tag ends at the first ``>`` outside quotes; if a ``<`` or the page's end
    comes first, its ``<`` is text. A quote that is never closed is a character.
    """
    at, n = 0, len(page)
    unclosed: set[str] = set()  # marks that don't occur in the rest of the page

    def find(mark: str, start: int) -> int:
        if mark in unclosed:
            return -1
        found = page.find(mark, start)
        if found < 0:
            unclosed.add(mark)
        return found

    def tag_end(start: int) -> int:
        while (m := _STOP.search(page, start)) is not None:
            mark = m.group()
            if mark == ">":
                return m.start()
            if mark == "<":
                return -1
            closed = find(mark, m.end())
            start = (closed if closed >= 0 else m.start()) + 1
        return -1

    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            yield page[at:], None, None, False
            return
        if open_at > at:
            yield page[at:open_at], None, None, False
        if page.startswith("<!--", open_at):
            close = find("-->", open_at + 4)
            at = close + 3 if close >= 0 else n
            continue
        if page.startswith("<![CDATA[", open_at) and (close := find("]]>", open_at)) >= 0:
            at = close + 3
            continue
        if page.startswith(("<!", "<?"), open_at) and (close := find(">", open_at)) >= 0:
            at = close + 1
            continue
        name = _TAG.match(page, open_at + 1)
        close = tag_end(name.end()) if name else -1
        if close < 0:
            yield "<", None, None, False
            at = open_at + 1
            continue
        tag, closes = name.group(1).lower(), page[open_at + 1] == "/"
        at = close + 1
        if tag in _RAW_END and not closes:
            over = _RAW_END[tag].search(page, at)
            at = over.end() if over else n
            continue
        yield "", tag, page[name.end() : close], closes


def blocks(page: str | None, marks: bool = True) -> list[tuple[str, int]]:
    """(text, kind) of each block in page order: OWN in an article, OPEN undecided, LINKS an article's block of links.

    Should classes, ids and roles leave nothing of a page, its elements alone
    decide (``marks`` False).
    """
    out: list[tuple[str, int, bool]] = []
    if not page:
        return []
    stack: list[tuple[str, bool, bool]] = []  # tag, no content, in an article
    opened: dict[str, int] = {}  # tags on the stack
    dropped, inside, linked = 0, 0, 0
    parts: list[str] = []
    chars = in_links = 0

    def end() -> None:
        nonlocal chars, in_links
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((text, inside > 0, chars > 0 and in_links >= 0.8 * chars))
            parts.clear()
        chars = in_links = 0

    def close_from(at: int) -> None:
        nonlocal dropped, inside
        for name, drop, main in stack[at:]:
            opened[name] -= 1
            dropped -= drop
            inside -= main
        del stack[at:]

    for text, tag, rest, closes in tokens(page):
        if tag is None:
            if not dropped:
                parts.append(text)
                n = len(text) - text.count(" ")
                chars += n
                if linked:
                    in_links += n
            continue
        if tag in BLOCK:
            end()
        if closes:
            if tag == "a":
                linked = max(linked - 1, 0)
            if opened.get(tag):
                close_from(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in VOID or rest.endswith("/"):
            continue
        if tag == "p" and opened.get("p"):  # a paragraph ends the one before
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close_from(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag == "a":
            linked += 1
            continue
        main = tag in ("article", "main") and not dropped
        drop = tag in DROPPED
        if rest and marks and not drop and tag not in ("html", "body"):
            drop = _marked(rest)
            if tag in ("article", "main") and inside == 0 and not re.search(r"comment|advert|sponsor|promo", rest, re.I):
                drop = False
        if drop:
            end()
        stack.append((tag, drop, main))
        opened[tag] = opened.get(tag, 0) + 1
        dropped += drop
        inside += main
    end()
    if not out and marks:
        return blocks(page, marks=False)
    return [(t, (LINKS if links else OWN) if main else OPEN) for t, main, links in out]


def shared_lines(mine: list[int], other: list[int]) -> set[int]:
    """Positions of ``mine`` on a longest common subsequence with ``other``."""
    a, b = 0, min(len(mine), len(other))
    while a < b and mine[a] == other[a]:
        a += 1
    z = 0
    while z < b - a and mine[-1 - z] == other[-1 - z]:
        z += 1
    out = {*range(a), *range(len(mine) - z, len(mine))}
    common = set(mine[a : len(mine) - z]) & set(other[a : len(other) - z])
    left = [i for i in range(a, len(mine) - z) if mine[i] in common]
    right = [x for x in other[a : len(other) - z] if x in common]
    return out | {left[i] for i in _aligned(np.array([mine[i] for i in left]), np.array(right))}


def _lengths(a, b):
    """Rows 0, 1, ... of the table: longest common subsequences of beginnings of ``a`` with those of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    yield row
    for x in a:
        row = np.concatenate(([0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))))
        yield row


def _aligned(a, b) -> list[int]:
    """Positions of ``a`` on a longest common subsequence with ``b``, in memory that doesn't grow with the product (Hirschberg, 1975)."""
    if not len(a) or not len(b):
        return []
    if len(a) > 1 and (len(a) + 1) * (len(b) + 1) > CELLS:
        half = len(a) // 2
        for upper in _lengths(a[:half], b):
            pass
        for lower in _lengths(a[half:][::-1], b[::-1]):
            pass
        at = int(np.argmax(upper + lower[::-1]))
        return _aligned(a[:half], b[:at]) + [half + i for i in _aligned(a[half:], b[at:])]
    table = np.stack(list(_lengths(a, b)))
    i, j, out = len(a), len(b), []
    while i and j:
        if b[j - 1] == a[i - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def main_text(lines: list[str], kinds: list[int], keys: list[int], neighbours: list[tuple[list[int], int]]) -> str:
    """Text of a page's lines less those shared with a neighbour.

    ``keys`` are hashes of the lines; a neighbour is its own keys and the
    characters of its article, or of all its lines if it has none.
    """
    has_own = OWN in kinds
    size = own_chars(lines, kinds)
    gone: set[int] = set()
    agreed: list[set[int]] = []
    for other, other_size in neighbours:
        shared = shared_lines(keys, other)
        own = {i for i in shared if kinds[i] == OWN}
        copy = 2 * sum(len(lines[i]) for i in own) > min(size, other_size)
        agreed.append(set() if copy else own)
        gone |= shared - own
    if len(agreed) > 1:
        gone |= set.intersection(*agreed)
    inside = [i for i, k in enumerate(kinds) if k != OPEN or not has_own]
    keep = [i for i in inside if i not in gone]
    if not keep:
        keep = [i for i in inside if kinds[i] == OWN or not has_own]
    return " ".join(lines[i] for i in keep)


def own_chars(lines: list[str], kinds: list[int]) -> int:
    """Characters of a page's article, or of all lines if it has none."""
    return sum(len(t) for t, k in zip(lines, kinds, strict=True) if k == OWN or OWN not in kinds)


def _page(html: str | None) -> dict:
    rows = blocks(html)
    lines, kinds = [t for t, _ in rows], [k for _, k in rows]
    hashes = pd.util.hash_array(np.array(lines, dtype=object), categorize=False).view(np.int64) if lines else np.zeros(0, np.int64)
    return {"lines": lines, "kinds": kinds, "keys": hashes.tolist(), "own": own_chars(lines, kinds)}


def _assemble(batches):
    """Texts of a sorted stream of pages. Equal rows in a row are one page; a page waits for the one after it."""
    made: list[tuple[int, str, str]] = []
    before: dict | None = None
    held: dict | None = None  # the page that waits, and how many of its rows get a result
    copies = 0

    def near(other):
        fits = other and held["host"] and (other["part"], other["host"]) == (held["part"], held["host"])
        return [(other["keys"], other["own"])] if fits else []

    def batch(rows):
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "url", "text"])

    def done(after):
        if not copies:
            return
        text = main_text(held["lines"], held["kinds"], held["keys"], near(before) + near(after))
        row, most = (held["page_id"], held["url"], text), max(4_000_000 // (len(text) + 1), 1)
        for left in range(copies, 0, -most):
            made.extend([row] * min(left, most))
            if len(made) >= 1024 or sum(len(r[2]) for r in made) > 4_000_000:
                yield batch(made)
                made.clear()

    same = ("part", "host", "path", "page_id", "url", "html")
    for given in batches:
        for at in range(0, given.num_rows, 64):
            for row in given.slice(at, 64).to_pylist():
                if held is None or any(held[c] != row[c] for c in same):
                    page = row | _page(row["html"])
                    if held is not None:
                        yield from done(page)
                        before = held
                    held, copies = page, 0
                copies += not row["guest"]
    if held is not None:
        yield from done(None)
    yield batch(made)


_PLACE = ("host", "path", "page_id", "url")


def _ranged(base: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Adds part, the number of the range of up to about ``size`` pages, to rows that have the columns of _PLACE; and the ranges."""
    parts, n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), base.count()
    ranges = min(max(min(n // min(SMALL_RANGE, size), parts), n // size, 1), RANGES)
    starts: list[tuple] = []
    if ranges > 1:
        # a page's hash chooses it, so the sample is the same each time
        found = base.where("page_id is not null").select(*_PLACE[:3]).orderBy(F.xxhash64(*_PLACE), *_PLACE[:3]).limit(SAMPLED * ranges).collect()
        order = sorted(map(tuple, found), key=lambda r: (r[0].encode(), r[1].encode(), r[2]))
        starts = list(dict.fromkeys(order[i * len(order) // ranges] for i in range(1, ranges) if order))
    if not starts:
        return base.withColumn("part", F.lit(0)), 1
    place = F.struct(*_PLACE[:3])
    kind = "array<struct<host: string, path: string, page_id: bigint>>"

    def literal(rows):
        return F.from_json(F.lit(json.dumps([{"host": h, "path": p, "page_id": i} for h, p, i in rows])), kind)

    def before(rows):
        return F.aggregate(rows, F.lit(0), lambda n, x: n + (x <= place).cast("int"))

    # every STRIDE-th beginning first, then those between
    coarse = before(literal(starts[STRIDE - 1 :: STRIDE]))
    fine = F.aggregate(F.slice(literal(starts), coarse * STRIDE + 1, F.lit(STRIDE)), F.lit(0), lambda n, x: n + (x <= place).cast("int"))
    return base.withColumn("part", coarse * STRIDE + fine), len(starts) + 1


def _met(ranged: DataFrame) -> DataFrame | None:
    """(_id, _url, also): the pages at an end of a range, null ids too, and the ranges that they border on within their host."""
    place = F.struct(*_PLACE)
    ends = ranged.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last")).collect()
    ends.sort(key=lambda r: r["part"])
    also: dict[tuple, list[int]] = {}
    for one, two in zip(ends, ends[1:], strict=False):
        if one["last"]["host"] and one["last"]["host"] == two["first"]["host"]:
            also.setdefault((one["last"]["page_id"], one["last"]["url"]), []).append(two["part"])
            also.setdefault((two["first"]["page_id"], two["first"]["url"]), []).append(one["part"])
    rows = [(i, u, p) for (i, u), p in also.items()]
    return ranged.sparkSession.createDataFrame(rows, "_id long, _url string, also array<int>") if rows else None


def extract(pages: DataFrame, big_host: int = BIG_HOST) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    rest = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
        F.col("html").cast("string").alias("html"),
    )
    ranged, ranges = _ranged(base, big_host)
    met = _met(ranged)
    # pages without a host have no neighbours and need no range
    ranged = ranged.withColumn("part", F.when(F.col("host") == "", -1 - F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 20)).cast("int")).otherwise(F.col("part")))
    if met is None:
        dealt = ranged.withColumn("guest", F.lit(False))
    else:
        # a page at the end of a range is a guest in the next one: a neighbour there, without a result
        places = F.concat(
            F.array(F.struct("part", F.lit(False).alias("guest"))),
            F.transform(F.coalesce("also", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(True).alias("guest"))),
        )
        at_end = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("url") == F.col("_url"))
        dealt = ranged.join(F.broadcast(met), at_end, "left").withColumn("place", F.explode(places)).select(
            *[c for c in ranged.columns if c != "part"], "place.part", "place.guest"
        )
    # a range is a partition: hashed, several would meet in one
    slot = F.pmod("part", F.lit(ranges)).cast("int")
    streamed = dealt.repartitionById(ranges, slot).sortWithinPartitions("part", *_PLACE, F.xxhash64("html")).select("part", "guest", *_PLACE, "html")
    return streamed.mapInArrow(_assemble, "page_id long, url string, text string")

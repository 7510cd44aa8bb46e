"""Quality rules by distribution divergence, in DataFrame expressions only.

References are learnt from the table itself: for each language the shares of
character classes over all its documents, and those of its most frequent words.
A language needs ``REFERENCE_WORDS`` words in all, however small its share of the
table; at most ``LANGUAGES`` of them, those with the most words, have a reference.
A document's own shares are compared with every language's by Jensen-Shannon
distance and the nearest language counts. The distance of words is measured in
units of what a text without any of the language's common words has, so lacking
them all gives 1 whatever the language. Documents too short for a histogram pass
by a minimum length guard, and so do documents of a declared language that has
no reference: there is nothing to compare them with. The base rules (word count,
repeated 5-word windows) come first.

Everything per document is computed within its row; only word counts are
shuffled, after partial aggregation. Words are compared as they stand: sentence
case and shouting are part of a distribution. The driver receives ``TOP`` words
and one row of sums for each reference.

Null and empty texts have no words and fail the base rules. With no language in
the table the divergence rules pass everything. Rows without a language are
compared with all references. Repeated rows, and rows of a null id, are judged
each on its own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.fence import fenced
from strandlake.plans.lineage import cut, spent

#: Common words per language, words that a language needs for a reference, and the most references.
TOP, REFERENCE_WORDS, LANGUAGES = 20, 2_000, 200
#: Guards: words and characters from which the histograms are compared, and the largest distances kept (of words: in units of having no common word).
MIN_WORDS, MIN_CHARS, MAX_WORD_DISTANCE, MAX_CHAR_DISTANCE = 80, 300, 0.97, 0.25
MIN_BASE_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_SPACE = "[\\x20\\x09-\\x0D]+"
CLASSES = ("lower", "other", "upper", "space", "symbol", "digit", "mark")


def measured(docs: DataFrame) -> DataFrame:
    """Base counts and character classes beside the columns of ``docs``; helper columns start with ``_``."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    out = docs.withColumn("_t", t).withColumn("_r0", F.regexp_replace("_t", "[a-z]+", ""))
    for i, pattern in enumerate(("[^\\x00-\\x7F]+", "[A-Z]+", _SPACE, "[#*$%&|<>]+", "[0-9]+")):
        out = out.withColumn(f"_r{i + 1}", F.regexp_replace(f"_r{i}", pattern, ""))
    sizes = [F.length("_t"), *[F.length(f"_r{i}") for i in range(6)]]
    classes = [(sizes[i] - sizes[i + 1]).cast("long") for i in range(6)] + [sizes[6].cast("long")]
    return out.select(
        *docs.columns, "_t", *[c.alias(f"_{name}") for c, name in zip(classes, CLASSES, strict=True)],
        F.array_remove(F.split("_t", _SPACE), "").alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows of WINDOW words that occur twice or more."""
    w = WINDOW
    df = df.withColumn("_hw", F.transform("_words", lambda x: F.xxhash64(x)))
    starts = F.sequence(F.lit(0), F.size("_words") - w)
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get("_hw", i + k) for k in range(w)]))
    df = df.withColumn("_win", F.when(F.size("_words") > w, window).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_win")) < F.size("_win")
    pairs = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty = F.lit(None).cast("array<struct<h: bigint, i: int>>")
    df = df.withColumn("_sorted", F.when(again, pairs).otherwise(empty))
    same = F.filter(
        "_sorted",
        lambda s, j: (F.get("_sorted", j - 1)["h"] == s["h"]) | F.coalesce(F.get("_sorted", j + 1)["h"] == s["h"], F.lit(False)),
    )
    df = df.withColumn("_at", F.sort_array(F.transform(same, lambda s: s["i"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "_at", zero,
        lambda a, p: F.struct((p + w).alias("end"), (a["n"] + p + w - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def references(docs: DataFrame) -> list[tuple[str, list[float], dict[str, float]]]:
    """(language, shares of character classes, shares of its common words) of each language with enough words."""
    known = docs.where(F.col("_lang").isNotNull())
    words = known.select("_lang", F.explode(F.split("_text", _SPACE)).alias("w")).where("w <> ''")
    counts = cut(words.groupBy("_lang", "w").count())
    held = {
        r["_lang"]: r["n"] for r in counts.groupBy("_lang").agg(F.sum("count").alias("n")).where(F.col("n") >= REFERENCE_WORDS)
        .orderBy(F.desc("n"), "_lang").limit(LANGUAGES).collect()
    }
    if not held:
        spent(counts)
        return []
    wide = known.where(F.col("_lang").isin(sorted(held)))
    best = Window.partitionBy("_lang").orderBy(F.col("count").desc(), "w")
    few = counts.where(F.col("_lang").isin(sorted(held))).withColumn("r", F.row_number().over(best)).where(F.col("r") <= TOP)
    top: dict[str, dict[str, float]] = {}
    for r in few.collect():
        top.setdefault(r["_lang"], {})[r["w"]] = r["count"] / held[r["_lang"]]
    spent(counts)
    sums = {r["_lang"]: r for r in measured(wide).groupBy("_lang").agg(*[F.sum(f"_{c}").alias(c) for c in CLASSES]).collect()}
    out = []
    for name in sorted(held):
        chars = sum(sums[name][c] for c in CLASSES) or 1
        out.append((name, [sums[name][c] / chars for c in CLASSES], top[name]))
    return out


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _entropy_part(m: Column) -> Column:
    return F.coalesce(m * F.log2(m), F.lit(0.0))


def _mixed(q: float) -> float:
    """Part of a bin that only the reference has."""
    return q / 2 * math.log2(q / 2) if q > 0 else 0.0


def lacking(q: list[float]) -> float:
    """Distance between a reference and a document that has nothing but the reference's last bin."""
    rest = q[-1]
    alone = math.fsum(-_mixed(x) for x in q[:-1]) - ((1 + rest) / 2) * math.log2((1 + rest) / 2)
    own = -math.fsum(x * math.log2(x) for x in q if x > 0)
    return math.sqrt(max(alone - own / 2, 0.0))


def _least_distance(bins: Column, refs: list[list[float]]) -> Column:
    """Smallest Jensen-Shannon distance between a document's non-empty bins and the references, each in units of :func:`lacking`.

    ``bins`` is an array of (i, p): bin numbers and shares. With m the mean of
    both distributions the divergence is H(m) - (H(p) + H(q)) / 2; bins that the
    document leaves empty enter through a constant per reference, so only
    non-empty ones are visited. ``bins`` is bound to a lambda's variable: as a
    column it could be inlined and computed again for every reference.
    """
    tables = F.array(*[
        F.struct(
            _doubles(q).alias("q"), _doubles(map(_mixed, q)).alias("alone"), F.lit(math.fsum(map(_mixed, q))).alias("all"),
            F.lit(math.fsum(2 * _mixed(x) + x for x in q)).alias("own"), F.lit(lacking(q) or 1.0).alias("unit"),
        )
        for q in refs
    ])

    def least(mine):
        own = F.aggregate(mine, F.lit(0.0), lambda a, b: a + _entropy_part(b["p"]))

        def one(ref):
            mean = F.aggregate(
                mine, ref["all"],
                lambda a, b: a + _entropy_part((b["p"] + F.get(ref["q"], b["i"])) / 2) - F.get(ref["alone"], b["i"]),
            )
            return F.sqrt(F.greatest(ref["own"] / 2 - mean + own / 2, F.lit(0.0))) / ref["unit"]

        return F.array_min(F.transform(tables, one))

    return F.get(F.transform(F.array(bins), least), F.lit(0))


def _least_dense_distance(shares: list[Column], refs: list[list[float]]) -> Column:
    """The same for a few bins that are columns of their own: plain arithmetic, compiled with the stage."""

    def total(parts):
        return functools.reduce(lambda a, b: a + b, map(_entropy_part, parts))

    own = total(shares)
    each = [
        (own + math.fsum(2 * _mixed(x) + x for x in q)) / 2 - total([(p + F.lit(x)) / 2 for p, x in zip(shares, q, strict=True)])
        for q in refs
    ]
    return F.sqrt(F.greatest(F.lit(0.0), F.least(*each) if len(each) > 1 else each[0]))


def quality_rules(docs: DataFrame, refs: list | None = None) -> DataFrame:
    """Verdict of every row of ``docs`` (doc_id, text, lang).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, word_distance (in units of a text without any
    common word), char_distance (both null below the guards) and kept.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"),
        F.col("lang").cast("string").alias("_lang"),
    )
    refs = references(rows) if refs is None else refs
    df = _repeats(measured(rows))
    n_words, chars = F.size("_words").cast("long"), F.length("_t")
    none = F.lit(None).cast("double")
    if refs:
        vocabulary = sorted({w for _, _, shares in refs for w in shares})
        common = F.filter("_words", lambda w: w.isin(vocabulary))
        df = df.withColumn("_common", F.when(n_words >= MIN_WORDS, common))
        df = df.withColumn("_line", F.concat(F.lit(" "), F.array_join("_common", "  "), F.lit(" ")))
        listed = F.array(*map(F.lit, vocabulary))

        def share(w):
            key = F.concat(F.lit(" "), w, F.lit(" "))
            n = (F.length("_line") - F.length(F.replace("_line", key, F.lit("")))) / F.length(key)
            return F.struct((F.array_position(listed, w) - 1).cast("int").alias("i"), (n / F.size("_words")).alias("p"))

        df = df.withColumn("_bins", F.transform(F.array_distinct("_common"), share))
        rest = 1.0 - F.aggregate("_bins", F.lit(0.0), lambda a, b: a + b["p"])
        last = F.struct(F.lit(len(vocabulary)).alias("i"), F.greatest(F.lit(0.0), rest).alias("p"))
        tables = [[s.get(w, 0.0) for w in vocabulary] for _, _, s in refs]
        word_distance = _least_distance(F.concat("_bins", F.array(last)), [[*t, max(0.0, 1 - sum(t))] for t in tables])
        df = df.withColumns({f"_p{i}": F.col(f"_{c}") / F.greatest(chars, F.lit(1)).cast("double") for i, c in enumerate(CLASSES)})
        char_distance = _least_dense_distance([F.col(f"_p{i}") for i in range(len(CLASSES))], [c for _, c, _ in refs])
    else:
        word_distance = char_distance = none
    df = df.withColumn("word_distance", F.when(n_words >= MIN_WORDS, word_distance)).withColumn(
        "char_distance", F.when(chars >= MIN_CHARS, char_distance)
    )
    failed = (n_words < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n_words)
    names = [name for name, _, _ in refs]
    foreign = F.col("_lang").isNotNull() & ~F.col("_lang").isin(names) if names else F.lit(True)
    fits = foreign | (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE) & (
        F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE
    )
    judged = df.select(
        "doc_id", n_words.alias("n_words"), (chars.cast("long") - F.col("_space")).alias("word_chars"),
        F.col("_symbol").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), "word_distance", "char_distance", (~failed & fits).alias("kept"),
    )
    return fenced(judged, "doc_id", "base_failed", "kept")

"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Tokens are the words of a text, A-Z lower-cased, and one end. Every count is
exact and over the whole training part: a token's count c, their sum N, and the
number V of distinct ones. The model factors a token's probability as
``P(class | context) * P(token | class, context)``:

* the HEAD commonest tokens, with the end, are dealt into classes of WORDS by
  frequency; both factors are maximum-entropy models whose features are the
  previous word, the one before (skipping one), the one before that (skipping
  two) and the previous two together, hashed to rows of two weight tables;
* every other token, seen or not, belongs to the class of its last letter, and
  is drawn there in proportion to c + 0.5, one unseen token counted in. This is
  a distribution over all tokens: nothing is left out of it.

**Training** is by rounds. The training documents are dealt over ROUNDS by a
hash; in each round every task starts from the same weights, takes a gradient
step for each block of its tokens (observed less expected counts, divided by the
expected counts so far), and gives back what changed, row by row. Changes are
averaged by how often the task saw a row, in two levels of summation, so a task
holds one table however many tasks there are. All training documents are seen
once, whole.

**Scoring** goes through every text in blocks that touch the active rows only.
Counts of the LISTED commonest tokens are sent along. All others are joined
by token: the list ends where counts fall under about N / LISTED, so no other token of
the training part is hot.

Nulls and empty texts are one end. A document without an id counts as training
text. Long texts are read in blocks of tokens, whole; repeated rows are scored
each, and count each in training; ties in frequency go by the token. Over an
empty training part every token has probability one in its class. Columns
other than ``doc_id`` and ``text`` aren't read, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.flat import mix, pieces
from strandlake.llm.words import SPACED, split
from strandlake.plans.lineage import cut, spent, total

#: Head tokens and their classes' size; classes of the others; tokens whose counts are sent along.
HEAD, WORDS, ENDINGS, LISTED = 512, 32, 32, 65_536
CLASSES = HEAD // WORDS + ENDINGS
#: Rows of the weight tables of classes and of words within a class; features a token has in each.
ROWS, INNER, FEATURES = 1 << 13, 1 << 14, 4
#: Rounds of training; training tokens for which a task is started in a round; tokens of a block; step and damping.
ROUNDS, SHARE, BLOCK, STEP, DAMPING = 3, 1_000_000, 16_384, 0.5, 4.0
#: Tokens scored at a time.
SCORED = 4_096
#: The end as a token (no word can hold a line feed), and what stands before a text as a context.
END, BEFORE = "\n", HEAD + ENDINGS
#: Distinct tokens that a task sums up before it lets them go, and pieces in which tables travel.
HELD, PIECES = 250_000, 16

_LOG10 = float(np.log(10.0))


def _endings(words: pa.Array) -> np.ndarray:
    """Class of each word by its last letter or digit; marks after it are skipped, two at most."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)
    last = edges[1:] - 1
    letter = np.arange(256) >= 0x80
    for a, b in (("0", "9"), ("a", "z")):
        letter[ord(a) : ord(b) + 1] = True
    at = last.copy()
    for back in (2, 1, 0):
        place = np.maximum(last - back, edges[:-1])
        at = np.where(letter[raw[place]], place, at)
    return (raw[at] & 31).astype(np.int64)


# -- counts ---------------------------------------------------------------


def _counts(batches):
    """(token, ending, count) of the batches' tokens, ends included, summed up within the task."""
    held: list[pa.Table] = []
    size = 0

    def merged():
        out = pa.concat_tables(held).group_by("token").aggregate([("count", "sum")])
        return pa.table({"token": out.column("token"), "count": out.column("count_sum")})

    def given(table):
        words = table.column("token").combine_chunks()
        ending = pa.array(_endings(words), pa.int32())
        return pa.table({"token": words.cast(pa.string()), "ending": ending, "count": table.column("count")}).to_batches()

    for batch in batches:
        for piece in pieces(batch, "text", 3_000_000):
            words, sizes = split(piece.column("text"), SPACED)
            found = pc.value_counts(words)
            held.append(pa.table({"token": found.field("values"), "count": found.field("counts")}))
            held.append(pa.table({"token": pa.array([END], pa.large_string()), "count": pa.array([len(sizes)], pa.int64())}))
            size += len(found)
            if size > 2 * HELD:
                held = [merged()]
                size = held[0].num_rows
                if size > HELD:
                    yield from given(held.pop())
                    size = 0
    if held:
        yield from given(merged())


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, ending, count) of all tokens of ``text``; the end is a line feed."""
    return texts.select("text").mapInArrow(_counts, "token string, ending int, count long").groupBy("token", "ending").agg(F.sum("count").alias("count"))


# -- the model ------------------------------------------------------------


@dataclass
class Model:
    """Counts, biases and weights; ``counts`` is the table of all training tokens."""

    tokens: int
    distinct: int
    listed: pa.Array
    count: np.ndarray
    end_count: int
    mass: np.ndarray
    bias: np.ndarray
    inner_bias: np.ndarray
    counts: DataFrame | None = None
    weights: list[np.ndarray] = field(default_factory=lambda: [np.zeros((ROWS, CLASSES), np.float32), np.zeros((INNER, WORDS), np.float32)])
    seen: list[np.ndarray] = field(default_factory=lambda: [np.zeros(ROWS), np.zeros(INNER)])

    def sent(self) -> Model:
        """What tasks need of it."""
        return Model(**{**self.__dict__, "counts": None})

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(id, place in the list or -1) of words; an id is that of a head token, or HEAD and the ending's class."""
        place = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        head = (place >= 0) & (place < HEAD - 1)
        return np.where(head, place + 1, HEAD + _endings(words)), place


def _contexts(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens with an end, which is token 0, after each text; feature rows of each)."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.zeros(len(ids) + len(sizes), np.int64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = ids
    place = np.arange(len(out)) - np.repeat(ends - sizes, sizes + 1)
    before = []
    for back in (1, 2, 3):
        shifted = np.full(len(out), BEFORE, np.int64)
        shifted[back:] = out[:-back] if back < len(out) else shifted[back:]
        before.append(np.where(place >= back, shifted, BEFORE))
    one, two, three = before
    keys = np.stack([one, two + (1 << 12), three + (2 << 12), (one << 12) + two + (3 << 24)], axis=1)
    return out, mix(keys.astype(np.uint64))


def _rows(hashes: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    if classes is None:
        return (hashes >> np.uint64(40)).astype(np.uint16) & np.uint16(ROWS - 1)
    return (mix(hashes ^ (classes.astype(np.uint64) << np.uint64(50))[:, None]) >> np.uint64(40)).astype(np.uint16) & np.uint16(INNER - 1)


def _chances(bias: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of a softmax whose inputs are the bias and the active rows."""
    s = bias + table[rows[:, 0]]
    for f in range(1, FEATURES):
        s += table[rows[:, f]]
    s -= s.max(axis=1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=1, keepdims=True)
    return s


def _steps(p: np.ndarray, target: np.ndarray, rows: np.ndarray, table: np.ndarray, expected: np.ndarray, seen: np.ndarray) -> None:
    """One gradient step for a block, in place: observed less expected, over the expected so far."""
    width = table.shape[1]
    for f in range(FEATURES):
        row = rows[:, f]
        order = np.argsort(row, kind="stable")
        ordered = row[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        active = ordered[first]
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
        e = np.add.reduceat(p[order], first, axis=0)
        o = np.bincount(which * width + target[order], minlength=len(first) * width).reshape(-1, width)
        expected[active] += e
        table[active] += np.clip(STEP * (o - e) / (expected[active] + DAMPING), -1, 1).astype(np.float32)
        seen[active] += np.diff(np.append(first, len(row)))


def _blocks(ids: np.ndarray, sizes: np.ndarray, size: int):
    """(first token, tokens, hashes) of blocks of all texts' tokens."""
    tokens, hashes = _contexts(ids, sizes)
    for at in range(0, len(tokens), size):
        yield at, tokens[at : at + size], hashes[at : at + size]


def _split_ids(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, whether it is a head class) of tokens."""
    head = tokens < HEAD
    return np.where(head, tokens // WORDS, HEAD // WORDS + tokens - HEAD), head


def _trained(model: Model):
    """Function of a task: batches of texts to what changed in the weights, in pieces."""

    def run(batches):
        tables = [w.copy() for w in model.weights]
        seen = [np.zeros(len(w)) for w in tables]
        shares = [np.exp(model.bias) / np.exp(model.bias).sum(), np.full(WORDS, 1 / WORDS)]
        expected = [(s[:, None] * share[None, :]).astype(np.float32) for s, share in zip(model.seen, shares, strict=True)]
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, sizes = split(piece.column("text"), SPACED)
                for _, tokens, hashes in _blocks(model.ids(words)[0], sizes, BLOCK):
                    classes, head = _split_ids(tokens)
                    rows = _rows(hashes)
                    _steps(_chances(model.bias, tables[0], rows), classes, rows, tables[0], expected[0], seen[0])
                    if head.any():
                        rows = _rows(hashes[head], classes[head])
                        p = _chances(model.inner_bias[classes[head]], tables[1], rows)
                        _steps(p, tokens[head] % WORDS, rows, tables[1], expected[1], seen[1])
        if not any(s.any() for s in seen):
            return
        for k, (new, old, n) in enumerate(zip(tables, model.weights, seen, strict=True)):
            changed = ((new - old) * n[:, None]).astype(np.float32)
            for i, (c, s, q) in enumerate(zip(np.split(changed, PIECES), np.split(n, PIECES), np.split(n * n, PIECES), strict=True)):
                yield _piece(k * PIECES + i, c, s, q)

    return run


_PIECE = "piece int, changed binary, seen binary, squares binary"


def _piece(piece: int, changed: np.ndarray, seen: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    values = [changed.astype(np.float32).tobytes(), seen.astype(np.float64).tobytes(), squares.astype(np.float64).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=["piece", "changed", "seen", "squares"])


def _added(batches):
    """Sums the pieces that a partition gets; memory is that of the tables, however many come."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            values = [np.frombuffer(row["changed"], np.float32).astype(np.float64), np.frombuffer(row["seen"]).copy(), np.frombuffer(row["squares"]).copy()]
            held = sums.setdefault(row["piece"], values)
            if held is not values:
                for a, b in zip(held, values, strict=True):
                    a += b
    for piece, values in sums.items():
        yield _piece(piece, *values)


def _updated(model: Model, texts: DataFrame, tasks: int) -> Model:
    """The model after a round over ``texts``."""
    gone = texts.coalesce(tasks).select("text").mapInArrow(_trained(model.sent()), _PIECE)
    dealt = gone.withColumn("_deal", F.pmod(F.spark_partition_id(), F.lit(16))).repartition(4 * PIECES, "piece", "_deal").drop("_deal")
    sums = dealt.mapInArrow(_added, _PIECE).repartition(2 * PIECES, "piece").mapInArrow(_added, _PIECE)
    weights, seen = [w.copy() for w in model.weights], [s.copy() for s in model.seen]
    for row in sums.collect():
        k, i = divmod(row["piece"], PIECES)
        height = len(weights[k]) // PIECES
        at = slice(i * height, (i + 1) * height)
        n = np.frombuffer(row["seen"])
        changed = np.frombuffer(row["changed"], np.float32).reshape(height, -1)
        weights[k][at] += np.where(n[:, None] > 0, changed / np.maximum(n, 1)[:, None], 0).astype(np.float32)
        seen[k][at] += np.frombuffer(row["squares"]) / np.maximum(n, 1)
    return Model(**{**model.__dict__, "weights": weights, "seen": seen})


def _commonest(counts: DataFrame) -> pd.DataFrame:
    """The commonest tokens, LISTED at most, in order: those whose count is at least some sixteenth power of two.

    The bound comes from a histogram of that many steps, so the driver gets a
    few hundred rows and then the list, and nothing is sorted.
    """
    step = F.floor(F.log2("count") * 16).cast("int").alias("step")
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(step).count().collect()), reverse=True)
    size, least = 0, None
    for s, n in steps:
        size += n
        if size > LISTED:
            break
        least = s
    if least is None:
        return pd.DataFrame({"token": [], "ending": [], "count": []})
    rows = counts.where(F.floor(F.log2("count") * 16) >= least).select("token", "ending", "count").toPandas()
    return rows.sort_values(["count", "token"], ascending=[False, True], ignore_index=True)


def fit(docs: DataFrame, held_out: Column | None = None, rounds: int = ROUNDS) -> Model:
    """Counts and weights from all documents (doc_id, text) that aren't held out."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.lit(False) if held_out is None else held_out).alias("_out"))
    known = known.where(~F.col("_out"))
    counts = cut(token_counts(known), tokens=F.sum("count"))
    n, v = int(total(counts, "tokens") or 0), int(total(counts) or 0)
    top = _commonest(counts.where(F.col("token") != END))
    ends = counts.where(F.col("token") == END).select("count").collect()
    end_count = int(ends[0][0]) if ends else 0
    by_ending = counts.where(F.col("token") != END).groupBy("ending").agg(F.sum("count").alias("count"), F.count("*").alias("tokens")).collect()
    count = top["count"].to_numpy(np.int64)
    head = np.concatenate(([end_count], count[: HEAD - 1], np.zeros(max(HEAD - 1 - len(count), 0)))).astype(np.float64)
    mass = np.full(ENDINGS, 0.5)
    for row in by_ending:
        mass[row["ending"]] += row["count"] + 0.5 * row["tokens"]
    for ending, c in zip(top["ending"][: HEAD - 1], count[: HEAD - 1], strict=True):
        mass[ending] -= c + 0.5
    mass = np.maximum(mass, 0.5)
    there = np.arange(HEAD) < 1 + len(count)
    inner = np.where(there, np.log(head + 0.5), -np.inf).reshape(-1, WORDS)
    inner[~np.isfinite(inner).any(axis=1)] = 0.0
    classes = np.concatenate([np.where(there, head + 0.5, 0).reshape(-1, WORDS).sum(axis=1), mass])
    with np.errstate(divide="ignore"):
        bias = np.where(classes > 0, np.log(classes), -np.inf)
    model = Model(n, v, pa.array(top["token"].tolist(), pa.large_string()), count, end_count, mass, (bias - bias.max()).astype(np.float32), inner.astype(np.float32), counts)
    tasks = max(1, round(n / rounds / SHARE))
    for r in range(rounds):
        model = _updated(model, known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r), tasks)
    return model


# -- scores ---------------------------------------------------------------

_SCORED = "_key long, doc_id long, n_tokens long, n_known long, base_score double, score double, n_rest long, rest array<struct<token:string,n:int>>"


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    total_ = np.concatenate(([0.0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total_[ends] - total_[ends - sizes]


def log_chances(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of every token's probability, ends included; for tokens outside the head without the part that depends on their own count."""
    out = np.zeros(len(ids) + len(sizes))
    for at, tokens, hashes in _blocks(ids, sizes, SCORED):
        classes, head = _split_ids(tokens)
        p = _chances(model.bias, model.weights[0], _rows(hashes))
        found = np.log(np.maximum(p[np.arange(len(tokens)), classes], 1e-30).astype(np.float64))
        if head.any():
            q = _chances(model.inner_bias[classes[head]], model.weights[1], _rows(hashes[head], classes[head]))
            found[head] += np.log(np.maximum(q[np.arange(len(q)), tokens[head] % WORDS], 1e-30).astype(np.float64))
        found[~head] -= np.log(model.mass[tokens[~head] - HEAD])
        out[at : at + len(tokens)] = found / _LOG10
    return out


def _scores(model: Model):
    def run(batches):
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 40
        scale = np.log10(model.tokens + 0.5 * (model.distinct + 1))
        listed = np.log10(np.append(model.count, 0) + 0.5)
        end = np.log10(model.end_count + 0.5)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, sizes = split(piece.column("text"), SPACED)
                ids, place = model.ids(words)
                found = _summed(log_chances(model, ids, sizes), sizes + 1)
                own = np.where(place >= 0, listed[place], 0.0)
                base = _summed(own, sizes) + end - (sizes + 1) * scale
                score = found + _summed(np.where(place >= HEAD - 1, own, 0.0), sizes)
                rest = place < 0
                n_rest = _summed(rest.astype(np.float64), sizes).astype(np.int64)
                names = words.filter(pa.array(rest)).dictionary_encode()
                size = max(len(names.dictionary), 1)
                in_doc, times = np.unique(
                    np.repeat(np.arange(len(sizes)), n_rest) * size + names.indices.to_numpy(zero_copy_only=False), return_counts=True
                )
                edges = np.concatenate(([0], np.cumsum(np.bincount(in_doc // size, minlength=len(sizes)))))
                tail = pa.StructArray.from_arrays(
                    [names.dictionary.take(pa.array(in_doc % size)).cast(pa.string()), pa.array(times.astype(np.int32))], ["token", "n"]
                )
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(key, key + len(sizes))), piece.column("doc_id"), pa.array(sizes + 1),
                    pa.array(sizes - n_rest + (model.end_count > 0)), pa.array(base), pa.array(score), pa.array(n_rest),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), tail),
                ], names=["_key", "doc_id", "n_tokens", "n_known", "base_score", "score", "n_rest", "rest"])
                key += len(sizes)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = cut(texts.mapInArrow(_scores(model.sent()), _SCORED))
    rest = scored.where("n_rest > 0").select("_key", F.inline("rest"))
    joined = rest.join(model.counts.select("token", "count"), "token", "left")
    c = F.coalesce(F.col("count"), F.lit(0))
    more = joined.groupBy("_key").agg(
        F.sum(F.col("n") * F.log10(c + F.lit(0.5))).alias("_more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).cast("long").alias("_known")
    )
    added = F.coalesce(F.col("_more"), F.lit(0.0))
    return scored.drop("rest", "n_rest").join(more, "_key", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce(F.col("_known"), F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + added).alias("base_score"), (F.col("score") + added).alias("score"),
    )

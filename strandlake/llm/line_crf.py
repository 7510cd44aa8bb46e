"""Document quality from a linear-chain conditional random field over lines.

Every line that has a word is a node with two states, good and bad. Its unary
potential is linear in the line's own features and those of the lines before
and after it; a 2 x 2 matrix scores neighbouring states. Forward-backward gives
each line's marginal of being bad, the document's badness is the mean of these
weighted by the lines' lengths, and a logistic curve fitted on the training
documents turns it into the score.

Labels are of documents, so training starts from every line carrying its
document's label; then lines of bad documents that the model takes for good are
relabelled (never all of a document) and the field is fitted again.

Features are computed for all lines of a batch at once from byte classes and
word hashes; lines are whole, however long, and long texts go through in parts of
whole lines. Null texts and texts without words score 0. Repeated rows, and rows
of a null id, get the same score each; nothing is learnt from a null id or from
one labelled both ways. Without labels of both classes every text scores 0. A
column named like a result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from strandlake.llm.flat import Flat, appended

_U = np.uint64

# Byte classes. Upper, lower, digit, symbol as in `[#*$%&|<>]`, exclamation and question, full stop and comma, other punctuation, non-ASCII
_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?", b".,",
    b"\"'()+-/:;=@[\\]^_`{}~", bytes(range(128, 256)),
]
_CLASS_OF = np.zeros(256, dtype=np.uint8)
for _k, _members in enumerate(_CLASSES):
    for _b in _members:
        _CLASS_OF[_b] = _k + 1

#: Characters of a text from which its lines go through in parts.
PART = 1_500_000
_WORD = re.compile("[^\x20\x09-\x0D]")
#: Training: lines of at most this many documents of each class and characters in total.
TRAIN_PER_CLASS, TRAIN_CHARS = 1500, 4_000_000


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, length in bytes, own features) of every line with a word."""
    flat = Flat(texts)
    data = flat.bytes
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ends)
    line_of_word = np.searchsorted(ends, flat.starts, "left")
    words = np.bincount(line_of_word, minlength=n)
    kind = _CLASS_OF[data]
    # sums over the bytes of each line; a line's newline is in no class
    shares = [np.add.reduceat(kind == k, starts, dtype=np.int32) if n else np.zeros(0) for k in range(1, len(_CLASSES) + 1)]
    counts = np.stack(shares, axis=1).astype(float)
    size = ends - starts
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 7] / 2, 1)
    # repeated words of a line, and words that equal the one before
    value = flat.hashes()
    key = (line_of_word.astype(_U) << _U(40)) | (value >> _U(24))
    ordered = np.sort(key)
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    distinct = np.bincount((ordered[first] >> _U(40)).astype(np.int64), minlength=n) if len(key) else np.zeros(n)
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    twice = np.bincount(line_of_word, weights=same, minlength=n)
    # last byte of words in a symbol or exclamation mark, and words of one byte that is a symbol
    tail = kind[np.maximum(flat.ends - 1, 0)]
    marked = np.bincount(line_of_word, weights=(tail == 4) | (tail == 5), minlength=n)
    span = np.bincount(line_of_word, weights=flat.ends - flat.starts, minlength=n)
    keep = words > 0
    w = np.maximum(words, 1)
    head = np.zeros(n, dtype=np.int64)
    opening = np.flatnonzero(np.diff(line_of_word, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    head[line_of_word[opening]] = kind[flat.starts[opening]]
    doc = np.searchsorted(flat.begin, starts, "right") - 1
    # lines equal to the line before
    sums = np.zeros(n, dtype=_U)
    if len(key):
        at = np.arange(len(value)).astype(_U)
        np.add.at(sums, line_of_word, value * (at - np.repeat(at[opening], np.diff([*opening, len(value)])) + _U(1)))
    echo = np.zeros(n)
    echo[1:] = (sums[1:] == sums[:-1]) & (doc[1:] == doc[:-1]) & (words[1:] > 0)
    own = np.column_stack((
        np.log1p(size) / 5, np.log1p(words) / 4, counts[:, 0] / letters, counts[:, 2] / np.maximum(size, 1),
        np.sqrt(counts[:, 3] / np.maximum(size, 1)), np.sqrt(counts[:, 4] / np.maximum(size, 1)),
        counts[:, 5] / w, counts[:, 6] / np.maximum(size, 1), 1 - distinct / w, twice / w, marked / w,
        np.minimum(span / w, 30) / 10, head == 1, kind[np.maximum(ends - 1, 0)] == 6, echo, words <= 3,
    )).astype(np.float64)
    return doc[keep], size[keep], own[keep]


def with_neighbours(doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zeros at the ends), and a bias."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        joined = (doc[1:] == doc[:-1])[:, None]
        before[1:] = own[:-1] * joined
        after[:-1] = own[1:] * joined
    return np.column_stack((np.ones(len(own)), own, before, after))


def _grid(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of documents by lines, descending; step; lane) of each line."""
    ids, start, counts = np.unique(doc, return_index=True, return_counts=True)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(ids))
    step = np.arange(len(doc)) - np.repeat(start, counts)
    return np.sort(counts)[::-1], step, np.repeat(rank, counts)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def forward_backward(unary: np.ndarray, trans: np.ndarray, doc: np.ndarray):
    """Marginals (lines, 2), expected transitions (2, 2) and the sum of log Z.

    ``unary`` (lines, 2), lines of a document adjacent. All documents move in
    step; ones that have ended drop out.
    """
    counts, step, lane = _grid(doc)
    where = np.lexsort((lane, step))
    live = np.bincount(step)
    cut = np.concatenate(([0], np.cumsum(live)))
    pad, alpha = unary[where], np.empty_like(unary)
    alpha[: live[0]] = pad[: live[0]]
    for t in range(1, len(live)):
        k, now = live[t], slice(cut[t], cut[t + 1])
        alpha[now] = _lse(alpha[cut[t - 1] : cut[t - 1] + k, :, None] + trans[None], 1) + pad[now]
    total = np.zeros(len(counts))
    marginal = np.empty_like(unary)
    moves = np.zeros((2, 2))
    last = np.zeros((0, 2))
    for t in range(len(live) - 1, -1, -1):
        now, beta = slice(cut[t], cut[t + 1]), np.zeros((live[t], 2))
        ended = len(last)
        if ended:
            ahead = pad[cut[t + 1] : cut[t + 2]] + last
            beta[:ended] = _lse(trans[None] + ahead[:, None, :], 2)
        joint = alpha[now] + beta
        z = _lse(joint, 1)
        total[: live[t]] = z
        marginal[where[now]] = np.exp(joint - z[:, None])
        if ended:
            moves += np.exp(alpha[now][:ended, :, None] + trans[None] + ahead[:, None, :] - z[:ended, None, None]).sum(axis=0)
        last = beta
    return marginal, moves, float(total.sum())


class LineField:
    """Weights of the field and of the document curve."""

    def __init__(self):
        self.weights: np.ndarray | None = None
        self.trans = np.zeros((2, 2))
        self.mean = self.scale = None
        self.curve = (0.0, 0.0)

    def _unary(self, x: np.ndarray) -> np.ndarray:
        bad = ((x - self.mean) / self.scale) @ self.weights
        return np.column_stack((-bad / 2, bad / 2))

    def fit(self, texts: list[str], good: np.ndarray, steps: int = 80, rounds: int = 2, ridge: float = 1e-3) -> LineField:
        doc, size, own = line_features(texts)
        if not len(doc) or len(set(good)) < 2:
            return self
        x = with_neighbours(doc, own)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.mean[0], self.scale[self.scale < 1e-6] = 0, 1
        z = (x - self.mean) / self.scale
        bad = 1 - np.asarray(good)[doc]
        gold = bad.copy()
        # classes weigh the same, and the lines of a long document less than those of a short one
        each = 1 / np.sqrt(np.bincount(doc, minlength=len(texts))[doc])
        weight = np.array([each.sum() / max(2 * each[bad == k].sum(), 1e-9) for k in (0, 1)])[bad] * each * len(doc) / each.sum()
        self.weights = np.zeros(x.shape[1])
        for again in range(rounds + 1):
            m = [np.zeros_like(self.weights), np.zeros((2, 2))]
            v = [np.zeros_like(self.weights), np.zeros((2, 2))]
            follow = doc[1:] == doc[:-1]
            seen = np.zeros((2, 2))
            np.add.at(seen, (gold[:-1][follow], gold[1:][follow]), 1)
            for t in range(1, steps + 1):
                marginal, moves, _ = forward_backward(self._unary(x), self.trans, doc)
                error = (gold - marginal[:, 1]) * weight
                grads = (z.T @ error / len(doc) - ridge * self.weights, (seen - moves) / len(doc) - ridge * self.trans)
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    step = 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
                    if k:
                        self.trans = self.trans + step
                    else:
                        self.weights = self.weights + step
            marginal = forward_backward(self._unary(x), self.trans, doc)[0][:, 1]
            if again < rounds:
                top = np.zeros(len(texts))
                np.maximum.at(top, doc, marginal)
                gold = ((bad == 1) & ((marginal > 0.5) | (marginal >= top[doc]))).astype(bad.dtype)
        self._fit_curve(self._badness(doc, size, marginal, len(texts)), np.asarray(good))
        return self

    @staticmethod
    def _badness(doc: np.ndarray, size: np.ndarray, marginal: np.ndarray, n: int) -> np.ndarray:
        weight = np.bincount(doc, weights=size, minlength=n)
        return np.bincount(doc, weights=size * marginal, minlength=n) / np.maximum(weight, 1)

    def _fit_curve(self, badness: np.ndarray, good: np.ndarray) -> None:
        """Logistic regression of the label on badness, by Newton's method with a small ridge."""
        x = np.column_stack((np.ones(len(badness)), badness))
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            w = w + np.clip(np.linalg.solve(hess, x.T @ (good - p) - 1e-2 * w), -4, 4)
        self.curve = (float(w[0]), float(w[1]))

    def _lines(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, length, unary potentials) of every line with a word.

        A long text goes through in parts of whole lines. A part also sees the
        two lines with words before it and the one after, so features come out
        as they do for the whole text.
        """
        if len(texts) > 1 or len(texts[0] or "") <= PART:
            doc, size, own = line_features(texts)
            return doc, size, self._unary(with_neighbours(doc, own)) if len(doc) else np.zeros((0, 2))
        lines = texts[0].split("\n")
        worded = [i for i, x in enumerate(lines) if _WORD.search(x)]
        sizes, unary, a = [], [], 0
        while a < len(worded):
            b, chars = a, 0
            while b < len(worded) and (b == a or chars + len(lines[worded[b]]) <= PART):
                chars += len(lines[worded[b]])
                b += 1
            lead = min(a, 2)
            first = max(worded[a - lead] - 1, 0)
            _, size, own = line_features(["\n".join(lines[first : worded[min(b, len(worded) - 1)] + 1])])
            part = self._unary(with_neighbours(np.zeros(len(own), dtype=np.int64), own))
            lead = len(own) - (b - a) - (b < len(worded))
            sizes.append(size[lead : lead + b - a])
            unary.append(part[lead : lead + b - a])
            a = b
        if not sizes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2))
        size = np.concatenate(sizes)
        return np.zeros(len(size), dtype=np.int64), size, np.concatenate(unary)

    def score(self, texts: list) -> tuple[np.ndarray, list[np.ndarray]]:
        """Score of each text and the marginals of its lines being bad."""
        if self.weights is None:
            return np.zeros(len(texts)), [np.zeros(0)] * len(texts)
        out = np.zeros(len(texts))
        long = [i for i, t in enumerate(texts) if t is not None and len(t) > PART]
        if long and len(texts) > 1:
            marginals = [np.zeros(0)] * len(texts)
            for chosen in ([i for i in range(len(texts)) if i not in set(long)], *([i] for i in long)):
                some, lines = self.score([texts[i] for i in chosen]) if chosen else ((), ())
                for i, x, m in zip(chosen, some, lines, strict=True):
                    out[i], marginals[i] = x, m
            return out, marginals
        doc, size, unary = self._lines(texts) if texts else (np.zeros(0), None, None)
        if not len(doc):
            return out, [np.zeros(0)] * len(texts)
        marginal = forward_backward(unary, self.trans, doc)[0][:, 1]
        badness = self._badness(doc, size, marginal, len(texts))
        out = 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * badness, -30, 30)))
        out[np.bincount(doc, minlength=len(texts)) == 0] = 0
        return out, np.split(marginal, np.searchsorted(doc, np.arange(1, len(texts))))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> LineField:
    """Learn from labelled documents outside the held-out fold (a bounded sample, see the constants)."""
    from strandlake.llm.sampling import training_rows

    rows = training_rows(docs, labels, "quality", modulus, held_out, TRAIN_PER_CLASS, TRAIN_CHARS)
    return LineField().fit(list(rows["text"]), rows["label"].to_numpy(dtype=np.int64))


def classify(docs: DataFrame, model: LineField, lines: bool = False, keep_text: bool = False) -> DataFrame:
    """Adds score (and bad_lines) to the columns of ``docs``; the text goes unless ``keep_text``.

    ``bad_lines`` holds the marginal of being bad of each line that has a word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        score, marginals = shared.value.score(texts)
        return {"score": score, "bad_lines": [m.tolist() for m in marginals] if lines else None}

    return appended(docs, "text", make, "score double" + ", bad_lines array<double>" * lines, drop=not keep_text)

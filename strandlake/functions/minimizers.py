"""Minimizers of reads, and pairs of reads that share a k-mer, a batch at a time.

The minimizer of a k-mer is the least of its M-mers, in an order without regard
to the alphabet. It depends on the k-mer alone, so reads that share a k-mer meet
at its minimizer. All windows of a batch are made together, over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bases of a minimizer.
M = 13
#: Odd, so the product is another order of the same numbers; none of up to 62 bits becomes NONE.
_ORDER, NONE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(2**64 - 1)
_DIGITS = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate("TGAC"):
    _DIGITS[ord(_c)] = _DIGITS[ord(_c.lower())] = _i
#: Candidates looked at together, and pairs returned together.
CANDIDATES, PAIRS = 1_000_000, 10_000


def _at(a: np.ndarray, by: int, fill) -> np.ndarray:
    """``a`` from ``by`` on, filled up to its size."""
    return np.concatenate([a[by:], np.full(min(by, len(a)), fill, a.dtype)])


def _codes(digits: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` digits that begin at each place; without meaning where fewer follow."""
    part, width, out, covered = digits.astype(np.uint64), 1, None, 0
    while True:
        if k & width:
            out = part if out is None else (out << np.uint64(2 * width)) | _at(part, covered, 0)
            covered += width
        if covered == k:
            return out
        part = (part << np.uint64(2 * width)) | _at(part, width, 0)
        width *= 2


def _least(a: np.ndarray, n: int) -> np.ndarray:
    """Least of the ``n`` values that begin at each place."""
    width = 1
    while 2 * width <= n:
        a, width = np.minimum(a, _at(a, width, NONE)), 2 * width
    return np.minimum(a, _at(a, n - width, NONE))


def _digits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digits of all letters, ends of the texts, number of bad letters before each place, text of each letter)."""
    texts = texts.cast(pa.binary())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    digits = _DIGITS[data]
    bad = np.concatenate([[0], np.cumsum(digits > 3)])
    return digits & 3, ends - ends[0], bad, np.repeat(np.arange(len(texts)), np.diff(ends))


def _clean(ends: np.ndarray, bad: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Whether a clean k-mer begins at each place."""
    at = np.arange(len(text))
    good = at + k <= ends[text + 1]
    good[good] = bad[at[good] + k] == bad[at[good]]
    return good


def words(texts: pa.Array, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, number) of all clean k-mers in order, for each size up to 31; the first base is the highest digit."""
    digits, ends, bad, text = _digits(texts)
    for k in sizes:
        good = np.flatnonzero(_clean(ends, bad, text, k))
        yield text[good], good - ends[text[good]], _codes(digits, k)[good].view(np.int64)


def kmers(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, k-mer's number, its minimizer) of all clean k-mers, in order."""
    digits, ends, bad, text = _digits(texts)
    low = _least(_codes(digits, M) * _ORDER, k - M + 1)
    good = np.flatnonzero(_clean(ends, bad, text, k))
    return text[good], good - ends[text[good]], (_codes(digits, k) * _ORDER)[good], low[good]


def minimizers(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, minimizer): each one that a clean k-mer of a text has, once."""
    text, _, _, low = kmers(texts, k)
    order = np.lexsort([low, text])
    text, low = text[order], low[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (low[1:] != low[:-1])
    return text[new], low[new].view(np.int64)


def _chunks(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose counts add up to about ``most``."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")), at + 1)
        yield at, to
        at = to


def _least_shared(tables: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number that rows ``a`` and ``b`` of the tables, each without repeats, have in common."""
    both = np.sort(np.concatenate([tables[a], tables[b]], axis=1), axis=1)
    same = np.where(both[:, 1:] == both[:, :-1], both[:, 1:], NONE)
    return same.min(axis=1)


def shared(ids: np.ndarray, texts: pa.Array, group: np.ndarray, low: np.ndarray, block: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) with ids[i] < ids[j] that share a k-mer, told at that of least number: over all groups each pair once.

    A row stands in group ``group`` for the k-mers whose minimizer is ``low``.
    Where ``own`` is false, only rows of unequal ``block`` are a pair.
    """
    text, place, number, least = kmers(texts, k)
    size = int(place.max(initial=-1)) + 1
    if not size:
        return
    wide = np.full((len(texts), size), NONE)
    wide[text, place] = number
    tables = np.sort(wide, axis=1)
    tables[:, 1:][tables[:, 1:] == tables[:, :-1]] = NONE
    here = least.view(np.int64) == low[text]
    text, place, number = text[here], place[here], number[here]
    order = np.lexsort([place, text, number, group[text]])
    text, place, number = text[order], place[order], number[order]
    run = np.ones(len(text), bool)
    run[1:] = (group[text[1:]] != group[text[:-1]]) | (number[1:] != number[:-1])
    first = run.copy()  # of a k-mer that a text repeats, the first
    first[1:] |= text[1:] != text[:-1]
    run = np.cumsum(run)[first]
    text, place, number = text[first], place[first], number[first]
    last = np.searchsorted(run, run, "right")
    after = last - np.arange(len(run)) - 1
    for lo, hi in _chunks(after, CANDIDATES):
        n = after[lo:hi]
        one = np.repeat(np.arange(lo, hi), n)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        a, b = text[one], text[two]
        keep = (ids[a] != ids[b]) & (own[a] | (block[a] != block[b]))
        one, two = one[keep], two[keep]
        # most are told by a lesser k-mer beside this one
        for by in (1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 6, -6, 8, -8, 11, -11, 15, -15):
            pa_, pb = place[one] + by, place[two] + by
            there = (pa_ >= 0) & (pb >= 0) & (pa_ < size) & (pb < size)
            x = wide[text[one], np.clip(pa_, 0, size - 1)]
            keep = ~(there & (x == wide[text[two], np.clip(pb, 0, size - 1)]) & (x < number[one]))
            one, two = one[keep], two[keep]
        for s in range(0, len(one), PAIRS):
            i, j = one[s : s + PAIRS], two[s : s + PAIRS]
            told = _least_shared(tables, text[i], text[j]) == number[i]
            a, b = text[i[told]], text[j[told]]
            swap = ids[a] > ids[b]
            yield np.where(swap, b, a), np.where(swap, a, b)

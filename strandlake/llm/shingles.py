"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

from strandlake.llm.flat import Flat, mix

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
#: Positions worked on at a time.
_BLOCK = 1 << 18


def distinct_shingles(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct ``width``-word shingles of each text, in order.

    Words are runs of non-space bytes with A-Z lower-cased. A text of fewer
    words, but not none, has its whole word sequence as one shingle.
    """
    flat = Flat(texts, lower=True)
    words, counts, owner = flat.hashes(), flat.words, flat.doc
    del flat
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    n = len(words)
    docs, values = [], []
    for a in range(0, n, _BLOCK):  # positions in blocks, so that what is needed beside the words stays small
        b = min(a + _BLOCK, n)
        doc = owner[a:b]
        at = np.arange(a, b)
        left = counts[doc] - (at - first[doc])
        value = np.zeros(b - a, dtype=_U)
        for k in range(width):
            there = left > k
            value[there] = mix(value[there] * _STEP + words[at[there] + k] + _U(k + 1))
        keep = (left >= width) | ((at == first[doc]) & (counts[doc] < width))
        docs.append(doc[keep])
        values.append(value[keep])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    del words, owner
    doc, value = np.concatenate(docs), np.concatenate(values)
    del docs, values
    if len(texts) == 1:
        value = np.unique(value)
        return np.zeros(len(value), dtype=np.int64), value
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]

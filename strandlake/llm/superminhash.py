"""SuperMinHash signatures (Ertl, 2017) for many texts at once.

Every element draws one permutation of the ``m`` components and one uniform
number per position; component ``p[j]`` gets rank ``j`` plus that number. The
ranks of one element are thus correlated, which lowers the variance of the
similarity estimate below that of independent hash functions. Components are
filled in order of rank, so a text stops as soon as its largest component is
below the next rank: a text of many elements looks at few positions of each.
"""

from __future__ import annotations

import numpy as np

from strandlake.llm.flat import mix

_U = np.uint64
#: Elements worked on at a time.
_BLOCK = 1 << 18


def signatures(doc: np.ndarray, value: np.ndarray, n: int, m: int) -> np.ndarray:
    """uint16 signatures (n, m) of the element hashes ``value``, sorted by ``doc``.

    Two texts agree in a component with a probability of their Jaccard
    similarity, but for chance agreements of 2^-16. Texts without elements get
    zeros.
    """
    best = np.full(n * m, np.inf)
    for a in range(0, len(value), _BLOCK):  # minima don't depend on the order, and what one block fills stops the next ones sooner
        _fill(best, doc[a : a + _BLOCK].astype(np.int64), value[a : a + _BLOCK], n, m)
    best[np.isinf(best)] = 0
    return (mix(best.view(_U)) >> _U(48)).astype(np.uint16).reshape(n, m)


def _fill(best: np.ndarray, who: np.ndarray, x: np.ndarray, n: int, m: int) -> None:
    """Lower the components ``best`` by the ranks of the elements ``x`` of the texts ``who``."""
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(x):
            break
        drawn = mix(x + _U((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = j + (drawn >> _U(12)) / float(1 << 52)
        other = mix(drawn ^ _U(0xA0761D6478BD642F))
        k = j + ((other >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int32)
        # the component at position k after the swaps of earlier ranks
        place = k.copy()
        for i in range(j - 1, -1, -1):
            place[place == swaps[i]] = i
        swaps = [*swaps, k]
        np.minimum.at(best, who * m + place, rank)
        largest = best.reshape(n, m).max(axis=1)
        stay = (largest > j + 1)[who]
        if not stay.all():
            who, x, swaps = who[stay], x[stay], [s[stay] for s in swaps]

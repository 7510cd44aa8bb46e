"""Texts of a batch as flat numpy arrays, so that work per byte or per word is
done by array operations instead of Python loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_U = np.uint64
#: Odd multiplier of the polynomial hash, its inverse modulo 2^64, and the mixing constants of splitmix64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


#: Bytes hashed at a time.
_RUN = 1 << 20

#: Every byte value has a random-looking 64-bit code.
_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x632BE59BD9B4E019))

#: bytes.split() and the space class of the contracts agree: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), dtype=_U)
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * _U(step)
        done += take
        step = step * step & (1 << 64) - 1
    return out


class Flat:
    """UTF-8 bytes of all texts, each followed by a newline, and the words in them.

    ``starts`` and ``ends`` are the byte ranges of words, ``doc`` the text each
    word belongs to, ``hash`` a 64-bit hash of each word. A null text has no
    words.
    """

    def __init__(self, texts: list, lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        blob = b"\n".join(raw) + b"\n"
        self.blob = blob.lower() if lower else blob
        self.bytes = np.frombuffer(self.blob, dtype=np.uint8)
        self.n = len(raw)
        self.sizes = np.fromiter((len(r) for r in raw), np.int64, self.n)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        gap = _SPACE[self.bytes]
        before = np.concatenate(([True], gap[:-1]))
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(gap & ~before)
        self.doc = np.searchsorted(self.begin, self.starts, "right") - 1
        self.words = np.bincount(self.doc, minlength=self.n) if self.n else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        """Polynomial hash of every word, independent of where it stands; words are taken in runs, so memory follows a run and not the text."""
        out = np.empty(len(self.starts), dtype=_U)
        first, n = 0, len(self.starts)
        while first < n:
            base = int(self.starts[first])
            last = max(int(np.searchsorted(self.ends, base + _RUN, "right")), first + 1)
            starts, ends = self.starts[first:last] - base, self.ends[first:last] - base
            if int(ends[-1]) > 2 * _RUN:  # one very long word
                out[first:last] = self._long(base, int(ends[-1]))
            else:
                run = self.bytes[base : base + int(ends[-1])]
                total = np.zeros(len(run) + 1, dtype=_U)
                np.cumsum(_CODES[run] * _powers(len(run), _BASE), out=total[1:])
                out[first:last] = (total[ends] - total[starts]) * _powers(len(run) + 1, _INVERSE)[starts]
            first = last
        return mix(out + (self.ends - self.starts).astype(_U))

    def _long(self, base: int, size: int):
        """The hash of one word before mixing, in runs of bytes."""
        total, scale = 0, 1
        step = pow(_BASE, _RUN, 1 << 64)
        for at in range(0, size, _RUN):
            run = self.bytes[base + at : base + min(at + _RUN, size)]
            total += scale * int(np.sum(_CODES[run] * _powers(len(run), _BASE), dtype=_U))
            scale = scale * step & (1 << 64) - 1
        return _U(total & (1 << 64) - 1)


def pieces(batch, column: str, chars: int = 1_500_000):
    """Cut an Arrow batch into slices whose strings hold about ``chars`` bytes,
    so that memory does not depend on how long texts are."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes.astype(np.int64)) // chars
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def appended(df: DataFrame, column: str, make, ddl: str, drop: bool = True) -> DataFrame:
    """Add the columns of ``ddl``, computed from a string column, to every row.

    ``make`` takes the list of strings (None for null) of a piece of a batch and
    returns a dict of columns; it runs in Python workers. Other columns pass
    through as Arrow data, so ids keep their exact values beside nulls; those
    with the name of a new one are replaced. With ``drop`` the string column
    itself is not returned.
    """
    new = T.StructType.fromDDL(ddl)
    kept = [f for f in df.schema.fields if not (drop and f.name == column) and f.name not in new.names]
    types = to_arrow_schema(new)
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column):
                made = make(piece.column(column).to_pylist())
                arrays = [piece.column(n) for n in names]
                arrays += [pa.array(made[f.name], type=f.type) for f in types]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *types.names])

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))

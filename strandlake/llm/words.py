"""Words of whole Arrow columns, cut by array operations.

Every byte goes through a table of 256 entries that lower-cases A-Z and turns
what separates words into spaces; bytes of other letters (0x80 and above) stay,
so UTF-8 remains UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _table(separators) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    out[list(separators)] = 0x20
    return out


#: Words are what stands between 0x20 and 0x09 to 0x0D.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Terms hold letters only: A-Z, a-z and whatever lies beyond ASCII.
LETTERS = _table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def split(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, number of words of each text); a null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    mapped = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(edges - edges[0]), pa.py_buffer(table[raw]))
    parts = pc.ascii_split_whitespace(mapped)
    words, row = parts.flatten(), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(words), 0)
    words, row = words.filter(there), row.filter(there)
    return words, np.bincount(row.to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)

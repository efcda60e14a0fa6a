"""Words of whole Arrow text columns as numpy arrays: spans and 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. Work runs in
blocks, so a giant text costs about ten bytes per word beside its own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_TABLES = np.random.default_rng(20240607).integers(0, 2**64, (64, 256), dtype=np.uint64)
_BLOCK = 1 << 17
SLICE_BYTES = 2 << 20


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after the other
    offsets: np.ndarray  # len(texts) + 1 places in data
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # len(texts) + 1 places in start: the words of text i are first[i]:first[i + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text; a longer text is a range of its own."""
    offsets = _parts(column)[1]
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(column: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """Word spans of every text; null counts as empty. ``lower`` turns A-Z into a-z. ``letters`` (with
    ``lower``) takes runs of letters, digits and bytes beyond ASCII for words, without the signs around."""
    data, offsets = _parts(column)
    if lower:
        data = LOWER[data]
    word = LETTER[data] if letters else ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = word.copy(), word.copy()
    if len(data):
        starts[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit tabulation hash of each span's bytes."""
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), _BLOCK):
        s, n = start[lo : lo + _BLOCK], (end - start)[lo : lo + _BLOCK]
        first = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(first, n)
        value = _TABLES[pos & 63, data[np.repeat(s, n) + pos]]
        if n.max(initial=0) > 64:
            value = value * ((pos >> 6) * 2 + 1).astype(np.uint64)
        out[lo : lo + _BLOCK] = np.add.reduceat(value, first) if len(first) else value
    return mix(out)


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (``len(h) - n + 1`` of them)."""
    m = max(len(h) - n + 1, 0)
    out = np.full(m, np.uint64(seed), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def split_bytes(column: pa.Array) -> np.ndarray:
    """The bytes that the places of ``split`` refer to, unchanged."""
    return _parts(column)[0]


def in_row_order(batch: pa.RecordBatch, lo: int, hi: int, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).slice(lo, hi - lo)

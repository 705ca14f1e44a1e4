"""Vectorised word work over Arrow string buffers.

A batch's UTF-8 bytes are handled as one numpy array: no Python object is
made per document or word. Batches are cut into pieces of bounded size, so
memory does not follow the batch size; a document larger than a piece makes a
piece of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}

# Bytes that belong to words; A-Z are lowered in FOLDED. 0 separates words.
FOLDED = np.zeros(256, np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    FOLDED[_c] = _c
for _c in range(0x41, 0x5B):
    FOLDED[_c] = _c + 32
SPACED = np.arange(256, dtype=np.uint8)
for _c in [0x00]:
    SPACED[_c] = 1
for _c in [0x20, *range(0x09, 0x0E)]:
    SPACED[_c] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _TABLES.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 4096)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > 1 << 25:  # one huge text: don't keep the table
            return up, down
        _TABLES["up"], _TABLES["down"] = up, down
    return _TABLES["up"], _TABLES["down"]


def give_back() -> None:
    """Returns freed memory to the system. Spark keeps its Python workers for
    later stages, and what they hold is missing there."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is an empty text."""
    if pa.types.is_large_string(col.type) or not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int32, len(col) + 1, col.offset * 4).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(col: pa.Array, limit: int = PIECE_BYTES, rows: int = 1000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each piece."""
    raw, off = string_bytes(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + rows)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of a piece.

    start, end: byte span; doc: row within the piece; first: index of each
    row's first word (rows + 1 entries); hash: 64 bits of the (mapped) bytes.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, table: np.ndarray = FOLDED, hashed: bool = True):
        rows = len(off) - 1
        mapped = table[raw]
        inside = mapped != 0
        n = len(raw)
        head = np.empty(n + 1, bool)
        tail = np.empty(n + 1, bool)
        if n:
            head[0], head[1:n], head[n] = inside[0], inside[1:] & ~inside[:-1], False
            tail[0], tail[1:n], tail[n] = False, inside[:-1] & ~inside[1:], inside[-1]
            cuts = off[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            head[cuts] = inside[cuts]
            tail[cuts] = inside[cuts - 1]
        else:
            head[:] = tail[:] = False
        self.mapped = mapped
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail)
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(rows), self.count)
        if hashed:
            up, down = _powers(n + 1)
            acc = np.zeros(n + 1, np.uint64)
            np.cumsum((mapped.astype(np.uint64) + np.uint64(1)) * up[:n], out=acc[1:])
            h = (acc[self.end] - acc[self.start]) * down[self.start]
            self.hash = mix(h ^ (self.end - self.start).astype(np.uint64) * np.uint64(_P))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every window of k words, by row; a row with
    fewer words, but not none, has one window of all of them."""
    h, n = words.hash, len(words.hash)
    acc = np.zeros(n, np.uint64)
    last = words.first[1:][words.doc] if n else np.zeros(0, np.int64)
    idx = np.arange(n)
    for j in range(k):
        m = max(n - j, 0)
        part = mix(h[j:] + np.uint64((j + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        ok = idx[:m] + j < last[:m]
        acc[:m] += np.where(ok, part, np.uint64(0))
    whole = idx + k <= last
    short = np.zeros(n, bool)
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    short[words.first[few]] = True
    use = whole | short
    return words.doc[use], mix(acc[use])

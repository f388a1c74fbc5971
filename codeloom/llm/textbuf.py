"""Whole texts as flat byte arrays.

Every text operator here receives Arrow batches, lays the UTF-8 bytes of a few
thousand texts side by side and works on all of them with numpy: no Python
object is made per word or per line.  A block is bounded by bytes, so memory
does not depend on the size of a partition; a single longer text is a block of
its own (texts are never cut).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
BLOCK_BYTES = 2 << 20

U64 = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and for each byte with A-Z lower-cased.
RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLDED = RAW[LOWER]
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
NONSPACE = ~_WS
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place on its copy)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for p in (_P, _P_INV):
        a = np.full(n + 1, p, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(BLOCK_BYTES, 1 << max(1, n - 1).bit_length()))


class Block:
    """Texts side by side: ``data`` (uint8), ``offs`` (len + 1 byte offsets), ``batch`` (their rows)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, batch: pa.RecordBatch | None = None):
        self.data, self.offs, self.batch = data, offs, batch
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def col(self, name: str) -> np.ndarray:
        return self.batch.column(self.batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``; first word of each text (n + 1)."""
        if self._words is None:
            self._words = spans(NONSPACE[self.data], self.offs)
        return self._words

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
        """A 64-bit fingerprint of each span (in order of their starts), with A-Z lower-cased if ``fold``."""
        out = np.empty(len(starts), dtype=np.uint64)
        i, table = 0, FOLDED if fold else RAW
        while i < len(starts):  # spans by where they start, so that scratch space follows the block and not one long text
            lo = int(starts[i])
            j = int(np.searchsorted(starts, lo + BLOCK_BYTES, side="right"))
            s, e = starts[i:j] - lo, ends[i:j] - lo
            n = int(e.max())
            pw, inv = powers(n)
            acc = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(table[self.data[lo : lo + n]] * pw[:n], out=acc[1:])
            out[i:j] = (acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64) * U64(0xA0761D6478BD642F)
            i = j
        return mix(out)

    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words()
        return self.hashes(starts, ends)

    def code_points(self) -> np.ndarray:
        """Running number of code points before each byte (n + 1)."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(LEADS[self.data], out=out[1:])
        return out


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross a text's border."""
    n = len(inside)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offs), dtype=np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    first[edge] = inside[edge]
    last[edge[1:] - 1] = inside[edge[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of ``\\n``-split lines (an empty text has one empty line); first line of each text (n + 1)."""
    breaks = np.flatnonzero(data == 10)
    at = np.searchsorted(breaks, offs)  # breaks before each text
    count = np.diff(at) + 1
    first = np.zeros(len(offs), dtype=np.int64)
    np.cumsum(count, out=first[1:])
    starts = np.empty(first[-1], dtype=np.int64)
    ends = np.empty(first[-1], dtype=np.int64)
    is_first = np.zeros(first[-1], dtype=bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(first[-1], dtype=bool)
    is_last[first[1:] - 1] = True
    starts[is_first] = offs[:-1]
    starts[~is_first] = breaks + 1
    ends[is_last] = offs[1:]
    ends[~is_last] = breaks
    return starts, ends, first


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``limit`` bytes (or one text), nulls as empty texts, rows in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        if arr.null_count:
            arr = pc.fill_null(arr, "" if not pa.types.is_binary(arr.type) else b"")
        wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
        _, obuf, dbuf = arr.buffers()
        offs = np.frombuffer(obuf, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        data = np.frombuffer(dbuf, dtype=np.uint8) if dbuf is not None else np.zeros(0, dtype=np.uint8)
        i, n = 0, len(arr)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            j = min(j, n)
            yield Block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], batch.slice(i, j - i))
            i = j


def block_of(texts: list[str | None]) -> Block:
    """For tests and for small driver-side texts."""
    return next(blocks(iter([pa.record_batch({"text": pa.array(texts, pa.string())})]), limit=1 << 40)) if texts else Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each run [first[i], first[i + 1])."""
    if values.dtype.kind == "f":  # each run on its own, so that a sum does not depend on its neighbours
        out = np.zeros(len(first) - 1)
        some = np.flatnonzero(first[1:] > first[:-1])
        if len(some):
            out[some] = np.add.reduceat(values[: first[-1]], first[:-1][some])
        return out
    acc = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[first[1:]] - acc[first[:-1]]


def trim() -> None:
    """Gives freed memory back to the system: workers are kept for other tasks and would hold on to what their largest block took."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


class Lookup:
    """Numbers to positions by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(1 << bits, np.uint64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several, the last stays
            self.keys[at[free]] = keys[todo[free]]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys):
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if it isn't there."""
        at = self._slot(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        out[wrong] = -1
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            s = self.slots[at]
            hit = (s >= 0) & (self.keys[at] == keys[wrong])
            out[wrong[hit]] = s[hit]
            more = (s >= 0) & ~hit
            wrong, at = wrong[more], at[more]
        return out


def map_texts(df, columns: list[str], each: Callable[[Block], pa.RecordBatch | None], schema: str, column: str = "text", limit: int = BLOCK_BYTES):
    """``each`` over blocks of ``df``; only ``columns`` leave the JVM."""

    def run(batches):
        for b in blocks(batches, column, limit):
            out = each(b)
            if out is not None and out.num_rows:
                yield out

    return df.select(*columns).mapInArrow(run, schema)

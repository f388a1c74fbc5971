"""LM scoring (operator 2): context-tree weighting over bytes.

A byte is eight binary decisions, and every decision has a tree over the bytes
before it.  A node's Krichevsky-Trofimov estimate codes what follows its
context; context-tree weighting mixes the estimates of all depths by how well
each coded the training texts.  What is coded is what the base score is about:
a text's words with A-Z lower-cased, one space between them, and its end.

The tree holds every context of the training texts, so it grows with the corpus
and never is in one place.  Blocks of text send their distinct (context, byte)
pairs, sorted and packed to about a byte each, to the part of the tree below
the last ``SPLIT`` bytes of the context.  The parts send the weights of their
roots to the driver, which holds the depths above ``SPLIT`` only; with those,
each part works out the probabilities of its pairs and answers in the order in
which it was asked.  Words of the base score are asked for and counted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import stage
from codeloom.llm.textbuf import BLOCK_BYTES, LOWER, NONSPACE, U64, Block, blocks, mix, sums, trim
from codeloom.llm.toxicity import held_out

DEPTH = 7
#: Depths below this are on the driver, whatever the corpus at most 256 ** (SPLIT - 1) contexts; those from it on are in parts by their last SPLIT bytes.
SPLIT = 3
#: None: every context is kept.  A number: only those that make up such a part of all bytes; what lies beneath a node without a node of its own is coded by one further leaf of that node.
CONTEXTS = None
#: Text (about) that asks together; pairs (about) that a part of the tree is asked for, and parts at most: beyond that many, a part answers in several tasks.
GROUP_BYTES, PART_PAIRS, MOST_PARTS = 8 << 20, 1 << 19, 4096
#: Pairs (about) of a part of the tree that are worked out at once: the trees below contexts of SPLIT bytes do not depend on each other.
SLICE_PAIRS = 1 << 16
END = 0xFF  # ends a text, and stands before its start; not a byte of UTF-8
_MASK = [U64((1 << 8 * d) - 1) for d in range(9)]
END_TOKEN = 0x1E35A7BD3C6EF372  # fingerprint of the end token


def folded(b: Block) -> Block:
    """The texts as they are coded: A-Z lower-cased, white space between words as one space, none around them."""
    starts, _, first = b.words()
    keep = NONSPACE[b.data]
    data = np.where(keep, LOWER[b.data], np.uint8(32))
    inner = np.ones(len(starts), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    keep[starts[inner] - 1] = True
    offs = np.concatenate([[0], np.cumsum(keep)])[b.offs]
    return Block(data[keep], offs, b.batch)


def _laid(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The texts with DEPTH ends before each and one after; where each begins in that (n + 1)."""
    begin = np.concatenate([[0], np.cumsum(np.diff(b.offs) + DEPTH + 1)])
    a = np.full(begin[-1], END, np.uint8)
    for i, (s, e) in enumerate(zip(b.offs[:-1].tolist(), b.offs[1:].tolist())):
        at = begin[i] + DEPTH
        a[at : at + e - s] = b.data[s:e]
    return a, begin


def _windows(a: np.ndarray) -> np.ndarray:
    """Key as of :func:`_turn` of each byte that has DEPTH bytes before it."""
    n = len(a) - DEPTH
    a = np.concatenate([np.zeros(7 - DEPTH, np.uint8), a, np.zeros(7, np.uint8)])
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        m = (n - r + 7) // 8
        out[r::8] = a[r : r + 8 * m].view("<u8")
    if DEPTH < 7:
        out &= ~_MASK[7 - DEPTH]
    high = out >> U64(56)  # the byte itself, last in memory; the one before it is next
    out <<= U64(8)
    out |= high
    return out


def turned(b: Block, most: int = 2 * BLOCK_BYTES):
    """Keys as of :func:`_turn` of every symbol of a block, and the first symbol of each text (n + 1); of a text longer than ``most``, a stretch at a time."""
    if len(b.data) <= most:
        a, begin = _laid(b)
        real = np.ones(len(a), bool)
        for j in range(DEPTH):
            real[begin[:-1] + j] = False
        yield _windows(a)[real[DEPTH:]], np.concatenate([[0], np.cumsum(np.diff(b.offs) + 1)])
        return
    a = np.concatenate([np.full(DEPTH, END, np.uint8), b.data, np.full(1, END, np.uint8)])
    for i in range(DEPTH, len(a), most):
        k = _windows(a[i - DEPTH : i + most])
        yield k, np.array([0, len(k)])


def pieces(b: Block, most: int = 2 * BLOCK_BYTES):
    """The same with the byte lowest, then the byte before it ..."""
    for keys, first in turned(b, most):
        yield (keys.byteswap() << U64(8)) | (keys & U64(255)), first


def contexts(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of every symbol as one number (byte lowest, then the byte before it ...); first symbol of each text (n + 1)."""
    return next(pieces(b, len(b.data)))


def _turn(keys: np.ndarray) -> np.ndarray:
    """Keys with the byte before first, then the one before that ..., the byte itself last: sorted, what shares a context is together at every depth."""
    return ((keys >> U64(8)) | (keys << U64(56))).byteswap()


def _distinct(a: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of parts of (sorted distinct keys, numbers), and their sums."""
    if len(parts) == 1:
        return parts[0]
    k = np.sort(np.concatenate([x for x, _ in parts])) if parts else np.zeros(0, np.uint64)
    k = k[_distinct(k)]
    n = np.zeros(len(k), np.int64)
    for x, m in parts:
        n[np.searchsorted(k, x)] += m
    return k, n


class Tally:
    """Distinct keys of many arrays and how often each occurs, with little beside them."""

    def __init__(self, most: int = 2 << 20):
        self.most, self.raw, self.held, self.parts = most, [], 0, []

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.held += len(keys)
        if self.held >= self.most:
            self._settle()

    def _settle(self) -> None:
        a = np.concatenate(self.raw) if self.raw else np.zeros(0, np.uint64)
        self.raw, self.held = [], 0
        a.sort()
        at = _distinct(a)
        self.parts.append((a[at], np.diff(np.append(at, len(a)))))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        return _merge(self.parts)


def pack(a: np.ndarray) -> bytes:
    """64-bit numbers plane by plane of their bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(z: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=U64(0)))


def unpack_sorted(z: bytes) -> np.ndarray:
    return np.cumsum(unpack(z), dtype=np.uint64)


def pack_logs(x: np.ndarray) -> bytes:
    """Logarithms to 14 binary digits."""
    bits = x.astype(np.float32).view(np.uint32)
    return pack((bits + np.uint32(1 << 9)) & np.uint32(0xFFFFFC00))


def unpack_logs(z: bytes) -> np.ndarray:
    return unpack(z).astype(np.uint32).view(np.float32).astype(float)


def _learnt(b: Block) -> np.ndarray:
    return ~b.batch.column(b.batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)


def _asks(texts: pa.Table, parts: int):
    """Of a block of texts: what it asks for of pairs and of words, as sorted distinct keys, times in training texts and part of each."""
    train, other = (Tally(), Tally()), (Tally(), Tally())
    for b in blocks(texts.to_batches()):
        learnt = _learnt(b)
        words, (_, _, wf) = b.word_hashes(), b.words()
        mine = np.repeat(learnt, np.diff(wf))
        train[1].add(words[mine])
        other[1].add(words[~mine])
        train[1].add(np.full(learnt.sum(), END_TOKEN, np.uint64))
        other[1].add(np.full(1, END_TOKEN, np.uint64))
        for keys, first in turned(folded(b)):
            mine = np.repeat(learnt, np.diff(first))
            train[0].add(keys[mine])
            other[0].add(keys[~mine])
    for kind in range(2):
        k, n = other[kind].result()
        k, n = _merge([train[kind].result(), (k, np.zeros(len(k), np.int64))])
        yield k, n, _part(k, kind, parts)


def _part(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """The part of the tree that a pair (kind 0) belongs to, or that of the vocabulary that a word (1) does."""
    return (mix(keys if kind else keys >> U64(64 - 8 * SPLIT)) % U64(parts)).astype(np.uint16) + np.uint16(kind * parts)


def _inverse(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    at = _distinct(sorted_)
    place = np.empty(len(keys), np.int32)
    place[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(keys))))
    return sorted_[at], place


def _ordered(part: np.ndarray):
    """An order by part, and for each part that occurs its stretch of that order."""
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    at = _distinct(sorted_)
    return order, list(zip(sorted_[at].tolist(), at.tolist(), np.append(at[1:], len(part)).tolist()))


_ASKED = "block long, part int, keys binary, ns binary"


def _ask(parts: int):
    def run(texts: pa.Table) -> pa.Table:
        rows = []
        for k, n, part in _asks(texts, parts):
            order, stretches = _ordered(part)
            k, n = k[order], n[order]
            rows += [(p, pack_sorted(k[i:j]), pack(n[i:j])) for p, i, j in stretches]
        block = texts.column("block")[0].as_py()
        del k, n, part, order
        trim()
        return pa.table([pa.array([block] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary())))], names=["block", "part", "keys", "ns"])

    return run


_GATHERED = "part int, keys binary, ns binary, distinct long, total long, blocks array<long>, asked array<binary>"


def _gather(rows: pa.Table) -> pa.Table:
    """One row of all that a part is asked for: its pairs with their times in training texts, and each block's keys."""
    part, keys = rows.column("part")[0].as_py(), rows.column("keys").to_pylist()
    held: list = []
    for z, n in zip(keys, rows.column("ns").to_pylist()):
        k, n = unpack_sorted(z), unpack(n).view(np.int64)
        held.append((k[n > 0], n[n > 0]))
        if len(held) > 1 and sum(len(x) for x, _ in held[1:]) > max(1 << 18, len(held[0][0])):
            held = [_merge(held)]
    k, n = _merge(held)
    del held
    trim()
    asked = "block" in rows.schema.names
    cols = [[part], [pack_sorted(k)], [pack(n)], [len(k)], [int(n.sum())], [rows.column("block").to_pylist() if asked else []], [keys if asked else []]]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _GATHERED.split(", ")])


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_SMALL = 1 << 16
_HALF, _WHOLE = lgamma(np.arange(_SMALL) + 0.5), lgamma(np.arange(_SMALL) + 1.0)


def _gamma(n: np.ndarray, more: float, table: np.ndarray) -> np.ndarray:
    if not len(n) or n.max() < _SMALL:
        return table[n]
    out = table[np.minimum(n, _SMALL - 1)]
    large = np.flatnonzero(n >= _SMALL)
    out[large] = lgamma(n[large] + more)
    return out


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _gamma(a, 0.5, _HALF) + _gamma(b, 0.5, _HALF) - _gamma(a + b, 1.0, _WHOLE) - 1.1447298858494002


def _rows(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _near(ctx: np.ndarray, d: int) -> np.ndarray:
    """Contexts of d bytes (the last byte lowest) as numbers with the last byte first."""
    return ctx.byteswap() >> U64(64 - 8 * d) if d else ctx & _MASK[0]


@dataclass
class Level:
    """Contexts of one depth and their binary nodes: ``node`` is context index * 256 + (1, then the bits so far)."""

    ctx: np.ndarray
    node: np.ndarray
    est: np.ndarray  # chance of a one by the node's own estimate
    split: np.ndarray  # weight of what is deeper
    leaf: np.ndarray  # chance of a one by the leaf for contexts without a node (where the context has deeper ones)
    above: np.ndarray  # contribution of the shallower depths, and the weight that is left
    left: np.ndarray
    parent: np.ndarray  # context index in the level before
    inner: np.ndarray  # has deeper contexts
    where: np.ndarray  # node of each bit (8) of each pair of context and byte
    upper: np.ndarray | None = None  # node of the level before with the same bits


class Model:
    def __init__(self, levels: list[Level], tables, top: Model | None = None):
        """``top``: a model of the depths above ``levels``."""
        self.levels = (top.levels if top else []) + levels
        #: For each depth: context * 256 + byte, and log10 probability of the bytes seen there.
        self.tables = (top.tables if top else []) + tables

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol (a key as of :func:`contexts`) after its context."""
        return self.log10_turned(_turn(keys))

    def log10_turned(self, keys: np.ndarray) -> np.ndarray:
        """The same of keys as of :func:`_turn`; fast where those are sorted."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        byte = keys & U64(255)
        slow = []
        for d in range(len(self.levels) - 1, -1, -1):
            c = keys[todo] >> U64(64 - 8 * d) if d else np.zeros(len(todo), np.uint64)
            ctx = _rows(self.levels[d].ctx, c)
            there = ctx >= 0
            at, ctx, c = todo[there], ctx[there], c[there]
            pair, log = self.tables[d]
            pos = _rows(pair, (c << U64(8)) | byte[at])
            hit = pos >= 0
            out[at[hit]] = log[pos[hit]]
            slow.append((at[~hit], d, ctx[~hit]))
            todo = todo[~there]
        for at, d, ctx in slow:
            if len(at):
                out[at] = self._unseen(d, ctx, byte[at])
        return out

    def _unseen(self, d: int, ctx: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """A byte that never followed its context: the same mixture, bit by bit over all depths."""
        path = [ctx]
        for lv in range(d, 0, -1):
            path.append(self.levels[lv].parent[path[-1]])
        path = path[::-1]
        out = np.zeros(len(ctx))
        byte = byte.astype(np.int64)
        for j in range(8):
            p, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            above, left = np.zeros(len(ctx)), np.ones(len(ctx))
            for u, c in enumerate(path):
                lv = self.levels[u]
                key = c * 256 + p
                at = np.minimum(np.searchsorted(lv.node, key), len(lv.node) - 1)
                seen = lv.node[at] == key
                est = np.where(seen, lv.est[at], 0.5)
                split = np.where(seen, lv.split[at], 0.5 * lv.inner[c])
                if u == d:
                    leaf = np.where(seen, lv.leaf[at], 0.5)
                    above += left * ((1 - split) * est + split * leaf)
                else:
                    above += left * (1 - split) * est
                    left = left * split
            out += np.log10(np.where(bit == 1, above, 1 - above))
        return out


def _binary(ctx: np.ndarray, byte: np.ndarray, n: np.ndarray):
    """Contexts; binary nodes (context index * 256 + bits so far), how many zeros and ones each counts, a pair of each; node of each bit of each pair (8, pairs)."""
    new = np.concatenate([[True], ctx[1:] != ctx[:-1]])
    idx = np.cumsum(new) - 1
    byte = byte.astype(np.int64)
    nodes, zeros, ones, firsts, where, held = [], [], [], [], np.empty((8, len(ctx)), np.int64), 0
    for j in range(8):
        key = idx * 256 + ((1 << j) | (byte >> (8 - j)))
        start = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(start)
        all_, set_ = np.add.reduceat(n, at), np.add.reduceat(n * ((byte >> (7 - j)) & 1), at)
        nodes.append(key[at])
        zeros.append(all_ - set_)
        ones.append(set_)
        firsts.append(at + j * len(ctx))
        where[j] = np.cumsum(start) + (held - 1)
        held += len(at)
    node = np.concatenate(nodes)
    if len(node) and node.max() < 1 << 32:  # sorting plain numbers is several times as fast
        order = np.sort((node << 31) | np.arange(len(node))) & ((1 << 31) - 1)
    else:
        order = np.argsort(node)
    place = np.empty(len(node), np.int64)
    place[order] = np.arange(len(node))
    return ctx[new], node[order], np.concatenate(zeros)[order], np.concatenate(ones)[order], np.concatenate(firsts)[order], place[where]


def _weigh(depths, above: np.ndarray | None = None, below=None, whole: bool = False) -> tuple[list[Level], tuple | None]:
    """Levels of ``depths`` without what comes from above them, and nodes, counts and log weights of the first.

    ``above``: contexts of the depth before.  ``below``: what the depth after
    adds, as this returns it.  ``whole``: deeper contexts cover every occurrence
    of a context that has any.
    """
    raw = []
    for x in depths:
        if not len(x[0]):
            break
        raw.append((_binary(*x[:3]), x[3] if len(x) > 3 else None))
    levels: list[Level] = [None] * len(raw)
    for d in range(len(raw) - 1, -1, -1):
        (ctx, node, n0, n1, pair, where), _ = raw[d]
        own = kt(n0, n1)
        inner = np.zeros(len(ctx), bool)
        none = np.zeros(len(node), np.int64)
        deep, o0, o1 = np.zeros(len(node)), none, none
        if below is not None:
            lower, bnode, b0, b1, weighted = below
            parent = np.searchsorted(ctx, lower >> U64(8))
            inner[parent] = True
            if d + 1 < len(raw) and raw[d + 1][1] is not None:
                bit, at = np.divmod(raw[d + 1][0][4], raw[d + 1][0][5].shape[1])
                at = where.ravel()[bit * where.shape[1] + raw[d + 1][1][at]]
            else:
                at = np.searchsorted(node, parent[bnode >> 8] * 256 + (bnode & 255))
            if d + 1 < len(raw):
                levels[d + 1].upper = at
            deep = np.bincount(at, weighted, len(node))
            if not whole:
                o0, o1 = n0 - np.bincount(at, b0, len(node)).astype(np.int64), n1 - np.bincount(at, b1, len(node)).astype(np.int64)
                deep += kt(o0, o1)
        has = inner[node >> 8]
        split = np.where(has, 1 / (1 + np.exp(np.minimum(own - deep, 700))), 0.0)
        total = np.where(has, deep - np.log(np.where(has, split, 1.0)) - np.log(2), own)
        before = raw[d - 1][0][0] if d else above
        up = np.zeros(len(ctx), np.int64) if before is None else np.searchsorted(before, ctx >> U64(8))
        levels[d] = Level(ctx, node, (n1 + 0.5) / (n0 + n1 + 1), split, (o1 + 0.5) / (o0 + o1 + 1), np.zeros(len(node)), np.ones(len(node)), up, inner, where)
        below = (ctx, node, n0, n1, total)
    return levels, below


def build(depths: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """From (context, byte, count) of each depth, the context's last byte lowest; every context's shorter ones are there."""
    out = []
    for d, (ctx, byte, n) in enumerate(depths):
        k = (_near(ctx, d) << U64(8)) | byte
        order = np.argsort(k)
        out.append((k[order] >> U64(8), byte[order], n[order]))
    return _build(out)


def _build(depths, top: Model | None = None, below=None, whole: bool = False) -> Model:
    """From (context, byte, count) of each depth, sorted, the context's last byte first; ``top``: a model of the depths above."""
    levels, _ = _weigh(depths, top.levels[-1].ctx if top else None, below, whole)
    tables = []
    for d, lv in enumerate(levels):
        before = levels[d - 1] if d else top.levels[-1] if top else None
        if before is not None:
            at = lv.upper
            if at is None:
                at = np.searchsorted(before.node, lv.parent[lv.node >> 8] * 256 + (lv.node & 255))
            lv.above = before.above[at] + before.left[at] * (1 - before.split[at]) * before.est[at]
            lv.left = before.left[at] * before.split[at]
        one = lv.above + lv.left * ((1 - lv.split) * lv.est + lv.split * lv.leaf)
        ctx, byte = depths[d][:2]
        bits = byte.astype(np.int64)
        p = np.ones(len(ctx))
        for j in range(8):
            q = one[lv.where[j]]
            p *= np.where((bits >> (7 - j)) & 1, q, 1 - q)
        tables.append(((ctx << U64(8)) | byte, np.log10(p)))
    return Model(levels, tables, top)


def _collapse(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their numbers, and the place of each key among them."""
    u = np.sort(k)
    u = u[_distinct(u)]
    at = np.searchsorted(u, k)
    return u, np.bincount(at, n, len(u)).astype(np.int64), at


def _depths(k: np.ndarray, n: np.ndarray, shallow: int, deep: int, least: int) -> list[tuple]:
    """(context, byte, count) of some depths, of contexts that occur ``least`` times at least, from those of the deepest (context * 256 + byte, sorted).

    Where all contexts are asked for, also the place of each among those of the
    depth before.
    """
    pairs = [(k, n)]
    ups = []
    for _ in range(deep - shallow):
        k, n, at = _collapse(((k >> U64(16)) << U64(8)) | (k & U64(255)), n)
        pairs.append((k, n))
        ups.append(at)
    out = []
    for d, (k, n), at in zip(range(shallow, deep + 1), reversed(pairs), [None, *reversed(ups)]):
        ctx = k >> U64(8)
        if d and least and len(k):
            new = _distinct(ctx)
            keep = np.repeat(np.add.reduceat(n, new) >= least, np.diff(np.append(new, len(k))))
            k, n, ctx = k[keep], n[keep], ctx[keep]
        out.append((ctx, k & U64(255), n, None if least else at))
    return out


def _deepest(key: np.ndarray) -> np.ndarray:
    """Sorted keys as of :func:`_turn` as context of DEPTH bytes * 256 + byte."""
    return ((key >> U64(64 - 8 * DEPTH)) << U64(8)) | (key & U64(255))


def _slices(k: np.ndarray, most: int):
    """Stretches of about ``most`` sorted keys as of :func:`_turn`, each of whole trees below contexts of SPLIT bytes; none of none."""
    first = _distinct(k >> U64(64 - 8 * SPLIT))
    at = np.searchsorted(first, np.arange(most, len(k), most))
    cuts = np.unique(np.concatenate([[0], first[at[at < len(first)]], [len(k)]]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _logs(u: np.ndarray, k: np.ndarray, n: np.ndarray, top: Model, least: int) -> np.ndarray:
    """log10 probabilities of sorted keys by the part of the tree of the sorted pairs ``k``, a slice at a time."""
    slices = _slices(k, SLICE_PAIRS) if len(top.levels) == SPLIT else []
    if not slices:
        return top.log10_turned(u)
    shift = U64(64 - 8 * SPLIT)
    ends = [*(int(np.searchsorted(u, k[i] >> shift << shift)) for i, _ in slices[1:]), len(u)]
    out, at = np.empty(len(u)), 0
    for (i, j), end in zip(slices, ends):
        m = _build(_depths(_deepest(k[i:j]), n[i:j], SPLIT, DEPTH, least), top, whole=not least)
        out[at:end] = m.log10_turned(u[at:end])
        m, at = None, end
    return out


def _roots(least: int):
    """Of parts of the tree rows for the driver: ``kind`` 0: context of SPLIT - 1 bytes and byte, times; 1: such a context and node, with the counts and weights of its children added up."""

    def run(batches):
        for batch in batches:
            for zk, zn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, times = unpack_sorted(zk), unpack(zn).view(np.int64)
                for i, j in _slices(keys, SLICE_PAIRS):
                    key, n = keys[i:j], times[i:j]
                    depths = _depths(_deepest(key), n, SPLIT, DEPTH, least)
                    k, c, _ = _collapse(((key >> U64(64 - 8 * (SPLIT - 1))) << U64(8)) | (key & U64(255)), n)
                    z = np.zeros(len(k))
                    yield pa.record_batch({"kind": pa.array(z.astype(np.int32)), "key": pa.array(k.view(np.int64)), "a": pa.array(c.astype(float)), "b": pa.array(z), "w": pa.array(z)})
                    first = _weigh(depths, whole=not least)[1]
                    if first is not None:
                        ctx, node, n0, n1, w = first
                        k, at = np.unique(((ctx >> U64(8))[node >> 8] << U64(8)) | (node & 255).astype(np.uint64), return_inverse=True)
                        a, b, w = (np.bincount(at, x, len(k)) for x in (n0, n1, w))
                        yield pa.record_batch({"kind": pa.array(np.ones(len(k), np.int32)), "key": pa.array(k.view(np.int64)), "a": pa.array(a), "b": pa.array(b), "w": pa.array(w)})

    return run


def _top(rows, least: int) -> Model:
    """Model of the depths above SPLIT from what :func:`_roots` sent."""
    rows = rows.assign(key=rows["key"].to_numpy(np.int64).view(np.uint64)).sort_values(["kind", "key"])
    own, deep = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    below = None
    if len(deep):
        key = deep["key"].to_numpy(np.uint64)
        ctx, at = np.unique(key >> U64(8), return_inverse=True)
        below = (ctx << U64(8), at * 256 + (key & U64(255)).astype(np.int64), *(deep[c].to_numpy(float) for c in "abw"))
    if not len(own):
        z = np.zeros(1, np.uint64)
        return _build([(z, z + U64(END), np.zeros(1, np.int64))])
    return _build(_depths(own["key"].to_numpy(np.uint64), own["a"].to_numpy().astype(np.int64), 0, SPLIT - 1, least), below=below, whole=not least)


def _answer(top, parts: int, least: int):
    """Rows ``block, part, values`` for what blocks ask of a part: log10 probabilities of pairs, or times of words."""

    def run(batches):
        for batch in batches:
            part, zk, zn, ids, asked = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "keys", "ns", "blocks", "asked"))
            for p, k, n, blocks_, wanted in zip(part, zk, zn, ids, asked):
                k, n = unpack_sorted(k), unpack(n).view(np.int64)
                wanted = [unpack_sorted(w) for w in wanted]
                if p < parts:
                    u = np.sort(np.concatenate(wanted))
                    u = u[_distinct(u)]
                    log = _logs(u, k, n, top.value, least)
                    out = [pack_logs(log[np.searchsorted(u, w)]) for w in wanted]
                else:
                    at = [_rows(k, w) for w in wanted]
                    out = [pack(np.where(a >= 0, n[a], 0) if len(n) else np.zeros(len(a), np.int64)) for a in at]
                u = log = wanted = at = None
                trim()
                yield pa.record_batch({"block": pa.array(blocks_, pa.int64()), "part": pa.array([p] * len(out), pa.int32()), "values": pa.array(out, pa.binary())})

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _score(parts: int, total: int, distinct: int):
    floor = np.log10(total + distinct + 1.0)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        held, values = [], dict(zip(answers.column("part").to_pylist(), answers.column("values").to_pylist()))
        for b in blocks(texts.to_batches()):
            coded = folded(b)
            held.append((b, np.diff(coded.offs), [(*_inverse(keys), first) for keys, first in turned(coded)], _inverse(b.word_hashes())))

        def table(kind: int, keys: list[np.ndarray]):
            """What the block asked for, in the same order, and the answers."""
            k = np.sort(np.concatenate(keys))
            k = k[_distinct(k)]
            order, stretches = _ordered(_part(k, kind, parts))
            v = np.empty(len(k))
            for p, i, j in stretches:
                v[order[i:j]] = unpack(values.pop(p)).view(np.int64) if kind else unpack_logs(values.pop(p))
            return k, v

        pairs, logs = table(0, [u for _, _, x, _ in held for u, _, _ in x])
        words, times = table(1, [np.full(1, END_TOKEN, np.uint64), *(u for *_, (u, _) in held)])
        end = times[np.searchsorted(words, U64(END_TOKEN))]
        out = []
        for b, size, own, (u, place) in held:
            score = np.zeros(b.n)
            for v, at, first in own:
                score += np.add.reduceat(logs[np.searchsorted(pairs, v)][at], first[:-1])
            n = times[np.searchsorted(words, u)][place]
            wf = b.words()[2]
            tokens = np.diff(wf) + 1
            base = sums(np.log10(n + 1.0), wf) + np.log10(end + 1.0) - tokens * floor
            cols = {c: b.batch.column(b.batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")}
            out.append(pa.record_batch(cols | {"n_tokens": pa.array(tokens), "n_known": pa.array(sums(n > 0, wf) + int(end > 0)), "base_score": pa.array(base), "score": pa.array(score), "n_bytes": pa.array(size)}))
        held.clear()
        del pairs, logs, words, times, own, u, place
        trim()
        return pa.Table.from_batches(out)

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``.

    Trained on the whole texts of the rows with ``crc32(doc_id) % 7 <> 2``; all
    rows are scored.  ``score`` is the log10 probability of what the base score
    is about too: the text's words, A-Z lower-cased, with one space between
    them, and the end.  ``n_bytes`` counts the bytes of that; ``bits_per_byte``
    is the code length per byte (per the end alone if empty).  Null text counts
    as empty, a null ``doc_id`` as training text.  Repeated rows stay and count
    each; an empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 7, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    size, rows = d.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = (size or 0) + rows
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // GROUP_BYTES + 1)))
    parts = min(MOST_PARTS, size // (6 * PART_PAIRS) + 1)
    tasks = size // (48 * PART_PAIRS * parts) + 1  # that answer for one part
    asked = d.groupBy("block").applyInArrow(_ask(parts), _ASKED).withColumn("salt", F.pmod("block", F.lit(tasks)))
    gathered = stage.written(asked.groupBy("part", "salt").applyInArrow(_gather, _GATHERED), "gathered")
    tables = gathered
    if tasks > 1:  # what the tasks of a part counted, added up
        tables = stage.written(gathered.select("part", "keys", "ns").groupBy("part").applyInArrow(_gather, _GATHERED), "tables")
        gathered = gathered.drop("keys", "ns").join(tables.select("part", "keys", "ns"), "part")
    n, v = tables.where(F.col("part") >= parts).agg(F.sum("total"), F.sum("distinct")).first()
    n, v = n or 0, v or 0
    symbols = tables.where(F.col("part") < parts).agg(F.sum("total")).first()[0] or 0
    least = -(-symbols // CONTEXTS) if CONTEXTS else 0
    roots = tables.where(F.col("part") < parts).select("keys", "ns").mapInArrow(_roots(least), "kind int, key long, a double, b double, w double")
    top = _top(roots.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in "abw"]).toPandas(), least)
    answers = gathered.select("part", "keys", "ns", "blocks", "asked").mapInArrow(_answer(spark.sparkContext.broadcast(top), parts, least), "block long, part int, values binary")
    out = d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(parts, n, v), _SCORED)
    bits = -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))

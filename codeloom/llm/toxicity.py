"""Toxicity (operator 6): a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters with character inputs (its byte n-grams, ends marked) and word
inputs; a window of words runs through two GRUs, attention pools their states,
and the document's score is that of its most toxic window.  Windows overlap by
half and cover the whole text.  Words are embedded and projected once a block
of text, so a step of the network is a gather and a small product.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import stage
from codeloom.llm.decontaminate import _CHUNKS, _pieces, _sum
from codeloom.llm.textbuf import FOLDED, U64, Block, blocks, map_texts, mix, trim

WINDOW, STRIDE = 32, 16
HIDDEN = 8
BUCKETS = 1 << 12  # learned embeddings, words and n-grams each
WIDE = 1 << 18  # label statistics, words and n-grams each
DIM = 6
#: Labelled texts that a task fits on together, about so many rows and bytes at most; every labelled row is in one such shard.
SHARD_ROWS, SHARD_BYTES = 2500, 8 << 20
GRAMS = (3, 5, 7)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(max(GRAMS))], dtype=np.uint64)


def _grams(b: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of each word and where each word's begin (len + 1). A gram at a word's start or end is its own."""
    size = ends - starts
    counts = [np.maximum(size - g, 0) + 1 for g in GRAMS]
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sum(counts), out=first[1:])
    # bytes of the words side by side: which word's, where in it, and how many are left of it
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(starts)), size)
    n = len(owner)
    within = np.arange(n) - begin[owner]
    left = size[owner] - within
    folded = np.zeros(n + max(GRAMS), np.uint64)
    folded[:n] = FOLDED[b.data[starts[owner] + within]]
    out, place = np.empty(first[-1], np.uint64), first[owner] + within
    acc, whole = np.zeros(n, np.uint64), np.zeros(len(starts), np.uint64)
    for j in range(max(GRAMS)):
        acc += folded[j : j + n] * _POWERS[j]
        done = np.flatnonzero(size == j + 1)
        whole[done] = acc[begin[done]]
        if (g := j + 1) in GRAMS:
            at = np.flatnonzero((left >= g) | (within == 0))
            rest = left[at]
            h = np.where(rest < g, whole[owner[at]], acc[at]) + U64(g * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h += (within[at] == 0).astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F)
            h += (rest <= g).astype(np.uint64) * U64(0x165667B19E3779F9)
            out[place[at]] = mix(h)
            place += counts[GRAMS.index(g)][owner]
    return out, first


def _gram_places(b: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and of each hash only where its statistics (low bits) and its embedding (high bits) are."""
    h, first = _grams(b, starts, ends)
    return ((h & U64(WIDE - 1)) + ((h >> U64(40)) % U64(BUCKETS) * U64(WIDE))).astype(np.uint32), first


def _as_they_come(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values by their first places, those places, and the index of each value."""
    u, at, index = np.unique(h, return_index=True, return_inverse=True)
    order, rank = np.argsort(at), np.empty(len(u), np.int32)
    rank[order] = np.arange(len(u))
    return u[order], at[order], rank[index]


@dataclass
class Words:
    """The distinct words of a block: their hashes, places of their n-grams, and the index of each word of the text.

    Words of a block or a shard are in the order in which they first come, so that what is looked up for one window lies together.
    """

    hashes: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray
    index: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, b: Block) -> Words:
        starts, ends, first = b.words()
        h, at, index = _as_they_come(b.word_hashes())
        grams, gf = _gram_places(b, starts[at], ends[at]) if len(at) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        return cls(h, grams, gf, index, first)

    @classmethod
    def of_texts(cls, texts: list[str]) -> Words:
        """The same over any number of texts, a block at a time."""
        hashes, grams, counts, order, sizes = [], [], [], [], []
        seen = np.zeros(0, np.uint64)
        for b in blocks(iter([pa.record_batch({"text": pa.array(texts, pa.string())})])):
            starts, ends, first = b.words()
            h = b.word_hashes()
            order.append(h)
            sizes.append(np.diff(first))
            u, at = np.unique(h, return_index=True)
            new = ~np.isin(u, seen, assume_unique=True)
            if new.any():
                g, gf = _gram_places(b, starts[at[new]], ends[at[new]])
                hashes.append(u[new])
                grams.append(g)
                counts.append(np.diff(gf))
                seen = np.union1d(seen, u[new])
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        if not hashes:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64), first)
        h, g, c = np.concatenate(hashes), np.concatenate(grams), np.concatenate(counts)
        by = np.argsort(h)
        begin = np.cumsum(c) - c
        reps = c[by]
        g = g[np.repeat(begin[by], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        return cls(h[by], g, np.concatenate([[0], np.cumsum(reps)]), np.concatenate([np.searchsorted(h[by], x) for x in order]), first)

    def stretch(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words ``i`` to ``j`` where each one's n-grams begin, how many there are, and the n-grams."""
        first = self.gram_first[i : j + 1]
        return first[:-1] - first[0], np.diff(first), self.grams[first[0] : first[-1]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word indices of every window (-1: none) and the text each belongs to; a text has at least one."""
        count = np.diff(self.first)
        per = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
        doc = np.repeat(np.arange(len(count)), per)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin, end = self.first[:-1][doc] + k * STRIDE, self.first[1:][doc]
        idx = np.full((len(doc), WINDOW), -1, np.int32)
        for i in range(0, len(doc) if len(self.index) else 0, 4096):
            at = begin[i : i + 4096, None] + np.arange(WINDOW)
            part = self.index.take(at, mode="clip")
            part[at >= end[i : i + 4096, None]] = -1
            idx[i : i + 4096] = part
        return idx, doc


def _odds(pos: np.ndarray, neg: np.ndarray, share: float, prior: float = 3.0) -> np.ndarray:
    p = (pos + prior * share) / (pos + neg + prior)
    return (np.log(p / (1 - p)) - np.log(share / (1 - share))).astype(np.float32)


def _word_odds(w: Words, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """Of each distinct word the label statistics: its own, mean and maximum of its n-grams."""
    n = len(w.hashes)
    x = np.zeros((n, 3), np.float32)
    x[:, 0] = word_odds[(w.hashes & U64(WIDE - 1)).astype(np.int64)]
    for i in range(0, n, 16384):
        cut, num, grams = w.stretch(i, i + 16384)
        g = gram_odds.take(grams & np.uint32(WIDE - 1))
        x[i : i + 16384, 1] = np.add.reduceat(g, cut) / num
        x[i : i + 16384, 2] = np.maximum.reduceat(g, cut)
    return x


def _rows(*parts: np.ndarray) -> np.ndarray:
    """Columns side by side and a last row of zeros."""
    x = np.zeros((len(parts[0]) + 1, sum(p.shape[1] for p in parts)), parts[-1].dtype)
    np.concatenate(parts, axis=1, out=x[:-1])
    return x


def _scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by ``at`` into ``n`` rows."""
    k = values.shape[1]
    return np.bincount((at[:, None] * k + np.arange(k)).ravel(), values.ravel(), n * k).reshape(n, k)


class Net:
    """Parameters by name; ``word_odds`` and ``gram_odds`` are label statistics, the rest is learned by gradients."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d = 3 + 2 * DIM
        self.p = {"Ew": r.normal(0, 0.05, (BUCKETS, DIM)), "Ec": r.normal(0, 0.05, (BUCKETS, DIM)), "v": r.normal(0, 0.3, 2 * HIDDEN), "o": r.normal(0, 0.3, 2 * HIDDEN), "b": np.full(1, -2.0)}
        for side in "fb":
            self.p |= {f"W{side}": r.normal(0, 0.3, (d, 3 * HIDDEN)), f"c{side}": np.zeros(3 * HIDDEN), f"U{side}": r.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)), f"V{side}": r.normal(0, 0.3, (HIDDEN, HIDDEN))}
        self.word_odds = np.zeros(WIDE, np.float32)
        self.gram_odds = np.zeros(WIDE, np.float32)

    def float32(self) -> Net:
        """A copy that scores in single precision."""
        out = Net.__new__(Net)
        out.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        out.word_odds, out.gram_odds = self.word_odds, self.gram_odds
        return out

    def embedded(self, w: Words) -> np.ndarray:
        """Of each distinct word the learned inputs."""
        p, n = self.p, len(w.hashes)
        x = np.zeros((n, 2 * DIM), p["Ew"].dtype)
        x[:, :DIM] = p["Ew"][(w.hashes >> U64(40)).astype(np.int64) % BUCKETS]
        for i in range(0, n, 16384):
            cut, num, grams = w.stretch(i, i + 16384)
            x[i : i + 16384, DIM:] = np.add.reduceat(p["Ec"].take(grams // np.uint32(WIDE), 0), cut) / num[:, None]
        return x

    def inputs(self, w: Words) -> np.ndarray:
        """A row for each distinct word and a last one, of zeros, for no word."""
        return _rows(_word_odds(w, self.word_odds, self.gram_odds), self.embedded(w))

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]

    def scores(self, x: np.ndarray, idx: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """Logits of windows in single precision: a state's share of the attention and of the logit is all that is kept of it.

        Units are rows and windows columns, so that every operation runs over adjacent numbers; few windows at once, so that they stay in the cache.
        """
        p, none, half = self.p, len(x) - 1, np.float32(0.5)
        sides = []
        scale = np.repeat(np.float32([0.5, 1]), [2 * HIDDEN, HIDDEN])  # a logistic function is a tanh of half its argument
        for k, side in enumerate("fb"):
            u, v, mine = p[f"U{side}"], p[f"V{side}"], slice(k * HIDDEN, (k + 1) * HIDDEN)
            proj = x.astype(np.float32, copy=False) @ (p[f"W{side}"] * scale).astype(np.float32)
            proj += (p[f"c{side}"] * scale).astype(np.float32)
            proj[none, :HIDDEN] = -1e4  # no word: the state stays
            sides.append((proj, np.concatenate([u.T * 0.5, [p["v"][mine], p["o"][mine]]]).astype(np.float32), np.ascontiguousarray(v.T * 0.5, np.float32)))
        out = np.empty(len(idx), np.float32)
        for a in range(0, len(idx), at_once):
            steps = np.ascontiguousarray(idx[a : a + at_once].T).astype(np.int64)
            steps[steps < 0] = none
            t, n = steps.shape
            kept = np.zeros((2, t, n), np.float32)
            x, xt, g, c, d = (np.empty(shape, np.float32) for shape in ((n, 3 * HIDDEN), (3 * HIDDEN, n), (2 * HIDDEN + 2, n), (HIDDEN, n), (HIDDEN, n)))
            zr = g[: 2 * HIDDEN]
            for k, (proj, m, v) in enumerate(sides):
                h = np.zeros((HIDDEN, n), np.float32)
                for s in range(t) if k == 0 else range(t - 1, -1, -1):
                    np.take(proj, steps[s], axis=0, out=x, mode="clip")
                    np.copyto(xt, x.T)
                    np.matmul(m, h, out=g)
                    if s != (0, t - 1)[k]:
                        kept[:, s + (-1, 1)[k]] += g[2 * HIDDEN :]
                    zr += xt[: 2 * HIDDEN]
                    np.tanh(zr, out=zr)
                    zr += 1
                    np.multiply(zr[HIDDEN:], h, out=d)
                    np.matmul(v, d, out=c)
                    c += xt[2 * HIDDEN :]
                    np.tanh(c, out=c)
                    c -= h
                    c *= zr[:HIDDEN]
                    c *= half
                    h += c
                kept[:, (t - 1, 0)[k]] += m[2 * HIDDEN :] @ h
            att = kept[0]
            att[steps == none] = -1e9
            att -= att.max(axis=0)
            np.exp(att, out=att)
            out[a : a + n] = (att * kept[1]).sum(axis=0) / att.sum(axis=0) + p["b"][0]
        return out

    def gradients(self, x: np.ndarray, idx: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean weighted logistic loss of windows, its gradients, and the gradient by ``x``."""
        p = self.p
        n, t = idx.shape
        u, v = (np.stack([p[f"{name}{side}"] for side in "fb"]) for name in "UV")
        ut, vt = u.transpose(0, 2, 1), v.transpose(0, 2, 1)
        # both directions go through the same steps: steps, directions, units, windows
        there = [idx.T, idx.T[::-1]]
        xs = np.ascontiguousarray(np.stack([proj[i] for proj, i in zip(self.project(x), there)], 1).transpose(0, 1, 3, 2))
        xs[:, :, : 2 * HIDDEN] *= 0.5  # a logistic function is a tanh of half its argument
        half, some, rh = ut * 0.5, (np.stack(there, 1)[:, :, None] >= 0).astype(float), np.empty((2, HIDDEN, n))
        hs, zrs, cs = np.zeros((t + 1, 2, HIDDEN, n)), np.empty((t, 2, 2 * HIDDEN, n)), np.empty((t, 2, HIDDEN, n))
        for s in range(t):
            h, zr, c = hs[s], zrs[s], cs[s]
            np.matmul(half, h, out=zr)
            zr += xs[s, :, : 2 * HIDDEN]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            z *= some[s]
            np.matmul(vt, np.multiply(r, h, out=rh), out=c)
            c += xs[s, :, 2 * HIDDEN :]
            np.tanh(c, out=c)
            np.subtract(c, h, out=hs[s + 1])
            hs[s + 1] *= z
            hs[s + 1] += h
        h = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], 1)  # steps, units, windows
        a = np.matmul(p["v"], h)
        a[(idx < 0).T] = -1e9
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, None] * h).sum(axis=0)
        logit = p["o"] @ pooled + p["b"][0]
        prob = 1 / (1 + np.exp(-logit))
        total = weight.sum()
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / total)
        d = weight * (prob - y) / total
        g = {"o": pooled @ d, "b": np.array([d.sum()])}
        dpool = p["o"][:, None] * d
        da = (h * dpool).sum(axis=1)
        da = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,thn->h", da, h)
        dh = a[:, None] * dpool + da[:, None] * p["v"][:, None]
        dh = np.stack([dh[:, :HIDDEN], dh[::-1, HIDDEN:]], 1)
        h, z, r = hs[:-1], zrs[:, :, :HIDDEN], zrs[:, :, HIDDEN:]
        by_c, by_z, by_r, stay = z * (1 - cs * cs), (cs - h) * z * (1 - z), h * r * (1 - r), 1 - z
        steps, carry, drh = np.empty((t, 2, 3 * HIDDEN, n)), np.zeros((2, HIDDEN, n)), np.empty((2, HIDDEN, n))
        for s in range(t - 1, -1, -1):
            dzr, dc = steps[s, :, : 2 * HIDDEN], steps[s, :, 2 * HIDDEN :]
            carry += dh[s]
            np.multiply(carry, by_c[s], out=dc)
            np.matmul(v, dc, out=drh)
            np.multiply(carry, by_z[s], out=dzr[:, :HIDDEN])
            np.multiply(drh, by_r[s], out=dzr[:, HIDDEN:])
            carry *= stay[s]
            drh *= r[s]
            carry += drh
            carry += np.matmul(u, dzr, out=rh)
        flat = steps.transpose(1, 0, 3, 2).reshape(2, t * n, 3 * HIDDEN)
        before, reset = (m.transpose(1, 2, 0, 3).reshape(2, HIDDEN, t * n) for m in (h, r * h))
        du, dv = before @ flat[:, :, : 2 * HIDDEN], reset @ flat[:, :, 2 * HIDDEN :]
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            dproj = _scatter(there[k].ravel() % len(x), flat[k], len(x))
            dproj[-1] = 0
            g |= {f"U{side}": du[k], f"V{side}": dv[k], f"W{side}": x.T @ dproj, f"c{side}": dproj.sum(axis=0)}
            dx += dproj @ p[f"W{side}"].T
        return loss, g, dx


@dataclass
class Shard:
    """Labelled texts that are fitted on together: words, labels, the half (0, 1) of each text; windows, their texts, the first of each text."""

    w: Words
    y: np.ndarray
    fold: np.ndarray
    idx: np.ndarray
    wdoc: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, w: Words, y: np.ndarray, fold: np.ndarray) -> Shard:
        idx, wdoc = w.windows()
        return cls(w, y, fold, idx, wdoc, np.searchsorted(wdoc, np.arange(len(y))))

    def counts(self) -> np.ndarray:
        """Texts that hold each word and each n-gram, by half and label; a text counts once."""
        w = self.w
        wb = (w.hashes & U64(WIDE - 1)).astype(np.int64)
        gb = (w.grams & np.uint32(WIDE - 1)).astype(np.int32)
        num = np.diff(w.gram_first)
        seen = np.zeros((2, 2, 2, WIDE), np.float32)
        for i in range(len(self.y)):
            q = np.unique(w.index[w.first[i] : w.first[i + 1]])
            reps = num[q]
            at = np.repeat(w.gram_first[q], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            seen[0, self.fold[i], int(self.y[i]), wb[q]] += 1  # once, however often a place is named
            seen[1, self.fold[i], int(self.y[i]), gb[at]] += 1
        return seen


def _set_odds(net: Net, seen: np.ndarray, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gives the network the statistics of all texts; returns for each half those of the other one, as they will be for texts that were never seen."""

    def table(folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_odds(c[folds, 1].sum(axis=0), c[folds, 0].sum(axis=0), share) for c in seen)

    net.word_odds, net.gram_odds = table([0, 1])
    return [table([1 - f]) for f in (0, 1)]


def _epoch(net: Net, adam: dict, step: int, shard: Shard, halves, epoch: int, epochs: int, batch: int, rng) -> int:
    """One pass over a shard; changes ``net`` and ``adam``, returns the number of steps so far."""
    w, y, fold, idx, wdoc, first = shard.w, shard.y, shard.fold, shard.idx, shard.wdoc, shard.first
    n, num = len(y), np.diff(w.gram_first)

    odds = [_rows(_word_odds(w, *half)) for half in halves]
    s = np.empty(len(idx))
    fast = net.float32()
    learned = fast.embedded(w) if epoch else None
    for f in (0, 1):
        mine = np.flatnonzero(fold[wdoc] == f)
        if epoch:
            s[mine] = fast.scores(_rows(odds[f][:-1], learned), idx[mine])
            continue
        x = odds[f][:, 0] + odds[f][:, 2]
        for a in range(0, len(mine), 8192):
            s[mine[a : a + 8192]] = np.sort(x[idx[mine[a : a + 8192]]], axis=1)[:, -3:].sum(axis=1)
    top = np.lexsort((s, wdoc))[np.append(first[1:], len(wdoc)) - 1]  # each text's window of the highest score
    other = first + (rng.random(n) * (np.append(first[1:], len(wdoc)) - first)).astype(np.int64)
    rows = np.concatenate([top, other[y == 0]])
    target = y[wdoc[rows]]
    rows, target = rows[(o := rng.permutation(len(rows)))], target[o]
    rate = 0.02 * (1 - epoch / epochs)
    # parameters and moments become parts of three rows of numbers, each worked on as a whole
    keys = sorted(net.p)
    values, m1, m2 = (np.concatenate([np.ravel(x[k]) for k in keys]) for x in (net.p, {k: adam[k][0] for k in keys}, {k: adam[k][1] for k in keys}))
    grad, square, change = (np.empty_like(values) for _ in range(3))
    gradient, at = {}, 0
    for k in keys:
        to, shape = at + net.p[k].size, net.p[k].shape
        net.p[k], gradient[k] = values[at:to].reshape(shape), grad[at:to].reshape(shape)
        adam[k] = m1[at:to].reshape(shape), m2[at:to].reshape(shape)
        at = to
    for a in range(0, len(rows), batch):
        r, t = rows[a : a + batch], target[a : a + batch]
        for f in (0, 1):
            mine = fold[wdoc[r]] == f
            if not mine.any():
                continue
            used, small = np.unique(idx[r[mine]], return_inverse=True)
            small = small.reshape(-1, WINDOW)
            if used[0] == -1:  # keep -1 last
                used, small = np.append(used[1:], -1), small - 1
            else:
                used = np.append(used, -1)
            x = np.zeros((len(used), 3 + 2 * DIM))
            x[:, :3] = odds[f][used]
            words = used[:-1]
            hw = (w.hashes[words] >> U64(40)).astype(np.int64) % BUCKETS
            reps = num[words]
            places = np.repeat(w.gram_first[words], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            hg = (w.grams[places] // np.uint32(WIDE)).astype(np.int64)
            cut = np.cumsum(reps) - reps
            x[:-1, 3 : 3 + DIM] = net.p["Ew"][hw]
            if len(words):
                x[:-1, 3 + DIM :] = np.add.reduceat(net.p["Ec"][hg], cut) / reps[:, None]
            _, g, dx = net.gradients(x, small, t[mine], np.ones(mine.sum()))
            g["Ew"] = _scatter(hw, dx[:-1, 3 : 3 + DIM], BUCKETS)
            g["Ec"] = _scatter(hg, np.repeat(dx[:-1, 3 + DIM :] / reps[:, None], reps, axis=0), BUCKETS)
            step += 1
            for k, v in g.items():
                gradient[k][...] = v
            for m, share, by in ((m1, 0.1, grad), (m2, 0.01, np.square(grad, out=square))):
                np.subtract(by, m, out=change)
                change *= share
                m += change
            np.divide(m2, 1 - 0.99**step, out=square)
            np.sqrt(square, out=square)
            square += 1e-6
            np.divide(m1, 1 - 0.9**step, out=change)
            change *= rate
            change /= square
            np.multiply(values, rate * 1e-4, out=square)
            change += square
            values -= change
    return step


def _constant(net: Net, y: np.ndarray) -> Net:
    net.p["o"][:] = 0
    net.p["b"][0] = -6.0 if not len(y) or y[0] == 0 else 6.0
    return net.float32()


def fit(texts: list[str], toxic: list[int], epochs: int = 8, batch: int = 128, seed: int = 5) -> Net:
    """The same texts and labels give the same network. Without both labels: a network that scores every text alike."""
    net = Net(seed)
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return _constant(net, y)
    rng = np.random.default_rng(seed)
    shard = Shard.of(Words.of_texts(list(texts)), y, rng.permutation(len(y)) % 2)
    halves = _set_odds(net, shard.counts(), y.mean())
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        step = _epoch(net, adam, step, shard, halves, epoch, epochs, batch, rng)
    return net.float32()


_SHARD = "shard long, z binary"


def _prepared(rows: pa.Table) -> pa.Table:
    """One row of a shard: its distinct words, as they first come, which of them each text holds, labels and halves."""
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    shard, y = rows.column("shard")[0].as_py(), rows.column("toxic").to_numpy().astype(float)
    known, words, order, sizes = np.zeros(0, np.uint64), [], [], []
    for b in blocks(rows.to_batches()):
        starts, ends, first = b.words()
        order.append(b.word_hashes())
        sizes.append(np.diff(first))
        h, at = np.unique(order[-1], return_index=True)
        new = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h if len(known) else np.ones(len(h), bool)
        at = np.sort(at[new])
        known = np.sort(np.concatenate([known, h[new]]))
        size = ends[at] - starts[at] + 1  # and a space
        data = b.data[np.minimum(np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum()), len(b.data) - 1)]
        data[np.cumsum(size) - 1] = 32
        words.append(data.tobytes())
    _, _, index = _as_they_come(np.concatenate(order))
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    fold = np.random.default_rng((5, shard)).permutation(len(y)) % 2
    z = zstandard.compress(pickle.dumps((shard, b"".join(words), index, first, y, fold), 5), 1)
    del order, words, known, index
    trim()
    return pa.table({"shard": pa.array([shard], pa.int64()), "z": pa.array([z], pa.binary())})


def _unpacked(z: bytes) -> tuple[int, Shard]:
    shard, words, index, first, y, fold = pickle.loads(zstandard.decompress(z))
    b = Block(np.frombuffer(words, np.uint8), np.array([0, len(words)]))
    starts, ends, _ = b.words()
    parts = [_gram_places(b, starts[i : i + 16384], ends[i : i + 16384]) for i in range(0, len(starts), 16384)]
    grams = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.uint32)
    num = np.concatenate([[0], *(np.diff(f) for _, f in parts)])
    return shard, Shard.of(Words(b.word_hashes(), grams, np.cumsum(num), index, first), y, fold)


def _shards(batches):
    """Shards one after the other; who takes one lets go of it before the next."""
    for batch in batches:
        for z in batch.column(0):
            yield _unpacked(z.as_py())


def _seen(batches):
    seen = 0
    for _, s in _shards(batches):
        seen = seen + s.counts()
        del s
        trim()
    if np.ndim(seen):
        yield _pieces(seen)


def _flat(net: Net, adam: dict, step: float, weight: float = 1.0) -> np.ndarray:
    """Parameters, their moments and the number of steps times ``weight``, and the weight, in a row."""
    x = np.concatenate([np.ravel(a) for k in sorted(net.p) for a in (net.p[k], *adam[k])] + [[step, 1.0]]) * weight
    return np.concatenate([x, np.zeros(-len(x) % _CHUNKS)])


def _unflat(x: np.ndarray) -> tuple[Net, dict, int]:
    net, adam, at = Net(), {}, 0
    for k in sorted(net.p):
        v = net.p[k]
        a = [x[at + i * v.size : at + (i + 1) * v.size].reshape(v.shape).copy() for i in range(3)]
        net.p[k], adam[k], at = a[0], (a[1], a[2]), at + 3 * v.size
    return net, adam, round(x[at])


def _pass(state, halves, epoch: int, epochs: int, batch: int = 128):
    """Of each shard what a pass over it makes of the state, weighted by its texts."""

    def run(batches):
        for shard, s in _shards(batches):
            net, adam, step = _unflat(state.value)
            step = _epoch(net, adam, step, s, halves.value, epoch, epochs, batch, np.random.default_rng((5, shard, epoch)))
            x = _flat(net, adam, step, len(s.y))
            del s, net, adam
            trim()
            yield _pieces(x)

    return run


def fit_shards(shards: DataFrame, share: float, epochs: int = 8) -> Net:
    """The same on shards as of :func:`_prepared`, of any number: statistics are those of all texts, and after each pass parameters and moments are averaged over shards."""
    sc, z = shards.sparkSession.sparkContext, shards.select("z")
    net = Net()
    seen = _sum(z.mapInArrow(_seen, "part int, z binary"), (2, 2, 2, WIDE))
    halves = sc.broadcast(_set_odds(net, seen, share))
    state = _flat(net, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0)
    weight = sum(3 * v.size for v in net.p.values()) + 1
    for epoch in range(epochs):
        shared = sc.broadcast(state)
        total = _sum(z.mapInArrow(_pass(shared, halves, epoch, epochs), "part int, z binary"), state.shape)
        state = total / total[weight]
        shared.destroy()
    halves.destroy()
    net.p = _unflat(state)[0].p
    return net.float32()


def score_block(net: Net, b: Block) -> np.ndarray:
    """Per text the probability of its most toxic window; without a word, that of an empty window."""
    w = Words.of(b)
    idx, doc = w.windows()
    s = net.scores(net.inputs(w), idx)
    top = np.maximum.reduceat(s, np.searchsorted(doc, np.arange(b.n)))
    return 1 / (1 + np.exp(-top.astype(float)))


def held_out(doc_id, modulus: int, rest: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> Net:
    """Fits on all labelled documents outside the held-out quarter: at the driver if they are one shard, in tasks if they are more."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 4, 2))
    chosen = stage.written(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(stage.if_small(chosen), "doc_id")
    n, size, toxic = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.sum("toxic")).first()
    shards = max(-(-n // shard_rows), (size or 0) // SHARD_BYTES + 1)
    if not n or toxic in (0, n):
        return _constant(Net(), np.array([1.0 if toxic else 0.0]))
    if shards == 1:
        rows = rows.toPandas().sort_values(["doc_id", "text"])
        return fit(rows["text"].tolist(), rows["toxic"].tolist())
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return fit_shards(stage.written(rows.groupBy("shard").applyInArrow(_prepared, _SHARD), "shards"), toxic / n)


def score_toxicity(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, held_out, score, predicted``.

    Only the text is scored.  Null or empty text: the score of an empty window.
    Null ``doc_id``: scored, not held out.  Repeated rows stay; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def each(b: Block) -> pa.RecordBatch:
        s = score_block(shared.value, b)
        return pa.record_batch({"doc_id": b.batch.column(0), "held_out": b.batch.column(2), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return map_texts(d, ["doc_id", "text", "held_out"], each, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, train(docs, labels))


def without_toxic(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; every column as it was.

    Each row is judged by its own whole text, so repeated rows share their fate
    and a null ``doc_id`` does not matter; null text is judged as empty; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches):
        for b in blocks(batches):
            assert b.batch.schema.names[at] == "text"
            yield b.batch.filter(pa.array(score_block(shared.value, b) < threshold))

    return docs.mapInArrow(run, docs.schema)

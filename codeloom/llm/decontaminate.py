"""Benchmark decontamination (operator 1): latent semantic retrieval, then verification on words.

Passages are TF-IDF vectors over hashed terms, with statistics of all
documents.  A distributed randomised SVD (one product with the Gram matrix of
all passages, finished by Nystrom's method on the driver, whose matrices are
TERMS x RANK whatever the corpus) gives a latent space with whitened axes.  Windows over the whole of every text are compared with each
benchmark passage by cosine.  Those close enough, and with enough words in
common for the rule to hold at all, are verified by longest common subsequence
of words and by whether the passage's answer, its last words, is there too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.textbuf import U64, Block, Lookup, block_of, blocks

TERMS = 1 << 14
#: Axes of the latent space, and leading ones left out of it: they tell languages and kinds of text apart, not passages.
RANK, EXTRA = 40, 8
#: Words of a passage whose Gram matrix is decomposed, and between starts of windows in the search.
PASSAGE, STEP = 32, 6
COSINE = 0.3
#: A benchmark text is compared in parts of at most so many words.
PART = 48
#: Benchmark rows that travel to the texts at once; a larger benchmark takes several rounds.
ROUND = 20_000
ANSWER = 5
#: Least shared subsequence: on its own, or together with the answer.
VERBATIM, PARAPHRASE, ANSWER_SHARE = 0.75, 0.5, 0.8
_CHUNKS = 16
#: Words whose vectors are added up at once: few enough to stay in the cache.
_STRETCH = 1 << 13


def terms(h: np.ndarray) -> np.ndarray:
    return (h >> U64(50)).astype(np.uint16)


def _passages(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each run of ``width`` words (each text's last is shorter), and the number of runs before each text."""
    count = np.diff(first)
    per = -(-count // width)
    upto = np.concatenate([[0], np.cumsum(per)])
    at = np.repeat(first[:-1] - upto[:-1] * width, per) + np.arange(upto[-1]) * width
    return at, upto


def _grid(t: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Terms of each run in a row, filled up with TERMS."""
    p = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(t))))
    grid = np.full((len(at), width), TERMS, np.uint16)
    grid[p, np.arange(len(t)) - at[p]] = t
    return grid


def _run_sums(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Sum of the table's rows named in each row of ``grid``; row TERMS of the table is zero."""
    out = table[grid[:, 0]]
    for j in range(1, grid.shape[1]):
        out += table[grid[:, j]]
    return out


def _sum(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Adds up arrays that tasks sent in ``_CHUNKS`` pieces; each piece has its own task, the driver gets one array."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, z in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(z.as_py()), np.float32).astype(np.float64)
                total[part] = total[part] + x if part in total else x
        for part, x in total.items():
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "z": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})

    out = np.zeros(int(np.prod(shape)))
    size = len(out) // _CHUNKS
    for r in rows.repartition(_CHUNKS, "part").mapInArrow(add, "part int, z binary").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["z"]))
    return out.reshape(shape)


def _pieces(x: np.ndarray) -> pa.RecordBatch:
    cut = np.split(x.astype(np.float32).ravel(), _CHUNKS)
    return pa.record_batch({"part": pa.array(range(_CHUNKS), pa.int32()), "z": pa.array([zlib.compress(c.tobytes(), 1) for c in cut], pa.binary())})


def _frequencies(batches):
    """How many passages hold each term; the last number is that of passages."""
    df = np.zeros(TERMS + _CHUNKS)
    for b in blocks(batches):
        t, (_, _, first) = terms(b.word_hashes()), b.words()
        at, _ = _passages(first, PASSAGE)
        grid = _grid(t, at, PASSAGE)
        grid.sort(axis=1)
        grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = TERMS
        df[:TERMS] += np.bincount(grid.ravel(), minlength=TERMS + 1)[:TERMS]
        df[TERMS] += len(at)
    if df.any():
        yield _pieces(df)


def _random(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TERMS, RANK + EXTRA)).astype(np.float32)


def _gram(idf):
    """Sum over passages of a (a . random), that is the Gram matrix of all passages times a random matrix."""

    def run(batches):
        w = idf.value
        omega = _random()
        weighted = np.vstack([omega * w[:, None], np.zeros((1, omega.shape[1]), np.float32)])
        out = np.zeros((TERMS, RANK + EXTRA), np.float64)
        any_ = False
        for b in blocks(batches):
            t, (_, _, first) = terms(b.word_hashes()), b.words()
            if not len(t):
                continue
            any_ = True
            at, _ = _passages(first, PASSAGE)
            y = _run_sums(weighted, _grid(t, at, PASSAGE))
            square = np.add.reduceat(w[t] ** 2, at)
            y /= np.maximum(square, 1e-9)[:, None]  # a passage counts by its direction: length out of both factors
            p = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(t))))
            order = np.argsort(t, kind="stable")
            for i in range(0, len(order), _STRETCH):
                o = order[i : i + _STRETCH]
                s = t[o]
                cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                out[s[cut]] += np.add.reduceat(y[p[o]], cut) * w[s[cut]][:, None]
        if any_:
            yield _pieces(out)

    return run


def latent_terms(gram_omega: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Nystrom approximation of the Gram matrix -> for each term its whitened latent vector, without the leading axes."""
    omega = _random().astype(np.float64)
    nu = 1e-6 * max(np.linalg.norm(gram_omega), 1e-12)
    y = gram_omega + nu * omega
    core = omega.T @ y
    vals, vecs = np.linalg.eigh((core + core.T) / 2)
    vals = np.maximum(vals, 1e-12 * max(vals.max(), 1e-30))
    b = y @ (vecs / np.sqrt(vals))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    keep = slice(EXTRA, RANK + EXTRA)
    return ((u[:, keep] / np.maximum(s[keep], 1e-9)) * idf[:, None]).astype(np.float32)


class Queries:
    """Benchmark passages: words, latent directions, grouped by how many steps their window takes."""

    def __init__(self, items: list[tuple[int, str | None]], latent: np.ndarray):
        self.item, self.words = [], []
        for item, text in items:
            b = block_of([text])
            h = b.word_hashes()
            n = max(1, -(-len(h) // PART))
            for part in np.array_split(h, n):
                if len(part):
                    self.item.append(item)
                    self.words.append(part)
        #: (steps, passages, their directions, and for each word of the vocabulary which of them hold it).
        self.groups = []
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.find = Lookup(self.vocabulary)
        length = np.array([-(-(len(w) + 1) // STEP) for w in self.words], np.int64)
        for size in np.unique(length):
            every = np.flatnonzero(length == size)
            for which in np.array_split(every, -(-len(every) // 128)):
                v = np.array([latent[terms(self.words[i])].sum(axis=0) for i in which])
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                holds = np.zeros((len(self.vocabulary) + 1, len(which)), np.uint8)  # none holds the last
                for c, i in enumerate(which):
                    holds[np.searchsorted(self.vocabulary, self.words[i]), c] = 1
                least = np.array([int(np.ceil(PARAPHRASE * len(self.words[i]))) for i in which], np.uint8)
                self.groups.append((int(size), which, np.ascontiguousarray(v.T.astype(np.float32)), holds, least))
        #: For each passage the bit of each of its words, for the common subsequence.
        self.bits = []
        for w in self.words:
            m: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                m[x] = m.get(x, 0) | 1 << k
            self.bits.append(m)


def lcs(bits: dict[int, int], n: int, words: list[int]) -> int:
    """Longest common subsequence of a passage of ``n`` words (its words' bits) and ``words``."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = bits.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def search_block(b: Block, q: Queries, latent: np.ndarray, cosine: float, bound: bool = True) -> list[tuple[int, int, float, int]]:
    """Row, passage, cosine and first word of every window close to a passage.

    With ``bound``, only windows whose surroundings hold at least as many of the
    passage's words as any verdict needs: what it leaves out would fail.
    """
    h, (_, _, first) = b.word_hashes(), b.words()
    if not len(h) or not q.groups:
        return []
    at, upto = _passages(first, STEP)
    n = len(at)
    steps = _run_sums(np.vstack([latent, np.zeros((1, latent.shape[1]), np.float32)]), _grid(terms(h), at, STEP))
    doc = np.repeat(np.arange(b.n), np.diff(upto))
    last = upto[1:][doc]
    word = q.find.find(h)
    grid = np.full((n, STEP), len(q.vocabulary), np.int32)  # words of the vocabulary in each step
    p = np.repeat(np.arange(n), np.diff(np.append(at, len(h))))
    known = np.flatnonzero(word >= 0)
    grid[p[known], known - at[p[known]]] = word[known]
    win, taken = np.zeros_like(steps), 0
    out = []
    for size, which, v, holds, least in q.groups:  # by size
        while taken < size:
            inside = np.arange(n - taken)[np.arange(taken, n) < last[: n - taken]] if taken else slice(None)
            win[inside] += steps[inside + taken] if taken else steps
            taken += 1
        length = np.sqrt(np.einsum("ij,ij->i", win, win))
        near = win @ v
        ok = near >= (cosine * np.maximum(length, np.float32(1e-9)))[:, None]
        if bound:
            count = np.zeros((n + size + 3, len(which)), np.uint8)
            count[1 : n + 1] = _run_sums(holds, grid)
            held = count[:n].copy()
            for j in range(1, size + 3):  # what it counts beyond a text's end only lets more through
                held += count[j : n + j]
            ok &= held >= least
        r, k = np.divmod(np.flatnonzero(ok), len(which))
        if len(r):
            out += zip(doc[r].tolist(), which[k].tolist(), (near[r, k] / np.maximum(length[r], 1e-9)).tolist(), at[r].tolist())
    return out


def verify(q: Queries, passage: int, words: np.ndarray) -> tuple[int, bool]:
    """Shared subsequence with a passage, and whether the passage's last words are there."""
    own = q.words[passage]
    got = lcs(q.bits[passage], len(own), words.tolist())
    tail = own[-ANSWER:]
    m: dict[int, int] = {}
    for k, x in enumerate(tail.tolist()):
        m[x] = m.get(x, 0) | 1 << k
    return got, lcs(m, len(tail), words.tolist()) >= ANSWER_SHARE * len(tail)


_LEAK = "doc_id long, item_id long, cosine double, lcs long, item_words long, answer boolean, word_at long"


def _search(shared, cosine: float):
    def run(batches):
        q, latent = shared.value
        for b in blocks(batches, limit=1 << 20):
            first = b.words()[2]
            h = b.word_hashes()
            found: dict[tuple[int, int], tuple] = {}
            for row, k, cos, at in search_block(b, q, latent, cosine):
                n = len(q.words[k])
                lo, hi = max(int(first[row]), at - STEP), min(int(first[row + 1]), at + n + 2 * STEP)
                got, answer = verify(q, k, h[lo:hi])
                if got >= VERBATIM * n or (answer and got >= PARAPHRASE * n):
                    new = (got / n, cos, got, n, answer, at - int(first[row]))
                    key = (row, q.item[k])
                    if key not in found or new > found[key]:
                        found[key] = new
            if found:
                ids = b.col("doc_id")
                rows = [(int(ids[r]), i, cos, got, n, ans, at) for (r, i), (_, cos, got, n, ans, at) in sorted(found.items())]
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=[x.split()[0] for x in _LEAK.split(", ")])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Pairs ``doc_id, item_id, cosine, lcs, item_words, answer, word_at``: documents that hold a benchmark passage, verbatim or paraphrased.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Term statistics and
    the decomposition cover all passages of all texts, the search all their windows.
    Null or empty texts hold nothing and empty items are in nothing; rows without
    ``doc_id`` or ``item_id`` take no part in the search.  Repeated rows give one
    pair.  Other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df = _sum(d.select("text").mapInArrow(_frequencies, "part int, z binary"), (TERMS + _CHUNKS,))
    idf = np.log((df[TERMS] + 1) / (df[:TERMS] + 1)).astype(np.float32) + np.float32(0.1)
    shared_idf = spark.sparkContext.broadcast(idf)
    gram = _sum(d.select("text").mapInArrow(_gram(shared_idf), "part int, z binary"), (TERMS, RANK + EXTRA))
    latent = latent_terms(gram, idf)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    rounds = max(1, -(-items.count() // ROUND))
    out = None
    for r in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).collect()
        shared = spark.sparkContext.broadcast((Queries([(x["item_id"], x["text"]) for x in part], latent), latent))
        found = d.where("doc_id is not null").mapInArrow(_search(shared, cosine), _LEAK)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("cosine", "lcs", "item_words", "answer", "word_at"), F.struct(F.col("lcs") / F.col("item_words"), "cosine", "word_at"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; every column as it was.

    Null and empty texts and rows with a null ``doc_id`` stay; rows that repeat
    a ``doc_id`` share its fate; an empty benchmark removes nothing, an empty
    table gives an empty result.
    """
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__leak"], "left_anti")

"""Quality classifier (operator 5): a weak-label model.

Overlapping heuristics vote good or bad on every document, or abstain between.  Expectation
maximisation over the counts of vote patterns (3 to the power of the number of
heuristics at most, whatever the corpus) estimates how often each heuristic
says what about good and bad documents; the posteriors label a bounded sample,
and that trains a linear scorer over hashed byte trigrams and text statistics,
which scores every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.quality import LOW, _limit, compression, text_stats
from codeloom.llm.textbuf import NONSPACE, U64, Block, map_texts, sums

#: Votes: 0 bad, 1 good, 2 no opinion.
VOTERS = ("repeats", "symbols", "capitals", "length", "same_lines", "compression", "word_length", "variety", "letters")
#: Distinct texts (about; those whose hash is below a share of its range) that the linear scorer is fitted on.
FIT_ROWS = 4000
BUCKETS = 1 << 14
BINS = 16  # of each statistic
_STATS = 6
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

_WORDY = _LETTER.copy()
_WORDY[48:58] = _WORDY[128:] = True


def measures(b: Block) -> dict[str, np.ndarray]:
    """Shares and sizes that the heuristics and the scorer look at."""
    st = text_stats(b)
    words = np.maximum(st["n_words"], 1)
    h = b.word_hashes()
    doc = np.repeat(np.arange(b.n), st["n_words"])
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    head = np.minimum(words, 200)  # variety falls with length; compare with what that many words may hold
    letters = sums(_LETTER[b.data], b.offs)
    ratio = compression(b, chunk=1 << 62)[0]
    return dict(
        n_words=st["n_words"],
        repeats=st["n_repeat_words"] / words,
        symbols=st["n_symbols"] / np.maximum(st["word_chars"], 1),
        capitals=sums(_UPPER[b.data], b.offs) / np.maximum(letters, 1),
        same_lines=st["n_dup_lines"] / np.maximum(st["n_lines"], 1),
        squeeze=ratio - _limit(LOW, st["n_bytes"]),
        word_length=st["word_chars"] / words,
        variety=np.bincount(doc[order][new], minlength=b.n) / words * np.sqrt(words / head),
        letters=sums(_WORDY[b.data], b.offs) / np.maximum(sums(NONSPACE[b.data], b.offs), 1),
        n_bytes=st["n_bytes"],
    )


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each document, a column for each heuristic."""

    def vote(bad, good=False):
        return np.where(bad, 0, np.where(good, 1, 2))

    long = m["n_words"] >= 20
    return np.column_stack(
        [
            vote(m["repeats"] > 0.3, long & (m["repeats"] < 0.05)),
            vote(m["symbols"] > 0.04, m["symbols"] < 0.01),
            vote(m["capitals"] > 0.5, (m["capitals"] > 0.002) & (m["capitals"] < 0.15)),
            vote(m["n_words"] < 8, m["n_words"] >= 50),
            vote(m["same_lines"] > 0.3, m["same_lines"] < 0.1),
            vote((m["n_bytes"] >= 64) & (m["squeeze"] < 0), (m["n_bytes"] >= 256) & (m["squeeze"] > 0.015)),
            vote((m["word_length"] < 3) | (m["word_length"] > 8), (m["word_length"] > 3.5) & (m["word_length"] < 7)),
            vote(long & (m["variety"] < 0.25), m["variety"] > 0.45),
            vote(m["letters"] < 0.9, m["letters"] > 0.94),
        ]
    ).astype(np.int8)


def codes(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1]))


@dataclass
class Labels:
    """``share`` of good documents, and how often each heuristic is right when it votes: in all, on good documents, on bad ones; abstaining says nothing.

    A heuristic that looks for one kind of bad text is nearly always right on
    good documents and often wrong on bad ones of other kinds: its good votes
    weigh little, its bad ones much.
    """

    share: float
    accuracy: np.ndarray
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        for_good, for_bad = np.log(self.on_good / (1 - self.on_bad)), np.log(self.on_bad / (1 - self.on_good))
        z = np.log(self.share / (1 - self.share)) + (v == 1) @ for_good - (v == 0) @ for_bad
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Labels:
    """Expectation maximisation, from the belief that heuristics are right more often than not; equal input gives equal output."""
    k = len(VOTERS)
    model = Labels(0.8, np.full(k, 0.8), np.full(k, 0.9), np.full(k, 0.5))
    if not len(patterns):
        return model
    n = counts.astype(float)
    good, bad = (patterns == 1).T, (patterns == 0).T
    p = model.posterior(patterns)
    for _ in range(rounds):
        hits, misses = good @ (n * p), bad @ (n * p)  # votes on good documents
        caught, missed = bad @ (n * (1 - p)), good @ (n * (1 - p))
        on_good = np.clip((hits + 4.5) / (hits + misses + 5), 0.5, 0.995)
        on_bad = np.clip((caught + 1) / (caught + missed + 2), 1.01 - on_good, 0.995)  # better than chance
        accuracy = (hits + caught + 4) / ((good | bad) @ n + 5)
        model = Labels(float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98)), accuracy, on_good, on_bad)
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def _bins(m: dict[str, np.ndarray]) -> np.ndarray:
    """A feature number for each statistic of each document."""
    x = np.column_stack([m["repeats"], m["symbols"] * 5, m["capitals"], m["same_lines"], (m["squeeze"] + 0.5), m["variety"] / 2])
    return BUCKETS + np.arange(_STATS) * BINS + np.clip(x * BINS, 0, BINS - 1).astype(np.int64)


def _trigrams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts, and the first of each text (n + 1)."""
    d = b.data.astype(np.uint64)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(b.n + 1, np.int64)
    t = (((d[:-2] << U64(16)) | (d[1:-1] << U64(8)) | d[2:]) * U64(0x9E3779B97F4A7C15)) >> U64(50)
    inside = np.ones(len(t), bool)
    for back in (1, 2):
        at = b.offs[1:-1] - back
        inside[at[(at >= 0) & (at < len(t))]] = False
    return t[inside].astype(np.int64), np.concatenate([[0], np.cumsum(inside)])[np.minimum(b.offs, len(t))]


_SAMPLE = "code long, stats array<long>, grams array<long>, shares array<float>"


def _sample(b: Block) -> pa.RecordBatch:
    m = measures(b)
    t, first = _trigrams(b)
    grams, shares = [], []
    for i in range(b.n):
        u, c = np.unique(t[first[i] : first[i + 1]], return_counts=True)
        grams.append(u)
        shares.append((c / max(1, c.sum())).astype(np.float32))
    return pa.record_batch([pa.array(codes(votes(m))), pa.array(list(_bins(m)), pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float32()))], names=["code", "stats", "grams", "shares"])


def fit(rows: list, labels: Labels, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> np.ndarray:
    """Logistic regression by AdaGrad on posterior labels; the last weight is the bias."""
    w = np.zeros(BUCKETS + _STATS * BINS + 1)
    g2 = np.full(len(w), 1e-3)
    y = labels.posterior(np.array([[r["code"] // 3**j % 3 for j in range(len(VOTERS))] for r in rows], np.int64)) if rows else np.zeros(0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            at = np.concatenate([r["grams"], r["stats"], [len(w) - 1]]).astype(np.int64)
            x = np.concatenate([np.asarray(r["shares"], float) * 10, np.full(_STATS, 0.5), [0.5]])
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -50, 50)))
            g = (p - y[i]) * x
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


_SCHEMA = "doc_id long, votes string, posterior double, score double, kept boolean"


def weak_quality(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``votes`` (a digit a heuristic: 0 bad, 1 good, 2 none), ``posterior``, ``score``, ``kept`` (score >= 0.5).

    No label is read.  Null text counts as empty (its votes and score are those
    of an empty text); a null ``doc_id`` and repeated rows stay; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = map_texts(d, ["text"], lambda b: pa.record_batch({"code": pa.array(codes(votes(measures(b))))}), "code long").groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    patterns = np.array([[r["code"] // 3**j % 3 for j in range(len(VOTERS))] for r in found], np.int64).reshape(-1, len(VOTERS))
    counts = np.array([r["n"] for r in found], float)
    labels = estimate(patterns, counts)
    rate = min(1.0, fit_rows / max(1.0, counts.sum()))
    chosen = d.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 50)) <= int(rate * (1 << 50))).dropDuplicates(["text"])
    rows = sorted(map_texts(chosen, ["text"], _sample, _SAMPLE).collect(), key=lambda r: (r["code"], r["grams"], r["shares"]))
    model = spark.sparkContext.broadcast((labels, fit(rows, labels)))

    def each(b: Block) -> pa.RecordBatch:
        labels, w = model.value
        m = measures(b)
        v = votes(m)
        t, first = _trigrams(b)
        gram = sums(w[t], first) / np.maximum(np.diff(first), 1) * 10
        z = gram + 0.5 * w[_bins(m)].sum(axis=1) + 0.5 * w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        text = (v + 48).astype(np.uint8).view(f"S{len(VOTERS)}").ravel().astype(str)
        return pa.record_batch({"doc_id": b.batch.column(0), "votes": pa.array(text.tolist(), pa.string()), "posterior": pa.array(labels.posterior(v.astype(np.int64))), "score": pa.array(s), "kept": pa.array(s >= 0.5)})

    return map_texts(d, ["doc_id", "text"], each, _SCHEMA)

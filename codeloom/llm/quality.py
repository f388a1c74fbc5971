"""Quality rules (operator 4): compression bands on top of simple text statistics.

A text that zstandard shrinks too well is repetitive, one that it hardly
shrinks is noise; what is normal depends on the length, so both limits are
curves over it.  The whole document and each fixed chunk of it are judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.textbuf import LEADS, NONSPACE, U64, Block, lines, map_texts, mix, sums

#: Compressed share of the bytes by length: limits of normal text, straight between the points over log2(bytes).
LOW = {8: 0.9, 32: 0.8, 64: 0.70, 128: 0.50, 256: 0.45, 512: 0.48, 1024: 0.465, 2048: 0.448, 4096: 0.428, 8192: 0.412, 16384: 0.40, 32768: 0.388, 65536: 0.378, 262144: 0.36}
HIGH = {1: 12.0, 2: 6.5, 4: 3.8, 8: 2.4, 16: 1.75, 32: 1.42, 64: 1.25, 128: 1.12, 256: 0.92, 512: 0.82, 1024: 0.74, 2048: 0.70, 4096: 0.66, 16384: 0.62}
#: Chunks of this many bytes (a rest of half of it or more is one too, a shorter one belongs to the last, so that chunks cover every byte) and their own limits; a text whose share of chunks outside reaches CHUNK_SHARE goes.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 2048, 0.36, 0.72, 0.5
LEVEL = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_POW8 = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(8)], dtype=np.uint64)


def _duplicates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is there an equal one; is there an equal one before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


def text_stats(b: Block) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bytes, n_lines."""
    starts, ends, first = b.words()
    n = b.n
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    salt = mix(np.arange(n, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(1))
    h = b.hashes(starts, ends, fold=False)
    repeat = np.zeros(n, np.int64)
    if len(h) >= 8:
        m = len(h) - 7
        win = np.zeros(m, np.uint64)
        for k in range(8):
            win += h[k : k + m] * _POW8[k]
        inside = doc[:m] == doc[7:]
        at = np.flatnonzero(inside)
        twice, _ = _duplicates(mix(win[at]) ^ salt[doc[at]])
        cover = np.zeros(len(h) + 1, np.int64)
        hit = at[twice]
        cover[hit] += 1
        np.subtract.at(cover, hit + 8, 1) if len(hit) else None
        repeat = sums(np.cumsum(cover[:-1]) > 0, first)
    ls, le, lfirst = lines(b.data, b.offs)
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ldoc = np.repeat(np.arange(n), np.diff(lfirst))
    at = np.flatnonzero(has_word)
    _, later = _duplicates(b.hashes(ls[at], le[at], fold=False) ^ salt[ldoc[at]])
    return dict(
        n_words=n_words,
        word_chars=sums((NONSPACE & LEADS)[b.data], b.offs),
        n_symbols=sums(_SYMBOL[b.data], b.offs),
        n_dup_lines=np.bincount(ldoc[at[later]], minlength=n),
        n_repeat_words=repeat,
        n_bytes=np.diff(b.offs),
        n_lines=np.diff(lfirst),
    )


def _limit(curve: dict[int, float], n_bytes: np.ndarray) -> np.ndarray:
    return np.interp(np.log2(np.maximum(n_bytes, 1)), np.log2(list(curve)), list(curve.values()))


def compression(b: Block, level: int = LEVEL, chunk: int = CHUNK, chunk_low: float = CHUNK_LOW, chunk_high: float = CHUNK_HIGH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: compressed share of its bytes (1 if empty), number of chunks, number of chunks outside their limits."""
    z = zstandard.ZstdCompressor(level=level, write_content_size=False)
    view = memoryview(np.ascontiguousarray(b.data))
    ratio, chunks, outside = np.ones(b.n), np.zeros(b.n, np.int64), np.zeros(b.n, np.int64)
    offs = b.offs.tolist()
    for i in range(b.n):
        s, e = offs[i], offs[i + 1]
        if e == s:
            continue
        ratio[i] = len(z.compress(view[s:e])) / (e - s)
        if e - s > chunk:
            n = max(1, (e - s + chunk - chunk // 2) // chunk)
            for k in range(n):
                c, stop = s + k * chunk, e if k == n - 1 else s + (k + 1) * chunk
                r = len(z.compress(view[c:stop])) / (stop - c)
                chunks[i] += 1
                outside[i] += not chunk_low <= r <= chunk_high
    return ratio, chunks, outside


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, zstd_ratio double, n_chunks long, n_chunks_outside long, reason string"


def quality_rules(docs: DataFrame, low: dict[int, float] = LOW, high: dict[int, float] = HIGH, chunk_share: float = CHUNK_SHARE, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): text statistics, compression figures, ``kept`` and why not.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  ``base_failed``:
    fewer than ``min_words`` words, or too many words inside 8-word windows that
    the text has twice.  Null text counts as empty: no word, ratio 1, base
    failed.  Null ``doc_id`` and repeated rows stay rows of their own; an empty
    table gives an empty result; other columns are not read.
    """

    def each(b: Block) -> pa.RecordBatch:
        st = text_stats(b)
        ratio, chunks, outside = compression(b)
        failed = (st["n_words"] < min_words) | (100 * st["n_repeat_words"] > max_repeat_percent * st["n_words"])
        judged = st["n_bytes"] > 0
        small = judged & (ratio < _limit(low, st["n_bytes"]))
        large = judged & (ratio > _limit(high, st["n_bytes"]))
        parts = judged & (chunks > 0) & (outside >= chunk_share * chunks)
        kept = ~(failed | small | large | parts)
        reason = np.select([failed, small, large, parts], ["base", "repetitive", "incompressible", "chunks"], "")
        cols = {k: pa.array(st[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        return pa.record_batch({"doc_id": b.batch.column(0), **cols, "base_failed": pa.array(failed), "kept": pa.array(kept), "n_bytes": pa.array(st["n_bytes"], pa.int64()), "zstd_ratio": pa.array(ratio), "n_chunks": pa.array(chunks, pa.int64()), "n_chunks_outside": pa.array(outside, pa.int64()), "reason": pa.array(reason.tolist(), pa.string())})

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], each, _SCHEMA)

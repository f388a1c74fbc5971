"""Line dedup (operator 10): which lines of each document stay, as compressed bitmaps.

Lines are hashed where the text lies; only (hash, document, line number) rows
move.  The hash space is cut into equal ranges, each range is sorted by hash,
then by document (largest first) and line, and one streaming pass finds the
first occurrence of every key.  A key that fills a third of the corpus never
meets in one place: each block of text settles its own copies and sends on at
most two documents a key.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import stage
from codeloom.llm.textbuf import Block, blocks, lines

#: Text whose lines are settled against each other before anything is sent.
SETTLE_BYTES = 32 << 20

_ROW = "doc_id long, fp long, n_lines int, line int, hash long, many boolean"


def line_keys(b: Block, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of every line whose stripped key has ``min_chars`` code points, its hash; lines of each row."""
    starts, ends, first = lines(b.data, b.offs)
    ws, we, _ = b.words()
    count = np.diff(first)
    lo, hi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    some = np.flatnonzero(hi > lo)
    ks, ke = ws[lo[some]], we[hi[some] - 1]
    cp = b.code_points()
    long = cp[ke] - cp[ks] >= min_chars
    some, ks, ke = some[long], ks[long], ke[long]
    row = np.searchsorted(first, some, side="right") - 1
    return row, some - first[row], b.hashes(ks, ke), count


def _settle(rows: dict[str, np.ndarray], min_docs: int, final: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows sorted by hash, document (largest first) and line; for each row 0: stays, 1: is dropped, 2: must be sent on.

    ``many`` says that a row's block already saw ``min_docs`` documents with the key.
    """
    order = np.lexsort((rows["line"], rows["fp"], -rows["doc_id"], rows["hash"]))
    rows = {k: v[order] for k, v in rows.items()}
    h, d = rows["hash"], rows["doc_id"]
    n = len(h)
    if not n:
        return rows, np.zeros(0, np.int8)
    new_key = np.ones(n, bool)
    new_key[1:] = h[1:] != h[:-1]
    new_doc = new_key.copy()
    new_doc[1:] |= d[1:] != d[:-1]
    key = np.cumsum(new_key) - 1
    at = np.flatnonzero(new_key)
    rank = np.cumsum(new_doc)
    rank = rank - rank[at][key] + 1  # 1: the largest document with the key
    docs = np.maximum.reduceat(rank, at)
    many = (docs >= min_docs) | np.logical_or.reduceat(rows["many"], at)
    state = np.where(rank == 1, 0, np.where(many[key], 1, 0 if final else 2)).astype(np.int8)
    if not final:
        state[rank == 1] = 2
        rows["many"] = many[key]
    return rows, state


def _batch(rows: dict[str, np.ndarray], pick: np.ndarray | slice) -> pa.RecordBatch:
    types = dict(doc_id=pa.int64(), fp=pa.int64(), n_lines=pa.int32(), line=pa.int32(), hash=pa.int64(), many=pa.bool_())
    return pa.record_batch({k: pa.array(rows[k][pick], t) for k, t in types.items()})


_SENT = -1  # line number of the row that every document sends, so that it gets a bitmap
_KEYS = ("doc_id", "fp", "n_lines", "line", "hash", "many")


def _scan(min_chars: int, min_docs: int):
    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush():
            rows = {k: np.concatenate([x[k] for x in held]) for k in _KEYS}
            rows, state = _settle(rows, min_docs, final=False)
            yield _batch(rows, state == 2)
            rows["hash"] = np.zeros(len(state), np.int64)
            yield _batch(rows | {"many": np.ones(len(state), bool)}, state == 1)

        for b in blocks(batches):
            ids, fps = b.batch.column(0), b.batch.column(2).to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            row, line, h, count = line_keys(b, min_chars)
            ok = known[row]
            row, line, h = row[ok], line[ok], h[ok]
            n = int(known.sum())
            yield _batch(dict(doc_id=ids[known], fp=fps[known], n_lines=count[known], line=np.full(n, _SENT), hash=np.zeros(n, np.int64), many=np.ones(n, bool)), slice(None))
            held.append(dict(doc_id=ids[row], fp=fps[row], n_lines=count[row], line=line, hash=h.view(np.int64) | 1, many=np.zeros(len(row), bool)))
            size += len(b.data)
            if size >= SETTLE_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _stream(min_docs: int):
    """Over rows sorted by hash: rows that are dropped.  Holds one key's rows at a time, at most two documents a block of text."""

    def run(batches):
        held: dict[str, np.ndarray] | None = None

        def out(rows):
            rows, state = _settle(rows, min_docs, final=True)
            return _batch(rows, state == 1)

        for batch in batches:
            rows = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(_KEYS)}
            if held is not None:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            if not len(rows["hash"]):
                continue
            cut = int(np.searchsorted(rows["hash"], rows["hash"][-1]))
            if cut:
                yield out({k: v[:cut] for k, v in rows.items()})
            held = {k: v[cut:] for k, v in rows.items()}
        if held is not None:
            yield out(held)

    return run


def pack(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches):
    for batch in batches:
        n, dropped = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
        offs, vals = dropped.offsets.to_numpy(), dropped.values.to_numpy(zero_copy_only=False)
        maps, counts = [], []
        for i in range(batch.num_rows):
            keep = np.ones(n[i], bool)
            at = vals[offs[i] : offs[i + 1]]
            keep[at[at >= 0]] = False
            maps.append(pack(keep))
            counts.append(int(n[i] - keep.sum()))
        yield pa.record_batch({"doc_id": batch.column(0), "fp": batch.column(1), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(counts, pa.int64()), "keep": pa.array(maps, pa.binary())})


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document ``doc_id, fp (xxhash64 of the text), n_lines, n_dropped, keep``.

    ``keep`` is a zlib-compressed bitmap with a bit for each ``\\n``-split line.
    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z
    lower-cased, compared by a 64-bit fingerprint.  A key of ``min_chars`` code
    points in at least ``min_docs`` documents keeps its lines only in the
    largest ``doc_id`` that holds it.

    Null or empty text: one empty line, kept.  Null ``doc_id``: no bitmap, no
    influence (the document stays whole).  Rows that repeat a ``doc_id`` count
    as one document; each text of it gets its own bitmap.  Other columns of
    ``docs`` are not read.  An empty table gives an empty result.
    """
    p = stage.partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("fp")).mapInArrow(_scan(min_chars, min_docs), _ROW)
    rows = stage.written(rows, "lines")
    settled = F.col("hash") == 0
    # hashes are uniform, so equal ranges of them are equal shares: no sampling pass for the range partitioning
    part = F.shiftright((F.shiftright("hash", 40) + F.lit(1 << 23)) * F.lit(p), 24).cast("int")
    found = rows.where(~settled).repartitionById(p, part).sortWithinPartitions("hash", F.desc("doc_id"), "line").mapInArrow(_stream(min_docs), _ROW)
    per_doc = rows.where(settled).select("doc_id", "fp", "n_lines", "line").unionByName(found.select("doc_id", "fp", "n_lines", "line")).groupBy("doc_id", "fp", "n_lines").agg(F.collect_set("line").alias("dropped"))
    return per_doc.mapInArrow(_bitmaps, "doc_id long, fp long, n_lines long, n_dropped long, keep binary")


def _joined(docs: DataFrame, bitmaps: DataFrame, mark: str = "__") -> DataFrame:
    """``docs`` with their bitmaps, the columns of which are named after ``mark``."""
    m = bitmaps.select(F.col("doc_id").alias(f"{mark}id"), F.col("fp").alias(f"{mark}fp"), F.col("n_lines").alias(f"{mark}n"), F.col("n_dropped").alias(f"{mark}d"), F.col("keep").alias(f"{mark}keep"))
    return docs.join(m.hint("shuffle_hash"), (docs["doc_id"].cast("long") == m[f"{mark}id"]) & (F.xxhash64(docs["text"]) == m[f"{mark}fp"]), "left")


def kept_lines(data: bytes, bitmap: bytes | None, n_lines: int, n_dropped: int) -> bytes:
    if not n_dropped:
        return data
    keep = unpack(bitmap, n_lines)
    return b"\n".join(x for x, k in zip(data.split(b"\n"), keep.tolist()) if k)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines that :func:`keep_bitmaps` drops taken out of ``text``; ``n_chars``, if there, follows.

    Every row stays, unless ``drop_emptied``: then rows go that lost lines and
    have no word left, all they said being in other documents.  Null and empty
    texts, texts of white space and rows with a null ``doc_id`` stay as they
    are; repeated rows share their fate; of equal documents the one with the
    largest ``doc_id`` keeps the lines.  An empty table gives an empty result,
    and other columns, whatever their names, come out as they went in.
    """
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    joined = _joined(docs, keep_bitmaps(docs, min_chars, min_docs), mark)
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = {f: i for i, f in enumerate(batch.schema.names)}
            cols = {f: batch.column(at[f]) for f in names}
            dropped = batch.column(at[f"{mark}d"]).to_pylist()
            texts, stay = None, None
            for i, d in enumerate(dropped):
                if d:
                    texts = texts or cols["text"].to_pylist()
                    texts[i] = kept_lines((texts[i] or "").encode(), batch.column(at[f"{mark}keep"])[i].as_py(), batch.column(at[f"{mark}n"])[i].as_py(), d).decode()
                    if drop_emptied and not texts[i].strip(" \t\n\v\f\r"):
                        stay = stay or [True] * len(dropped)
                        stay[i] = False
            if texts:
                cols["text"] = pa.array(texts, cols["text"].type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(t) if d else n for t, d, n in zip(texts, dropped, cols["n_chars"].to_pylist())], cols["n_chars"].type)
            out = pa.record_batch(cols)
            yield out.filter(pa.array(stay)) if stay else out

    return joined.mapInArrow(run, docs.schema)


def _digest(batches):
    for b in blocks(batches):
        cols = {c: b.batch.column(i) for i, c in enumerate(b.batch.schema.names)}
        ids, n, d = cols["doc_id"], cols["__n"].to_pylist(), cols["__d"].to_pylist()
        keep = cols["__keep"]
        total = np.diff(lines(b.data, b.offs)[2])
        sha = []
        for i in range(b.n):
            t = b.text(i)
            if d[i]:
                t = kept_lines(t, keep[i].as_py(), n[i], d[i])
            sha.append(hashlib.sha256(t).hexdigest())
        yield pa.record_batch({"doc_id": ids, "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array([x or 0 for x in d], pa.int64()), "kept_sha256": pa.array(sha)})


def line_dedup_digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines`` (before), ``n_dropped, kept_sha256`` (of the kept lines joined by ``\\n``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _joined(docs, keep_bitmaps(docs, min_chars, min_docs)).select("doc_id", "text", "__n", "__d", "__keep").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH l AS (
  SELECT doc_id, s.n AS n, s.line AS line,
         translate(trim(s.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS n) s
), hot AS (
  SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT l.*, hot.k IS NOT NULL AND l.doc_id <> hot.top AS dropped FROM l LEFT JOIN hot USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

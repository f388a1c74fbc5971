"""N-gram Jaccard join (operator 3): adaptive multi-match prefixes.

Texts with the same shingle set are one class.  A class orders its shingles by
estimated frequency (rare first) and publishes a prefix of them: two sets that
are similar enough share at least one shingle of prefixes as long as
``n - ceil(t n) + 1``, and at least k of prefixes k - 1 longer.  Each class picks
its k by the estimated cost of scanning and verifying what its prefix would
meet.  Pairs that share enough prefix shingles are verified on whole texts,
block against block, so that a text travels once a block and not once a pair.

Two classes that have met ``K_MAX`` times need not meet again: a posting carries
fingerprints of the last ``K_MAX`` prefix shingles before it, and of the last
``K_MAX`` of every second one, and postings that agree on either are no news.
A group of near copies meets a few times a pair, not at every shingle.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import stage
from codeloom.llm.components import components
from codeloom.llm.textbuf import U64, Block, block_of, blocks, mix

K_MAX = 3
#: Counters of the frequency sketch; its size is the same for any corpus.
SKETCH = 1 << 20
#: Classes of one verification block.
BLOCK_CLASSES = 256
#: Bits of the filter that keeps texts without candidates out of the exchange (false positives end in the join).
FILTER_BITS = 1 << 23
#: A posting has one fingerprint of 64 bits (0: fewer shingles before it), as long as those of the shingles themselves, and one of 52 beside 12 bits of size on a log scale.
_OTHER_BITS, _STEPS = 52, 128.0
_W = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shingle_sets(b: Block, width: int = 3) -> list[np.ndarray]:
    """Per text its distinct ``width``-word shingles as sorted 64-bit fingerprints; a shorter text is one shingle, no word: none."""
    h, (_, _, first) = b.word_hashes(), b.words()
    weights = [U64(int(_W[k % 3]) + 2 * k) for k in range(width)]
    m = max(0, len(h) - width + 1)
    s = np.zeros(m, np.uint64)
    for k in range(width):
        s += mix(h[k : k + m] + weights[k])
        s = s * U64(0x9E3779B97F4A7C15) + U64(1)
    s = mix(s)
    out = []
    for i in range(b.n):
        a, e = int(first[i]), int(first[i + 1])
        if e - a >= width:
            out.append(np.unique(s[a : e - width + 1]))
        elif e > a:
            x = U64(0x5851F42D4C957F2D + e - a)
            for k in range(a, e):
                x = mix(np.array([x ^ h[k]], np.uint64))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    """A fingerprint of a set, as a signed integer; its two lowest bits are 0 (postings keep k there)."""
    x = mix(mix(s).sum(keepdims=True, dtype=np.uint64) + U64(len(s)))
    return int(x.view(np.int64)[0]) & ~3


def similar(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


# ---- first pass: classes and the sketch

_DOC = "doc_id long, n long, sig long, part int, counts binary"


def _first_pass(width: int):
    def run(batches):
        sketch = np.zeros(SKETCH, np.uint32)
        for b in blocks(batches):
            ids, ns, sigs = b.batch.column(0), [], []
            sets = shingle_sets(b, width)
            for s in sets:
                ns.append(len(s))
                sigs.append(signature(s))
            every = np.concatenate(sets)
            sketch += np.bincount((every & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            yield pa.record_batch([ids, pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(b.n, pa.int32()), pa.nulls(b.n, pa.binary())], names=["doc_id", "n", "sig", "part", "counts"])
        if sketch.any():
            cuts = np.split(sketch, 16)
            yield pa.record_batch([pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64()), pa.array(range(16), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in cuts], pa.binary())], names=["doc_id", "n", "sig", "part", "counts"])

    return run


def _sum_sketch(rows: DataFrame) -> np.ndarray:
    """Sums the partitions' counters, each sixteenth by its own task; 4 MB reach the driver."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(zlib.decompress(z), np.uint32).astype(np.uint64)
                total[part] = total[part] + c if part in total else c
        for part, c in total.items():
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "counts": pa.array([c.astype(np.float32).tobytes()], pa.binary())})

    out = np.zeros(SKETCH, np.float32)
    for r in rows.where("part is not null").select("part", "counts").repartition(16, "part").mapInArrow(add, "part int, counts binary").collect():
        out[r["part"] * (SKETCH // 16) : (r["part"] + 1) * (SKETCH // 16)] = np.frombuffer(r["counts"], np.float32)
    return out


# ---- second pass: prefixes


def prefix(s: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set in global order, and how many of its shingles a partner must share.

    The order (sketch count, fingerprint) is the same for all sets.  A prefix
    for k shared shingles holds ``n - ceil(t n) + k``.  Scanning costs the sum of
    the estimated frequencies; at most a k-th of that many partners meet k
    times and are verified, each for about n steps.
    """
    n = len(s)
    c = counts[(s & U64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((s, c))
    need = -(-percent * n // 100)
    base = n - need
    df = np.cumsum(np.maximum(c[order] - noise, 0.25))
    ks = np.arange(1, min(K_MAX, need) + 1)
    scan = df[base + ks - 1]
    k = int(ks[np.argmin(scan + scan / ks * (n / 16.0))])
    return s[order[: base + k]], k


def _chains(p: np.ndarray, before: np.ndarray, bits: int = 64) -> np.ndarray:
    """For each position a fingerprint of the ``K_MAX`` elements of ``p`` that end at ``before``, never 0; 0 if there are fewer."""
    out = np.zeros(len(p) + 1, np.uint64)
    if len(p) >= K_MAX:
        x = np.zeros(len(p) - K_MAX + 1, np.uint64)
        for j in range(K_MAX):
            x = mix(x + p[j : j + len(x)])
        out[K_MAX:] = np.maximum(x >> U64(64 - bits), U64(1))
    return out[before]


def _postings(counts, noise: float, width: int, percent: int):
    def run(batches):
        table = counts.value
        seen: set[int] = set()
        for b in blocks(batches):
            toks, sigs, chains, infos = [], [], [], []
            for s in shingle_sets(b, width):
                if not len(s):
                    continue
                sig = signature(s)
                if sig in seen:  # copies in this partition publish once
                    continue
                seen.add(sig)
                p, k = prefix(s, table, noise, percent)
                m = len(p)
                half = np.flatnonzero((p >> U64(7)) & U64(1))
                recent = _chains(p, np.arange(m))
                other = _chains(p[half], np.searchsorted(half, np.arange(m)), _OTHER_BITS)
                size = U64(min(4095, int(np.log2(len(s)) * _STEPS)))
                toks.append(p)
                sigs.append(np.full(m, sig | (k - 1), np.int64))
                chains.append(recent)
                infos.append((other << U64(12)) | size)
            if toks:
                yield pa.record_batch({"token": pa.array(np.concatenate(toks).view(np.int64)), "sig": pa.array(np.concatenate(sigs)), "chain": pa.array(np.concatenate(chains).view(np.int64)), "info": pa.array(np.concatenate(infos).view(np.int64))})

    return run


def _meet(percent: int, most: int = 1 << 20):
    """Over postings sorted by token, chain and class: pairs of classes that meet at a token."""
    apart = np.ceil(np.log2(100 / percent) * _STEPS) + 1  # sizes further apart are never similar

    def pairs(tok, sig, chain, info):
        keep = np.ones(len(tok), bool)
        keep[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
        tok, sig, chain, info = tok[keep], sig[keep], chain[keep], info[keep].view(np.uint64)
        other, size = info >> U64(12), (info & U64(4095)).astype(np.int64)
        at = np.arange(len(tok))
        new = np.ones(len(tok), bool)
        new[1:] = tok[1:] != tok[:-1]
        start = np.maximum.accumulate(np.where(new, at, 0))
        sub = new.copy()
        sub[1:] |= (chain[1:] != chain[:-1]) | (chain[1:] == 0)
        until = np.maximum.accumulate(np.where(sub, at, 0))  # rows before this have another chain
        count = until - start
        rows = np.flatnonzero(count)
        done = np.cumsum(count[rows])
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + most, side="right")))
            r = rows[i:j]
            c = count[r]
            a = np.repeat(r, c)
            o = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[r], c)
            ok = (np.abs(size[a] - size[o]) <= apart) & (sig[a] != sig[o]) & ((other[a] != other[o]) | (other[a] == 0))
            a, o = a[ok], o[ok]
            if len(a):
                yield np.minimum(sig[a], sig[o]), np.maximum(sig[a], sig[o]), np.ones(len(a), np.int64)
            i = j

    def combine(found):
        """Pairs once, with how often they met (no more than K_MAX matters)."""
        x, y, n = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((y, x))
        x, y, n = x[order], y[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        return x[at], y[at], np.minimum(np.add.reduceat(n, at), K_MAX)

    def rows(found):
        """A row for each smaller class, with all it met."""
        x, y, n = combine(found)
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        offs = pa.array(np.append(at, len(x)), pa.int32())
        return pa.record_batch({"x": pa.array(x[at]), "y": pa.ListArray.from_arrays(offs, pa.array(y)), "met": pa.ListArray.from_arrays(offs, pa.array(n, pa.int8()))})

    def run(batches):
        held, found, size = None, [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                ready, held = held, None
            else:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                if held is not None:
                    cols = [np.concatenate(x) for x in zip(held, cols)]
                if not len(cols[0]):
                    continue
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                ready, held = [c[:cut] for c in cols], [c[cut:] for c in cols]
            if ready is None or not len(ready[0]):
                continue
            for p in pairs(*ready):
                found.append(p)
                size += len(p[0])
                if size >= 4 * most:
                    found = [combine(found)]
                    size = len(found[0][0])
                    if size >= 2 * most:
                        yield rows(found)
                        found, size = [], 0
        if found:
            yield rows(found)

    return run


# ---- verification


def _verify(width: int, percent: int):
    """Over rows sorted by task, texts before pairs. A task's links leave it added up: for each class the copies it
    links to, and a spanning forest of its links, so that what follows grows with the documents and not with the pairs."""

    def run(batches):
        task, sets, copies, reps, near, root = None, {}, {}, {}, {}, {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        def end():
            rows = [(0, s, c) for s, c in near.items()] + [(1, reps[s], reps[find(s)]) for s in root if find(s) != s]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["kind", "a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
            texts = batch.column(3)
            for i, (t, x, y, c, r) in enumerate(zip(*cols)):
                if t != task:
                    yield from end()
                    task, sets, copies, reps, near, root = t, {}, {}, {}, {}, {}
                if y is None:
                    (s,) = shingle_sets(block_of([texts[i].as_py()]), width)
                    if (g := signature(s)) == x:
                        sets[g], copies[g], reps[g] = s, c, r
                else:
                    a, b = sets[x], sets[y]
                    both = np.sort(np.concatenate([a, b]))
                    if similar(int((both[1:] == both[:-1]).sum()), len(a), len(b), percent):
                        near[x] = near.get(x, 0) + copies[y]
                        near[y] = near.get(y, 0) + copies[x]
                        u, v = find(x), find(y)
                        root[max(u, v)] = root[min(u, v)] = min(u, v)
        yield from end()

    return run


def _candidates(docs: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(sketch)
    noise = float(sketch.mean())
    posts = docs.select("text").mapInArrow(_postings(counts, noise, width, percent), "token long, sig long, chain long, info long")
    met = posts.repartition(stage.partitions(spark), "token").sortWithinPartitions("token", "chain", "sig").mapInArrow(_meet(percent), "x long, y array<long>, met array<tinyint>")
    pairs = met.repartition(stage.partitions(spark), "x").select("x", F.inline(F.arrays_zip("y", "met"))).groupBy("x", "y").agg(F.sum("met").alias("met"))
    k = F.least(F.col("x").bitwiseAND(F.lit(3)), F.col("y").bitwiseAND(F.lit(3))) + 1
    return pairs.where(F.col("met") >= k).select(*[F.col(c).bitwiseAND(F.lit(~3)).alias(c) for c in ("x", "y")])


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    ends = pairs.select(F.col("x").alias("sig"), F.col("y").alias("o")).unionByName(pairs.select(F.col("y").alias("sig"), F.col("x").alias("o")))
    star = ends.groupBy("sig").agg(F.least(F.min("o"), F.first("sig")).alias("star"))
    sizes = star.groupBy("star").agg(F.count("*").alias("size"))
    place = star.join(sizes, "star").select("sig", F.xxhash64("star", F.pmod(F.xxhash64("sig"), F.ceil(F.col("size") / BLOCK_CLASSES))).alias("block"))
    place = stage.if_small(stage.written(place, "blocks"))
    px, py = place.select(F.col("sig").alias("x"), F.col("block").alias("bx")), place.select(F.col("sig").alias("y"), F.col("block").alias("by"))
    tasks = stage.written(pairs.join(px, "x").join(py, "y").select(F.xxhash64(F.least("bx", "by"), F.greatest("bx", "by")).alias("task"), "x", "y"), "tasks")
    wanted = tasks.select("task", F.col("x").alias("sig")).unionByName(tasks.select("task", F.col("y").alias("sig"))).distinct().join(classes.select("sig", "rep", "copies"), "sig")
    wanted = stage.written(wanted.select("task", "sig", "rep", "copies"), "wanted")
    # a bitmap of the wanted documents (at most FILTER_BITS / 8 bytes) thins out the texts before the exact join
    bit = lambda column: F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
    maps = wanted.select(bit("rep").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    flags = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:
        flags[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    shared = spark.sparkContext.broadcast(flags)

    def thin(batches):
        for batch in batches:
            p = batch.column(2).to_numpy(zero_copy_only=False) - 1
            yield batch.filter(pa.array(((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)))

    texts = docs.select("doc_id", "text", bit("doc_id").alias("p")).mapInArrow(thin, "doc_id long, text string, p long").select("doc_id", "text")
    narrow = stage.if_small(wanted)
    rows = narrow.join(texts, narrow["rep"] == texts["doc_id"]).select("task", F.col("sig").alias("x"), F.lit(None).cast("long").alias("y"), "text", "copies", "rep")
    rows = rows.unionByName(tasks.select("task", "x", "y", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("long").alias("rep")))
    return rows.repartition(stage.partitions(spark), "task").sortWithinPartitions("task", "y").mapInArrow(_verify(width, percent), "kind long, a long, b long")


def similarity_classes(docs: DataFrame, percent: int = 70, width: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` (``doc_id, n, sig``), ``classes`` (``sig, rep, copies``) and what verification found:
    kind 0: class ``a`` links to ``b`` documents of other classes, kind 1: a link between representatives ``a`` and ``b`` (a spanning forest of each task)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stage.written(d.mapInArrow(_first_pass(width), _DOC), "classes")
    members = first.where("part is null").select("doc_id", "n", "sig")
    classes = stage.written(members.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    named = d.where("doc_id is not null")
    pairs = stage.written(_candidates(named, _sum_sketch(first), width, percent), "pairs")
    return members, classes, stage.written(_verified(named, pairs, classes, width, percent), "found")


def jaccard_join(docs: DataFrame, percent: int = 70, width: int = 3) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, n_similar, component_id, class_id, n_copies``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set is
    its distinct ``width``-word shingles (64-bit fingerprints).  Two documents
    link when ``100 * intersection >= percent * union``.  ``n_similar`` counts
    the other rows linked directly, ``component_id`` is the smallest ``doc_id``
    reachable.  No word (or null text): empty set, linked with nothing.  A null
    ``doc_id`` takes no part (``component_id`` null).  Rows that repeat a
    ``doc_id`` are documents of their own.  Other columns are not read; an empty
    table gives an empty result.
    """
    members, classes, found = similarity_classes(docs, percent, width)
    reps = classes.select("sig", "rep", "copies")
    near = found.where("kind = 0").groupBy(F.col("a").alias("sig")).agg(F.sum("b").alias("near"))
    comp = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    per_class = reps.join(near, "sig", "left").join(comp, F.col("rep") == F.col("node"), "left").select(F.col("sig").alias("c_sig"), "rep", "copies", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("component", "rep").alias("component"))
    per_class = stage.written(per_class, "per_class")
    out = members.join(per_class, (F.col("sig") == F.col("c_sig")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.col("copies") - 1 + F.col("near"), F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("n_copies")
    )


def one_of_each(docs: DataFrame, percent: int = 70) -> DataFrame:
    """``docs`` without the documents that have a smaller ``doc_id`` in their component (rows of one ``doc_id`` share its fate).

    Documents without a word (null, empty or blank text) link with nothing and
    stay, as do rows with a null ``doc_id``; of equal documents the smallest
    ``doc_id`` stays.  An empty table gives an empty result; every column comes
    out as it went in.
    """
    gone = jaccard_join(docs, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


#: The same rows by joining all documents on every shingle that they share.
SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS h FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n AS p ON p.doc_id = c.a JOIN n AS q ON q.doc_id = c.b WHERE 100 * c.i >= 70 * (p.n + q.n - c.i)),
r AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d),
k AS (SELECT h, min(doc_id) AS rep, count(*) AS copies FROM n WHERE n > 0 GROUP BY h)
SELECT n.doc_id, n.n AS n_shingles, coalesce(d.similar, 0) AS n_similar, o.component AS component_id, coalesce(k.rep, n.doc_id) AS class_id, coalesce(k.copies, 1) AS n_copies
FROM n JOIN (SELECT d, min(m) AS component FROM r GROUP BY d) AS o ON o.d = n.doc_id
LEFT JOIN (SELECT a, count(*) AS similar FROM l GROUP BY a) AS d ON d.a = n.doc_id
LEFT JOIN k ON k.h = n.h AND n.n > 0
"""

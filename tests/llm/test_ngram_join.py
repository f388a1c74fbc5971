import collections
import os
import random
import re

import duckdb
import numpy as np
import pytest

from codeloom.llm import ngram_join
from codeloom.llm.components import components
from codeloom.llm.textbuf import block_of

W = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=70):
    sets = []
    for i, t in rows:
        w = [x.translate(FOLD) for x in W.findall(t or "")]
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    deg = [0] * n
    for a in range(n):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * inter >= percent * len(sets[a] | sets[b]):
                deg[a] += 1
                deg[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), rows[k][0])
    return [(rows[k][0], len(sets[k]), deg[k], least.get(find(k)) if rows[k][0] is not None else None) for k in range(n)]


def check(spark, rows, percent=70):
    d = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, sig int, rep string")
    got = ngram_join.jaccard_join(d, percent).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, percent), key=key)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 8, 30, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, near_copies(seed))


def test_other_threshold(spark):
    check(spark, near_copies(5, 40), 40)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "A"), (6, "a b"), (7, "a  b"), (None, "a b"), (8, "a b c"), (8, "a b c"), (9, "A B\nC"), (10, "b a")])


def test_border_of_the_threshold(spark):
    # 7 of 10 shingles: exactly 70 percent links, 69 does not
    a = " ".join(f"x{k}" for k in range(12))
    check(spark, [(1, a), (2, " ".join(f"x{k}" for k in range(9))), (3, " ".join(f"x{k}" for k in range(8)))])


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_join(d).count() == 0


def test_one_of_each_keeps_columns(spark):
    d = spark.createDataFrame([(5, "a b c d", "s"), (2, "A b c d", "s"), (9, "q", "s"), (None, "a b c d", "t")], "doc_id long, text string, source string")
    out = ngram_join.one_of_each(d)
    assert out.columns == d.columns and {r["doc_id"] for r in out.collect()} == {2, 9, None}


def test_prefix_filter_never_loses_a_pair():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 50, ngram_join.SKETCH).astype(np.float32)
    for _ in range(200):
        base = rng.integers(1, 1 << 62, rng.integers(1, 80)).astype(np.uint64)
        other = np.concatenate([base[rng.random(len(base)) < 0.85], rng.integers(1, 1 << 62, rng.integers(0, 8)).astype(np.uint64)])
        a, b = np.unique(base), np.unique(other)
        inter = len(np.intersect1d(a, b))
        if len(b) and ngram_join.similar(inter, len(a), len(b), 70):
            (pa, ka), (pb, kb) = (ngram_join.prefix(s, counts, 3.0, 70) for s in (a, b))
            assert len(np.intersect1d(pa, pb)) >= min(ka, kb)


def test_short_texts_have_their_own_shingles():
    sets = ngram_join.shingle_sets(block_of(["a b", "a", "a b c", "", "b a"]))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1]
    assert len({int(s[0]) for s in sets if len(s)}) == 4


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert collections.Counter(got.values())[100] == 41


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_sql_gives_the_same_rows(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = c.sql(ngram_join.SQL)
    got = ngram_join.jaccard_join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())

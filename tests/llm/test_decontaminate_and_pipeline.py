import importlib.util
import os
import random

import numpy as np
import pytest

from codeloom.llm import decontaminate as D
from codeloom.llm.textbuf import block_of


def corpus(seed=1, n=300, items=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    words = lambda k: [rng.choice(vocabulary[: rng.choice([30, 3000])]) for _ in range(k)]
    bench = [words(rng.choice([6, 15, 20, 38, 55, 70])) for _ in range(items)]
    docs, planted = [], {}
    for i in range(n):
        w = words(rng.randint(5, 300))
        if i % 6 == 0:
            k = rng.randrange(items)
            item = list(bench[k])
            kind = rng.choice(["verbatim", "paraphrase"]) if len(item) >= 15 else "verbatim"
            if kind == "paraphrase":
                for j in range(0, len(item) - D.ANSWER, 6):
                    item[j] = rng.choice(vocabulary)
            at = rng.randint(0, len(w))
            w[at:at] = item
            planted[i] = k
        docs.append((i, " ".join(w)))
    return docs, [(k, " ".join(x)) for k, x in enumerate(bench)], planted


def frames(spark, docs, bench):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, item_id string, cosine double"), spark.createDataFrame(bench, "item_id long, text string")


def test_lcs_against_the_textbook():
    rng = random.Random(2)
    for _ in range(100):
        a, b = [[rng.randrange(6) for _ in range(rng.randint(1, 14))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        bits = {}
        for k, x in enumerate(a):
            bits[x] = bits.get(x, 0) | 1 << k
        assert D.lcs(bits, len(a), b) == t[-1][-1]


def test_finds_what_was_planted_and_nothing_else(spark):
    docs, bench, planted = corpus()
    d, b = frames(spark, docs, bench)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(d.repartition(3), b).collect()}
    want = set(planted.items())
    assert len(want - got) <= 0.05 * len(want), sorted(want - got)
    assert len(got - want) <= 1, sorted(got - want)


def test_search_recall_against_all_windows():
    docs, bench, _ = corpus(3, 80)
    b = block_of([t for _, t in docs])
    freq = next(iter(D._frequencies(iter([__import__("pyarrow").record_batch({"text": [t for _, t in docs]})]))))
    df = np.concatenate([np.frombuffer(__import__("zlib").decompress(z.as_py()), np.float32) for z in freq["z"]])
    idf = np.log((df[D.TERMS] + 1) / (df[: D.TERMS] + 1)).astype(np.float32) + np.float32(0.1)

    class Idf:
        value = idf

    gram = next(iter(D._gram(Idf)(iter([__import__("pyarrow").record_batch({"text": [t for _, t in docs]})]))))
    g = np.concatenate([np.frombuffer(__import__("zlib").decompress(z.as_py()), np.float32) for z in gram["z"]]).reshape(D.TERMS, -1)
    latent = D.latent_terms(g.astype(float), idf)
    q = D.Queries(bench, latent)
    exact = set()
    h, (_, _, first) = b.word_hashes(), b.words()
    for row in range(b.n):
        for k in range(len(q.words)):
            n = len(q.words[k])
            for at in range(int(first[row]), int(first[row + 1]), D.STEP):
                lo, hi = max(int(first[row]), at - D.STEP), min(int(first[row + 1]), at + n + 2 * D.STEP)
                got, answer = D.verify(q, k, h[lo:hi])
                if got >= D.VERBATIM * n or answer and got >= D.PARAPHRASE * n:
                    exact.add((row, k))
                    break
    found = {(r, k) for r, k, _, _ in D.search_block(b, q, latent, D.COSINE)}
    assert len(exact & found) >= 0.9 * len(exact) and len(exact) > 8
    wide = {(r, k) for r, k, _, _ in D.search_block(b, q, latent, D.COSINE, bound=False)}
    assert exact & wide == exact & found  # the bound on shared words only leaves out what would fail


@pytest.mark.parametrize("replaced", [0.3, 0.4, 0.5])
def test_recall_where_many_words_are_replaced(spark, replaced):
    """Documents that hold passages with their answer and the other words replaced up to what the rule accepts, against the rule on all windows."""
    docs, bench, _ = corpus(6, 240)
    rng = random.Random(7)
    vocabulary = sorted({w for _, t in docs for w in t.split()})
    long = [(k, x.split()) for k, x in bench if 15 <= len(x.split()) <= D.PART]
    for i in range(0, 240, 2):
        w, (_, x) = docs[i][1].split(), rng.choice(long)
        for j in rng.sample(range(len(x) - D.ANSWER), min(len(x) - D.ANSWER, int(replaced * len(x)))):
            x = [*x[:j], rng.choice(vocabulary), *x[j + 1 :]]
        at = rng.randint(0, len(w))
        docs[i] = (i, " ".join(w[:at] + x + w[at:]))
    b, q = block_of([t for _, t in docs]), D.Queries(bench, np.zeros((D.TERMS, D.RANK), np.float32))
    h, (_, _, first) = b.word_hashes(), b.words()
    want = set()
    for row in range(b.n):
        for k, own in enumerate(q.words):
            for at in range(int(first[row]), int(first[row + 1]), D.STEP):
                got, answer = D.verify(q, k, h[max(int(first[row]), at - D.STEP) : min(int(first[row + 1]), at + len(own) + 2 * D.STEP)])
                if got >= D.VERBATIM * len(own) or answer and got >= D.PARAPHRASE * len(own):
                    want.add((row, q.item[k]))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(*frames(spark, docs, bench)).collect()}
    assert got <= want and len(want) > 100 and len(got) >= 0.9 * len(want)


def test_odd_rows(spark):
    d, b = frames(spark, [(1, None), (2, ""), (None, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "x " * 3000 + "A b c D e f g h")], [(1, "a b c d e f g h"), (2, None), (3, ""), (None, "x x x"), (1, "a b c d e f g h")])
    assert {r["doc_id"] for r in D.leaks(d, b).collect()} <= {3, 4}
    assert D.leaks(d.where("false"), b).count() == 0 and D.leaks(d, b.where("false")).count() == 0
    out = D.without_leaks(d, b)
    assert out.columns == d.columns and {1, 2, None} <= {r["doc_id"] for r in out.collect()}


def test_a_large_benchmark_takes_rounds(spark, monkeypatch):
    docs, bench, planted = corpus(4, 120)
    d, b = frames(spark, docs, bench)
    once = {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b).collect()}
    monkeypatch.setattr(D, "ROUND", 5)
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b).collect()} == once


def test_the_decomposition_covers_every_passage(spark, monkeypatch):
    """The product that is decomposed, against a sum over all passages in plain loops, whatever a sample would have been allowed."""
    docs, bench, _ = corpus(8, 60)
    seen = []
    latent_terms = D.latent_terms
    monkeypatch.setattr(D, "latent_terms", lambda gram, idf: (seen.append((gram, idf)), latent_terms(gram, idf))[1])
    monkeypatch.setattr(D, "FIT_PASSAGES", 100, raising=False)
    D.leaks(*frames(spark, docs, bench))
    gram, idf = seen[0]
    want, omega = np.zeros_like(gram), D._random().astype(float)
    for _, text in docs:
        t = D.terms(block_of([text]).word_hashes())
        for at in range(0, len(t), D.PASSAGE):
            own, n = np.unique(t[at : at + D.PASSAGE], return_counts=True)
            a = n * idf[own].astype(float)
            want[own] += np.outer(a, a @ omega[own]) / (n * idf[own].astype(float) ** 2).sum()
    assert np.abs(gram - want).max() < 1e-4 * np.abs(want).max()


# ---- pipeline

SF = "/root/testdata/sf0.001"
HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "corpus_pipeline.py")


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(HERE), reason="no driver tables")
def test_pipeline_step_by_step(spark):
    """Each stage against brute force or its own operator's verdicts on the rows that the stage before kept."""
    from test_line_dedup_and_mixing import brute_lines
    from test_ngram_join import brute

    from codeloom.llm import mixing, toxicity

    spec = importlib.util.spec_from_file_location("corpus_pipeline", HERE)
    P = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(P)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, seen = dict(P.STAGES), [docs]
    for name, step in P.STAGES:
        out = step(spark, seen[-1], SF).persist()
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(out)
    rows = [[(r["doc_id"], r["text"]) for r in x.collect()] for x in seen[:-1]]
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {i for i, _ in rows[1]} == {i for i, p in verdict.items() if not p}
    import hashlib

    before, blank = dict(rows[1]), {i for i, t in rows[1] if not (t or "").strip(" \t\n\v\f\r")}
    want = {i: (n, s) for i, _, n, s in brute_lines(rows[1])}
    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows[2]} <= {(i, s) for i, (_, s) in want.items()}
    emptied = set(want) - {i for i, _ in rows[2]}
    held = {k.strip(" \t\n\v\f\r").lower() for _, t in rows[2] for k in (t or "").split("\n")}
    for i in emptied:  # they lost lines, nothing else of them was words, and what they said is still there
        assert want[i][0] and all(not (k := x.strip(" \t\n\v\f\r")) or k.lower() in held for x in before[i].split("\n"))
    assert blank <= {i for i, _ in rows[2]}
    assert {i for i, _ in rows[3]} == {i for i, _, _, c in brute(rows[2]) if i == c}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {i for i, _ in rows[3]} - {i for i, _ in rows[4]}
    assert {i for i, t in rows[3] if any(b in t for _, b in bench)} <= gone
    final = {r["doc_id"]: r for r in seen[-1].collect()}
    assert set(final) == {i for i, _ in rows[4]} and all(0 <= r["taken"] <= 2 * r["size"] for r in final.values())
    again = {r["doc_id"]: r["taken"] for r in P.run(spark, SF).collect()}
    assert again == {i: r["taken"] for i, r in final.items()}
    assert mixing.WEIGHTS == (5, 2, 1)


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(HERE), reason="no driver tables")
def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, columns of clashing names, and tables without rows."""
    spec = importlib.util.spec_from_file_location("corpus_pipeline", HERE)
    P = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(P)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("*", "doc_id as __id", "text as __leak", "1 as __gone")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-2, None, "en", "s", None), (-3, "same words in both of these rows here", "en", "s", 1), (-3, "same words in both of these rows here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.selectExpr("*", "doc_id as __id", "text as __leak", "1 as __gone")
    rows = docs.unionByName(odd.select(*[odd[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))
    for name, step in P.STAGES:
        for table in (rows, rows.where("false")):
            out = step(spark, table, SF)
            got = out.collect()
            assert (name == "mixing" or out.columns == docs.columns) and len(got) <= 35
            if table is rows and name != "toxicity":
                assert sum(r["doc_id"] is None for r in got) == 1 and {-1, -2, -3} <= {r["doc_id"] for r in got}

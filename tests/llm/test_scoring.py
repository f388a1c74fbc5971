"""Quality rules, weak labels, toxicity and language-model scoring."""

import collections
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import ctw, quality, textbuf, toxicity, weak_quality
from codeloom.llm.textbuf import block_of, lines

W = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["one two three four five six seven eight nine ten " * 2, "", None, " \t\n", "a\na\n\n \nA\na b", "é # $ | ü\n<x>\x1c&%*", "w " * 5000, "x", "q\n" * 40, "one two three four five six seven eight z one two three four five six seven eight"]


def table(spark, texts, **extra):
    rows = [(i, t, 0.5, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, kept string")


def stats(t):
    t = t or ""
    w = W.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_text_buffer_lines_and_words():
    b = block_of(TEXTS)
    s, e, first = lines(b.data, b.offs)
    got = [[b.data[s[k] : e[k]].tobytes().decode() for k in range(first[i], first[i + 1])] for i in range(b.n)]
    assert got == [(t or "").split("\n") for t in TEXTS]
    ws, we, wf = b.words()
    assert [[b.data[ws[k] : we[k]].tobytes().decode() for k in range(wf[i], wf[i + 1])] for i in range(b.n)] == [W.findall(t or "") for t in TEXTS]
    assert len(set(block_of(["ab", "ab x", "AB"]).word_hashes().tolist())) == 2


def test_quality_statistics(spark):
    got = {r["doc_id"]: r for r in quality.quality_rules(table(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == stats(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_compression_bands(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("etaoinshrdlucmfwypvbgkETAS") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = " ".join(rng.choice(vocabulary[: rng.choice([60, 4000])]) for _ in range(900))
    words = [f"{rng.choice(vocabulary)}" for _ in range(300)]
    noise = " ".join("".join(rng.choice("".join(map(chr, range(33, 127))) + "äöüßéèê") for _ in range(12)) for _ in range(400))
    loop = " ".join(w for w in words[:40] for _ in range(7))
    r = quality.quality_rules(table(spark, [prose, noise, loop])).orderBy("doc_id").collect()
    assert [x["kept"] for x in r] == [True, False, False]
    assert r[1]["reason"] == "incompressible"


def test_chunks_cover_every_byte(spark):
    """The rule by its definition on texts around the borders of chunks, the tail of which is noise or one letter."""
    import zstandard

    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(9000))
    z = lambda t: len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False).compress(t)) / len(t)
    texts = [prose[:n] + tail[:k] for n in (1, 40, 2000, 2048, 4096, 6000) for k in (0, 1, 900, 1023, 1024, 1025, 2048) for tail in (noise, "a" * 3000)]
    for r in quality.quality_rules(table(spark, texts)).collect():
        t = texts[r["doc_id"]].encode()
        c = quality.CHUNK
        cuts = list(range(0, len(t), c)) if len(t) > c else []
        if len(cuts) > 1 and len(t) - cuts[-1] < c // 2:
            cuts.pop()
        pieces = [t[a:b] for a, b in zip(cuts, [*cuts[1:], len(t)])]
        assert b"".join(pieces) == (t if cuts else b"")
        assert r["n_chunks"] == len(pieces) and r["n_chunks_outside"] == sum(not quality.CHUNK_LOW <= z(p) <= quality.CHUNK_HIGH for p in pieces)
        w, _, _, _, again = stats(texts[r["doc_id"]])
        failed = w < 20 or 100 * again > 30 * w
        lo, hi = (float(np.interp(np.log2(len(t)), np.log2(list(x)), list(x.values()))) for x in (quality.LOW, quality.HIGH))
        assert r["kept"] == (not failed and lo <= z(t) <= hi and not (pieces and r["n_chunks_outside"] >= quality.CHUNK_SHARE * len(pieces)))


def test_short_texts_are_judged_too(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t", "a " * 20, "b", "xy zw"]
    r = quality.quality_rules(table(spark, texts)).orderBy("doc_id").collect()
    assert [x["kept"] for x in r] == [True, False, False, False] and r[2]["reason"] == "base"


def test_quality_odd_rows(spark):
    d = spark.createDataFrame([(None, "a", 1), (3, "long word " * 60_000, 2), (3, "long word " * 60_000, 3), (4, None, 4)], "doc_id long, text string, n_words long")
    for f in (quality.quality_rules, weak_quality.weak_quality):
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in f(d).collect()) == [(False, 3), (False, 3), (False, 4), (True, 0)]


def test_quality_of_nothing(spark):
    assert quality.quality_rules(table(spark, ["a"]).where("false")).count() == 0
    assert weak_quality.weak_quality(table(spark, ["a"]).where("false")).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.8
    acc = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9, 0.85, 0.7])
    right = rng.random((len(y), len(acc))) < acc
    v = np.where(right, y[:, None], ~y[:, None]).astype(np.int64)
    v[rng.random(v.shape) < 0.3] = 2
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    m = weak_quality.estimate(patterns, counts)
    assert np.abs(m.accuracy - acc).max() < 0.03 and abs(m.share - 0.8) < 0.02
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.97


def naive_em(v, rounds=200):
    """The same model, a document and a voter at a time, in plain Python."""
    k = len(v[0])
    share, good, bad = 0.8, [0.9] * k, [0.5] * k

    def posterior(row):
        a, b = share, 1 - share
        for j, x in enumerate(row):
            if x != 2:
                a *= good[j] if x == 1 else 1 - good[j]
                b *= bad[j] if x == 0 else 1 - bad[j]
        return a / (a + b)

    for _ in range(rounds):
        p = [posterior(r) for r in v]
        share = min(0.98, max(0.02, sum(p) / len(p)))
        for j in range(k):
            hit, miss = sum(q for q, r in zip(p, v) if r[j] == 1), sum(q for q, r in zip(p, v) if r[j] == 0)
            got, lost = sum(1 - q for q, r in zip(p, v) if r[j] == 0), sum(1 - q for q, r in zip(p, v) if r[j] == 1)
            good[j] = min(0.995, max(0.5, (hit + 4.5) / (hit + miss + 5)))
            bad[j] = min(0.995, max(1.01 - good[j], (got + 1) / (got + lost + 2)))
    return [posterior(r) for r in v]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_posteriors_of_real_votes_against_plain_python(spark):
    got = weak_quality.weak_quality(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).orderBy("doc_id").collect()
    want = naive_em([[int(c) for c in r["votes"]] for r in got])
    assert max(abs(r["posterior"] - w) for r, w in zip(got, want)) < 1e-6


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_weak_labels_rank_quality(spark):
    """Area under the curve against labels that the operator never reads; every heuristic has both kinds of votes to weigh."""
    got = weak_quality.weak_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null").select("doc_id", "quality")
    r = got.join(lab, "doc_id").collect()
    s = [x["score"] for x in r]
    y = np.array([x["quality"] for x in r])
    rank = np.empty(len(s))
    rank[np.argsort(s)] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95
    assert np.mean([x["kept"] == bool(x["quality"]) for x in r]) > 0.95
    for j in range(len(weak_quality.VOTERS)):
        assert sum(x["votes"][j] == "1" for x in r) > len(r) / 2


def test_weak_quality(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinsrhl") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(60, 200))).capitalize() + "." for _ in range(60)]
    bad = [" ".join([word()] * 80) for _ in range(15)] + [" ".join(word() + "### $$$" for _ in range(60)) for _ in range(15)]
    d = table(spark, good + bad + ["", None])
    a, b = ([tuple(r) for r in weak_quality.weak_quality(x).orderBy("doc_id").collect()] for x in (d, d.repartition(5)))
    assert a == b and len(a) == 92
    kept = [r[4] for r in a]
    assert sum(kept[:60]) >= 58 and sum(kept[60:90]) <= 4


# ---- toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Net(1)
    x = rng.normal(size=(6, 3 + 2 * toxicity.DIM))
    x[-1] = 0
    idx = rng.integers(0, 5, (3, 7))
    idx[1, 4:] = -1
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    _, g, dx = net.gradients(x, idx, y, w)
    loss = lambda: net.gradients(x, idx, y, w)[0]
    for name in g:
        at = tuple(int(rng.integers(0, s)) for s in net.p[name].shape)
        for step, sign in ((1e-5, 1), (-2e-5, -1)):
            net.p[name][at] += step
            up, down = (loss(), None) if sign > 0 else (up, loss())  # noqa: F821
        net.p[name][at] += 1e-5
        assert abs(g[name][at] - (up - down) / 2e-5) < 1e-6
    x[2, 4] += 1e-5
    up = loss()
    x[2, 4] -= 2e-5
    assert abs(dx[2, 4] - (up - loss()) / 2e-5) < 1e-6


def test_windows_cover_whole_texts():
    w = toxicity.Words.of(block_of([" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 100)]))
    idx, doc = w.windows()
    for i, n in enumerate((0, 1, 31, 32, 33, 48, 49, 100)):
        mine = idx[doc == i]
        assert len(mine) >= 1 and set(mine[mine >= 0].tolist()) == set(w.index[w.first[i] : w.first[i + 1]].tolist())


def insults(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinsrhldcu") for _ in range(rng.randint(2, 7)))
    texts, labels = [], []
    for _ in range(n):
        w = [word() for _ in range(rng.randint(10, 150))]
        bad = rng.random() < 0.3
        for _ in range(bad * rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(["jerk", "Twit", "grumb" + word()])
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_on_texts_it_never_saw(spark):
    texts, labels = insults(1, 700)
    d = table(spark, texts + ["", None])
    lab = spark.createDataFrame([(i, y, 9) for i, y in enumerate(labels)] + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(d, lab).orderBy("doc_id").collect()
    assert len(got) == 702 and got[700]["score"] == got[701]["score"]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    out = [r for r in got[:700] if r["held_out"]]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in out]) > 0.9
    flipped = lab.withColumn("toxic", lab.toxic if False else (1 - lab.toxic)).where(toxicity.held_out(lab.doc_id, 4, 2))
    same = toxicity.toxicity(d, lab.where(~toxicity.held_out(lab.doc_id, 4, 2)).unionByName(flipped)).orderBy("doc_id").collect()
    assert [r["score"] for r in same] == [r["score"] for r in got]  # held-out labels change nothing


def test_toxicity_is_fitted_on_every_labelled_text(spark):
    """Shards of a third of the texts: statistics against plain counts of all texts, and texts it never saw."""
    texts, labels = insults(3, 900)
    d, lab = table(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    net = toxicity.train(d, lab, 250)
    mine = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 != 2]
    seen = np.zeros((2, toxicity.WIDE))
    for i in mine:
        seen[labels[i], np.unique(block_of([texts[i]]).word_hashes() & np.uint64(toxicity.WIDE - 1)).astype(int)] += 1
    assert np.abs(net.word_odds - toxicity._odds(seen[1], seen[0], np.mean([labels[i] for i in mine]))).max() < 1e-5
    s = toxicity.score_block(net, block_of(texts))
    assert np.mean([(s[i] >= 0.3) == labels[i] for i in set(range(900)) - set(mine)]) > 0.9


def scores_in_rows(net, x, idx):
    """Logits of windows as they were worked out first: a window a row, all states kept."""
    p, h = net.p, toxicity.HIDDEN
    states = []
    for side, order in (("f", range(idx.shape[1])), ("b", range(idx.shape[1] - 1, -1, -1))):
        proj, state = x @ p[f"W{side}"] + p[f"c{side}"], np.zeros((len(idx), h), np.float32)
        out = np.zeros((idx.shape[1], len(idx), h), np.float32)
        for s in order:
            a = proj[idx[:, s]]
            zr = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + state @ p[f"U{side}"]))
            z, r = zr[:, :h] * (idx[:, s] >= 0)[:, None], zr[:, h:]
            state = state + z * (np.tanh(a[:, 2 * h :] + (r * state) @ p[f"V{side}"]) - state)
            out[s] = state
        states.append(out)
    both = np.concatenate(states, axis=2)
    a = both @ p["v"]
    a[(idx < 0).T] = -1e9
    a = np.exp(a - a.max(axis=0))
    return np.einsum("tn,tnh->nh", a / a.sum(axis=0), both) @ p["o"] + p["b"][0]


def test_windows_cost_less_than_in_rows():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, n) % 9000) for n in [0, 1, 31, 33, *rng.integers(1, 900, 400).tolist()]]
    w, net = toxicity.Words.of(block_of(texts)), toxicity.Net(2).float32()
    x, (idx, _) = net.inputs(w), w.windows()
    seconds = collections.defaultdict(list)
    for _ in range(5):
        for name, f in (("rows", lambda: scores_in_rows(net, x, idx)), ("now", lambda: net.scores(x, idx))):
            t = time.thread_time()
            seconds[name].append((f(), time.thread_time() - t))
    assert np.abs(seconds["rows"][0][0] - seconds["now"][0][0]).max() < 1e-5
    assert min(t for _, t in seconds["now"]) < 0.8 * min(t for _, t in seconds["rows"])


def test_shards_hold_every_word_of_every_text():
    """A shard as it is sent and unpacked, over several blocks, against the texts; words lie in the order in which they first come."""
    texts = ["", "é x ABC abc", None, "word " * 3, "long-" * 40 + " " + "y" * 9] + [" ".join(f"v{k * i % 977}" for k in range(20_000)) for i in range(1, 40)]
    n = len(texts)
    rows = pa.table({"doc_id": pa.array(range(n)), "text": pa.array([t or "" for t in texts]), "toxic": pa.array([i % 2 for i in range(n)]), "shard": pa.array([3] * n)})
    ((shard, s),) = toxicity._shards(toxicity._prepared(rows).select(["z"]).to_batches())
    b = block_of(texts)
    w = toxicity.Words.of(b)
    assert shard == 3 and s.y.tolist() == [i % 2 for i in range(n)] and (np.diff(np.unique(s.w.index, return_index=True)[1]) > 0).all()
    assert (s.w.hashes[s.w.index] == b.word_hashes()).all()
    for name in ("hashes", "grams", "gram_first", "index", "first"):
        assert (getattr(s.w, name) == getattr(w, name)).all(), name


def test_grams_of_short_and_long_words():
    b = block_of(["a bb ccc dddd eeeee ffffff ggggggg abcdefgh é ABCDEFGH"])
    starts, ends, _ = b.words()
    got, first = toxicity._grams(b, starts, ends)
    mask, fold = (1 << 64) - 1, [int(v) for v in textbuf.FOLDED]
    for i, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist())):
        want = []
        for g in toxicity.GRAMS:
            k = min(g, hi - lo)
            for at in range(lo, hi - k + 1):
                h = g * 0x9E3779B97F4A7C15 + sum(fold[b.data[at + j]] * int(toxicity._POWERS[j]) for j in range(k))
                want.append((h + (at == lo) * 0xC2B2AE3D27D4EB4F + (at + k == hi) * 0x165667B19E3779F9) & mask)
        assert got[first[i] : first[i + 1]].tolist() == textbuf.mix(np.array(want, np.uint64)).tolist()


def test_toxicity_without_labels(spark):
    d = table(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity(d, none).collect()] == [0, 0]
    assert toxicity.toxicity(d.where("false"), none).count() == 0


def test_dropping_toxic_rows_keeps_the_rest(spark):
    texts, labels = insults(2, 300)
    d = table(spark, texts)
    net = toxicity.fit(texts, labels)
    out = toxicity.without_toxic(d, net)
    s = np.concatenate([toxicity.score_block(net, block_of([t])) for t in texts])
    assert out.schema == d.schema and {r["doc_id"] for r in out.collect()} == {i for i in range(300) if s[i] < 0.3}


# ---- context-tree weighting


def reference_model(texts, depth, least):
    """Context-tree weighting by its definition, with dictionaries."""
    counts = collections.defaultdict(lambda: [0, 0])
    total = collections.Counter()
    for t in texts:
        a = bytes([255] * depth) + (t or "").encode() + b"\xff"
        for i in range(depth, len(a)):
            for d in range(depth + 1):
                c = a[i - d : i]
                total[c] += 1
                for j in range(8):
                    counts[c, (1 << j) | (a[i] >> (8 - j))][(a[i] >> (7 - j)) & 1] += 1
    kept = {c for c in total if not c or total[c] >= least}
    below = collections.defaultdict(list)
    for c in kept:
        if c:
            below[c[1:]].append(c)
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weight(c, p):
        """log P_w of a node, and the share of what is deeper."""
        n = counts.get((c, p), [0, 0])
        own = pe(*n)
        if not below[c]:
            return own, 0.0
        rest = list(n)
        deep = 0.0
        for x in below[c]:
            m = counts.get((x, p), [0, 0])
            rest = [rest[0] - m[0], rest[1] - m[1]]
            deep += weight(x, p)[0]
        deep += pe(*rest)
        both = np.logaddexp(own, deep) - math.log(2)
        return both, math.exp(deep - math.log(2) - both)

    def log10(t):
        a = bytes([255] * depth) + (t or "").encode() + b"\xff"
        out = 0.0
        for i in range(depth, len(a)):
            path = [b""]
            while len(path) <= depth and a[i - len(path) : i] in kept:
                path.append(a[i - len(path) : i])
            for j in range(8):
                p, bit = (1 << j) | (a[i] >> (8 - j)), (a[i] >> (7 - j)) & 1
                one, left = 0.0, 1.0
                for c in path:
                    n = counts.get((c, p), [0, 0])
                    split = weight(c, p)[1]
                    one += left * (1 - split) * (n[1] + 0.5) / (sum(n) + 1)
                    left *= split
                rest = counts.get((path[-1], p), [0, 0])
                for x in below[path[-1]]:
                    m = counts.get((x, p), [0, 0])
                    rest = [rest[0] - m[0], rest[1] - m[1]]
                one += left * (rest[1] + 0.5) / (sum(rest) + 1)
                out += math.log10(one if bit else 1 - one)
        return out

    return log10, sum(total[c] for c in total if len(c) == 0)


def coded(t):
    """What is scored: the words that the base score counts, one space between them."""
    return " ".join(w.translate(FOLD) for w in W.findall(t or ""))


def test_texts_as_they_are_coded():
    for texts in (TEXTS, ["", "A"], [" \x0b\ta  B\n"], [""], ["\u2028É x"]):
        b = ctw.folded(block_of(texts))
        assert [b.text(i).decode() for i in range(b.n)] == [coded(t) for t in texts]


def test_scores_are_context_tree_weighting(spark, monkeypatch):
    monkeypatch.setattr(ctw, "CONTEXTS", 40)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "then", "Anna", "über", "to"]) for _ in range(rng.randint(0, 12))) for _ in range(24)] + ["", None, "zzz\x01 unseen"]
    got = ctw.score_texts(table(spark, texts)).orderBy("doc_id").collect()
    texts = [coded(t) for t in texts]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    n = sum(len((t or "").encode()) + 1 for t in train)
    log10, total = reference_model(train, ctw.DEPTH, n / 40)
    assert total == n
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert abs(r["score"] - log10(texts[r["doc_id"]])) < 1e-4 * max(1, abs(r["score"]))


@pytest.mark.parametrize("group, pairs", [(16 << 20, 1 << 19), (300, 40)])
def test_base_score(spark, monkeypatch, group, pairs):
    """log10((c + 1) / (n + 1 * (v + 1))), in one block and in several, with parts that answer in several tasks."""
    monkeypatch.setattr(ctw, "GROUP_BYTES", group)
    monkeypatch.setattr(ctw, "PART_PAIRS", pairs)
    monkeypatch.setattr(ctw, "MOST_PARTS", 5)
    texts = TEXTS + ["Two words", "two WORDS never", "x"]
    c = collections.Counter()
    tokens = [[w.translate(FOLD) for w in W.findall(t or "")] + [None] for t in texts]
    for i, w in enumerate(tokens):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for r in ctw.score_texts(table(spark, texts)).collect():
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)) < 1e-6 * max(1, abs(r["base_score"]))


def test_base_score_is_add_one(spark):
    """log10((c + 1) / (n + v + 1)): known words and one unknown have chances that add up to one."""
    texts = [f"w{i} w{i % 3} x" for i in range(12)]
    tokens = [[*t.split(), None] for t in texts]
    c = collections.Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in ctw.score_texts(table(spark, texts)).collect():
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[r["doc_id"]])) < 1e-6


def test_the_tree_keeps_every_context(spark, monkeypatch):
    """Against one tree in memory of all contexts, over several blocks and parts; most contexts make up far less than 2^-15 of the bytes."""
    monkeypatch.setattr(ctw, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(ctw, "PART_PAIRS", 9_000)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("etaoinsü") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["", None]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    k = ctw.contexts(block_of(train))[0]
    depths = []
    for d in range(ctw.DEPTH + 1):
        u, n = np.unique(k & ctw._MASK[d + 1], return_counts=True)
        depths.append((u >> np.uint64(8), u & np.uint64(255), n))
    assert len(k) > 2 << 15
    m = ctw.build(depths)
    for r in ctw.score_texts(table(spark, texts)).collect():
        want = m.log10(ctw.contexts(block_of([texts[r["doc_id"]]]))[0]).sum()
        assert abs(r["score"] - want) < 1e-4 * max(1, abs(want))


def test_probabilities_of_all_bytes_sum_to_one():
    k = ctw.contexts(block_of(["the theme of them " * 6, "over there"]))[0]
    depths = []
    for d in range(ctw.DEPTH + 1):
        u, n = np.unique(k & ctw._MASK[d + 1], return_counts=True)
        ctx = u >> np.uint64(8)
        keep = np.isin(ctx, [c for c in np.unique(ctx) if n[ctx == c].sum() >= 4]) if d else np.ones(len(u), bool)
        depths.append((ctx[keep], u[keep] & np.uint64(255), n[keep]))
    m = ctw.build(depths)
    for c in (b"\xff\xff\xff\xff\xff", b" them", b"zzzzz", b"of th"):
        ctx = np.uint64(int.from_bytes(c, "big"))
        keys = (ctx << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10.0 ** m.log10(keys)).sum() - 1) < 1e-4


def test_lm_scoring_of_nothing(spark):
    assert ctw.score_texts(table(spark, ["a"]).where("false")).count() == 0


def test_answers_do_not_depend_on_blocks_and_parts(spark, monkeypatch):
    texts, _ = insults(4, 80)
    whole = {r["doc_id"]: r for r in ctw.score_texts(table(spark, texts)).collect()}
    monkeypatch.setattr(ctw, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(ctw, "PART_PAIRS", 90)
    monkeypatch.setattr(ctw, "MOST_PARTS", 7)
    for r in ctw.score_texts(table(spark, texts).repartition(3)).collect():
        w = whole[r["doc_id"]]
        assert abs(r["score"] - w["score"]) < 1e-4 * abs(w["score"]) and abs(r["base_score"] - w["base_score"]) < 1e-6
        assert r["n_known"] == w["n_known"]


def test_memory_of_a_part_does_not_follow_its_pairs(monkeypatch):
    """Answers of a part in slices are those of the whole tree, and take a fraction of its memory."""
    import tracemalloc

    rng = random.Random(4)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(40_000))
    keys, n = np.unique(next(ctw.turned(ctw.folded(block_of([text]))))[0], return_counts=True)
    wanted = np.unique(np.concatenate([keys[::3], keys[::7] ^ np.uint64(1), keys[::11] ^ np.uint64(1 << 60)]))
    packed = {"keys": [ctw.pack_sorted(keys)], "ns": [ctw.pack(n)]}

    class Top:
        value = None

    def answers(pairs):
        monkeypatch.setattr(ctw, "SLICE_PAIRS", pairs, raising=False)
        roots = pa.Table.from_batches(ctw._roots(0)(iter([pa.record_batch(packed)]))).to_pandas()
        Top.value = ctw._top(roots.groupby(["kind", "key"], as_index=False).sum(), 0)
        asked = pa.record_batch({"part": [0], **packed, "blocks": [[1]], "asked": [[ctw.pack_sorted(wanted)]]})
        tracemalloc.start()
        out = next(ctw._answer(Top, 1, 0)(iter([asked])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return ctw.unpack_logs(out["values"][0].as_py()), peak

    whole, most = answers(1 << 40)
    sliced, least = answers(1 << 12)
    assert len(keys) > 100_000 and np.abs(whole - sliced).max() < 1e-3 and least < most / 4


def test_scoring_odd_rows(spark):
    rows = [(None, "a b", 1), (None, "a b", 2), (3, None, 3), (3, None, 3), (5, "b " * 40_000, 4), (6, "", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score long").withColumnsRenamed({}).selectExpr("*", "score as part", "score as block")
    got = ctw.score_texts(d).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(False, 3, 1), (False, 3, 1), (False, 5, 40_001), (False, 6, 1), (True, 0, 3), (True, 0, 3)]
    assert len({r["score"] for r in got if r["doc_id"] is None}) == 1 and all(r["score"] < 0 for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_lm_beats_words_on_held_out_texts(spark):
    r = ctw.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def plain_score(net, text):
    """A text's score by the definition, a window, a step and a unit at a time; only the inputs of a word are taken from the operator."""
    w = toxicity.Words.of(block_of([text]))
    x = net.inputs(w).astype(float).tolist()
    words = [x[i] for i in w.index.tolist()]
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    h, sigmoid = toxicity.HIDDEN, lambda a: 1 / (1 + math.exp(-a))

    def gru(side, steps):
        state, out = [0.0] * h, []
        wx, c, u, v = p[f"W{side}"], p[f"c{side}"], p[f"U{side}"], p[f"V{side}"]
        for s in steps:
            a = [c[k] + sum(s[i] * wx[i][k] for i in range(len(s))) for k in range(3 * h)]
            z = [sigmoid(a[k] + sum(state[i] * u[i][k] for i in range(h))) for k in range(h)]
            r = [sigmoid(a[h + k] + sum(state[i] * u[i][h + k] for i in range(h))) for k in range(h)]
            new = [math.tanh(a[2 * h + k] + sum(r[i] * state[i] * v[i][k] for i in range(h))) for k in range(h)]
            state = [(1 - z[k]) * state[k] + z[k] * new[k] for k in range(h)]
            out.append(state)
        return out

    best, at = None, 0
    while best is None or at + toxicity.WINDOW - toxicity.STRIDE < len(words):
        mine = words[at : at + toxicity.WINDOW]
        if mine:
            both = [f + b for f, b in zip(gru("f", mine), gru("b", mine[::-1])[::-1])]
            score = [sum(e * v for e, v in zip(s, p["v"])) for s in both]
            weight = [math.exp(s - max(score)) for s in score]
            pooled = [sum(k * s[j] for k, s in zip(weight, both)) / sum(weight) for j in range(2 * h)]
        else:
            pooled = [0.0] * (2 * h)
        logit = sum(a * b for a, b in zip(pooled, p["o"])) + p["b"][0]
        best = logit if best is None else max(best, logit)
        at += toxicity.STRIDE
    return sigmoid(best)


def test_scores_against_a_forward_pass_in_plain_python():
    texts, labels = insults(7, 60)
    net = toxicity.fit(texts, labels, epochs=2)
    some = [t for t in texts if len(t.split()) < 90][:6] + ["", " ", "one", " ".join(f"w{k}" for k in range(33))]
    got = toxicity.score_block(net, block_of(some))
    assert max(abs(g - plain_score(net, t)) for g, t in zip(got, some)) < 1e-4


def test_toxicity_odd_rows(spark):
    texts, labels = insults(8, 80)
    lab = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, labels[0])], "doc_id long, toxic int")
    rows = [(i, t, 0, True) for i, t in enumerate(texts)] + [(None, texts[0], 1, None), (3, texts[3], 2, None), (3, texts[3], 3, None), (500, "word " * 50_000, 4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, predicted int, held_out boolean")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 3}) == 1 and sum(r["doc_id"] is None for r in got) == 1

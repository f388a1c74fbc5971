import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from codeloom.llm import line_dedup, mixing

WS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "A line of at least twenty code points"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, hash string, many boolean")


def brute_lines(rows):
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(WS).translate(FOLD)
            if i is not None and len(k) >= 20:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(held.get(k := x.strip(WS).translate(FOLD), ())) >= 3 and i != max(held[k]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


CASES = {
    "shared": [(1, LONG + "\nown one"), (2, "  " + LONG.upper() + "\t\r\nx"), (3, LONG), (4, "é" * 20), (5, "é" * 20), (6, "É" * 20)],
    "nulls and empties": [(1, None), (2, ""), (3, "\n\n"), (None, LONG), (4, LONG), (5, LONG)],
    "repeated rows": [(1, LONG), (1, LONG), (2, LONG), (3, LONG + "\n" + LONG), (3, LONG + "\n" + LONG)],
    "one id, two texts": [(1, LONG), (1, LONG + "\nz"), (2, LONG), (3, LONG)],
    "nineteen": [(i, "x" * 19) for i in range(5)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_line_dedup(spark, case):
    rows = CASES[case]
    got = line_dedup.line_dedup_digest(docs(spark, *rows)).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_lines(rows), key=key)


def test_a_hot_key_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SETTLE_BYTES", 100)
    rows = [(i, LONG + f"\nown {i % 7}") for i in range(400)]
    got = line_dedup.line_dedup_digest(docs(spark, *rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_lines(rows))


def test_bitmaps_and_texts(spark):
    d = docs(spark, (1, LONG + "\na"), (2, LONG + "\nb"), (3, LONG + "\nc")).withColumn("n_chars", F.char_length("text").cast("long"))
    maps = {r["doc_id"]: line_dedup.unpack(bytes(r["keep"]), r["n_lines"]).tolist() for r in line_dedup.keep_bitmaps(d).collect()}
    assert maps == {1: [False, True], 2: [False, True], 3: [True, True]}
    out = line_dedup.dedup_lines(d)
    assert out.columns == d.columns
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, "a", 1), (2, "b", 1), (3, LONG + "\nc", len(LONG) + 2)}


# ---- mixing


def texts(spark, *rows):
    return spark.createDataFrame([(i, s, "w " * n if n is not None else None, 7) for i, s, n in rows], "doc_id long, source string, text string, shard int")


def test_targets_are_reshared_until_none_is_above():
    sizes = [100, 1000, 10]
    t = mixing.targets(sizes, [5, 2, 1], 1.5 * sum(sizes))
    assert t[0] == 200 and t[2] == 20 and abs(sum(t) - 1665) < 1e-9 and t[1] <= 2000
    assert mixing.targets([0, 0], [5, 2], 0.0) == [0, 0]


def test_sainte_lague_by_hand():
    assert mixing.sainte_lague([53000.0, 24000.0, 23000.0], 7) == [3, 2, 2]
    assert mixing.sainte_lague([1.0, 1.0], 1) == [1, 0]
    assert sum(mixing.sainte_lague([5.0, 2.0, 1.0, 1.0], 1000)) == 1000


def test_mix(spark):
    rows = [(i, f"s{i % 4}" if i % 5 else None, i % 97 * 3) for i in range(2000)] + [(3000, "s1", None), (3001, "s1", 5000), (3001, "s1", 5000)]
    d = texts(spark, *rows)
    a, b = (sorted(map(tuple, mixing.mix_digest(x).collect())) for x in (d, d.repartition(9)))
    assert a == b and len(a) == len(rows)
    per = collections.defaultdict(lambda: [0, 0.0])
    source = {i: s for i, s, _ in rows}
    for doc_id, size, _, target, taken in a:
        assert 0 <= taken <= 2 * size
        per[source[doc_id]][0] += taken
        per[source[doc_id]][1] = target
    for taken, target in per.values():
        assert abs(taken - target) <= max(64, 0.01 * target)


def test_mix_of_nothing(spark):
    assert mixing.mix(texts(spark).where("false")).count() == 0
    r = mixing.mix_digest(texts(spark, (1, None, None), (2, "a", 0))).collect()
    assert {tuple(x) for x in r} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_words_are_counted_by_the_same_pattern(spark):
    d = spark.createDataFrame([(1, "s", "a b\x1cc \t\x0bd\x0c\re")], "doc_id long, source string, text string")
    assert mixing.mix(d).first()["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", "a b\x1cc \t\x0bd\x0c\re"))


def test_emptied_documents_may_go(spark):
    rows = [(1, LONG), (2, LONG + "\n\n  "), (3, LONG), (4, None), (5, ""), (6, " \n"), (None, LONG), (7, LONG + "\nown"), (7, LONG + "\nown"), (2, LONG + "\n\n  ")]
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, __d int, __keep int, ___n int, _ID int")
    out = line_dedup.dedup_lines(d, drop_emptied=True)
    assert out.schema == d.schema
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, [(4, None), (5, ""), (6, " \n"), (None, LONG), (7, LONG + "\nown"), (7, LONG + "\nown")]))
    assert line_dedup.dedup_lines(d).count() == len(rows) and line_dedup.dedup_lines(d.where("false"), drop_emptied=True).count() == 0

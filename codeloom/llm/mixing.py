"""Mixing sources to target weights (operator 8): Sainte-Lague quotas of equal-token blocks.

Sources split a token budget by weight, no source beyond ``max_repeats`` times
its own size (the excess is shared again).  The budget is dealt out in blocks
of ``block`` tokens to sources by highest quotients, then within each source to
its shards (hash-salted, so that a hot source is many small groups).  A shard
lays its documents end to end in seeded order, cuts the line into blocks and
takes its quota of them by a seeded permutation; a document's share is what
the taken blocks cover of it.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import stage

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Primes above 2**30: k * prime + c runs through every block of a shard of fewer than 2**30 blocks once.
PRIMES = (1073741827, 1073741831, 1073741833, 1073741839, 1073741843, 1073741857, 1073741891, 1073741909)
#: One row a source goes to the driver; beyond this many, sources must be grouped first.
MAX_SOURCES = 1 << 22
BROADCAST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], total: float, max_repeats: int = 2) -> list[float]:
    """``total`` shared by weight, none above ``max_repeats`` times its size, the excess reshared until none is above."""
    capped = [False] * len(sizes)
    while True:
        rest = total - sum(max_repeats * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        level = rest / weight if weight else 0.0
        more = [i for i, c in enumerate(capped) if not c and weights[i] * level > max_repeats * sizes[i]]
        if not more:
            return [float(max_repeats * s) if c else w * level for s, w, c in zip(sizes, weights, capped)]
        for i in more:
            capped[i] = True


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Highest quotients votes / (2k + 1); of equal ones the earlier party's first."""
    import heapq

    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    out = [max(0, floor(v * seats / total) - len(votes) // 2 - 2) for v in votes]  # never above the final quota
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, out))]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _hash(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols]))


def _number(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 2, block: int = 32, shard_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """Per row of ``docs`` (``doc_id, source, text``): ``doc_id, source, size, source_size, target, quota_blocks, taken``.

    Size: words of the text (null or empty: 0; such rows take 0).  Sources in
    code point order, null last, get ``weights`` in turn.  ``taken`` is at most
    ``max_repeats * size``; a source's sum is within a few blocks of its
    target.  The same seed gives the same result.  Rows that repeat a
    ``doc_id`` are rows of their own; a null ``doc_id`` is allowed.  An empty
    table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stage.written(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    found = sorted(((r["source"], r["source_size"]) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), max_repeats)
    seats = floor(sum(goal) / block + 0.5)
    quota = sainte_lague(goal, seats)
    table = [(n, n is None, s, t, q, max(1, -(-s // shard_tokens))) for (n, s), t, q in zip(found, goal, quota)]
    sources = spark.createDataFrame(table, "source string, no_source boolean, source_size long, target double, seats long, shards long").drop("no_source")
    if len(table) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)

    d = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "inner").select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.seats", "s.shards")
    empty = d.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("quota_blocks"), F.lit(0).cast("long").alias("taken"))
    d = d.where("size > 0").withColumn("h", _hash(seed, F.col("doc_id"))).withColumn("shard", F.pmod(_number(F.col("h")), F.col("shards")))

    # quotas of shards: from just below the exact share, the highest quotients win
    votes = d.groupBy("source", "shard").agg(F.sum("size").alias("w"), F.first("source_size").alias("source_size"), F.first("seats").alias("seats"))
    base = F.greatest(F.lit(0), F.floor(F.col("seats") * F.col("w") / F.col("source_size")) - 2)
    bids = votes.withColumn("base", base).withColumn("open", F.col("seats") - F.sum("base").over(Window.partitionBy("source")))
    bids = bids.withColumn("k", F.explode(F.sequence(F.col("base"), F.col("base") + 5)))
    bids = bids.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.col("w") / (F.col("k") * 2 + 1)), "shard", "k")))
    quotas = bids.groupBy("source", "shard").agg(F.first("w").alias("w"), (F.first("base") + F.sum(F.when(F.col("rank") <= F.col("open"), 1).otherwise(0))).alias("q"))
    n = F.ceil(F.col("w") / block)
    quotas = quotas.select("source", "shard", n.alias("n"), F.least(F.col("q"), n * max_repeats).cast("long").alias("q"), _hash(seed, F.col("source"), F.col("shard")).alias("sh"))
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(_number(F.col("sh")), F.lit(len(PRIMES))) + 1).cast("int"))
    quotas = quotas.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "n", "q", prime.cast("long").alias("prime"), F.pmod(_number(F.substring("sh", 9, 8)), F.col("n")).alias("shift"))

    w = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("b", F.sum("size").over(w)).join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    a = F.col("b") - F.col("size")
    whole, extra = F.floor(F.col("q") / F.col("n")), F.pmod(F.col("q"), F.col("n"))

    def covered(acc: Column, k: Column) -> Column:
        inside = F.least(F.col("b"), (k + 1) * block) - F.greatest(a, k * block)
        return acc + F.when(F.pmod(k * F.col("prime") + F.col("shift"), F.col("n")) < extra, inside).otherwise(F.lit(0).cast("long"))

    more = F.aggregate(F.sequence(F.floor(a / block), F.floor((F.col("b") - 1) / block)), F.lit(0).cast("long"), covered)
    taken = (whole * F.col("size") + more).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", F.col("q").alias("quota_blocks"), taken.alias("taken")).unionByName(empty)


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), c AS (  -- sources in the order in which they reach their limit; the level if those before are limited
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS full_before, coalesce(sum(w) OVER o, 0) AS w_before,
         sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w
  FROM s WINDOW o AS (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT min_by((1.5 * all_size - full_before) / (all_w - w_before), w_before) AS level FROM c
  WHERE w * ((1.5 * all_size - full_before) / (all_w - w_before)) <= 2 * source_size
), t AS (
  SELECT s.*, CASE WHEN w * level > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * level END AS target,
         greatest(1, CAST(ceil(source_size / 1048576.0) AS BIGINT)) AS shards FROM s, lv
), h AS (SELECT CAST(floor(sum(target) / 32 + 0.5) AS BIGINT) AS seats, sum(target) AS goal, count(*) AS n FROM t
), b0 AS (SELECT t.*, h.seats AS seats_all, greatest(0, CAST(floor(target * h.seats / h.goal) AS BIGINT) - h.n // 2 - 2) AS base FROM t, h
), b1 AS (SELECT *, seats_all - sum(base) OVER () AS open, unnest(generate_series(base, base + (SELECT n FROM h) + 6)) AS k FROM b0
), b2 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, i, k) AS rank FROM b1
), q AS (SELECT source, any_value(base) + count(*) FILTER (rank <= open) AS seats FROM b2 GROUP BY source
), e AS (
  SELECT d.*, t.source_size, t.target, q.seats, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), chr(0))) AS h,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 8) AS BIGINT) % t.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN q ON d.source IS NOT DISTINCT FROM q.source
), v AS (
  SELECT source, shard, sum(size) AS w, any_value(seats) AS seats, any_value(source_size) AS source_size FROM e WHERE size > 0 GROUP BY source, shard
), v0 AS (SELECT *, greatest(0, CAST(floor(CAST(seats AS DOUBLE) * w / source_size) AS BIGINT) - 2) AS base FROM v
), v1 AS (SELECT *, seats - sum(base) OVER (PARTITION BY source) AS open, unnest(generate_series(base, base + 5)) AS k FROM v0
), v2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CAST(w AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS rank FROM v1
), v3 AS (
  SELECT source, shard, CAST(ceil(any_value(w) / 32.0) AS BIGINT) AS n, any_value(base) + count(*) FILTER (rank <= open) AS q0,
         md5('17:' || coalesce(source, chr(0)) || CAST(shard AS VARCHAR)) AS sh FROM v2 GROUP BY source, shard
), v4 AS (
  SELECT source, shard, n, least(q0, 2 * n) AS q, CAST('0x' || substr(sh, 9, 8) AS BIGINT) % n AS shift,
         [1073741827, 1073741831, 1073741833, 1073741839, 1073741843, 1073741857, 1073741891, 1073741909][CAST('0x' || substr(sh, 1, 8) AS BIGINT) % 8 + 1] AS prime FROM v3
), f AS (
  SELECT e.*, sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM e WHERE size > 0
), g AS (
  SELECT f.doc_id, f.size, f.source_size, f.target, f.b - f.size AS a, f.b, v4.*, unnest(generate_series(CAST((f.b - f.size) // 32 AS BIGINT), CAST((f.b - 1) // 32 AS BIGINT))) AS k
  FROM f JOIN v4 ON f.source IS NOT DISTINCT FROM v4.source AND f.shard = v4.shard
)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum((least(b, (k + 1) * 32) - greatest(a, k * 32)) * (q // n + CASE WHEN (k * prime + shift) % n < q % n THEN 1 ELSE 0 END)) AS BIGINT) AS taken
FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM e WHERE size = 0
"""

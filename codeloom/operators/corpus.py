"""Across files: coupling, call resolution, reachability and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.staging import written


def coupling(imports: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """Efferent (``key, ce``: distinct sources a file imports) and afferent (``source, ca``: distinct files that import it)."""
    pairs = imports.select(key, "source").distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("ce")), pairs.groupBy("source").agg(F.count("*").alias("ca"))


def resolve_calls(edges: DataFrame, functions: DataFrame, key: str = "file_id") -> DataFrame:
    """External calls with how many files define the callee (``definitions``; 0: unknown)."""
    defined = functions.where("name is not null").groupBy(F.col("name").alias("callee")).agg(F.count_distinct(key).alias("definitions"))
    return edges.where("is_external").join(defined, "callee", "left").withColumn("definitions", F.coalesce("definitions", F.lit(0)).cast("long"))


#: Distinct edges (two strings each) up to which one task may hold the whole graph; larger ones are closed and coloured by joins.
TASK_EDGES = 1 << 18


def _edges(edges: DataFrame) -> DataFrame:
    return written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")


def _adjacency(pairs: list) -> dict:
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``start, node`` for every node reachable from each start (``start``) over ``src -> dst``, in at most ``max_rounds`` + 1 steps if given.

    A graph of at most ``TASK_EDGES`` edges travels to the starts, which are
    searched breadth first in parallel.  A larger one is closed semi-naively:
    only pairs found in the last round are joined again; every round is written
    by itself, so lineage stays flat and a lost executor costs one round.
    """
    spark = edges.sparkSession
    e = _edges(edges)
    first = starts.select("start").where("start is not null").distinct()
    if e.count() <= TASK_EDGES:
        graph = spark.sparkContext.broadcast(_adjacency([(r["src"], r["dst"]) for r in e.collect()]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to = graph.value
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    seen: dict = {}
                    front, rounds = [s], -1
                    while front and (max_rounds is None or rounds < max_rounds):
                        front = [n for n in dict.fromkeys(n for f in front for n in to.get(f, ())) if n not in seen]
                        seen.update(dict.fromkeys(front))
                        rounds += 1
                    yield pa.record_batch({"start": pa.array([s] * len(seen), batch.schema.field(0).type), "node": pa.array(list(seen), batch.schema.field(0).type)})

        kind = e.schema["dst"].dataType.simpleString()
        return first.select(F.col("start").cast(kind)).repartition("start").mapInArrow(search, f"start {kind}, node {kind}")
    new = written(first.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct(), "closure")
    seen, rounds = new, 0
    while (max_rounds is None or rounds < max_rounds) and new.limit(1).count():
        step = new.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = written(step.join(seen, ["start", "node"], "left_anti"), "closure")
        seen = seen.unionByName(new)
        rounds += 1
    return seen


def _components(pairs: list) -> list:
    """Nodes on cycles, by Tarjan's algorithm with a stack of its own."""
    to = _adjacency(pairs)
    index: dict = {}
    low: dict = {}
    stack: list = []
    held: set = set()
    out: list = []
    for root in to:
        if root in index:
            continue
        work = [(root, iter(to[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while work:
            node, nexts = work[-1]
            for n in nexts:
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    held.add(n)
                    work.append((n, iter(to.get(n, ()))))
                    break
                if n in held:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        held.discard(part[-1])
                    if len(part) > 1 or node in to.get(node, ()):
                        out += part
    return out


def _spread(labels: DataFrame, e: DataFrame, source: str, target: str) -> DataFrame:
    """``node, label``: the least label of all nodes from which each can be reached (by ``source`` -> ``target``)."""
    while True:
        heard = labels.join(e, F.col("node") == F.col(source)).select(F.col(target).alias("node"), "label")
        new = written(labels.select("node", "label").unionByName(heard).groupBy("node").agg(F.min("label").alias("label")), "labels")
        changed = new.join(labels.select("node", F.col("label").alias("old")), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """``node``: everything that reaches itself.

    Nodes without an edge in or out are trimmed until none is left.  What
    remains is one task's work if it has at most ``TASK_EDGES`` edges.  A larger
    graph is coloured: every node takes the least node that reaches it; those of
    a colour that reach its namesake are a component.  They go, and so on with
    the rest.
    """
    e = _edges(edges)
    kind = e.schema["dst"].dataType.simpleString()
    found = e.where("src = dst").select(F.col("src").alias("node"))
    n = e.count()
    while n > TASK_EDGES:
        inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = written(inner.select("src", "dst"), "edges")
        left = e.count()
        if left < n:
            n = left
            continue
        nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
        colour = _spread(nodes.withColumn("label", F.col("node")), e, "src", "dst")
        both = e.join(colour.select(F.col("node").alias("src"), F.col("label").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("d")), "dst")
        own = written(both.where("c = d").select("src", "dst", "c"), "edges")
        # within a colour, which nodes reach the one that it is named after
        back = _spread(colour.select("node", F.when(F.col("node") == F.col("label"), F.lit(0)).otherwise(F.lit(1)).alias("label")), own, "dst", "src")
        part = back.where("label = 0").join(colour.withColumnRenamed("label", "c"), "node")
        sizes = part.groupBy("c").agg(F.count("*").alias("size")).where("size > 1")
        found = written(found.unionByName(part.join(sizes, "c", "left_semi").select("node")), "cycles")
        done = part.select(F.col("node").alias("gone"))
        e = written(both.where("c = d").select("src", "dst").join(done, F.col("src") == F.col("gone"), "left_anti").join(done, F.col("dst") == F.col("gone"), "left_anti"), "edges")
        n = e.count()

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        got = _components(pairs)
        if got:
            yield pa.record_batch({"node": pa.array(got)})

    return found.unionByName(e.select("src", "dst").coalesce(1).mapInArrow(small, f"node {kind}")).distinct()

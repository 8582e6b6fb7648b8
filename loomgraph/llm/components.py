"""Connected components of an undirected graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that a task closes to stars at a time.
CHUNK = 200_000


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node reachable.

    The graph is contracted until no edge is left. First each task turns its own edges, `chunk` at a time, into stars
    around their least node, which never makes more edges than there were. Then, in rounds, every node goes over to
    one of itself and its neighbours: the least in odd rounds, which ends a star at once, and the least by a hash of
    the round in even ones, which leaves at most three quarters of the nodes on average whatever the graph's form. An
    edge is renamed to where its ends went and goes when they meet, so the rows of each round only shrink. The rounds'
    choices, followed from the last to the first, give every node's component. A round is written to the shared
    folder, which cuts its lineage; a node with many neighbours meets them in a partial aggregation, not in one list;
    the driver sees counts only. Self loops are allowed; null ends are left out.
    """
    once = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    once = once.mapInArrow(_stars(chunk), "a long, b long").distinct()
    both = written(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    nodes = both.select(F.col("a").alias("node")).distinct()
    left, chosen = both.where("a <> b"), []
    while not left.isEmpty():
        turn = len(chosen)
        by = F.col("b") if turn % 2 == 0 else F.xxhash64("b", F.lit(turn))
        own = F.struct((F.col("a") if turn % 2 == 0 else F.xxhash64("a", F.lit(turn))).alias("by"), F.col("a").alias("to"))
        near = left.groupBy("a").agg(F.min(F.struct(by.alias("by"), F.col("b").alias("to"))).alias("n"))
        to = written(near.select(F.col("a").alias("node"), F.least(own, F.col("n"))["to"].alias("to")), "moves")
        chosen.append(to)
        first = to.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        second = to.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = left.join(first, "a").join(second, "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        left = written(moved.distinct(), "edges")
    if not chosen:
        return written(nodes.select("node", F.col("node").alias("root")), "roots")
    label = chosen.pop()
    while chosen:
        later = label.select(F.col("node").alias("to"), F.col("to").alias("last"))
        label = written(chosen.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to")), "labels")
    # the component's name so far is any of its nodes; nodes with self loops only are their own
    least = label.groupBy("to").agg(F.min("node").alias("root"))
    named = label.join(least, "to").select("node", "root")
    return written(nodes.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")


def _stars(chunk: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def star(ends: list[pa.RecordBatch]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in ends:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = [x for x, up in root.items() if up != x]
        hubs = {find(x) for x in nodes}
        alone = [x for x, up in root.items() if up == x and x not in hubs]  # self loops
        return pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes] + alone, pa.int64()), pa.array(nodes + alone, pa.int64())], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                held.append(part)
                n += part.num_rows
                if n >= chunk:
                    yield star(held)
                    held, n = [], 0
        if held:
            yield star(held)

    return run

"""Bounded breadth-first searches over code, level by level: one join a level for the whole frontier."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .index import blocks, bounds, callees, callers, first_definition, function_name

SPAN = ["path", "start0", "end0"]


def reach(seeds: DataFrame, edges: DataFrame, depth: int, visited: DataFrame | None = None) -> DataFrame:
    """(node, depth) of the nodes of edges(src, dst) within `depth` steps of seeds(node), each at its least depth; nodes of visited(node) are neither passed nor returned."""
    frontier = written(seeds.select("node").distinct(), "frontier")
    seen = frontier if visited is None else frontier.unionByName(visited.select("node"))
    out = frontier.withColumn("depth", F.lit(0))
    edges = written(edges.select("src", "dst").distinct(), "edges") if depth > 1 else edges
    for level in range(1, depth + 1):
        step = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        out = out.unionByName(frontier.withColumn("depth", F.lit(level)))
    return out


def spans_of(hits: DataFrame, lines: DataFrame, shape: DataFrame) -> DataFrame:
    """hits(path, line_no, ...) with the enclosing span and its name; lines at or below 0 have none."""
    found = bounds(hits.where("line_no > 0"), shape)
    named = blocks(found.select(*SPAN).distinct(), lines).withColumn("func", function_name(F.col("code"), F.col("start0"), F.col("end0")))
    return found.join(named.select(*SPAN, "func"), SPAN)


def trace_callers(seeds: DataFrame, lines: DataFrame, toks: DataFrame, defs: DataFrame, shape: DataFrame, depth: int = 1, extra: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Callers of seeds(path, start0, end0, func) up to `depth`, and all spans visited.

    Every mention found is returned at its distance, also in a span already visited; only unseen spans go on to the
    next level. extra(name, path, line_no, code) adds mentions from elsewhere, such as macro expansion, one a line.
    """
    frontier, visited, found = seeds.select(*SPAN, "func").distinct(), seeds.select(*SPAN).distinct(), None
    for level in range(depth):
        names = frontier.select(F.col("func").alias("name"))
        hits = callers(names, toks, defs)
        if extra is not None:
            more = extra.join(names.distinct(), "name", "left_semi").join(hits, ["name", "path", "line_no"], "left_anti")
            hits = hits.unionByName(more.select(*hits.columns))
        hits = written(hits.withColumn("distance", F.lit(level + 1)), "callers")
        found = hits if found is None else found.unionByName(hits)
        spans = spans_of(hits.select("path", "line_no").distinct(), lines, shape).select(*SPAN, "func").distinct()
        frontier = written(spans.join(visited, SPAN, "left_anti"), "frontier")
        visited = visited.unionByName(frontier.select(*SPAN))
        if frontier.isEmpty():
            break
    return found, visited


def trace_callees(seeds: DataFrame, visited: DataFrame, lines: DataFrame, defs: DataFrame, shape: DataFrame, depth: int = 1) -> DataFrame | None:
    """(func, path, start0, end0, source, distance) of the functions that seeds(path, start0, end0) call, up to `depth`; spans in visited, the seeds and the callers found before, are left out."""
    frontier, found = seeds.select(*SPAN).distinct(), None
    calls = callees(lines)
    for level in range(depth):
        inside = frontier.withColumn("line_no", F.explode(F.sequence((F.col("start0") + 1).cast("long"), F.greatest(F.col("end0"), F.col("start0") + 1).cast("long"))))
        names = calls.join(inside.select("path", "line_no").distinct(), ["path", "line_no"], "left_semi").select("name").distinct()
        at = bounds(first_definition(names, defs), shape).select(*SPAN, F.col("name").alias("func"))
        new = at.join(visited, SPAN, "left_anti").groupBy(*SPAN).agg(F.min("func").alias("func"))
        new = written(blocks(new, lines).select("func", *SPAN, "source").withColumn("distance", F.lit(level + 1)), "callees")
        found = new if found is None else found.unionByName(new)
        frontier = new.select(*SPAN)
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found


def inherited(classes: DataFrame, parents: DataFrame, depth: int | None = None) -> DataFrame:
    """(name, ancestor, depth) for classes(name) over parents(name, parent): least depth, cycles cut, the class itself at 0; with depth, no level beyond it."""
    frontier = written(classes.select("name", F.col("name").alias("ancestor")).distinct(), "frontier")
    seen, out = frontier, frontier.withColumn("depth", F.lit(0))
    up = parents.select(F.col("name").alias("ancestor"), F.col("parent").alias("next"))
    for level in count(1) if depth is None else range(1, depth + 1):
        step = frontier.join(up, "ancestor").select("name", F.col("next").alias("ancestor")).distinct()
        frontier = written(step.join(seen, ["name", "ancestor"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        out = out.unionByName(frontier.withColumn("depth", F.lit(level)))
    return out


def searched(classes: DataFrame, parents: DataFrame) -> DataFrame:
    """(name, ancestor, trail) for classes(name) over parents(name, parent, at): the order in which a depth-first search meets each ancestor, as the places of the parents on the way; trails compare as arrays, the class's own is empty.

    An ancestor that several ways lead to keeps the earliest one, so a later level may still improve it; what doesn't
    improve goes no further, which also ends cycles.
    """
    best = written(classes.select("name", F.col("name").alias("ancestor")).distinct().withColumn("trail", F.array().cast("array<int>")), "trails")
    frontier = best
    up = written(parents.groupBy(F.col("name").alias("ancestor"), F.col("parent").alias("next")).agg(F.min(F.col("at").cast("int")).alias("at")), "parents")
    while True:
        step = frontier.join(up, "ancestor").groupBy("name", F.col("next").alias("ancestor")).agg(F.min(F.concat("trail", F.array("at"))).alias("trail"))
        known = best.select("name", "ancestor", F.col("trail").alias("was"))
        frontier = written(step.join(known, ["name", "ancestor"], "left").where("was is null or trail < was").drop("was"), "frontier")
        if frontier.isEmpty():
            return best
        best = written(best.unionByName(frontier).groupBy("name", "ancestor").agg(F.min("trail").alias("trail")), "trails")

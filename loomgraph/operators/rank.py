"""Ranking, top-k, pruning and packing."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import by_name, omission_comment
from ..functions.stripping import stripper
from ..runtime import written

TOP = 15
PRUNED = "[Pruned Instances]"


def closeness(path: Column, target: Column) -> Column:
    """struct(category, distance): 0 the same file, 1 the same folder, 2 elsewhere by steps in the tree, 3 on another drive, 4 no path."""
    a, b = (F.slice(F.split(x, "/"), 1, F.greatest(F.size(F.split(x, "/")) - 1, F.lit(0))) for x in (path, target))
    least = F.least(F.size(a), F.size(b))
    equal = F.transform(F.sequence(F.lit(0), least), lambda i: (i == least) | (F.get(a, i) != F.get(b, i)))
    common = F.array_position(equal, True) - 1
    far = F.size(a) + F.size(b) - 2 * common
    drive = lambda x: F.lower(F.regexp_extract(x, r"^(?:file:/*)?([A-Za-z]:)[\\\\/]", 1))
    category = F.when(path.isNull() | (path == ""), 4).when(path == target, 0).when(F.array_join(a, "/") == F.array_join(b, "/"), 1).when(drive(path) != drive(target), 3).otherwise(2)
    return F.struct(category.alias("category"), F.when(category == 2, far).otherwise(0).cast("int").alias("distance"))


def closest(refs: DataFrame, k: int = TOP) -> DataFrame:
    """refs(func, target, path, line_no, seq, code) cut to the k closest of each func, with a sentinel row that counts those left out. Ranks beyond k are dropped before the shuffle."""
    near = closeness(F.col("path"), F.col("target"))
    rank = F.row_number().over(Window.partitionBy("func").orderBy(near["category"], near["distance"], "seq"))
    kept = refs.withColumn("rank", rank).where(F.col("rank") <= k).select("func", "path", "line_no", "code", "rank")
    more = refs.groupBy("func").count().where(F.col("count") > k)
    note = more.select("func", F.lit(PRUNED).alias("path"), F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("omitted "), (F.col("count") - k).cast("string")).alias("code"), F.lit(k + 1).alias("rank"))
    return kept.unionByName(note)


def running(items: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """items with `sofar`, the sum of value over the rows before and the row itself, in two levels: ranges of the order are summed each and only their totals meet, so that no task gets all rows."""
    parts = max(1, items.sparkSession.sparkContext.defaultParallelism)
    ranged = items.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    inside = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "part").agg(F.sum(value).alias("t")).withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    out = ranged.withColumn("own", F.sum(value).over(inside))
    joined = out.join(totals, [*group, "part"])
    return joined.withColumn("sofar", F.col("own") + F.col("base")).drop("own", "base", "part")


def sticky_pack(items: DataFrame, budget: int, start: int = 0) -> DataFrame:
    """items(section, ord, header, text) that fit: in order, a section's header charged with its first item, and nothing after the first that overflows. bytes is the running total."""
    first = F.broadcast(items.groupBy("section").agg(F.min("ord").alias("least")))  # one row a section
    sized = items.join(first, "section").withColumn("cost", F.octet_length("text") + F.when(F.col("ord") == F.col("least"), F.octet_length("header")).otherwise(0)).drop("least")
    # a prefix sum only grows, so what fits is what lies before the first overflow
    return running(sized, [], ["section", "ord"], "cost").withColumn("bytes", F.col("sofar") + start).where(F.col("bytes") <= budget).drop("sofar", "cost")


def pack_groups(items: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """The rows of each group before its running bytes go over the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("bytes", F.sum(F.octet_length(text)).over(w)).where(F.col("bytes") <= budget)


def upgrades(full: Column, least: Column, limit: Column) -> Column:
    """array<boolean>: which of the groups with full and least line counts are shown whole, in order, as what remains of the limit allows; one that doesn't fit is skipped."""
    zero = F.struct((limit - F.aggregate(least, F.lit(0), lambda a, x: a + x)).alias("left"), F.array().cast("array<boolean>").alias("up"))

    def step(a, x):
        cost = x["full"] - x["least"]
        fits = cost <= a["left"]
        return F.struct((a["left"] - F.when(fits, cost).otherwise(0)).alias("left"), F.concat(a["up"], F.array(fits)).alias("up"))

    return F.aggregate(F.transform(full, lambda x, i: F.struct(x.alias("full"), F.get(least, i).alias("least"))), zero, step, lambda a: a["up"])


def truncated(text: Column, limit: int, comment: Column) -> Column:
    """The first `limit` lines and an omission comment; shorter texts as they are."""
    lines = F.split(text, "\n", -1)
    return F.when(F.size(lines) <= limit, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, limit), "\n"), F.lit("\n"), comment))


def prune_block(source: str, lang: str, limit: int) -> tuple[str, str]:
    """(suffix, text) of a block cut to `limit` lines. Blocks in Python, and in languages with braces, keep every definition's signature and as many bodies as fit; others, and what doesn't parse, keep their first lines."""
    limit = max(1, limit)
    lines = source.split("\n")
    if len(lines) <= limit:
        return "", source
    language = by_name(lang)
    groups = _python_groups(source, lines) if lang == "python" else _brace_groups(source, lines, language) if language.block else None
    if not groups:
        return " (Truncated)", "\n".join([*lines[:limit], omission_comment(language, "Truncated")])
    spare = limit - sum(len(short) for _, short in groups)
    out: list[str] = []
    if spare < 0:
        for _, short in groups:
            out += short[: max(0, limit - 1 - len(out))]
        pad = out[-1][: len(out[-1]) - len(out[-1].lstrip())] if out else ""
        return " (AST Semantically Pruned)", "\n".join([*out, pad + omission_comment(language, "Remaining Methods Omitted")])
    for whole, short in groups:
        cost = len(whole) - len(short)
        fits = cost <= spare
        out += whole if fits else short
        spare -= cost if fits else 0
    return " (AST Semantically Pruned)", "\n".join(out)


def _python_groups(source: str, lines: list[str]) -> list[tuple[list[str], list[str]]] | None:
    """Each top-level statement (of a lone class: its members) in full and at its least."""
    try:
        body = ast.parse(source).body
    except SyntaxError:
        return None
    out, at = [], 0
    if len(body) == 1 and isinstance(body[0], ast.ClassDef):
        at = body[0].body[0].lineno - 1 - len(getattr(body[0].body[0], "decorator_list", []))
        out.append((lines[:at], lines[:at]))
        body = body[0].body
    for i, node in enumerate(body):
        end = body[i + 1].lineno - 1 - len(getattr(body[i + 1], "decorator_list", [])) if i + 1 < len(body) else len(lines)
        whole = lines[at:end]
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            head = lines[at : max(at + 1, node.body[0].lineno - 1)]
            pad = " " * node.body[0].col_offset
            short = [*head, f"{pad}# ... [Body Omitted] ...", f"{pad}pass"]
        else:
            short = whole[:5]
        out.append((whole, short if len(short) < len(whole) else whole))
        at = end
    return out


def _brace_groups(source: str, lines: list[str], language) -> list[tuple[list[str], list[str]]] | None:
    """Each top-level block (of a lone one that holds others: its members) in full and at its least: what comes before its brace, an omission and its last line. None where braces don't pair."""
    scanner = stripper(language)
    clean = [scanner.line(x) for x in scanner.whole(source).split("\n")]
    depth, at = [0], 0
    for x in clean:
        depth.append(depth[-1] + x.count("{") - x.count("}"))
    if depth[-1] or min(depth) < 0 or max(depth) < 1:
        return None

    def parts(first: int, last: int, base: int) -> list[tuple[int, int]]:
        """Ranges of lines that end where the depth is back at base after a brace."""
        found, start, deep = [], first, False
        for i in range(first, last):
            deep = deep or depth[i + 1] > base or "{" in clean[i]
            if deep and depth[i + 1] <= base:
                found.append((start, i + 1))
                start, deep = i + 1, False
        return [*found, (start, last)] if start < last else found

    out = []
    top = parts(0, len(lines), 0)
    if len(top) == 1:
        opens = next(i for i, x in enumerate(clean) if "{" in x)
        inner = parts(opens + 1, len(lines) - 1, 1)
        if len(inner) < 2:
            return None
        out.append((lines[: opens + 1], lines[: opens + 1]))
        top, at = inner, len(lines) - 1
    for a, b in top:
        whole = lines[a:b]
        opens = next((i for i in range(a, b) if "{" in clean[i]), None)
        short = whole[:5]
        if opens is not None and b - opens > 3:
            pad = lines[opens][: len(lines[opens]) - len(lines[opens].lstrip())] + "    "
            short = [*lines[a : opens + 1], pad + omission_comment(language, "Body Omitted"), lines[b - 1]]
        out.append((whole, short if len(short) < len(whole) else whole))
    return [*out, (lines[at:], lines[at:])] if at else out


def prune_blocks(source: Column, lang: Column, limit: int) -> Column:
    """struct(suffix, text) of prune_block, in Arrow batches."""

    @F.pandas_udf("struct<suffix:string,text:string>")
    def run(s: pd.Series, x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prune_block(a or "", b, limit) for a, b in zip(s, x, strict=True)], columns=["suffix", "text"])

    return run(source, lang)

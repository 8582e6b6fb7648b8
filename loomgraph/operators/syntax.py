"""Python by its syntax tree, from the standard library: bounds, calls, variables and assigned names of files that parse.

Where a file doesn't parse, or is in another language, the lexical operators of `index` and `resolve` serve; the
functions here named *_or_lexical choose by file.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import CALLEE_IGNORED, bounds, callees
from .resolve import identifiers

_FACT = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line_no", pa.int64()), ("end_line", pa.int64()), ("utf16", pa.int32()), ("stored", pa.bool_())])
FACTS = "path string, kind string, name string, line_no long, end_line long, utf16 int, stored boolean"


def facts(content: str) -> list[tuple] | None:
    """(kind, name, line, end line, UTF-16 offset, stored) of a Python text: `def` its functions and classes, `call` what is called, `name` its variables. None if it doesn't parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = content.split("\n")

    def place(line: int, column: int) -> int:
        """A place in UTF-16 units; ast counts bytes of UTF-8."""
        return len(lines[line - 1].encode()[:column].decode(errors="ignore").encode("utf-16-le")) // 2

    out, called = [], set()
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            head = re.search(rf"\b(?:def|class)\s+(?={re.escape(node.name)}\b)", lines[node.lineno - 1])
            out.append(("def", node.name, node.lineno, node.end_lineno, len(lines[node.lineno - 1][: head.end()].encode("utf-16-le")) // 2 if head else node.col_offset, False))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name | ast.Attribute):
                called.add(id(f))
                # an attribute's name ends where the attribute does
                out.append(("call", f.id if isinstance(f, ast.Name) else f.attr, f.end_lineno, f.end_lineno, place(f.end_lineno, f.end_col_offset) - len(f.id if isinstance(f, ast.Name) else f.attr), False))
        elif isinstance(node, ast.arg):
            out.append(("name", node.arg, node.lineno, node.lineno, place(node.lineno, node.col_offset), True))
    out += [("name", n.id, n.lineno, n.lineno, place(n.lineno, n.col_offset), not isinstance(n.ctx, ast.Load)) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called]
    return out


def syntax(files: DataFrame) -> DataFrame:
    """facts() of the Python files of files(path, lang, content), and one row of kind `parsed` for each that parses."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = facts(content or "")
                if found is not None:
                    rows = [(path, *r) for r in [("parsed", "", 0, 0, 0, False), *found]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FACT, strict=True)], schema=_FACT)

    return files.where("lang = 'python'").select("path", "content").mapInArrow(run, FACTS)


def syntax_bounds(targets: DataFrame, tree: DataFrame) -> DataFrame:
    """targets(path, line_no, ...) with start0, end0 and name of the innermost function or class around the line; those in none have no row. A definition offers the lines it holds, so this is an equi-join."""
    spans = tree.where("kind = 'def'").select("path", (F.col("line_no") - 1).cast("int").alias("start0"), F.col("end_line").cast("int").alias("end0"), "name", F.explode(F.sequence("line_no", "end_line")).alias("at"))
    spans = spans.join(targets.select("path", F.col("line_no").alias("at")).distinct(), ["path", "at"], "left_semi")
    inner = spans.groupBy("path", F.col("at").alias("line_no")).agg(F.max(F.struct("start0", "end0", "name")).alias("s"))
    return targets.join(inner, ["path", "line_no"]).select(*targets.columns, "s.start0", "s.end0", "s.name")


def syntax_callees(tree: DataFrame, ignored: tuple[str, ...] = CALLEE_IGNORED) -> DataFrame:
    """(path, line_no, name) of what each line calls."""
    return tree.where("kind = 'call'").where(~F.col("name").isin(*ignored)).select("path", "line_no", "name").distinct()


def syntax_identifiers(tree: DataFrame) -> DataFrame:
    """(path, line_no, name, utf16, stored) of the variables on each line at their first place there; stored: assigned, deleted or a parameter."""
    return tree.where("kind = 'name'").groupBy("path", "line_no", "name").agg(F.min("utf16").alias("utf16"), F.max("stored").alias("stored"))


def assigned(tree: DataFrame) -> DataFrame:
    """(path, line_no, name, utf16) of the names on the left of assignments, in loops, `with` and parameters."""
    return tree.where("kind = 'name' and stored").groupBy("path", "line_no", "name").agg(F.min("utf16").alias("utf16"))


def name_column(tree: DataFrame) -> DataFrame:
    """(path, line_no, name, utf16) of where each definition writes its name."""
    return tree.where("kind = 'def'").select("path", "line_no", "name", "utf16")


def bounds_or_lexical(targets: DataFrame, tree: DataFrame, shape: DataFrame) -> DataFrame:
    """targets with start0 and end0: by the tree where it has a block, else by indentation or braces."""
    first = syntax_bounds(targets, tree).drop("name")
    rest = targets.join(first.select("path", "line_no").distinct(), ["path", "line_no"], "left_anti")
    return first.unionByName(bounds(rest, shape).select(*first.columns))


def callees_or_lexical(lines: DataFrame, tree: DataFrame, ignored: tuple[str, ...] = CALLEE_IGNORED) -> DataFrame:
    """(path, line_no, name) of calls: by the tree in files that parse, by pattern in the others."""
    parsed = tree.where("kind = 'parsed'").select("path")
    return syntax_callees(tree, ignored).unionByName(callees(lines.join(parsed, "path", "left_anti"), ignored))


def identifiers_or_lexical(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, line_no, name, utf16) of variables on lines: by the tree in files that parse, by pattern in the others."""
    parsed = tree.where("kind = 'parsed'").select("path")
    own = syntax_identifiers(tree).drop("stored").join(lines.select("path", "line_no").distinct(), ["path", "line_no"], "left_semi")
    return own.unionByName(identifiers(lines.join(parsed, "path", "left_anti")).select("path", "line_no", "name", F.col("utf16").cast("int").alias("utf16")))

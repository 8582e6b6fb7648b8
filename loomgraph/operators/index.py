"""The code index: lines, tokens, file shapes, definitions and function bounds, each made once for all names."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import C_DEFINITION, C_MACRO, C_MACRO_PREFIX, CALLEE, CALLEE_IGNORED, DECLARATION, GENERIC_DEFINITION, NOT_A_NAME, by_name, definition_pattern, languages
from ..functions.stripping import strip_lines
from ..runtime import join_hint, written

TOKEN = r"operator\s*[^\sA-Za-z0-9_(]+|[A-Za-z_$][A-Za-z0-9_$]*"
#: Shorter names give nothing for callers, definitions and tests.
MIN_NAME = 3
#: Lines taken after the target if a brace block never closes, and before it if nothing is declared above.
OPEN_END, OPEN_START = 20, 10
#: Lines whose marks or spans a task holds as Python values, beyond one file's own.
SPAN_LINES = 50_000


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def indent(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of a text column, from line 1."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def code_lines(files: DataFrame) -> DataFrame:
    """lines(path, file_ord, lang, line_no, raw, stripped, clean) of files(path, file_ord, lang, content): one pass of the scanners a file."""
    each = files.select("path", "file_ord", "lang", F.posexplode(strip_lines(F.col("content"), F.col("lang"))).alias("at", "l"))
    return each.select("path", "file_ord", "lang", (F.col("at") + 1).cast("long").alias("line_no"), "l.raw", "l.stripped", "l.clean")


def tokens(lines: DataFrame) -> DataFrame:
    """(path, file_ord, lang, line_no, token, code) of every distinct token of a line's code: a search for any name is an equi-join with it."""
    found = F.array_distinct(F.regexp_extract_all("clean", F.lit(f"(~?)({TOKEN})"), F.lit(0)))
    # ~Name is a token of its own and one of Name
    found = F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda x: x.startswith("~")), lambda x: F.substring(x, 2, 1 << 20))))
    return lines.select("path", "file_ord", "lang", "line_no", F.explode(found).alias("token"), strip(F.col("stripped")).alias("code"))


def definitions(lines: DataFrame) -> DataFrame:
    """(name, path, file_ord, lang, line_no) of what each line defines, by its language's patterns; a C-style signature that ends in `;` is none."""
    c_style = [x.name for x in languages() if x.c_style]
    parts = [F.regexp_extract_all("clean", F.lit(definition_pattern(GENERIC_DEFINITION, by_name("python"))), F.lit(1))]
    for x in languages():
        for p in x.definitions:
            got = F.regexp_extract_all("clean", F.lit(definition_pattern(p, x)), F.lit(1))
            parts.append(F.when(F.col("lang") == x.name, got).otherwise(F.array().cast("array<string>")))
    signature = F.regexp_extract_all("clean", F.lit(definition_pattern(C_DEFINITION, by_name("c-family"))), F.lit(1))
    parts.append(F.when(F.col("lang").isin(*c_style) & ~strip(F.col("clean")).endswith(";"), signature).otherwise(F.array().cast("array<string>")))
    # a macro may define what it is given, as TEST(Suite, name) { does; in the C family any word between its brackets
    c_lang = F.col("lang").isin(*c_style) & ~strip(F.col("clean")).endswith(";")
    given = F.regexp_extract_all(F.regexp_extract("clean", C_MACRO, 1), F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    after = F.regexp_extract_all("clean", F.lit(definition_pattern(C_MACRO_PREFIX, by_name("c-family"))), F.lit(1))
    parts.append(F.when(c_lang & F.col("clean").rlike(C_MACRO), F.concat(given, after)).otherwise(F.array().cast("array<string>")))
    names = F.array_distinct(F.flatten(F.array(*parts)))
    return lines.where("lang <> 'unknown'").select(F.explode(names).alias("name"), "path", "file_ord", "lang", "line_no").where((F.col("name") != "") & ~F.col("name").isin(*NOT_A_NAME))


def first_definition(names: DataFrame, defs: DataFrame) -> DataFrame:
    """(name, path, line_no) of the first definition of each of names(name), by file order, path and line: an aggregate, not a sort."""
    long_ = names.select("name").where(F.length("name") >= MIN_NAME).distinct()
    first = defs.join(long_, "name", "left_semi").groupBy("name").agg(F.min(F.struct("file_ord", "path", "line_no")).alias("f"))
    return first.select("name", "f.path", "f.line_no")


def callers(names: DataFrame, toks: DataFrame, defs: DataFrame) -> DataFrame:
    """(name, path, line_no, code) of the lines that mention names(name) and don't define them."""
    long_ = names.select("name").where(F.length("name") >= MIN_NAME).distinct()
    hits = toks.where("lang <> 'unknown' and not endswith(path, '.md')").join(long_.withColumnRenamed("name", "token"), "token")
    hits = hits.select(F.col("token").alias("name"), "path", "line_no", "code")
    return hits.join(defs.select("name", "path", "line_no"), ["name", "path", "line_no"], "left_anti")


def callees(lines: DataFrame, ignored: tuple[str, ...] = CALLEE_IGNORED) -> DataFrame:
    """(path, line_no, name) of call-shaped names, without the ignored words."""
    got = F.array_distinct(F.regexp_extract_all("clean", F.lit(CALLEE), F.lit(1)))
    return lines.select("path", "line_no", F.explode(got).alias("name")).where(~F.col("name").isin(*ignored))


def shapes(lines: DataFrame) -> DataFrame:
    """One row a file: its lines' declarations, indents and braces, from which any bounds are read without another pass."""
    clean = F.col("clean")
    opens, closes = (F.length(clean) - F.length(F.replace(clean, F.lit(b))) for b in "{}")
    solid = (strip(F.col("stripped")) != "") & ~strip(F.col("stripped")).startswith("#")
    each = F.struct(F.col("line_no").cast("int").alias("no"), F.col("stripped").rlike(DECLARATION).alias("decl"), solid.alias("solid"), indent(F.col("stripped")).alias("indent"), (opens > 0).alias("opens"), (opens - closes).alias("net"), (strip(F.col("stripped")) != "").alias("text"))
    flat = [x.name for x in languages() if x.indentation]
    return lines.groupBy("path").agg(F.sort_array(F.collect_list(each)).alias("shape"), F.first(F.col("lang").isin(*flat)).alias("flat"))


def _file_spans(decl, solid, text, indent_, opens, net, flat: bool) -> tuple[list[int], list[int]]:
    """Of each line of a file the start and the end (half open from 0) of the block around it, from the lines' marks; the end is -1 where braces never close. One pass: an end is found once a start."""
    n = len(decl)
    starts, ends, known = [0] * n, [0] * n, {}
    if flat:  # the next line that is indented no further, for every line, by a stack from below
        after, stack = [n] * n, []
        for i in range(n - 1, -1, -1):
            while stack and indent_[stack[-1]] > indent_[i]:
                stack.pop()
            after[i] = stack[-1] if stack else n
            if solid[i]:
                stack.append(i)
    else:  # the depth before each line, and the least depth after any line from here on
        depth = [0] * (n + 1)
        for i in range(n):
            depth[i + 1] = depth[i] + net[i]
        least = [0] * n
        for i in range(n - 1, -1, -1):
            least[i] = depth[i + 1] if i == n - 1 else min(depth[i + 1], least[i + 1])
    last = 0 if n and text[0] else None
    for i in range(n):
        if decl[i]:
            last = i
        start = last if last is not None else max(0, i - OPEN_START)
        if start not in known:
            if flat:
                known[start] = after[start]
            else:
                end, at, open_ = -1, start, False
                while at < n and (not open_ or least[at] <= depth[start]):
                    open_ = open_ or opens[at]
                    if open_ and depth[at + 1] <= depth[start]:
                        end = at + 1
                        break
                    at += 1
                known[start] = end
        starts[i], ends[i] = start, known[start]
    return starts, ends


def line_spans(shape: DataFrame) -> DataFrame:
    """(path, line_no, start0, end0, size) of every line of the files of shape: the block around it, end0 -1 where braces never close."""
    schema = pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("start0", pa.int32()), ("end0", pa.int32()), ("size", pa.int32())])

    def files(batch):
        """Each file's path, marks and kind; the marks are read for several files at once, of SPAN_LINES lines or one file."""
        paths, flats, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
        sizes = [n or 0 for n in pa.compute.list_value_length(marks).to_pylist()]
        at = 0
        while at < len(paths):
            end, n = at + 1, sizes[at]
            while end < len(paths) and n + sizes[end] <= SPAN_LINES:
                n += sizes[end]
                end += 1
            own, first = marks.slice(at, end - at).flatten(), 0
            fields = [own.field(c).to_pylist() for c in ("decl", "solid", "text", "indent", "opens", "net")]
            for i in range(at, end):
                yield paths[i], [x[first : first + sizes[i]] for x in fields], flats[i]
                first += sizes[i]
            at = end

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    def run(batches):
        rows = [[] for _ in schema]
        for batch in batches:
            for path, marks, flat in files(batch):
                starts, ends = _file_spans(*marks, flat)
                for at in range(0, len(starts), SPAN_LINES):
                    n = len(starts[at : at + SPAN_LINES])
                    for c, x in zip(rows, ([path] * n, range(at + 1, at + n + 1), starts[at : at + n], ends[at : at + n], [len(starts)] * n), strict=True):
                        c += x
                    if len(rows[0]) >= SPAN_LINES:
                        yield table(rows)
                        rows = [[] for _ in schema]
        if rows[0]:
            yield table(rows)

    return shape.select("path", "shape", "flat").mapInArrow(run, "path string, line_no long, start0 int, end0 int, size int")


def bounds(targets: DataFrame, shape: DataFrame) -> DataFrame:
    """targets(path, line_no, ...) with start0 and end0 of the block around the line, half open from 0; lines outside the file have no row.

    The start is the nearest declaration at or above (or the file's first line); the end is where the indentation
    falls back, or the braces close. Each file that has a target is read once, and its lines' blocks are joined by
    equality, so the work is in proportion to files and targets, not to their product.
    """
    targets = written(targets, "targets")
    how = join_hint(targets)
    spans = line_spans(shape.join(targets.select("path").distinct().hint(how), "path", "left_semi"))
    open_end = F.least(F.col("size"), F.col("line_no").cast("int") - 1 + OPEN_END)
    return targets.hint(how).join(spans, ["path", "line_no"]).withColumn("end0", F.when(F.col("end0") < 0, open_end).otherwise(F.col("end0"))).drop("size")


def function_name(chunk: Column, start0: Column, end0: Column) -> Column:
    """The first declared name of a block's code; else its first call-shaped name that is no keyword; else its place."""
    declared = F.regexp_extract(chunk, r"\b(?:fn|def|function|sub|func|class|macro)\s+([A-Za-z0-9_]+)", 1)
    called = F.filter(F.regexp_extract_all(chunk, F.lit(r"(~?\b[A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda x: ~x.isin(*NOT_A_NAME))
    return F.coalesce(F.nullif(declared, F.lit("")), F.get(called, F.lit(0)), F.concat(F.lit("block_lines_"), start0.cast("string"), F.lit("_"), end0.cast("string")))


def blocks(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans(path, start0, end0, ...) with source and code (the block's raw and clean lines)."""
    spans = written(spans, "spans")
    inside = spans.select("path", "start0", "end0").distinct().withColumn("line_no", F.explode(F.sequence((F.col("start0") + 1).cast("long"), F.greatest(F.col("end0"), F.col("start0") + 1).cast("long"))))
    text = inside.hint(join_hint(inside)).join(lines.select("path", "line_no", "raw", "clean"), ["path", "line_no"]).groupBy("path", "start0", "end0")
    text = text.agg(F.sort_array(F.collect_list(F.struct("line_no", "raw", "clean"))).alias("l"))
    joined = reduce(lambda d, c: d.withColumn(c[0], F.array_join(F.transform("l", lambda x: x[c[1]]), "\n")), (("source", "raw"), ("code", "clean")), text).drop("l")
    return spans.hint(join_hint(spans)).join(joined, ["path", "start0", "end0"])

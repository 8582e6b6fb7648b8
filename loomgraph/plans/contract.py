"""Contract queries: the engine's operators over the driver tables, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.languages import CALLEE_IGNORED, IGNORED_DIRECTORIES, extension, fence_of, language_of
from ..operators import graph, index, linkage, rank, resolve, syntax
from ..runtime import ship, written
from ..sources import artifacts, diff, files
from .engine import ContextEngine, compare

QUERIES: dict = {}
ORACLE: dict = {}

WORD = r"[A-Za-z_][A-Za-z0-9_]*"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# A code corpus made of the tables: ten orders a file, each a function that calls the parts of its items.
CORPUS = """corpus AS (
  SELECT k // 10 AS f, concat('src/m', (k // 10) % 40, '/f', k // 10, '.py') AS path, line_no, text FROM (
    SELECT k, row_number() OVER (PARTITION BY k // 10 ORDER BY k, n, text) AS line_no, text FROM (
      SELECT o_orderkey AS k, 0 AS n, concat('def order_', o_orderkey, '():') AS text FROM orders
      UNION ALL SELECT l_orderkey, l_linenumber, concat('    part_', l_partkey, '()') FROM lineitem)))"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines(path, file_ord, lang, line_no, raw, stripped, clean) of the corpus."""
    heads = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("n"), F.concat(F.lit("def order_"), "o_orderkey", F.lit("():")).alias("text"))
    calls = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.concat(F.lit("    part_"), "l_partkey", F.lit("()")).alias("text"))
    rows = heads.unionByName(calls).withColumn("f", F.expr("k div 10"))
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("f").orderBy("k", "n", "text")).cast("long"))
    path = F.concat(F.lit("src/m"), (F.col("f") % 40).cast("string"), F.lit("/f"), F.col("f").cast("string"), F.lit(".py"))
    return rows.select(path.alias("path"), F.col("f").alias("file_ord"), F.lit("python").alias("lang"), "line_no", F.col("text").alias("raw"), F.col("text").alias("stripped"), F.col("text").alias("clean"))


def _joined(lines: DataFrame) -> DataFrame:
    """files(path, file_ord, lang, content) of lines."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n")
    return lines.groupBy("path", "file_ord", "lang").agg(text.alias("content"))


def _files(rows: DataFrame, path, content, order=None) -> DataFrame:
    return files.with_order(rows.select(path.alias("path"), content.alias("content"), (F.lit(0) if order is None else order).cast("int").alias("file_ord")))


def _lines(rows: DataFrame) -> DataFrame:
    """Lines of files, scanned once and written, since several joins read them. A narrow table has few tasks, so the files are dealt out before the scanners."""
    return written(index.code_lines(rows.repartition("path")), "lines")


# A chain of calls: each order's function calls that of half its number, ten orders a file.
CHAIN = """chain AS (SELECT o_orderkey AS k, concat('src/c', o_orderkey // 10, '.py') AS path, 2 * row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS line_no, concat('fn_', o_orderkey // 2) AS calls, o_orderpriority AS priority FROM orders)"""


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lines of the chain, and its functions as (k, priority, path, start0, end0, func)."""
    k = F.col("o_orderkey")
    n = F.row_number().over(Window.partitionBy("f").orderBy("o_orderkey"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr("o_orderkey div 10").alias("f")).withColumn("n", n)
    rows = rows.withColumn("path", F.concat(F.lit("src/c"), "f", F.lit(".py")))
    texts = F.array(F.concat(F.lit("def fn_"), k, F.lit("():")), F.concat(F.lit("    fn_"), F.expr("o_orderkey div 2"), F.lit("()")))
    lines = rows.select("path", F.col("f").alias("file_ord"), F.lit("python").alias("lang"), "n", F.posexplode(texts).alias("at", "raw"))
    lines = lines.select("path", "file_ord", "lang", (F.col("n") * 2 - 1 + F.col("at")).cast("long").alias("line_no"), *[F.col("raw").alias(c) for c in ("raw", "stripped", "clean")])
    return lines, rows.select(k.alias("k"), F.col("o_orderpriority").alias("priority"), "path", (F.col("n") * 2 - 2).cast("int").alias("start0"), (F.col("n") * 2).cast("int").alias("end0"), F.concat(F.lit("fn_"), k).alias("func"))


SPANS = f"""{CORPUS}, decl AS (SELECT path, line_no, regexp_extract(text, 'def ([a-z_0-9]+)', 1) AS func FROM corpus WHERE text LIKE 'def %'),
sizes AS (SELECT path, max(line_no) AS n FROM corpus GROUP BY path),
spans AS (SELECT path, line_no - 1 AS start0, coalesce(lead(line_no) OVER (PARTITION BY path ORDER BY line_no) - 1, n) AS end0, func FROM decl JOIN sizes USING (path))"""


@query("SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def line_scan(spark, sf_dir):
    return index.split_lines(t(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line) = '') AS n_blank, max(length(line) - length(ltrim(line))) AS max_indent, sum(length(line))::BIGINT AS n_chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def line_stats(spark, sf_dir):
    lines = index.split_lines(t(spark, sf_dir, "documents"), "doc_id", "text")
    blank = F.sum((index.strip(F.col("line")) == "").cast("long"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), blank.alias("n_blank"), F.max(index.indent(F.col("line"))).cast("long").alias("max_indent"), F.sum(F.length("line")).alias("n_chars"))


@query(f"""SELECT concat('p', page_id) AS path, i AS line_no, name FROM (SELECT DISTINCT page_id, i, unnest(regexp_extract_all(l[i], '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS name
FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS l FROM pages))) WHERE name NOT IN ({_list(CALLEE_IGNORED)})""")
def call_extraction(spark, sf_dir):
    """Lexical callees of the pages' scripts."""
    scripts = t(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("at", "clean"))
    return index.callees(scripts.select("path", (F.col("at") + 1).cast("long").alias("line_no"), "clean"))


KINDS = """kinds AS (SELECT DISTINCT concat('src/o', l_orderkey, '_', l_linenumber, '_', l_partkey) AS stem, l_partkey AS k, l_linenumber % 7 AS kind FROM lineitem),
stripped AS (SELECT CASE kind WHEN 4 THEN concat(stem, '.rs') WHEN 5 THEN concat(stem, '.py') WHEN 6 THEN concat(stem, '.go') ELSE concat(stem, '.cpp') END AS path, unnest(CASE kind
  WHEN 0 THEN [{'raw': concat('call_', k, '(); // note "x"'), 'stripped': concat('call_', k, '(); // note "x"'), 'clean': concat('call_', k, '(); ')}]
  WHEN 1 THEN [{'raw': concat('a = "str // ', k, '"; b();'), 'stripped': concat('a = "str // ', k, '"; b();'), 'clean': 'a = ; b();'}]
  WHEN 2 THEN [{'raw': concat('x /* one */ = ', k, ';'), 'stripped': concat('x  = ', k, ';'), 'clean': concat('x  = ', k, ';')}]
  WHEN 3 THEN [{'raw': concat('pre_', k, ' /* first'), 'stripped': concat('pre_', k, ' '), 'clean': concat('pre_', k, ' ')}, {'raw': concat('second */ post_', k), 'stripped': concat(' post_', k), 'clean': concat(' post_', k)}]
  WHEN 4 THEN [{'raw': concat('a /* x /* y */ z */ b_', k, ' // "'), 'stripped': concat('a  b_', k, ' // "'), 'clean': concat('a  b_', k, ' ')}]
  WHEN 5 THEN [{'raw': concat('v_', k, ' = 1  # "note"'), 'stripped': concat('v_', k, ' = 1  # "note"'), 'clean': concat('v_', k, ' = 1  ')}]
  ELSE [{'raw': concat('s := `raw ', k), 'stripped': 's := ', 'clean': 's := '}, {'raw': 'more` + t', 'stripped': ' + t', 'clean': ' + t'}] END) AS l FROM kinds)"""


def _kinds(spark, sf_dir) -> DataFrame:
    """files(path, file_ord, lang, content) that hold comments and strings in several languages."""
    k, kind = F.col("l_partkey"), F.col("l_linenumber") % 7
    texts = ('concat("call_", k, "(); // note \\"x\\"")', 'concat("a = \\"str // ", k, "\\"; b();")', 'concat("x /* one */ = ", k, ";")', 'concat("pre_", k, " /* first\\nsecond */ post_", k)', 'concat("a /* x /* y */ z */ b_", k, " // \\"")', 'concat("v_", k, " = 1  # \\"note\\"")')
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("k"), kind.alias("kind")).distinct()
    content = F.expr('concat("s := `raw ", k, "\\nmore` + t")')
    for i, x in enumerate(texts):
        content = F.when(F.col("kind") == i, F.expr(x)).otherwise(content)
    ext = F.when(F.col("kind") == 4, ".rs").when(F.col("kind") == 5, ".py").when(F.col("kind") == 6, ".go").otherwise(".cpp")
    path = F.concat(F.lit("src/o"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "k", ext)
    return files.with_order(rows.select(path.alias("path"), content.alias("content")))


@query(f"WITH {KINDS} SELECT path, l.raw AS raw, l.stripped AS stripped, l.clean AS clean FROM stripped")
def comment_strip(spark, sf_dir):
    """Strings and comments out of C++, Rust (nested), Python and Go (strings over lines): the scanners themselves."""
    return index.code_lines(_kinds(ship(spark), sf_dir)).select("path", "raw", "stripped", "clean")


@query("""WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([a-z]+)"', 1)) AS word FROM pages)
SELECT concat('u', page_id, '.c') AS path, concat('lib/', word, '.h') AS target, concat(word, '.h') AS base FROM h UNION ALL SELECT concat('u', page_id, '.c'), concat('sys/', word), word FROM h""")
def include_scan(spark, sf_dir):
    words = t(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([a-z]+)"'), F.lit(1)))).alias("word"))
    line = F.concat(F.lit('#include "lib/'), "word", F.lit('.h"\n  # include \\\n<sys/'), "word", F.lit(">\nint x;"))
    units = words.groupBy("page_id").agg(F.concat_ws("\n", F.collect_list(line)).alias("content"))
    return linkage.includes(units.select(F.concat(F.lit("u"), "page_id", F.lit(".c")).alias("path"), "content"))


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+"), F.lit(0))).alias("token"))


WORDS = r"'~?(?:operator\\s*[^\\sA-Za-z0-9_(]+|[A-Za-z_$][A-Za-z0-9_$]*)'"


def _text_lines(spark, sf_dir, name: str, key: str, text: str) -> DataFrame:
    """Lines of a table's texts, as if each were a Python file."""
    cols = [F.col("line").alias(c) for c in ("raw", "stripped", "clean")]
    return index.split_lines(t(spark, sf_dir, name), key, text).select(F.concat(F.lit("d"), F.col(key).cast("string")).alias("path"), F.lit(0).alias("file_ord"), F.lit("python").alias("lang"), "line_no", *cols)


@query(f"""WITH b AS (SELECT DISTINCT ltrim(unnest(regexp_extract_all(text, {WORDS})), '~') AS name FROM benchmark),
w AS (SELECT DISTINCT doc_id, i, ltrim(unnest(regexp_extract_all(l[i], {WORDS})), '~') AS name FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
SELECT concat('d', doc_id) AS path, count(*) AS n FROM w SEMI JOIN b USING (name) WHERE length(name) >= 3 GROUP BY doc_id""")
def token_prefilter(spark, sf_dir):
    """Lines of documents that mention a word of the benchmark: the token table and its equi-join."""
    asked = index.tokens(_text_lines(spark, sf_dir, "benchmark", "item_id", "text")).where(~F.col("token").startswith("~")).select(F.col("token").alias("name"))
    toks = index.tokens(_text_lines(spark, sf_dir, "documents", "doc_id", "text"))
    none = spark.createDataFrame([], "name string, path string, line_no long")
    return index.callers(asked, toks, none).groupBy("path").agg(F.count("*").alias("n"))


@query(f"""WITH {CORPUS} SELECT path, line_no, regexp_extract(text, '([a-z]+_[0-9]+)\\(', 1) AS name FROM corpus""")
def callees_lexical(spark, sf_dir):
    return index.callees(corpus(spark, sf_dir))


@query(f"""WITH {SPANS} SELECT c.path, c.line_no, s.start0 + 1 AS start_line FROM corpus c JOIN spans s ON c.path = s.path AND c.line_no > s.start0 AND c.line_no <= s.end0""")
def scope_of_line(spark, sf_dir):
    """The scope tree, and each line's innermost scope."""
    lines = corpus(ship(spark), sf_dir)
    tree = resolve.scopes(lines)
    at = resolve.innermost(lines.select("path", "line_no"), tree)
    return at.join(tree, ["path", "scope_id"]).select("path", "line_no", F.col("start_line").cast("long").alias("start_line"))


@query(f"""WITH {CHAIN} SELECT path, line_no - unnest([0, 1]) AS line_no, line_no - 2 AS start0, line_no AS end0, concat('fn_', k) AS name FROM chain""")
def syntax_bounds(spark, sf_dir):
    """Bounds by the syntax tree for every line of the chain."""
    lines, _ = _chain(ship(spark), sf_dir)
    out = syntax.syntax_bounds(lines.select("path", "line_no"), syntax.syntax(_joined(lines)))
    return out.select("path", "line_no", F.col("start0").cast("long").alias("start0"), F.col("end0").cast("long").alias("end0"), "name")


@query(f"""WITH {CHAIN} SELECT path, line_no, calls AS name FROM chain""")
def syntax_callees(spark, sf_dir):
    return syntax.syntax_callees(syntax.syntax(_joined(_chain(ship(spark), sf_dir)[0])))


@query(f"""WITH {CHAIN}, x AS (SELECT path, line_no, CAST(k // 2 AS VARCHAR) AS k FROM chain)
SELECT path, line_no, concat('v', k) AS name, 4 AS utf16, true AS stored FROM x UNION ALL SELECT path, line_no, concat('w', k), CAST(4 + length(k) + 10 AS INTEGER), false FROM x""")
def syntax_identifiers(spark, sf_dir):
    """Variables by the tree, with their place in UTF-16 units and whether they are assigned."""
    lines, _ = _chain(ship(spark), sf_dir)
    k = F.regexp_extract("raw", "([0-9]+)", 1)
    text = F.when(F.col("raw").startswith("def "), F.col("raw")).otherwise(F.concat(F.lit("    v"), k, F.lit(' = "é" + w'), k, F.lit(".x")))
    return syntax.syntax_identifiers(syntax.syntax(_joined(lines.withColumn("raw", text)))).select("path", "line_no", "name", "utf16", "stored")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS path, d.n_chars AS line_no, CASE WHEN l.doc_id IS NULL THEN 'Unknown' ELSE 'Covered' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_left(spark, sf_dir):
    changed = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("line_no"))
    covered = t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path")).distinct().join(changed, "path")
    return linkage.coverage_status(changed, covered)


@query(f"WITH {SPANS} SELECT path, start0, end0, func FROM spans")
def indentation_bounds(spark, sf_dir):
    lines = corpus(spark, sf_dir)
    heads = lines.where(F.col("clean").startswith("def ")).select("path", "line_no", F.regexp_extract("clean", r"\bdef\s+(\w+)", 1).alias("func"))
    return index.bounds(heads, index.shapes(lines)).select("path", F.col("start0").cast("long").alias("start0"), F.col("end0").cast("long").alias("end0"), "func")


BRACES = """braces AS (SELECT path, line_no, text FROM (
  SELECT concat('src/f', k // 10, '.c') AS path, row_number() OVER (PARTITION BY k // 10 ORDER BY k, n, text) AS line_no, text FROM (
    SELECT o_orderkey AS k, 0 AS n, concat('void order_', o_orderkey, '() {') AS text FROM orders
    UNION ALL SELECT l_orderkey, l_linenumber, concat('  if (x) { part_', l_partkey, '(); }') FROM lineitem
    UNION ALL SELECT o_orderkey, 99, '}' FROM orders)))"""


@query(f"""WITH {BRACES}, h AS (SELECT path, line_no, regexp_extract(text, 'void ([a-z_0-9]+)', 1) AS func FROM braces WHERE text LIKE 'void%'),
e AS (SELECT path, line_no FROM braces WHERE text = '}}') SELECT h.path, h.line_no - 1 AS start0, min(e.line_no) AS end0, func FROM h JOIN e ON h.path = e.path AND e.line_no > h.line_no GROUP BY ALL""")
def brace_bounds(spark, sf_dir):
    heads = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("n"), F.concat(F.lit("void order_"), "o_orderkey", F.lit("() {")).alias("text"))
    ends = heads.select("k", F.lit(99).alias("n"), F.lit("}").alias("text"))
    body = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.concat(F.lit("  if (x) { part_"), "l_partkey", F.lit("(); }")).alias("text"))
    rows = heads.unionByName(ends).unionByName(body).withColumn("f", F.expr("k div 10"))
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("f").orderBy("k", "n", "text")).cast("long"))
    lines = rows.select(F.concat(F.lit("src/f"), F.col("f").cast("string"), F.lit(".c")).alias("path"), F.lit("c-family").alias("lang"), "line_no", F.col("text").alias("stripped"), F.col("text").alias("clean"))
    found = index.bounds(lines.where(F.col("clean").startswith("void")).select("path", "line_no", F.regexp_extract("clean", r"void (\w+)", 1).alias("func")), index.shapes(lines))
    return found.select("path", F.col("start0").cast("long").alias("start0"), F.col("end0").cast("long").alias("end0"), "func")


@query(f"WITH {SPANS} SELECT c.path, c.line_no, s.func FROM corpus c JOIN spans s ON c.path = s.path AND c.line_no > s.start0 AND c.line_no <= s.end0")
def line_to_span(spark, sf_dir):
    lines = corpus(spark, sf_dir)
    spans = indentation_bounds(spark, sf_dir)
    inside = spans.withColumn("line_no", F.explode(F.sequence(F.col("start0") + 1, "end0")))
    return lines.select("path", "line_no").join(inside.select("path", "line_no", "func"), ["path", "line_no"])


@query("""SELECT doc_id, coalesce(nullif(regexp_extract(text, '\\b(?:fn|def|function|sub|func|class|macro)\\s+([A-Za-z0-9_]+)', 1), ''),
  nullif(regexp_extract(text, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), ''), concat('block_lines_0_', len(string_split(text, chr(10))))) AS func FROM documents""")
def function_names(spark, sf_dir):
    end = F.size(F.split("text", "\n", -1))
    return t(spark, sf_dir, "documents").select("doc_id", index.function_name(F.col("text"), F.lit(0), end).alias("func"))


@query(f"""WITH {CORPUS}, d AS (SELECT regexp_extract(text, 'def ([a-z_0-9]+)', 1) AS name, f, path, line_no FROM corpus WHERE text LIKE 'def %')
SELECT name, path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f, path, line_no) AS r FROM d) WHERE r = 1""")
def definition_lookup(spark, sf_dir):
    lines = corpus(spark, sf_dir)
    names = t(spark, sf_dir, "orders").select(F.concat(F.lit("order_"), "o_orderkey").alias("name"))
    return index.first_definition(names, index.definitions(lines))


@query(f"""WITH {CORPUS} SELECT name, path, line_no, code FROM (SELECT regexp_extract(text, '([a-z]+_[0-9]+)', 1) AS name, path, line_no, trim(text) AS code, text FROM corpus)
WHERE text NOT LIKE 'def %' AND name IN (SELECT concat('part_', p_partkey) FROM part)""")
def caller_lines(spark, sf_dir):
    lines = corpus(spark, sf_dir)
    names = t(spark, sf_dir, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("name"))
    return index.callers(names, index.tokens(lines), index.definitions(lines))


EDGES = """e AS (SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation UNION SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier
  UNION SELECT concat('s', l_suppkey), concat('p', l_partkey) FROM lineitem UNION SELECT concat('p', l_partkey), concat('s', l_suppkey) FROM lineitem)"""


def _edges(spark, sf_dir):
    """Regions to nations to suppliers to parts, and back from parts to suppliers."""
    node = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    down = edge(t(spark, sf_dir, "nation"), node("r", "n_regionkey"), node("n", "n_nationkey")).unionByName(edge(t(spark, sf_dir, "supplier"), node("n", "s_nationkey"), node("s", "s_suppkey")))
    return down.unionByName(edge(li, node("s", "l_suppkey"), node("p", "l_partkey"))).unionByName(edge(li, node("p", "l_partkey"), node("s", "l_suppkey")))


def _regions(spark, sf_dir):
    return t(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT concat('r', r_regionkey) AS node, 0 AS depth FROM region UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def caller_bfs(spark, sf_dir):
    return graph.reach(_regions(spark, sf_dir), _edges(spark, sf_dir), 4)


@query(f"""WITH RECURSIVE {EDGES}, v AS (SELECT concat('s', s_suppkey) AS node FROM supplier WHERE s_acctbal < 0),
b AS (SELECT concat('r', r_regionkey) AS node, 0 AS depth FROM region UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 4 AND dst NOT IN (SELECT node FROM v))
SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def callee_bfs(spark, sf_dir):
    """The same search with suppliers in debt as visited before."""
    seen = t(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.reach(_regions(spark, sf_dir), _edges(spark, sf_dir), 4, seen)


TRACED = f"""{CHAIN}, seed AS (SELECT k FROM chain WHERE k IN (SELECT n_nationkey + 1 FROM nation)),
one AS (SELECT calls AS name, path, line_no, concat(calls, '()') AS code, 1 AS distance, k FROM chain WHERE k // 2 IN (SELECT k FROM seed)),
two AS (SELECT calls AS name, path, line_no, concat(calls, '()') AS code, 2 AS distance, k FROM chain WHERE k // 2 IN (SELECT k FROM one EXCEPT SELECT k FROM seed))"""


def _seeds(spark, sf_dir):
    lines, funcs = _chain(spark, sf_dir)
    return lines, funcs, funcs.join(t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("k")), "k", "left_semi")


@query(f"WITH {TRACED} SELECT name, path, line_no, code, distance FROM one UNION ALL SELECT name, path, line_no, code, distance FROM two")
def caller_trace(spark, sf_dir):
    """Callers of callers of the functions that nations number."""
    lines, _, seeds = _seeds(ship(spark), sf_dir)
    found, _ = graph.trace_callers(seeds, lines, index.tokens(lines), index.definitions(lines), index.shapes(lines), 2)
    return found


@query(f"""WITH {TRACED}, extra AS (SELECT concat('fn_', n_nationkey + 1) AS name, 'gen/macros.py' AS path, n_nationkey + 1 AS line_no, 'EXPANDED' AS code FROM nation)
SELECT name, path, line_no, code, distance FROM one UNION ALL SELECT name, path, CAST(line_no AS BIGINT), code, 1 FROM extra WHERE name IN (SELECT concat('fn_', k) FROM seed)""")
def merge_callers(spark, sf_dir):
    """Mentions after macro expansion join the lexical ones, once a line."""
    lines, _, seeds = _seeds(ship(spark), sf_dir)
    name = F.concat(F.lit("fn_"), F.col("n_nationkey") + 1)
    extra = t(spark, sf_dir, "nation").select(name.alias("name"), F.lit("gen/macros.py").alias("path"), (F.col("n_nationkey") + 1).cast("long").alias("line_no"), F.lit("EXPANDED").alias("code"))
    toks, defs = index.tokens(lines), index.definitions(lines)
    again = index.callers(seeds.select(F.col("func").alias("name")), toks, defs)
    found, _ = graph.trace_callers(seeds, lines, toks, defs, index.shapes(lines), 1, extra.unionByName(again))
    return found


@query(f"""WITH {CHAIN}, s0 AS (SELECT k FROM chain WHERE priority = '1-URGENT'), l1 AS (SELECT DISTINCT k // 2 AS k FROM s0 EXCEPT SELECT k FROM s0), l2 AS (SELECT DISTINCT k // 2 AS k FROM l1 JOIN chain USING (k) EXCEPT SELECT k FROM s0 EXCEPT SELECT k FROM l1),
f AS (SELECT k, 1 AS distance FROM l1 UNION ALL SELECT k, 2 FROM l2)
SELECT concat('fn_', k) AS func, path, CAST(line_no - 2 AS BIGINT) AS start0, CAST(line_no AS BIGINT) AS end0, concat('def fn_', k, '():', chr(10), '    ', calls, '()') AS source, distance FROM f JOIN chain USING (k)""")
def callee_trace(spark, sf_dir):
    """What the urgent orders' functions call, and what that calls, without themselves."""
    lines, funcs = _chain(ship(spark), sf_dir)
    seeds = funcs.where("priority = '1-URGENT'")
    found = graph.trace_callees(seeds, seeds.select(*graph.SPAN), lines, index.definitions(lines), index.shapes(lines), 2)
    return found.select("func", "path", F.col("start0").cast("long").alias("start0"), F.col("end0").cast("long").alias("end0"), "source", "distance")


@query("""WITH RECURSIVE p AS (SELECT concat('c', c_custkey) AS name, concat('n', c_nationkey) AS parent FROM customer UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation),
a AS (SELECT concat('c', c_custkey) AS name, concat('c', c_custkey) AS ancestor, 0 AS depth FROM customer UNION SELECT a.name, p.parent, depth + 1 FROM a JOIN p ON p.name = a.ancestor)
SELECT name, ancestor, min(depth) AS depth FROM a GROUP BY ALL""")
def inheritance_closure(spark, sf_dir):
    cust = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    nation = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return graph.inherited(cust.select("name"), cust.unionByName(nation))


@query("""SELECT concat('src/k', c_custkey, '.py') AS path, 9::BIGINT AS line_no, 'x' AS name, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS depth, concat('src/k', c_custkey, '.py') AS def_path, CASE WHEN c_custkey % 2 = 0 THEN 6::BIGINT ELSE 2 END AS def_line, CASE WHEN c_custkey % 2 = 0 THEN 'x = 3' ELSE 'x = 1' END AS code FROM customer""")
def member_resolution(spark, sf_dir):
    """A class's members depth first: the first parent's own parent goes before the second parent."""
    k = F.col("c_custkey").cast("string")
    first = F.when(F.col("c_custkey") % 2 == 0, "z").otherwise("x")
    text = F.concat(F.lit("class P_"), k, F.lit(":\n    "), first, F.lit(" = 1\nclass A_"), k, F.lit("(P_"), k, F.lit("):\n    y = 2\nclass B_"), k, F.lit(":\n    x = 3\nclass C_"), k, F.lit("(A_"), k, F.lit(", B_"), k, F.lit("):\n    def m(self):\n        return x"))
    lines = index.code_lines(_files(t(ship(spark), sf_dir, "customer"), F.concat(F.lit("src/k"), k, F.lit(".py")), text))
    found = resolve.classes(lines, resolve.scopes(lines))
    uses = lines.where("line_no = 9").select("path", "line_no", F.lit("x").alias("name"))
    none = spark.createDataFrame([], "path string, file string")
    return resolve.member_definitions(uses, found, resolve.parents(lines), resolve.members(lines, found), none)


@query("""WITH f AS (SELECT concat('src/p', p_partkey, '.rs') AS path, concat('#[no_mangle]', chr(10), 'pub fn part_', p_partkey, '() {}') AS content FROM part WHERE p_size > 25),
x AS (SELECT DISTINCT unnest(regexp_extract_all(content, '(?s)#\\[no_mangle\\].*?fn\\s+([A-Za-z0-9_]+)', 1)) AS name FROM f),
c AS (SELECT concat('part_', l_partkey) AS name, concat('src/o', l_orderkey, '.py') AS path, l_linenumber AS line_no FROM lineitem)
SELECT name, path, CAST(line_no AS BIGINT) AS line_no, concat(name, '()') AS code FROM (SELECT DISTINCT * FROM c) SEMI JOIN x USING (name)""")
def ffi_registry(spark, sf_dir):
    rust = t(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".rs")).alias("path"), F.concat(F.lit("part_"), "p_partkey").alias("func"), F.concat(F.lit("#[no_mangle]\npub fn part_"), "p_partkey", F.lit("() {}")).alias("content"))
    calls = t(spark, sf_dir, "lineitem").select(F.concat(F.lit("src/o"), "l_orderkey", F.lit(".py")).alias("path"), F.lit(0).alias("file_ord"), F.lit("python").alias("lang"), F.col("l_linenumber").cast("long").alias("line_no"), F.concat(F.lit("part_"), "l_partkey", F.lit("()")).alias("clean"))
    toks = index.tokens(calls.withColumn("stripped", F.col("clean")))
    return linkage.ffi_callers(rust, linkage.ffi_exports(rust), toks, toks)


@query("""WITH h AS (SELECT concat('inc/', word) AS header FROM (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([a-z]+)"', 1)) AS word FROM pages)),
u AS (SELECT DISTINCT concat('unit', page_id, '.c') AS unit, unnest(regexp_extract_all(html, 'href="/([a-z]+)"', 1)) AS target FROM pages)
SELECT DISTINCT header, unit FROM u JOIN h ON header = concat('inc/', target)""")
def compile_links(spark, sf_dir):
    pages = t(spark, sf_dir, "pages")
    words = pages.select(F.concat(F.lit("unit"), "page_id", F.lit(".c")).alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="/([a-z]+)"'), F.lit(1))).alias("word"))
    units = words.groupBy("path").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit('#include "'), "word", F.lit('"')))).alias("content"))
    headers = words.select(F.concat(F.lit("inc/"), "word").alias("path")).distinct()
    return linkage.build_links(headers, units.select(F.col("path").alias("file")), linkage.includes(units))


@query("""WITH e AS (SELECT concat('u', user_id) AS path, event_id AS idx, CASE WHEN value < 20 THEN concat('# ', event_id, ' "', event_type, '"') ELSE event_type END AS text FROM events),
m AS (SELECT *, max(CASE WHEN text LIKE '# %' THEN idx END) OVER (PARTITION BY path ORDER BY idx) AS at FROM e)
SELECT m.path, m.idx, m.text, coalesce(regexp_extract(x.text, '"([^"]*)"', 1), '') AS of_path, coalesce(m.at, -1) AS of_line FROM m LEFT JOIN e x ON x.path = m.path AND x.idx = m.at WHERE m.text NOT LIKE '# %'""")
def linemarkers(spark, sf_dir):
    text = F.when(F.col("value") < 20, F.concat(F.lit("# "), "event_id", F.lit(' "'), "event_type", F.lit('"'))).otherwise(F.col("event_type"))
    return artifacts.markers(t(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_id").alias("idx"), text.alias("text"))).fillna({"of_path": "", "of_line": -1})


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O')
SELECT *, 'lexical' AS source FROM a UNION ALL SELECT *, 'macro' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def merge_callers(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_partkey"]
    a = li.where("l_returnflag = 'R'").select(*keys).distinct()
    b = li.where("l_linestatus = 'O'").select(*keys).distinct().join(a, keys, "left_anti")
    return a.withColumn("source", F.lit("lexical")).unionByName(b.withColumn("source", F.lit("macro")))


@query("""WITH r AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS func, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS path, page_id AS seq FROM pages),
k AS (SELECT *, CASE WHEN path = '' THEN 4 WHEN path = 'a/index' THEN 0 WHEN regexp_replace(path, '/?[^/]*$', '') = 'a' THEN 1 ELSE 2 END AS cat,
 len(string_split(path, '/')) - 1 + 1 - 2 * CASE WHEN starts_with(path, 'a/') THEN 1 ELSE 0 END AS far FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY func ORDER BY cat, CASE WHEN cat = 2 THEN far ELSE 0 END, seq) AS rank FROM k)
SELECT func, path, seq AS line_no, 'x' AS code, rank FROM o WHERE rank <= 3
UNION ALL SELECT func, '[Pruned Instances]', 0, concat('omitted ', count(*) - 3), 4 FROM r GROUP BY func HAVING count(*) > 3""")
def closeness_top_k(spark, sf_dir):
    refs = t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("func"), F.lit("a/index").alias("target"), F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1).alias("path"), F.col("page_id").alias("line_no"), F.col("page_id").alias("seq"), F.lit("x").alias("code"))
    return rank.closest(refs, 3).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT conv_id, turn, bytes FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS bytes FROM conversations) WHERE bytes <= 2000")
def budget_groups(spark, sf_dir):
    return rank.pack_groups(t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", "bytes")


@query("""SELECT section, ord, bytes FROM (SELECT source AS section, doc_id AS ord, 100 + sum(strlen(text) + CASE WHEN r = 1 THEN strlen(concat('## ', source)) ELSE 0 END) OVER (ORDER BY source, doc_id)::BIGINT AS bytes
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)) WHERE bytes <= 1000000""")
def sticky_packing(spark, sf_dir):
    items = t(spark, sf_dir, "documents").select(F.col("source").alias("section"), F.col("doc_id").alias("ord"), F.concat(F.lit("## "), "source").alias("header"), "text")
    return rank.sticky_pack(items, 1_000_000, 100).select("section", "ord", "bytes")


@query("""WITH RECURSIVE d AS (SELECT doc_id, [length(x) for x in string_split(text, chr(10))] AS f FROM documents),
r AS (SELECT doc_id, 0 AS i, 1500 - list_sum([least(x, 20) for x in f]) AS rest, '' AS shown FROM d
  UNION ALL SELECT r.doc_id, i + 1, rest - CASE WHEN f[i + 1] - least(f[i + 1], 20) <= rest THEN f[i + 1] - least(f[i + 1], 20) ELSE 0 END, concat(shown, CASE WHEN f[i + 1] - least(f[i + 1], 20) <= rest THEN '1' ELSE '0' END) FROM r JOIN d ON d.doc_id = r.doc_id WHERE i < len(f))
SELECT r.doc_id, shown FROM r JOIN d ON d.doc_id = r.doc_id WHERE i = len(f)""")
def greedy_upgrade(spark, sf_dir):
    full = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    df = t(spark, sf_dir, "documents").select("doc_id", full.alias("full"), F.transform(full, lambda x: F.least(x, F.lit(20))).alias("least"))
    return df.select("doc_id", F.concat_ws("", F.transform(rank.upgrades(F.col("full"), F.col("least"), F.lit(1500)), lambda x: x.cast("int").cast("string"))).alias("shown"))


@query("""SELECT doc_id, CASE WHEN len(l) <= 3 THEN text ELSE concat(array_to_string(l[1:3], chr(10)), chr(10), '// cut') END AS text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def truncation(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", rank.truncated(F.col("text"), 3, F.lit("// cut")).alias("text"))


@query("""SELECT DISTINCT concat('o', o_orderkey) AS path, unnest(range(s, s + n)) AS line_no FROM (SELECT o_orderkey, o_custkey AS s, o_orderkey % 4 AS n FROM orders) WHERE n > 0""")
def hunk_lines(spark, sf_dir):
    n = F.col("o_orderkey") % 4
    count = F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string")))
    text = F.concat(F.lit("+++ b/x\n@@ -"), "o_custkey", F.lit(" +"), "o_custkey", count, F.lit(" @@ f\n+added\n@@ broken @@"))
    return diff.changed_lines(t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), text.alias("diff")))


@query(f"SELECT page_id, NOT list_has_any(string_split(url, '/')[:-2], [{_list((*IGNORED_DIRECTORIES, 'a'))}]) AS inside FROM pages")
def ignored_directories(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", files.in_repository(F.col("url"), (*IGNORED_DIRECTORIES, "a")).alias("inside"))


@query("SELECT page_id, regexp_replace(url, '^https://site', 'file:///srv/site') AS url FROM pages WHERE false UNION ALL SELECT page_id, replace(concat('/old/root/', page_id, ':/old/rooted/', page_id), '/old/root/', '/new/') FROM pages")
def root_rewrite(spark, sf_dir):
    text = F.concat(F.lit("/old/root/"), "page_id", F.lit(":/old/rooted/"), "page_id")
    return t(spark, sf_dir, "pages").select("page_id", files.rewrite_root(text, "/old/root", "/new").alias("url"))


@query("""SELECT path, epoch_us(ts) AS mtime FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'coverage.xml' WHEN 1 THEN 'build/coverage.xml' WHEN 2 THEN 'out/coverage.xml' ELSE 'other/coverage.xml' END AS path, ts FROM events) WHERE path <> 'other/coverage.xml' ORDER BY ts DESC, path DESC LIMIT 1""")
def newest_artifact(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(x) for x in ("coverage.xml", "build/coverage.xml", "out/coverage.xml", "other/coverage.xml")]), (F.col("user_id") % 4 + 1).cast("int"))
    return files.newest_artifact(t(spark, sf_dir, "events").select(path.alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime")), "coverage.xml")


@query("""WITH f AS (SELECT concat('part_', p_partkey) AS func FROM part), w AS (SELECT p_partkey AS k, concat('tests/t', p_partkey % 50, '.py') AS path, concat('test_part_', p_partkey, CASE WHEN p_size % 3 = 0 THEN '_ok' WHEN p_size % 3 = 1 THEN 'er' ELSE '' END) AS word FROM part)
SELECT func, path, word FROM f JOIN w ON word = concat('test_', func) OR starts_with(word, concat('test_', func, '_'))""")
def test_names(spark, sf_dir):
    parts = t(spark, sf_dir, "part")
    tail = F.when(F.col("p_size") % 3 == 0, "_ok").when(F.col("p_size") % 3 == 1, "er").otherwise("")
    words = parts.select(F.concat(F.lit("tests/t"), (F.col("p_partkey") % 50).cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("test_part_"), "p_partkey", tail).alias("word"))
    return words.withColumn("func", F.explode(linkage.test_stems(F.col("word")))).join(parts.select(F.concat(F.lit("part_"), "p_partkey").alias("func")), "func").select("func", "path", "word")


@query(f"""WITH {CORPUS} SELECT path, line_no, name, instr(text, name) - 1 AS utf16 FROM (SELECT path, line_no, concat('    total = total_', line_no, ' + rate') AS text, unnest(['total', concat('total_', line_no), 'rate']) AS name FROM corpus) WHERE name <> 'x'""")
def identifier_positions(spark, sf_dir):
    lines = corpus(spark, sf_dir)
    text = F.concat(F.lit("    total = total_"), "line_no", F.lit(" + rate"))
    return resolve.identifiers(lines.withColumn("raw", text).withColumn("clean", text)).select("path", "line_no", "name", F.col("utf16").cast("long").alias("utf16"))


@query(f"""WITH {CORPUS}, c AS (SELECT regexp_extract(text, '([a-z]+_[0-9]+)', 1) AS name, path, line_no, text FROM corpus)
SELECT path, count(*) AS n, array_to_string(list(concat(line_no, ':', name) ORDER BY line_no, name), ',') AS occ FROM c WHERE text NOT LIKE 'def %' AND name IN (SELECT concat('part_', p_partkey) FROM part) GROUP BY path""")
def occurrence_map(spark, sf_dir):
    occ = F.sort_array(F.collect_list(F.struct("line_no", "name")))
    grouped = caller_lines(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), occ.alias("o"))
    return grouped.select("path", "n", F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["line_no"], x["name"])), ",").alias("occ"))


@query("""SELECT concat('part_', p_partkey) AS func, concat('tests/test_', p_partkey, '.py') AS path, 1::BIGINT AS line_no, concat('def test_part_', p_partkey, '():', chr(10), '    assert part_', p_partkey, '()') AS code FROM part""")
def test_mining(spark, sf_dir):
    """Tests of each part's function; of two files with equal tests the first one."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("def test_part_"), k, F.lit("():\n    assert part_"), k, F.lit("()"))
    parts = t(ship(spark), sf_dir, "part")
    one = _files(parts, F.concat(F.lit("tests/test_"), k, F.lit(".py")), text, F.lit(0))
    two = _files(parts, F.concat(F.lit("spec/again_"), k, F.lit(".py")), F.concat(F.lit("\n"), text, F.lit("\n")), F.lit(1))
    lines = _lines(one.unionByName(two))
    return linkage.find_tests(parts.select(F.concat(F.lit("part_"), k).alias("func"), F.concat(F.lit("src/part_"), k, F.lit(".py")).alias("path")), lines, index.shapes(lines))


@query("""SELECT p_partkey AS part_id, p_size % 2 = 0 AS python, CASE WHEN p_size < 10 THEN '' WHEN p_size % 2 = 0 THEN ' (AST Semantically Pruned)' ELSE ' (Truncated)' END AS suffix,
CASE WHEN p_size < 10 THEN concat(head, repeat(line, p_size)) WHEN p_size % 2 = 0 THEN concat(head, chr(10), '    # ... [Body Omitted] ...', chr(10), '    pass') ELSE concat(head, repeat(line, 9), chr(10), '/* ... [Truncated] ... */') END AS text
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN concat('def f_', p_partkey, '():') ELSE concat('begin ', p_partkey) END AS head, concat(chr(10), '    a') AS line FROM part)""")
def block_pruning(spark, sf_dir):
    """Blocks of more than ten lines: Python by its structure, others cut."""
    ship(spark)
    python = F.col("p_size") % 2 == 0
    k = F.col("p_partkey").cast("string")
    source = F.concat(F.when(python, F.concat(F.lit("def f_"), k, F.lit("():"))).otherwise(F.concat(F.lit("begin "), k)), F.expr("repeat('\n    a', p_size)"))
    done = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), python.alias("python"), rank.prune_blocks(source, F.when(python, "python").otherwise("unknown"), 10).alias("p"))
    return done.select("part_id", "python", "p.suffix", "p.text")


@query("""SELECT path, unnest(targets) AS target FROM (SELECT concat('src/i', p_partkey, ['.rs', '.py', '.go'][p_size % 3 + 1]) AS path, CASE p_size % 3
  WHEN 0 THEN [concat('a_', p_partkey), concat('a_', p_partkey, '/b'), concat('c_', p_partkey), concat('c_', p_partkey, '/d'), concat('c_', p_partkey, '/e')]
  WHEN 1 THEN [concat('p_', p_partkey), concat('p_', p_partkey, '/a'), concat('p_', p_partkey, '/b')] ELSE [concat('x/y_', p_partkey), concat('q_', p_partkey)] END AS targets FROM part)""")
def import_statements(spark, sf_dir):
    """Imports over several lines: a nested Rust use tree, a Python import in brackets, a Go group."""
    k = F.col("p_partkey").cast("string")
    rust = F.concat(F.lit("use crate::{a_"), k, F.lit("::b,\n    c_"), k, F.lit("::{d, e as f}\n};\n"))
    python = F.concat(F.lit("from p_"), k, F.lit(" import (a,\n    b as c,\n)\n"))
    go = F.concat(F.lit('import (\n\t"x/y_'), k, F.lit('"\n\tz "q_'), k, F.lit('"\n)\n'))
    kind = F.col("p_size") % 3
    path = F.concat(F.lit("src/i"), k, F.when(kind == 0, ".rs").when(kind == 1, ".py").otherwise(".go"))
    lines = index.code_lines(_files(t(ship(spark), sf_dir, "part"), path, F.when(kind == 0, rust).when(kind == 1, python).otherwise(go)))
    return linkage.imports(lines).select("path", "target")


@query("""SELECT path, line_no::BIGINT AS line_no, unnest(names) AS name FROM (SELECT concat('src/d', p_partkey, '.cpp') AS path, 1 AS line_no, ['TEST_F', concat('Suite_', p_partkey), concat('name_', p_partkey)] AS names FROM part
  UNION ALL SELECT concat('src/d', p_partkey, '.cpp'), 2, ['UFUNCTION', 'X', concat('go_', p_partkey)] FROM part UNION ALL SELECT concat('src/d', p_partkey, '.cpp'), 3, [concat('Box_', p_partkey)] FROM part)""")
def macro_definitions(spark, sf_dir):
    """What lines of C++ define, also by macros; a call that ends in a semicolon defines nothing."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("TEST_F(Suite_"), k, F.lit(", name_"), k, F.lit(") {\nUFUNCTION(X) void go_"), k, F.lit("() {\nstruct Box_"), k, F.lit(" {\nCALL(one, two);"))
    return index.definitions(index.code_lines(_files(t(ship(spark), sf_dir, "part"), F.concat(F.lit("src/d"), k, F.lit(".cpp")), text))).select("path", "line_no", "name")


@query("""SELECT concat('src/v', o_orderkey, '.py') AS path, line_no::BIGINT AS line_no, code, distance FROM (SELECT o_orderkey, unnest([{'line_no': 3, 'code': concat('a_', o_orderkey, ' = b_', o_orderkey), 'distance': 1}, {'line_no': 1, 'code': concat('b_', o_orderkey, ' = 7'), 'distance': 2}], recursive := true) FROM orders)""")
def data_trace(spark, sf_dir):
    """Definitions of the variables of each file's last line, and of those on the lines found."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("b_"), k, F.lit(" = 7\ndef f_"), k, F.lit("():\n    a_"), k, F.lit(" = b_"), k, F.lit("\n    return a_"), k)
    lines = _lines(_files(t(ship(spark), sf_dir, "orders"), F.concat(F.lit("src/v"), k, F.lit(".py")), text))
    none = spark.createDataFrame([], "path string, file string")
    return resolve.trace_data(lines.where("line_no = 4").select("path", "line_no"), lines, written(resolve.scopes(lines), "scopes"), none, 2)


@query("""SELECT part_id, path, CASE p_size % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'c-family' WHEN 2 THEN 'rust' WHEN 3 THEN 'unknown' ELSE 'typescript' END AS lang, CASE p_size % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' WHEN 2 THEN 'rust' WHEN 3 THEN 'text' ELSE 'typescript' END AS fence,
['.py', '.h', '.rs', '.md', '.tsx'][p_size % 5 + 1] AS ext FROM (SELECT p_partkey AS part_id, p_size, concat('src/x', p_partkey, ['.py', '.H', '.rs', '.md', '.tsx'][p_size % 5 + 1]) AS path FROM part)""")
def language_dimension(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".H", ".rs", ".md", ".tsx")]), F.col("p_size") % 5 + 1)
    path = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.concat(F.lit("src/x"), "p_partkey", ext).alias("path"))
    return path.select("part_id", "path", language_of(F.col("path")).alias("lang"), fence_of(F.col("path")).alias("fence"), extension(F.col("path")).alias("ext"))


@query(f"""WITH {CORPUS} SELECT 'upstream_dependent_callers' AS section, concat('{{"path":"', path, '","name":"', name, '","line_no":', line_no, ',"distance":1,"code":"', trim(text), '"}}') AS json
FROM (SELECT regexp_extract(text, '([a-z]+_[0-9]+)', 1) AS name, path, line_no, text FROM corpus) WHERE text NOT LIKE 'def %' AND name IN (SELECT concat('part_', p_partkey) FROM part)""")
def payload_json(spark, sf_dir):
    """The JSON payload's rows."""
    return ContextEngine.json_rows(None, {"callers": caller_lines(spark, sf_dir).withColumn("distance", F.lit(1))})


@query("""WITH a AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 30), b AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 20)
SELECT *, 'first' AS only FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def compare_modes(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return compare(li.where("l_quantity < 30").select("l_orderkey", "l_partkey"), li.where("l_quantity > 20").select("l_orderkey", "l_partkey"))


@query(f"""WITH {CORPUS}, i AS (SELECT path, concat('m', (f + 1) % 40, '/f', f + 1) AS target, f FROM (SELECT DISTINCT path, f FROM corpus)) SELECT path, target, concat('src/', target, '.py') AS file FROM i WHERE concat('src/', target, '.py') IN (SELECT path FROM corpus)""")
def import_resolution(spark, sf_dir):
    own = corpus(spark, sf_dir).select("path", "file_ord", "lang").distinct()
    n = F.col("file_ord") + 1
    text = F.concat(F.lit("import m"), (n % 40).cast("string"), F.lit(".f"), n.cast("string"))
    ship(spark)
    imp = linkage.imports(own.select("path", "lang", F.lit(1).alias("line_no"), text.alias("raw"), text.alias("clean")))
    return linkage.resolve_imports(imp, own).select("path", "target", "file")


@query("""WITH h AS (SELECT DISTINCT o_orderkey // 10 AS f FROM orders), first_one AS (SELECT min(f) AS f FROM h WHERE f % 3 = 0),
u AS (SELECT o_orderkey // 10 AS f, 1 + 2 * row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS line_no FROM orders),
w AS (SELECT u.f, line_no, CASE WHEN u.f % 3 = 0 THEN u.f WHEN u.f % 3 = 1 AND u.f - 1 IN (SELECT f FROM h) THEN u.f - 1 ELSE (SELECT f FROM first_one) END AS d FROM u)
SELECT concat('src/m', f, '.py') AS path, line_no, 'rate' AS name, 'global_regex' AS resolved_type, concat('src/m', d, '.py') AS def_path, 1 AS def_line, concat('rate = ', d) AS code FROM w
UNION ALL SELECT concat('src/m', f, '.py'), line_no, 'total', 'local_regex', concat('src/m', f, '.py'), line_no, 'total = rate' FROM w""")
def variable_resolution(spark, sf_dir):
    """The cascade: a local, the own file's top level, an imported file's, the first file's of that extension."""
    orders = t(ship(spark), sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("o_orderkey div 10").alias("f"))
    f = F.col("f").cast("string")
    head = F.when(F.col("f") % 3 == 0, F.concat(F.lit("rate = "), f)).when(F.col("f") % 3 == 1, F.concat(F.lit("import m"), (F.col("f") - 1).cast("string"))).otherwise("pass")
    body = F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda x: F.concat(F.lit("def order_"), x, F.lit("():\n    total = rate"))), "\n")
    own = orders.groupBy("f").agg(body.alias("body")).withColumn("body", F.concat(head, F.lit("\n"), "body"))
    fs = _files(own, F.concat(F.lit("src/m"), f, F.lit(".py")), F.col("body"), F.col("f"))
    lines = index.code_lines(fs)
    uses = lines.where(F.col("clean").endswith("= rate")).select("path", "line_no", F.explode(F.array(F.lit("rate"), F.lit("total"))).alias("name"))
    return resolve.resolve_variables(uses, lines, resolve.scopes(lines), linkage.resolve_imports(linkage.imports(lines), fs))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: who calls the parts that the corpus's functions name, with the function around each call."""
    lines = corpus(spark, sf_dir)
    calls = caller_lines(spark, sf_dir)
    spans = indentation_bounds(spark, sf_dir).withColumn("line_no", F.explode(F.sequence(F.col("start0") + 1, "end0")))
    return calls.join(spans.select("path", "line_no", "func"), ["path", "line_no"]).join(lines.select("path", "file_ord").distinct(), "path")

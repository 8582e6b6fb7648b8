"""Links between files: exports to other languages, includes, imports, tests, coverage."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import FFI_EXPORTS, extension, languages
from ..runtime import join_hint, written
from .index import MIN_NAME, blocks, bounds, strip
from .resolve import split_top

INCLUDE = r'^\s*#\s*(?:include|import)\s*(?:"([^"]+)"|<([^>]+)>)'


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def ffi_exports(files: DataFrame, patterns: tuple[str, ...] = FFI_EXPORTS) -> DataFrame:
    """(name) exported to other languages by files(content)."""
    found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit("(?s)" + p), F.lit(1)) for p in patterns]))
    return files.select(F.explode(found).alias("name")).distinct()


def ffi_callers(funcs: DataFrame, exports: DataFrame, toks: DataFrame, defs: DataFrame) -> DataFrame:
    """(name, path, line_no, code) of mentions of exported funcs(path, func) in files of another extension, any length of name."""
    own = funcs.select(F.col("func").alias("token"), extension(F.col("path")).alias("ext")).distinct().join(exports.withColumnRenamed("name", "token"), "token", "left_semi")
    hits = toks.join(own, "token").where(extension(F.col("path")) != F.col("ext"))
    return hits.select(F.col("token").alias("name"), "path", "line_no", "code").distinct()


def includes(files: DataFrame) -> DataFrame:
    """(path, target, base) of include directives; a backslash before the line's end continues it."""
    joined = F.split(F.regexp_replace("content", r"\\\n", ""), "\n")
    line = files.select("path", F.explode(joined).alias("line")).where(F.col("line").contains("include") | F.col("line").contains("import"))
    target = F.coalesce(F.nullif(F.regexp_extract("line", INCLUDE, 1), F.lit("")), F.nullif(F.regexp_extract("line", INCLUDE, 2), F.lit("")))
    return line.select("path", target.alias("target")).where("target is not null").withColumn("base", basename(F.col("target")))


def build_links(headers: DataFrame, units: DataFrame, incl: DataFrame) -> DataFrame:
    """(header, unit) of headers(path) and the compilation units(file) that include them: equal base names, then the directive's folders end the header's path."""
    own = headers.select(F.col("path").alias("header"), basename(F.col("path")).alias("base"))
    of_units = units.select(F.col("file").alias("unit")).distinct().join(incl.withColumnRenamed("path", "unit"), "unit")
    fits = (F.col("header") == F.col("target")) | F.concat(F.lit("/"), "header").endswith(F.concat(F.lit("/"), F.regexp_replace("target", r"^(?:\.{1,2}/)+", "")))
    return of_units.join(own, "base").where(fits).select("header", "unit").distinct()


def split_commas(text: str) -> list[str]:
    """Parts between the commas that are in no brace."""
    return [x.strip() for x in split_top(text, ",", "{}") if x.strip()]


def use_paths(tree: str, before: tuple[str, ...] = ()) -> list[str]:
    """What a Rust use tree may refer to: every step on the way to each of its leaves, as paths, each once."""
    head, brace, rest = tree.partition("{")
    steps = [x.strip() for x in re.sub(r"\s+as\s+\w+\s*$", "", head).split("::")]
    way = (*before, *[x for x in steps if x and x not in ("crate", "self", "super", "*")])
    out = ["/".join(way[:n]) for n in range(1, len(way) + 1)]
    if brace:
        out += [x for part in split_commas(rest[: rest.rfind("}")]) for x in use_paths(part, way)]
    return list(dict.fromkeys(out))


def _python_paths(statement: str) -> list[str]:
    def path(x: str) -> str:
        return re.sub(r"\s+as\s+\w+$", "", x.strip()).strip().lstrip(".").replace(".", "/")

    if m := re.match(r"import\s+(.+)", statement):
        return [path(x) for x in m[1].split(",")]
    if m := re.match(r"from\s+(\.*[\w.]*)\s+import\s+(.+)", statement):
        names = [path(x) for x in m[2].strip(" ()").split(",")]
        return [path(m[1]), *["/".join(x for x in (path(m[1]), n) if x) for n in names if n and n != "*"]]
    return []


def statements(rows: list[str], lang: str) -> list[tuple[int, list[str]]]:
    """(line, paths) of the import statements of a file's code, also of those that go on over several lines: a Python import in brackets or with a backslash, a Rust use tree up to its semicolon."""
    begins = re.compile(r"\s*(?:from\s+\.*[\w.]*\s+import\b|import\s)" if lang == "python" else r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:use\s|mod\s+\w+\s*;)")
    out, held, at = [], "", 0
    for no, line in enumerate(rows, 1):
        if not held:
            if not begins.match(line):
                continue
            at = no
        held += line.strip() + " "
        if lang == "python":
            if held.count("(") > held.count(")") or held.rstrip().endswith("\\"):
                held = held.rstrip().rstrip("\\") + " "
                continue
            out.append((at, _python_paths(held.strip().split(";")[0])))
        else:
            if ";" not in held:
                continue
            body = re.sub(r"^\s*(?:pub(?:\([^)]*\))?\s+)?", "", held.split(";")[0])
            out.append((at, [body[4:].strip()] if body.startswith("mod ") else use_paths(body[4:])))
        held = ""
    return out


def imports(lines: DataFrame) -> DataFrame:
    """(path, lang, line_no, target) of import statements, as a path without extension where the language writes dots. Python and Rust statements may go on over lines and are read a file at a time; a Go group has one path a line."""
    def all_(pattern: str) -> Column:
        return F.regexp_extract_all("text", F.lit(pattern), F.lit(1))

    text = F.when(F.col("lang").isin("go", "javascript", "typescript", "c-family"), F.col("raw")).otherwise(F.col("clean"))
    rows = lines.select("path", "lang", "line_no", text.alias("text"))
    dotted = lambda a: F.transform(a, lambda x: F.regexp_replace(strip(x), r"\.", "/"))
    found = (
        F.when(F.col("lang") == "go", all_(r'^\s*(?:import\s+)?\(?\s*(?:[\w.]+\s+)?"([^"]+)"\s*\)?\s*$'))
        .when(F.col("lang") == "java", dotted(all_(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;")))
        .when(F.col("lang").isin("javascript", "typescript"), F.concat(all_(r"""\bfrom\s+['"]([^'"]+)['"]"""), all_(r"""\b(?:require|import)\s*\(?\s*['"]([^'"]+)['"]""")))
        .when(F.col("lang") == "c-family", F.concat(all_(r'^\s*#\s*include\s*"([^"]+)"'), all_(r"^\s*#\s*include\s*<([^>]+)>")))
    )
    single = rows.where(~F.col("lang").isin("python", "rust")).select("path", "lang", "line_no", F.explode(found).alias("target"))
    whole = rows.where(F.col("lang").isin("python", "rust")).groupBy("path", "lang").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    whole = whole.where(F.exists("l", lambda x: x["text"].rlike(r"^\s*(?:from|import|use|mod|pub)\b")))

    @F.pandas_udf("array<struct<line_no:long,paths:array<string>>>")
    def read(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([[{"line_no": n, "paths": p} for n, p in statements(list(t), x)] for t, x in zip(text, lang, strict=True)])

    several = whole.select("path", "lang", F.inline(read(F.col("l.text"), F.col("lang")))).select("path", "lang", "line_no", F.explode("paths").alias("target"))
    return single.unionByName(several).select("path", "lang", "line_no", F.regexp_replace("target", r"^(?:\./|\.\./|/)+", "").alias("target")).where("target <> ''")


def resolve_imports(imp: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, file, line_no) of each import's first file, at the import's first line: the target as it is, with an extension of the language or as a package, at the end of a file's path. A file offers every suffix of its path, so this is an equi-join."""
    parts = F.split("path", "/")
    full = files.select(F.col("path").alias("file"), "file_ord", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    full = full.withColumn("rank", F.when(F.col("suffix") == F.col("file"), 0).otherwise(1))
    bare = full.withColumn("suffix", F.regexp_replace("suffix", r"\.[^./]+$", ""))
    folder = full.where(basename(F.col("file")).rlike(r"^(?:__init__\.py|mod\.rs|index\.[jt]sx?)$") | (F.col("lang") == "go")).withColumn("suffix", F.regexp_replace("suffix", r"/?[^/]+$", "")).where("suffix <> ''")
    offers = full.unionByName(bare).unionByName(folder).distinct().select("file", "file_ord", F.col("lang").alias("of_lang"), F.col("suffix").alias("target"), "rank")
    kin = lambda c: F.when(F.col(c) == "typescript", "javascript").otherwise(F.col(c))
    first_line = F.min("line_no") if "line_no" in imp.columns else F.lit(0)
    imp = imp.groupBy("path", "lang", "target").agg(first_line.cast("long").alias("line_no"))
    hit = imp.join(offers, "target").where((kin("lang") == kin("of_lang")) & (F.col("file") != F.col("path")))
    best = hit.groupBy("path", "target").agg(F.min(F.struct("rank", "file_ord", "file")).alias("b"), F.min("line_no").alias("line_no"))
    return best.select("path", "target", "b.file", "line_no")


def coverage_status(changed: DataFrame, covered: DataFrame) -> DataFrame:
    """changed(path, line_no) with status Covered or Unknown."""
    return changed.join(covered.select("path", "line_no").distinct().withColumn("hit", F.lit(True)), ["path", "line_no"], "left").withColumn("status", F.when(F.col("hit"), "Covered").otherwise("Unknown")).drop("hit")


def test_stems(word: Column) -> Column:
    """The names that a test's name may be about: itself, and what is left without test_, up to any underscore."""
    parts = F.split(F.regexp_replace(word, "^test_", ""), "_")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    return F.array_distinct(F.concat(cuts, F.array(word)))


def find_tests(funcs: DataFrame, lines: DataFrame, shape: DataFrame) -> DataFrame:
    """(func, path, line_no, code) of tests of funcs(path, func): lines of test files that name func, perhaps as test_func or func_suffix, and speak of a test. Of equal bodies one function's search keeps the first."""
    names = funcs.select("func", F.col("path").alias("own")).where(F.length("func") >= MIN_NAME).distinct()
    names = written(names, "names")
    own_ok = [x.name for x in languages() if x.tests_in_file]
    said = F.col("clean").contains("test") | F.col("clean").contains("it(") | F.col("clean").contains("describe") | F.col("raw").contains("test")
    words = lines.where(said).select("path", "file_ord", "lang", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("word"))
    # test_<func>, <func> and <func>_<suffix> are all found by equality on what the word may stand for
    stems = words.withColumn("func", F.explode(test_stems(F.col("word"))))
    testish = F.lower("path").rlike("test|spec") | (F.col("lang").isin(*own_ok) & (F.col("path") == F.col("own")))
    hits = stems.join(names.hint(join_hint(names)), "func").where(testish).select("func", "path", "file_ord", "line_no").distinct()
    spans = written(bounds(hits, shape), "spans")
    bodies = spans.hint(join_hint(spans)).join(blocks(spans.select("path", "start0", "end0").distinct(), lines), ["path", "start0", "end0"])
    first = bodies.groupBy("func", strip(F.col("source")).alias("body")).agg(F.min(F.struct("file_ord", "path", "line_no", "source")).alias("f"))
    return first.select("func", "f.path", "f.line_no", F.col("f.source").alias("code"))

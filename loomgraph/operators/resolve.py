"""Scopes, identifiers, variable definitions, classes and their members."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import Language, by_name, extension, languages
from ..runtime import join_hint, written
from .graph import searched
from .index import indent, strip

WORD = r"[A-Za-z_][A-Za-z0-9_]*"
_TYPE = r"[A-Za-z_][A-Za-z0-9_<>:,*&]*"
_ASSIGN = re.compile(r"(?<![=!<>:+\-*/%&|^])(?::=|=(?![=>])|[+\-*/%&|^]=)")


def split_top(text: str, mark: str, pairs: str = "()[]{}") -> list[str]:
    """Parts of text between marks that are in no bracket."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        k = pairs.find(c)
        if k >= 0:
            depth = max(0, depth + (1 if k % 2 == 0 else -1))
        elif c == mark and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]]


def without_templates(name: str) -> str:
    """A name without its template arguments, however nested."""
    while (short := re.sub(r"<[^<>]*>", "", name)) != name:
        name = short
    return name


@lru_cache(maxsize=4096)
def _patterns(var: str) -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    alone = rf"(?<![.\w])(?<!->)(?<!::){re.escape(var)}\b"
    typed = rf"(?:(?:const|static|extern|volatile|mutable|thread_local|constexpr)\s+)*((?:{_TYPE}\s+)*{_TYPE})(?:\s*[*&]+\s*|\s+)(?:(?:const|volatile)\s+)*{alone}"
    return re.compile(alone), re.compile(rf"\b(?:let|const|var|mut)\b[^;=]*?{alone}"), re.compile(rf"^\s*{typed}"), re.compile(rf"^\s*(?:[*&]\s*)*{typed}")


# words that the line rules read; a variable of such a name gets patterns of its own
_RULE_WORDS = frozenset("let const var mut static extern volatile mutable thread_local constexpr for if while def fn function sub func".split())
_STAND_IN = "the_name_looked_for"


def defines(line: str, var: str, language: Language) -> bool:
    """Whether a line's code defines a variable: as an assignment's left side, after let, const, var or mut, after a type, or as a parameter of a header.

    The name is written over by one stand-in first, so that patterns are compiled once and not for each name.
    """
    if var.isascii() and var.isidentifier() and var not in _RULE_WORDS and var not in language.flow and _STAND_IN not in line:
        line, var = re.sub(r"\w+", lambda m: _STAND_IN if m[0] == var else m[0], line), _STAND_IN
    return _defines_in(line, var, language)


def _defines_in(line: str, var: str, language: Language) -> bool:
    alone, let, typed, param = _patterns(var)
    flow = set(language.flow)
    statements = split_top(line, ";")
    for i, part in enumerate(statements):
        if not alone.search(part):
            continue
        head = re.match(r"\s*(?:for|if|while)\s*\(([^)]*)\)?", part)
        if head:
            if any(_defines_in(x, var, language) for x in head[1].split(";") if alone.search(x)):
                return True
            continue
        assign = _ASSIGN.search(part)
        if assign:
            left = part[: assign.start()]
            word = re.match(rf"\s*({WORD})\b", left)
            if alone.search(left) and (assign.group() == ":=" or not (word and word[1] in flow)):
                return True
            continue
        if let.search(part):
            return True
        m = typed.search(part)
        if m and re.split(r"\W", m[1], maxsplit=1)[0] not in flow:
            return True
        named = re.search(r"\b(?:def|fn|function|sub|func)\s+\w+", part)
        args = re.search(r"\(([^)]*)\)", part)
        if not args or not alone.search(args[1]) or not (named or language.c_style):
            continue
        if not language.c_style:
            return True
        before = part[: args.start()].strip()
        is_header = before and before not in flow and i == len(statements) - 1 and (re.search(r"\s", before) or before.startswith("~") or _is_constructor(before))
        if is_header and any((m := param.search(x)) and re.split(r"\W", m[1], maxsplit=1)[0] not in flow for x in split_top(args[1], ",")):
            return True
    return False


def _is_constructor(before: str) -> bool:
    if "::" not in before:
        return True
    owner, name = before.rsplit("::", 1)
    return without_templates(owner).split("::")[-1].strip() == without_templates(name).strip().lstrip("~")


def scope_rows(clean: list[str], stripped: list[str], indentation: bool) -> list[tuple[int, int, int, int, int]]:
    """(scope_id, parent_id, start_line, end_line, indent) of a file's scopes; scope 0 is the whole file."""
    last = len(clean)
    rows = [[0, -1, 1, last, -1]]
    open_ = [0]
    for no, (code, text) in enumerate(zip(clean, stripped, strict=True), 1):
        if indentation:
            if not code.strip() or text.strip().startswith("#"):
                continue
            deep = len(text) - len(text.lstrip())
            while len(open_) > 1 and deep <= rows[open_[-1]][4]:
                rows[open_.pop()][3] = no - 1
            if code.rstrip().endswith(":"):
                rows.append([len(rows), open_[-1], no, last, deep])
                open_.append(len(rows) - 1)
            continue
        for c in re.findall(r"[{}]", code):
            if c == "{":
                rows.append([len(rows), open_[-1], no, last, 0])
                open_.append(len(rows) - 1)
            elif len(open_) > 1:
                rows[open_.pop()][3] = no
    return [tuple(r) for r in rows]


def scopes(lines: DataFrame) -> DataFrame:
    """scopes(path, scope_id, parent_id, start_line, end_line, indent), a file at a time."""
    flat = [x.name for x in languages() if x.indentation]
    files = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "clean", "stripped"))).alias("l"), F.first(F.col("lang").isin(*flat)).alias("flat"))

    @F.pandas_udf("array<struct<scope_id:int,parent_id:int,start_line:int,end_line:int,indent:int>>")
    def build(clean: pd.Series, stripped: pd.Series, flat: pd.Series) -> pd.Series:
        names = ("scope_id", "parent_id", "start_line", "end_line", "indent")
        return pd.Series([[dict(zip(names, r, strict=True)) for r in scope_rows(list(c), list(s), f)] for c, s, f in zip(clean, stripped, flat, strict=True)])

    return files.select("path", F.inline(build(F.col("l.clean"), F.col("l.stripped"), F.col("flat"))))


def innermost(targets: DataFrame, of_scopes: DataFrame) -> DataFrame:
    """targets(path, line_no, ...) with scope_id of the innermost scope that holds the line: by file, the last one opened. A line belongs to the last scope that begins at or above it or to one around that, so each target walks up from one scope instead of meeting all of its file."""
    begun = Window.partitionBy("path").orderBy("line_no", "k").rowsBetween(Window.unboundedPreceding, 0)
    asked = targets.select("path", "line_no").distinct().select("path", F.col("line_no").cast("long").alias("line_no"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("scope_id"))
    marks = of_scopes.select("path", F.col("start_line").cast("long").alias("line_no"), F.lit(0).alias("k"), "scope_id")
    at = asked.unionByName(marks).withColumn("scope_id", F.max("scope_id").over(begun)).where("k = 1").select("path", "line_no", "scope_id")
    tree = of_scopes.select("path", "scope_id", "parent_id", "end_line")
    out, left = None, written(at, "walk")
    how = join_hint(left)
    while True:  # one round a level of nesting that ended above the line
        step = left.hint(how).join(tree, ["path", "scope_id"])
        done = step.where("line_no <= end_line").select("path", "line_no", "scope_id")
        out = done if out is None else out.unionByName(done)
        left = written(step.where("line_no > end_line and parent_id >= 0").select("path", "line_no", F.col("parent_id").alias("scope_id")), "walk")
        if left.isEmpty():
            return targets.join(out.hint(how), ["path", "line_no"]).select(*targets.columns, "scope_id")


def identifiers(lines: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, line_no, name, utf16) of variables on lines: not members, calls or keywords; utf16 is the offset in UTF-16 units of the first such place in the raw line."""
    pattern = rf"(?<![\w.$])(?<!->)({WORD})(?!\w)(?!\s*\()(?!\s*::)"
    flow = F.lit(False)
    for x in languages():
        flow = flow | ((F.col("lang") == x.name) & F.col("name").isin(*x.flow)) if x.flow else flow
    rows = lines.select("path", "lang", "line_no", "raw", F.explode(F.array_distinct(F.regexp_extract_all("clean", F.lit(pattern), F.lit(1)))).alias("name"))
    rows = rows.where(~flow & ~F.col("name").isin("def", "class", "self", "this", "True", "False", "None", "true", "false", "null", "let", "const", "var", "mut", "fn", "func", "function", *ignored))
    # the engine's strings are UTF-16, and so is a match's place
    at = F.regexp_instr("raw", F.concat(F.lit(r"(?<![\w.])"), F.col("name"), F.lit(r"(?!\w)"))) - 1
    return rows.select("path", "line_no", "name", F.greatest(at, F.lit(0)).alias("utf16"))


def utf16_length(text):
    """Length of a string in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def _defines(clean, name, lang):
    @F.pandas_udf("boolean")
    def run(clean: pd.Series, name: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([defines(c, n, by_name(x)) for c, n, x in zip(clean, name, lang, strict=True)], dtype=bool)

    # else the optimizer asks it of every word, below the join that leaves a few
    return run.asNondeterministic()(clean, name, lang)


def variable_definitions(names: DataFrame, lines: DataFrame) -> DataFrame:
    """(name, path, file_ord, line_no, code) of lines that define one of names(name): those that have the word, as found by a join, then a cheap pattern (something assigned, declared, typed or bracketed), then the line rules."""
    some = lines.where(F.col("clean").rlike(r"=|\(|\b(?:let|const|var|mut)\b|[A-Za-z_>*&]\s+[*&]*[A-Za-z_]"))
    words = some.select("path", "file_ord", "lang", "line_no", "clean", "raw", F.explode(F.array_distinct(F.regexp_extract_all("clean", F.lit(WORD), F.lit(0)))).alias("name"))
    names = written(names.select("name").distinct(), "names")
    hits = words.join(names.hint(join_hint(names)), "name")
    return hits.where(_defines(F.col("clean"), F.col("name"), F.col("lang"))).select("name", "path", "file_ord", "line_no", strip(F.col("raw")).alias("code"))


def resolve_variables(uses: DataFrame, lines: DataFrame, of_scopes: DataFrame, imported: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """uses(path, line_no, name) with resolved_type and the definition's def_path, def_line and code.

    First that has one: an enclosing scope from inside out, nearest line above first (local_regex); a member of the
    enclosing class or an ancestor (member_regex); the top level of the own file, then of imported(path, file) in the
    order of their line_no, if they have one, then of the first file in listing order with the same extension, always
    with the file's first such line (global_regex). Otherwise none. Globals are reduced to one a file and name, and to
    one an extension and name, before any use meets them.
    """
    uses = written(uses.select("path", "line_no", "name").distinct(), "uses")
    how = join_hint(uses)
    many = uses.hint(how)
    # what is made of many uses is many too; of few ones, Spark sees how much comes
    kept = lambda df: df.hint("merge") if how == "merge" else df
    found = written(variable_definitions(uses, lines).withColumnRenamed("path", "def_path").withColumnRenamed("line_no", "def_line"), "vardefs")
    placed = written(innermost(found.select(F.col("def_path").alias("path"), "file_ord", F.col("def_line").alias("line_no"), "name", "code").distinct(), of_scopes), "placed")
    depth_of = of_scopes.select("path", "scope_id", "start_line", "end_line")
    local = many.join(placed.select("path", F.col("line_no").alias("def_line"), "name", "code", "scope_id"), ["path", "name"]).where("def_line <= line_no")
    local = kept(local).join(depth_of, ["path", "scope_id"]).where(F.col("line_no").between(F.col("start_line"), F.col("end_line")) & (F.col("scope_id") > 0))
    local = local.select("path", "line_no", "name", F.lit(1).alias("priority"), (-F.col("start_line")).cast("long").alias("k1"), (-F.col("def_line")).alias("k2"), F.col("path").alias("def_path"), "def_line", "code", F.lit("local_regex").alias("resolved_type"))
    top = placed.where("scope_id = 0").groupBy(F.col("path").alias("def_path"), "name").agg(F.min(F.struct(F.col("line_no").alias("def_line"), "code")).alias("d"), F.min("file_ord").alias("file_ord"))
    top = top.select("def_path", "name", "file_ord", "d.def_line", "d.code")
    kind = F.lit("global_regex").alias("resolved_type")
    zero = F.lit(0).cast("long")
    own = many.join(top.withColumn("path", F.col("def_path")), ["path", "name"]).withColumns({"priority": F.lit(3), "k1": zero})
    order = F.min("line_no") if "line_no" in imported.columns else F.min(zero)
    far = many.join(imported.groupBy("path", F.col("file").alias("def_path")).agg(order.cast("long").alias("k1")), "path")
    far = kept(far).join(top, ["def_path", "name"]).withColumn("priority", F.lit(4))
    # the own file can't win here: where it has a definition, that went before
    of_ext = top.groupBy(extension(F.col("def_path")).alias("ext"), "name").agg(F.min(F.struct("file_ord", "def_path", "def_line", "code")).alias("d")).select("ext", "name", "d.*")
    same = uses.withColumn("ext", extension(F.col("path"))).hint(how).join(of_ext, ["ext", "name"]).withColumns({"priority": F.lit(5), "k1": zero})
    every = local
    for d in (own, far, same):
        every = every.unionByName(d.select("path", "line_no", "name", "priority", "k1", F.col("file_ord").cast("long").alias("k2"), "def_path", "def_line", "code", kind))
    if members is not None:
        every = every.unionByName(many.join(members, ["path", "line_no", "name"]).select("path", "line_no", "name", F.lit(2).alias("priority"), zero.alias("k1"), zero.alias("k2"), "def_path", "def_line", "code", F.lit("member_regex").alias("resolved_type")))
    best = every.groupBy("path", "line_no", "name").agg(F.min_by(F.struct("resolved_type", "def_path", "def_line", "code"), F.struct("priority", "k1", "k2", "def_path", "def_line")).alias("b"))
    return uses.join(kept(best), ["path", "line_no", "name"], "left").select("path", "line_no", "name", F.coalesce("b.resolved_type", F.lit("none")).alias("resolved_type"), "b.def_path", "b.def_line", "b.code")


CLASS = r"^\s*(?:[\w@<>]+\s+)*?(?:class|struct|interface)\s+(\w+)"


def classes(lines: DataFrame, of_scopes: DataFrame) -> DataFrame:
    """(path, name, line_no, end_line) of class-like blocks."""
    go = F.regexp_extract("clean", r"^\s*type\s+(\w+)\s+(?:struct|interface)\b", 1)
    name = F.when(F.col("lang") == "go", go).otherwise(F.regexp_extract("clean", CLASS, 1))
    head = lines.withColumn("name", name).where("name <> ''").select("path", "name", "line_no")
    return head.join(of_scopes.where("scope_id > 0").select("path", F.col("start_line").cast("long").alias("line_no"), "end_line"), ["path", "line_no"])


def parents(lines: DataFrame) -> DataFrame:
    """(path, name, parent, at) of the classes that each class extends, in order."""
    clean, lang = F.col("clean"), F.col("lang")
    listed = F.when(lang == "python", F.regexp_extract(clean, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1)).when(lang == "c-family", F.regexp_extract(clean, r"\b(?:class|struct)\s+\w+[^:{]*:(?!:)\s*([^{]+)", 1)).otherwise(F.regexp_extract(clean, r"\bextends\s+([\w.]+)", 1))
    bare = F.transform(F.split(listed, ","), lambda x: F.regexp_extract(F.regexp_replace(F.regexp_replace(x, r"\b(?:public|private|protected|virtual)\b", ""), r"<.*", ""), r"(\w+)\s*$", 1))
    name = F.regexp_extract(clean, CLASS, 1)
    return lines.select("path", name.alias("name"), F.posexplode(bare).alias("at", "parent")).where("name <> '' and parent <> '' and parent <> 'object'")


def members(lines: DataFrame, of_classes: DataFrame) -> DataFrame:
    """(path, class, name, line_no, code) of fields: assigned or typed in a class's body, or `self.x =` in its methods; the first of each name."""
    inside = lines.join(of_classes.select("path", F.col("name").alias("class"), F.col("line_no").alias("from_"), "end_line"), "path").where("line_no > from_ and line_no <= end_line")
    own = F.regexp_extract("clean", r"^\s*self\.(\w+)\s*(?::[^=]+)?=(?!=)", 1)
    plain = F.regexp_extract("clean", r"^\s*(?:[\w<>\[\],:*&]+\s+)*[*&]*(\w+)\s*(?::[^=(]+)?=(?!=)", 1)
    typed = F.regexp_extract("clean", r"^\s*(?:[\w<>\[\],:*&]+\s+)+[*&]*(\w+)\s*;", 1)
    field = F.regexp_extract("clean", r"^\s*(\w+)\s+[\w*\[\].]+\s*$", 1)
    name = F.coalesce(F.nullif(own, F.lit("")), F.nullif(plain, F.lit("")), F.nullif(typed, F.lit("")), F.when(F.col("lang") == "go", F.nullif(field, F.lit(""))))
    rows = inside.withColumn("name", name).where(F.col("name").isNotNull() & ~F.col("name").isin("return", "if", "else", "for", "while"))
    first = rows.groupBy("path", "class", "name").agg(F.min(F.struct("line_no", "raw")).alias("f"))
    return first.select("path", "class", "name", "f.line_no", strip(F.col("f.raw")).alias("code"))


def member_definitions(uses: DataFrame, of_classes: DataFrame, of_parents: DataFrame, of_members: DataFrame, imported: DataFrame) -> DataFrame:
    """(path, line_no, name, depth, def_path, def_line, code) for uses(path, line_no, name) inside a class: the first hit of a depth-first search over its own members and then, parent by parent, theirs; an ancestor's file is the own one, an imported one or any, in this order."""
    held = uses.join(of_classes.select("path", F.col("name").alias("class"), F.col("line_no").alias("from_"), "end_line"), "path").where("line_no >= from_ and line_no <= end_line")
    up = searched(held.select(F.col("class").alias("name")).distinct(), of_parents).select(F.col("name").alias("class"), "ancestor", "trail")
    field = of_members.select(F.col("class").alias("ancestor"), "name", F.col("path").alias("def_path"), F.col("line_no").alias("def_line"), "code")
    hit = held.join(up, "class").join(field, ["ancestor", "name"])
    near = imported.select("path", F.col("file").alias("def_path")).distinct().withColumn("near", F.lit(1))
    hit = hit.join(near, ["path", "def_path"], "left").withColumn("rank", F.when(F.col("path") == F.col("def_path"), 0).when(F.col("near") == 1, 1).otherwise(2))
    # of nested classes the inner one first
    best = hit.groupBy("path", "line_no", "name").agg(F.min_by(F.struct(F.size("trail").alias("depth"), "def_path", "def_line", "code"), F.struct(-F.col("from_"), "trail", "rank", "def_path", "def_line")).alias("b"))
    return best.select("path", "line_no", "name", "b.*")


def trace_data(seeds: DataFrame, lines: DataFrame, of_scopes: DataFrame, imported: DataFrame, depth: int = 1, own_members: DataFrame | None = None) -> DataFrame | None:
    """(path, line_no, code, distance) of the definitions of the variables on seeds(path, line_no), and, up to `depth`, of those on the lines found; each line once, at its least distance."""
    frontier = written(seeds.select("path", "line_no").distinct(), "seeds")
    seen, out = frontier, None
    for level in range(depth):
        uses = identifiers(lines.join(frontier.hint(join_hint(frontier)), ["path", "line_no"], "left_semi")).select("path", "line_no", "name")
        got = resolve_variables(uses, lines, of_scopes, imported, own_members).where("resolved_type <> 'none'")
        new = got.select(F.col("def_path").alias("path"), F.col("def_line").alias("line_no"), "code").distinct().join(seen.hint(join_hint(seen)), ["path", "line_no"], "left_anti")
        new = written(new.withColumn("distance", F.lit(level + 1)), "data")
        out = new if out is None else out.unionByName(new)
        frontier = new.select("path", "line_no")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return out

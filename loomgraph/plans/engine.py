"""From a snapshot and a diff to the context of a change, within a byte budget."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import fence_of
from ..operators import graph, index, linkage, rank, resolve, syntax
from ..runtime import ship, written
from ..sources import diff as diffs
from ..sources.artifacts import parse_config

SECTIONS = ("## 2. Modified Core Logic\n", "## 3. Data & State Context\n", "## 4. Downstream Called Functions\n", "## 5. Validating Unit Tests\n", "## 6. Upstream Dependent Callers\n", "## 7. Cross-Language FFI Linkages\n")
JSON_SECTIONS = {"core": "modified_core_logic", "data": "data_and_state_context", "callees": "downstream_called_functions", "tests": "validating_unit_tests", "callers": "upstream_dependent_callers", "ffi": "cross_language_ffi_linkages"}


@dataclass(frozen=True)
class Options:
    """What a run can be told; from_sources() checks types against these defaults."""

    format: str = "md"
    max_lines: int = 1500
    max_mb: float = 2.0
    max_interface_depth: int = 15
    disable_pruning: bool = False
    skip_ffi: bool = False
    skip_macro_expansion: bool = False
    caller_depth: int = 1
    callee_depth: int = 1
    data_depth: int = 1

    @classmethod
    def from_sources(cls, config: str | None = None, **given) -> Options:
        """Defaults, then a configuration text, then what is given; None means not given. Unknown keys of the text are left out."""
        known = {f.name: getattr(cls(), f.name) for f in fields(cls)}
        chosen = {k: v for k, v in parse_config(config or "{}").items() if k in known} | {k: v for k, v in given.items() if v is not None}
        for k, v in chosen.items():
            if k not in known:
                raise TypeError(f"no option {k}")
            want = type(known[k])
            if isinstance(v, bool) != (want is bool) or not isinstance(v, (int, float) if want is float else want):
                raise TypeError(f"{k} must be {want.__name__}")
            chosen[k] = want(v)
        return replace(cls(), **chosen)


class ContextEngine:
    """Tables of a snapshot's code, and the context of a change in them."""

    def __init__(self, spark: SparkSession, files: DataFrame, options: Options | None = None):
        self.spark, self.options = ship(spark), options or Options()
        self.files = written(files.select("path", "file_ord", "lang", "content"), "files")
        self.lines = written(index.code_lines(self.files), "lines")
        self.tokens = written(index.tokens(self.lines), "tokens")
        self.defs = written(index.definitions(self.lines).distinct(), "defs")
        self.shapes = written(index.shapes(self.lines), "shapes")
        self.tree = written(syntax.syntax(self.files), "tree")

    def changed_spans(self, changed: DataFrame) -> DataFrame:
        """(path, start0, end0, func, source) of the blocks around changed(path, line_no)."""
        spans = syntax.bounds_or_lexical(changed.join(self.files.select("path"), "path", "left_semi"), self.tree, self.shapes).select(*graph.SPAN).distinct()
        named = index.blocks(spans, self.lines)
        return written(named.withColumn("func", index.function_name(F.col("code"), F.col("start0"), F.col("end0"))), "core")

    def context(self, changed: DataFrame, coverage: DataFrame | None = None, units: DataFrame | None = None, references: DataFrame | None = None, expanded: DataFrame | None = None) -> dict[str, DataFrame]:
        """The sections' rows for changed(path, line_no). references(func, target, path, line_no, seq, code), where a resolver gives some for a function, replace its lexical callers and are cut to the closest; functions without any keep the lexical ones; expanded(name, path, line_no, code) adds mentions after macro expansion; units(file) links changed headers to what includes them."""
        o = self.options
        core = self.changed_spans(changed)
        of_scopes = written(resolve.scopes(self.lines), "scopes")
        imported = written(linkage.resolve_imports(linkage.imports(self.lines), self.files), "imports")
        of_classes = resolve.classes(self.lines, of_scopes)
        uses = resolve.identifiers(self.lines.join(changed, ["path", "line_no"], "left_semi")).select("path", "line_no", "name")
        fields_ = resolve.member_definitions(uses, of_classes, resolve.parents(self.lines), resolve.members(self.lines, of_classes), imported)
        data = resolve.trace_data(changed, self.lines, of_scopes, imported, o.data_depth, fields_)
        extra = None if o.skip_macro_expansion else expanded
        if references is not None:
            found = references if o.disable_pruning else rank.closest(references, o.max_interface_depth)
            callers_ = found.select(F.col("func").alias("name"), "path", "line_no", "code").withColumn("distance", F.lit(1))
            missing = core.join(references.select("func").distinct(), "func", "left_anti")
            lexical, visited = graph.trace_callers(missing, self.lines, self.tokens, self.defs, self.shapes, o.caller_depth, extra)
            callers_ = callers_ if lexical is None else callers_.unionByName(lexical.select(*callers_.columns))
            visited = visited.unionByName(core.select(*graph.SPAN)).distinct()
        else:
            callers_, visited = graph.trace_callers(core, self.lines, self.tokens, self.defs, self.shapes, o.caller_depth, extra)
        if units is not None:
            incl = linkage.includes(self.files)
            linked = linkage.build_links(changed.select("path").distinct(), units, incl).select(F.col("header").alias("name"), F.col("unit").alias("path"), F.lit(0).cast("long").alias("line_no"), F.lit("[Build System Linkage]").alias("code"), F.lit(1).alias("distance"))
            callers_ = linked if callers_ is None else callers_.unionByName(linked)
        callees_ = graph.trace_callees(core, visited, self.lines, self.defs, self.shapes, o.callee_depth)
        out = {"core": core, "data": data, "callees": callees_, "tests": linkage.find_tests(core, self.lines, self.shapes), "callers": callers_}
        if not o.skip_ffi:
            out["ffi"] = linkage.ffi_callers(core, linkage.ffi_exports(self.files), self.tokens, self.defs).withColumn("distance", F.lit(1))
        if coverage is not None:
            out["coverage"] = linkage.coverage_status(changed, coverage)
        return {k: v for k, v in out.items() if v is not None}

    def items(self, context: dict[str, DataFrame]) -> DataFrame:
        """(section, ord, header, text) of a context, each section in its order."""
        o, parts = self.options, []

        def add(section: int, df: DataFrame | None, text, *order):
            if df is not None:
                parts.append(df.select(F.lit(section).alias("section"), F.struct(*[F.col(c).cast("string") if c not in ("distance", "line_no", "start0") else F.col(c).cast("long") for c in order]).alias("k"), F.lit(SECTIONS[section - 2]).alias("header"), text.alias("text")))

        def fenced(title, code):
            return F.concat(title, F.lit("\n```"), fence_of(F.col("path")), F.lit("\n"), code, F.lit("\n```\n"))

        limit = max(1, o.max_lines - 100)
        for section, name in ((2, "core"), (4, "callees")):
            df = context.get(name)
            if df is not None:
                df = df.join(self.files.select("path", "lang"), "path").withColumn("p", rank.prune_blocks(F.col("source"), F.col("lang"), limit))
                far = F.concat(F.lit(" (Distance "), F.col("distance").cast("string"), F.lit(")")) if section == 4 else F.lit("")
                title = F.concat(F.lit("### `"), "path", F.lit("` -> `"), "func", "p.suffix", F.lit("()`"), far)
                add(section, df, fenced(title, F.col("p.text")), *(["distance"] if section == 4 else []), "path", "start0")
        line_title = F.concat(F.lit("### `"), "path", F.lit("` (Line "), F.col("line_no").cast("string"), F.lit(")"))
        add(3, context.get("data"), fenced(line_title, F.col("code")), "path", "line_no")
        add(5, context.get("tests"), fenced(line_title, F.col("code")), "path", "line_no")
        for section, name, sure in ((6, "callers", "MEDIUM"), (7, "ffi", "HIGH")):
            df = context.get(name)
            if df is not None:
                trust = F.when(F.col("code").contains("FFI Bridge"), "LOW (Ghost Risk)").otherwise(sure)
                text = F.concat(F.lit("- `"), "path", F.lit("` (L"), F.col("line_no").cast("string"), F.lit(", Distance "), F.col("distance").cast("string"), F.lit("): `"), "code", F.lit("` **[Confidence: "), trust, F.lit("]**\n"))
                add(section, df, text, "distance", "path", "line_no")
        # each section has its own key, so the order is numbered section by section, by ranges and not in one task
        numbered = [rank.running(p.withColumn("one", F.lit(1).cast("long")), ["section"], ["k", "text"], "one").withColumnRenamed("sofar", "ord").drop("k", "one") for p in parts]
        out = numbered[0]
        for p in numbered[1:]:
            out = out.unionByName(p)
        return out.select("section", "ord", "header", "text")

    def markdown(self, context: dict[str, DataFrame], raw_diff: str) -> str:
        """The payload. What fits the budget is bounded by it, so it is assembled on the driver."""
        start = f"# LLM Context Payload\n## 1. Raw Diff\n```diff\n{raw_diff}\n```\n"
        budget = int(self.options.max_mb * 1024 * 1024)
        items = written(self.items(context), "items")
        kept = rank.sticky_pack(items, budget, len(start.encode())).orderBy("section", "ord").collect()
        out, section = [start], None
        for r in kept:
            out += [r.header] * (r.section != section) + [r.text]
            section = r.section
        if len(kept) < items.count():
            out.append(f"\n\n> [!WARNING]\n> Payload truncated because it exceeded the size limit of {self.options.max_mb:.2f} MB.\n")
        return "".join(out)

    def json_rows(self, context: dict[str, DataFrame]) -> DataFrame:
        """(section, json) of all rows of a context, never cut: a table, however many there are."""
        out = None
        for k, name in JSON_SECTIONS.items():
            if k in context:
                df = context[k]
                keep = [c for c in ("path", "func", "name", "line_no", "distance", "code", "source") if c in df.columns]
                rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*keep)).alias("json"))
                out = rows if out is None else out.unionByName(rows)
        return out

    def json(self, context: dict[str, DataFrame], raw_diff: str) -> str:
        """All rows as one document. It is as large as they are; json_rows() is the table to write instead where that is too much."""
        out = {"raw_diff": raw_diff} | {name: [] for name in JSON_SECTIONS.values()}
        for r in self.json_rows(context).toLocalIterator():
            out[r.section].append(json.loads(r.json))
        return json.dumps(out, indent=2, ensure_ascii=False)

    def run(self, diff: DataFrame, raw_diff: str = "", **sources) -> str:
        """The payload of diff(text), a unified diff without context."""
        changed = written(diffs.changed_lines(diffs.split_diff(diff)), "changed")
        context = self.context(changed, **sources)
        return self.json(context, raw_diff) if self.options.format == "json" else self.markdown(context, raw_diff)


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that only one of two resolvers found, with `only` saying which."""
    return first.exceptAll(second).withColumn("only", F.lit("first")).unionByName(second.exceptAll(first).withColumn("only", F.lit("second")))


def compare_runs(engine: ContextEngine, diff: DataFrame, raw_diff: str, references: DataFrame, **sources) -> tuple[str, str, DataFrame]:
    """Two runs over one diff: the payload by lexical search, the one by a resolver's references, and the callers that only one of them has, with `only` lexical or resolver."""
    changed = written(diffs.changed_lines(diffs.split_diff(diff)), "changed")
    both = [engine.context(changed, **sources), engine.context(changed, references=references, **sources)]
    render = engine.json if engine.options.format == "json" else engine.markdown
    cols = ["name", "path", "line_no"]
    rows = [c["callers"].select(*cols).distinct() for c in both]
    only = compare(*rows).withColumn("only", F.when(F.col("only") == "first", "lexical").otherwise("resolver"))
    return render(both[0], raw_diff), render(both[1], raw_diff), only

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, index, linkage, rank, resolve
from loomgraph.operators.resolve import defines, scope_rows, split_top, without_templates
from loomgraph.functions.languages import by_name
from loomgraph.sources.files import with_order


def files(spark, **texts):
    return with_order(spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), i, v) for i, (k, v) in enumerate(texts.items())], "path string, file_ord int, content string"))


def bounds(spark, name, text, line):
    lines = index.code_lines(files(spark, **{name: text}))
    rows = index.bounds(spark.createDataFrame([(name.replace("_dot_", "."), line)], "path string, line_no long"), index.shapes(lines)).collect()
    return [(r.start0, r.end0) for r in rows]


def test_bounds(spark):
    assert bounds(spark, "a_dot_py", "def f():\n    def g():\n        pass\n    return g\nx = 1\n", 1) == [(0, 4)]
    assert bounds(spark, "a_dot_cpp", "int f(int a) {\n  return a;\n}\n", 2) == [(0, 3)]
    assert bounds(spark, "A_dot_java", "class A {\n  public int f() {\n    return 1;\n  }\n}\n", 3) == [(1, 4)]
    assert bounds(spark, "a_dot_c", "int f() {\n  /* } */ g();\n}\n", 2) == [(0, 3)]
    assert bounds(spark, "a_dot_c", "int f() {\n  g();\n" + "x;\n" * 40, 2) == [(0, 21)]
    assert bounds(spark, "a_dot_py", "x = 1\n", 0) == []


def test_callers_skip_definitions_not_prototypes(spark):
    lines = index.code_lines(files(spark, a_dot_cpp="int target();\nint target() {\n  return 1;\n}\nint go() { return target(); }\n"))
    names = spark.createDataFrame([("target",)], "name string")
    got = index.callers(names, index.tokens(lines), index.definitions(lines)).collect()
    assert sorted(r.line_no for r in got) == [1, 5]


def test_names_in_comments_and_strings(spark):
    lines = index.code_lines(files(spark, a_dot_py='# target\nx = "target"\ny = """\ntarget()\n"""\n'))
    assert index.tokens(lines).where("token = 'target'").count() == 0


def test_definition_first_match(spark):
    lines = index.code_lines(files(spark, a_dot_py="def other():\n    helper()\n", b_dot_py="def helper():\n    pass\n", c_dot_py="def helper():\n    pass\n"))
    got = index.first_definition(spark.createDataFrame([("helper",), ("no",)], "name string"), index.definitions(lines)).collect()
    assert [tuple(r) for r in got] == [("helper", "b.py", 1)]


def test_function_name(spark):
    df = spark.createDataFrame([("def abc(x):",), ("if (x) run(y)",), ("x = 1",)], "c string")
    assert [r[0] for r in df.select(index.function_name(F.col("c"), F.lit(0), F.lit(3))).collect()] == ["abc", "run", "block_lines_0_3"]


def test_reach_has_least_depth_and_stops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "src string, dst string")
    got = {r.node: r.depth for r in graph.reach(spark.createDataFrame([("a",)], "node string"), edges, 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_scopes():
    py = ["def f():", "  x = 1", "  if x:", "    y = 2", "z = 3"]
    assert [(r[2], r[3]) for r in scope_rows(py, py, True)] == [(1, 5), (1, 4), (3, 4)]
    c = ["int f() {", "  int x;", "  if (x) {", "    y();", "  }", "}"]
    assert [(r[1], r[2], r[3]) for r in scope_rows(c, c, False)] == [(-1, 1, 6), (0, 1, 6), (1, 3, 5)]


@pytest.mark.parametrize(
    ("line", "var", "lang", "want"),
    [
        ("x = 1", "x", "python", True), ("y = x", "x", "python", False), ("return x", "x", "python", False), ("def f(a, x):", "x", "python", True),
        ("let mut x = 1;", "x", "rust", True), ("for (int i = 0; i < n; i++)", "i", "c-family", True), ("int f(int x) {", "x", "c-family", True),
        ("f(x);", "x", "c-family", False), ("const char *x;", "x", "c-family", True), ("self.x = 1", "x", "python", False), ("x := 2", "x", "go", True), ("if x == 1", "x", "go", False),
    ],
)
def test_defines(line, var, lang, want):
    assert defines(line, var, by_name(lang)) is want


def test_splitters():
    assert split_top("a;b(c;d);e", ";") == ["a", "b(c;d)", "e"]
    assert without_templates("A<B<C>, D>::f") == "A::f"


def test_variables_resolve_from_inside_out(spark):
    fs = files(spark, a_dot_py="import b\nLIMIT = 1\ndef f():\n    x = LIMIT\n    if x:\n        x = 2\n        return x + FAR\n", b_dot_py="FAR = 9\n")
    lines = index.code_lines(fs)
    imp = linkage.resolve_imports(linkage.imports(lines), fs)
    uses = spark.createDataFrame([("a.py", 7, "x"), ("a.py", 4, "LIMIT"), ("a.py", 7, "FAR"), ("a.py", 7, "nothing")], "path string, line_no long, name string")
    got = {r.name: (r.resolved_type, r.def_path, r.def_line) for r in resolve.resolve_variables(uses, lines, resolve.scopes(lines), imp).collect()}
    assert got == {"x": ("local_regex", "a.py", 6), "LIMIT": ("global_regex", "a.py", 2), "FAR": ("global_regex", "b.py", 1), "nothing": ("none", None, None)}


def test_members_of_parents(spark):
    fs = files(spark, base_dot_py="class Base:\n    rate = 3\n", child_dot_py="from base import Base\nclass Child(Base):\n    def f(self):\n        return self.rate\n")
    lines = index.code_lines(fs)
    sc = resolve.scopes(lines)
    imp = linkage.resolve_imports(linkage.imports(lines), fs)
    of_classes = resolve.classes(lines, sc)
    uses = spark.createDataFrame([("child.py", 4, "rate")], "path string, line_no long, name string")
    got = resolve.member_definitions(uses, of_classes, resolve.parents(lines), resolve.members(lines, of_classes), imp).collect()
    assert [(r.def_path, r.def_line, r.depth) for r in got] == [("base.py", 2, 1)]


def test_identifier_offsets_are_utf16(spark):
    lines = index.code_lines(files(spark, a_dot_py="s = '😀' + total\n"))
    got = {r.name: r.utf16 for r in resolve.identifiers(lines).collect()}
    assert got == {"s": 0, "total": 11}


def test_imports_of_languages(spark):
    fs = files(spark, src__m_dot_py="x = 1\n", src__a_dot_rs="use crate::m::n;\nmod b;\n", src__b_dot_rs="\n", src__m__n_dot_rs="\n", main_dot_py="from src.m import x\nimport src.m as q, os\n", w_dot_ts="import {a} from './v';\n", v_dot_ts="\n", p_dot_cpp='#include "inc/q.h"\n', inc__q_dot_h="\n")
    lines = index.code_lines(fs)
    got = {(r.path, r.file) for r in linkage.resolve_imports(linkage.imports(lines), fs).collect()}
    assert {("main.py", "src/m.py"), ("src/a.rs", "src/b.rs"), ("src/a.rs", "src/m/n.rs"), ("w.ts", "v.ts"), ("p.cpp", "inc/q.h")} <= got


def test_ffi_needs_another_extension(spark):
    fs = files(spark, a_dot_rs='#[no_mangle]\npub extern fn ab(x: i32) {}\nfn z() { ab(1) }\n', b_dot_cpp='extern "C" int ab(int);\nextern "C" int other(int);\n')
    assert {r.name for r in linkage.ffi_exports(fs).collect()} >= {"ab", "other"}
    toks = index.tokens(index.code_lines(fs))
    got = linkage.ffi_callers(spark.createDataFrame([("a.rs", "ab")], "path string, func string"), linkage.ffi_exports(fs), toks, toks).collect()
    assert {(r.path, r.line_no) for r in got} == {("b.cpp", 1)}


def test_build_links(spark):
    fs = files(spark, u1_dot_c='#include "inc/\\\nh.h"\n', u2_dot_c="#include <h.h>\n", u3_dot_c='#include "other/h.h"\n')
    headers = spark.createDataFrame([("src/inc/h.h",)], "path string")
    got = {r.unit for r in linkage.build_links(headers, fs.selectExpr("path AS file"), linkage.includes(fs)).collect()}
    assert got == {"u1.c", "u2.c"}


def test_tests_by_name(spark):
    lines = index.code_lines(files(spark, a_dot_py="def run():\n    pass\n", tests__t_dot_py="def test_run_behaviour():\n    assert run()\n\ndef test_run():\n    pass\n\ndef test_runner():\n    pass\n"))
    got = linkage.find_tests(spark.createDataFrame([("a.py", "run")], "path string, func string"), lines, index.shapes(lines)).collect()
    assert sorted(r.line_no for r in got) == [1, 4]


def test_closest_has_sentinel(spark):
    rows = [("f", "a/b/x.py", p, i, i, "c") for i, p in enumerate(["z/q.py", "a/b/y.py", "a/c/y.py", "a/b/x.py", ""])]
    got = rank.closest(spark.createDataFrame(rows, "func string, target string, path string, line_no long, seq long, code string"), 3).orderBy("rank").collect()
    assert [r.path for r in got] == ["a/b/x.py", "a/b/y.py", "a/c/y.py", rank.PRUNED]
    assert got[-1].code == "omitted 2"


def test_sticky_pack_stops_at_the_first_overflow(spark):
    items = spark.createDataFrame([(1, 1, "H", "aaaa"), (1, 2, "H", "b" * 50), (2, 1, "I", "c")], "section int, ord long, header string, text string")
    assert [(r.section, r.ord, r.bytes) for r in rank.sticky_pack(items, 20).collect()] == [(1, 1, 5)]


def test_upgrades_skip_and_go_on(spark):
    df = spark.createDataFrame([([11, 5, 5], [3, 3, 3])], "f array<int>, m array<int>")
    assert df.select(rank.upgrades(F.col("f"), F.col("m"), F.lit(11))).first()[0] == [False, True, False]


def test_prune_block():
    text = "class A:\n    def f(self):\n" + "        x = 1\n" * 20 + "    def g(self):\n        return 2"
    suffix, out = rank.prune_block(text, "python", 10)
    assert suffix == " (AST Semantically Pruned)" and "def f" in out and "def g" in out and len(out.split("\n")) <= 10
    assert rank.prune_block("a\nb\nc", "c-family", 2) == (" (Truncated)", "a\nb\n/* ... [Truncated] ... */")
    assert rank.prune_block("a", "c-family", 2) == ("", "a")


def test_defines_is_the_same_under_the_stand_in():
    """Patterns compiled for the name itself give what those of the stand-in give, on lines dealt from small words."""
    rng = random.Random(5)
    words = ["x", "if", "for", "let", "int", "x.", "->x", "::x", "=", "==", ":=", "+=", "(", ")", ";", ",", "*", "&", "foo", "xx", "const", "return", "std::vector<x>", "def", " ", "x::x", "the_name_looked_for"]
    for _ in range(20000):
        line = " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        for var in ("x", "foo", "let", "return"):
            for lang in ("python", "c-family", "javascript", "go"):
                language = by_name(lang)
                assert resolve.defines(line, var, language) is resolve._defines_in(line, var, language), (line, var, lang)

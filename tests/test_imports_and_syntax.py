from loomgraph.operators.linkage import statements, use_paths
from loomgraph.operators.rank import prune_block
from loomgraph.operators.resolve import resolve_variables, scopes
from loomgraph.operators.syntax import bounds_or_lexical, facts, identifiers_or_lexical, syntax
from loomgraph.operators.index import code_lines, shapes
from loomgraph.plans.engine import ContextEngine, compare_runs
from loomgraph.sources import artifacts
from loomgraph.sources.files import with_order


def test_import_statements():
    assert use_paths("crate::{a::b, c::{d, e as f}, g::*}") == ["a", "a/b", "c", "c/d", "c/e", "g"]
    assert statements(["use x::{", "  y,", "};", "mod m;", "fn f() {}"], "rust") == [(1, ["x", "x/y"]), (4, ["m"])]
    assert statements(["from p import (a,", "  b as c,", ")", "import x.y as z, w", "important = 1"], "python") == [(1, ["p", "p/a", "p/b"]), (4, ["x/y", "w"])]
    assert statements(["from p import a, \\\\".replace("\\\\", chr(92)), "    b"], "python") == [(1, ["p", "p/a", "p/b"])]


def test_facts():
    got = facts("def f(a):\n    é = a.b(c); g(d)\n    return é\n")
    assert ("def", "f", 1, 3, 4, False) in got and ("call", "b", 2, 2, 10, False) in got and ("name", "é", 2, 2, 4, True) in got
    assert ("name", "d", 2, 2, 18, False) in got and not any(r[:2] == ("name", "g") for r in got)
    assert facts("def (") is None


def test_tree_or_lexical(spark):
    fs = with_order(spark.createDataFrame([("a.py", 0, "def f():\n    def g():\n        x = 1\n    return g\n"), ("b.py", 1, "def f(:\n    y = 2\n"), ("c.c", 2, "int f(void) {\n  z = 3;\n}\n")], "path string, file_ord int, content string"))
    lines, tree = code_lines(fs), syntax(fs)
    asked = spark.createDataFrame([("a.py", 3), ("a.py", 4), ("b.py", 2), ("c.c", 2)], "path string, line_no long")
    got = {(r.path, r.line_no): (r.start0, r.end0) for r in bounds_or_lexical(asked, tree, shapes(lines)).collect()}
    assert got == {("a.py", 3): (1, 3), ("a.py", 4): (0, 4), ("b.py", 2): (0, 3), ("c.c", 2): (0, 3)}
    names = {(r.path, r.line_no, r.name) for r in identifiers_or_lexical(lines, tree).collect()}
    assert {("a.py", 3, "x"), ("b.py", 2, "y"), ("c.c", 2, "z")} <= names


def test_globals_come_in_listing_order(spark):
    fs = with_order(spark.createDataFrame([("z.py", 0, "\n\nv = 1\nv = 2\n"), ("a.py", 1, "v = 3\n"), ("u.py", 2, "def f():\n    return v\n")], "path string, file_ord int, content string"))
    lines = code_lines(fs)
    uses = spark.createDataFrame([("u.py", 2, "v")], "path string, line_no long, name string")
    none = spark.createDataFrame([], "path string, file string")
    got = resolve_variables(uses, lines, scopes(lines), none).first()
    assert (got.resolved_type, got.def_path, got.def_line, got.code) == ("global_regex", "z.py", 3, "v = 1")


def test_brace_pruning():
    source = "class A {\n  int f() {\n" + "   a;\n" * 3 + "  }\n  int g() {\n" + "   b;\n" * 9 + "  }\n}"
    suffix, text = prune_block(source, "java", 12)
    assert suffix == " (AST Semantically Pruned)" and text.count("a;") == 3 and "b;" not in text and "Body Omitted" in text and text.endswith("}")


def test_database_files(spark, tmp_path):
    (tmp_path / "cc.json").write_text('[{"directory": "/old", "file": "/old/a.c", "command": "cc -I/old/inc a.c"}]')
    assert artifacts.rewrite_database(spark, str(tmp_path / "cc.json"), str(tmp_path / "new.json"), "/old", "/new")
    unit = artifacts.read_commands(spark, str(tmp_path / "new.json")).first()
    assert (unit.directory, unit.command) == ("/new", "cc -I/new/inc a.c")
    (tmp_path / "bad.json").write_bytes(b"\xff{not json")
    assert not artifacts.rewrite_database(spark, str(tmp_path / "bad.json"), str(tmp_path / "copy.json"), "/old", "/new")
    assert (tmp_path / "copy.json").read_bytes() == b"\xff{not json"


def test_two_runs(spark):
    fs = with_order(spark.createDataFrame([("a.py", 0, "def helper():\n    return 1\ndef other():\n    return 2\n"), ("b.py", 1, "helper()\nother()\n")], "path string, file_ord int, content string"))
    engine = ContextEngine(spark, fs)
    diff = spark.createDataFrame([("diff --git a b\n--- a/a.py\n+++ b/a.py\n@@ -2 +2 @@\n@@ -4 +4 @@\n",)], "text string")
    refs = spark.createDataFrame([("helper", "a.py", "d/x.py", 7, 0, "helper()")], "func string, target string, path string, line_no long, seq long, code string")
    lexical, resolved, only = compare_runs(engine, diff, "", refs)
    # a function that the resolver says nothing about keeps its lexical callers
    assert "`b.py` (L1" in lexical and "`d/x.py` (L7" in resolved and "`b.py` (L1" not in resolved and "`b.py` (L2" in resolved
    assert sorted((r.name, r.path, r.only) for r in only.collect()) == [("helper", "b.py", "lexical"), ("helper", "d/x.py", "resolver")]

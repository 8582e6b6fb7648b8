import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.graph import inherited
from loomgraph.plans.engine import ContextEngine, Options, compare
from loomgraph.sources import artifacts, diff, git
from loomgraph.sources.files import case_sensitive, in_repository, newest_artifact, rewrite_root, with_order, within_root


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-C", str(top), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    for i, body in enumerate(("    return 1\n", "    return 2\n", "    return 3\n")):
        (top / "a.py").write_text(f"def helper():\n{body}\ndef user():\n    return helper()\n")
        run("add", ".")
        run("commit", "-q", "-m", f"c{i}")
    return str(top)


def test_hunks(spark):
    text = "--- a/x\n+++ b/x\n@@ -1,2 +4,3 @@ f\n@@ -8 +12 @@\n@@ -9 +15,0 @@\n@@ broken\n"
    df = spark.createDataFrame([("x", text)], "path string, diff string")
    assert sorted(r.line_no for r in diff.changed_lines(df).collect()) == [4, 5, 6, 12]


def test_ranges(repo):
    log = git.run_git(repo, "rev-list", "--reverse", "HEAD").decode().split()
    assert git.resolve_range(repo, "-2") == (log[0], log[2])
    assert git.resolve_range(repo, f"{log[0]}..{log[2]}") == (log[0], log[2])
    assert git.resolve_range(repo, f"{log[0]}+2") == (log[0], log[2])
    assert git.resolve_range(repo, f"{log[2]}-1") == (log[1], log[2])
    with pytest.raises(ValueError):
        git.resolve_range(repo, "nothing")


def test_end_to_end(spark, repo):
    start, end = git.resolve_range(repo, "-1")
    engine = ContextEngine(spark, git.snapshot(spark, repo, end))
    d = git.diff(spark, repo, start, end)
    out = engine.run(d.select("text"), d.first().raw)
    assert "`a.py` -> `helper()`" in out and "`a.py` (L5, Distance 1): `return helper()`" in out
    assert "-    return 2" in out
    none = ContextEngine(spark, git.snapshot(spark, repo, end), Options(caller_depth=0)).run(d.select("text"), "")
    assert "Distance 1): `return helper()`" not in none
    both = json.loads(ContextEngine(spark, git.snapshot(spark, repo, end), Options(format="json")).run(d.select("text"), "x"))
    assert both["raw_diff"] == "x" and both["upstream_dependent_callers"][0]["line_no"] == 5


def test_budget(spark, repo):
    engine = ContextEngine(spark, git.snapshot(spark, repo), Options(max_mb=0.00005))
    out = engine.run(spark.createDataFrame([("--- a\n+++ b/a.py\n@@ -2 +2 @@\n",)], "text string").select(F.concat(F.lit("diff --git a b\n"), "text").alias("text")), "d" * 200)
    assert "truncated" in out and "## 2." not in out


def test_options():
    got = Options.from_sources('// note\n{"max_lines": 10, "unknown": 1, "caller_depth": 2}', caller_depth=3, max_mb=None)
    assert (got.max_lines, got.caller_depth, got.max_mb) == (10, 3, 2.0)
    with pytest.raises(TypeError):
        Options.from_sources('{"max_lines": true}')
    assert artifacts.parse_config('﻿{\n  # x\n "a": 1\n}') == {"a": 1}
    text = artifacts.commented_config({"a": 2}, {"a": 1, "b": [1]})
    assert artifacts.parse_config(text) == {"a": 2}


def test_coverage_and_commands(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="s\\a.py"><lines><line number="5" hits="1"/><line number="6" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert [tuple(r) for r in artifacts.read_coverage(spark, str(tmp_path / "c.xml")).collect()] == [("s/a.py", 5)]
    (tmp_path / "cc.json").write_text(json.dumps([{"directory": "/old/root", "file": "/old/root/a.c", "arguments": ["cc", "-I/old/root/inc", "-I/old/rooted"]}]))
    moved = artifacts.rewrite_commands(artifacts.read_commands(spark, str(tmp_path / "cc.json")), "/old/root", "/new").first()
    assert (moved.directory, moved.file, moved.arguments[1:]) == ("/new", "/new/a.c", ["-I/new/inc", "-I/old/rooted"])


def test_markers(spark):
    rows = [("x.i", i, t) for i, t in enumerate(['# 7 "a.c"', "call()", "more", '# 3 "b.h"', "z"])]
    got = artifacts.markers(spark.createDataFrame(rows, "path string, idx long, text string")).orderBy("idx").collect()
    assert [(r.of_path, r.of_line) for r in got] == [("a.c", 7), ("a.c", 7), ("b.h", 3)]


def test_paths(spark):
    df = spark.createDataFrame([("src/build/a.c",), ("src/build.c",), ("a\\node_modules\\b.js",)], "p string")
    assert [r[0] for r in df.select(in_repository(F.col("p"))).collect()] == [False, True, False]
    one = spark.createDataFrame([("C:\\Repo\\x",)], "p string")
    assert one.select(within_root(F.col("p"), "c:/repo", False), within_root(F.col("p"), "c:/rep", False)).first() == (True, False)
    assert one.select(rewrite_root(F.col("p"), "C:/Repo", "D:/n$w")).first()[0] == "D:\\n$w\\x"
    assert not case_sensitive("C:\\x") and case_sensitive("/x") and not case_sensitive("/x", [{"root": "/x", "case_sensitive": False}])
    listing = spark.createDataFrame([("cc.json", 1), ("build/cc.json", 5), ("else/cc.json", 9)], "path string, mtime int")
    assert newest_artifact(listing, "cc.json").first().path == "build/cc.json"


def test_compare(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ((1, 1, 2), (1, 3)))
    assert sorted((r.x, r.only) for r in compare(a, b).collect()) == [(1, "first"), (2, "first"), (3, "second")]


def test_references_replace_callers(spark):
    fs = with_order(spark.createDataFrame([("a.py", 0, "def helper():\n    return 1\n")], "path string, file_ord int, content string"))
    refs = spark.createDataFrame([("helper", "a.py", f"d/{i}.py", i + 1, i, "helper()") for i in range(20)], "func string, target string, path string, line_no long, seq long, code string")
    ctx = ContextEngine(spark, fs).context(spark.createDataFrame([("a.py", 2)], "path string, line_no long"), references=refs)
    assert ctx["callers"].count() == 16


def test_inheritance_has_no_depth_limit(spark):
    parents = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(35)] + [("c35", "c30")], "name string, parent string")
    got = {(r.ancestor, r.depth) for r in inherited(spark.createDataFrame([("c0",)], "name string"), parents).collect()}
    assert got == {(f"c{i}", i) for i in range(36)}

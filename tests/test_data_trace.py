"""The data trace makes each table once, and asks the line rules only of lines that hold the name."""

from loomgraph.operators import resolve
from loomgraph.plans import contract

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_scanned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(resolve, "trace_data", lambda seeds, lines, scopes, *a: seen.extend([lines, scopes]))
    contract.QUERIES["data_trace"](spark, SF)
    assert len(seen) == 2
    assert all("EvalPython" not in plan(df) for df in seen)


def test_line_rules_follow_the_join(spark):
    lines = spark.createDataFrame([("a.py", 0, "python", i, t, t) for i, t in enumerate(("x = 1", "y = 2", "return x"), 1)], "path string, file_ord int, lang string, line_no long, clean string, raw string")
    found = resolve.variable_definitions(spark.createDataFrame([("x",)], "name string"), lines)
    text = plan(found)
    assert text.index("ArrowEvalPython") < text.index("Join")
    assert [tuple(r) for r in found.collect()] == [("x", "a.py", 0, 1, "x = 1")]

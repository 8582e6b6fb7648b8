"""Sides of joins and shared scans: what must not reach the driver, and what must not be made twice."""

import pytest

from loomgraph import runtime
from loomgraph.operators import index
from loomgraph.plans import contract

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def wide(spark):
    """A session whose broadcast threshold takes any table here, as Spark's default takes a large one that compresses well."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_sides_are_not_broadcast(wide, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0, raising=False)
    df = contract.QUERIES["test_mining"](wide, SF)
    assert "BroadcastExchange" not in plan(df)
    assert df.count() == wide.read.parquet(f"{SF}/part.parquet").count()


def test_bounds_joins_by_counted_size(wide, monkeypatch):
    lines = wide.createDataFrame([("a.py", "python", i, t, t) for i, t in enumerate(("def f():", "    x", "def g():", "    y"), 1)], "path string, lang string, line_no long, stripped string, clean string")
    asked = wide.createDataFrame([("a.py", 2), ("a.py", 4), ("b.py", 1)], "path string, line_no long")
    want = [("a.py", 2, 0, 2), ("a.py", 4, 2, 4)]
    few = index.bounds(asked, index.shapes(lines)).select("path", "line_no", "start0", "end0")
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0, raising=False)
    many = index.bounds(asked, index.shapes(lines)).select("path", "line_no", "start0", "end0")
    assert "BroadcastExchange" in plan(few) and "BroadcastExchange" not in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want


def test_spans_of_many_files_and_of_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(index, "SPAN_LINES", 3)
    rows = [(f"f{k}.py", "python", i, t, t) for k in range(5) for i, t in enumerate(("def f():", "    x", "def g():", "    y")[: k or None], 1)]
    lines = spark.createDataFrame(rows, "path string, lang string, line_no long, stripped string, clean string")
    got = sorted(map(tuple, index.line_spans(index.shapes(lines)).collect()))
    sizes = [4, 1, 2, 3, 4]
    assert got == sorted((f"f{k}.py", i, (i - 1) // 2 * 2, min((i - 1) // 2 * 2 + 2, n), n) for k, n in enumerate(sizes) for i in range(1, n + 1))

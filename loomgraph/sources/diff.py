"""Unified diffs as changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(path, line_no) of the new side of every hunk of diffs(path, diff), taken without context. A missing count is 1; a count of 0, a deletion, has no line; malformed headers are skipped."""
    heads = diffs.select("path", F.explode(F.split("diff", "\n")).alias("line")).where(F.col("line").startswith("@@") & F.col("line").rlike(HUNK))
    start = F.regexp_extract("line", HUNK, 1).cast("long")
    count = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("line", HUNK, 2), F.lit("")), F.lit("999999999")).cast("long"), F.lit(1).cast("long"))
    hunks = heads.select("path", start.alias("s"), count.alias("n")).where("n > 0")
    return hunks.select("path", F.explode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("line_no")).distinct()


def split_diff(diff: DataFrame) -> DataFrame:
    """diffs(path, diff) of a whole diff(text): one row a file that exists on the new side."""
    parts = diff.select(F.explode(F.split("text", r"(?m)^(?=diff --git )")).alias("diff"))
    path = F.regexp_extract("diff", r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", 1)
    return parts.select(path.alias("path"), "diff").where((F.col("path") != "") & (F.col("path") != "/dev/null"))

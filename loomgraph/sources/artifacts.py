"""Coverage reports, compilation databases, preprocessed sources and configuration files."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import normal_path, rewrite_root

COMMANDS = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "arguments" else T.StringType()) for n in ("directory", "file", "command", "arguments", "output")])
COVERAGE = "_filename string, lines struct<line: array<struct<_number: bigint, _hits: bigint>>>"
MARKER = r'^#(?:line)?\s+(\d+)\s+"([^"]*)"'


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no) of covered lines of a Cobertura report; a malformed one has none."""
    classes = spark.read.format("xml").schema(COVERAGE).option("rowTag", "class").option("mode", "DROPMALFORMED").load(path)
    lines = classes.select(normal_path(F.col("_filename")).alias("path"), F.explode("lines.line").alias("l"))
    return lines.where("l._hits > 0").select("path", F.col("l._number").alias("line_no")).distinct()


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """The units of a compilation database; their arguments as one command where there is no command."""
    units = spark.read.schema(COMMANDS).option("multiLine", "true").json(path)
    return units.withColumn("command", F.coalesce("command", F.array_join("arguments", " ")))


def rewrite_commands(units: DataFrame, old: str, new: str, ignore_case: bool = False) -> DataFrame:
    """Every path of a compilation database moved from the root `old` to `new`."""
    out = units
    for name in ("directory", "file", "command", "output"):
        if name in units.columns:
            out = out.withColumn(name, rewrite_root(F.col(name), old, new, ignore_case))
    if "arguments" in units.columns:
        out = out.withColumn("arguments", F.transform("arguments", lambda x: rewrite_root(x, old, new, ignore_case)))
    return out


def write_commands(units: DataFrame, path: str) -> None:
    """A database as one JSON array, the form that compilers' tools read, in a file of the driver. Units come partition by partition, so the driver never holds them all."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(units.select(F.to_json(F.struct(*units.columns))).toLocalIterator()):
            f.write((",\n" if i else "\n") + row[0])
        f.write("\n]\n")


def rewrite_database(spark: SparkSession, source: str, target: str, old: str, new: str, ignore_case: bool = False) -> bool:
    """A database file moved from the root `old` to `new` as a file of its own; one that is no array of units is copied as it is. Whether it was rewritten."""
    text = open(source, "rb").read()  # noqa: SIM115
    try:
        units = json.loads(text.decode("utf-8-sig"))
        valid = isinstance(units, list) and all(isinstance(u, dict) for u in units)
    except ValueError:
        valid = False
    if not valid:
        with open(target, "wb") as f:
            f.write(text)
        return False
    write_commands(rewrite_commands(read_commands(spark, source).select(*COMMANDS.names), old, new, ignore_case), target)
    return True


def markers(expanded: DataFrame) -> DataFrame:
    """(path, idx, text, of_path, of_line) of expanded(path, idx, text): every line with the nearest line marker above it. The line reported is the marker's own number."""
    from pyspark.sql import Window

    above = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("text").rlike(MARKER), F.struct(F.regexp_extract("text", MARKER, 2).alias("p"), F.regexp_extract("text", MARKER, 1).alias("n")))
    out = expanded.withColumn("m", F.last(mark, ignorenulls=True).over(above)).where(~F.col("text").rlike(MARKER))
    return out.select("path", "idx", "text", F.col("m.p").alias("of_path"), F.col("m.n").cast("long").alias("of_line"))


def parse_config(text: str) -> dict:
    """A JSON object with comment lines (`//` or `#`) and perhaps a byte-order mark."""
    return json.loads("\n".join(x for x in text.lstrip("﻿").split("\n") if not re.match(r"\s*(?://|#)", x)) or "{}")


def commented_config(active: dict, defaults: dict) -> str:
    """All options as JSON; those at their default are comment lines."""
    body = [("" if active.get(k, v) != v else "// ") + f'"{k}": {json.dumps(active.get(k, v))}' for k, v in defaults.items()]
    live = [i for i, x in enumerate(body) if not x.startswith("//")]
    return "{\n" + "\n".join("  " + x + ("," if i in live[:-1] else "") for i, x in enumerate(body)) + "\n}\n"

"""A stream of diffs as changed lines, and their context batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import ContextEngine, Options
from ..sources import diff

SCHEMA = "commit string, at timestamp, text string"


def read_diffs(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """diffs(commit, at, text) from a folder of JSON lines that grows."""
    return spark.readStream.schema(schema).json(folder)


def changed_per_window(diffs: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, path, lines) of how many lines of each file changed in windows of event time; what comes later than `late` is left out."""
    heads = diffs.withWatermark("at", late).select("at", F.explode(F.split("text", r"(?m)^(?=diff --git )")).alias("diff"))
    path = F.regexp_extract("diff", r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", 1)
    hunks = heads.select("at", path.alias("path"), F.explode(F.split("diff", "\n")).alias("line")).where(F.col("line").rlike(diff.HUNK) & (F.col("path") != ""))
    count = F.coalesce(F.nullif(F.regexp_extract("line", diff.HUNK, 2), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return hunks.groupBy(F.window("at", width).alias("w"), "path").agg(F.sum(count).alias("lines")).select(F.col("w.start").alias("start"), "path", "lines")


def contexts(diffs: DataFrame, files: DataFrame, options: Options, sink: Callable[[int, str], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands `sink` the payload of each batch of diffs against a snapshot's files; the checkpoint folder makes each batch count once."""
    engine = ContextEngine(diffs.sparkSession, files, options)

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            sink(number, engine.run(df.select("text")))

    return diffs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

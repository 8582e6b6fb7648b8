"""Putting the package on the executors, and tables into the folder that they share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()
#: A side of a join of at most so many bytes, as counted, is broadcast.
BROADCAST_BYTES = 24 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once per application, so that Python functions load there whatever their PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parent
        name = os.path.join(tempfile.mkdtemp(prefix="loomgraph-src-"), "loomgraph_src.zip")
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        sc.addPyFile(name)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hint(df: DataFrame) -> str:
    """How to join with df, a written table: "broadcast" if its rows take at most BROADCAST_BYTES, as counted, else "merge". Spark's own estimate carries a compressed file's size through strings that are made and rows that are exploded, so it would collect millions of rows on the driver."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in text), F.lit(24 * len(df.columns)).cast("long"))
    return "broadcast" if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else "merge"

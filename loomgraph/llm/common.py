"""What the training-data operators share: column picking, folds, tables written to the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Java and DuckDB pattern of the separators between words.
SPACE = r"[\x20\x09-\x0D]"
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A side of at most so many bytes, as counted, may be broadcast.
BROADCAST_BYTES = 24 << 20
#: Bytes of text that a worker takes from a batch at a time.
SLICE_BYTES = 2 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others. Exact spelling wins, so extra columns with clashing names do no harm."""
    cols = df.columns
    flat = df.toDF(*[f"c{i}__" for i in range(len(cols))])
    out = []
    for name in names:
        at = cols.index(name) if name in cols else [c.lower() for c in cols].index(name.lower())
        out.append(F.col(f"c{at}__").alias(name))
    return flat.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def text_key(text: Column) -> Column:
    """64-bit hash of a text's bytes; with the doc_id it tells rows of one doc_id apart."""
    return F.xxhash64(text.cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a temporary one on a local master; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, and there for every executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(field: T.StructField) -> Column:
    """Bytes that a value of a column takes, about."""
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.octet_length(field.name).cast("long") + 24
    if isinstance(field.dataType, T.ArrayType | T.MapType):
        return F.length(F.to_json(field.name)).cast("long") + 24
    return F.lit(16).cast("long")


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most `limit` bytes, as counted; else as it is, for a shuffled join. df is a written table: rows of fixed width are counted from its footers, others by a scan."""
    wide = [f for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType | T.ArrayType | T.MapType)]
    fixed = 16 * (len(df.columns) - len(wide)) + 16
    if not wide:
        return F.broadcast(df) if df.count() * fixed <= limit else df
    size = sum((F.coalesce(_bytes(f), F.lit(24).cast("long")) for f in wide), F.lit(fixed).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in slices of at most `limit` bytes of a text or binary column, but of one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64) + 64
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return a worker's free memory to the system: workers are used again for other tasks, beside which it would count."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def labelled(labels: DataFrame, name: str, sample: int, fold: int, held: int) -> tuple[DataFrame, dict[bool, int]]:
    """At most `sample` ids of each class of labels(doc_id, name) outside the held fold, by a hash of doc_id, as (doc_id, y, check): check marks the third that calibrates. And the number of ids of each class. A doc_id with both labels counts as 1."""
    known = pick(labels, "doc_id", name).where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(name) != 0).alias("y"))
    known = known.where(remainder(F.col("doc_id"), fold) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = known.where("y").orderBy(*order).limit(sample).unionByName(known.where("not y").orderBy(*order).limit(sample))
    return written(some.withColumn("check", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0), "sample"), dict(known.groupBy("y").count().collect())


def sampled(docs: DataFrame, some: DataFrame, cut, kind: T.DataType, *names: str) -> list:
    """Rows (doc_id, *names, x) of the documents of the small table some(doc_id, *names), in order; x = cut(text bytes, key) is made on the executors and must be of bounded size. Of rows that share a doc_id one is taken (the least text key), before anything is collected."""
    text = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = text.join(F.broadcast(some), "doc_id").select("doc_id", *names, "th", "text")
    schema = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("x", kind)])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1):
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                x = [cut(t, k) for t, k in zip(part.column(part.num_columns - 1).to_pylist(), cols[-1].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(x, to_arrow_type(kind))], names=schema.names)
        give_back()

    cut_rows = rows.mapInArrow(run, schema)
    one = cut_rows.groupBy("doc_id", *names).agg(F.min_by("x", F.coalesce("th", F.lit(0).cast("long"))).alias("x"))
    return sorted(one.collect(), key=lambda r: r.doc_id)


def batch_rows(batch, *names):
    """Python lists of an Arrow batch's columns."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton steps. With one class only, the bias says which."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w
    ridge = np.full(x.shape[1], l2 * len(y) / 100 + 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w

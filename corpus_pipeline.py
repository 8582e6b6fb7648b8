"""The corpus pipeline: five stages over `documents`, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import toxicity
from loomgraph.llm.common import small_side, table, text_key, written
from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.minmax import near_dedup
from loomgraph.llm.mixing import mix
from loomgraph.llm.packing import pack
from loomgraph.runtime import ship

#: A document is toxic from this probability on.
TOXIC_AT = 0.5
#: The mixture is the flattest that takes no source more often than this; every source is taken whole once.
MAX_REPEATS = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression-distance classifier doesn't reject, each judged by its own text; its model learns from the labelled rows of its input. Null and empty texts stay; an empty table gives an empty one; without labels of both classes nothing goes unless all are toxic."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=5, held=0)
    return toxicity.drop(docs, model, TOXIC_AT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, later repeated passages removed from its text; n_chars follows the text. Null texts and rows without a doc_id stay as they are; rows that repeat doc_id and text are edited alike."""
    out = line_dedup(docs).drop("n_lines", "n_removed")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (shingles of five words, similarity 0.8): the smallest doc_id, of rows that share it the one with the least text key, of repeated rows one. Rows without words or without a doc_id stay."""
    ship(spark)
    rows = written(near_dedup(docs, width=5, percent=80).where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "th").agg(F.max("first").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "copies")
    key = (docs["doc_id"].cast("long") == F.col("of_id")) & (text_key(docs["text"]) == F.col("of_th"))
    side = rows.select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), "stays")
    rest = docs.join(small_side(side.drop("stays")), key, "left_anti")
    # a row that stays but is repeated: one of the copies, which are alike in id and text
    again = docs.join(small_side(written(side.where("stays").drop("stays"), "repeated")), key, "left_semi")
    return rest.unionByName(again.dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least; those of small sources again, up to the mixture's weights. A null source is one of its own; texts without tokens come once; an empty table gives an empty one."""
    return mix(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; a null text is its end token; an empty table gives no piece."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Dictionaries, min-max hashing and tokenisers are beyond SQL: the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written before the next begins."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

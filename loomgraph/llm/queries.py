"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import langid, quality_cnn
from . import quality_rules as rules
from . import toxicity
from .common import remainder, table
from .grace_dedup import exact_dedup
from .lattice_lm import lattice_lm
from .line_dedup import line_dedup
from .minmax import near_dedup
from .mixing import mix
from .packing import pack


def op10_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(ship(spark), sf_dir, "documents"))


OP10_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def _scored(scored: DataFrame, fold: int, held: int, at: float) -> DataFrame:
    return scored.select("doc_id", (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op1_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=5, held=0)
    return _scored(toxicity.score(docs, model), 5, 0, 0.5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(ship(spark), sf_dir, "documents"))


def op3_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs, fold=4, held=2))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm(table(ship(spark), sf_dir, "documents"), fold=10, held=0)


def op5_winnow_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text_sha256 of what is left."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and epoch that the mixture takes: doc_id, source, n_tokens, epoch, block, turn. The flattest mixture that takes no source more than twice, every one whole once."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), max_repeats=2.0).drop("text")


def op7_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), fold=4, held=2)
    return _scored(quality_cnn.score(docs, model), 4, 2, 0.7)


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(ship(spark), sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("text")


QUERIES = {
    "op1_zstd_toxicity": op1_zstd_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_cnn_langid": op3_byte_cnn_langid,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_winnow_line_dedup": op5_winnow_line_dedup,
    "op6_temperature_mixing": op6_temperature_mixing,
    "op7_byte_cnn_quality": op7_byte_cnn_quality,
    "op8_minmax_near_dedup": op8_minmax_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_grace_dedup": op10_grace_dedup,
}

ORACLE = {
    "op9_quality_rules": rules.ORACLE,
    "op10_grace_dedup": OP10_SQL,
}

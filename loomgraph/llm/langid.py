"""Language identification by a byte convolutional network.

The network reads fixed-length windows of the lower-cased text's UTF-8 bytes; a document's windows cover its whole
text, are run in batches, and their class probabilities are averaged. It is trained on the driver in numpy from at
most SAMPLE documents a language (by a hash of doc_id) with WINDOWS random windows each.

Defined results: lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing was learnt; a
null doc_id stays null; repeated rows are predicted each; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_cnn import ByteCNN, cut_windows, some_windows
from .common import give_back, pick, remainder, sampled, text_slices, written

LENGTH = 160
STEP = 160
#: Documents of a language, windows of a document, and languages in the fit at most.
SAMPLE, WINDOWS, LANGUAGES = 500, 4, 200


class Model:
    def __init__(self, langs: list[str], net: ByteCNN | None):
        self.langs, self.net = langs, net

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, sure = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, sure
        own = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        cuts = [cut_windows(texts[i].lower().encode("utf-8", "replace"), LENGTH, STEP) for i in own]
        if not own:
            return lang, sure
        prob = self.probabilities(np.concatenate(cuts))
        ends = np.cumsum([len(c) for c in cuts])
        mean = np.add.reduceat(prob, np.append(0, ends[:-1]), axis=0) / np.diff(ends, prepend=0)[:, None]
        for i, k, p in zip(own, mean.argmax(1).tolist(), mean.max(1).tolist(), strict=True):
            lang[i], sure[i] = self.langs[k], min(1.0, p)
        return lang, sure

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.ones((len(windows), 1))
        out = self.net.logits(windows).astype(np.float64)
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def _train_windows(text: bytes, key: int | None) -> bytes:
    data = text.decode("utf-8", "replace").lower().encode("utf-8")
    return some_windows(data, LENGTH, LENGTH, WINDOWS, key or 0).tobytes()


def train(rows: list[tuple[bytes, str]]) -> Model:
    """A model from rows of windows (LENGTH bytes each, one after the other) and their language."""
    langs = sorted({lang for _, lang in rows})
    if len(langs) < 2:
        return Model(langs, None)
    windows = [np.frombuffer(w, np.uint8).reshape(-1, LENGTH) for w, _ in rows]
    target = np.repeat([langs.index(lang) for _, lang in rows], [len(w) for w in windows])
    share = np.bincount(target, minlength=len(langs))
    weight = (len(target) / len(langs) / share)[target]
    net = ByteCNN(len(langs)).fit(np.concatenate(windows), target, weight, epochs=3 if len(target) > 2000 else 12)
    return Model(langs, net)


def fit(docs: DataFrame, sample: int = SAMPLE, fold: int = 4, held: int = 2) -> Model:
    """Learn from the rows of docs(doc_id, text, lang) with a language whose crc32 remainder by `fold` is not `held`."""
    own = pick(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("long")).where(remainder(F.col("doc_id"), fold) != held)
    sizes = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Model([], None)
    # a hash below a language's limit leaves some three times the sample, whatever the language's size, to be ranked
    limit = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 3 * (sample + 20) / r["count"])))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = own.select("doc_id", "lang").where(place < F.coalesce(F.try_element_at(limit, F.col("lang")), F.lit(0.0))).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = written(few.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang"), "sample")
    rows = sampled(own, chosen, _train_windows, T.BinaryType(), "lang")
    return train([(bytes(r.x), r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang))])


def _scan(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                lang, sure = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], schema=schema)
        give_back()

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs(doc_id, text)."""
    spread = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread.mapInArrow(_scan(model), "doc_id long, lang_pred string, score double")

"""Quality by a byte-level convolutional network over whole documents.

Chunks of LENGTH bytes that overlap by LENGTH - STEP cover the whole text. Each goes through learned filters of
several widths and max pooling to a log odds; the chunks' mean, least and greatest log odds, the share of them above
zero and their number are combined by a logistic regression into the document's probability. The network is trained
on the driver in numpy from CHUNKS random chunks each, which the executors cut, of two thirds of at most SAMPLE
labelled rows of a class (by a hash of doc_id); the other third, which the network hasn't seen, calibrates the
combination, by five numbers a document that the executors make of its whole text. The driver gets these only (5 MB).

Defined results: null and empty texts hold nothing of quality and score 0; a null doc_id stays null; repeated rows
are scored each; without labels of both classes the score is 0.5 or near the one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_cnn import ByteCNN, cut_windows, some_windows
from .common import give_back, labelled, logistic_fit, pick, sampled, text_slices

LENGTH, STEP = 256, 224
SAMPLE = 1500
#: Random chunks of a document that the network is trained on at most.
CHUNKS = 6
FEATURES = 5


class Model:
    def __init__(self, net: ByteCNN | None, weights: np.ndarray | None):
        self.net, self.weights = net, weights

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        cuts = [cut_windows(t or b"", LENGTH, STEP) for t in texts]
        ends = np.cumsum([len(c) for c in cuts])
        starts, n = np.append(0, ends[:-1]), np.diff(ends, prepend=0)[:, None]
        pooled = self.net.pooled(np.concatenate(cuts)).astype(np.float64)
        out = pooled @ self.net.p["v"] + self.net.p["b"]
        odds = np.clip(out[:, 1:2] - out[:, 0:1], -12, 12)
        share = np.add.reduceat((odds > 0) * 1.0, starts) / n
        mean = np.add.reduceat(odds, starts) / n
        return np.hstack([mean / 4, np.minimum.reduceat(odds, starts) / 4, np.maximum.reduceat(odds, starts) / 4, share, np.minimum(n, 50) / 25])

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.net is None:
            return np.full(len(texts), 0.5 if self.weights is None else self.weights[0])
        x = self.features(texts)
        return np.where([bool(t) for t in texts], 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))), 0.0)


def _train_chunks(text: bytes, key: int | None) -> bytes:
    return some_windows(text, LENGTH, STEP, CHUNKS, key or 0).tobytes()


def train(rows: list[tuple[bytes, bool]]) -> ByteCNN:
    """A network from rows of chunks (LENGTH bytes each, one after the other) and their label, of both classes."""
    windows = [np.frombuffer(w, np.uint8).reshape(-1, LENGTH) for w, _ in rows]
    target = np.repeat([int(y) for _, y in rows], [len(w) for w in windows])
    weight = (len(target) / 2 / np.bincount(target, minlength=2))[target]
    return ByteCNN(2, widths=(3, 5, 8)).fit(np.concatenate(windows), target, weight, epochs=4 if len(target) > 3000 else 15)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 4, held: int = 2) -> Model:
    """Learn from the rows of labels(doc_id, quality) whose crc32 remainder by `fold` is not `held`."""
    some, counts = labelled(labels, "quality", sample, fold, held)
    rows = [(bytes(r.x), r.y) for r in sampled(docs, some.where("not check"), _train_chunks, T.BinaryType(), "y")]
    seen = {y for _, y in rows}
    if len(seen) < 2:
        return Model(None, np.array([0.98 if True in seen else 0.02]) if seen else None)
    model = Model(train(rows), None)
    check = sampled(docs, some.where("check"), lambda t, k: model.features([t])[0].tolist(), T.ArrayType(T.DoubleType()), "y")
    model.weights = logistic_fit(np.array([r.x for r in check]).reshape(-1, FEATURES), np.array([float(r.y) for r in check]))
    ones = sum(r.y for r in check)
    if 0 < ones < len(check):  # the classes are sampled alike; set the odds back to those of the labels
        model.weights[-1] += np.log(counts[True] / counts[False]) - np.log(ones / (len(check) - ones))
    return model


def _scan(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], schema=schema)
        give_back()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs(doc_id, text)."""
    spread = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return spread.mapInArrow(_scan(model), "doc_id long, score double")

"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text. Both begin with segments that zstandard's own trainer picks
from ordinary text; then one holds the words that mark toxic documents, the other those that mark ordinary ones (by
the log ratio of document frequencies), and both end with the same carrier bytes. A window is one word between
spaces, followed by the carrier, so that even a short word is measured in compressed form. A window's two compressed
lengths give its saving under the toxic dictionary and how wholly that dictionary covers it; a document's windows
are counted against a grid of thresholds of both, and a logistic regression, fitted on labelled documents that the
dictionaries have not seen, calibrates the counts to a probability. Only the text is used for a score. (Dictionaries
that the trainer makes of whole toxic texts, with windows of several words, were tried and miss too much: README.)

The fit takes at most SAMPLE labelled rows of a class, the same ones at any size of cluster (by a hash of doc_id). The
dictionaries are made from an excerpt of each, up to EXCERPTS stretches of EXCERPT bytes spread over its text, and
the calibration from 41 numbers that the executors make of its whole text: the driver gets these only (30 MB).
Scoring covers every window of every text, in one pass without a shuffle.

Defined results: null, empty and blank texts have no windows and get the calibrated score of no evidence; a null
doc_id stays null; repeated rows are scored each; without labels of both classes the score is 0.5 or the one class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, give_back, labelled, logistic_fit, pick, sampled, text_slices

#: Labelled rows of each class that the fit uses at most.
SAMPLE = 2000
LEVEL = 9
SHARED_BYTES, MARK_BYTES = 16_000, 12_000
#: Both dictionaries' last bytes; no text has them, being invalid UTF-8 in this order.
CARRIER = bytes((37 * i * i + 101 * i) % 128 | 128 for i in range(48))
GAINS, COVERS = 8, 8
FEATURES = 41
#: Stretches of a document that the dictionaries are made from at most, and their bytes.
EXCERPTS, EXCERPT = 8, 1024
#: Words whose cell a task keeps: some 10 MB.
WORD_CACHE = 60_000
LONG = 48

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_EDGE = b".,;:!?\"'()[]"


def windows(text: bytes | None) -> list[bytes]:
    """Words of a text in lower case, without punctuation at their ends; an overlong word in pieces."""
    out = []
    for w in _WORDS.findall((text or b"").translate(LOWER)):
        w = w.strip(_EDGE) or w
        if len(w) <= LONG:
            out.append(w)
        else:
            out += [w[i : i + LONG] for i in range(0, len(w), LONG)]
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class _Codes(dict):
    """A word's cell in the grid of saving and cover."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.none = len(self.toxic.compress(CARRIER))

    def __missing__(self, word: bytes) -> int:
        window = b" " + word + b" " + CARRIER
        t, o = len(self.toxic.compress(window)), len(self.ordinary.compress(window))
        code = min(max(o - t, 0), GAINS - 1) * COVERS + min(max(t - self.none, 0), COVERS - 1)
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = code
        return code


class Model:
    """Two dictionaries and the weights of the threshold counts."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray | None):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights
        self._codes: _Codes | None = None

    def forget(self) -> None:
        """Drop what a task kept."""
        self._codes = None
        give_back()

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: bytes | None) -> np.ndarray:
        if self._codes is None:
            self._codes = _Codes(self.toxic, self.ordinary)
        words = windows(text)
        grid = np.bincount(list(map(self._codes.__getitem__, words)), minlength=GAINS * COVERS).reshape(GAINS, COVERS)
        # windows that save at least g bytes and are covered up to c bytes
        over = grid[::-1].cumsum(0)[::-1].cumsum(1)[2:6, 1:6].ravel()
        return np.concatenate([np.log1p(over), over / max(1, len(words)) * 100, [np.log1p(len(words)) / 5]])

    def score(self, texts: Iterable[bytes | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES)
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _marks(of: Counter, n: int, against: Counter, m: int, least: int, ratio: float) -> list[bytes]:
    """Words in `least` documents at least whose log frequency ratio is over `ratio`, most frequent last."""
    found = [w for w, c in of.items() if c >= least and len(w) >= 3 and np.log((c + 0.5) / (n + 1)) - np.log((against[w] + 0.5) / (m + 1)) > ratio]
    return sorted(found, key=lambda w: (of[w], w))


def excerpt(text: bytes, key: int | None = None) -> bytes:
    """A text of up to EXCERPTS * EXCERPT bytes as it is, of a longer one as many stretches at even distances, at spaces."""
    if len(text) <= EXCERPTS * EXCERPT:
        return text
    parts = []
    for i in range(EXCERPTS):
        at = i * (len(text) - EXCERPT) // (EXCERPTS - 1)
        parts.append(b" ".join(text[at : at + EXCERPT].split(b" ")[(i > 0) : (None if i == EXCERPTS - 1 else -1)]))
    return b"\n".join(parts)


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """A model without weights from excerpts of both classes."""
    in_t, in_o = Counter(), Counter()
    for t in toxic:
        in_t.update(set(windows(t)))
    for t in ordinary:
        in_o.update(set(windows(t)))
    least = int(min(8, max(2, len(toxic) / 125)))
    mark_t = b"".join(b" " + w + b" " for w in _marks(in_t, len(toxic), in_o, len(ordinary), least, 2.5))[-MARK_BYTES:]
    mark_o = b"".join(b" " + w + b" " for w in _marks(in_o, len(ordinary), in_t, len(toxic), least, 0.2))[-max(1, len(mark_t)) :]
    samples = [t.translate(LOWER) for t in ordinary if t]
    shared = b""
    if sum(map(len, samples)) > 10 * SHARED_BYTES and len(samples) > 20:
        shared = zstandard.train_dictionary(SHARED_BYTES, samples).as_bytes()[-SHARED_BYTES:]
    return Model(shared + mark_t + CARRIER, shared + mark_o + CARRIER, None)


def calibrated(model: Model, features: list, toxic: list[bool]) -> Model:
    """The model with weights for the threshold counts."""
    model.weights = logistic_fit(np.array(features).reshape(-1, FEATURES), np.array(toxic, float), l2=0.05)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5, held: int = 0) -> Model:
    """Learn from the rows of labels(doc_id, toxic) whose crc32 remainder by `fold` is not `held`: two thirds make the dictionaries, the rest calibrates."""
    some, counts = labelled(labels, "toxic", sample, fold, held)
    rows = [(r.y, bytes(r.x)) for r in sampled(docs, some.where("not check"), excerpt, T.BinaryType(), "y")]
    model = dictionaries([t for y, t in rows if y], [t for y, t in rows if not y])
    check = sampled(docs, some.where("check"), lambda t, k: model.features(t).tolist(), T.ArrayType(T.DoubleType()), "y")
    calibrated(model, [r.x for r in check], [r.y for r in check])
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
        model.forget()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs(doc_id, text)."""
    spread = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return spread.mapInArrow(_scan(model), "doc_id long, score double")


def drop(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below `at`: each row by its own text, in one pass."""
    names = docs.columns
    place = names.index("text") if "text" in names else [c.lower() for c in names].index("text")
    flat = docs.toDF(*[f"c{i}__" for i in range(len(names))])
    flat = flat.select("*", F.col(f"c{place}__").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1):
                keep = pa.array(model.score(part.column(part.num_columns - 1).to_pylist()) < at)
                yield part.filter(keep).drop_columns(["text"])
        model.forget()

    kept = flat.drop("text").schema
    return flat.mapInArrow(run, kept).toDF(*names)

"""Language-model scores by the subword lattice: the probability of a text over all its segmentations.

The vocabulary is an existing byte-level one; nothing is added to it. Its unigram scores are the pieces' shares among
the training documents' tokens (the vocabulary file has merge ranks, no unigram scores), smoothed and then refined by
expectation over all segmentations. Every piece that spells a part of a word is an arc of the word's lattice; the
forward recursion in log space adds up all paths, so a word's probability is marginal, not that of one segmentation.
Pieces join a space to the word it precedes and never span two words, so a text's probability is the product of its
words' and of the end token's.

Distribution: a scan task turns blocks of documents into word numbers with the block's own vocabulary, so only each
block's distinct words are shuffled: once to be counted, once to bring back each word's count and lattice score.
A word of every document is one row a block. The model itself is one number a piece, which bounds what the driver
sees; counts, words and their scores stay distributed and grow with the input.

Defined results: null, empty and blank texts are the end token alone; a null doc_id is neither held out nor learnt
from; repeated rows are scored each; without training documents c = N = V = 0 and the base is log10(0.1 / 0.1) = 0.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch_rows, give_back, pick, remainder, text_slices, written

#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: Rounds in which expected counts over all segmentations replace those of the tokeniser's own.
EM_ROUNDS = 2
#: Longer words, with the space before them, take the sequential recursions, in learning and in scoring.
SHORT = 64
SMOOTH = 0.5

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_BITS = 20


class Vocabulary:
    """Pieces by their bytes: a hash table in arrays, for many look-ups at once."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("lattice", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max(ranks.values()) + 1
        # a piece is of use if a space can only be its first byte and it has no other blank or capital
        ok = {p: i for p, i in ranks.items() if len(p) == 1 or not re.search(rb"[\x20\x09-\x0D]", p[1:]) and p[:1] not in b"\t\n\x0b\x0c\r" and not re.search(rb"[A-Z]", p)}
        self.longest = max(map(len, ok))
        self.byte = (np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)) ^ _U(0x2545F4914F6CDD1D)
        self.tables: list[tuple[np.ndarray, np.ndarray, int]] = []
        left = [(self._hash(p), i) for p, i in ok.items()]
        shift = 64 - _BITS
        while left:
            keys, ids, over = np.zeros(1 << _BITS, _U), np.full(1 << _BITS, -1, np.int32), []
            for h, i in left:
                slot = self._mixed(h) >> shift & (1 << _BITS) - 1
                if ids[slot] < 0:
                    keys[slot], ids[slot] = h, i
                else:
                    over.append((h, i))
            self.tables.append((keys, ids, shift))
            left, shift = over, shift - 9

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_P) + int(self.byte[b])) & (1 << 64) - 1
        return h

    @staticmethod
    def _mixed(h: int) -> int:
        return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        mixed = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        out = np.full(h.shape, -1, np.int32)
        for keys, ids, shift in self.tables:
            slot = (mixed >> _U(shift) & _U((1 << _BITS) - 1)).astype(np.int64)
            np.copyto(out, ids[slot], where=(keys[slot] == h) & (ids[slot] >= 0))
        return out

    def arcs(self, words: np.ndarray):
        """For each length, from 1: the piece numbers at every place of the rows of words (n, length)."""
        n, length = words.shape
        codes = self.byte[words]
        h = codes
        for w in range(1, min(length, self.longest) + 1):
            if w > 1:
                h = h[:, :-1] * _P + codes[:, w - 1 :]
            yield w, self.find(h)


_vocabularies: dict = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _by_length(words: list[bytes]):
    """Numbers and byte rows of the words with a space before, by length, in batches."""
    order = np.argsort([len(w) for w in words], kind="stable")
    lengths = np.array([len(words[i]) + 1 for i in order])
    at = 0
    while at < len(order):
        end = min(int(np.searchsorted(lengths, lengths[at], "right")), at + max(1, 60_000 // int(lengths[at])))
        some = order[at:end]
        yield some, np.frombuffer(b"".join(b" " + words[i] for i in some), np.uint8).reshape(len(some), lengths[at])
        at = end


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    top = np.max(parts, axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(np.array(parts) - safe).sum(0)) + safe


def forward(rows: np.ndarray, scores: np.ndarray, vocab: Vocabulary, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Log marginal probability of rows of equal length; with counts, the expected uses of each piece are added to `expected`."""
    n, length = rows.shape
    if length > SHORT:
        return np.array([_long(r, scores, vocab, 0.0 if counts is None else counts[i], expected) for i, r in enumerate(rows)])
    with_none = np.append(scores, -np.inf)  # -1 finds the last
    arcs = {w: (p, with_none[p]) for w, p in vocab.arcs(rows)}
    live = [w for w, (p, _) in arcs.items() if (p >= 0).any()]
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0
    for j in range(1, length + 1):
        alpha[j] = _log_sum([alpha[j - w] + arcs[w][1][:, j - w] for w in live if w <= j])
    if expected is not None:
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0
        for i in range(length - 1, -1, -1):
            beta[i] = _log_sum([arcs[w][1][:, i] + beta[i + w] for w in live if i + w <= length])
        for w in live:
            piece, score = arcs[w]
            use = np.exp(alpha[: length - w + 1].T + score + beta[w:].T - alpha[length][:, None]) * counts[:, None]
            ok = piece >= 0
            expected += np.bincount(piece[ok], use[ok], len(expected))
    return alpha[length]


def _long(row: np.ndarray, scores: np.ndarray, vocab: Vocabulary, count: float = 0.0, expected: np.ndarray | None = None, step: int = 4096) -> float:
    """The recursions for one long word, place by place, with the arcs of `step` places at a time; the expected uses go to `expected`, if given."""
    most, n = vocab.longest, len(row)
    with_none = np.append(scores, -np.inf)

    def pieces(at: int, end: int) -> np.ndarray:
        """Piece numbers of the arcs into at + 1 .. end, by start."""
        begin = max(0, at - most)
        into = np.full((end - at, most), -1, np.int32)
        for w, piece in vocab.arcs(row[None, begin:end]):
            stop = begin + w + np.arange(piece.shape[1])
            ok = stop > at
            into[stop[ok] - at - 1, most - w] = piece[0][ok]
        return into

    alpha = np.full(n + most + 1, -np.inf)  # alpha[most + j]
    alpha[most] = 0
    for at in range(0, n, step):
        end = min(n, at + step)
        into = with_none[pieces(at, end)]
        for j in range(at + 1, end + 1):
            parts = alpha[j : j + most] + into[j - at - 1]
            top = parts.max()
            alpha[most + j] = top + np.log(np.exp(parts - top).sum())
    if expected is not None:
        beta = np.full(n + most + 1, -np.inf)  # beta[most + j]
        beta[most + n] = 0
        for at in reversed(range(0, n, step)):
            end = min(n, at + step)
            piece = pieces(at, end)
            into = with_none[piece]
            for j in range(end, at, -1):
                beta[j : j + most] = np.logaddexp(beta[j : j + most], into[j - at - 1] + beta[most + j])
            # each arc's start, row by row as in `into`
            starts = np.lib.stride_tricks.sliding_window_view(alpha, most)[at + 1 : end + 1]
            ok = piece >= 0
            use = np.exp((starts + into + beta[most + at + 1 : most + end + 1, None])[ok] - alpha[most + n]) * count
            expected += np.bincount(piece[ok], use, len(expected))
    return float(alpha[most + n])


def _blocks(block_bytes: int):
    names = ["block", "pos", "word", "n", "doc_id", "held", "n_words", "ids"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def send(block, known, train, docs):
        words = list(known)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            cols = [[block] * len(part), range(at, at + len(part)), part, train[at : at + len(part)], *[[None] * len(part)] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=schema)
        for at in range(0, len(docs), 500):
            part = docs[at : at + 500]
            cols = [[block] * len(part), *[[None] * len(part)] * 3, *zip(*part, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=schema)

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        known: dict[bytes, int] = {}
        train, docs, size = [], [], 0
        for part in (p for batch in batches for p in text_slices(batch, 1)):
            for doc, text, rest in zip(*batch_rows(part, "doc_id", "text", "rest"), strict=True):
                ids = np.array([known.setdefault(w, len(known)) for w in _WORDS.findall((text or b"").translate(LOWER))], "<u4")
                train += [0] * (len(known) - len(train))
                if rest:  # learnt from
                    for k, c in zip(*np.unique(ids, return_counts=True), strict=True):
                        train[k] += int(c)
                docs.append((doc, rest == 0, len(ids), ids.tobytes()))
                size += len(text or b"") + 100
                if size >= block_bytes:
                    yield from send(block, known, train, docs)
                    block, known, train, docs, size = block + 1, {}, [], [], 0
        if docs:
            yield from send(block, known, train, docs)
        known, train, docs = {}, [], []
        give_back()

    return run


def _own_pieces(path):
    def run(batches):
        vocab = vocabulary(path)
        total = np.zeros(vocab.size)
        for batch in batches:
            for word, c in zip(*batch_rows(batch, "word", "c"), strict=True):
                for i in vocab.encode(" " + word.decode("utf-8", "replace")):
                    total[i] += c
        yield _piece_rows(total)

    return run


def _expected_pieces(path, scores):
    def run(batches):
        vocab = vocabulary(path)
        total = np.zeros(vocab.size)
        for batch in batches:
            words, c = batch_rows(batch, "word", "c")
            c = np.array(c, float)
            for some, rows in _by_length(words):
                forward(rows, scores, vocab, c[some], total)
        yield _piece_rows(total)

    return run


def _piece_rows(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.float64())], names=["piece", "n"])


def _score_words(path, scores):
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("lattice", pa.float64())])

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            out = np.zeros(len(words))
            for some, rows in _by_length(words):
                out[some] = forward(rows, scores, vocab)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], schema=schema)

    return run


class Model:
    """Piece scores (natural logarithms), the end token's, and the counts that the base score needs."""

    def __init__(self, scores: np.ndarray, end: float, n_docs: int, tokens: int, distinct: int):
        self.scores, self.end, self.n_docs, self.tokens, self.distinct = scores, end, n_docs, tokens, distinct


def _summed(df: DataFrame, size: int) -> np.ndarray:
    """Sums by piece; as many rows as the vocabulary has at most."""
    out = np.zeros(size)
    for r in df.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece] = r.n
    return out


def _fit(counts: DataFrame, n_docs: int, path: str | None, rounds: int) -> Model:
    """Unigram scores of the vocabulary from counts(word, c)."""
    vocab = vocabulary(path)
    row = counts.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    words, distinct = row[0] or 0, row[1]
    known = counts.where("c > 0")

    def scores(n: np.ndarray) -> tuple[np.ndarray, float]:
        total = n.sum() + n_docs + SMOOTH * (vocab.size + 1)
        return np.log((n + SMOOTH) / total), float(np.log((n_docs + SMOOTH) / total))

    found, end = scores(_summed(known.mapInArrow(_own_pieces(path), "piece int, n double"), vocab.size))
    for _ in range(rounds):
        found, end = scores(_summed(known.mapInArrow(_expected_pieces(path, found), "piece int, n double"), vocab.size))
    return Model(found, end, n_docs, words + n_docs, distinct + (n_docs > 0))


def _score_docs(model: Model):
    low = 0.1 / (model.tokens + 0.1 * (model.distinct + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        n = words.num_rows
        c, lattice = np.zeros(n), np.zeros(n)
        pos = words.column("pos").to_numpy()
        c[pos] = words.column("c").to_numpy()
        lattice[pos] = words.column("lattice").to_numpy()
        base = np.log10((c + 0.1) / (0.1 / low))
        end = np.log10((model.n_docs + 0.1) / (0.1 / low))
        known, score, plain = [], [], []
        for ids in docs.column("ids").to_pylist():
            ids = np.frombuffer(ids, "<u4")
            known.append(int((c[ids] > 0).sum()) + (model.n_docs > 0))
            plain.append(float(base[ids].sum() + end))
            score.append(float((lattice[ids].sum() + model.end) / np.log(10)))
        n_tokens = [k + 1 for k in docs.column("n_words").to_pylist()]
        cols = [docs.column("doc_id").to_pylist(), docs.column("held").to_pylist(), n_tokens, known, [model.tokens] * len(known), plain, score]
        return pa.table([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

    return run


def lattice_lm(docs: DataFrame, fold: int = 10, held: int = 0, path: str | None = None, rounds: int = EM_ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spread = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # rest: 1 learnt from, 0 held out, null neither
    spread = spread.withColumn("rest", (remainder(F.col("doc_id"), fold) != held).cast("int"))
    spread = spread.select("doc_id", "text", "rest")
    blocks = written(spread.mapInArrow(_blocks(block_bytes), "block long, pos int, word binary, n long, doc_id long, held boolean, n_words long, ids binary"), "blocks")
    vocab = blocks.where("pos is not null").select("block", "pos", "word", "n")
    texts = blocks.where("pos is null").select("block", "doc_id", F.coalesce("held", F.lit(False)).alias("held"), "n_words", "ids")
    counts = written(vocab.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    n_docs = spread.where("rest = 1").count()
    model = _fit(counts, n_docs, path, rounds)
    scored = written(counts.mapInArrow(_score_words(path, model.scores), "word binary, c long, lattice double"), "scored")
    found = vocab.select("block", "pos", "word").join(scored, "word").select(F.col("block").alias("of_block"), "pos", "c", "lattice")
    return texts.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_score_docs(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Best-fit packing of tokenised documents into fixed-length sequences, in two levels.

Each scan task tokenises its documents, cuts those over the capacity, and best-fits its own pieces (largest
first). Bins that are nearly full are final; every underfull one goes on as an item of its fill. Only the number of
items of each fill, below the capacity, is collected; best-fit decreasing over these counts, all items at once, gives
ranges of equal sequences. An item finds its place by its rank among those of its fill (the scan task's own rank and
the counts of the tasks before), so no task holds the items and none is left out; texts never move.

Token ids are those that `tokenizers` gives with the byte-level BPE file. Words repeat, so a word's ids come from
a bounded cache; a miss is encoded with the same vocabulary in rank form (the two are compared on a probe when a
worker starts), and texts whose white space could join words go to `tokenizers` as a whole.

Defined results: null text is empty and still yields its end token; an empty table gives no row; repeated rows
are packed each; a null doc_id stays null.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, pick, small_side, text_slices, written

CAPACITY = 1024
END_ID = 2
#: A bin with at most this much room is nearly full.
SLACK = 8
#: Pieces that a scan task packs at a time.
BLOCK = 200_000
#: Words, of less than 64 characters, whose ids a task keeps: some 25 MB.
CACHE = 100_000
PROBE = "It's 1,234 tests\tofé über naïve 中文 text… \n\n done <|endoftext|> x  y"

_JOINED = re.compile(r"\s \s|  ")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.whole.encode_special_tokens = True
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.word = tiktoken.Encoding("word", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self._slow(PROBE) != self._bytes(self.word.encode_ordinary(PROBE)):
            raise ValueError("the two vocabulary files differ")
        self.known = _Words(self)

    @staticmethod
    def _bytes(ids) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _slow(self, text: str) -> bytes:
        return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if _JOINED.search(text):
            return self._slow(text)
        # a lone space always begins a pre-token, so the words between lone spaces can be encoded one by one
        first, *rest = text.split(" ")
        return (self._bytes(self.word.encode_ordinary(first)) if first else b"") + b"".join(map(self.known.__getitem__, rest))


class _Words(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder._bytes(self.encoder.word.encode_ordinary(" " + word))
        if len(self) >= CACHE:
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids


_encoders: dict = {}


def encoder(json_path=None, ranks_path=None) -> Encoder:
    key = (json_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def cut(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of ids in bytes; only the first piece may be shorter than the capacity."""
    n = len(ids) // 4
    at, piece = 0, 0
    while at < n:
        length = (n - at) % capacity or capacity
        yield piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])
        at += length
        piece += 1


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: each item's bin and offset, and the bins' fills. The non-empty classes of room are the bits of one integer."""
    bin_of, offset, fills = [0] * len(sizes), [0] * len(sizes), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += s
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return bin_of, offset, fills


def best_fit_counts(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """best_fit() over counts by size: rows (first item, items a bin, first bin, offset, size), items numbered by falling size, and the number of bins.

    Equal bins are a range of numbers; a size splits at most two, so the rows depend on the sizes and not on the counts.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    mask, item, bins, rows = 0, 0, 0, []
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            fits = mask >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                first, n = room[r].pop()
                if not room[r]:
                    mask &= ~(1 << r)
            else:
                r, first, n = capacity, bins, -(-left // (capacity // s))
                bins += n
            # a bin that took one is the tightest for the next, until it has no room
            most = r // s
            full = min(n, left // most)
            parts = [(full, most), (1, left - full * most) if full < n else (0, 0)]
            for m, k in parts:
                if m and k:
                    rows.append((item, k, first, capacity - r, s))
                    room[r - k * s].append((first, m))
                    mask |= 1 << (r - k * s)
                    item, left, first, n = item + m * k, left - m * k, first + m, n - m
            if n:
                room[r].append((first, n))
                mask |= 1 << r
    return np.array(rows, np.int64).reshape(-1, 5), bins


def _scan(capacity: int, slack: int, paths: tuple):
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "grp")
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in names])

    def rows(pieces, grp, first, ranks):
        bin_of, offset, fills = best_fit([p[3] for p in pieces], capacity)
        out = [(*p, first + b, o, None, grp) for p, b, o in zip(pieces, bin_of, offset, strict=True)]
        for b, f in enumerate(fills):
            if f < capacity - slack:  # start: its rank among the task's bins of this fill
                out.append((None, -1, ranks[f], None, None, first + b, None, f, grp))
                ranks[f] += 1
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 50_000], strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        grp, first, pieces = TaskContext.get().partitionId(), TaskContext.get().partitionId() << 36, []
        ranks = [0] * (capacity + 1)
        encode, end = encoder(*paths), Encoder._bytes([END_ID])
        for batch in batches:
            for part in text_slices(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    pieces += [(doc, *p) for p in cut(encode(text or "") + end, capacity)]
                    if len(pieces) >= BLOCK:
                        yield from rows(pieces, grp, first, ranks)
                        first += len(pieces)
                        pieces = []
        if pieces:
            yield from rows(pieces, grp, first, ranks)
            pieces = []
        encode.known.clear()
        give_back()

    return run


def _place(rows: np.ndarray, first_host: int):
    schema = pa.schema([(n, pa.int64()) for n in ("bin", "host", "off")])

    def run(batches):
        for batch in batches:
            at = batch.column(1).to_numpy()
            item, k, first, offset, size = rows[np.searchsorted(rows[:, 0], at, "right") - 1].T
            host, off = first_host + first + (at - item) // k, offset + (at - item) % k * size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(host), pa.array(off)], schema=schema)

    return run


def placed(items: DataFrame, first_host: int, capacity: int = CAPACITY) -> DataFrame:
    """(bin, host, off) of items(bin, fill, grp, rank), rank from 0 among those of a fill and grp; hosts are numbered from first_host."""
    counts = written(items.groupBy("fill", "grp").agg(F.count("*").alias("n")), "fills")
    by_fill = {r.fill: r.n for r in counts.groupBy("fill").agg(F.sum("n").alias("n")).collect()}
    rows, _ = best_fit_counts(by_fill, capacity)
    starts = np.zeros(capacity + 1, np.int64)  # items of larger fills
    for f in range(capacity - 1, -1, -1):
        starts[f] = starts[f + 1] + by_fill.get(f + 1, 0)
    before = F.sum("n").over(Window.partitionBy("fill").orderBy("grp")) - F.col("n")
    first = F.get(F.lit(starts.tolist()), F.col("fill").cast("int"))
    start = counts.select("fill", "grp", (before + first).alias("first"))
    numbered = items.join(small_side(start), ["fill", "grp"]).select("bin", (F.col("first") + F.col("rank")).alias("item"))
    return numbered.mapInArrow(_place(rows, first_host), "bin long, host long, off long")


def pack(docs: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan: int | None = None, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset. `fan` has no effect: all groups are matched at once."""
    spread = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = written(spread.mapInArrow(_scan(capacity, slack, (json_path, ranks_path)), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, grp long"), "pieces")
    pieces = packed.where("piece >= 0").select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset")
    items = packed.where("piece < 0").select("bin", "fill", "grp", F.col("start").alias("rank"))
    groups = (packed.agg(F.max("grp")).first()[0] or 0) + 1
    place = written(placed(items, groups << 36, capacity), "place")
    return pieces.join(place, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("host", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("off", F.lit(0))).alias("offset"))

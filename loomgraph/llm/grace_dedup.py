"""Exact dedup by Grace hashing.

Texts are equal when their UTF-8 bytes are identical after lower-casing A-Z. Each scan task first folds its own
rows in a table of complete contents, so that a group of copies, however large, sends one text per task, and the
rows themselves go as numbers, which no bucket reads: they are joined to their class at the end. The folded
records are dealt out by 64 bits of their hash; in each bucket a bounded open-addressing table (a Python
dict: it probes by hash and then compares whole keys) gathers the classes, and a bucket beyond the memory bound
is split by the next hash bits into spill files of the task, which are read back one by one, recursively. Spill
files are the task's own scratch, gone when it ends; a task that runs again on another executor writes its own.

Defined results: null text counts as empty; a null doc_id is smaller than any other; among rows with the same
largest doc_id and equal texts (repeated rows) one stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch_rows, give_back, pick, text_slices, written

#: Bytes of text that a table holds before it spills (or, in the scan, is sent on).
TABLE_BYTES = 64 << 20
FAN_BITS = 4
#: Python's cost of one table entry besides the text.
ENTRY = 300

FOLDED = "h long, text binary, n long, best_doc long, best_row long, rep long, row_no long, doc_id long, sha binary"
PLACED = "rep long, keep_id long, group_size long, best_row long"
_FOLDED = pa.schema([("h", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("best_doc", pa.int64()), ("best_row", pa.int64()), ("rep", pa.int64()), ("row_no", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary())])
_PLACED = pa.schema([(n, pa.int64()) for n in ("rep", "keep_id", "group_size", "best_row")])


def _later(a, b):
    """The winner of two (doc_id, row_no): larger doc_id, then the earlier row."""
    da, db = (-(1 << 63) - 1 if x[0] is None else x[0] for x in (a, b))
    return a if (da, -a[1]) >= (db, -b[1]) else b


def fold(batches: Iterator[pa.RecordBatch], base: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows of one scan task as member rows (row_no, doc_id, rep, sha) and one record per distinct text of each table filling."""
    held: dict[bytes, list] = {}
    size = row = reps = 0

    def send():
        for start in range(0, len(items := list(held.items())), 2000):
            part = items[start : start + 2000]
            none = [None] * len(part)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([c[3] for _, c in part], [t for t, _ in part], [c[1] for _, c in part], [c[2][0] for _, c in part], [c[2][1] for _, c in part], [c[0] for _, c in part], none, none, none), _FOLDED, strict=True)], schema=_FOLDED)

    for batch in (p for b in batches for p in text_slices(b, 1)):
        ids, texts = batch_rows(batch, "doc_id", "text")
        out = []
        for doc, text in zip(ids, texts, strict=True):
            text = (text or b"").translate(LOWER)
            sha = hashlib.sha256(text).digest()
            me = (doc, base + row)
            row += 1
            known = held.get(text)
            if known is None:
                known = held[text] = [base + reps, 0, me, int.from_bytes(sha[:8], "big", signed=True)]
                reps += 1
                size += len(text) + ENTRY
            known[1] += 1
            known[2] = _later(known[2], me)
            out.append((known[0], me[1], doc, sha))
        none = [None] * len(out)
        rep, row_no, doc_id, sha_ = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((none, none, none, none, none, rep, row_no, doc_id, sha_), _FOLDED, strict=True)], schema=_FOLDED)
        if size > budget:
            yield from send()
            held, size = {}, 0
    yield from send()


def grace(records: Iterator[tuple], budget: int, level: int = 0, scratch: str | None = None) -> Iterator[tuple]:
    """(rep, keep_id, group_size, best_row) for every record (h, text, n, best_doc, best_row, [reps]). Beyond `budget` bytes the bucket is split by its next hash bits into files, each worked off alone."""
    held: dict[bytes, list] = {}
    size, files, names = 0, None, []
    most = 64 // FAN_BITS  # then all bits are used: one hash value, which can't be split

    def put(rec):
        pickle.dump(rec, files[(rec[0] & (1 << 64) - 1) >> (64 - FAN_BITS * (level + 1)) & (1 << FAN_BITS) - 1], protocol=5)

    with tempfile.TemporaryDirectory(dir=scratch) as room:
        for rec in records:
            if files is not None:
                put(rec)
                continue
            known = held.get(rec[1])
            if known is None:
                held[rec[1]] = list(rec[:3]) + [(rec[3], rec[4]), list(rec[5])]
                size += len(rec[1]) + ENTRY
            else:
                known[2] += rec[2]
                known[3] = _later(known[3], (rec[3], rec[4]))
                known[4] += rec[5]
            if size > budget and level < most and len(held) > 1:
                names = [os.path.join(room, f"{level}-{i}") for i in range(1 << FAN_BITS)]
                files = [open(n, "wb") for n in names]  # noqa: SIM115
                for c in held.values():
                    put((c[0], c[1], c[2], c[3][0], c[3][1], c[4]))
                held = {}
        if files is None:
            for c in held.values():
                for rep in c[4]:
                    yield rep, c[3][0], c[2], c[3][1]
            return
        for f in files:
            f.close()
        for name in names:
            yield from grace(_spilled(name), budget, level + 1, room)
            os.unlink(name)


def _spilled(name: str) -> Iterator[tuple]:
    with open(name, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _scan(budget: int):
    def run(batches):
        yield from fold(batches, TaskContext.get().partitionId() << 36, budget)
        give_back()

    return run


def _buckets(budget: int):
    def run(batches):
        def records():
            for batch in batches:
                for part in text_slices(batch, 1):
                    for h, text, n, doc, row, rep in zip(*batch_rows(part, "h", "text", "n", "best_doc", "best_row", "rep"), strict=True):
                        yield h, text, n, doc, row, (rep,)

        out: list[tuple] = []
        for got in grace(records(), budget):
            out.append(got)
            if len(out) >= 5000:
                yield _classes(out)
                out = []
        if out:
            yield _classes(out)
        give_back()

    return run


def _classes(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PLACED, strict=True)], schema=_PLACED)


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    spread = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    folded = written(spread.mapInArrow(_scan(table_bytes), FOLDED), "folded")
    records = folded.where("row_no is null").select("h", "text", "n", "best_doc", "best_row", "rep")
    classes = records.repartition("h").mapInArrow(_buckets(table_bytes), PLACED)
    members = folded.where("row_no is not null").select("rep", "row_no", "doc_id", "sha")
    return members.join(classes, "rep").select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("best_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

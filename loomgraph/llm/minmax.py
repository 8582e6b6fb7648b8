"""MinHash near-dedup with min-max hashing.

A document's set holds its distinct shingles of words (hashed to 64 bits). Under each of PERMUTATIONS hash
functions both the smallest and the largest value are kept: two signature entries for one evaluation, each equal
in two documents with a probability of their Jaccard similarity. The entries are cut into bands of two minima and
two maxima. Documents that agree in a band are candidates, and a link counts only after the full sets are compared.

Skew: documents with the same set (by a 128-bit digest of the whole sorted set) are one class from the start (a
partial aggregation), so copies never meet in pairs. A bucket of up to SMALL_BUCKET members lists its pairs. In a
larger one each of HUB_ROUNDS rounds compares the members with one hub only (linear in the bucket), and the confirmed
links are closed to components. The documents that are still apart in large buckets meet by FURTHER bands of six
entries of other permutations, FURTHER rows a document however many buckets it is in, and each such bucket has a hub
of its own, which is linear again. What is then in a large bucket but not
in its main component is compared with that component's documents and with the bucket's other strangers, in blocks of
CELL by CELL documents that emit one link a document and component, not pairs. So no link between components is lost
to a cap, pairs known to be connected are never listed, and no task gets a whole group.

A scan takes SLICE_BYTES of text at a time, and a longer text in parts, so its memory doesn't grow with the batch.

Defined results: every row is a document of its own, also where rows share a doc_id; no words (null, empty or blank
text): an empty set, linked with nothing; fewer words than a shingle: the whole sequence as one shingle; a null doc_id
has a null component_id, is linked with nothing and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE_BYTES, give_back, mix64, pick, small_side, text_key, text_slices, written
from .components import components

PERMUTATIONS = 64
BANDS = 32
#: Rounds with one hub a bucket before what is left apart is compared in blocks.
HUB_ROUNDS = 2
#: Further bands, of so many minima and maxima, that split what is left of a large bucket.
FURTHER, FURTHER_EACH = 16, 3
#: A bucket of so many members lists its pairs.
SMALL_BUCKET = 16
#: Documents on either side of a block of comparisons, about.
CELL = 1000
#: Entries of the sketch that spares most comparisons of full sets there.
SKETCH = 512

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(9, 14)]] = True


def _odd(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = _odd(11, 256)
_PLACE = _odd(12, 64)
_BAND = _odd(13, 64)
_MULTIPLY = _odd(14, 512)
_ADD = _odd(15, 512)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all the words of lower-cased texts, and the number of words of each text."""
    counts = np.zeros(len(texts), np.int64)
    data = b"\n".join((t or b"") for t in texts).translate(LOWER)
    raw = np.frombuffer(data + b"\n", np.uint8)
    inside = ~_SPACES[raw]
    if not inside.any():
        return np.zeros(0, _U), counts
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
    kept = raw[inside]
    before = np.cumsum(inside) - inside  # word bytes before a position
    starts = before[edge]
    lengths = np.diff(np.append(starts, len(kept)))
    at = np.arange(len(kept)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, _U(0x9E3779B97F4A7C15) | _U(1)))
    h = mix64(np.add.reduceat(_BYTE[kept] * powers[at], starts) + lengths.astype(_U))
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    counts = np.diff(np.searchsorted(edge, ends), prepend=0)
    return h, counts


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` word hashes."""
    if len(h) < width:
        return np.zeros(0, _U)
    out = h[: len(h) - width + 1] * _PLACE[0]
    for k in range(1, width):
        out += h[k : len(h) - width + 1 + k] * _PLACE[k]
    return mix64(out)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. A text beyond SLICE_BYTES goes through in parts that overlap by a shingle less a word."""
    out: list = [None] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t or b"") <= SLICE_BYTES]
    for i in set(range(len(texts))) - set(short):
        out[i] = _long_set(texts[i], width)
    h, counts = word_hashes([texts[i] for i in short])
    all_ = _shingles(h, width)
    at = 0
    for i, n in zip(short, counts.tolist(), strict=True):
        out[i] = np.unique(all_[at : at + n - width + 1]) if n >= width else _short_set(h[at : at + n])
        at += n
    return out


def _short_set(own: np.ndarray) -> np.ndarray:
    n = len(own)
    return mix64(np.array([int((own * _PLACE[:n]).sum(dtype=_U)) + 0x5851F42D4C957F2D * n & (1 << 64) - 1], _U)) if n else np.zeros(0, _U)


def _long_set(text: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    found, before, at = [], np.zeros(0, _U), 0
    while at < len(text):
        end = min(len(text), at + SLICE_BYTES)
        while end < len(text) and not (gap := np.flatnonzero(_SPACES[raw[end : end + SLICE_BYTES]])).size:  # on to the word's end
            end = min(len(text), end + SLICE_BYTES)
        end = end if end >= len(text) else end + int(gap[0])
        h = np.concatenate([before, word_hashes([text[at:end]])[0]])
        found.append(np.unique(_shingles(h, width)))
        before, at = h[max(0, len(h) - width + 1) :], end
    out = np.unique(np.concatenate(found))
    return out if len(out) else _short_set(before)


def signature(hashes: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima under each permutation; long sets go through in blocks."""
    low, high = None, None
    for at in range(0, len(hashes), 4096):
        values = hashes[at : at + 4096, None] * _MULTIPLY[:permutations] + _ADD[:permutations]
        a, b = values.min(0), values.max(0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return low, high


def band_keys(hashes: np.ndarray, permutations: int, bands: int) -> np.ndarray:
    """One key for each band of permutations/bands minima and as many maxima."""
    return _banded(*signature(hashes, permutations), bands)


def _banded(low: np.ndarray, high: np.ndarray, bands: int) -> np.ndarray:
    each = len(low) // bands
    both = np.hstack([low.reshape(bands, each), high.reshape(bands, each)])
    return mix64((both * _BAND[: 2 * each]).sum(1, dtype=_U) + np.arange(bands, dtype=_U))


def _sign(width: int, permutations: int, bands: int):
    """rid numbers the rows; set is the digest of the sorted set, null if it is empty."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in text_slices(batch, 2):
                sets = shingle_sets(part.column(2).to_pylist(), width)
                n = [len(x) for x in sets]
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                keys = [band_keys(x, permutations, bands).view(np.int64) if len(x) else [] for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + len(n)), pa.int64()), part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)
                rid += len(n)
        give_back()

    return run


def _gather(width: int):
    """Sets, sketches and further band keys of the texts that are compared."""
    schema = pa.schema([("rid", pa.int64()), ("shingles", pa.binary()), ("sketch", pa.binary()), ("more", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist(), width)
                marks = [sketch(x) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([m for m, _ in marks], pa.binary()), pa.array([k for _, k in marks], pa.list_(pa.int64()))], schema=schema)
        give_back()

    return run


def sketch(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """SKETCH min-max entries of one byte each, by other permutations than the bands', and keys of FURTHER bands of the first of these entries."""
    low = high = None
    for at in range(0, len(hashes), 4096):
        values = hashes[at : at + 4096, None] * _MULTIPLY[-SKETCH // 2 :] + _ADD[-SKETCH // 2 :]
        x, y = values.min(0), values.max(0)
        low, high = (x, y) if low is None else (np.minimum(low, x), np.maximum(high, y))
    some = FURTHER * FURTHER_EACH
    return (mix64(np.concatenate([low, high])) >> _U(56)).astype(np.uint8).tobytes(), _banded(low[:some], high[:some], FURTHER).view(np.int64)


def _compare(percent: int):
    """Links between the documents of two cells that are in different components: one for each document on the right and component on the left. The sketches leave out pairs that are surely below; the others' full sets are compared."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    # five standard deviations below
    j = percent / 100
    surely = j - 5 * (max(j * (1 - j), 0.01) / SKETCH) ** 0.5

    def columns(t: pa.Table):
        sets = [np.frombuffer(v, _U) for v in t.column("shingles").to_pylist()]
        return t.column("doc").to_numpy(), t.column("root").to_numpy(), sets, np.array([len(x) for x in sets]), np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            ids, roots, sets, sizes, marks = columns(left)
            for i, root, own, n, mark in zip(*columns(right), strict=True):
                fits = (roots != root) & (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent)
                some = np.flatnonzero(fits)
                if not len(some):
                    continue
                same = ((marks[some] == mark).mean(1) - 1 / 256) * 256 / 255
                done = set()
                for k in some[same >= surely][np.argsort(-same[same >= surely], kind="stable")]:
                    if roots[k] in done:
                        continue
                    both = len(np.intersect1d(own, sets[k], assume_unique=True))
                    if both * 100 >= percent * (n + sizes[k] - both):
                        done.add(roots[k])
                        a.append(min(i, ids[k]))
                        b.append(max(i, ids[k]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def across(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int, cell: int) -> DataFrame:
    """Links between left(grp, doc, root) and right(grp, doc, root) of the same group, compared in blocks of about `cell` by `cell` documents: each row goes to as many blocks as the other side has cells."""
    many = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count("*") / cell).cast("int").alias(name))
    cells = written(many(left, "ln").join(many(right, "rn"), "grp"), "cells")

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        df = df.join(small_side(cells), "grp").withColumn(own, F.pmod(F.xxhash64("doc"), F.col(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return df.select("grp", "lc", "rc", "doc", "root").join(sets.select(F.col("rid").alias("doc"), "shingles", "sketch"), "doc")

    # new names on one side, as both may come from one table
    first = dealt(left, "lc", "ln", "rc", "rn").toDF("doc", "g1", "l1", "r1", "root", "shingles", "sketch")
    second = dealt(right, "rc", "rn", "lc", "ln").toDF("doc", "g2", "l2", "r2", "root", "shingles", "sketch")
    return written(first.groupBy("g1", "l1", "r1").cogroup(second.groupBy("g2", "l2", "r2")).applyInArrow(_compare(percent), "a long, b long").distinct(), "links")


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = []
            for p, q in zip(x, y, strict=True):
                p, q = (np.frombuffer(v.as_buffer(), _U) for v in (p, q))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both * 100 >= percent * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], schema=schema)

    return run


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, bands: int = BANDS, hub_rounds: int = HUB_ROUNDS, small_bucket: int = SMALL_BUCKET, cell: int = CELL) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, th (text_key of the text), n_shingles, component_id (the smallest doc_id of its group), kept (doc_id = component_id) and first: whether it is the one row of its group that a filter leaves (the smallest doc_id, then th)."""
    spread = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), F.col("text").cast("binary").alias("text"))
    signed = written(spread.mapInArrow(_sign(width, permutations, bands), "rid long, doc_id long, th long, n long, set binary, keys array<long>"), "signed")

    # copies of a set are one class, which one row stands for
    full = signed.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("set").agg(F.min("rid").alias("rep"), F.min(F.struct("doc_id", "th", "rid")).alias("one")).select("set", "rep", "one.doc_id", "one.th", "one.rid"), "classes")
    reps = full.join(small_side(written(classes.select(F.col("rep").alias("rid")), "reps")), "rid", "left_semi")
    banded = reps.select(F.col("rid").alias("rep"), "doc_id", "th", "n", F.explode("keys").alias("key"))
    shared = written(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared")
    buckets = written(banded.join(small_side(shared), "key"), "buckets")

    members = written(buckets.groupBy("rep").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th")), "members")
    # repeated rows share doc_id and th, and one of them is enough
    texts = spread.join(small_side(members.select(F.col("rep").alias("rid"), "doc_id", "th")), ["doc_id", "th"])
    sets = written(texts.select("rid", "text").mapInArrow(_gather(width), "rid long, shingles binary, sketch binary, more array<long>").dropDuplicates(["rid"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs(a, b) whose full sets are similar enough."""
        one = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
        two = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
        return written(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), "links")

    fits = (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent) & (F.col("root") != F.col("hub_root"))
    ordered = (F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))

    def listed(these: DataFrame) -> DataFrame:
        """All pairs of a bucket that are in different components."""
        other = these.select("key", F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
        return these.select("key", "rep", "n", "root").join(other, "key").where(fits & (F.col("rep") < F.col("hub"))).select(*ordered)

    def with_hubs(rows: DataFrame, turn: int) -> DataFrame:
        """rows(key, rep, n, root) of buckets that hold more than one component, with the bucket's size m and its hub, another one each turn."""
        by = F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")
        hubs = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(F.struct(by.alias("by"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))).alias("h"))
        hubs = written(hubs.where("r1 <> r2").select("key", "m", "h.hub", "h.hub_n", "h.hub_root"), "hubs")
        return written(rows.join(small_side(hubs), "key"), "apart")

    def closed(found: DataFrame, state: DataFrame | None) -> DataFrame:
        """The components when the links found come in: the graph of these links between the components so far, which is small, is closed alone."""
        if state is None:
            return components(found)
        root_a, root_b = state.select(F.col("node").alias("a"), F.col("root").alias("ra")), state.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        between = found.join(root_a, "a", "left").join(root_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        new = components(between).select(F.col("node").alias("was"), F.col("root").alias("now"))
        later = state.join(small_side(new), F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
        return written(later.unionByName(new.join(state, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))), "state")

    def labelled(rows: DataFrame, state: DataFrame) -> DataFrame:
        return rows.select("key", "rep", "n").join(state.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))

    state, root, first = None, buckets.select("key", "rep", "n", F.col("rep").alias("root")), True
    for turn in range(hub_rounds):
        apart = with_hubs(root, turn)
        large = apart.where(F.col("m") > small_bucket)
        pairs = large.where(fits).select(*ordered)
        if first:
            pairs = pairs.unionByName(listed(apart.where(F.col("m") <= small_bucket)))
        found = confirmed(written(pairs.distinct(), "pairs"))
        if first or not found.isEmpty():
            state = closed(found, state)
        first = False
        root = labelled(large, state)
    # large buckets in which components are still apart: part them by further bands, a hub each
    root = written(root, "root")
    apart = with_hubs(root, hub_rounds)
    if not apart.isEmpty():
        each = apart.select("rep", "n", "root").distinct().join(sets.select(F.col("rid").alias("rep"), "more"), "rep").select("rep", "n", "root", F.posexplode("more").alias("band", "own"))
        parts = each.select(F.xxhash64("band", "own").alias("key"), "rep", "n", "root")
        found = confirmed(written(with_hubs(written(parts, "parts"), 0).where(fits).select(*ordered).distinct(), "pairs"))
        if not found.isEmpty():
            state = closed(found, state)
            root = labelled(root, state)
    # what is left: strangers to the bucket's main component
    spread_of = root.groupBy("key", "root").count()
    main = spread_of.groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("k")).where("k > 1").select("key", F.col("top.root").alias("main"))
    apart = written(root.select("key", F.col("rep").alias("doc"), "root").join(main, "key"), "apart")
    if not apart.isEmpty():
        strangers = apart.where("root <> main")
        # meet all of that component's documents in such buckets, and each other within the bucket
        of_main = apart.where("root = main").select(F.col("main").alias("grp"), "doc", "root").distinct()
        of_key = strangers.select(F.col("key").alias("grp"), "doc", "root")
        met = across(of_main, strangers.select(F.col("main").alias("grp"), "doc", "root").distinct(), sets, percent, cell)
        met = met.unionByName(across(of_key, of_key, sets, percent, cell))
        if not met.isEmpty():
            state = closed(met, state)

    # a group is a component of classes; its first row and smallest doc_id are those of its classes
    grouped = classes.join(state.select(F.col("node").alias("rep"), "root"), "rep", "left").select("set", F.coalesce("root", "rep").alias("grp"), F.struct("doc_id", "th", "rid").alias("one"))
    grouped = grouped.join(grouped.groupBy("grp").agg(F.min("one").alias("least")), "grp").select("set", "least")
    out = signed.join(grouped.withColumnRenamed("set", "of_set"), F.col("set") == F.col("of_set"), "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), (~linked | (F.col("rid") == F.col("least.rid"))).alias("first"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

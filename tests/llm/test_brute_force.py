"""Operators against plain Python on the small tables."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import lattice_lm, mixing, packing, queries, toxicity
from loomgraph.llm.byte_cnn import ByteCNN, cut_windows
from loomgraph.llm.common import text_key
from loomgraph.llm.components import components
from loomgraph.llm.grace_dedup import exact_dedup, grace
from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.minmax import near_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(3)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


def test_grace_spills_and_agrees(docs, texts):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs, table_bytes=3000).collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t.translate(LOWER)].append(i)
    assert got == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_grace_recursion_ends_on_equal_hashes(tmp_path):
    records = [(7, b"%d" % (i % 5), 1, i, i, (i,)) for i in range(200)]
    got = {rep: (keep, size) for rep, keep, size, _ in grace(iter(records), 10, scratch=str(tmp_path))}
    assert got == {i: (195 + i % 5, 40) for i in range(200)} and not list(tmp_path.iterdir())


@pytest.mark.parametrize("options", [{}, {"small_bucket": 1, "cell": 7, "hub_rounds": 1}])
def test_near_dedup(docs, texts, options):
    sets = {}
    for i, t in texts.items():
        w = words(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs, width=4, **options).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_copies_in_one_bucket(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        own = list(base)
        for k in rnd.sample(range(200), i % 4):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(w if k % 9 else f"y{i}{k}" for k, w in enumerate(base))) for i in range(20)]
    out = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hub_rounds=1, cell=30).collect()}
    assert {out[i] for i in range(120)} == {0} and all(out[1000 + i] == 1000 + i for i in range(20))


@pytest.mark.parametrize("chunk", [3, 1000])
def test_components(spark, chunk):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), chunk).collect()}
    assert got == {x: find(x) for x in root}


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 1024
    assert len(by_seq) <= 1.03 * -(-total // 1024) + 1


def test_tree_of_merges(docs):
    one, many = (packing.pack(docs.repartition(9), fan=f) for f in (64, 2))
    assert abs(one.select("sequence_id").distinct().count() - many.select("sequence_id").distinct().count()) <= 3


def test_packing_by_counts_is_best_fit():
    rnd = random.Random(6)
    for _ in range(200):
        capacity = rnd.choice([10, 64, 1024])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 40) for _ in range(rnd.randint(0, 30))}
        rows, n = packing.best_fit_counts(counts, capacity)
        _, _, fills = packing.best_fit([s for s, c in counts.items() for _ in range(c)], capacity)
        used, ends = defaultdict(list), [*[r[0] for r in rows[1:]], sum(counts.values())]
        for (item, k, first, offset, size), end in zip(rows.tolist(), ends, strict=True) if len(rows) else ():
            for i in range(end - item):
                used[first + i // k].append((offset + i % k * size, size))
        got = []
        for parts in used.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:], strict=False))
            got.append(sum(parts[-1]))
        assert sorted(got) == sorted(fills) and len(used) == n
        assert Counter(s for parts in used.values() for _, s in parts) == counts


def test_every_underfull_bin_is_handed_on(spark):
    """40 scan tasks whose long and short documents lie apart: more underfull bins than 50,000, and each long one takes a short one."""
    n = 120_000
    items = spark.range(0, 2 * n, 1, 40).selectExpr("id AS bin", f"if(id < {n}, 650L, 300L) AS fill", f"id div {n // 20} AS grp", f"id % {n // 20} AS rank")
    out = packing.placed(items, 1 << 40).join(items, "bin").groupBy("host").agg(F.sum("fill").alias("fill"), F.sort_array(F.collect_list("off")).alias("off"))
    assert out.groupBy("fill", "off").count().collect() == [(950, [0, 650], n)]


def test_words_encode_like_whole_texts():
    enc, rnd = packing.encoder(), random.Random(2)
    parts = [" ", "  ", "\n", " \n", "\n ", "a", "Bc", "'s", "é", "12", "..", "\t", "中", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert enc(text) == enc._slow(text)


def test_lattice_counts(docs, texts):
    own = {i: words(t.translate(LOWER)) for i, t in texts.items()}
    learnt = [i for i in own if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in learnt for w in own[i])
    c["\n"] = len(learnt)
    n, v = sum(c.values()), len(c)
    rows = lattice_lm.lattice_lm(docs, block_bytes=50_000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = [*own[r.doc_id], "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.held_out == (r.doc_id not in learnt) and r.score < 0


def test_lattice_sums_all_segmentations():
    import base64

    import public_tokenizers

    vocab = lattice_lm.vocabulary()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    scores = np.random.default_rng(1).normal(-8, 2, vocab.size)

    def brute(w):
        w = b" " + w
        a = [0.0]
        for j in range(1, len(w) + 1):
            a.append(np.logaddexp.reduce([a[i] + scores[ranks[w[i:j]]] for i in range(j) if w[i:j] in ranks]))
        return a[-1]

    some = [b"the", "año".encode(), b"x" * 70, b"password=1234", b"a", b"thean" * 300, b"a--------b"]
    for at, rows in lattice_lm._by_length(some):
        assert lattice_lm.forward(rows, scores, vocab) == pytest.approx([brute(some[i]) for i in at])
    total = np.zeros(vocab.size)
    lattice_lm.forward(np.frombuffer(b" the", np.uint8)[None], scores, vocab, np.ones(1), total)
    lengths = np.array([len(p) for p, _ in sorted(ranks.items(), key=lambda x: x[1])])
    assert (total[: len(lengths)] * lengths).sum() == pytest.approx(4)


def test_lattice_learns_from_long_words(spark):
    """Block by block the expected counts are those of the whole lattice, and words of 64 bytes and more count in the fit."""
    vocab = lattice_lm.vocabulary()
    scores = np.random.default_rng(2).normal(-8, 2, vocab.size)
    for word in (b" " + b"the" * 30, b" " + "\u4e2d\u6587\u5206\u8bcd".encode() * 9, b" " + b"a--------b" * 40):
        row = np.frombuffer(word, np.uint8)
        with_none = np.append(scores, -np.inf)
        arcs = [(w, i, p) for w, found in vocab.arcs(row[None]) for i, p in enumerate(found[0]) if p >= 0]
        alpha, beta = np.full(len(row) + 1, -np.inf), np.full(len(row) + 1, -np.inf)
        alpha[0] = beta[-1] = 0
        for w, i, p in sorted(arcs, key=lambda x: x[0] + x[1]):
            alpha[i + w] = np.logaddexp(alpha[i + w], alpha[i] + with_none[p])
        for w, i, p in sorted(arcs, key=lambda x: -x[1]):
            beta[i] = np.logaddexp(beta[i], beta[i + w] + with_none[p])
        want = np.zeros(vocab.size)
        for w, i, p in arcs:
            want[p] += 3 * np.exp(alpha[i] + scores[p] + beta[i + w] - alpha[-1])
        for step in (7, 50, 4096):
            got = np.zeros(vocab.size)
            assert lattice_lm._long(row, scores, vocab, 3.0, got, step) == pytest.approx(alpha[-1])
            assert np.allclose(got, want)
        got = np.zeros(vocab.size)
        lattice_lm.forward(row[None], scores, vocab, np.array([3.0]), got)
        assert np.allclose(got, want)
    # a corpus of long words alone: the pieces they are made of must be likelier than the floor
    long = "\u4e2d\u6587\u5206\u8bcd" * 10
    counts = spark.createDataFrame([(bytearray(long.encode()), 50)], "word binary, c long")
    model = lattice_lm._fit(counts, 1, None, lattice_lm.EM_ROUNDS)
    used = np.exp(model.scores) > 2 * np.exp(model.scores.min())
    assert used.any()
    row = np.frombuffer(b" " + long.encode(), np.uint8)
    assert lattice_lm.forward(row[None], model.scores, vocab)[0] > lattice_lm.forward(row[None], np.full(vocab.size, model.scores.min()), vocab)[0] + 10


def test_line_dedup(spark):
    """Against the definition: of two equal spans of 25 words, the later one goes, if a passage of 50 words holds them; and only such lines go."""
    rnd = random.Random(4)
    passages = [[" ".join(f"p{k}_{i}_{j}" for j in range(rnd.randint(3, 30))) for i in range(rnd.randint(2, 9))] for k in range(8)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            p = passages[rnd.randrange(8)]
            a = rnd.randrange(len(p))
            lines += rnd.choice([p, p[a:], p[: a + 1], p[a : a + 2]])
            lines += rnd.choice([[], ["", " "], [f"own {d} " + " ".join("abcdef"[rnd.randrange(6)] for _ in range(rnd.randint(1, 30)))]])
        rows.append((d // 2 if d % 20 == 1 else d, "\n".join(lines)))  # some doc_ids have two texts
    got = [(r.doc_id, r.before, r.text, r.n_removed) for r in line_dedup(spark.createDataFrame([(*r, r[1]) for r in rows], "doc_id long, text string, before string").repartition(3)).collect()]
    assert sorted((d, b) for d, b, *_ in got) == sorted(rows)
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", text_key(F.col("t")).alias("h")).collect()}
    order = sorted({(d, hashes[t]): t for d, t in rows}.items())
    lines = [[x for x in t.split("\n") if words(x)] for _, t in order]
    n = [[len(words(x)) for x in own] for own in lines]

    def runs(least):
        """Of each document the lines of spans of `least` words that an earlier place has too."""
        seen, out = {}, []
        for d, own in enumerate(lines):
            gone = set()
            for a in range(len(own)):
                for b in range(a, len(own)):
                    if sum(n[d][a : b + 1]) >= least and seen.setdefault(tuple(own[a : b + 1]), (d, a)) != (d, a):
                        gone |= set(range(a, b + 1))
            out.append(gone)
        return out

    after = {(d, hashes[b]): (t, k) for d, b, t, k in got}
    must, may = runs(50), runs(25)
    some = 0
    for d, (key, _) in enumerate(order):
        left = [x for x in after[key][0].split("\n") if words(x)]
        at, gone = 0, set()
        for i, x in enumerate(lines[d]):  # the lines that stay, in order; of equal neighbours the first ones
            if at < len(left) and left[at] == x and i not in must[d]:
                at += 1
            else:
                gone.add(i)
        assert at == len(left) and must[d] <= gone <= may[d], (key, must[d], gone, may[d])
        some += len(gone)
    assert some > 100
    # nothing is lost from the corpus
    assert {x for own in lines for x in own} == {x for _, _, t, _ in got for x in t.split("\n") if words(x)}


def test_line_dedup_with_a_part_elsewhere(spark):
    """A passage goes wholly from its second place, though an earlier document has only the middle of it."""
    for seed in range(4):
        own = [" ".join(f"w{seed}_{i}_{j}" for j in range(13)) for i in range(4)]
        fill = [[f"f{seed} {d} " + " ".join(f"x{d}_{j}" for j in range(9)) for _ in range(2)] for d in range(3)]
        rows = [(1, "\n".join([fill[0][0], *own[1:3], fill[0][1]])), (2, "\n".join([fill[1][0], *own, fill[1][1]])), (3, "\n".join([fill[2][0], *own, fill[2][1]]))]
        got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[3] == "\n".join(fill[2]) and got[1] == rows[0][1]
        assert set(own[::3]) <= set(got[2].split("\n"))


def test_line_dedup_by_row(spark):
    """Rows of one doc_id with different texts are edited each by its own."""
    passage = "\n".join(" ".join(f"p{i}_{j}" for j in range(20)) for i in range(4))
    rows = [(1, "top\n" + passage), (2, "head\n" + passage), (2, "head\n" + passage.replace("p", "q")), (3, "line\n" * 100_000), (4, None), (5, "")]
    got = sorted((r.doc_id, r.text or "") for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[:3] == [(1, rows[0][1]), (2, "head"), (2, rows[2][1])]
    # of a line that repeats without end, what is no later repeat of 25 words stays
    assert len(got[3][1].split("\n")) < 30


def test_mixing(docs, texts):
    src = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SF}/documents.parquet'").fetchall())
    n = Counter()
    for i, t in texts.items():
        n[src[i]] += len(words(t))
    rows = mixing.mix(docs, max_repeats=1.5).collect()
    times = Counter(r.doc_id for r in rows)
    assert set(times) == set(texts) and max(times.values()) <= 2
    took = Counter()
    for r in rows:
        took[r.source] += r.n_tokens
    tokens = [(float(x), 1) for x in n.values()]
    alpha = mixing.find_alpha(tokens, None, 1.5, None)
    z, top = sum(x**alpha for x in n.values()), max(n.values())
    budget = top / (top**alpha / z)
    longest = max(len(words(t)) for t in texts.values())
    for s in n:
        aim = budget * n[s] ** alpha / z
        assert aim - longest - 1 <= took[s] <= min(aim, 1.5 * n[s]) + 1e-3
    half = mixing.mix(docs, target_entropy=0.9, budget=sum(n.values()) / 2).collect()
    assert sum(r.n_tokens for r in half) <= sum(n.values()) / 2 + 1 and len({r.doc_id for r in half}) == len(half)


def test_alpha_meets_the_aim():
    tokens = [(1000.0, 1), (100.0, 3), (10.0, 2)]
    alpha = mixing.find_alpha(tokens, 0.8, None, None)
    assert mixing.entropy(tokens, alpha) == pytest.approx(0.8, abs=1e-6)
    alpha = mixing.find_alpha(tokens, None, 3.0, None)
    assert mixing.repeats(tokens, alpha, None) == pytest.approx(3.0)
    assert mixing.find_alpha(tokens, None, 1e9, None) == 0.0


def test_cnn_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = ByteCNN(3, widths=(2, 3), filters=4, dim=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y, w = rng.integers(97, 105, (6, 12)).astype(np.uint8), rng.integers(0, 3, 6), np.ones(6)
    _, g = net.gradients(x, y, w)
    for k in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[k].shape) if k != "e" else (100, 1)
        old, e = net.p[k][at], 1e-6
        net.p[k][at] = old + e
        up, _ = net.gradients(x, y, w)
        net.p[k][at] = old - e
        down, _ = net.gradients(x, y, w)
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=1e-5)


def test_windows_cover_everything():
    data = bytes(range(256)) * 3
    cut = cut_windows(data, 100, 70)
    assert cut.shape[1] == 100 and bytes(cut[-1]) == data[-100:] and len(cut) >= len(data) // 100


def test_classifiers_hold_out(spark):
    """Held-out accuracy on sf0.01; the table is too small for the rarer classes to be learnt fully."""
    sf = SF.replace("0.001", "0.01")
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op3_byte_cnn_langid(spark, sf).join(lang, "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.93
    got = queries.op7_byte_cnn_quality(spark, sf).join(lab, "doc_id").where("held_out and quality is not null").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    got = queries.op1_zstd_toxicity(spark, sf).join(lab, "doc_id").where("held_out and toxic is not null").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.85


def test_toxic_windows_compress():
    rnd = random.Random(5)
    plain = [" ".join(rnd.choice(["ton", "re", "lin", "mar"]) + rnd.choice(["da", "ko", "su"]) for _ in range(60)) for _ in range(400)]
    bad = [t + " horrid vermin" + t[:20] for t in plain[:150]]
    model = toxicity.dictionaries([t.encode() for t in bad[:100]], [t.encode() for t in plain[150:300]])
    rest = bad[100:] + plain[300:]
    toxicity.calibrated(model, [model.features(t.encode()) for t in rest], [True] * 50 + [False] * 100)
    good, evil = model.score([b"tonda reko linsu marda reko"]), model.score([b"tonda reko horrid vermin marda reko"])
    assert evil[0] > 0.5 > good[0]

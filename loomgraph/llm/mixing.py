"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

A source's weight is its token share to the power alpha, normalised: 1 keeps the shares, 0 levels them. Alpha is
found by bisection, either for a target entropy (a fraction of the greatest possible) or as the flattest that
repeats no source more than `max_repeats` times. The token budget is given, or the least with which every source is
taken whole once, so that nothing is lost. A source's part of the budget is met by whole epochs and a part of one
more: its documents fall into blocks by a hash, each epoch has its own permutation of a source's blocks, and the last
epoch takes blocks in that order, the block on the boundary by its documents' own order, until the budget is met.

Bounds: a source has as many blocks as the square root of its tokens over BLOCK_UNIT, so that both what is ordered at
once, a source's blocks in an epoch and the documents of the block on the boundary, grows as the root of the source
only. What is ordered are narrow rows (key, tokens), from a table of one such row a document; texts are joined to the
result and never sorted. The driver sees, for an aim that needs them, token totals to four digits and their
frequency, at most some ten thousand numbers however many sources there are; repetition is bounded on exact totals.

Defined results: null source is a source of its own; null text has no tokens; a source without tokens has weight 0
and is taken once, as it costs nothing; rows that repeat doc_id and text are taken together, as often as the input
has them; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, pick, small_side, text_key, written

#: A source has sqrt(tokens / BLOCK_UNIT) blocks.
BLOCK_UNIT = 256
SEED = 42


def entropy(tokens: list[tuple[float, int]], alpha: float) -> float:
    """Entropy of the weights of (tokens, number of sources with so many) under alpha, as a fraction of the greatest."""
    n = sum(c for _, c in tokens)
    if n < 2:
        return 1.0
    top = max(t for t, _ in tokens)
    powers = [((t / top) ** alpha, c) for t, c in tokens]
    z = sum(p * c for p, c in powers)
    return -sum(c * p / z * math.log(p / z) for p, c in powers if p > 0) / math.log(n)


def repeats(tokens: list[tuple[float, int]], alpha: float, budget: float | None) -> float:
    """How often the most repeated source is taken under alpha."""
    top, least = max(t for t, _ in tokens), min(t for t, _ in tokens)
    if budget is None:  # the largest source is taken once
        return (top / least) ** (1 - alpha)
    z = sum(c * t**alpha for t, c in tokens)
    return max(budget * t**alpha / z / t for t, _ in tokens)


def find_alpha(tokens: list[tuple[float, int]], target_entropy: float | None, max_repeats: float | None, budget: float | None, rounds: int = 60) -> float:
    """Bisection for alpha in 0..1. Entropy and repeats both fall as alpha grows; an aim out of reach gives the nearer end."""
    if target_entropy is not None:
        fits = lambda a: entropy(tokens, a) >= target_entropy  # noqa: E731  the largest alpha that is level enough
        if not fits(0.0):
            return 0.0
        low, high = 0.0, 1.0
        if fits(1.0):
            return 1.0
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low
    within = lambda a: repeats(tokens, a, budget) <= max_repeats * (1 + 1e-12)  # noqa: E731  the smallest alpha within the limit
    if within(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if within(mid) else (mid, high)
    return high


def _key(source) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _block(doc_id: Column, th: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, th, F.lit(seed)), blocks)


def plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, block_unit: int = BLOCK_UNIT, seed: int = SEED) -> DataFrame:
    """Sources (skey, tokens, blocks, weight, aim, whole, part, alpha) of the written table docs(skey, n_tokens): whole epochs and the tokens of one more."""
    totals = written(docs.groupBy("skey").agg(F.sum("n_tokens").alias("tokens")), "totals")
    ends = totals.where("tokens > 0").agg(F.max("tokens"), F.min("tokens")).first()
    alpha = 1.0
    if ends[0]:
        if target_entropy is None and budget is None:  # the largest and the smallest source decide
            tokens = [(float(ends[0]), 1), (float(ends[1]), 1)]
        else:
            digits = F.pow(F.lit(10.0), F.floor(F.log10("tokens")) - 3)
            seen = totals.where("tokens > 0").groupBy((F.round(F.col("tokens") / digits) * digits).alias("tokens")).count().collect()
            tokens = sorted((r["tokens"], r["count"]) for r in seen)
        alpha = find_alpha(tokens, target_entropy, max_repeats, budget)
    z = totals.agg(F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))))).first()[0] or 1.0
    if budget is None:
        top = float(ends[0] or 0)
        budget = top / (top**alpha / z) if top else 0.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / z).otherwise(0.0)
    sources = totals.withColumn("weight", weight).withColumn("aim", F.col("weight") * float(budget))
    if max_repeats is not None:  # where totals were rounded, the exact one still bounds
        sources = sources.withColumn("aim", F.least("aim", F.col("tokens") * float(max_repeats)))
    # a hair of slack, so that a source that is due whole is not cut by rounding
    sources = sources.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("aim") / F.col("tokens") + 1e-9)).otherwise(1).cast("long"))
    sources = sources.withColumn("part", F.greatest(F.lit(0).cast("long"), F.floor(F.col("aim") - F.col("whole") * F.col("tokens") + 1e-6).cast("long")))
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("tokens") / F.lit(block_unit)))).cast("long"))
    return written(sources.withColumn("alpha", F.lit(alpha)), "sources")


def _turns(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(skey, block, epoch, turn, t, takes) for docs(skey, block, n_tokens, rows): each epoch's permutation of a source's blocks, and the tokens taken of each."""
    per_block = docs.groupBy("skey", "block").agg(F.sum("n_tokens").alias("t"))
    turns = per_block.join(small_side(sources), "skey").withColumn("epoch", F.explode(F.expr("sequence(0L, whole)"))).where((F.col("epoch") < F.col("whole")) | (F.col("part") > 0))
    order = Window.partitionBy("skey", "epoch").orderBy(F.xxhash64("skey", "epoch", "block", F.lit(seed)), "block")
    turns = turns.withColumn("turn", F.row_number().over(order).cast("long")).withColumn("before", F.sum("t").over(order) - F.col("t"))
    takes = F.when(F.col("epoch") < F.col("whole"), F.col("t")).otherwise(F.least(F.col("t"), F.greatest(F.lit(0).cast("long"), F.col("part") - F.col("before"))))
    return turns.withColumn("takes", takes).where((F.col("epoch") < F.col("whole")) | (F.col("takes") > 0)).select("skey", "block", "epoch", "turn", "t", "takes")


def _tokens(text):
    return F.coalesce(F.size(F.array_remove(F.split(text.cast("string"), f"{SPACE}+", -1), "")), F.lit(0)).cast("long")


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, block_unit: int = BLOCK_UNIT, seed: int = SEED) -> DataFrame:
    """Rows of docs(doc_id, source, text, ...) as often as the mixture takes them, with all their columns and n_tokens, epoch, block and turn (the block's place in the epoch's permutation), which replace columns of these names."""
    narrow = pick(docs, "doc_id", "source", "text")
    narrow = narrow.select(_key(F.col("source")).alias("skey"), F.col("doc_id").cast("string").alias("id"), text_key(F.col("text")).alias("th"), _tokens(F.col("text")).alias("n_tokens"))
    narrow = written(narrow, "narrow")
    sources = plan(narrow, target_entropy, max_repeats, budget, block_unit, seed)
    blocks_of = written(sources.select("skey", "blocks"), "blocks_of")
    placed = narrow.join(small_side(blocks_of), "skey").withColumn("block", _block(F.col("id"), F.col("th"), F.col("blocks"), seed))
    turns = written(_turns(placed, sources, seed), "turns")
    whole = written(turns.where("takes = t").select("skey", "block", "epoch", "turn"), "whole")
    # the block on a source's boundary: one at most an epoch, whose documents are ordered by themselves
    cut = written(turns.where("takes < t").select("skey", "block", "epoch", "turn", "takes"), "cut")
    each = placed.groupBy("skey", "block", "id", "th").agg(F.sum("n_tokens").alias("n_tokens")).join(small_side(cut), ["skey", "block"])
    inside = Window.partitionBy("skey", "block", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "id", "th"), "id", "th").rowsBetween(Window.unboundedPreceding, 0)
    some = each.withColumn("sofar", F.sum("n_tokens").over(inside)).where("sofar <= takes")
    some = written(some.select(F.col("skey").alias("of_key"), F.col("id").alias("of_id"), F.col("th").alias("of_th"), "block", "epoch", "turn"), "some")

    names = docs.columns
    lower = [c.lower() for c in names]
    col = {n: F.col(f"c{names.index(n) if n in names else lower.index(n)}__") for n in ("doc_id", "source", "text")}
    flat = docs.toDF(*[f"c{i}__" for i in range(len(names))])
    flat = flat.select("*", _key(col["source"]).alias("skey"), col["doc_id"].cast("string").alias("id"), text_key(col["text"]).alias("th"), _tokens(col["text"]).alias("n_tokens"))
    by_block = flat.join(small_side(blocks_of), "skey").withColumn("block", _block(F.col("id"), F.col("th"), F.col("blocks"), seed)).drop("blocks")
    first = by_block.join(small_side(whole), ["skey", "block"])
    same = (F.col("skey") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))
    rest = flat.join(small_side(some), same)
    own = ("n_tokens", "epoch", "block", "turn")
    kept = [F.col(f"c{i}__").alias(c) for i, c in enumerate(names) if c.lower() not in own]
    return first.select(*kept, *own).union(rest.select(*kept, *own))

"""Removal of passages that repeat, by winnowing over line hashes, in DataFrame functions only.

Lines with a word are hashed and numbered. A gram is the fewest lines from a position on that hold MIN_WORDS words; a
back gram is the fewest lines up to one that do. Of WINDOW consecutive grams' hashes the smallest (the first, if
equal) is a fingerprint, and so is every gram of one line. With a WINDOW of 2, two equal passages of 2 * MIN_WORDS words
in whole lines always share one: if the first line is no gram alone, the next gram lies in the passage too.

Fingerprints that occur twice or more are the seeds. From each seed a match is extended both ways over the lines
beside it: the grams less than WINDOW lines away and the back grams that end up to MIN_WORDS + WINDOW lines on, which
in a shared passage reach its first and its last line. Extended spans are joined by their content's hash, and one
that has an earlier equal in the corpus, by (doc_id, line), is removed. So

* a passage of 2 * MIN_WORDS words or more in whole lines goes wholly from every place but its first, whichever
  parts of it other documents hold;
* what goes always lies in a span of MIN_WORDS words with an earlier equal, and of equal lines the first one in the
  corpus always stays (it has no earlier equal), so nothing is lost from the corpus;
* blank lines inside a removed run go with it.

Joins are by equality of a hash with one row a distinct span, never between documents or within a group: a passage of
a third of all documents, or a line that one document repeats, gives one row a place. Windows run within a document.

Defined results: a row is told by its doc_id and its text, so rows that share a doc_id but not the text are documents
of their own, in the order of the texts' hashes, and rows that repeat both are edited alike; null or empty text has
no line and stays as it is; rows with a null doc_id are left as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, pick, small_side, text_key, written

MIN_WORDS = 25
WINDOW = 2

KEY = ("doc_id", "th")


def _blank(line):
    return F.length(F.regexp_replace(line, f"^{SPACE}+", "")) == 0


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, h, words) of every line with a word; at counts all lines."""
    each = docs.select(*KEY, F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(~_blank(F.col("line")))
    words = F.size(F.array_remove(F.split("line", f"{SPACE}+", -1), ""))
    each = each.select(*KEY, "at", F.xxhash64("line").alias("h"), words.cast("long").alias("words"))
    # one shuffle serves all the windows; of rows that repeat one line stays at each place
    return each.repartition(*KEY).withColumn("copy", F.row_number().over(Window.partitionBy(*KEY, "at").orderBy("h"))).where("copy = 1").drop("copy")


def grams(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """Of each line with a word: (doc_id, th, ord, at), its gram (null near the end), the gram's last line, its back gram (null near the start), that one's first line, and whether winnowing selects the gram."""
    doc = Window.partitionBy(*KEY)
    lines = _lines(docs).withColumn("ord", F.row_number().over(doc.orderBy("at")).cast("long"))
    lines = lines.withColumn("upto", F.sum("words").over(doc.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("before", F.col("upto") - F.col("words")).withColumn("total", F.sum("words").over(doc))
    on, back = doc.orderBy("before").rangeBetween(0, min_words - 1), doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    place = F.struct("ord", "at")
    rows = lines.select("*", F.collect_list("h").over(on).alias("hs"), F.max(place).over(on).alias("last"))
    rows = rows.select("*", F.collect_list("h").over(back).alias("bs"), F.min(place).over(back).alias("first"))
    whole = F.col("total") - F.col("before") >= min_words
    rows = rows.select(*KEY, "ord", "at", "words", F.when(whole, F.xxhash64("hs")).alias("gram"), "last", F.when(F.col("upto") >= min_words, F.xxhash64("bs")).alias("bgram"), "first")
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "ord"))).over(doc.orderBy("ord").rowsBetween(0, window - 1))
    rows = rows.withColumn("least", least)
    # chosen by one of the windows over it
    picked = F.array_contains(F.collect_list("least.ord").over(doc.orderBy("ord").rowsBetween(1 - window, 0)), F.col("ord"))
    return rows.withColumn("picked", F.col("gram").isNotNull() & (picked | (F.col("words") >= min_words))).drop("least", "words")


def removed_spans(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, s, e) of the runs of lines that go from docs(doc_id, th, text), apart from each other."""
    rows = written(grams(docs, min_words, window), "grams")
    picked = rows.where("picked").select(*KEY, "ord", "gram")
    shared = written(picked.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"), "shared")
    seeds = picked.join(small_side(shared), "gram", "left_semi").select(*KEY, "ord", F.lit(True).alias("seed"))
    # extend: which lines lie beside a seed. Seeds go among the lines, so that one shuffle serves.
    names = ("at", "gram", "last", "bgram", "first")
    marked = rows.select(*KEY, "ord", *names, F.lit(False).alias("seed")).unionByName(seeds, allowMissingColumns=True)
    near = Window.partitionBy(*KEY).orderBy("ord")
    marked = marked.withColumn("on", F.max("seed").over(near.rangeBetween(1 - window, window - 1))).withColumn("back", F.max("seed").over(near.rangeBetween(-min_words - window, 0)))
    here = F.struct("ord", "at")
    spans = marked.where("not seed and (on or back)").select(*KEY, F.explode(F.array(F.when(F.col("on") & F.col("gram").isNotNull(), F.struct(F.col("gram").alias("c"), here.alias("s"), F.col("last").alias("e"))), F.when(F.col("back") & F.col("bgram").isNotNull(), F.struct(F.col("bgram").alias("c"), F.col("first").alias("s"), here.alias("e"))))).alias("x"))
    spans = written(spans.where("x is not null").select(*KEY, "x.c", F.col("x.s.ord").alias("so"), F.col("x.s.at").alias("sa"), F.col("x.e.ord").alias("eo"), F.col("x.e.at").alias("ea")), "spans")
    # the first place of each content; a span found as a gram and as a back gram is one place
    first = spans.groupBy("c").agg(F.min(F.struct(*KEY, "so")).alias("f"), F.max(F.struct(*KEY, "so")).alias("l")).where("f <> l").select(F.col("c"), "f")
    later = spans.join(small_side(written(first, "first")), "c").where(F.struct(*KEY, "so") != F.col("f"))
    # spans that touch are one run
    order = Window.partitionBy(*KEY).orderBy("so", "eo")
    later = later.select(*KEY, "so", "sa", "eo", "ea").withColumn("reach", F.max("eo").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("run", F.sum(F.when(F.col("so") <= F.col("reach") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy(*KEY, "run").agg(F.min("sa").alias("s"), F.max("ea").alias("e")).select(*KEY, "s", "e")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """docs with all its columns, later repeated runs deleted from text; plus n_lines and n_removed (long), which replace columns of these names."""
    own = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    gone = removed_spans(own.where("doc_id is not null and text is not null"), min_words, window)
    spans = written(gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).agg(F.sort_array(F.collect_list("s")).alias("starts"), F.sort_array(F.collect_list("e")).alias("ends")), "gone")
    names = docs.columns
    lower = [c.lower() for c in names]
    at, key = (names.index(n) if n in names else lower.index(n) for n in ("text", "doc_id"))
    flat = docs.toDF(*[f"c{i}__" for i in range(len(names))]).withColumn("text", F.col(f"c{at}__").cast("string"))
    joined = flat.join(small_side(spans), (F.col(f"c{key}__").cast("long") == F.col("gone_id")) & (text_key(F.col("text")) == F.col("gone_th")), "left")
    joined = joined.withColumn("lines", F.split("text", "\n", -1))
    # what lies before, between and after the runs, in one pass however many there are
    after = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(-1)) + 1
    left = F.transform(F.sequence(F.lit(0), F.size("ends")), lambda i: F.slice("lines", after(i) + 1, F.coalesce(F.get("starts", i), F.size("lines")) - after(i)))
    new = F.when(F.col("ends").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(left), "\n"))
    removed = F.coalesce(F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s + 1), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    n = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    cols = [(new if i == at else F.col(f"c{i}__")).alias(c) for i, c in enumerate(names) if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*cols, n.alias("n_lines"), removed.alias("n_removed"))

"""Quality rules by line-first cleaning, in DataFrame functions only.

Each line with a word is judged by three rules: punctuation (marks that outweigh its words), navigation (short
entries between separators) and boilerplate (fixed phrases of licences, notices and page furniture, one for each
NOTICE_CHARS characters of the line, so that long prose may mention one). Failing lines are removed; a document that loses too much of its text with them is rejected, as is one that fails the
base rules (too few words, or too many of them in windows of words that repeat). Everything is computed within
the document's row: no shuffle, and memory in proportion to the longest text.

Defined results: null text has no words and fails; an empty table gives no row; repeated rows are judged each;
a null doc_id stays null.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, pick

SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>!?]"
SEPARATORS = r"[|>»·•]"
#: Fixed phrases, lower case.
BOILERPLATE = ("licensed under", "all rights reserved", "copyright", "terms of use", "terms of service", "privacy policy", "cookie", "click here", "subscribe", "sign up", "log in", "login", "lorem ipsum", "enable javascript", "skip to content", "skip to main content", "powered by")
#: A line has one of them for so many characters, begun ones too, or is prose that mentions them.
NOTICE_CHARS = 300
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: A line fails the punctuation rule with so many marks at least, and over so many a hundred words.
MIN_MARKS, MARK_PERCENT = 3, 30
#: A line is navigation with so many separators at least and at most so many words an entry.
MIN_SEPARATORS, ENTRY_WORDS = 3, 5
#: A document that loses more of its word characters is rejected.
LOST_PERCENT = 50


def _hits(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")


def _keep(df: DataFrame, *cols: Column) -> DataFrame:
    """Like select, but what is above refers to its values and never computes them again, row by row or in a lambda."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def line_fails(line: Column) -> Column:
    words = F.size(_words(line))
    marks, separators = _hits(line, MARKS), _hits(line, SEPARATORS)
    punctuation = (marks >= MIN_MARKS) & (marks * 100 > words * MARK_PERCENT)
    navigation = (separators >= MIN_SEPARATORS) & (words <= (separators + 1) * ENTRY_WORDS)
    need = F.ceil(F.length(line) / NOTICE_CHARS)
    # one array element, so that the line is lower-cased once and not once a phrase; phrases are counted only where one is not enough
    some = lambda low: reduce(operator.or_, [low.contains(p) for p in BOILERPLATE])
    count = lambda low: reduce(operator.add, [low.contains(p).cast("int") for p in BOILERPLATE])
    boilerplate = F.exists(F.array(F.lower(line)), lambda low: some(low) & ((need <= 1) | (count(low) >= need)))
    return punctuation | navigation | boilerplate


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): the counts, base_failed, n_failed_lines, lost_chars, kept and text, the cleaned text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.length(F.regexp_replace(x, f"^{SPACE}+", "")) > 0)
    df = _keep(df, F.col("doc_id"), F.col("text"), _words(F.col("text")).alias("w"), lines.alias("lines"))

    n = F.size("w")
    hashes = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    none = F.array().cast("array<bigint>")
    df = _keep(
        df, F.col("doc_id"), F.col("text"), n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.when(F.col("text").rlike(SYMBOLS), _hits(F.col("text"), SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("lines", line_fails).alias("failed"),
        F.when(n > WINDOW, hashes).otherwise(none).alias("h"),
    )
    # windows found twice or more: neighbours in order of their hash
    order = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("h")) < F.size("h")
    df = _keep(df, *[F.col(c) for c in df.columns if c != "h"], F.when(some, order).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("s"))
    twice = F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    lost = F.length(F.array_join(_words(F.array_join("failed", "\n")), ""))
    df = _keep(df, *[F.col(c) for c in df.columns if c not in ("s", "failed")], F.when(F.size("s") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"), F.size("failed").cast("long").alias("n_failed_lines"), F.when(F.size("failed") > 0, lost).otherwise(0).cast("long").alias("lost_chars"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    df = df.withColumn("text", F.when(F.col("n_failed_lines") > 0, cleaned(F.col("text"))).otherwise(F.col("text")))
    return df.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * LOST_PERCENT))


def cleaned(text: Column) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x)), "\n")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, len(list_filter(string_split_regex(line, '{SPACE}+'), lambda x: x <> '')) AS n,
              len(regexp_extract_all(line, '{MARKS}')) AS marks, len(regexp_extract_all(line, '{SEPARATORS}')) AS seps,
              length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars FROM l),
lf AS (SELECT *, (marks >= {MIN_MARKS} AND marks * 100 > n * {MARK_PERCENT}) OR (seps >= {MIN_SEPARATORS} AND n <= (seps + 1) * {ENTRY_WORDS})
              OR ({' OR '.join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)}) AND ({' + '.join(f"contains(lower(line), '{p}')::INT" for p in BOILERPLATE)}) * {NOTICE_CHARS} >= length(line) AS fails FROM lw WHERE n > 0),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines,
                 coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost_chars FROM lf GROUP BY r),
a AS (SELECT r, list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, len(w) AS n, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, w FROM a WHERE len(w) > {WINDOW}),
gi AS (SELECT r, i, list_aggregate(w[i:i + {WINDOW} - 1], 'string_agg', chr(10)) AS s FROM g),
tw AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM gi) WHERE c > 1),
cov AS (SELECT r, sum(least({WINDOW}, coalesce(i - before, {WINDOW})))::BIGINT AS n_repeat_words
        FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM tw) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
             len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
      FROM d JOIN a USING (r) LEFT JOIN lines USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT} AS base_failed FROM m)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * {LOST_PERCENT} AS kept FROM b
"""

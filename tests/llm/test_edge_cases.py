"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from loomgraph.llm import langid, quality_cnn, quality_rules, toxicity  # noqa: E402
from loomgraph.llm.grace_dedup import exact_dedup  # noqa: E402
from loomgraph.llm.lattice_lm import lattice_lm  # noqa: E402
from loomgraph.llm.line_dedup import line_dedup  # noqa: E402
from loomgraph.llm.minmax import near_dedup  # noqa: E402
from loomgraph.llm.mixing import mix  # noqa: E402
from loomgraph.llm.packing import pack  # noqa: E402

LONG = " ".join(f"word{i % 977} and, so" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "Plain words of a text that is long enough to be one, more or less.\n" + PASSAGE, "en", "a"),
    (1, "Plain words of a text that is long enough to be one, more or less.\n" + PASSAGE, "en", "a"),
    (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "de", "b"), (5, LONG, "en", "a"), (6, "x" * 100_000, "en", "c"), (7, "Einige Wörter, für den Fall.", "de", None), (8, "123 456!", "de", "b"),
    (9, "another beginning\n" + PASSAGE, "en", "a"), (None, "no id at all", "en", "a"), (None, None, None, None), (10, "einige WÖRTER, für den fall.", "de", "b"), (11, "EINIGE Wörter, für den Fall.", None, "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, None) for r in ROWS], SCHEMA)
    for name in ("n", "h", "rep", "key", "block", "epoch", "n_lines", "lines", "score", "word", "TEXT2", "kept"):
        df = df.withColumn(name, F.lit("own"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, None), (6, 0, 1), (7, None, 1), (9, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "grace": lambda d, x: exact_dedup(d),
    "lattice": lambda d, x: lattice_lm(d),
    "lines": lambda d, x: line_dedup(d),
    "near": lambda d, x: near_dedup(d),
    "mix": lambda d, x: mix(d, max_repeats=2.0),
    "pack": lambda d, x: pack(d),
    "rules": lambda d, x: quality_rules.quality_rules(d),
    "toxicity": lambda d, x: toxicity.score(d, toxicity.fit(d, x)),
    "quality": lambda d, x: quality_cnn.score(d, quality_cnn.fit(d, x)),
    "langid": lambda d, x: langid.predict(d, langid.fit(d)),
}
ONE_A_ROW = ("grace", "lattice", "lines", "near", "rules", "toxicity", "quality", "langid")


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(docs, labels, name):
    out = OPERATORS[name](docs, labels).collect()
    assert len(out) == len(ROWS) if name in ONE_A_ROW else len(out) >= len(ROWS)


def test_failing_lines_are_removed(spark):
    prose = "Ten plain words of a text that nobody would take away."
    rows = [(1, f"Home | News | Sport | About\n{prose}\n\n  {prose.upper()}\nAll rights reserved"), (2, f"{prose}\n### $$$ !!!"), (3, f" {prose}\n"), (4, "Log in")]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].text for i in (1, 2, 3, 4)] == [f"{prose}\n\n  {prose.upper()}", prose, f" {prose}\n", ""]
    assert [(out[i].n_failed_lines, out[i].kept) for i in (1, 2, 3, 4)] == [(2, True), (1, True), (0, True), (1, False)]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.where("false"), labels.where("false")).count() == 0


@pytest.mark.parametrize("name", list(OPERATORS))
def test_all_null(spark, labels, name):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert OPERATORS[name](docs, labels).count() == 3


def test_results_of_odd_rows(docs, labels):
    kept = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()]
    assert sorted(x for x in kept if x[0] == 1) == [(1, 1, 2, False), (1, 1, 2, True)]
    # Ö is not A-Z, so 10 stands alone; 7 and 11 are equal
    assert {x for x in kept if x[0] in (7, 10, 11)} == {(7, 11, 2, False), (10, 10, 1, True), (11, 11, 2, True)}
    near = {r.doc_id: r for r in near_dedup(docs).collect()}
    assert near[3].n_shingles == near[4].n_shingles == 0 and near[3].kept and near[4].component_id == 4
    assert near[None].kept and near[None].component_id is None
    lang = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [lang[i].lang_pred for i in (2, 3, 4, 8)] == ["und"] * 4
    lines = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert lines[9].text == "another beginning" and lines[9].n_removed == 1 and lines[1].n_removed == 0 and lines[2].text is None
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[2].base_failed and not rules[2].kept and rules[1].kept


def test_pipeline_on_odd_rows(spark, docs, labels, tmp_path):
    labels.withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= {3, 5, 6}
    got = plain
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == plain.columns


def test_filters_go_by_row(spark):
    """Rows that share a doc_id are judged by their own texts; of repeated rows and of near copies one stays."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, base), (1, "other " + " ".join(f"v{i}" for i in range(60))), (2, base + " more"), (3, "plain " + " ".join(f"u{i}" for i in range(50))), (3, "plain " + " ".join(f"u{i}" for i in range(50))), (None, base), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "a", None) for r in rows], SCHEMA)
    left = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert left == sorted([(0, base), (1, base), (1, rows[1][1]), (3, rows[3][1]), (4, ""), (5, "")])
    model = toxicity.dictionaries([b"vermin horrid vermin"] * 9, [b"kind words here"] * 9)
    toxicity.calibrated(model, [model.features(t) for t in [b"horrid vermin"] * 5 + [b"kind words"] * 5], [True] * 5 + [False] * 5)
    some = spark.createDataFrame([(1, "horrid vermin horrid"), (1, "kind words here"), (2, None)], "doc_id long, text string").withColumn("TEXT2", F.lit(1))
    out = toxicity.drop(some, model)
    assert out.columns == some.columns and sorted(r.text or "" for r in out.collect()) == ["", "kind words here"]

"""Pipeline stages on odd rows: nulls, empty and long texts, repeats, clashing and dotted names."""

import corpus_pipeline

TEXT = "alpha beta gamma delta epsilon zeta\none two three four five six seven\nred green blue yellow black white"
LONG = "x " * 50_000
ROWS = [
    (1, TEXT, "en", "a", len(TEXT)), (None, TEXT, "en", "a", 1), (2, None, "en", None, None), (3, "", None, "b", 0),
    (4, "½", "en", "a", 1), (5, TEXT + "\nmore of it here", "en", "b", 9), (6, LONG, "en", "a", 1), (6, LONG, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_any_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr(
        "*", "7 AS n_lines", "'q' AS `a.b`", "1 AS _k", "2 AS score", "3 AS `group`"
    )
    extra = docs.columns[5:]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, ""))
        assert docs.columns == before.columns, name
        rows = docs.collect()
        assert {tuple(r[c] for c in extra) for r in rows} == {(7, "q", 1, 2, 3)}, name
        found = sorted((str(r.doc_id), r.text[:5]) for r in rows)
        if name == "language_id":
            assert [f[0] for f in found] == ["1", "5", "6", "6", "None"]
        if name == "line_dedup":  # the null id comes first and keeps the shared lines
            assert found == [("5", "more "), ("6", "x x x"), ("6", "x x x"), ("None", "alpha")]
            assert {r.text: r.n_chars for r in rows}["more of it here"] == 15
        if name == "near_dedup":
            assert found == [("5", "more "), ("6", "x x x"), ("None", "alpha")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0

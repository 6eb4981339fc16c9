import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Names that operators use for columns of their own.
CLASH = ("component_id", "_k", "_h", "rank", "place", "size", "taken", "shard", "node", "lines")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or (id, text[, lang, source]) rows, with extra clashing columns."""

    def make(rows, clash=True):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            ident, text, lang, source = (*row, "en", "a")[:4] if len(row) == 2 else (*row, None, None)[:4]
            full.append((ident, text, lang, source, None if text is None else len(text)))
        frame = spark.createDataFrame(full, DOC)
        if clash:
            for name in CLASH:
                frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame

    return make


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]

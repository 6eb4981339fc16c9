"""Registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from pyrogrid.llm.queries import ORACLE_SQL, QUERIES


def normal(rows):
    return sorted(repr([None if x != x else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    base = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = base.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert normal(found.select(*names).collect()) == normal(want.fetchall())


def test_all_are_registered():
    numbers = sorted(int(n.split("_")[0][2:]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)
    assert mixed.schema == docs.schema and 0 < mixed.count()
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0

"""A training corpus from raw documents: each stage is one operator of ``pyrogrid.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm import langid, line_dedup, minhash, mixing, packing
from pyrogrid.llm.common import table
from pyrogrid.session import materialise


def names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


# Every stage keeps repeated rows' and extra columns' values under any name, and gives no rows for an
# empty table; what it does with nulls, empty and very long texts and ties stands in its docstring.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts, texts without a letter and undecided ones go.

    Whole texts are scored, of equal scores the first language by name; rows of one id or text are
    decided each on its own text.
    """
    return langid.keep_identified(docs, langid.fit(docs)).select(names(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that an earlier document holds; emptied ones go.

    Null and empty texts stay as they are, ``n_chars`` follows the text.  Documents are in order of
    their id, null ids first; rows of one id and text are one document and keep their lines alike.
    """
    row = F.struct(*names(docs)).alias("_row")
    left = line_dedup.line_dedup(docs.select("doc_id", "text", row))
    left = left.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[made.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8).

    The smallest id stays, null first, of equal ids the smallest hash; texts without words are no
    duplicates of each other, but repeated rows of an id are one.
    """
    return minhash.near_dedup(docs).select(names(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null and empty texts have no size."""
    return mixing.mixed(docs).select(names(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents of the mix; a null text is an empty one."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", packed),
]

# Model scores, signatures and tokenisers are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

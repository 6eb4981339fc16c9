"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pyrogrid.llm.common import table

ORDERS = (1, 2, 3, 4)
BITS = 16
SPAN = 1 << 18
UNDETERMINED = "und"


def buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF))
    for i in range(order):
        h = (h ^ codes[i : i + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def stretches(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text, overlapping by the longest n-gram but one."""
    step = SPAN
    for at in range(0, max(1, len(text)), step):
        part = text[at : at + step + ORDERS[-1] - 1].lower()
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the text; those of an overlap are counted once."""
    for codes in stretches(text):
        last = len(codes) <= SPAN
        for order in ORDERS:
            own = buckets(codes, order)
            yield own if last else own[: len(codes) - ORDERS[-1] + 1]


@dataclass(frozen=True)
class Model:
    """Log probabilities, one row per bucket and one column per language."""

    languages: tuple[str, ...]
    prior: np.ndarray
    log_prob: np.ndarray

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        total = self.prior.copy()
        for own in grams(text):
            total += self.log_prob[:, own].sum(axis=1, dtype=np.float64)
        best = int(total.argmax())
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def learnable() -> F.Column:
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    return (rest != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def fit(docs: DataFrame, per_language: int = 4000) -> Model:
    """Fit on about ``per_language`` labelled texts of each language, chosen by a hash of the id.

    The bound covers the fit alone: what is predicted, and the label counts, are all rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(learnable())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    size = 1 << BITS
    if not languages:
        return Model((), np.zeros(0), np.zeros((0, size), np.float32))
    share = F.create_map(*[
        F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))
    ])
    unit = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = {k: i for i, k in enumerate(languages)}

    def count(batches):
        import pyarrow as pa

        seen = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                row = seen[place[lang.as_py()]]
                for own in grams(text.as_py()):
                    row += np.bincount(own, minlength=size)
        which, bucket = seen.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int64()), pa.array(bucket, pa.int64()), pa.array(seen[which, bucket])],
            ["which", "bucket", "n"],
        )

    counted = (
        rows.where(unit < F.element_at(share, F.col("lang")))
        .select("text", "lang")
        .mapInArrow(count, "which long, bucket long, n long")
        .groupBy("which", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most languages x buckets rows
    )
    total = np.ones((len(languages), size))
    total[counted["which"], counted["bucket"]] += counted["n"]
    prior = np.log(np.array([sizes[k] for k in languages], float))
    log_prob = np.log(total) - np.log(total.sum(axis=1, keepdims=True))
    return Model(languages, prior - np.logaddexp.reduce(prior), log_prob.astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (its posterior) from the text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language
    was learned.  Whole texts are scored, very long ones in overlapping stretches; repeated rows
    and null ids are kept; an empty table gives no rows.  Columns of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x buckets floats
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [shared.value.score(t.as_py()) for t in batch.column(at)]
            arrays = [
                *batch.columns,
                pa.array([x for x, _ in out], pa.string()),
                pa.array([x for _, x in out], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(
                arrays, [*batch.schema.names, "lang_pred", "score"]
            )

    return docs.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows whose language is found with a posterior of ``least`` or more, columns unchanged."""
    named = identify(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text"), model)
    kept = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    return named.where(kept).select("row.*")

"""Vector code compression: product codes whose codebooks are fitted by ball k-means."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.functions.ordered import attach_by_value
from pyrogrid.llm.blocks import finite
from pyrogrid.llm.common import table
from pyrogrid.session import discard, materialise

SCALE = 1024
EXACT = 2**53
ANNULI = 4


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Columns of each part; equal where the length can be divided."""
    return [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries: whole numbers below 2**53, so exact."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)


class Balls:
    """One part's codebook with what ball k-means knows of it: the gaps between its entries.

    ``ranked[i]`` lists the other entries by their gap from entry ``i``, ``gaps[i]`` those squared
    gaps, ascending.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k = len(entries)
        gaps = squared(entries, entries)
        gaps[np.arange(k), np.arange(k)] = -1  # an entry is first in its own list
        self.ranked = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.ranked, axis=1)
        self.compared = self.stable = 0

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Index of the nearest entry by comparison with all: there is no earlier entry yet."""
        step = max(1, (1 << 22) // max(len(self.entries), 1))
        found = [squared(x[s : s + step], self.entries).argmin(axis=1) for s in range(0, len(x), step)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def moved(self, x: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Index of the nearest entry of each row, given the entry it belonged to.

        The rows of an entry form a ball around it.  Another entry can be as near to a row as its
        own only if their gap is at most twice the row's distance.  So entries beyond twice the
        ball's radius are no neighbours; rows within half the gap to the nearest neighbour are
        its stable core and stay; and the half gaps to the neighbours cut the rest into rings,
        whose rows meet only the neighbours inside.
        """
        own = ((x - self.entries[old]) ** 2).sum(axis=1)
        new = old.copy()
        order = np.lexsort((own, old))
        starts = np.flatnonzero(np.diff(old[order], prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            rows = order[lo:hi]
            i = old[rows[0]]
            radius = own[rows[-1]]
            neighbours = self.gaps[i, : np.searchsorted(self.gaps[i], 4 * radius, side="right")]
            ring = np.searchsorted(neighbours, 4 * own[rows], side="right")
            core = np.searchsorted(ring, 0, side="right")
            self.stable += core
            # Rows are in order of distance, so rings widen; a few annuli share their candidates.
            cuts = np.linspace(core, len(rows), ANNULI + 1).astype(np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                some = rows[a:b]
                near = np.sort(np.append(self.ranked[i, : ring[b - 1]], i))
                distance = squared(x[some], self.entries[near])
                self.compared += distance.size
                new[some] = near[distance.argmin(axis=1)]  # the first of equals has the lower index
        return new

    def distances(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return ((x - self.entries[codes]) ** 2).sum(axis=1)


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow column of lists of equal length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _codes(column, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


STATE = "vec_id long, label string, vector array<int>, code binary"


def assigned(state: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """The rows with the code of their nearest entries; a null code has no entry to start from."""
    spans = bounds(dim, len(books))

    def run(batches):
        import pyarrow as pa

        balls = [Balls(book) for book in books]
        for batch in batches:
            x = matrix(batch.column(2), dim)
            first = batch.column(3).null_count > 0
            old = None if first else _codes(batch.column(3), len(books)).astype(np.int64)
            new = np.empty((len(x), len(books)), np.uint8)
            for p, (lo, hi) in enumerate(spans):
                part = x[:, lo:hi]
                new[:, p] = balls[p].nearest(part) if first else balls[p].moved(part, old[:, p])
            code = pa.array([row.tobytes() for row in new], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], code], batch.schema.names)

    return state.mapInArrow(run, STATE)


def replaced(state: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Codebooks of the rounded-down means of each entry's rows; an unused entry stays.

    Tasks add up their rows, so a task sends one row per entry and component; what reaches the
    driver is one codebook, whatever the number of rows.
    """
    spans = bounds(dim, len(books))
    size = len(books[0])

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((size, dim), np.int64)
        counts = np.zeros((size, len(books)), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dim)
            codes = _codes(batch.column(1), len(books))
            for p, (lo, hi) in enumerate(spans):
                counts[:, p] += np.bincount(codes[:, p], minlength=size)
                for at in range(lo, hi):
                    sums[:, at] += np.bincount(codes[:, p], x[:, at], size).astype(np.int64)
        for block, table_ in ((0, counts), (1, sums)):
            entry, at = np.nonzero(table_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), block)), pa.array(entry), pa.array(at), pa.array(table_[entry, at])],
                ["block", "entry", "at", "value"],
            )

    partial = state.select("vector", "code").mapInArrow(run, "block long, entry long, at long, value long")
    totals = [np.zeros((size, len(books)), np.int64), np.zeros((size, dim), np.int64)]
    for block, entry, at, value in partial.groupBy("block", "entry", "at").agg(F.sum("value")).collect():
        totals[block][entry, at] = value
    counts, sums = totals
    found = []
    for p, (lo, hi) in enumerate(spans):
        used = counts[:, p] > 0
        book = books[p].copy()
        book[used] = sums[used, lo:hi] // counts[used, p][:, None]
        found.append(book)
    return found


def with_errors(state: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """``vec_id, label, code, error``: the squared distance of each row to its code."""
    spans = bounds(dim, len(books))

    def run(batches):
        import pyarrow as pa

        balls = [Balls(book) for book in books]
        for batch in batches:
            x = matrix(batch.column(2), dim)
            codes = _codes(batch.column(3), len(books))
            error = np.zeros(len(x))
            for p, (lo, hi) in enumerate(spans):
                error += balls[p].distances(x[:, lo:hi], codes[:, p])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(error.astype(np.int64))],
                ["vec_id", "label", "code", "error"],
            )

    return state.mapInArrow(run, "vec_id long, label string, code binary, error long")


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the codebooks that decode them.

    The frame holds ``vec_id, label, code, error``: the code's bytes are entry numbers, one for
    each part.  Vectors are whole numbers, ``floor(1024 * x)``.  Codebooks start as the parts of the
    ``entries`` smallest ids and go through ``rounds`` of assignment and replacement; each
    assignment after the first is one of ball k-means, so it skips rows that cannot change and
    compares others with the entries of their ring.  Rows carry their code from round to round in a
    written table, which replaces the table before.

    Vectors that are null, or hold null or non-finite components, are left out.  Vectors of another
    length than most (of equal shares the longer) have a null code and error.  Null ids come
    first in the starting order, equal ids by their vectors; repeated rows count each; with
    fewer rows than ``entries`` the codebooks are smaller; an empty table gives no rows; further columns are
    ignored.  Components so large that squared distances exceed 2**53 raise ``ValueError``.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code byte holds 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).where(finite("vector"))
    highest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x) * SCALE + 1)))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), highest.alias("most"))
    found = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        empty = spark.createDataFrame([], "vec_id long, label string, code binary, error long")
        return empty, [np.zeros((0, 0)) for _ in range(parts)]
    dim, most = found["dim"], found["most"] or 0.0
    if (2 * most) ** 2 * max(dim, 1) >= EXACT:
        raise ValueError(f"components up to {most / SCALE:g} give squared distances beyond 2**53")
    whole = F.transform("vector", lambda x: F.floor(x * SCALE).cast("int")).alias("vector")
    fitting = rows.where(F.size("vector") == dim).select("vec_id", "label", whole)
    state = materialise(fitting.withColumn("code", F.lit(None).cast("binary")), "codes")
    start = state.orderBy(F.asc_nulls_first("vec_id"), "vector").limit(entries).collect()
    start = np.array([r["vector"] for r in start], np.float64).reshape(len(start), dim)
    books = [start[:, lo:hi] for lo, hi in bounds(dim, parts)]
    for turn in range(rounds + 1):
        after = materialise(assigned(state, books, dim), "codes")
        discard(state)
        state = after
        if turn < rounds:
            books = replaced(state, books, dim)
    others = rows.where(F.size("vector") != dim).select(
        "vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")
    )
    coded = materialise(with_errors(state, books, dim).union(others), "coded")
    discard(state)
    return coded, books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    numbers = ",".join(str(int(x)) for book in books for x in book.ravel())
    key = F.when(F.col("label").isNotNull(), F.concat(F.lit("="), "label")).otherwise("")
    keyed = coded.withColumn("key", key)
    sums = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = sums.withColumn("total", F.lit(coded.count()))
    return attach_by_value(keyed, sums, "key", "n", "total").select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _op11_sql(rounds: int = 4) -> str:
    """The rounds written out: each one's nearest entries ``a`` and replaced entries ``b``."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, p.x,
         min((p.xx - 2 * list_inner_product(p.x, b.x) + b.xx)::BIGINT * 256 + b.entry) AS best
  FROM parts p JOIN b{r} b USING (part) GROUP BY ALL)"""
    replaced_ = """
s{r} AS (
  SELECT part, best % 256 AS entry, place, floor(sum(v)::DOUBLE / count(*)) AS v
  FROM (SELECT part, best, unnest(x) AS v, unnest(range(len(x))) AS place FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT part, entry, list(v ORDER BY place) AS x FROM s{r} GROUP BY ALL),
b{n} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, b.x) AS x,
         list_inner_product(coalesce(m.x, b.x), coalesce(m.x, b.x)) AS xx
  FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"""
    steps = [nearest.format(r=0)]
    for r in range(rounds):
        steps += [replaced_.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT vec_id, label, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS x
  FROM v, (SELECT unnest(range(4)) AS part)),
parts AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM cut),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x, xx
  FROM parts WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),
{",".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code,
         sum(best // 256)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id, label),
book AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) AS sha
  FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       sha AS codebooks_sha256
FROM coded, book
"""


OP11_SQL = _op11_sql()

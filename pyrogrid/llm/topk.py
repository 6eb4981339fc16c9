"""Exact inner-product search with multi-resolution segment bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pyrogrid.llm.blocks import NO_ID, finite, pack_blocks, unpack
from pyrogrid.llm.common import shard_count, table
from pyrogrid.session import materialise

LEVELS = (1, 4, 16)


def whole(matrix: np.ndarray) -> np.ndarray:
    """Components scaled by 64 and rounded down; whole numbers held as doubles."""
    return np.floor(matrix * 64.0)


def segments(matrix: np.ndarray, m: int) -> np.ndarray:
    """Per segment: mean times root length, and the norm of the deviations from the mean.

    The inner product of two such rows is never below that of the vectors themselves, which is the
    same as a lower bound for their distance when norms are given.
    """
    parts = [p for p in np.array_split(np.arange(matrix.shape[1]), m) if len(p)]
    means = [matrix[:, p].mean(axis=1) for p in parts]
    spread = [
        np.sqrt(((matrix[:, p] - mu[:, None]) ** 2).sum(axis=1))
        for p, mu in zip(parts, means, strict=True)
    ]
    scaled = [mu * np.sqrt(len(p)) for p, mu in zip(parts, means, strict=True)]
    return np.array(scaled + spread).T.reshape(len(matrix), -1)


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all pairs; doubles while they hold every sum exactly."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    if not bound < 2**63:
        raise OverflowError("scores of these vectors exceed 64 bits")
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def search(q_ids, queries, floors, ids, rows, k: int):
    """(query, row, score) of each query's best ``k`` rows here that reach its floor."""
    alive = q_ids[:, None] != ids[None, :]
    for m in LEVELS:
        some_q, some_r = alive.any(axis=1), alive.any(axis=0)
        if not some_q.any():
            return [np.zeros(0, np.int64)] * 3
        bound = segments(queries[some_q], m) @ segments(rows[some_r], m).T
        slack = 1e-9 * (np.abs(bound).max() + 1)
        alive[np.ix_(some_q, some_r)] &= bound + slack >= floors[some_q][:, None]
    some_q, some_r = alive.any(axis=1), alive.any(axis=0)
    alive = alive[np.ix_(some_q, some_r)]
    score = exact(queries[some_q], rows[some_r])
    which, where = np.nonzero(alive & (score >= floors[some_q][:, None]))
    value, row = score[which, where], ids[some_r][where]
    order = np.lexsort((row, -value, which))
    which, value, row = which[order], value[order], row[order]
    first = np.searchsorted(which, which)
    keep = np.arange(len(which)) - first < k
    return q_ids[some_q][which[keep]], row[keep], value[keep]


def top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    query_rows: int = 512,
    block_rows: int = 2048,
    sample_rows: int = 2000,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest whole inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those of
    the query's id.  Blocks of queries meet blocks of rows.  A broadcast sample of about
    ``sample_rows`` rows gives each query a floor that its k-th best score cannot fall below;
    bounds from 1, 4 and 16 segments rule pairs out before exact scores are computed.

    Vectors that are null, or hold null or non-finite components, take no part, nor do two vectors
    of different length meet.  Vectors whose scores could exceed 64 bits raise an error.  Ties go to the smaller id, null ids first; repeated rows are
    candidates of their own and queries once, with the smallest vector of their id; an empty table gives no rows; further columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = materialise(
        vectors.select(
            F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )
        .where(finite("vector"))
        .withColumn("dim", F.size("vector").cast("long")),
        "vectors",
    )
    n = rows.count()
    n_blocks = shard_count(n, block_rows)
    asks = rows.where((F.col("id") % every == 0) & (F.col("id") != NO_ID))
    asks = asks.groupBy("id", "dim").agg(F.min("vector").alias("vector"))
    n_asks = shard_count(shard_count(n, every), query_rows)
    share = min(1.0, sample_rows / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).toPandas()
    samples = {
        int(dim): (part["id"].to_numpy(), whole(np.array(part["vector"].tolist()).reshape(len(part), -1)))
        for dim, part in chosen.groupby("dim")
    }
    shared = spark.sparkContext.broadcast(samples)
    blocks = pack_blocks(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), ["dim", "block"])
    queries = pack_blocks(asks.withColumn("ask", F.pmod(F.xxhash64("id"), F.lit(n_asks))), ["dim", "ask"])

    def set_floors(batches):
        import pyarrow as pa

        for batch in batches:
            floors = []
            for dim, ids, body in zip(*[batch.column(i).to_pylist() for i in (0, 3, 4)], strict=True):
                ids, matrix = unpack(ids, body)
                floor = np.full(len(ids), -np.inf)
                if dim in shared.value and len(shared.value[dim][0]) > k:
                    sample_ids, sample = shared.value[dim]
                    score = exact(whole(matrix), sample).astype(np.float64)
                    score[ids[:, None] == sample_ids[None, :]] = -np.inf
                    floor = np.partition(score, -k, axis=1)[:, -k]
                floors.append(floor.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(floors, pa.binary())], [*batch.schema.names, "floors"]
            )

    asked = queries.mapInArrow(
        set_floors, "dim long, ask long, n long, ids binary, vectors binary, floors binary"
    ).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "floors")
    met = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(
        blocks.withColumn("block", F.col("block").cast("int")), ["dim", "block"]
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for q_ids, q_vectors, floors, ids, body in zip(
                *[batch.column(i).to_pylist() for i in range(5)], strict=True
            ):
                q_ids, queries_ = unpack(q_ids, q_vectors)
                ids, matrix = unpack(ids, body)
                found = search(
                    q_ids, whole(queries_), np.frombuffer(floors, np.float64), ids, whole(matrix), k
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"]
                )

    best = met.select("q_ids", "q_vectors", "floors", "ids", "vectors").mapInArrow(
        run, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20
"""

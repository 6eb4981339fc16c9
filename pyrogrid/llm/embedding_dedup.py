"""Near-duplicate vectors of equal label by PCA-ordered tiled comparison."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm.blocks import NO_ID, finite, pack_blocks, unpack
from pyrogrid.llm.common import components, table
from pyrogrid.session import materialise

STEPS = (8, 16, 32)
GATHER = 1 << 15


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes of unit vectors, widest spread first."""
    _, axes = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))
    return axes[:, ::-1]


def unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # norms of huge values stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def linked_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, cosine: float, same: bool):
    """Index pairs with the cosine or more.

    Products of the leading axes are accumulated first; with the norms of the axes to come they
    bound the cosine, and pairs that cannot reach it any more are left.
    """
    a, b = unit(left), unit(right)
    x, y = a @ axes, b @ axes
    dims = x.shape[1]
    alive = np.ones((len(x), len(y)), bool)
    if same:
        alive = np.triu(alive, 1)
    product = np.zeros((len(x), len(y)))
    done = 0
    for stop in [s for s in STEPS if s < dims]:
        product += x[:, done:stop] @ y[:, done:stop].T
        rest = np.sqrt((x[:, stop:] ** 2).sum(axis=1))[:, None]
        rest = rest * np.sqrt((y[:, stop:] ** 2).sum(axis=1))[None, :]
        alive &= product + rest >= cosine - 1e-9
        done = stop
        if not alive.any():
            break
    i, j = np.nonzero(alive)
    near = [
        np.einsum("nd,nd->n", a[i[s : s + GATHER]], b[j[s : s + GATHER]]) >= cosine
        for s in range(0, len(i), GATHER)
    ]
    keep = np.concatenate(near) if near else np.zeros(0, bool)
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable within one tile pair, for each index."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return low


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, tile_rows: int = 1024, sample_rows: int = 10_000
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Equal vectors of a label are one class, so a third of all rows in one vector cost one
    comparison.  Classes are laid out by label and by the cells of their first two principal
    coordinates, as wide as two linked vectors can differ; cells are cut into hashed tiles of about
    ``tile_rows``, and tiles of equal or touching cells are compared.  Each tile pair sends link
    counts and a spanning forest of its links, not the links.  The axes are fitted on about
    ``sample_rows`` classes; being orthonormal they only order the work.

    Vectors that are null, zero, or hold null or non-finite components, or whose label is null,
    link with nothing; nor do vectors of different length.  Repeated rows are vectors of their own
    with equal ids; null ids sort first; an empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    apart = finite("vector") & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull()
    rows = rows.withColumn(
        "class", F.when(F.coalesce(apart, F.lit(False)), F.xxhash64("label", "vector"))
    )
    classes = materialise(
        rows.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"),
            F.min("id").alias("low"), F.count("*").alias("copies"),
        )
        .withColumn("dim", F.size("vector")),
        "classes",
    )
    n = classes.count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = classes.where(F.pmod(F.col("class"), F.lit(1 << 30)) < share * (1 << 30)).select("dim", "vector")
    axes = {
        int(dim): principal_axes(unit(np.array(part["vector"].tolist())))
        for dim, part in chosen.toPandas().groupby("dim")
        if len(part) > 1
    }
    shared = spark.sparkContext.broadcast(axes)
    width = math.sqrt(2 - 2 * cosine) + 1e-6

    def lay_out(batches):
        import pyarrow as pa

        for batch in batches:
            cells = []
            for vector in batch.column(1).to_pylist():
                y = unit(np.array([vector]))
                if len(vector) in shared.value:
                    y = y @ shared.value[len(vector)][:, :2]
                y = np.floor(np.append(y[0, :2], 0.0)[:2] / width)
                cells.append((int(y[0]), int(y[1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([c[i] for c in cells], pa.int64()) for i in (0, 1)]],
                ["class", "c1", "c2"],
            )

    placed = classes.select("class", "vector").mapInArrow(lay_out, "class long, c1 long, c2 long")
    placed = materialise(placed.join(classes, "class").drop("low"), "placed")
    cell = ["label", "dim", "c1", "c2"]
    counts = placed.groupBy(*cell).agg(F.ceil(F.count("*") / tile_rows).alias("parts"))
    tile = F.xxhash64(*cell, "part")
    tiles = counts.withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    ).withColumn("tile", tile)
    blocks = pack_blocks(
        placed.join(counts, cell)
        .withColumn("part", F.pmod(F.col("class"), F.col("parts")))
        .select(tile.alias("tile"), F.col("class").alias("id"), "vector", "copies"),
        ["tile"], ["copies"],
    )
    blocks = materialise(blocks, "tiles")
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    around = (
        tiles.withColumn("d1", F.explode(steps)).withColumn("d2", F.explode(steps))
        .select("label", "dim", (F.col("c1") + F.col("d1")).alias("c1"),
                (F.col("c2") + F.col("d2")).alias("c2"), F.col("tile").alias("one"))
    )
    pairs = around.join(tiles, cell).where("one <= tile").select("one", F.col("tile").alias("two"))
    met = pairs.join(blocks.select(
        F.col("tile").alias("one"), F.col("ids").alias("i1"), F.col("vectors").alias("v1"), F.col("copies").alias("n1")
    ), "one").join(blocks.select(
        F.col("tile").alias("two"), F.col("ids").alias("i2"), F.col("vectors").alias("v2"), F.col("copies").alias("n2")
    ), "two").select("one", "two", "i1", "v1", "n1", "i2", "v2", "n2")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for one, two, i1, v1, n1, i2, v2, n2 in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                (ids1, left), (ids2, right) = unpack(i1, v1), unpack(i2, v2)
                n1, n2 = np.frombuffer(n1, np.int64), np.frombuffer(n2, np.int64)
                turn = shared.value.get(left.shape[1], np.eye(left.shape[1]))
                i, j = linked_pairs(left, right, turn, cosine, one == two)
                shift = 0 if one == two else len(ids1)
                ids = ids1 if one == two else np.concatenate([ids1, ids2])
                count = np.zeros(len(ids), np.int64)
                np.add.at(count, i, n2[j])
                np.add.at(count, j + shift, n1[i])
                low = forest(i, j + shift, len(ids))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(ids[low[some]]), pa.array(count[some])],
                    ["a", "b", "n"],
                )

    found = materialise(met.mapInArrow(run, "a long, b long, n long"), "links")
    label = components(found.select("a", "b"))
    linked = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    parts = (
        classes.select("class", "low", "copies")
        .join(label.withColumnRenamed("node", "class"), "class", "left")
        .join(linked, "class", "left")
        .select("class", "low", "copies", "n", F.coalesce("component", "class").alias("group"))
    )
    lowest = parts.groupBy("group").agg(F.min("low").alias("component_id"))
    parts = parts.join(lowest, "group").select(
        "class", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    component = F.coalesce("component_id", "id")
    return rows.select("id", "class").join(parts, "class", "left").select(
        F.nullif("id", F.lit(NO_ID)).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y USING (label)
  WHERE x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN linked l ON l.a = r.other),
lowest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN counts USING (vec_id)
"""

"""Vectors packed into blocks of bounded size: one row with the ids and the matrix as bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(2**63)


def finite(vector: str) -> F.Column:
    """Not null, without null, NaN or infinite components."""
    inside = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(inside, F.lit(False))


def pack_blocks(rows: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per block of ``keys``: ``n, ids, vectors`` and the long columns ``extra`` as bytes.

    The caller chooses keys such that a block has about a thousand rows.
    """
    keys, extra = list(keys), list(extra)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        matrix = np.array(group["vector"].tolist(), np.float64).reshape(len(group), -1)
        row = {k: group[k].iloc[0] for k in keys}
        row |= {"n": len(group), "ids": group["id"].to_numpy(np.int64).tobytes()}
        row |= {"vectors": matrix.tobytes()}
        row |= {c: group[c].to_numpy(np.int64).tobytes() for c in extra}
        return pd.DataFrame([row])

    schema = ", ".join(
        [*[f"{k} long" for k in keys], "n long", "ids binary", "vectors binary"]
        + [f"{c} binary" for c in extra]
    )
    packed = rows.select(
        *[F.col(k).cast("long") for k in keys],
        F.col("id").cast("long"),
        F.col("vector").cast("array<double>").alias("vector"),
        *[F.col(c).cast("long") for c in extra],
    )
    return packed.groupBy(*keys).applyInPandas(run, schema)


def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.float64).reshape(len(ids), -1)

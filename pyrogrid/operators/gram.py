"""Least-squares refits from sufficient statistics.

The cross products of features, missing-value marks and target, added up for each *cell* of the
rows (a fold, a split, a stretch of dates), determine every least-squares fit on any union of
cells, any subset of the features and any value that stands in for missing ones.  So a whole
ablation or curve costs one scan for the cross products and one that scores all fits together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a cross-product matrix that are summed by one group.
BLOCK = 8
MEDIAN_ERROR = 0.001
SINGULAR = 1e-12


def _matrix(batch, first: int, count: int) -> np.ndarray:
    """Columns of an Arrow batch as doubles, missing ones NaN."""
    columns = [
        batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
        for i in range(first, first + count)
    ]
    return np.array(columns).T.reshape(batch.num_rows, count)


@dataclass(frozen=True)
class Fit:
    """Coefficients on ``features`` (positions), the values that stand in for missing ones."""

    features: tuple[int, ...]
    fill: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        part = x[:, self.features]
        return np.where(np.isnan(part), self.fill, part) @ self.coefficients + self.intercept


class Moments:
    """Cross products of (1, known features less a centre, missing marks, target) by cell."""

    def __init__(self, features: Sequence[str], centre: np.ndarray, cells: Mapping[object, np.ndarray]):
        self.features, self.centre, self.cells = tuple(features), centre, dict(cells)

    def total(self, cells: Sequence[object]) -> np.ndarray:
        """Cross products of a union of cells."""
        size = 2 * len(self.features) + 2
        return sum((self.cells[c] for c in cells if c in self.cells), np.zeros((size, size)))

    def solve(self, products: np.ndarray, features: Sequence[str], fill: Mapping[str, float]) -> Fit:
        """Least squares on some features; those without a known value are left out.

        Features that others determine share the coefficient of least norm.
        """
        d = len(self.features)
        n = products[0, 0]
        known = [i for i, f in enumerate(self.features) if f in set(features) and n - products[0, 1 + d + i] > 0.5]
        if n < 1 or not known:
            raise ValueError("no feature has any value in the training rows")
        values = np.array([fill[self.features[i]] for i in known])
        design = np.zeros((len(known) + 1, len(products)))
        design[0, 0] = 1
        for row, (i, value) in enumerate(zip(known, values, strict=True), 1):
            design[row, 1 + i] = 1
            design[row, 1 + d + i] = value - self.centre[i]
        gram = design @ products @ design.T
        cross = design @ products[:, -1]
        mean = gram[0, 1:] / n
        spread = gram[1:, 1:] - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(spread), 0))
        scale[scale <= 1e-9 * np.sqrt(np.maximum(np.diag(gram)[1:], 0))] = np.inf  # constant
        along = (cross[1:] - mean * cross[0]) / scale
        beta = np.linalg.lstsq(spread / np.outer(scale, scale), along, rcond=SINGULAR)[0] / scale
        intercept = cross[0] / n - (mean + self.centre[known]) @ beta
        return Fit(tuple(known), values, beta, float(intercept))


def medians(rows: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Medians as the imputer of the other fits takes them; 0 where nothing is known."""
    found = rows.approxQuantile(list(features), [0.5], MEDIAN_ERROR)
    return {f: (v[0] if v else 0.0) for f, v in zip(features, found, strict=True)}


def moments(
    rows: DataFrame, features: Sequence[str], target: str, cell: str, centre: Mapping[str, float]
) -> Moments:
    """Cross products of every cell from one scan.

    A task adds up its rows and sends the matrix of each cell it saw in blocks of rows, so what
    is shuffled and what reaches the driver depends on features and cells alone.  Rows without
    a target are left out; NaN counts as missing.
    """
    d = len(features)
    shift = np.array([centre[f] for f in features])

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            cells = np.array(batch.column(0).to_pylist(), object)
            y = _matrix(batch, 1, 1)
            x = _matrix(batch, 2, d)
            missing = np.isnan(x)
            z = np.concatenate([np.ones_like(y), np.where(missing, 0.0, x - shift), missing, y], axis=1)
            for c in set(cells.tolist()):
                mine = z[cells == c]
                sums[c] = sums.get(c, 0.0) + mine.T @ mine
        found = [
            (c, at, m[at : at + BLOCK].tobytes()) for c, m in sums.items() for at in range(0, len(m), BLOCK)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
             pa.array([f[2] for f in found], pa.binary())],
            ["cell", "at", "part"],
        )

    def add(key, group):
        import pandas as pd

        total = sum(np.frombuffer(p) for p in group["part"])
        return pd.DataFrame([(key[0], key[1], total.tobytes())], columns=["cell", "at", "part"])

    schema = "cell string, at long, part binary"
    parts = (
        rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")) & F.col(cell).isNotNull())
        .select(F.col(cell).cast("string"), F.col(target).cast("double"), *[F.col(f).cast("double") for f in features])
        .mapInArrow(run, schema)
        .groupBy("cell", "at")
        .applyInPandas(add, schema)
        .collect()
    )
    size = 2 * d + 2
    cells: dict = {}
    for c, at, part in parts:
        block = np.frombuffer(part).reshape(-1, size)
        cells.setdefault(c, np.zeros((size, size)))[at : at + len(block)] = block
    return Moments(features, shift, cells)


METRICS = "rmse double, mae double, r2 double, bias double"


def score_fits(
    rows: DataFrame, features: Sequence[str], target: str, cell: str, fits: Mapping[str, tuple[Fit, Sequence[str]]]
) -> DataFrame:
    """``fit, rmse, mae, r2, bias`` of every fit on its test cells, all in one scan.

    ``fits`` gives each fit and the cells it is tested on.  As in the other metrics, the share of
    variance is NaN below two rows or without variance.
    """
    names = sorted(fits)

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((len(names), 6))
        for batch in batches:
            cells = np.array(batch.column(0).to_pylist(), object)
            y = _matrix(batch, 1, 1)[:, 0]
            x = _matrix(batch, 2, len(features))
            for k, name in enumerate(names):
                fit, tested = fits[name]
                mine = np.isin(cells.astype(str), list(tested))
                if mine.any():
                    e = fit.predict(x[mine]) - y[mine]
                    sums[k] += [mine.sum(), e.sum(), np.abs(e).sum(), (e * e).sum(), y[mine].sum(), (y[mine] ** 2).sum()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), *(pa.array(sums[:, i]) for i in range(6))], ["fit", "n", "e", "a", "s", "y", "yy"]
        )

    total = (
        rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")) & F.col(cell).isNotNull())
        .select(F.col(cell).cast("string"), F.col(target).cast("double"), *[F.col(f).cast("double") for f in features])
        .mapInArrow(run, "fit string, n double, e double, a double, s double, y double, yy double")
        .groupBy("fit")
        .agg(*[F.sum(c).alias(c) for c in ("n", "e", "a", "s", "y", "yy")])
    )
    n = F.col("n")
    variance = F.try_divide(F.col("yy"), n) - F.try_divide(F.col("y"), n) * F.try_divide(F.col("y"), n)
    r2 = F.when((n >= 2) & (variance > 0), 1 - F.try_divide(F.try_divide(F.col("s"), n), variance))
    return total.select(
        "fit", F.sqrt(F.try_divide("s", n)).alias("rmse"), F.try_divide("a", n).alias("mae"),
        F.coalesce(r2, F.lit(float("nan"))).alias("r2"), F.try_divide("e", n).alias("bias"), n.cast("long").alias("n"),
    )

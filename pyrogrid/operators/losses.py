"""Losses of a risk model evaluated on a prediction table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.functions.ordered import BUCKET, attach_by_value, cut_points, ordered_prefix, with_bucket
from pyrogrid.operators.metrics import metrics_row

MIN_PROPENSITY = 0.05
TOLERANCE = 1e-11
# Beyond this argument softplus(x) equals x, and softplus(-x) 0, within the tolerance.
REACH = 27.7


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _np_softplus(x):
    return np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x)))


def pair_kernel(steepness: float) -> np.ndarray:
    """Coefficients C with softplus(steepness (v - u)) = sum C[p, q] T_p(u) T_q(v) on [-1, 1]^2.

    The kernel is analytic, so the Chebyshev series converges geometrically; the degree grows until
    the error at test points is below 1e-11 of the kernel's size.  Bands keep the steepness at
    ``REACH`` or less, so that the series always ends.
    """

    def kernel(u, v):
        return _np_softplus(steepness * (v - u))

    probe = np.cos(np.linspace(0.1, 3.0, 41))
    exact = kernel(probe[:, None], probe[None, :])
    k = 16
    while True:
        angles = (np.arange(k) + 0.5) * np.pi / k
        nodes = np.cos(angles)
        basis = np.cos(np.outer(np.arange(k), angles)) * (2.0 / k)
        basis[0] /= 2.0
        c = basis @ kernel(nodes[:, None], nodes[None, :]) @ basis.T
        t = np.cos(np.outer(np.arccos(probe), np.arange(k)))
        if np.abs(t @ c @ t.T - exact).max() <= TOLERANCE * np.abs(exact).max():
            return c
        k += k // 2


class Bands:
    """The risk axis in bands as wide as softplus takes to become linear.

    A pair's argument is ``scale ((risk_j + margin) - risk_i)``, so a row stands at its risk as ``i``
    and at its risk plus the margin as ``j``.  A range of one band or two is not cut further.
    """

    def __init__(self, low: float, high: float, margin: float, scale: float):
        self.margin, self.scale = margin, scale
        self.low = low + min(margin, 0.0)
        span = high + max(margin, 0.0) - self.low
        reach = REACH / scale if scale else float("inf")
        self.width = min(reach, span / 2) if span > 0 else 1.0
        self.n = max(2.0, float(np.ceil(span / self.width)))

    def place(self, shift: float) -> Column:
        return F.col("r") + shift - self.low

    def number(self, place: Column) -> Column:
        return F.least(_floor(place / self.width), F.lit(self.n - 1))


def _floor(x: Column) -> Column:
    """Rounded down, still a double: band numbers of very wide ranges exceed whole numbers."""
    return x - F.pmod(x, F.lit(1.0))


class PairSums:
    """Kernel sum of one group of rows that come in ascending order of their severity."""

    def __init__(self, c: np.ndarray):
        self.c = c
        k = len(c)
        self.loss, self.below = 0.0, np.zeros(k)
        self.left, self.right = np.zeros(k), np.zeros(k)
        self.last, self.held = None, None

    def add(self, s: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Severities and their rows' series terms; the last severity stays open."""
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        left, right = np.add.reduceat(left, starts), np.add.reduceat(right, starts)
        if self.held is not None:
            if s[0] == self.last:
                left[0] += self.held[0]
                right[0] += self.held[1]
            else:
                self.close()
        above = self.below + np.cumsum(right[:-1], axis=0)
        under = np.concatenate([self.below[None], above])[: len(left) - 1]
        self.loss += float(((left[:-1] @ self.c) * under).sum())
        self.left += left[:-1].sum(axis=0)
        self.right += right[:-1].sum(axis=0)
        if len(above):
            self.below = above[-1]
        self.last, self.held = s[-1], (left[-1], right[-1])

    def close(self) -> None:
        if self.held is not None:
            left, right = self.held
            self.loss += float(left @ self.c @ self.below)
            self.left, self.right, self.below = self.left + left, self.right + right, self.below + right
            self.held = None


def _groups(batch, keys):
    """Stretches of equal keys in a sorted batch."""
    columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
    if not batch.num_rows:
        return
    new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
    starts = np.flatnonzero(new)
    for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield tuple(c[lo] for c in columns), lo, hi


def _near(rows: DataFrame, bands: Bands, span: int, counts: DataFrame) -> float:
    """Kernel sum over ordered pairs that share a stretch of ``span`` neighbouring bands.

    In a separable series of the kernel, the sum over all pairs of a stretch is a product of
    per-severity sums of T_p(risk) with the same sums over all smaller severities.  A stretch is
    cut into severity ranges; tasks stream through a range in order, and send one vector for
    each range, which a last pass joins.  A severity with a large share of all rows is a range of
    its own, cut further into parts, as it holds no pair.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    half = span * bands.width / 2
    c = pair_kernel(bands.scale * half)
    order = np.arange(len(c))
    first = 0.0 if span == 2 else 1.0  # end bands lie in one stretch of two only
    share = F.col("n") / F.col("n_total") * (4 * tasks)
    large = counts.where(share > 1).select("s", F.ceil(share).alias("parts"))
    own = [r[0] for r in large.select("s").collect()]
    least = int(np.ceil(4 * tasks / max(bands.n - 1, 1.0)))
    cuts = sorted({*cut_points(rows, "s", least=least), *own, *(float(np.nextafter(x, np.inf)) for x in own)})
    part = F.pmod(F.xxhash64("r"), F.coalesce("parts", F.lit(1)))
    dealt = with_bucket(
        rows.join(F.broadcast(large), "s", "left").withColumn("part", part), "s", [x for x in cuts if np.isfinite(x)]
    )

    def placed(shift: float) -> DataFrame:
        at = dealt.select(BUCKET, "part", "s", bands.place(shift).alias("v"))
        at = at.withColumn("b", bands.number(F.col("v")))
        starts = F.array(*[F.col("b") - i for i in range(span)])
        inside = F.filter(starts, lambda g: (g >= first) & (g <= bands.n - 2))
        out = at.select("*", F.explode(inside).alias("g"))
        unit = (F.col("v") - F.col("g") * bands.width) / half - 1.0
        unit = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), unit))
        return out.select("g", BUCKET, "part", "s", F.acos(unit).alias("a"))

    if bands.margin == 0:
        angled = placed(0.0).withColumn("side", F.lit(2))
    else:
        angled = placed(0.0).withColumn("side", F.lit(0)).union(placed(bands.margin).withColumn("side", F.lit(1)))
    ordered = angled.repartition(tasks, "g", BUCKET, "part").sortWithinPartitions("g", BUCKET, "part", "s")

    def ranges(batches):
        import pyarrow as pa

        at, sums = None, None

        def out():
            sums.close()
            return pa.RecordBatch.from_pydict(
                {"g": [at[0]], BUCKET: pa.array([at[1]], pa.int32()), "loss": [sums.loss],
                 "left": [sums.left.tobytes()], "right": [sums.right.tobytes()]}
            )

        for batch in batches:
            s, a, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            for key, lo, hi in _groups(batch, 3):
                if key != at:
                    if at is not None:
                        yield out()
                    at, sums = key, PairSums(c)
                for x in range(lo, hi, 2048):
                    y = min(x + 2048, hi)
                    terms = np.cos(a[x:y, None] * order)
                    sums.add(s[x:y], terms * (side[x:y, None] != 1), terms * (side[x:y, None] != 0))
        if at is not None:
            yield out()

    def joined(batches):
        import pyarrow as pa

        g, bucket, loss = None, None, 0.0
        below = here = np.zeros(len(c))
        for batch in batches:
            for row in batch.to_pylist():
                left, right = np.frombuffer(row["left"]), np.frombuffer(row["right"])
                if row["g"] != g:
                    g, bucket, below, here = row["g"], row[BUCKET], np.zeros(len(c)), np.zeros(len(c))
                elif row[BUCKET] != bucket:  # parts of one range hold one severity, so no pair
                    bucket, below, here = row[BUCKET], below + here, np.zeros(len(c))
                loss += row["loss"] + float(left @ c @ below)
                here = here + right
        yield pa.RecordBatch.from_pydict({"loss": [loss]})

    found = ordered.mapInArrow(ranges, f"g double, {BUCKET} int, loss double, left binary, right binary")
    return (
        found.repartition("g").sortWithinPartitions("g", BUCKET)
        .mapInArrow(joined, "loss double").agg(F.sum("loss")).first()[0] or 0.0
    )


def _far(rows: DataFrame, bands: Bands) -> float:
    """Sum of the linear part: pairs whose ``j`` stands two bands or more above their ``i``.

    This is a sum over two orders, severity and band.  Two severities part at one binary digit of
    their ranks, the higher one with a 1; so for each digit and each common prefix, all ``i`` with
    a 1 meet all ``j`` with a 0, and band totals with one prefix pass over the bands are enough.
    Cells of equal severity and band are summed first.
    """
    left, right = bands.place(0.0), bands.place(bands.margin)
    zero = F.lit(0.0)
    cells = (
        rows.select("s", (bands.number(left) + 2).alias("key"), F.lit(1.0).alias("ni"), left.alias("xi"), zero.alias("nj"), zero.alias("yj"))
        .union(rows.select("s", bands.number(right).alias("key"), zero, zero, F.lit(1.0), right))
        .groupBy("s", "key")
        .agg(*[F.sum(x).alias(x) for x in ("ni", "xi", "nj", "yj")])
    )
    severities = cells.groupBy("s").agg(F.count(F.lit(1)).alias("cells"))
    ranks = ordered_prefix(severities, ["s"], {"one": F.lit(1), "cells": F.col("cells")})
    n = severities.count()
    if n < 2:
        return 0.0
    ranked = attach_by_value(cells, ranks.select("s", F.col("one_below").alias("rank"), "cells", "cells_total"), "s", "cells", "cells_total")
    digits = F.explode(F.array(*map(F.lit, range((n - 1).bit_length())))).alias("digit")
    split = ranked.select("*", digits).withColumn("rest", F.expr("shiftright(rank, digit)"))
    one = F.col("rest") % 2
    met = (
        split.select(
            "digit", F.floor(F.col("rest") / 2).alias("node"), "key",
            *[(F.col(x) * one).alias(x) for x in ("ni", "xi")],
            *[(F.col(x) * (1 - one)).alias(x) for x in ("nj", "yj")],
        )
    )
    table = ordered_prefix(met, ["key"], {x: F.col(x) for x in ("ni", "xi", "nj", "yj")}, by=["digit", "node"])
    above = {x: F.col(f"{x}_total") - F.col(f"{x}_below") for x in ("nj", "yj")}
    total = table.agg(F.sum(F.col("ni") * above["yj"] - F.col("xi") * above["nj"])).first()[0]
    return bands.scale * (total or 0.0)


def severity_pairs(
    df: DataFrame, risk: str, severity: str, margin: float = 0.0, scale: float = 10.0
) -> tuple[float, int]:
    """Mean ranking loss over ordered pairs with severity_i > severity_j, and their number.

    No pair is ever formed, whatever the range of the scores.  Pairs within two neighbouring bands
    of the risk axis are summed by a series; farther pairs are linear in their difference, or 0.
    Stretches of two bands overlap, so pairs inside a band that two of them hold are taken off once.
    """
    r = F.col(risk).cast("double")
    if scale < 0:
        r, margin, scale = -r, -margin, -scale
    rows = df.dropna(subset=[risk, severity]).select(
        r.alias("r"), F.col(severity).cast("double").alias("s")
    )
    low, high = rows.agg(F.min("r"), F.max("r")).first()
    if low is None:
        return 0.0, 0
    counts = ordered_prefix(rows, ["s"], {"n": F.lit(1)})
    pairs = counts.agg(F.sum(F.col("n") * F.col("n_below"))).first()[0] or 0
    if not pairs:
        return 0.0, 0
    bands = Bands(low, high, margin, scale)
    total = _near(rows, bands, 2, counts)
    if bands.n > 2:
        total += _far(rows, bands) - _near(rows, bands, 1, counts)
    return total / pairs, pairs


def ranking_loss(
    df: DataFrame, risk: str, severity: str, margin: float = 0.0, scale: float = 10.0
) -> DataFrame:
    loss, pairs = severity_pairs(df, risk, severity, margin, scale)
    return metrics_row(df.sparkSession, {"rank_loss": loss, "n_pairs": pairs})


def joint_loss(
    df: DataFrame,
    logit: str,
    sev_pred: str,
    y_occ: str,
    y_sev: str,
    available: str,
    propensity: str | None = None,
    lambda_sev: float = 0.5,
    lambda_rank: float = 0.1,
    margin: float = 0.0,
    scale: float = 10.0,
) -> DataFrame:
    """Occurrence cross-entropy + weighted severity error + severity ranking loss."""
    z, known = F.col(logit), F.col(available) == 1
    error = F.col(sev_pred) - F.col(y_sev)
    if propensity is None:
        weight = F.lit(1.0)
    else:
        p = F.col(propensity)
        weight = 1.0 / F.when(p < MIN_PROPENSITY, MIN_PROPENSITY).otherwise(p)
    row = df.agg(
        F.avg(softplus(z) - z * F.col(y_occ)).alias("occ"),
        F.sum(F.when(known, weight * error * error)).alias("weighted"),
        F.sum(F.when(known, weight)).alias("weights"),
        F.count_if(known).alias("n"),
    ).first()
    sev = row["weighted"] / row["weights"] if row["n"] else 0.0
    rank = 0.0
    if row["n"] > 1:
        risk = (F.col(sev_pred) / (1 + F.exp(-z))).alias("risk")
        rows = df.where(known).select(risk, F.col(y_sev).alias("severity"))
        rank, _ = severity_pairs(rows, "risk", "severity", margin, scale)
    return metrics_row(
        df.sparkSession,
        {
            "occ_loss": row["occ"],
            "sev_loss": sev,
            "rank_loss": rank,
            "total_loss": row["occ"] + lambda_sev * sev + lambda_rank * rank,
        },
    )

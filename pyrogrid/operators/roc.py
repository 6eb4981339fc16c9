"""DeLong variance of one ROC area and the test between two correlated ones.

A positive's component is the share of negatives its score beats, a negative's the share of
positives that beat it (ties count half).  Both follow from the per-score counts below, so one
classifier needs no row-level ranks at all, and two need only their distinct score pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.functions.ordered import attach_by_value
from pyrogrid.functions.special import normal_two_sided
from pyrogrid.operators.metrics import metrics_row, score_table


def _components(table: DataFrame) -> tuple[Column, Column]:
    """The shares that are missing from a positive's and a negative's component.

    Those of a good score are small numbers, whose moments do not cancel as those of numbers
    near 1 do; a covariance is the same for both.
    """
    missed = F.col("neg_total") - F.col("neg_below") - F.col("neg") / 2
    lost = F.col("pos_below") + F.col("pos") / 2
    return F.try_divide(missed, F.col("neg_total")), F.try_divide(lost, F.col("pos_total"))


def _sample_cov(w: Column, a: Column, b: Column, count: Column) -> Column:
    """Weighted sample covariance from raw moments of values in [0, 1]."""
    sa, sb, sab = F.sum(w * a), F.sum(w * b), F.sum(w * a * b)
    return F.try_divide(sab - sa * sb / count, count - 1)


def delong_variance(df: DataFrame, y: str, score: str) -> DataFrame:
    table = score_table(df, y, score)
    missed, lost = _components(table)
    neg, pos = F.col("neg_below") + F.col("neg") / 2, F.col("pos_total") - F.col("pos_below") - F.col("pos") / 2
    parts = table.select(
        "pos", "neg", missed.alias("missed"), lost.alias("lost"),
        F.try_divide(neg, F.col("neg_total")).alias("v01"), F.try_divide(pos, F.col("pos_total")).alias("v10"),
    )
    pos, neg = F.col("pos"), F.col("neg")
    m, n = F.sum(pos), F.sum(neg)

    def variance(one: str, other: str) -> Column:
        one, other = F.col(one), F.col(other)
        spread = F.try_divide(_sample_cov(pos, one, one, m), m)
        return spread + F.try_divide(_sample_cov(neg, other, other, n), n)

    auc = F.try_divide(F.sum(pos * F.col("v01")), m)
    small = F.when(auc > 0.5, variance("missed", "lost")).otherwise(variance("v01", "v10"))
    return parts.agg(auc.alias("auc"), small.alias("variance"))


def delong_test(df: DataFrame, y: str, score_a: str, score_b: str) -> DataFrame:
    """Areas of two scores on the same rows, z and the two-sided p-value of their difference."""
    rows = df.dropna(subset=[y, score_a, score_b])
    hit = F.col(y) == 1
    pairs = rows.groupBy(score_a, score_b).agg(
        F.count_if(hit).alias("p"), F.count_if(~hit).alias("q")
    )
    for name, score in (("a", score_a), ("b", score_b)):
        table = score_table(rows, y, score)
        missed, lost = _components(table)
        table = table.select(
            score,
            (F.col("pos") + F.col("neg")).alias("n"),
            (F.col("pos_total") + F.col("neg_total")).alias("total"),
            missed.alias(f"missed_{name}"),
            lost.alias(f"lost_{name}"),
        )
        pairs = attach_by_value(pairs, table, score, "n", "total")
    p, q = F.col("p"), F.col("q")
    m, n = F.sum(p), F.sum(q)

    # Moments of the difference itself: those of nearly equal scores would cancel.
    above = F.col("missed_b") - F.col("missed_a")
    below = F.col("lost_b") - F.col("lost_a")
    spread = F.try_divide(_sample_cov(p, above, above, m), m)
    spread = spread + F.try_divide(_sample_cov(q, below, below, n), n)

    row = pairs.agg(
        *[(1 - F.try_divide(F.sum(p * F.col(f"missed_{x}")), m)).alias(f"auc_{x}") for x in "ab"],
        F.try_divide(F.sum(p * above), m).alias("gap"),
        spread.alias("var"),
    ).first()
    if row["auc_a"] is None or row["auc_b"] is None:  # one class only
        nan = float("nan")
        return metrics_row(df.sparkSession, dict.fromkeys(("auc_a", "auc_b", "z", "p_value"), nan))
    gap, var = abs(row["gap"]), row["var"]
    z = gap / math.sqrt(var) if var is not None and var > 0 else 0.0
    return metrics_row(
        df.sparkSession,
        {"auc_a": row["auc_a"], "auc_b": row["auc_b"], "z": z, "p_value": normal_two_sided(z)},
    )

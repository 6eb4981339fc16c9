"""Total order at scale: prefix sums, ranks and order statistics without a one-task window.

A plain ``Window.orderBy(value)`` sends every row to one task.  Here equal values are first
collapsed by a map-side combined aggregation, the value range is cut into buckets at approximate
quantiles, and the window runs inside a bucket; a table with one row per bucket carries the
running totals across.  The cut points are fixed numbers in the plan, so a recomputed task
always places a row in the same bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 500_000
# A value is hot when it holds more than this share of all rows, hence at most 10 000 are hot.
HOT_SHARE = 1e-4

BUCKET = "_bucket"


def cut_points(
    df: DataFrame, value: str, bucket_rows: int | None = None, least: int = 1
) -> list[float]:
    """Approximate quantiles cutting ``value`` into buckets of about ``bucket_rows`` rows.

    At least ``least`` buckets are cut.  Cuts are taken among finite values; infinities fall into the end buckets.
    """
    bucket_rows = bucket_rows or BUCKET_ROWS
    v = F.col(value).cast("double")
    v = F.when(F.abs(v) < float("inf"), v)
    n = df.agg(F.count(v)).first()[0]
    buckets = max(-(-n // bucket_rows), min(least, n))
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(v, shares, 10 * buckets)).first()[0]
    return sorted(set(cuts))


def with_bucket(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Rows with the number of the value range between ``cuts`` they fall into, ascending."""
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    lead = "_lead"
    splits = [float("-inf"), *cuts, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol=lead, outputCol=BUCKET, handleInvalid="keep")
    out = cutter.transform(df.withColumn(lead, F.col(value).cast("double")))
    return out.withColumn(BUCKET, F.col(BUCKET).cast("int")).drop(lead)


def ordered_prefix(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    bucket_rows: int | None = None,
) -> DataFrame:
    """One row per distinct ``keys`` (ascending; the first one numeric) within ``by``.

    For every entry of ``sums`` the row carries ``name`` (total over its rows), ``name_below``
    (total over smaller keys) and ``name_total`` (total of the group).  Null and NaN keys are left out.
    """
    keys, by, names = list(keys), list(by), list(sums)
    cuts = cut_points(df, keys[0], bucket_rows)
    kept = df.dropna(subset=keys)
    dist = (
        with_bucket(kept, keys[0], cuts)
        .groupBy(*by, BUCKET, *keys)
        .agg(*[F.sum(sums[n]).alias(n) for n in names])
    )
    inside = W.partitionBy(*by, BUCKET)
    before = inside.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    if not cuts:
        return dist.select(
            *by,
            *keys,
            *names,
            *[F.coalesce(F.sum(n).over(before), zero).alias(f"{n}_below") for n in names],
            *[F.sum(n).over(inside).alias(f"{n}_total") for n in names],
        )
    # One row per (group, bucket).
    across = W.partitionBy(*by)
    earlier = across.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        dist.groupBy(*by, BUCKET)
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            *by,
            BUCKET,
            *[F.coalesce(F.sum(n).over(earlier), zero).alias(f"_{n}_carry") for n in names],
            *[F.sum(n).over(across).alias(f"{n}_total") for n in names],
        )
    )
    return dist.join(carried, [*by, BUCKET]).select(
        *by,
        *keys,
        *names,
        *[
            (F.col(f"_{n}_carry") + F.coalesce(F.sum(n).over(before), zero)).alias(f"{n}_below")
            for n in names
        ],
        *[f"{n}_total" for n in names],
    )


def order_statistics(df: DataFrame, value: str, positions: Sequence[int]) -> dict[int, float]:
    """Exact values at 0-based ``positions`` of the ascending order (nulls left out)."""
    table = ordered_prefix(df, [value], {"n": F.lit(1)})
    wanted = sorted(set(positions))
    inside = [(F.col("n_below") <= p) & (p < F.col("n_below") + F.col("n")) for p in wanted]
    hit = inside[0]
    for condition in inside[1:]:
        hit = hit | condition
    rows = table.where(hit).select(value, "n_below", "n").collect()
    return {
        p: next(r[0] for r in rows if r["n_below"] <= p < r["n_below"] + r["n"]) for p in wanted
    }


def quantile(df: DataFrame, value: str, level: float, method: str = "linear") -> float:
    """Exact quantile of a column; ``higher`` takes the next order statistic instead."""
    n = df.agg(F.count(value)).first()[0]
    if n == 0:
        return float("nan")
    position = min(max(level, 0.0), 1.0) * (n - 1)
    low = int(position)
    high = low if position == low else low + 1
    found = order_statistics(df, value, [low, high])
    if method == "higher":
        return found[high]
    return found[low] + (found[high] - found[low]) * (position - low)


def midranks(df: DataFrame, value: str, rank: str = "midrank") -> DataFrame:
    """Distinct values with their row count ``n`` and 1-based average rank."""
    table = ordered_prefix(df, [value], {"n": F.lit(1)})
    return table.select(
        value, "n", "n_total", (F.col("n_below") + (F.col("n") + 1) / 2).alias(rank)
    )


def attach_by_value(rows: DataFrame, table: DataFrame, key: str, count: str, total: str):
    """Inner join of rows to a one-row-per-value table, safe when one value is very frequent.

    Values above ``HOT_SHARE`` of all rows (at most ``1 / HOT_SHARE`` of them, as their counts
    add up to the total) are broadcast and never shuffled; the others are joined by shuffle.
    """
    hot = F.col(count) > F.col(total) * HOT_SHARE
    payload = [c for c in table.columns if c not in (key, count, total)]
    hot_side = F.broadcast(
        table.where(hot).select(key, *payload, F.lit(True).alias("_hot"))
    )
    first = rows.join(hot_side, key, "left")
    settled = first.where(F.col("_hot")).drop("_hot")
    others = first.where(F.col("_hot").isNull()).drop("_hot", *payload)
    cold = others.join(table.where(~hot).select(key, *payload), key)
    return settled.unionByName(cold)

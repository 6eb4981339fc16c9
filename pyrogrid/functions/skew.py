"""Parts of keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is cut where it holds more than this share of an even task's rows.
TASK_SHARE = 4


def large_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that hold more than a quarter of an even task's rows, and ``_parts`` of about that size.

    An even task holds one in ``spark.sql.shuffle.partitions`` of all rows.  Such keys number at most
    four for each partition, because their shares add up to one.  The counts are part of the plan.
    """
    share = 1.0 / (TASK_SHARE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg((F.sum("_n") * share).alias("_most"))
    return (
        counts.join(F.broadcast(total), F.col("_n") > F.col("_most"))
        .select(*keys, F.ceil(F.col("_n") / F.col("_most")).alias("_parts"))
    )


def has_large_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether ``large_keys`` has a row: two numbers, from one aggregation."""
    share = TASK_SHARE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    return total is not None and most * share > total


def with_parts(
    df: DataFrame, keys: Sequence[str], spread_by: Column, counted: DataFrame | None = None
) -> DataFrame:
    """``df`` with ``_part``: hashed parts, by ``spread_by``, of the large keys, 0 for all others.

    The large keys are broadcast.  ``counted`` may name a cheaper frame with the same keys.
    """
    large = large_keys(df if counted is None else counted, keys)
    part = F.pmod(F.xxhash64(spread_by), F.coalesce("_parts", F.lit(1)))
    return df.join(F.broadcast(large), list(keys), "left").withColumn("_part", part).drop("_parts")

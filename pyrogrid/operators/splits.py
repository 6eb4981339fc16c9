"""Leakage-free splits in time and space."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pyrogrid.config import DataConfig, SplitConfig
from pyrogrid.functions.ordered import ordered_prefix

DAY = "reference_date"
ORDERED_PAIRS = (("train", "val"), ("val", "test"))
OrderFn = Callable[[], Column]


class BufferError(AssertionError):
    """Two splits are closer in time than the label horizon."""


def _date_label(
    train_end: date, val_end: date, test_end: date | None, buffer_days: int, day: str
) -> Column:
    d, buffer = F.col(day), timedelta(days=buffer_days)
    last = F.lit(True) if test_end is None else d <= F.lit(test_end)
    return (
        F.when(d <= F.lit(train_end), "train")
        .when((d > F.lit(train_end + buffer)) & (d <= F.lit(val_end)), "val")
        .when((d > F.lit(val_end + buffer)) & last, "test")
        .otherwise("embargo")
    )


def validate_buffer(
    df: DataFrame, horizon_days: int, split: str = "split", day: str = DAY
) -> None:
    """Fail when train -> val or val -> test is less than the horizon apart."""
    ends = {
        r[0]: (r[1], r[2])
        for r in df.where(F.col(split).isin("train", "val", "test"))
        .groupBy(split)
        .agg(F.min(F.col(day).cast("date")), F.max(F.col(day).cast("date")))
        .collect()
    }
    for left, right in ORDERED_PAIRS:
        if left in ends and right in ends:
            gap = (ends[right][0] - ends[left][1]).days
            if gap < horizon_days:
                raise BufferError(f"{left} and {right} are {gap} days apart, not {horizon_days}")


def temporal_split(
    df: DataFrame,
    split: SplitConfig,
    horizon_days: int,
    day: str = DAY,
    validate: bool = True,
) -> DataFrame:
    """Label rows by date with a purge buffer after train and after val; the rest is embargo."""
    dated = df.withColumn(day, F.col(day).cast("date"))
    out = dated.withColumn(
        "split",
        _date_label(split.train_end, split.val_end, split.test_end, split.buffer_days, day),
    )
    if validate:
        validate_buffer(out, horizon_days, day=day)
    return out


def spatial_blocks(df: DataFrame, block_size_km: int = 50, grid_km: int = 10) -> DataFrame:
    """``block_id`` of the square block of patches a row belongs to."""
    per_block = max(1, block_size_km // grid_km)
    out = df
    for name, pattern in (("patch_row", r"(\d+)_\d+$"), ("patch_col", r"\d+_(\d+)$")):
        if name not in df.columns:
            out = out.withColumn(name, F.regexp_extract("patch_id", pattern, 1).cast("int"))
    return out.withColumn(
        "block_id",
        F.concat_ws(
            "_",
            F.floor(F.col("patch_row") / per_block),
            F.floor(F.col("patch_col") / per_block),
        ),
    )


def seeded_order(seed: int) -> Callable[[Column], Column]:
    """Pseudo-random order of keys that every task computes alike."""
    return lambda key: F.xxhash64(F.lit(seed), key)


def ranked_blocks(
    df: DataFrame, seed: int, order: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Distinct blocks with their 0-based position in the seeded order and their number."""
    order = order or seeded_order(seed)
    blocks = df.where(F.col("block_id").isNotNull()).select("block_id").distinct()
    ranked = ordered_prefix(
        blocks.withColumn("_order", order(F.col("block_id"))),
        ["_order", "block_id"],
        {"n": F.lit(1)},
    )
    return ranked.select(
        "block_id", F.col("n_below").alias("position"), F.col("n_total").alias("blocks")
    )


def spatial_split(
    df: DataFrame,
    n_folds: int,
    seed: int = 42,
    order: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Whole blocks to test (first fold of the seeded order), val (second) and train."""
    ranked = ranked_blocks(df, seed, order)
    fold = F.greatest(F.lit(1), F.floor(F.col("blocks") / n_folds))
    label = (
        F.when(F.col("blocks") < 3, F.raise_error(F.lit("fewer than three spatial blocks")))
        .when(F.col("position") < fold, "test")
        .when(F.col("position") < 2 * fold, "val")
        .otherwise("train")
    )
    assigned = ranked.select("block_id", label.cast("string").alias("spatial_split"))
    return df.join(assigned, "block_id", "left").withColumn(
        "spatial_split", F.coalesce("spatial_split", F.lit("train"))
    )


def spatiotemporal_split(
    df: DataFrame,
    config: DataConfig,
    order: Callable[[Column], Column] | None = None,
    validate: bool = True,
) -> DataFrame:
    """Keep a label only where the date and the block agree, else embargo."""
    if config.spatial_blocks is None:
        raise ValueError("this split needs spatial block settings")
    blocks = config.spatial_blocks
    out = spatial_blocks(df, blocks.block_size_km, config.grid.grid_km)
    out = spatial_split(out, blocks.n_folds, blocks.seed, order)
    out = temporal_split(out, config.split, config.temporal.horizon_days, validate=False)
    out = out.withColumn(
        "split",
        F.when(F.col("split") == F.col("spatial_split"), F.col("split")).otherwise("embargo"),
    )
    if validate:
        validate_buffer(out, config.temporal.horizon_days)
    return out


def split_panel(df: DataFrame, config: DataConfig) -> DataFrame:
    if config.spatial_blocks is not None:
        return spatiotemporal_split(df, config)
    return temporal_split(df, config.split, config.temporal.horizon_days)


def spatial_cv(
    df: DataFrame,
    n_folds: int = 5,
    block_size_km: int = 50,
    grid_km: int = 10,
    seed: int = 42,
    order: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rows with the ``fold`` they are tested in; every other fold trains.

    Blocks are cut into nearly equal folds with the larger ones first.
    """
    out = spatial_blocks(df, block_size_km, grid_km)
    ranked = ranked_blocks(out, seed, order)
    k = F.least(F.lit(n_folds), F.col("blocks"))
    size, extra = F.floor(F.col("blocks") / k), F.col("blocks") % k
    edge = extra * (size + 1)
    fold = F.when(
        F.col("position") < edge, F.floor(F.col("position") / (size + 1))
    ).otherwise(extra + F.floor((F.col("position") - edge) / size))
    assigned = ranked.select("block_id", fold.cast("int").alias("fold"))
    return out.join(assigned, "block_id", "left")


def date_thirds(df: DataFrame, day: str = DAY) -> tuple[date, date]:
    """Boundaries that cut the distinct dates (a calendar, so few) into thirds."""
    days = sorted(
        r[0]
        for r in df.where(F.col(day).isNotNull())
        .select(F.col(day).cast("date"))
        .distinct()
        .collect()
    )
    if len(days) < 3:
        raise ValueError("thirds need at least three distinct dates")
    return days[len(days) // 3 - 1], days[2 * len(days) // 3 - 1]


def buffered_split(
    df: DataFrame,
    buffer_days: int,
    boundaries: tuple[date, date] | None = None,
    day: str = DAY,
) -> DataFrame:
    """Temporal split with an arbitrary buffer and an open-ended test period."""
    train_end, val_end = boundaries or date_thirds(df, day)
    dated = df.withColumn(day, F.col(day).cast("date"))
    return dated.withColumn("split", _date_label(train_end, val_end, None, buffer_days, day))


def calibration_carve(
    df: DataFrame,
    fraction: float = 0.5,
    min_rows: int = 1,
    required: tuple[str, str] | None = None,
    day: str = DAY,
) -> DataFrame:
    """Turn the later part of val, by date, into a ``calibration`` split.

    ``required`` names an availability and a label column: only rows having both count, for the
    dates as well as for the minimum sizes.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("the calibration fraction lies strictly between 0 and 1")
    if min_rows < 1:
        raise ValueError("min_rows is at least 1")
    usable = F.lit(True)
    if required is not None:
        available, label = required
        usable = (F.coalesce(F.col(available).cast("int"), F.lit(0)) == 1) & F.col(
            label
        ).isNotNull()
    per_day = (
        df.where(F.col("split") == "val")
        .groupBy(F.col(day).cast("date").alias("d"))
        .agg(F.count_if(usable).alias("usable"))
        .collect()
    )
    if not per_day:
        raise ValueError("there is no validation split to carve calibration rows from")
    counts = {r["d"]: r["usable"] for r in per_day}
    if required is not None and sum(counts.values()) < 2 * min_rows:
        raise ValueError("too few evaluable validation rows for two parts")
    days = sorted(d for d, n in counts.items() if n or required is None)
    if len(days) < 2:
        raise ValueError("calibration needs at least two validation dates")
    cut = min(max(int(len(days) * (1.0 - fraction) // 1), 1), len(days) - 1)
    start = days[cut]
    if required is not None:
        late = sum(n for d, n in counts.items() if d >= start)
        if min(late, sum(counts.values()) - late) < min_rows:
            raise ValueError("one part would hold too few evaluable validation rows")
    return df.withColumn(
        "split",
        F.when(
            (F.col("split") == "val") & (F.col(day).cast("date") >= F.lit(start)), "calibration"
        ).otherwise(F.col("split")),
    )


def _sortable(df: DataFrame, name: str):
    """Numbers sort as numbers, anything else by its text."""
    numeric = isinstance(df.schema[name].dataType, NumericType)
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if numeric else F.lit(0.0)


def group_folds(
    df: DataFrame, n_splits: int = 5, group: str | None = "patch_id", seed: int = 42
) -> DataFrame:
    """Training rows with a ``fold``; a group's rows share it.

    Groups are dealt round the folds from the largest down, which balances them for the equal
    group sizes of a panel; rows without a group are one group, dealt after those of its size.
    Without at least two groups the rows themselves are dealt by hash.
    """
    if group is not None and group in df.columns:
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).select(
            F.col(group).alias("_group"),
            (-F.col("_rows")).alias("_down"),
            F.col(group).isNull().cast("int").alias("_none"),
            F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_name"),
        )
        ranked = ordered_prefix(
            sizes.withColumn("_order", _sortable(sizes, "_group")),
            ["_down", "_none", "_order", "_name"],
            {"n": F.lit(1)},
        )
        if ranked.take(2)[1:]:
            k = F.least(F.lit(n_splits), F.col("n_total"))
            assigned = ranked.select(
                "_none", "_name", (F.col("n_below") % k).cast("int").alias("fold")
            )
            keyed = df.withColumns({
                "_none": F.col(group).isNull().cast("int"),
                "_name": F.coalesce(F.col(group).cast("string"), F.lit("")),
            })
            return keyed.join(assigned, ["_none", "_name"]).select(*df.columns, "fold")
    return df.withColumn(
        "fold", F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(n_splits)).cast("int")
    )


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("patch_id").alias("count"), F.countDistinct("patch_id").alias("nunique")
    )

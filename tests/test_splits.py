from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pyrogrid.config import (
    BBox,
    DataConfig,
    GridConfig,
    SpatialBlockConfig,
    SplitConfig,
    TemporalConfig,
)
from pyrogrid.operators import splits

SPLIT = SplitConfig(30, date(2020, 6, 30), date(2020, 12, 31), date(2021, 6, 30))


def lattice(spark, side=6, n_dates=60, step=10):
    days = F.explode(
        F.array(*[F.lit(date(2020, 1, 1) + timedelta(days=step * i)) for i in range(n_dates)])
    )
    cells = spark.range(side * side).select(
        F.concat_ws("_", F.floor(F.col("id") / side), F.col("id") % side).alias("patch_id")
    )
    return cells.select("patch_id", days.alias("reference_date"))


def test_temporal_edges(spark):
    days = ["2020-06-30", "2020-07-01", "2020-07-30", "2020-07-31", "2021-01-30", "2021-01-31",
            "2021-06-30", "2021-07-01"]
    df = spark.createDataFrame([(d,) for d in days], "reference_date string")
    got = splits.temporal_split(df, SPLIT, 30).collect()
    assert [r.split for r in got] == [
        "train", "embargo", "embargo", "val", "embargo", "test", "test", "embargo"
    ]


def test_buffer_is_validated(spark):
    df = spark.createDataFrame(
        [(date(2020, 1, 1), "train"), (date(2020, 1, 15), "val")],
        "reference_date date, split string",
    )
    with pytest.raises(AssertionError, match="14 days apart"):
        splits.validate_buffer(df, 30)
    splits.validate_buffer(df, 14)
    splits.validate_buffer(df.where("split = 'train'"), 300)


def test_blocks_need_three(spark):
    few = splits.spatial_blocks(lattice(spark, 2, 1), 10, 10).where("patch_row = 0")
    with pytest.raises(Exception, match="three spatial blocks"):
        splits.spatial_split(few, 5).collect()


def test_spatiotemporal_split_keeps_blocks_apart(spark):
    config = DataConfig(
        GridConfig(10, BBox(0, 1, 0, 1)),
        TemporalConfig(date(2020, 1, 1), date(2021, 1, 1), 7, 30, (7,), 30),
        SPLIT,
        SpatialBlockConfig(20, 3),
    )
    out = splits.split_panel(lattice(spark), config)
    assert {r.split for r in out.select("split").distinct().collect()} == {
        "train", "val", "test", "embargo"
    }
    used = out.where("split <> 'embargo'").select("block_id", "split").distinct()
    assert used.groupBy("block_id").count().where("count > 1").count() == 0
    sizes = {
        r.spatial_split: r["count"]
        for r in out.select("block_id", "spatial_split").distinct()
        .groupBy("spatial_split").count().collect()
    }
    assert sizes == {"test": 3, "val": 3, "train": 3}


def test_cv_fold_sizes_are_as_equal_as_possible(spark):
    blocks = splits.spatial_cv(lattice(spark, 5, 1), 3, 10, 10).groupBy("fold").count()
    assert [r["count"] for r in blocks.orderBy("fold").collect()] == [9, 8, 8]


def test_thirds_and_open_test_end(spark):
    df = lattice(spark, 1, 9)
    got = splits.buffered_split(df, 10).orderBy("reference_date").collect()
    assert [r.split for r in got] == ["train"] * 3 + ["embargo"] + ["val"] * 2 + [
        "embargo"
    ] + ["test"] * 2
    with pytest.raises(ValueError):
        splits.buffered_split(lattice(spark, 1, 2), 10)


def calibration_frame(spark, n=6):
    rows = [
        (date(2020, 1, 1) + timedelta(days=i), "val", int(i % 2 == 0), 0.1 if i % 2 == 0 else None)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "reference_date date, split string, y_sev_available int, y_sev_dnbr double"
    )


def test_calibration_is_later_by_date(spark):
    out = splits.calibration_carve(calibration_frame(spark))
    ends = {
        r[0]: (r[1], r[2])
        for r in out.groupBy("split").agg(F.min("reference_date"), F.max("reference_date")).collect()
    }
    assert ends["val"][1] < ends["calibration"][0]
    required = ("y_sev_available", "y_sev_dnbr")
    out = splits.calibration_carve(calibration_frame(spark, 8), 0.5, 2, required)
    known = out.where("y_sev_available = 1").groupBy("split").count().collect()
    assert {r[0]: r[1] for r in known} == {"val": 2, "calibration": 2}


@pytest.mark.parametrize(
    "options",
    [{"fraction": 1.0}, {"min_rows": 0}, {"min_rows": 9, "required": ("y_sev_available", "y_sev_dnbr")}],
)
def test_calibration_errors(spark, options):
    with pytest.raises(ValueError):
        splits.calibration_carve(calibration_frame(spark), **options)


def test_calibration_needs_rows_and_dates(spark):
    df = calibration_frame(spark)
    with pytest.raises(ValueError):
        splits.calibration_carve(df.withColumn("split", F.lit("train")))
    with pytest.raises(ValueError):
        splits.calibration_carve(df.where(F.col("reference_date") == F.lit(date(2020, 1, 1))))


def test_group_folds_share_no_group(spark):
    df = lattice(spark, 4, 5)
    out = splits.group_folds(df, 5)
    assert out.count() == df.count()
    assert out.select("patch_id", "fold").distinct().count() == 16
    rows = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(rows) == 5 and max(rows) - min(rows) <= 5
    alone = splits.group_folds(df.where("patch_id = '0_0'"), 3)
    assert alone.count() == 5

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pyrogrid.functions.scalars import as_event_date, doy_to_date, severity_class
from pyrogrid.operators import labels

PANEL = (
    "patch_id string, reference_date date, temporal_burn_count_l7d double, "
    "temporal_burn_date_l7d double, temporal_burn_timestamp_l7d bigint, "
    "optical_nbr_mean_l7d double, weather_vpd_mean_l7d double"
)


def ms(day):
    return int((datetime(day.year, day.month, day.day) - datetime(1970, 1, 1)).total_seconds()) * 1000


def panel(spark, rows):
    full = [
        ("0_0", d, count, None, None if when is None else ms(when), nbr, 1.0)
        for d, count, when, nbr in rows
    ]
    return spark.createDataFrame(full, PANEL)


def example(spark):
    burn = date(2020, 1, 20)
    return panel(
        spark,
        [
            (date(2020, 1, 1), 0.0, None, 0.7),
            (date(2020, 1, 8), 0.0, None, 0.65),
            (date(2020, 1, 15), 0.0, None, 0.6),
            (date(2020, 1, 22), 1.0, burn, 0.3),
            (date(2020, 1, 29), 0.0, None, 0.2),
        ],
    )


def test_local_labels(spark):
    out = labels.materialize_labels(example(spark), None, 14, 14, 7)
    rows = out.orderBy("reference_date").collect()
    assert [r.reference_date for r in rows] == [date(2020, 1, d) for d in (1, 8, 15)]
    assert [r.y_occ_14d for r in rows] == [0, 1, 1]
    last = rows[2]
    assert last.event_date == date(2020, 1, 20)
    assert (last.label_nbr_prefire, last.label_nbr_postfire) == (0.6, 0.2)
    assert last.y_sev_dnbr == pytest.approx(0.4)
    assert (last.y_sev_available, last.y_sev_class) == (1, "high")
    assert not [c for c in out.columns if c.startswith(labels.SCAFFOLD)]


def test_occurrence_only_drops_the_burn_ratios(spark):
    out = labels.materialize_labels(example(spark), None, 14, 14, 7, with_severity=False)
    assert "label_nbr_prefire" not in out.columns
    assert {r.y_sev_available for r in out.collect()} == {0}


def test_custom_severity_sees_each_event_once(spark):
    seen = []

    def severity(events, window):
        seen.extend(r.event_date for r in events.collect())
        return events.select(
            "patch_id",
            "event_date",
            F.lit(0.5).alias("label_nbr_prefire"),
            F.lit(0.2).alias("label_nbr_postfire"),
            F.lit(1).alias("y_sev_available"),
            F.lit(0.3).alias("y_sev_dnbr"),
            F.lit("high").alias("y_sev_class"),
        )

    out = labels.materialize_labels(
        example(spark), None, 14, 14, 7, label_reference_end=date(2020, 1, 15), severity=severity
    )
    rows = out.where("y_occ_14d = 1").collect()
    assert seen == [date(2020, 1, 20)]
    assert [r.y_sev_dnbr for r in rows] == [0.3, 0.3]


def test_event_edges(spark):
    """(ref, ref + h]: the same day does not label its own row, day h does, day h + 1 does not."""
    refs = spark.createDataFrame(
        [("a", date(2020, 1, d)) for d in (1, 2, 3, 16)], "patch_id string, reference_date date"
    )
    events = spark.createDataFrame(
        [("a", date(2020, 1, 16))] * 3, "patch_id string, event_date date"
    )
    got = {
        r.reference_date.day: r.event_date
        for r in labels.next_event(refs, events, 14).collect()
    }
    assert got == {1: None, 2: date(2020, 1, 16), 3: date(2020, 1, 16), 16: None}


def test_severity_windows_are_strict_and_take_the_latest_row(spark):
    burn = date(2020, 1, 15)
    rows = panel(
        spark,
        [
            (date(2020, 1, 1), 0.0, None, 0.9),  # exactly 14 days before: in, but not latest
            (date(2020, 1, 10), 0.0, None, 0.8),
            (burn, 1.0, burn, 0.1),  # the event day itself is on neither side
            (date(2020, 1, 20), 0.0, None, 0.4),
            (date(2020, 1, 29), 0.0, None, 0.3),  # exactly 14 days after: the latest
            (date(2020, 1, 30), 0.0, None, 0.2),
        ],
    )
    marked = labels.observed_events(rows, 7)
    got = labels.local_severity(marked, labels.event_rows(marked), 14).first()
    assert (got.label_nbr_prefire, got.label_nbr_postfire) == (0.8, 0.3)


def test_latest_row_without_a_value_makes_severity_unavailable(spark):
    burn = date(2020, 1, 15)
    rows = panel(
        spark,
        [
            (date(2020, 1, 10), 0.0, None, 0.8),
            (burn, 1.0, burn, 0.1),
            (date(2020, 1, 20), 0.0, None, 0.4),
            (date(2020, 1, 27), 0.0, None, None),
        ],
    )
    marked = labels.observed_events(rows, 7)
    got = labels.local_severity(marked, labels.event_rows(marked), 14).first()
    assert (got.label_nbr_prefire, got.label_nbr_postfire) == (0.8, None)
    assert (got.y_sev_available, got.y_sev_dnbr, got.y_sev_class) == (0, None, None)
    only_before = rows.where(F.col("reference_date") <= F.lit(burn))
    alone = labels.local_severity(only_before, labels.event_rows(marked), 14).first()
    assert alone.label_nbr_prefire is None


def test_nbr_falls_back_within_the_row(spark):
    df = spark.createDataFrame(
        [(0.1, None), (0.1, 0.5)], "optical_nbr_mean_l30d double, optical_nbr_mean_l7d double"
    )
    assert [r[0] for r in df.select(labels.nbr_value(df.columns)).collect()] == [0.1, 0.5]


def test_undated_burns_are_demoted_and_counted(spark):
    rows = panel(
        spark,
        [(date(2020, 1, 1), 0.2, None, 0.5), (date(2020, 1, 8), 0.2, date(2020, 1, 5), 0.5)],
    )
    out = labels.observed_events(rows, 7).orderBy("reference_date").collect()
    assert [r.observed_event for r in out] == [0, 1]
    assert labels.undated_burns(rows, 7).first().demoted == 1


def test_timestamp_wins_over_numeric_date_across_years(spark):
    rows = panel(
        spark, [(date(2021, 1, 2), 1.0, date(2020, 12, 31), 0.5)]
    ).withColumn("temporal_burn_date_l7d", F.lit(366.0))
    got = labels.observed_events(rows, 7).first()
    assert got.observed_event_date == date(2020, 12, 31)


def test_unusable_inputs(spark):
    base = example(spark)
    with pytest.raises(ValueError, match="temporal_burn_timestamp features"):
        labels.observed_events(base.drop("temporal_burn_timestamp_l7d"), 7)
    fire = base.withColumnRenamed("temporal_burn_count_l7d", "temporal_fire_count_l7d")
    with pytest.raises(ValueError, match="require an inferable temporal_burn_date"):
        labels.observed_events(fire, 7)
    with pytest.raises(ValueError, match="at least one stride"):
        labels.observed_events(base, 10)


def test_event_date_parsing(spark):
    df = spark.createDataFrame(
        [(1609372800000.0, "2020-12-31T10:00:00"), (0.0, None), (366.0, "2021-01-02")],
        "ms double, text string",
    )
    got = df.select(as_event_date(df, "ms").alias("a"), as_event_date(df, "text").alias("b"))
    assert [tuple(r) for r in got.collect()] == [
        (date(2020, 12, 31), date(2020, 12, 31)),
        (None, None),
        (None, date(2021, 1, 2)),
    ]


def test_day_of_year(spark):
    ref = date(2021, 1, 10)
    df = spark.createDataFrame(
        [(ref, d) for d in (5.0, 364.0, 0.4, 2.5, 300.0, None)], "ref date, doy double"
    )
    got = [r[0] for r in df.select(doy_to_date(F.col("ref"), F.col("doy"), 60)).collect()]
    assert got == [
        date(2021, 1, 5), date(2020, 12, 29), None, date(2021, 1, 2), None, None
    ]


def test_event_exists(spark):
    schema = (
        "patch_id string, reference_date date, observed_event int, observed_event_date date"
    )
    rows = [
        ("a", date(2020, 1, 1), 0, None),
        ("a", date(2020, 1, 8), 0, None),
        ("a", date(2020, 1, 15), 1, date(2020, 1, 20)),
    ]
    out = labels.event_exists(spark.createDataFrame(rows, schema), 14)
    assert [r.y_occ_14d for r in out.orderBy("reference_date").collect()] == [0, 1, 1]
    undated = spark.createDataFrame([("a", date(2020, 1, 1), 1, None)], schema)
    with pytest.raises(ValueError, match="1 positive rows"):
        labels.event_exists(undated, 14)
    with pytest.raises(ValueError, match="observed_event_date"):
        labels.event_exists(undated.drop("observed_event_date"), 14)


def test_severity_from_columns(spark):
    df = spark.createDataFrame(
        [
            (date(2020, 1, 1), 0.7, 0.2, 1),
            (None, 0.7, 0.2, 0),
            (date(2020, 1, 1), 0.2, 0.2, 1),
            (date(2020, 1, 1), None, 0.2, 1),
        ],
        "event_date date, label_nbr_prefire double, label_nbr_postfire double, y_occ_14d int",
    )
    got = labels.severity_from_columns(df).collect()
    assert [r.y_sev_available for r in got] == [1, 0, 1, 1]
    assert got[0].y_sev_dnbr == pytest.approx(0.5) and got[0].y_sev_class == "high"
    assert (got[2].y_sev_dnbr, got[2].y_sev_class) == (0.0, None)
    with pytest.raises(ValueError):
        labels.severity_from_columns(df.withColumn("y_occ_30d", F.lit(1)))


def test_severity_class_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.27, 0.66, 0.67)], "x double")
    got = [r[0] for r in df.select(severity_class(F.col("x"))).collect()]
    assert got == ["low", "low", "moderate", "high", "extreme"]

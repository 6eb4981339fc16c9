import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyrogrid.operators import features, guard


def rows(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_vpd_detects_kelvin_by_median_and_clips(spark):
    df = rows(
        spark,
        weather_temperature_2m_mean_l60d=[300.0, 290.0],
        weather_temperature_2m_max_l60d=[305.0, 295.0],
        weather_dewpoint_temperature_2m_mean_l60d=[295.0, 291.0],
    )
    got = features.vpd(df).orderBy("weather_temperature_2m_mean_l60d").collect()

    def es(k):
        c = k - 273.15
        return 0.6108 * math.exp(17.27 * c / (c + 237.3))

    assert got[0].weather_vpd_mean_l60d == 0.0
    assert got[1].weather_vpd_mean_l60d == pytest.approx(es(300) - es(295))
    assert got[0].weather_vpd_max_l60d == pytest.approx(es(295) - es(291))


@pytest.mark.parametrize(
    "values,expected",
    [
        ([100.0, 300.0], False),  # exactly 200 is not above
        ([100.0, 301.0], True),
        ([201.0, 201.0, 1.0], True),
        ([1.0, 2.0, 900.0], False),
        ([None, None], False),
    ],
)
def test_median_threshold(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert features.median_exceeds(df, ["x"], 200) == {"x": expected}


def test_spectral_indices_finite_and_gated(spark):
    df = rows(spark, **{f"optical_b{b}_mean_l7d": [0.1 * b, 0.0] for b in (2, 3, 4, 8, 11, 12)})
    got = features.spectral_indices(df)
    made = [f"optical_{n}_mean_l7d" for n in ("ndvi", "nbr", "ndmi", "evi", "savi")]
    assert set(made) <= set(got.columns)
    for row in got.select(*made).collect():
        assert all(math.isfinite(v) for v in row)
    without_b3 = features.spectral_indices(df.drop("optical_b3_mean_l7d"))
    assert "optical_savi_mean_l7d" not in without_b3.columns
    other = df.withColumnsRenamed({c: c.replace("l7d", "l10d") for c in df.columns})
    assert features.spectral_indices(other).columns == other.columns


def test_clip_keeps_null_and_nulls_propagate(spark):
    df = spark.createDataFrame(
        [("a", "2020-01-01", None), ("a", "2020-01-20", 3.0), ("a", "2020-02-01", 4.5)],
        "patch_id string, reference_date string, x double",
    )
    got = features.temporal_diff(df, ["x", "absent"], 7).orderBy("reference_date").collect()
    assert [r.x_diff_7d for r in got] == [None, None, 1.5]
    assert got[2].x_rate_7d == pytest.approx(1.5 / 7)


def test_desiccation_uses_sample_deviation_and_can_fit_on_train(spark):
    t, p = "weather_temperature_2m_mean_l7d", "weather_total_precipitation_sum_mean_l7d"
    df = rows(spark, **{t: [1.0, 2.0, 3.0, 100.0], p: [4.0, 4.0, 7.0, 9.0]}).withColumn(
        "split", F.when(F.col(t) < 50, "train").otherwise("test")
    )
    z = lambda s: (s - s.mean()) / (s.std() + 1e-8)
    pdf = df.toPandas()
    got = features.desiccation_index(df).toPandas().weather_desiccation_index_l7d
    assert got.tolist() == pytest.approx((z(pdf[t]) - z(pdf[p])).tolist())
    fitted = features.desiccation_index(df, fit_on="train").toPandas()
    assert fitted.weather_desiccation_index_l7d[1] == pytest.approx(0 - (4 - 5) / (3**0.5 + 1e-8))


def test_sequences_pad_on_the_left(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0, 0.1), ("a", 2, 2.0, None), ("a", 3, 3.0, 0.3), ("b", 1, 9.0, 0.9)],
        "patch_id string, reference_date int, x double, y double",
    )
    got = features.sequence_window(df, ["x", "y"], 3).orderBy("patch_id", "reference_date")
    found = got.collect()
    assert [r.sequence_length for r in found] == [1, 2, 3, 1]
    assert found[0].sequence == [[0, 0], [0, 0], [1.0, 0.1]]
    assert found[2].sequence == [[1.0, 0.1], [2.0, 0.0], [3.0, 0.3]]


def test_guard(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0, 3.0, 0.1, 1)],
        "patch_id string, weather_x double, optical_x double, peat_fraction double, "
        "label_nbr_prefire double, y_sev_available int",
    )
    assert guard.feature_columns(df) == ["weather_x", "optical_x", "peat_fraction"]
    assert guard.guarded_projection(df, ["patch_id"]).columns[0] == "patch_id"
    for bad in ("weather_DNBR_x", "unknown_x", "Weather_x"):
        with pytest.raises(guard.LeakageError):
            guard.check_features([bad])
    with pytest.raises(guard.LeakageError):
        guard.feature_columns(df.withColumn("optical_prefire", F.lit(1)))


def test_window_filter_keeps_unparsable_names():
    names = ["weather_a_l7d", "weather_a_l30d", "weather_a_l60d_diff_7d", "terrain_x", "human_ld"]
    assert guard.within_window(names, 14) == [
        "weather_a_l7d",
        "weather_a_l60d_diff_7d",
        "terrain_x",
        "human_ld",
    ]


def test_nan_is_not_above_a_threshold(spark):
    frame = spark.createDataFrame([(float("nan"),)] * 5 + [(10.0,), (20.0,), (None,)], "t double")
    assert features.median_exceeds(frame, ["t"], 200.0) == {"t": False}

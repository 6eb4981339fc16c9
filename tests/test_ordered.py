import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyrogrid.functions import ordered


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=4000), 2)
    x[:1500] = 0.25  # one hot value
    return pd.DataFrame({"x": x, "g": np.arange(4000) % 3, "w": rng.random(4000)})


@pytest.mark.parametrize("bucket_rows", [10_000, 200])
def test_prefix_matches_a_global_sort(spark, values, bucket_rows):
    df = spark.createDataFrame(values)
    got = (
        ordered.ordered_prefix(df, ["x"], {"n": F.lit(1)}, bucket_rows=bucket_rows)
        .toPandas()
        .sort_values("x")
    )
    counts = values.x.value_counts().sort_index()
    assert got.n.tolist() == counts.tolist()
    assert got.n_below.tolist() == (counts.cumsum() - counts).tolist()
    assert set(got.n_total) == {4000}


@pytest.mark.parametrize("bucket_rows", [10_000, 200])
def test_prefix_within_groups_and_two_keys(spark, values, bucket_rows):
    df = spark.createDataFrame(values)
    got = (
        ordered.ordered_prefix(
            df, ["x", "w"], {"n": F.lit(1)}, by=["g"], bucket_rows=bucket_rows
        )
        .toPandas()
        .sort_values(["g", "x", "w"])
    )
    expected = values.sort_values(["g", "x", "w"]).groupby("g").cumcount()
    assert got.n_below.tolist() == expected.tolist()


def test_order_statistics_and_quantiles(spark, values, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 300)
    df = spark.createDataFrame(values)
    s = np.sort(values.x.to_numpy())
    assert ordered.order_statistics(df, "x", [0, 17, 3999]) == {0: s[0], 17: s[17], 3999: s[-1]}
    assert ordered.quantile(df, "x", 0.5) == pytest.approx(np.median(s))
    assert ordered.quantile(df, "w", 0.3) == pytest.approx(np.quantile(values.w, 0.3))
    assert ordered.quantile(df, "w", 0.3, "higher") == np.quantile(
        values.w, 0.3, method="higher"
    )


def test_attach_by_value_keeps_every_row(spark, values):
    df = spark.createDataFrame(values)
    table = ordered.midranks(df, "x")
    got = ordered.attach_by_value(df, table, "x", "n", "n_total").toPandas()
    assert len(got) == 4000
    expected = values.assign(r=values.x.rank()).sort_values(["x", "w"]).r.tolist()
    assert got.sort_values(["x", "w"]).midrank.tolist() == expected


@pytest.mark.parametrize("bucket_rows", [None, 6])
def test_infinities_and_nan_do_not_depend_on_buckets(spark, bucket_rows):
    inf = float("inf")
    values = [inf] * 20 + [-inf] * 5 + [float("nan")] * 7 + [None] * 3 + [1.5] * 50 + list(range(40))
    frame = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    rows = ordered.ordered_prefix(frame, ["v"], {"n": F.lit(1)}, bucket_rows=bucket_rows).collect()
    plain = sorted(v for v in values if v is not None and v == v)
    assert {r["v"] for r in rows} == set(map(float, plain))
    for r in rows:
        assert r["n_below"] == sum(v < r["v"] for v in plain) and r["n_total"] == len(plain)

"""Refits from cross products against fits of the rows themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyrogrid.operators import models
from pyrogrid.operators.gram import Moments, medians, moments
from pyrogrid.operators.metrics import regression_metrics
from pyrogrid.plans import audits

FEATURES = ["weather_a_mean_l7d", "weather_b_mean_l30d", "optical_c_mean_l7d", "terrain_d"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    n = 600
    x = rng.normal(size=(n, 4)) * [1, 50, 0.01, 3] + [280, 101_325, 0.5, 0]
    y = (x - x.mean(axis=0)) @ [0.4, 0.01, 30, -0.2] + rng.normal(size=n) * 0.3
    x[rng.random(x.shape) < 0.15] = np.nan
    frame = pd.DataFrame(x, columns=FEATURES)
    frame["y_sev_dnbr"], frame["y_sev_available"] = y, 1
    frame["split"] = np.array(["train", "val", "test"])[np.arange(n) * 3 // n]
    frame["reference_date"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n) // 2, unit="D")
    frame["fold"] = rng.integers(0, 3, n)
    frame.loc[:9, "y_sev_dnbr"] = np.nan
    df = spark.createDataFrame(frame).withColumn("reference_date", F.to_date("reference_date"))
    for c in [*FEATURES, "y_sev_dnbr"]:
        df = df.withColumn(c, F.nanvl(c, F.lit(None)))
    return df.cache()


def refit(train, test, features):
    model = models.fit_model(train, "logreg", "regression", features, "y_sev_dnbr")
    row = regression_metrics(model.score(test), "y_sev_dnbr", "prediction").first()
    return row.asDict()


def test_curves_are_refits(panel):
    curves = audits.linear_curves(panel, windows=(7, 30), buffers=(0, 20, 60), fold="fold")
    got = {(r.curve, r.step): r for r in curves.collect()}
    known = panel.where("y_sev_dnbr IS NOT NULL")
    train, test = known.where("split = 'train'"), known.where("split = 'test'")
    last = known.where("split <> 'test'").agg(F.max("reference_date")).first()[0]
    wanted = {
        ("source", "weather"): (train, test, FEATURES[2:]),
        ("source", "terrain"): (train, test, FEATURES[:3]),
        ("lookback", "7"): (train, test, [FEATURES[0], FEATURES[2], FEATURES[3]]),
        ("buffer", "20"): (train, test.where(F.datediff("reference_date", F.lit(last)) > 20), FEATURES),
        ("fold", "1"): (known.where("fold <> 1"), known.where("fold = 1"), FEATURES),
    }
    for key, (one, other, features) in wanted.items():
        found = got[key].asDict()
        assert found["n"] == other.count()
        want = refit(one, other, features)
        assert {k: found[k] for k in want} == pytest.approx(want, rel=1e-6, abs=1e-8)
    assert {c for c, _ in got} == {"source", "lookback", "buffer", "fold"} and len(got) == 3 + 2 + 3 + 3


def test_products_do_not_depend_on_the_layout(panel):
    fill = medians(panel, FEATURES)
    one, many = (
        moments(panel.repartition(k), FEATURES, "y_sev_dnbr", "fold", fill) for k in (1, 7)
    )
    for c in one.cells:
        assert np.allclose(one.cells[c], many.cells[c], rtol=1e-9, atol=1e-6)
    total = one.total(list(one.cells))
    assert total[0, 0] == 590
    assert np.allclose(total - one.cells["1"], one.total(["0", "2"]), atol=1e-6)


def test_singular_and_empty_products():
    z = np.array([[1, 1.0, 2.0, 0, 0, 3.0], [1, 2.0, 4.0, 0, 0, 5.0], [1, 3.0, 6.0, 0, 0, 7.0]])
    cells = {"a": z.T @ z}
    found = Moments(["p", "q"], np.zeros(2), cells)
    fit = found.solve(found.total(["a"]), ["p", "q"], {"p": 0.0, "q": 0.0})
    assert fit.predict(z[:, 1:3]) == pytest.approx([3, 5, 7])
    with pytest.raises(ValueError):
        found.solve(found.total(["none"]), ["p"], {"p": 0.0})


def test_empty_curves(panel):
    assert audits.linear_curves(panel.where("split <> 'test'")).count() == 0
    assert audits.linear_curves(panel.limit(0)).count() == 0

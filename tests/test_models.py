import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyrogrid.operators import models
from pyrogrid.operators.guard import LeakageError
from pyrogrid.plans import audits

FEATURES = ["weather_vpd_mean_l7d", "terrain_twi_mean", "optical_x_l30d"]


@pytest.fixture(scope="module")
def panel(spark):
    """Nine patches on a lattice, dates in three purged periods, risk rising with dryness."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(9):
        for j in range(40):
            dry, wet = rng.normal(), rng.normal()
            day = date(2020, 1, 1) + timedelta(days=7 * j)
            split = "train" if j < 18 else "val" if 20 <= j < 29 else "test" if j >= 31 else "embargo"
            fire = int(rng.random() < 1 / (1 + math.exp(-2 * dry)))
            sev = 0.3 + 0.1 * wet + 0.02 * rng.normal() if fire else None
            rows.append(
                (f"{i // 3}_{i % 3}", day, split, dry, wet if j % 5 else None, 1.0, fire, fire, sev)
            )
    frame = spark.createDataFrame(
        rows,
        "patch_id string, reference_date date, split string, weather_vpd_mean_l7d double, "
        "terrain_twi_mean double, optical_x_l30d double, y_occ_14d int, y_sev_available int, "
        "y_sev_dnbr double",
    )
    return frame.cache()


@pytest.mark.parametrize(
    "family,params",
    [
        ("logreg", {}),
        ("random_forest", {"n_estimators": 10, "max_depth": 4}),
        ("xgboost", {"n_estimators": 5, "max_depth": 3}),
        ("transformer", {"max_iter": 30}),
    ],
)
def test_families_score_every_row(panel, family, params):
    run = models.fit_predict(panel, family, "classification", params, 14)
    assert run.predictions.count() == panel.count()
    assert run.predictions.where(F.col("prediction").between(0, 1)).count() == panel.count()
    assert models.scalars(run.metrics)["roc_auc"] > 0.7
    assert set(panel.columns) < set(run.predictions.columns)


def test_scores_are_written_without_the_panel(panel, monkeypatch):
    """A fit and an ablation write what their metrics read, not the rows as wide as the panel."""
    written = []
    for module in (models, audits):
        def recorded(df, name="stage", write=module.materialise):
            written.append(df.columns)
            return write(df, name)

        monkeypatch.setattr(module, "materialise", recorded)
    run = models.fit_predict(panel, "logreg", "classification", {}, 14)
    assert written == [["split", "y_occ_14d", "prediction"]]
    assert run.predictions.columns == [*panel.columns, "prediction"]
    del written[:]
    found = audits.source_ablation(panel, "logreg", "classification", {}, "y_occ_14d")
    assert found.count() == 3
    assert written == [["y_occ_14d", "prediction"]] * 3


def test_severity_task_uses_known_rows_only(panel):
    run = models.fit_predict(panel, "logreg", "regression", {}, 14)
    assert run.predictions.count() == panel.where("y_sev_available = 1").count()
    assert models.scalars(run.metrics)["rmse"] < 0.2


def test_bad_inputs(panel):
    with pytest.raises(ValueError, match="no rows in the splits test"):
        models.fit_predict(panel.where("split <> 'test'"), "logreg", "classification", {}, 14)
    with pytest.raises(ValueError, match="y_occ_99d"):
        models.fit_predict(panel, "logreg", "classification", {}, 99)
    with pytest.raises(LeakageError):
        models.fit_model(panel, "logreg", "classification", ["y_sev_dnbr"], "y_occ_14d")
    with pytest.raises(ValueError, match="family 'svm'"):
        models.fit_model(panel, "svm", "classification", FEATURES, "y_occ_14d")
    with pytest.raises(ValueError):
        models.severity_fit(panel, "ipw", FEATURES, "transformer")
    with pytest.raises(ValueError, match="no column propensity_score"):
        models.severity_fit(panel, "ipw", FEATURES, "logreg")


def test_features_without_any_value_are_left_out(panel):
    empty = panel.withColumn("optical_x_l30d", F.lit(None).cast("double"))
    model = models.fit_model(empty, "logreg", "classification", FEATURES, "y_occ_14d")
    assert "optical_x_l30d" not in model.features


def test_out_of_fold_scores_differ_from_in_sample(panel):
    run = models.oof_propensity(panel, 14, FEATURES, "logreg", {})
    assert run.predictions.count() == panel.count()
    assert run.predictions.where("propensity_score is null").count() == 0
    direct = models.fit_on_split(
        panel, "logreg", "classification", {}, "y_occ_14d", FEATURES
    ).predictions
    key = ["patch_id", "reference_date"]
    both = run.predictions.select(*key, "split", F.col("propensity_score").alias("oof")).join(
        direct.select(*key, F.col("prediction").alias("own")), key
    )
    gap = {
        r[0]: r[1]
        for r in both.groupBy("split").agg(F.avg(F.abs(F.col("oof") - F.col("own")))).collect()
    }
    assert gap["train"] > 1e-3
    assert gap["val"] == pytest.approx(0.0, abs=1e-6)
    assert gap["test"] == pytest.approx(0.0, abs=1e-6)


def test_fit_risk(panel):
    run = models.fit_risk(panel, 14, FEATURES, "logreg", {}, "logreg")
    rows = run.predictions
    assert rows.count() == panel.count()
    wrong = F.abs(
        F.col("risk_score") - F.col("occurrence_prediction") * F.col("severity_prediction")
    )
    assert rows.where((wrong > 1e-12) | F.col("risk_score").isNull()).count() == 0
    assert models.scalars(run.metrics)["n_evaluable"] >= 10


def test_weights_change_the_severity_fit(panel):
    scored = models.oof_propensity(panel, 14, FEATURES, "logreg", {}).predictions
    runs = [models.severity_fit(scored, k, FEATURES, "logreg") for k in ("naive", "ipw")]
    rmse = [models.scalars(r.metrics)["rmse"] for r in runs]
    assert rmse[0] != rmse[1]
    merged = audits.severity_side_join(scored, runs[0].predictions, runs[1].predictions)
    assert merged.count() == panel.count()
    unknown = merged.where("y_sev_available = 0")
    assert unknown.where("risk_score is not null").count() == 0


@pytest.mark.parametrize("method", ["isotonic", "platt"])
def test_calibrators_are_monotone(spark, method):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(800), 2)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": (rng.random(800) < s**2).astype(int)}))
    fitted = models.fit_calibrator(df, "s", "y", method)
    grid = spark.createDataFrame([(v / 10,) for v in range(-5, 16)], "s double")
    got = [r.calibrated for r in fitted.apply(grid, "s").orderBy("s").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(got, got[1:], strict=False))
    if method == "isotonic":
        assert got[0] == got[5] and got[-1] == got[15]
    with pytest.raises(ValueError):
        models.fit_calibrator(df, "s", "y", "other")


def test_temporal_leakage(spark):
    rows = [(date(2020, 1, 1), "train"), (date(2020, 1, 20), "train"), (date(2020, 1, 30), "val")]
    df = spark.createDataFrame(rows, "reference_date date, split string")
    got = audits.temporal_leakage(df, 30).first()
    assert (got.leakage_detected, got.gap_days, got.overlap_days) == (True, 10, 20)
    assert got.leaking_train_fraction == 1.0
    clean = audits.temporal_leakage(df, 5).first()
    assert (clean.leakage_detected, clean.leaking_train_fraction) == (False, 0.0)
    assert audits.temporal_leakage(df.where("split = 'val'"), 5).first().asDict() == {
        "leakage_detected": False
    }


def test_leakage_curve_shrinks_with_the_buffer(spark):
    rows = [
        ("0_0", date(2020, 1, 1) + timedelta(days=7 * i), i % 2, float(i % 2)) for i in range(60)
    ]
    df = spark.createDataFrame(
        rows, "patch_id string, reference_date date, y_occ_30d int, s double"
    )
    fits = []

    def train(rows, _val):
        fits.append(rows.count())

    curve = audits.leakage_curve(
        df, train, lambda _m, t: 0.5 + t.count() / 1000, 30, [0, 10, 20, 30, 400]
    ).collect()
    assert [r.buffer_days for r in curve] == [0, 10, 20, 30]
    assert [r.type2_overlap_days for r in curve] == [30, 20, 10, 0]
    assert [r.n_test for r in curve] == sorted((r.n_test for r in curve), reverse=True)
    assert fits == [20] * 4


def test_audits_read_the_features_of_a_test_row_once(spark, panel, monkeypatch):
    """The area of a narrow table of scores is the area of the scored rows."""
    features = FEATURES[:2]
    train, evaluate = audits.occurrence_callbacks(features, "y_occ_14d", "logreg", {"max_iter": 5})
    model = train(models.in_split(panel, "train"), None)
    test = models.in_split(panel, "test")
    want = models.scalars(audits.roc_metrics(model.score(test), "y_occ_14d", "prediction"))["roc_auc"]
    given, area = [], audits.roc_metrics

    def seen(rows, *args):
        given.append(rows)
        return area(rows, *args)

    monkeypatch.setattr(audits, "roc_metrics", seen)
    assert evaluate(model, test) == pytest.approx(want)
    assert given[0].columns == ["y_occ_14d", "prediction"]


def test_folds_of_all_block_sizes(spark, panel):
    """Block sizes run together; each has the mean over its own folds."""
    rows = panel.withColumns({"patch_row": F.split("patch_id", "_")[0].cast("int"), "patch_col": F.split("patch_id", "_")[1].cast("int")})

    def train(kept, _val):
        return kept.count()

    got = audits.spatial_leakage(rows, train, lambda n, test: test.count() / (n + test.count()), (20, 10, 10), 10).collect()
    assert [(r.block_size_km, r.n_folds) for r in got] == [(10, 5), (10, 5), (20, 4)]
    assert all(r.mean_auc == pytest.approx(1 / r.n_folds) for r in got)


def test_ablations(panel):
    table = audits.source_ablation(panel, "logreg", "classification", {}, "y_occ_14d", FEATURES)
    rows = {r.removed_namespace: r.roc_auc for r in table.collect()}
    assert list(rows) == ["optical", "terrain", "weather"]
    assert rows["weather"] < rows["terrain"]
    look = audits.lookback_ablation(panel, "logreg", "classification", {}, 14, (7, 30))
    assert [r.max_window_days for r in look.collect()] == [7, 30]


def test_conformal_experiment(panel):
    summary, sets = audits.conformal_experiment(panel, 14, "logreg", {}, min_rows=5)
    row = summary.first()
    assert row.n_test == sets.count() and row.n_calibration >= 5
    assert 0.5 <= row.empirical_coverage <= 1.0


def test_stored_predictions_are_reused(spark, panel, tmp_path):
    path, made = str(tmp_path / "predictions"), []

    def generate():
        made.append(1)
        return models.fit_predict(panel, "logreg", "classification", {}, 14).predictions

    first = audits.evaluate_predictions(path, "occurrence", 14, spark, generate).first()
    again = audits.evaluate_predictions(path, "occurrence", 14, spark, generate).first()
    assert made == [1] and first.roc_auc == pytest.approx(again.roc_auc)


def test_parameters_are_honoured_or_refused(panel):
    train = models.in_split(panel, "train")
    forest = {"n_estimators": 3, "max_depth": 4, "min_samples_leaf": 5, "class_weight": "balanced"}
    fitted = models.fit_model(train, "random_forest", "classification", FEATURES, "y_occ_14d", forest)
    stage = fitted.pipeline.stages[-1]
    assert stage.getOrDefault("minInstancesPerNode") == 5 and stage.getOrDefault("maxDepth") == 4
    boosted = {"n_estimators": 2, "max_depth": 2, "colsample_bytree": 0.5}
    fitted = models.fit_model(train, "xgboost", "classification", FEATURES, "y_occ_14d", boosted)
    assert fitted.pipeline.stages[-1].getOrDefault("featureSubsetStrategy") == "0.5"
    with pytest.raises(ValueError, match="reg_lambda"):
        models.check_params("xgboost", {"reg_lambda": 1.0})
    models.check_params("xgboost", {"reg_lambda": 1.0, "ignored": ["reg_lambda"]})
    assert models._tree_params({"max_depth": None})["maxDepth"] == models.UNLIMITED_DEPTH


def test_models_are_saved_and_loaded(spark, panel, tmp_path):
    train = models.in_split(panel, "train")
    fitted = models.fit_model(train, "logreg", "classification", FEATURES, "y_occ_14d", {"max_iter": 5})
    models.save_models({"occurrence": fitted}, str(tmp_path / "m"))
    loaded = models.load_model(spark, str(tmp_path / "m" / "occurrence"))
    a, b = (m.score(panel).select("prediction").collect() for m in (fitted, loaded))
    assert sorted(a) == sorted(b) and loaded.features == fitted.features


def test_buffers_of_one_fit_are_scored_once(spark, panel, monkeypatch):
    """The test rows of all buffers are scored in one go; every area is that of its own rows."""
    features, buffers = FEATURES[:2], [0, 10, 20]
    train, evaluate = audits.occurrence_callbacks(features, "y_occ_14d", "logreg", {"max_iter": 5})
    scored, score = [], models.FittedModel.score

    def seen(self, df, *args):
        scored.append(df)
        return score(self, df, *args)

    monkeypatch.setattr(models.FittedModel, "score", seen)
    curve = audits.leakage_curve(panel, train, evaluate, 14, buffers, uses_val=False).collect()
    assert len(scored) == 1 and len(curve) > 1
    boundaries = audits.date_thirds(panel)
    for row in curve:
        parts = audits.buffered_split(panel, row.buffer_days, boundaries)
        model = train(models.in_split(parts, "train"), None)
        assert row.roc_auc == pytest.approx(evaluate(model, models.in_split(parts, "test")), abs=1e-12)

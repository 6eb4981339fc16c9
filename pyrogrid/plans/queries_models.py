"""Queries that fit models.

Under the survey's keys stand fits whose answer has a closed form, so SQL can compute every
prediction; the same operators over the wide panel are registered as ``*_panel`` and have no twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pyrogrid.operators import models
from pyrogrid.operators.guard import feature_columns
from pyrogrid.operators.labels import KEY as PANEL_KEY
from pyrogrid.operators.metrics import METRIC_NAMES
from pyrogrid.plans import audits
from pyrogrid.plans import inputs as T
from pyrogrid.plans.inputs import HORIZON, SPLIT, with_tables
from pyrogrid.plans.queries_evaluation import report_rows
from pyrogrid.plans.registry import KEY, fields, query

TARGET = "y_occ_30d"
# Short fits: the contract is which rows train and which are scored, not the fit's quality.
PARAMS = {
    "logreg": {"max_iter": 20},
    "random_forest": {"n_estimators": 5, "max_depth": 4, "random_state": 42},
    "xgboost": {"n_estimators": 3, "max_depth": 3, "random_state": 42},
    "transformer": {"max_iter": 10},
}
CLASSIFIED = fields(METRIC_NAMES)
REGRESSED = "rmse:f mae:f r2:f bias:f"
BOUNDARIES = (SPLIT.train_end, SPLIT.val_end)


def _predicted(family: str, task: str = "classification"):
    def run(spark, sf):
        panel = T.model_panel(spark, sf)
        return models.fit_predict(panel, family, task, PARAMS[family], HORIZON).predictions

    return run


PREDICTION = f"{KEY} split {TARGET}:i prediction:f"
query("fit_logreg_panel", PREDICTION)(_predicted("logreg"))
query("fit_random_forest_panel", PREDICTION)(_predicted("random_forest"))
query("fit_boosted_panel", PREDICTION)(_predicted("xgboost"))
query("fit_mlp", PREDICTION)(_predicted("transformer"))


@query("fit_predict_panel", REGRESSED)
def severity_regression(spark, sf):
    panel = T.model_panel(spark, sf)
    return models.fit_predict(panel, "logreg", "regression", {}, HORIZON).metrics


def _propensity(spark, sf, family="logreg"):
    return models.oof_propensity(
        T.model_panel(spark, sf), HORIZON, family=family, params=PARAMS[family]
    )


@query("oof_propensity_panel", f"{KEY} split propensity_score:f occurrence_prediction:f prediction:f")
def cross_fitted(spark, sf):
    return _propensity(spark, sf).predictions


@query("severity_fit", f"kind {REGRESSED} risk_spearman:f")
def severity_kinds(spark, sf):
    scored = _propensity(spark, sf).predictions
    features = feature_columns(T.model_panel(spark, sf))
    runs = [
        models.severity_fit(scored, kind, features, "logreg").metrics.select(
            F.lit(kind).alias("kind"), "*"
        )
        for kind in ("naive", "ipw")
    ]
    return audits.union_rows(runs)


@query(
    "risk_pipeline_panel",
    f"{KEY} split propensity_score:f severity_prediction:f risk_score:f",
)
def risk(spark, sf):
    return models.fit_risk(
        T.model_panel(spark, sf),
        HORIZON,
        occurrence_family="xgboost",
        occurrence_params=PARAMS["xgboost"],
        severity_family="random_forest",
        severity_params=PARAMS["random_forest"],
        tie_break=[F.unix_date("reference_date"), F.xxhash64("patch_id")],
    ).predictions


@query("calibrate_probability", f"{KEY} isotonic:f platt:f")
def calibrated(spark, sf):
    rows = T.scored(spark, sf).select(*PANEL_KEY, "split", TARGET, "occurrence_prediction")
    fitted_on = models.in_split(rows, "val")
    for method in ("isotonic", "platt"):
        fitted = models.fit_calibrator(fitted_on, "occurrence_prediction", TARGET, method)
        rows = fitted.apply(rows, "occurrence_prediction", method)
    return rows


# --- fits with a closed form


FLAG = "weather_flag_l7d"
STUMP = {"n_estimators": 1, "max_depth": 1, "bootstrap": False, "max_features": 1.0}
FLAGGED = f"SELECT *, CASE WHEN occurrence_prediction > 0.51234::DOUBLE THEN 1 ELSE 0 END AS {FLAG} FROM scored"
TRAIN = f"SELECT * FROM ({FLAGGED}) WHERE split = 'train'"
SCORES = f"split {FLAG}:i n:i low:f high:f"


def flagged(spark, sf):
    """Line items with one 0/1 feature, labels and splits."""
    flag = (F.col("occurrence_prediction") > 0.51234).cast("int").alias(FLAG)
    return T.scored(spark, sf).select(
        "l_orderkey", "l_linenumber", *PANEL_KEY, "split", TARGET, "y_sev_available", "y_sev_dnbr",
        "sigma", flag,
    )


def _levels(rows, column="prediction", by=()):
    """Extremes of a prediction where it has to be constant."""
    return rows.groupBy("split", *by, FLAG).agg(
        F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
    )


def _rate_sql(value):
    """Every row with what a fit on the 0/1 feature predicts, from the training rows of its leaf."""
    return with_tables(
        f"""SELECT split, {FLAG}, count(*) AS n, min(p) AS low, max(p) AS high FROM ({FLAGGED})
        JOIN (SELECT {FLAG}, {value} AS p FROM ({TRAIN}) GROUP BY {FLAG}) USING ({FLAG})
        GROUP BY split, {FLAG}""",
        "scored",
    )


def _closed(family, params):
    def run(spark, sf):
        fit = models.fit_on_split(flagged(spark, sf), family, "classification", params, TARGET, [FLAG])
        return _levels(fit.predictions)

    return run


# Without a penalty, and in an unsampled tree of depth 1, a leaf predicts its rate.
RATE = f"avg({TARGET})"
query("fit_logreg", SCORES, _rate_sql(RATE))(
    _closed("logreg", {"C": 1e15, "max_iter": 500, "tol": 1e-13})
)
query("fit_random_forest", SCORES, _rate_sql(RATE))(_closed("random_forest", STUMP))
# One boosting step fits the labels -1 and 1; the probability is the logistic of twice its mean.
query("fit_boosted", SCORES, _rate_sql(f"1 / (1 + exp(-2 * avg(2 * {TARGET} - 1)))"))(
    _closed("xgboost", {"n_estimators": 1, "max_depth": 1})
)


@query(
    "fit_predict",
    REGRESSED,
    with_tables(
        f"""SELECT sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
        1 - sum(e * e) / (count(*) * var_pop(y_sev_dnbr)) AS r2, avg(e) AS bias
        FROM (SELECT y_sev_dnbr, b + a * sigma - y_sev_dnbr AS e FROM scored,
              (SELECT regr_slope(y_sev_dnbr, sigma) AS a, regr_intercept(y_sev_dnbr, sigma) AS b
               FROM scored WHERE split = 'train' AND y_sev_available = 1)
              WHERE split = 'test' AND y_sev_available = 1)""",
        "scored",
    ),
)
def least_squares(spark, sf):
    """Severity by a line through one feature."""
    rows = T.scored(spark, sf).select(
        *PANEL_KEY, "split", "y_sev_available", "y_sev_dnbr", F.col("sigma").alias(FLAG)
    )
    return models.fit_predict(rows, "logreg", "regression", {}, HORIZON).metrics


FOLDS = """SELECT patch_id, (row_number() OVER (ORDER BY count(*) DESC, patch_id) - 1) % 5 AS fold
    FROM scored WHERE split = 'train' GROUP BY patch_id"""
# Rates of the other folds for training rows, of all training rows for the rest.
CROSS_FITTED = f"""SELECT t.*, CASE WHEN split = 'train'
    THEN (a.y - f.y) / (a.n - f.n) ELSE a.y / a.n END AS p
    FROM ({FLAGGED}) t
    JOIN (SELECT {FLAG}, CAST(sum({TARGET}) AS DOUBLE) AS y, count(*) AS n FROM ({TRAIN}) GROUP BY {FLAG}) a
      USING ({FLAG})
    LEFT JOIN ({FOLDS}) g ON g.patch_id = t.patch_id AND split = 'train'
    LEFT JOIN (SELECT {FLAG}, fold, CAST(sum({TARGET}) AS DOUBLE) AS y, count(*) AS n
               FROM ({TRAIN}) JOIN ({FOLDS}) USING (patch_id) GROUP BY {FLAG}, fold) f
      ON f.{FLAG} = t.{FLAG} AND f.fold = g.fold"""


@query(
    "oof_propensity",
    f"patch_id {SCORES}",
    with_tables(
        f"""SELECT patch_id, split, {FLAG}, count(*) AS n, min(p) AS low, max(p) AS high
        FROM ({CROSS_FITTED}) GROUP BY patch_id, split, {FLAG}""",
        "scored",
    ),
)
def cross_fitted_rates(spark, sf):
    found = models.oof_propensity(
        flagged(spark, sf), HORIZON, features=[FLAG], family="random_forest", params=STUMP
    )
    return _levels(found.predictions, "propensity_score", ["patch_id"])


@query(
    "risk_pipeline",
    f"patch_id {SCORES}",
    with_tables(
        f"""SELECT patch_id, split, {FLAG}, count(*) AS n, min(p * s) AS low, max(p * s) AS high
        FROM ({CROSS_FITTED})
        JOIN (SELECT {FLAG}, sum(w * y_sev_dnbr) / sum(w) AS s
              FROM (SELECT *, 1 / greatest(0.05, least(0.95, p)) AS w FROM ({CROSS_FITTED}))
              WHERE split = 'train' AND y_sev_available = 1 GROUP BY {FLAG}) USING ({FLAG})
        GROUP BY patch_id, split, {FLAG}""",
        "scored",
    ),
)
def weighted_leaf_risk(spark, sf):
    """Cross-fitted rates times the inverse-propensity-weighted mean severity of the leaf."""
    found = models.fit_risk(
        flagged(spark, sf), HORIZON, [FLAG],
        occurrence_family="random_forest", occurrence_params=STUMP,
        severity_family="random_forest", severity_params=STUMP,
        tie_break=[F.unix_date("reference_date"), F.xxhash64("patch_id")],
    )
    return _levels(found.predictions, "risk_score", ["patch_id"])


# --- least-squares refits from one set of cross products


NEAR_X, FAR_Z = "weather_x_mean_l7d", "optical_z_mean_l30d"
BUFFERS = tuple(range(0, 2 * HORIZON + 1, 5))
CURVES = f"curve step n:i {REGRESSED}"


def two_features(spark, sf):
    """Known severities with one short and one long look-back feature, folds by patch."""
    return T.scored(spark, sf).select(
        *PANEL_KEY, "split", "y_sev_dnbr", "y_sev_available", (F.col("patch_key") % 5).alias("fold"),
        F.col("occurrence_prediction").alias(NEAR_X), F.col("sigma").alias(FAR_Z),
    )


KNOWN = """(SELECT split, reference_date, patch_key % 5 AS fold, y_sev_dnbr AS y,
      occurrence_prediction AS x, sigma AS z FROM scored WHERE y_sev_dnbr IS NOT NULL) known"""


def _line_sql(curve, step, train, test, x=True, z=True):
    """Metrics of a plane (or line) through the training rows, by the normal equations."""
    plane = f"(szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS bx, (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS bz"
    line = {(True, True): plane, (True, False): "sxy / sxx AS bx, 0 AS bz", (False, True): "0 AS bx, szy / szz AS bz"}
    return f"""SELECT '{curve}' AS curve, '{step}' AS step, count(*) AS n, sqrt(avg(e * e)) AS rmse,
      avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2, avg(e) AS bias
    FROM (SELECT y, my + bx * (x - mx) + bz * (z - mz) - y AS e FROM {KNOWN},
      (SELECT *, {line[x, z]} FROM (
        SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS sxx, var_pop(z) AS szz,
          covar_pop(x, z) AS sxz, covar_pop(x, y) AS sxy, covar_pop(z, y) AS szy FROM {KNOWN} WHERE {train}))
      WHERE {test}) HAVING count(*) > 0"""


def _curves_sql(chosen, step="curve, step"):
    train, test = "split = 'train'", "split = 'test'"
    edge = f"(SELECT max(reference_date) FROM {KNOWN} WHERE split IN ('train', 'val'))"
    parts = {
        "source": [("source", "weather", train, test, False, True), ("source", "optical", train, test, True, False)],
        "lookback": [("lookback", w, train, test, True, w >= 30) for w in audits.LOOKBACK_WINDOWS],
        "buffer": [("buffer", b, train, f"{test} AND reference_date - {edge} > {b}") for b in BUFFERS],
        "fold": [("fold", f, f"fold <> {f}", f"fold = {f}") for f in range(5)],
    }
    unions = " UNION ALL ".join(_line_sql(*p) for c in chosen for p in parts[c])
    return with_tables(f"SELECT {step}, n, rmse, mae, r2, bias FROM ({unions})", "scored")


@query("linear_curves", CURVES, _curves_sql(["source", "lookback", "buffer", "fold"]))
def refits(spark, sf):
    """Source, look-back, buffer and fold refits of a two-feature least-squares fit."""
    return audits.linear_curves(two_features(spark, sf), buffers=BUFFERS, fold="fold")


@query("linear_curves_panel", CURVES)
def panel_refits(spark, sf):
    """All refits of the wide panel's severity model."""
    panel = T.model_panel(spark, sf).withColumn("fold", F.pmod(F.xxhash64("patch_id"), F.lit(5)))
    return audits.linear_curves(panel.where("y_sev_available = 1"), buffers=BUFFERS, fold="fold")


# --- ablations and experiments


@query(
    "source_ablation",
    f"removed_namespace {REGRESSED}",
    _curves_sql(["source"], "step AS removed_namespace"),
)
def linear_namespaces(spark, sf):
    """Least squares without one namespace; ``source_ablation_panel`` refits the wide classifier."""
    return audits.source_ablation(two_features(spark, sf), "logreg", "regression", {}, "y_sev_dnbr")


@query(
    "lookback_ablation",
    f"max_window_days:i {REGRESSED}",
    _curves_sql(["lookback"], "step AS max_window_days"),
)
def linear_lookbacks(spark, sf):
    """Least squares on capped windows; ``lookback_ablation_panel`` refits the wide classifier."""
    return audits.lookback_ablation(two_features(spark, sf), "logreg", "regression", {}, HORIZON)


@query("source_ablation_panel", f"removed_namespace {CLASSIFIED}")
def namespaces(spark, sf):
    panel = T.model_panel(spark, sf)
    return audits.source_ablation(panel, "logreg", "classification", PARAMS["logreg"], TARGET)


@query("lookback_ablation_panel", f"max_window_days:i {CLASSIFIED}")
def lookbacks(spark, sf):
    panel = T.model_panel(spark, sf)
    return audits.lookback_ablation(
        panel, "logreg", "classification", PARAMS["logreg"], HORIZON
    )


@query("model_comparison", f"model {CLASSIFIED}")
def families(spark, sf):
    chosen = {f: PARAMS[f] for f in ("logreg", "random_forest", "xgboost")}
    return audits.model_comparison(
        T.model_panel(spark, sf), chosen, "classification", HORIZON
    )


@query("severity_comparison", f"model occurrence_roc_auc:f {REGRESSED} risk_spearman:f")
def severities(spark, sf):
    table, _ = audits.severity_comparison(
        T.model_panel(spark, sf), HORIZON, "logreg", PARAMS["logreg"]
    )
    return table


@query(
    "conformal_experiment",
    "empirical_coverage:f target_coverage:f mean_interval_width:f median_interval_width:f "
    "calibration_q:f n_calibration:i n_test:i n_confident_alerts:i "
    "fraction_confident_alerts:f mean_confident_lower:f",
)
def conformal_intervals(spark, sf):
    summary, _ = audits.conformal_experiment(
        T.model_panel(spark, sf), HORIZON, "logreg", PARAMS["logreg"]
    )
    return summary


@query("leakage_report_panel", "curve step:i auc:f")
def report(spark, sf):
    panel = T.model_panel(spark, sf)
    return report_rows(
        audits.leakage_report(panel.drop("split"), panel, HORIZON, "logreg", PARAMS["logreg"], BOUNDARIES)
    )


@query(
    "contribution_summary",
    "variant row_type occurrence_roc_auc:f severity_rmse:f severity_mae:f risk_spearman:f "
    "conformal_coverage:f conformal_width:f temporal_leakage_auc_drop:f "
    "spatial_leakage_auc_drop:f",
)
def contributions(spark, sf):
    panel = T.model_panel(spark, sf)
    return audits.contribution_summary(
        panel.drop("split"), panel, HORIZON, "logreg", PARAMS["logreg"], BOUNDARIES
    )

"""Leakage audits, ablations and experiments: compositions that end in small result tables.

Driver loops here run over configurations (buffers, block sizes, namespaces, families), never over
rows; every iteration is a Spark fit, and independent ones are submitted together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid.sources.tables import absent
from pyrogrid.config import DataConfig
from pyrogrid.operators import conformal
from pyrogrid.operators.gram import medians, moments, score_fits
from pyrogrid.operators.guard import (
    feature_columns,
    features_by_namespace,
    max_window_projection,
)
from pyrogrid.operators.labels import occurrence_column
from pyrogrid.operators.metrics import (
    classification_metrics,
    expected_risk,
    metrics_row,
    regression_metrics,
    risk_ranking,
    roc_metrics,
    with_risk,
)
from pyrogrid.operators.models import (
    RunResult,
    fit_model,
    fit_predict,
    in_split,
    oof_propensity,
    fit_risk,
    scalars,
    severity_fit,
)
from pyrogrid.operators.splits import (
    buffered_split,
    calibration_carve,
    date_thirds,
    spatial_cv,
    split_panel,
)
from pyrogrid.session import discard, in_parallel, materialise

# Default block sizes, windows and the smallest sample an audit fits on.
BLOCK_SIZES_KM = (10, 25, 50, 100)
LOOKBACK_WINDOWS = (7, 14, 30, 60)
REGRESSION_NAMES = ("rmse", "mae", "r2", "bias")
MIN_AUDIT_ROWS = 10
MIN_CALIBRATION_ROWS = 20

TrainFn = Callable[[DataFrame, DataFrame], object]
EvalFn = Callable[[object, DataFrame], float]


def rows_to_frame(spark, rows: Sequence[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema=schema)


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def temporal_leakage(df: DataFrame, horizon_days: int) -> DataFrame:
    """Gap between train and val against the horizon, and the share of train rows reaching val."""
    day, train = F.col("reference_date").cast("date"), F.col("split") == "train"
    ends = df.agg(
        F.max(F.when(train, day)).alias("last"),
        F.min(F.when(F.col("split") == "val", day)).alias("first"),
    ).first()
    if ends["last"] is None or ends["first"] is None:
        return metrics_row(df.sparkSession, {"leakage_detected": False})
    gap = (ends["first"] - ends["last"]).days
    overlap = max(0, horizon_days - gap)
    reaches = day >= F.lit(ends["first"] - timedelta(days=horizon_days))
    return df.where(train).agg(
        F.lit(overlap > 0).alias("leakage_detected"),
        F.lit(gap).alias("gap_days"),
        F.lit(horizon_days).alias("horizon_days"),
        F.lit(overlap).alias("overlap_days"),
        F.lit(overlap / horizon_days).alias("overlap_ratio"),
        F.avg(reaches.cast("double")).alias("leaking_train_fraction"),
    )


def _buffer_sizes(
    df: DataFrame, buffers: Sequence[int], boundaries: tuple[date, date]
) -> dict[int, tuple[int, int, int]]:
    """Rows of train, val and test for every buffer, from one aggregation."""
    train_end, val_end = boundaries
    day, aggs = F.col("reference_date").cast("date"), []
    for b in buffers:
        gap = timedelta(days=b)
        aggs += [
            F.count_if((day > F.lit(train_end + gap)) & (day <= F.lit(val_end))).alias(f"v{b}"),
            F.count_if(day > F.lit(val_end + gap)).alias(f"t{b}"),
        ]
    row = df.agg(F.count_if(day <= F.lit(train_end)).alias("n"), *aggs).first()
    return {b: (row["n"], row[f"v{b}"], row[f"t{b}"]) for b in buffers}


@dataclass(frozen=True)
class ScoreArea:
    """ROC area of a fitted model on test rows, in one step or from rows scored before."""

    target: str
    features: tuple[str, ...]

    def scored(self, model, rows: DataFrame, *kept: str) -> DataFrame:
        names = dict.fromkeys([self.target, *kept, *self.features])
        return model.score(rows.select(*names)).select(self.target, *kept, "prediction")

    def area(self, scored: DataFrame) -> float:
        return scalars(roc_metrics(scored, self.target, "prediction"))["roc_auc"]

    def __call__(self, model, rows: DataFrame) -> float:
        # The area reads its rows several times, the features of each are read and scored once.
        scored = materialise(self.scored(model, rows), "scores")
        auc = self.area(scored)
        discard(scored)
        return auc


CURVE_SCHEMA = (
    "buffer_days int, roc_auc double, n_train bigint, n_val bigint, n_test bigint, "
    "type2_overlap_days int"
)


def leakage_curve(
    df: DataFrame,
    train_fn: TrainFn,
    evaluate_fn: EvalFn,
    horizon_days: int,
    buffers: Sequence[int] | None = None,
    boundaries: tuple[date, date] | None = None,
    uses_val: bool = True,
) -> DataFrame:
    """Test AUC against the purge buffer.

    The training rows are the same for every buffer, so a ``train_fn`` that ignores the
    validation rows (``uses_val=False``) is fitted once.
    """
    buffers = list(range(0, 2 * horizon_days + 1, 5)) if buffers is None else list(buffers)
    boundaries = boundaries or date_thirds(df)
    sizes = _buffer_sizes(df, buffers, boundaries)
    used = [b for b in sorted(buffers) if min(sizes[b][0], sizes[b][2]) >= MIN_AUDIT_ROWS]

    def fit(b):
        parts = buffered_split(df, b, boundaries)
        return train_fn(in_split(parts, "train"), in_split(parts, "val"))

    once = fit(used[0]) if used and not uses_val else None
    scored = None
    if once is not None and isinstance(evaluate_fn, ScoreArea):
        # Test sets of longer buffers are parts of that of the shortest one.
        test = in_split(buffered_split(df, used[0], boundaries), "test")
        scored = materialise(evaluate_fn.scored(once, test, "reference_date"), "scores")

    def run(b):
        if scored is not None:
            return evaluate_fn.area(in_split(buffered_split(scored, b, boundaries), "test"))
        model = fit(b) if uses_val else once
        return evaluate_fn(model, in_split(buffered_split(df, b, boundaries), "test"))

    areas = in_parallel(df.sparkSession, [partial(run, b) for b in used])
    if scored is not None:
        discard(scored)
    rows = []
    for b, auc in zip(used, areas, strict=True):
        if math.isnan(auc):
            continue
        n_train, n_val, n_test = sizes[b]
        rows.append(
            {
                "buffer_days": b,
                "roc_auc": auc,
                "n_train": n_train,
                "n_val": n_val,
                "n_test": n_test,
                "type2_overlap_days": max(0, horizon_days - b),
            }
        )
    return rows_to_frame(df.sparkSession, rows, CURVE_SCHEMA)


SPATIAL_SCHEMA = "block_size_km int, mean_auc double, std_auc double, n_folds int"


def spatial_leakage(
    df: DataFrame,
    train_fn: TrainFn,
    evaluate_fn: EvalFn,
    block_sizes_km: Sequence[int] = BLOCK_SIZES_KM,
    grid_km: int = 10,
    n_folds: int = 5,
    seed: int = 42,
    order=None,
) -> DataFrame:
    """Cross-validated AUC against the block size: mean and population deviation over folds.

    The folds of all block sizes are independent and run together.
    """
    jobs, tables = [], []

    def run(folded, fold):
        inside = F.col("fold") == fold
        test = folded.where(inside)
        val = in_split(df, "val") if "split" in df.columns else test
        train = folded.where(F.coalesce(~inside, F.lit(True)))
        return evaluate_fn(train_fn(train, val), test)

    for at, km in enumerate(sorted(block_sizes_km)):
        folded = materialise(spatial_cv(df, n_folds, km, grid_km, seed, order), "blocks")
        tables.append(folded)
        sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
        total = sum(sizes.values())
        used = sorted(
            f
            for f, n_test in sizes.items()
            if f is not None and min(n_test, total - n_test) >= MIN_AUDIT_ROWS
        )
        jobs += [(at, partial(run, folded, fold)) for fold in used]
    found = in_parallel(df.sparkSession, [job for _, job in jobs])
    for table in tables:
        discard(table)
    rows = []
    for at, km in enumerate(sorted(block_sizes_km)):
        aucs = [auc for (of, _), auc in zip(jobs, found, strict=True) if of == at]
        if aucs:
            mean = sum(aucs) / len(aucs)
            spread = math.sqrt(sum((a - mean) ** 2 for a in aucs) / len(aucs))
            rows.append(
                {
                    "block_size_km": km,
                    "mean_auc": mean,
                    "std_auc": spread,
                    "n_folds": len(aucs),
                }
            )
    return rows_to_frame(df.sparkSession, rows, SPATIAL_SCHEMA)


def occurrence_callbacks(
    features: Sequence[str], target: str, family: str, params: dict
) -> tuple[TrainFn, EvalFn]:
    """Train and evaluate functions of the audits for one model family."""

    def train(rows: DataFrame, _val: DataFrame):
        return fit_model(rows, family, "classification", features, target, params)

    return train, ScoreArea(target, tuple(features))


def source_ablation(
    df: DataFrame,
    family: str,
    task: str,
    params: dict,
    target: str,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Test metrics with one feature namespace left out at a time.

    Least-squares fits, which take no parameters, come from one set of cross products.
    """
    features = list(features or feature_columns(df))
    if family == "logreg" and task == "regression" and not params:
        curves = linear_curves(df, target, features, windows=())
        return curves.where("curve = 'source'").select(
            F.col("step").alias("removed_namespace"), *REGRESSION_NAMES
        ).orderBy("removed_namespace")
    train, test = in_split(df, "train"), in_split(df, "test")
    metric = classification_metrics if task == "classification" else regression_metrics

    def run(namespace, kept):
        model = fit_model(train, family, task, kept, target, params)
        scored = model.score(test.select(target, *kept)).select(target, "prediction")
        scored = materialise(scored, "ablation")
        return metric(scored, target, "prediction").select(
            F.lit(namespace).alias("removed_namespace"), "*"
        )

    kept = {
        namespace: [c for c in features if c not in removed]
        for namespace, removed in features_by_namespace(features).items()
    }
    jobs = [partial(run, n, names) for n, names in sorted(kept.items()) if names]
    return union_rows(in_parallel(df.sparkSession, jobs)).orderBy("removed_namespace")


def lookback_ablation(
    df: DataFrame,
    family: str,
    task: str,
    params: dict,
    horizon_days: int,
    windows: Sequence[int] = LOOKBACK_WINDOWS,
) -> DataFrame:
    """Test metrics with look-back windows capped at each value; capped columns are not read.

    Least-squares fits, which take no parameters, come from one set of cross products.
    """
    if family == "logreg" and task == "regression" and not params:
        known = df.where(F.col("y_sev_available") == 1)
        curves = linear_curves(known, windows=windows).where("curve = 'lookback'")
        return curves.select(F.col("step").cast("int").alias("max_window_days"), *REGRESSION_NAMES)
    frames = []
    for w in windows:
        run = fit_predict(max_window_projection(df, w), family, task, params, horizon_days)
        frames.append(run.metrics.select(F.lit(w).alias("max_window_days"), "*"))
    return union_rows(frames)


def linear_curves(
    df: DataFrame,
    target: str = "y_sev_dnbr",
    features: Sequence[str] | None = None,
    windows: Sequence[int] = LOOKBACK_WINDOWS,
    buffers: Sequence[int] = (),
    fold: str | None = None,
) -> DataFrame:
    """``curve, step, n, rmse, mae, r2, bias``: every least-squares refit of the audits at once.

    ``source`` leaves out one namespace at a time, ``lookback`` caps the windows, ``buffer`` tests
    the full fit on test rows that start so many days after the validation period ends,
    and ``fold`` fits without one value of the column ``fold`` and tests on it.  All fits come from one
    set of cross products: buffers and splits are unions of cells, a fold is the total less a cell.
    Missing features take the median of their training rows.  Fits without a training row, a known
    feature or a test row have no row here; rows without a target are not used.
    """
    features = list(features or feature_columns(df))
    rows = df.where(F.col(target).isNotNull())
    buffers = sorted(buffers)
    part = F.col("split").cast("string")
    if buffers:
        last = rows.where("split IN ('train', 'val')").agg(F.max("reference_date")).first()[0]
        days = F.datediff(F.col("reference_date").cast("date"), F.lit(last))
        reached = F.size(F.filter(F.array(*map(F.lit, buffers)), lambda b: b < days))
        part = F.when(part == "test", F.concat(F.lit("test"), reached.cast("string"))).otherwise(part)
    rows = rows.withColumn("_cell", F.concat_ws("/", part, F.coalesce(F.col(fold).cast("string"), F.lit("")) if fold else F.lit("")))
    rows = materialise(rows.select("_cell", "split", *([F.col(fold).alias("_fold")] if fold else []), target, *features), "cells")
    train = in_split(rows, "train")
    fill = medians(train, features)
    found = moments(rows, features, target, "_cell", fill)
    cells = sorted(found.cells)
    of = lambda name: [c for c in cells if c.split("/")[0].rstrip("0123456789") == name]
    trained, tested = found.total(of("train")), of("test")
    fits = {}

    def add(curve, step, products, names, values, test):
        if names and test and products[0, 0] > 0:
            try:
                fits[f"{curve}/{step}"] = (found.solve(products, names, values), test)
            except ValueError:
                return

    for namespace, removed in features_by_namespace(features).items():
        add("source", namespace, trained, [f for f in features if f not in removed], fill, tested)
    for w in windows:
        capped = [f for f in features if f in max_window_projection(rows, w).columns]
        add("lookback", w, trained, capped, fill, tested)
    for i, b in enumerate(buffers):
        reach = [c for c in tested if int(c.split("/")[0][4:]) > i]
        add("buffer", b, trained, features, fill, reach)
    if fold:
        every = found.total(cells)
        folds = sorted({c.split("/", 1)[1] for c in cells} - {""})
        values = in_parallel(
            df.sparkSession,
            [partial(medians, rows.where(~F.coalesce(F.col("_fold").cast("string") == f, F.lit(False))), features) for f in folds],
        )
        for f, own in zip(folds, values, strict=True):
            inside = [c for c in cells if c.split("/", 1)[1] == f]
            add("fold", f, every - found.total(inside), features, own, inside)
    name = F.split("fit", "/", 2)
    return score_fits(rows, features, target, "_cell", fits).select(
        F.get(name, F.lit(0)).alias("curve"), F.get(name, F.lit(1)).alias("step"), "n", "rmse", "mae", "r2", "bias"
    )


def model_comparison(
    df: DataFrame, families: dict[str, dict], task: str, horizon_days: int
) -> DataFrame:
    """Test metrics of several families, each with its own parameters."""
    frames = []
    for family, params in families.items():
        run = fit_predict(df, family, task, params, horizon_days)
        frames.append(run.metrics.select(F.lit(family).alias("model"), "*"))
    return union_rows(frames)


def severity_side_join(
    occurrence: DataFrame, naive: DataFrame, ipw: DataFrame
) -> DataFrame:
    """Occurrence rows with both severity predictions; the risk uses the weighted one."""
    key = ["patch_id", "reference_date"]
    out = occurrence.drop("severity_prediction", "risk_score")
    for name, side in (("naive", naive), ("ipw", ipw)):
        renamed = side.select(
            *key, F.col("severity_prediction").alias(f"{name}_severity_prediction")
        )
        out = out.join(renamed, key, "left")
    out = out.withColumn("severity_prediction", F.col("ipw_severity_prediction"))
    return out.withColumn(
        "risk_score",
        expected_risk(F.col("occurrence_prediction"), F.col("severity_prediction")),
    )


def severity_comparison(
    df: DataFrame,
    horizon_days: int,
    family: str,
    params: dict,
    severity_params: dict | None = None,
    propensity: str = "propensity_score",
) -> tuple[DataFrame, DataFrame]:
    """Naive against weighted severity: the comparison table and the merged predictions."""
    features = feature_columns(df)
    occurrence = oof_propensity(df, horizon_days, features, family, params)
    auc = scalars(occurrence.metrics)["roc_auc"]
    runs = {
        kind: severity_fit(
            occurrence.predictions, kind, features, family, severity_params or params, propensity
        )
        for kind in ("naive", "ipw")
    }
    table = union_rows(
        [
            run.metrics.select(
                F.lit(kind).alias("model"), F.lit(auc).alias("occurrence_roc_auc"), "*"
            )
            for kind, run in runs.items()
        ]
    )
    merged = severity_side_join(
        occurrence.predictions, runs["naive"].predictions, runs["ipw"].predictions
    )
    return table, merged


def conformal_experiment(
    df: DataFrame,
    horizon_days: int,
    family: str,
    params: dict,
    alpha: float = 0.1,
    threshold: float = 0.5,
    severity_params: dict | None = None,
    min_rows: int = MIN_CALIBRATION_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Calibrated risk intervals: coverage with alert summary, and the test intervals."""
    carved = calibration_carve(df, 0.5, min_rows, ("y_sev_available", "y_sev_dnbr"))
    features = feature_columns(carved)
    occurrence = oof_propensity(carved, horizon_days, features, family, params)
    severity = severity_fit(
        occurrence.predictions, "ipw", features, family, severity_params or params
    )
    rows = severity.predictions.withColumn(
        "risk_score",
        expected_risk(F.col("propensity_score"), F.col("severity_prediction")),
    )
    fitted = conformal.calibrate(in_split(rows, "calibration"), "risk_score", "y_sev_dnbr", alpha)
    sets = conformal.intervals(in_split(rows, "test"), fitted, "risk_score")
    summary = scalars(conformal.coverage(sets, fitted, "y_sev_dnbr")) | scalars(
        conformal.confident_alerts(sets, threshold)
    )
    return metrics_row(df.sparkSession, summary), sets


def leakage_report(
    panel: DataFrame,
    split: DataFrame,
    horizon_days: int,
    family: str,
    params: dict,
    boundaries: tuple[date, date],
    grid_km: int = 10,
    buffers: Sequence[int] | None = None,
    block_sizes_km: Sequence[int] = BLOCK_SIZES_KM,
    folder: str | None = None,
    callbacks: tuple[TrainFn, EvalFn] | None = None,
    order=None,
) -> tuple[DataFrame, DataFrame]:
    """Temporal and spatial leakage curves, optionally written as CSV tables.

    ``callbacks`` replaces the model family, ``order`` the hashed order of the blocks.
    """
    if callbacks is None:
        target = occurrence_column(horizon_days)
        callbacks = occurrence_callbacks(feature_columns(split), target, family, params)
    train_fn, evaluate_fn = callbacks
    temporal = leakage_curve(
        panel, train_fn, evaluate_fn, horizon_days, buffers, boundaries, uses_val=False
    )
    spatial = spatial_leakage(split, train_fn, evaluate_fn, block_sizes_km, grid_km, order=order)
    if folder is not None:
        for name, table in (("temporal", temporal), ("spatial", spatial)):
            table.coalesce(1).write.mode("overwrite").option("header", True).csv(
                f"{folder}/leakage_curve_{name}"
            )
    return temporal, spatial


def curve_drop(curve: DataFrame, order: str, value: str) -> float:
    """First minus last value of a curve; NaN with fewer than two points."""
    points = [r[0] for r in curve.orderBy(order).select(value).collect()]
    return points[0] - points[-1] if len(points) >= 2 else float("nan")


def contribution_summary(
    panel: DataFrame,
    split: DataFrame,
    horizon_days: int,
    family: str,
    params: dict,
    boundaries: tuple[date, date],
    grid_km: int = 10,
    buffers: Sequence[int] | None = None,
    block_sizes_km: Sequence[int] = BLOCK_SIZES_KM,
    min_rows: int = MIN_CALIBRATION_ROWS,
) -> DataFrame:
    """Model variants and post-hoc diagnostics in one table."""
    spark = split.sparkSession
    carved = calibration_carve(split, 0.5, min_rows, ("y_sev_available", "y_sev_dnbr"))
    variants, merged = severity_comparison(carved, horizon_days, family, params)
    named = {"naive": "baseline", "ipw": "+ipw"}
    is_ipw = F.col("model") == "ipw"
    predictive = variants.select(
        F.when(is_ipw, named["ipw"]).otherwise(named["naive"]).alias("variant"),
        F.lit("model_variant").alias("row_type"),
        is_ipw.alias("uses_ipw"),
        "occurrence_roc_auc",
        F.col("rmse").alias("severity_rmse"),
        F.col("mae").alias("severity_mae"),
        "risk_spearman",
    )
    # The merged table is a join of wide predictions; the intervals read it several times.
    known = merged.where(F.col("y_sev_available") == 1).select("split", "risk_score", "y_sev_dnbr")
    known = materialise(known, "known")
    fitted = conformal.calibrate(in_split(known, "calibration"), "risk_score", "y_sev_dnbr")
    sets = conformal.intervals(in_split(known, "test"), fitted, "risk_score")
    cover = scalars(conformal.coverage(sets, fitted, "y_sev_dnbr"))
    temporal, spatial = leakage_report(
        panel, carved, horizon_days, family, params, boundaries, grid_km, buffers, block_sizes_km
    )
    common = {
        "row_type": "posthoc_diagnostic",
        "reference_variant": "+ipw",
        "conformal_coverage": cover["empirical_coverage"],
    }
    diagnostics = [
        {
            "variant": "conformal_risk_intervals",
            **common,
            "conformal_width": cover["mean_interval_width"],
        },
        {
            "variant": "leakage_audit",
            **common,
            "temporal_leakage_auc_drop": curve_drop(temporal, "buffer_days", "roc_auc"),
            "spatial_leakage_auc_drop": curve_drop(spatial, "block_size_km", "mean_auc"),
        },
    ]
    return union_rows([predictive, *[metrics_row(spark, d) for d in diagnostics]])


def evaluate_predictions(
    predictions_path: str,
    task: str,
    horizon_days: int,
    spark,
    generate: Callable[[], DataFrame] | None = None,
    tie_break=(),
) -> DataFrame:
    """Metrics of stored predictions; when there are none they are generated and stored."""
    try:
        predictions = spark.read.parquet(predictions_path)
    except AnalysisException as error:
        if generate is None or not absent(error):
            raise
        generate().write.mode("overwrite").parquet(predictions_path)
        predictions = spark.read.parquet(predictions_path)
    test, target = in_split(predictions, "test"), occurrence_column(horizon_days)
    if task == "risk":
        lacking = sorted({target, "y_sev_dnbr"} - set(test.columns))
        if lacking:
            raise ValueError(f"risk evaluation needs {', '.join(lacking)}")
        rows, risk = with_risk(test)
        return risk_ranking(rows, risk, "y_sev_dnbr", target, tie_break)
    if task == "severity":
        return regression_metrics(test, "y_sev_dnbr", "prediction")
    return classification_metrics(test, target, "prediction")


def run_experiment(
    labelled: DataFrame,
    config: DataConfig,
    task: str,
    family: str,
    params: dict,
    severity_family: str | None = None,
    severity_params: dict | None = None,
) -> RunResult:
    """Split a labelled panel and fit the model of the task."""
    split = materialise(split_panel(labelled, config), "split")
    horizon = config.temporal.horizon_days
    if task == "risk":
        return fit_risk(
            split, horizon, None, family, params, severity_family, severity_params
        )
    kind = "classification" if task == "occurrence" else "regression"
    return fit_predict(split, family, kind, params, horizon)

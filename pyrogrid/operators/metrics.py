"""Evaluation metrics: classification, regression, calibration, ranking, inverse propensity.

Every metric set is one row per group.  Threshold metrics and calibration bins are one flat
aggregation; ROC statistics come from per-score counts with prefix sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.functions.ordered import attach_by_value, midranks, ordered_prefix
from pyrogrid.functions.scalars import clip
from pyrogrid.functions.special import correlation_p_value

# Shares of the ranked population that are inspected.
RANKING_FRACTIONS = (0.10, 0.20)
MIN_EVALUABLE = 10
FEW_EVALUABLE = "fewer than 10 rows with a known severity: no conditional ranking"


def _nan() -> Column:
    return F.lit(float("nan"))


def ratio_or(numerator: Column, denominator: Column, default: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), default)


def score_table(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Distinct scores with (weighted) positive and negative counts and the counts below."""
    w = F.lit(1) if weight is None else weight
    hit = F.col(y) == 1
    return ordered_prefix(
        df,
        [score],
        {"pos": F.when(hit, w).otherwise(F.lit(0)), "neg": F.when(hit, F.lit(0)).otherwise(w)},
        by=by,
    )


def roc_from_table(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tie-exact ROC area and step-wise average precision; NaN when a class is missing."""
    pos, neg = F.col("pos_total"), F.col("neg_total")
    caught = pos - F.col("pos_below")
    raised = caught + neg - F.col("neg_below")
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)
    gain = F.col("pos") * F.try_divide(caught, raised)
    total = [F.max(pos).alias("n_pos"), F.max(neg).alias("n_neg")]
    sums = table.groupBy(*by).agg(*total, F.sum(wins).alias("wins"), F.sum(gain).alias("gain"))
    defined = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    auc = F.try_divide(F.col("wins"), F.col("n_pos").cast("double") * F.col("n_neg"))
    return sums.select(
        *by,
        F.when(defined, auc).otherwise(_nan()).alias("roc_auc"),
        F.when(defined, F.try_divide(F.col("gain"), F.col("n_pos")))
        .otherwise(_nan())
        .alias("pr_auc"),
    )


def roc_metrics(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    return roc_from_table(score_table(df, y, score, by, weight), by)


def bin_edges(n_bins: int) -> list[float]:
    """Edges i * (1 / n), the last one exactly 1: 0.3 * 10 lies just above 0.3."""
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def _threshold_aggregates(y: Column, p: Column, threshold: float) -> dict[str, Column]:
    hit = p >= threshold
    return {
        "tp": F.count_if(hit & (y == 1)),
        "fp": F.count_if(hit & (y != 1)),
        "fn": F.count_if(~hit & (y == 1)),
        "brier": F.avg((p - y) * (p - y)),
        "n": F.count(F.lit(1)),
    }


def _calibration_aggregates(y: Column, p: Column, n_bins: int) -> dict[str, Column]:
    edges, out = bin_edges(n_bins), {}
    for i in range(n_bins):
        upper = p <= edges[i + 1] if i == n_bins - 1 else p < edges[i + 1]
        inside = (p >= edges[i]) & upper
        out[f"gap_{i}"] = F.abs(F.sum(F.when(inside, p - y)))
    return out


def _calibration_error(n_bins: int) -> Column:
    """Sum over bins of share * |confidence - accuracy|, which is |sum(p - y)| / n."""
    total = F.lit(0.0)
    for i in range(n_bins):
        total = total + F.coalesce(F.col(f"gap_{i}"), F.lit(0.0))
    return F.try_divide(total, F.col("n"))


def threshold_metrics(
    df: DataFrame,
    y: str,
    p: str,
    threshold: float = 0.5,
    by: Sequence[str] = (),
    n_bins: int = 10,
) -> DataFrame:
    """F1, precision and recall at the threshold (0 when undefined), Brier score and ECE."""
    label, prob = F.col(y), F.col(p)
    aggs = _threshold_aggregates(label, prob, threshold) | _calibration_aggregates(
        label, prob, n_bins
    )
    sums = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    tp, fp, fn, zero = F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0.0)
    empty = F.col("n") == 0
    values = {
        "f1": ratio_or(2 * tp, 2 * tp + fp + fn, zero),
        "precision": ratio_or(tp, tp + fp, zero),
        "recall": ratio_or(tp, tp + fn, zero),
        "brier": F.col("brier"),
        "ece": _calibration_error(n_bins),
    }
    return sums.select(
        *by, "n", *[F.when(empty, _nan()).otherwise(c).alias(n) for n, c in values.items()]
    )


def calibration_error(
    df: DataFrame, y: str, p: str, n_bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    aggs = _calibration_aggregates(F.col(y), F.col(p), n_bins) | {"n": F.count(F.lit(1))}
    sums = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return sums.select(*by, _calibration_error(n_bins).alias("ece"))


METRIC_NAMES = ("roc_auc", "pr_auc", "f1", "precision", "recall", "brier", "ece")


def classification_metrics(
    df: DataFrame, y: str, p: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """All classification metrics, one row per group; an empty input yields NaN."""
    flat = threshold_metrics(df, y, p, threshold, by)
    roc = roc_metrics(df, y, p, by)
    if by:
        return flat.join(roc, list(by), "left").select(*by, *METRIC_NAMES)
    one = F.lit(1).alias("_one")
    return flat.select("*", one).join(roc.select("*", one), "_one").select(*METRIC_NAMES)


def regression_metrics(
    df: DataFrame, y: str, pred: str, by: Sequence[str] = ()
) -> DataFrame:
    """RMSE, MAE, R2 = 1 - SSres / SStot (NaN below two rows or without variance) and bias."""
    error = F.col(pred) - F.col(y)
    sums = df.groupBy(*by).agg(
        F.count(F.col(y)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("var"),
        F.avg(error).alias("bias"),
    )
    r2 = F.when(
        (F.col("n") >= 2) & (F.col("var") > 0), 1 - F.try_divide(F.col("mse"), F.col("var"))
    ).otherwise(_nan())
    return sums.select(
        *by, F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "bias"
    )


def metrics_by_split(
    df: DataFrame, y: str, prediction: str, task: str, splits: Sequence[str] = ("test",)
) -> DataFrame:
    """Metrics of the chosen splits, all in the same jobs."""
    rows = df.where(F.col("split").isin(*splits))
    if task == "classification":
        return classification_metrics(rows, y, prediction, by=["split"])
    return regression_metrics(rows, y, prediction, by=["split"])


def severity_evaluable(df: DataFrame, target: str = "y_sev_dnbr") -> DataFrame:
    """Regression metrics over the test rows whose severity is known."""
    pred = next((c for c in ("severity_prediction", "prediction") if c in df.columns), None)
    if pred is None:
        raise ValueError("no severity_prediction or prediction column")
    rows = df.where((F.col("split") == "test") & (F.col("y_sev_available") == 1))
    return regression_metrics(rows, target, pred)


def expected_risk(probability: Column, severity: Column) -> Column:
    return probability * severity


def with_risk(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame with a risk column, and its name: stored, or probability times severity."""
    for name in ("risk_score", "risk_prediction"):
        if name in df.columns:
            return df, name
    prob = next(
        (c for c in ("occurrence_prediction", "propensity_score") if c in df.columns), None
    )
    if prob is None or "severity_prediction" not in df.columns:
        raise ValueError("no risk column and nothing to derive it from")
    risk = expected_risk(F.col(prob), F.col("severity_prediction"))
    return df.withColumn("risk_score", risk), "risk_score"


def spearman(df: DataFrame, a: str, b: str) -> tuple[float, float, int]:
    """Rank correlation, its two-sided p-value and the number of complete pairs.

    Equal pairs are collapsed before their ranks are attached, and frequent values never shuffle.
    """
    pairs = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("pairs"))
    complete = df.dropna(subset=[a, b])
    ranked = attach_by_value(pairs, midranks(complete, a, "ra"), a, "n", "n_total")
    ranked = attach_by_value(ranked, midranks(complete, b, "rb"), b, "n", "n_total")
    w, ra, rb = F.col("pairs"), F.col("ra"), F.col("rb")
    # Ranks average (n + 1) / 2; centring them keeps the sums small.
    n = complete.count()
    mid = (n + 1) / 2
    s = ranked.agg(
        F.sum(w * (ra - mid) * (rb - mid)),
        F.sum(w * (ra - mid) * (ra - mid)),
        F.sum(w * (rb - mid) * (rb - mid)),
    ).first()
    if n < 2 or not s[1] or not s[2]:
        return float("nan"), float("nan"), n
    rho = s[0] / (s[1] * s[2]) ** 0.5
    return rho, correlation_p_value(rho, n), n


def _at_rank(df: DataFrame, key: Column, k: int):
    """Value of ``key`` at 1-based rank k with the rows below it and the rows sharing it."""
    table = ordered_prefix(
        df.select(key.alias("_key")), ["_key"], {"n": F.lit(1)}
    )
    hit = table.where((F.col("n_below") < k) & (F.col("n_below") + F.col("n") >= k)).first()
    return hit["_key"], hit["n_below"], hit["n"]


def top_k(df: DataFrame, keys: Sequence[Column], k: int) -> tuple[Column, Column, int]:
    """Split "the first k rows by ``keys`` ascending" into two row predicates.

    Rows matching the first are in for sure.  Of the rows matching the second, which share every
    key, the returned number is in.  Only keys that still tie at rank k are looked at further.
    """
    certain, tied, rest = F.lit(False), F.lit(True), k
    for key in keys:
        value, below, n = _at_rank(df.where(tied), key, rest)
        certain = certain | (tied & (key < F.lit(value)))
        tied = tied & (key == F.lit(value))
        rest -= below
        if rest == n:
            break
    return certain, tied, rest


def risk_ranking(
    df: DataFrame,
    risk: str,
    severity: str,
    occurrence: str,
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """Top-k capture over the whole population and rank correlation over realised events.

    Rows are inspected by falling risk; ``tie_break`` columns (numeric) order equal risks, then
    occurrence and severity do.
    """
    spark = df.sparkSession
    occ = F.coalesce((F.col(occurrence) == 1).cast("int"), F.lit(0))
    sev = F.coalesce(F.col(severity).cast("double"), F.lit(0.0))
    evaluable = (F.col(occurrence) == 1) & F.col(severity).isNotNull()
    whole = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(sev).alias("severity"),
        F.count_if(evaluable).alias("evaluable"),
    ).first()
    n, total = whole["n"], whole["severity"]
    out: dict = {"n_test": n}
    # Rows without a risk come last, as in a sort that puts missing values at its end.
    down = -F.col(risk).cast("double")
    down = F.when(down.isNull() | F.isnan(down), F.lit(float("inf"))).otherwise(down)
    keys = [down, *tie_break, occ, sev]
    if n:
        aggs, plan = [], []
        for fraction in RANKING_FRACTIONS:
            k = max(1, round(fraction * n))
            certain, tied, rest = top_k(df, keys, k)
            pct = round(fraction * 100)
            plan.append((pct, k, rest))
            aggs += [
                F.sum(F.when(certain, occ)).alias(f"o{pct}"),
                F.sum(F.when(certain, sev)).alias(f"s{pct}"),
                # Rows that tie to the end are alike, so their mean stands for each of them.
                F.avg(F.when(tied, occ)).alias(f"to{pct}"),
                F.avg(F.when(tied, sev)).alias(f"ts{pct}"),
            ]
        row = df.agg(*aggs).first()
        for pct, k, rest in plan:
            hits = (row[f"o{pct}"] or 0) + rest * row[f"to{pct}"]
            caught = (row[f"s{pct}"] or 0.0) + rest * row[f"ts{pct}"]
            out[f"precision_at_{pct}pct"] = float(hits / k)
            out[f"severity_capture_at_{pct}pct"] = (
                float(caught / total) if total > 0 else float("nan")
            )
    out["n_evaluable"] = whole["evaluable"]
    if whole["evaluable"] < MIN_EVALUABLE:
        out["warning"] = FEW_EVALUABLE
    else:
        rho, p, _ = spearman(df.where(evaluable), risk, severity)
        out["spearman_rho"], out["spearman_p"] = rho, p
    return spark.createDataFrame([out], schema=_row_schema(out))


def _row_schema(row: dict) -> str:
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    return ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in row.items())


def metrics_row(spark, row: dict) -> DataFrame:
    """A dict of scalars as a one-row frame."""
    return spark.createDataFrame([row], schema=_row_schema(row))


def observed_outcome(
    treated: Column, treatment: Column, control: Column | None = None
) -> Column:
    return treatment * treated + (1 - treatment) * (F.lit(0.0) if control is None else control)


def ipw_mean(
    df: DataFrame, outcome: str, treatment: str, propensity: str, clip_min: float = 1e-3
) -> DataFrame:
    """Inverse-propensity estimate of the mean treated outcome."""
    weight = F.col(treatment) / clip(F.col(propensity), clip_min, 1.0)
    return df.agg(F.avg(weight * F.col(outcome)).alias("ipw_mean"))

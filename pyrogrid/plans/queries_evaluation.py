"""Queries over splits, metrics, resampling and conformal intervals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pyrogrid.functions.ordered import ordered_prefix
from pyrogrid.operators import conformal, losses, metrics, resampling, roc, splits
from pyrogrid.operators.models import in_split, ipw_weights
from pyrogrid.plans import audits
from pyrogrid.plans import inputs as T
from pyrogrid.plans.inputs import DATA, HORIZON, SPLIT, with_tables
from pyrogrid.plans.registry import KEY, fields, query
from pyrogrid.session import scratch_path

Y, P, P2 = "y_occ_30d", "occurrence_prediction", "second_prediction"
SEV, SEV_HAT = "y_sev_dnbr", "severity_prediction"

# --- splits


def _label_case(day: str, buffer: int, train: str, val: str, test: str | None) -> str:
    last = f" AND {day} <= {test}" if test else ""
    return (
        f"CASE WHEN {day} <= {train} THEN 'train' "
        f"WHEN {day} > {train} + {buffer} AND {day} <= {val} THEN 'val' "
        f"WHEN {day} > {val} + {buffer}{last} THEN 'test' ELSE 'embargo' END"
    )


DATES = tuple(f"DATE '{d}'" for d in (SPLIT.train_end, SPLIT.val_end, SPLIT.test_end))
TEMPORAL_CASE = _label_case("reference_date", SPLIT.buffer_days, *DATES)
SPLIT_SQL = f"SELECT patch_id, reference_date, {TEMPORAL_CASE} AS split FROM skeleton"


@query("temporal_split", f"{KEY} split", with_tables(SPLIT_SQL, "skeleton"))
def by_date(spark, sf):
    return splits.temporal_split(T.skeleton(spark, sf), SPLIT, HORIZON)


@query(
    "validate_buffer",
    "split first:d last:d",
    with_tables(
        "SELECT split, min(reference_date) AS first, max(reference_date) AS last "
        f"FROM ({SPLIT_SQL}) WHERE split <> 'embargo' GROUP BY split",
        "skeleton",
    ),
)
def buffer_ends(spark, sf):
    out = splits.temporal_split(T.skeleton(spark, sf), SPLIT, HORIZON, validate=False)
    splits.validate_buffer(out, HORIZON)
    return (
        out.where(F.col("split") != "embargo")
        .groupBy("split")
        .agg(F.min("reference_date").alias("first"), F.max("reference_date").alias("last"))
    )


def arithmetic_order(block):
    """Block order that SQL can compute too; the default order is a hash."""
    row = F.split_part(block, F.lit("_"), F.lit(1)).cast("bigint")
    col = F.split_part(block, F.lit("_"), F.lit(2)).cast("bigint")
    return F.pmod(row * 7919 + col * 104729 + 1302, F.lit(10007))


def _ranked_sql(per_block: int, source: str) -> str:
    block = f"concat(patch_row // {per_block}, '_', patch_col // {per_block})"
    return f"""SELECT block_id, row_number() OVER (ORDER BY o, block_id) - 1 AS position,
      count(*) OVER () AS blocks FROM (SELECT DISTINCT {block} AS block_id,
        ((patch_row // {per_block}) * 7919 + (patch_col // {per_block}) * 104729 + 1302) % 10007
        AS o FROM {source})"""


def _spatial_sql(source: str) -> str:
    return f"""SELECT s.*, concat(patch_row // 2, '_', patch_col // 2) AS block_id,
      CASE WHEN position < greatest(1, blocks // 5) THEN 'test'
           WHEN position < 2 * greatest(1, blocks // 5) THEN 'val' ELSE 'train' END
      AS spatial_split FROM {source} s JOIN ({_ranked_sql(2, source)}) b
      ON b.block_id = concat(patch_row // 2, '_', patch_col // 2)"""


@query(
    "spatial_blocks",
    "patch_id block_id",
    with_tables(
        "SELECT patch_id, concat(patch_row // 5, '_', patch_col // 5) AS block_id FROM grid", "grid"
    ),
)
def blocks(spark, sf):
    return splits.spatial_blocks(T.grid(spark, sf).select("patch_id"), 50, 10)


@query(
    "spatial_split",
    "patch_id block_id spatial_split",
    with_tables(_spatial_sql("grid"), "grid"),
)
def by_block(spark, sf):
    rows = splits.spatial_blocks(T.grid(spark, sf), 20, 10)
    return splits.spatial_split(rows, 5, order=arithmetic_order)


SPATIOTEMPORAL_SQL = f"""SELECT patch_id, reference_date, block_id, spatial_split,
  CASE WHEN ({TEMPORAL_CASE}) = spatial_split THEN spatial_split ELSE 'embargo' END AS split
  FROM ({_spatial_sql("skeleton")})"""


@query(
    "spatiotemporal_split",
    f"{KEY} block_id spatial_split split",
    with_tables(SPATIOTEMPORAL_SQL, "skeleton"),
)
def by_date_and_block(spark, sf):
    return splits.spatiotemporal_split(T.skeleton(spark, sf), DATA, order=arithmetic_order)


@query(
    "split_summary",
    "split count:i nunique:i",
    with_tables(
        "SELECT split, count(patch_id) AS count, count(DISTINCT patch_id) AS nunique "
        f"FROM ({SPATIOTEMPORAL_SQL}) GROUP BY split",
        "skeleton",
    ),
)
def summary_of_splits(spark, sf):
    return splits.split_summary(by_date_and_block(spark, sf))


FOLD_SQL = """CASE WHEN position < blocks % 5 * (blocks // 5 + 1)
  THEN position // (blocks // 5 + 1)
  ELSE blocks % 5 + (position - blocks % 5 * (blocks // 5 + 1)) // (blocks // 5) END"""


def _cv_sql(per_block: int, source: str) -> str:
    return f"""SELECT s.*, {FOLD_SQL} AS fold FROM {source} s
      JOIN ({_ranked_sql(per_block, source)}) b
      ON b.block_id = concat(patch_row // {per_block}, '_', patch_col // {per_block})"""


@query("spatial_cv", "patch_id fold:i", with_tables(_cv_sql(1, "grid"), "grid"))
def cross_validation(spark, sf):
    return splits.spatial_cv(T.grid(spark, sf), 5, 10, 10, order=arithmetic_order)


@query(
    "buffered_split",
    f"{KEY} split",
    with_tables(
        f"""SELECT patch_id, reference_date, {_label_case(
            "reference_date", 15, "train_end", "val_end", None)} AS split FROM skeleton,
        (SELECT max(CASE WHEN r = n // 3 THEN d END) AS train_end,
                max(CASE WHEN r = 2 * n // 3 THEN d END) AS val_end
         FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n
               FROM (SELECT DISTINCT reference_date AS d FROM skeleton)))""",
        "skeleton",
    ),
)
def thirds(spark, sf):
    return splits.buffered_split(T.skeleton(spark, sf), 15)


CARVED_SQL = """SELECT *, CASE WHEN split = 'val' AND reference_date >= (
    SELECT max(CASE WHEN r = floor(n * 0.5) + 1 THEN d END) FROM (
      SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM (
        SELECT DISTINCT reference_date AS d FROM scored
        WHERE split = 'val' AND y_sev_available = 1 AND y_sev_dnbr IS NOT NULL)))
  THEN 'calibration' ELSE split END AS part FROM scored"""


@query(
    "calibration_carve",
    "part rows:i known:i first:d last:d",
    with_tables(
        "SELECT part, count(*) AS rows, sum(y_sev_available) AS known, "
        f"min(reference_date) AS first, max(reference_date) AS last FROM ({CARVED_SQL}) "
        "GROUP BY part",
        "scored",
    ),
)
def carve(spark, sf):
    out = splits.calibration_carve(T.scored(spark, sf), 0.5, 20, ("y_sev_available", SEV))
    return out.groupBy(F.col("split").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("y_sev_available").alias("known"),
        F.min("reference_date").alias("first"),
        F.max("reference_date").alias("last"),
    )


@query(
    "group_folds",
    "patch_id fold:i rows:i",
    with_tables(
        """SELECT patch_id, (row_number() OVER (ORDER BY rows DESC, patch_id) - 1) % 5 AS fold,
        rows FROM (SELECT patch_id, count(*) AS rows FROM scored WHERE split = 'train'
                   GROUP BY patch_id)""",
        "scored",
    ),
)
def folds(spark, sf):
    train = in_split(T.scored(spark, sf), "train")
    return (
        splits.group_folds(train, 5).groupBy("patch_id", "fold").agg(F.count(F.lit(1)).alias("rows"))
    )


# --- ordered prefix and classification metrics


@query(
    "ordered_prefix",
    "occurrence_prediction:f n:i n_below:i n_total:i",
    with_tables(
        f"""SELECT {P}, n, sum(n) OVER (ORDER BY {P}) - n AS n_below, sum(n) OVER () AS n_total
        FROM (SELECT {P}, count(*) AS n FROM scored GROUP BY {P})""",
        "scored",
    ),
)
def prefix(spark, sf):
    """In small buckets, so that several of them are stitched together."""
    return ordered_prefix(T.scored(spark, sf), [P], {"n": F.lit(1)}, bucket_rows=2_000)


def _counts_sql(score: str, by: str = "", source: str = "scored") -> str:
    """Per-score counts with the counts below and the totals."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    inner = (
        f"SELECT {lead}{score} AS s, sum({Y}) AS pos, count(*) - sum({Y}) AS neg FROM {source} "
        f"GROUP BY {lead}{score}"
    )
    return (
        f"SELECT *, sum(pos) OVER ({part} ORDER BY s) - pos AS pos_below, "
        f"sum(neg) OVER ({part} ORDER BY s) - neg AS neg_below, "
        f"sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS q FROM ({inner})"
    )


AUC_SQL = "sum(pos * (neg_below + neg / 2.0::DOUBLE)) / max(p) / max(q)"
AP_SQL = (
    "sum(pos * (p - pos_below) / CAST(p - pos_below + q - neg_below AS DOUBLE)) / max(p)"
)


@query(
    "roc_auc",
    "split roc_auc:f",
    with_tables(
        f"SELECT split, {AUC_SQL} AS roc_auc FROM ({_counts_sql(P, 'split')}) GROUP BY split",
        "scored",
    ),
)
def roc_auc(spark, sf):
    return metrics.roc_metrics(T.scored(spark, sf), Y, P, by=["split"])


@query(
    "pr_auc",
    "pr_auc:f",
    with_tables(f"SELECT {AP_SQL} AS pr_auc FROM ({_counts_sql(P)})", "scored"),
)
def pr_auc(spark, sf):
    return metrics.roc_metrics(T.scored(spark, sf), Y, P)


THRESHOLD_SQL = f"""
  2.0 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp)::DOUBLE AS precision,
  tp / (tp + fn)::DOUBLE AS recall, brier FROM (
  SELECT {{by}} count_if({P} >= 0.5 AND {Y} = 1) AS tp, count_if({P} >= 0.5 AND {Y} = 0) AS fp,
    count_if({P} < 0.5 AND {Y} = 1) AS fn, avg(({P} - {Y}) * ({P} - {Y})) AS brier
  FROM scored {{group}})"""


@query(
    "threshold_metrics",
    "f1:f precision:f recall:f brier:f",
    with_tables(f"SELECT {THRESHOLD_SQL.format(by='', group='')}", "scored"),
)
def thresholds(spark, sf):
    return metrics.threshold_metrics(T.scored(spark, sf), Y, P)


def _ece_sql(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    edges = " ".join(f"WHEN {P} < {i}::DOUBLE * 0.1::DOUBLE THEN {i - 1}" for i in range(1, 10))
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (
        f"SELECT {lead}sum(n / t::DOUBLE * abs(conf - acc)) AS ece FROM (SELECT *, "
        f"sum(n) OVER ({part}) AS t FROM (SELECT {lead}CASE {edges} ELSE 9 END AS bin, "
        f"count(*) AS n, avg({P}) AS conf, avg({Y}) AS acc FROM scored GROUP BY {lead}bin)) {group}"
    )


@query("calibration_error", "ece:f", with_tables(_ece_sql(), "scored"))
def ece(spark, sf):
    return metrics.calibration_error(T.scored(spark, sf), Y, P)


@query(
    "safe_metrics_by_split",
    f"split {fields(metrics.METRIC_NAMES)}",
    with_tables(
        f"""SELECT * FROM (SELECT split, {AUC_SQL} AS roc_auc, {AP_SQL} AS pr_auc
          FROM ({_counts_sql(P, 'split')}) GROUP BY split)
        JOIN (SELECT split, {THRESHOLD_SQL.format(by='split,', group='GROUP BY split')})
          USING (split)
        JOIN ({_ece_sql('split')}) USING (split) WHERE split <> 'embargo'""",
        "scored",
    ),
)
def all_metrics(spark, sf):
    return metrics.metrics_by_split(
        T.scored(spark, sf), Y, P, "classification", ("train", "val", "test")
    )


REGRESSION_SQL = f"""sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
  1 - avg(e * e) / var_pop({SEV}) AS r2, avg(e) AS bias
  FROM (SELECT *, {SEV_HAT} - {SEV} AS e FROM scored WHERE y_sev_available = 1)"""


@query(
    "regression_metrics",
    "split rmse:f mae:f r2:f bias:f",
    with_tables(f"SELECT split, {REGRESSION_SQL} GROUP BY split", "scored"),
)
def regression(spark, sf):
    known = T.scored(spark, sf).where(F.col("y_sev_available") == 1)
    return metrics.regression_metrics(known, SEV, SEV_HAT, by=["split"])


@query(
    "severity_evaluable",
    "rmse:f mae:f r2:f bias:f",
    with_tables(f"SELECT {REGRESSION_SQL} WHERE split = 'test'", "scored"),
)
def evaluable(spark, sf):
    return metrics.severity_evaluable(T.scored(spark, sf))


# --- risk ranking, rank correlation, DeLong


def _midrank_sql(column: str, where: str) -> str:
    return f"""SELECT *, rank() OVER (ORDER BY {column})
      + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE AS r_{column}
      FROM ({where})"""


def _spearman_sql(a: str, b: str, where: str) -> str:
    inner = _midrank_sql(b, _midrank_sql(a, where))
    return f"SELECT corr(r_{a}, r_{b}) AS rho FROM ({inner})"


EVALUABLE_SQL = f"SELECT * FROM scored WHERE {Y} = 1 AND {SEV} IS NOT NULL"


@query(
    "spearman",
    "spearman_rho:f n:i",
    with_tables(
        f"SELECT rho AS spearman_rho, (SELECT count(*) FROM ({EVALUABLE_SQL})) AS n "
        f"FROM ({_spearman_sql('risk_score', SEV, EVALUABLE_SQL)})",
        "scored",
    ),
)
def rank_correlation(spark, sf):
    known = T.scored(spark, sf).where((F.col(Y) == 1) & F.col(SEV).isNotNull())
    rho, p, n = metrics.spearman(known, "risk_score", SEV)
    return metrics.metrics_row(spark, {"spearman_rho": rho, "spearman_p": p, "n": n})


RANKING = (
    "n_test:i precision_at_10pct:f severity_capture_at_10pct:f precision_at_20pct:f "
    "severity_capture_at_20pct:f n_evaluable:i spearman_rho:f"
)


def _ranking_sql(where: str) -> str:
    top = ", ".join(
        f"avg(CASE WHEN place <= k{p} THEN {Y} END) AS precision_at_{p}pct, "
        f"sum(CASE WHEN place <= k{p} THEN coalesce({SEV}, 0) END) / sum(coalesce({SEV}, 0)) "
        f"AS severity_capture_at_{p}pct"
        for p in (10, 20)
    )
    rho = _spearman_sql("risk_score", SEV, f"{EVALUABLE_SQL} AND {where}")
    return f"""SELECT count(*) AS n_test, {top},
      count_if({Y} = 1 AND {SEV} IS NOT NULL) AS n_evaluable, ({rho}) AS spearman_rho
      FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, reference_date, patch_key,
          {Y}, coalesce({SEV}, 0)) AS place,
        greatest(1, round_even(0.1::DOUBLE * count(*) OVER (), 0)) AS k10,
        greatest(1, round_even(0.2::DOUBLE * count(*) OVER (), 0)) AS k20
      FROM scored WHERE {where})"""


TIES = ("reference_date", "patch_key")


def _tie_break():
    return [F.unix_date("reference_date"), F.col("patch_key")]


@query("risk_ranking", RANKING, with_tables(_ranking_sql("split = 'test'"), "scored"))
def ranking(spark, sf):
    test = in_split(T.scored(spark, sf), "test")
    return metrics.risk_ranking(test, "risk_score", SEV, Y, _tie_break())


@query("evaluate_predictions", RANKING, with_tables(_ranking_sql("split = 'test'"), "scored"))
def stored_predictions(spark, sf):
    """Predictions are generated and stored at first, then evaluated from storage."""
    path = scratch_path(spark, "predictions")
    return audits.evaluate_predictions(
        path, "risk", HORIZON, spark, lambda: T.scored(spark, sf), _tie_break()
    )


@query(
    "expected_risk",
    "l_orderkey:i l_linenumber:i l_partkey:i risk_score:f",
    with_tables("SELECT l_orderkey, l_linenumber, l_partkey, risk_score FROM scored", "scored"),
)
def risk(spark, sf):
    rows, _ = metrics.with_risk(T.scored(spark, sf).drop("risk_score"))
    return rows


def _components_sql(score: str) -> str:
    return f"""SELECT s, pos, neg, p, q, (neg_below + neg / 2.0::DOUBLE) / q AS v01,
      1 - (pos_below + pos / 2.0::DOUBLE) / p AS v10 FROM ({_counts_sql(score)})"""


def _rows_sql(score: str) -> str:
    return f"SELECT t.*, c.v01, c.v10 FROM scored t JOIN ({_components_sql(score)}) c ON c.s = {score}"


@query(
    "delong_variance",
    "auc:f variance_ppm:f",
    with_tables(
        f"""SELECT avg(CASE WHEN {Y} = 1 THEN v01 END) AS auc,
        1e6::DOUBLE * (var_samp(CASE WHEN {Y} = 1 THEN v01 END) / sum({Y})
         + var_samp(CASE WHEN {Y} = 0 THEN v10 END) / (count(*) - sum({Y}))) AS variance_ppm
        FROM ({_rows_sql(P)})""",
        "scored",
    ),
)
def delong(spark, sf):
    out = roc.delong_variance(T.scored(spark, sf), Y, P)
    return out.withColumn("variance_ppm", F.col("variance") * 1e6)


@query(
    "delong_test",
    "auc_a:f auc_b:f z:f",
    with_tables(
        f"""SELECT auc_a, auc_b, abs(auc_a - auc_b) / sqrt(v) AS z FROM (
        SELECT avg(CASE WHEN {Y} = 1 THEN a01 END) AS auc_a,
          avg(CASE WHEN {Y} = 1 THEN b01 END) AS auc_b,
          (var_samp(CASE WHEN {Y} = 1 THEN a01 - b01 END) / sum({Y})
           + var_samp(CASE WHEN {Y} = 0 THEN a10 - b10 END) / (count(*) - sum({Y}))) AS v
        FROM (SELECT t.{Y}, a.v01 AS a01, a.v10 AS a10, b.v01 AS b01, b.v10 AS b10 FROM scored t
          JOIN ({_components_sql(P)}) a ON a.s = {P}
          JOIN ({_components_sql(P2)}) b ON b.s = {P2}))""",
        "scored",
    ),
)
def correlated_areas(spark, sf):
    return roc.delong_test(T.scored(spark, sf), Y, P, P2)


# --- bootstrap

# Replicates of the patch bootstrap and of the row bootstrap.
REPLICATES, ROW_REPLICATES, SEED = 25, 1000, 42
# Moduli and multipliers of a draw that SQL can compute too; the default draw is a hash.
DRAW = (48271, 69621, 2147483647, 2147483629, 2147483587)


def arithmetic_draw(rep, j, n):
    a, b, m1, m2, m3 = DRAW
    x = (rep * 1_000_003 + j) * a % m1
    x = (x * x + j * b + SEED) % m2
    x = (x * x + rep * b + SEED) % m3
    return x % n


def _draw_sql(n: str, replicates: int = REPLICATES) -> str:
    a, b, m1, m2, m3 = DRAW
    return f"""SELECT rep, x3 % n AS idx FROM (
      SELECT *, (x2 * x2 + rep * {b} + {SEED}) % {m3} AS x3 FROM (
      SELECT *, (x1 * x1 + j * {b} + {SEED}) % {m2} AS x2 FROM (
      SELECT rep, j, n, (rep * 1000003 + j) * {a} % {m1} AS x1 FROM (
      SELECT ({n}) AS n), range(0, {replicates}) r(rep), LATERAL (
        SELECT unnest(range(0, CAST(n AS BIGINT))) AS j))))"""


def _replicates_sql(sampled: str) -> str:
    """Summary of per-replicate areas of the sampled rows (rep, score, label)."""
    counts = _counts_sql(P, "rep", f"({sampled})")
    return f"""SELECT avg(v) AS mean, quantile_cont(v, 0.025) AS lower,
      quantile_cont(v, 0.975) AS upper, count(v) AS n_bootstrap FROM (
      SELECT rep, {AUC_SQL} AS v FROM ({counts}) GROUP BY rep)"""


BOOTSTRAP = "mean:f lower:f upper:f n_bootstrap:i"


@query(
    "bootstrap_metric",
    BOOTSTRAP,
    with_tables(
        _replicates_sql(
            f"""SELECT d.rep, t.{P}, t.{Y} FROM ({_draw_sql("SELECT count(*) FROM scored", ROW_REPLICATES)}) d
            JOIN (SELECT *, row_number() OVER (ORDER BY {P}, {Y}) - 1 AS place FROM scored) t
            ON t.place = d.idx"""
        ),
        "scored",
    ),
)
def row_bootstrap(spark, sf):
    return resampling.bootstrap_metric(
        T.scored(spark, sf), Y, P,
        n_bootstrap=ROW_REPLICATES,
        draw=resampling.PlainDraw(arithmetic_draw),
    )


@query(
    "block_bootstrap",
    BOOTSTRAP,
    with_tables(
        _replicates_sql(
            f"""SELECT d.rep, t.{P}, t.{Y}
            FROM ({_draw_sql("SELECT count(DISTINCT patch_id) FROM scored")}) d
            JOIN (SELECT *, dense_rank() OVER (ORDER BY patch_key) - 1 AS place FROM scored) t
            ON t.place = d.idx"""
        ),
        "scored",
    ),
)
def patch_bootstrap(spark, sf):
    row, col = (F.split_part("patch_id", F.lit("_"), F.lit(i)).cast("bigint") for i in (1, 2))
    return resampling.block_bootstrap(
        T.scored(spark, sf),
        "patch_id",
        Y,
        P,
        n_bootstrap=REPLICATES,
        order=row * 10 + col,
        draw=arithmetic_draw,
    )


@query("bootstrap_metric_full", BOOTSTRAP)
def row_bootstrap_full(spark, sf):
    """A thousand replicates, drawn by multinomial splitting."""
    return resampling.bootstrap_metric(T.scored(spark, sf), Y, P)


@query("block_bootstrap_full", BOOTSTRAP)
def patch_bootstrap_full(spark, sf):
    return resampling.block_bootstrap(T.scored(spark, sf), "patch_id", Y, P)


# --- inverse propensity and losses


@query(
    "ipw_mean",
    "ipw_mean:f",
    with_tables(
        f"SELECT avg({Y} / least(greatest(propensity_score, 0.001::DOUBLE), 1.0::DOUBLE) "
        f"* ({Y} * {SEV_HAT} + (1 - {Y}) * sigma)) AS ipw_mean FROM scored",
        "scored",
    ),
)
def treated_mean(spark, sf):
    y = metrics.observed_outcome(F.col(SEV_HAT), F.col(Y), F.col("sigma"))
    rows = T.scored(spark, sf).withColumn("outcome", y)
    return metrics.ipw_mean(rows, "outcome", Y, "propensity_score")


CLIPPED = "least(greatest(propensity_score, 0.05::DOUBLE), 0.95::DOUBLE)"


@query(
    "ipw_weights",
    "l_orderkey:i l_linenumber:i l_partkey:i split ipw_weight:f",
    with_tables(
        f"""SELECT l_orderkey, l_linenumber, l_partkey, split, 1 / {CLIPPED}
        * count(*) OVER (PARTITION BY split) / sum(1 / {CLIPPED}) OVER (PARTITION BY split)
        AS ipw_weight FROM scored""",
        "scored",
    ),
)
def weights(spark, sf):
    return ipw_weights(T.scored(spark, sf))


LOSS_ROWS_SQL = f"""SELECT CASE WHEN {Y} = 1 THEN l_linenumber / 7.0::DOUBLE ELSE 0.4::DOUBLE END
  AS risk, {SEV} AS sev FROM scored WHERE y_sev_available = 1"""


def _pairs_sql(rows: str) -> str:
    """Pair loss over distinct (risk, severity) cells, weighted by their row counts."""
    return f"""SELECT sum(n * (greatest(z, 0) + ln(1 + exp(-abs(z))))) / sum(n) AS rank_loss,
      sum(n) AS n_pairs FROM (
      SELECT CAST(a.n AS DOUBLE) * b.n AS n, -10 * (a.risk - b.risk) AS z
      FROM (SELECT risk, sev, count(*) AS n FROM ({rows}) GROUP BY 1, 2) a
      JOIN (SELECT risk, sev, count(*) AS n FROM ({rows}) GROUP BY 1, 2) b ON a.sev > b.sev)"""


@query("severity_pairs", "rank_loss:f n_pairs:i", with_tables(_pairs_sql(LOSS_ROWS_SQL), "scored"))
def pair_loss(spark, sf):
    rows = T.scored(spark, sf).where(F.col("y_sev_available") == 1)
    risk = F.when(F.col(Y) == 1, F.col("l_linenumber") / 7.0).otherwise(0.4)
    return losses.ranking_loss(rows.withColumn("risk", risk), "risk", SEV)


LOGIT = "(l_linenumber - 4) / 2.0::DOUBLE"


@query(
    "joint_loss",
    "occ_loss:f sev_loss:f rank_loss:f total_loss:f",
    with_tables(
        f"""SELECT *, occ_loss + 0.5 * sev_loss + 0.1 * rank_loss AS total_loss FROM (
        SELECT avg(greatest(z, 0) + ln(1 + exp(-abs(z))) - z * {Y}) AS occ_loss,
          sum(CASE WHEN y_sev_available = 1 THEN (sigma - {SEV}) * (sigma - {SEV}) * w END)
          / sum(CASE WHEN y_sev_available = 1 THEN w END) AS sev_loss
        FROM (SELECT *, {LOGIT} AS z, 1 / greatest(propensity_score, 0.05::DOUBLE) AS w
              FROM scored)), ({_pairs_sql(
                  f"SELECT sigma / (1 + exp(-{LOGIT})) AS risk, {SEV} AS sev FROM scored "
                  "WHERE y_sev_available = 1")})""",
        "scored",
    ),
)
def combined_loss(spark, sf):
    rows = T.scored(spark, sf).withColumn("logit", (F.col("l_linenumber") - 4) / 2.0)
    return losses.joint_loss(
        rows, "logit", "sigma", Y, SEV, "y_sev_available", "propensity_score"
    )


# --- conformal intervals

SCORES_SQL = f"SELECT abs(risk_score - {SEV}) AS score, sigma FROM scored WHERE split = 'val' AND {SEV} IS NOT NULL"


def _q_sql(score: str) -> str:
    """Order statistic at ceil(level (n - 1)) with level = ceil((n + 1) 0.9) / n."""
    return f"""SELECT max(CASE WHEN place = ceil(least(ceil((n + 1) * (1 - 0.1::DOUBLE)) / n, 1)
        * (n - 1)) THEN s END) AS q, max(n) AS n FROM (
      SELECT {score} AS s, row_number() OVER (ORDER BY {score}) - 1 AS place,
        count(*) OVER () AS n FROM ({SCORES_SQL}))"""


def _known(spark, sf, split):
    rows = T.scored(spark, sf).where((F.col("split") == split) & F.col(SEV).isNotNull())
    return rows


@query("conformal_quantile", "q:f n:i", with_tables(_q_sql("score"), "scored"))
def conformal_quantile(spark, sf):
    fitted = conformal.calibrate(_known(spark, sf, "val"), "risk_score", SEV, 0.1)
    return metrics.metrics_row(spark, {"q": fitted.q, "n": fitted.n})


INTERVAL = (
    "l_orderkey:i l_linenumber:i l_partkey:i risk_point:f risk_lower:f risk_upper:f "
    "coverage_level:f"
)


def _interval_sql(score: str, width: str) -> str:
    return f"""SELECT t.*, risk_score AS risk_point,
      greatest(risk_score - {width}, 0) AS risk_lower, risk_score + {width} AS risk_upper,
      1 - 0.1::DOUBLE AS coverage_level, q, n
      FROM scored t, ({_q_sql(score)}) WHERE split = 'test' AND {SEV} IS NOT NULL"""


@query("conformal_interval", INTERVAL, with_tables(_interval_sql("score", "q"), "scored"))
def conformal_interval(spark, sf):
    fitted = conformal.calibrate(_known(spark, sf, "val"), "risk_score", SEV, 0.1)
    return conformal.intervals(_known(spark, sf, "test"), fitted, "risk_score")


@query(
    "conformal_coverage",
    "empirical_coverage:f target_coverage:f mean_interval_width:f median_interval_width:f "
    "calibration_q:f n_calibration:i n_test:i",
    with_tables(
        f"""SELECT avg(CASE WHEN {SEV} BETWEEN risk_lower AND risk_upper THEN 1 ELSE 0 END)
          AS empirical_coverage, max(coverage_level) AS target_coverage,
          avg(risk_upper - risk_lower) AS mean_interval_width,
          median(risk_upper - risk_lower) AS median_interval_width, max(q) AS calibration_q,
          max(n) AS n_calibration, count(*) AS n_test
        FROM ({_interval_sql("score", "q")})""",
        "scored",
    ),
)
def conformal_coverage(spark, sf):
    fitted = conformal.calibrate(_known(spark, sf, "val"), "risk_score", SEV, 0.1)
    sets = conformal.intervals(_known(spark, sf, "test"), fitted, "risk_score")
    return conformal.coverage(sets, fitted, SEV)


@query(
    "adaptive_conformal",
    INTERVAL,
    with_tables(_interval_sql("score / (sigma + 1e-8::DOUBLE)", "q * sigma"), "scored"),
)
def adaptive(spark, sf):
    fitted = conformal.calibrate(_known(spark, sf, "val"), "risk_score", SEV, 0.1, "sigma")
    return conformal.intervals(_known(spark, sf, "test"), fitted, "risk_score", "sigma")


@query(
    "confident_alerts",
    "threshold:f n_confident_alerts:i fraction_confident_alerts:f mean_confident_lower:f",
    with_tables(
        f"""SELECT 0.05 AS threshold, count_if(risk_lower > 0.05::DOUBLE) AS n_confident_alerts,
        avg(CASE WHEN risk_lower > 0.05::DOUBLE THEN 1 ELSE 0 END) AS fraction_confident_alerts,
        coalesce(avg(CASE WHEN risk_lower > 0.05::DOUBLE THEN risk_lower END), 0)
          AS mean_confident_lower FROM ({_interval_sql("score", "q")})""",
        "scored",
    ),
)
def alerts(spark, sf):
    return conformal.confident_alerts(conformal_interval(spark, sf), 0.05)


# --- leakage audits; the fitted model is the base rate per line number


@query(
    "temporal_leakage",
    "leakage_detected:i gap_days:i horizon_days:i overlap_days:i overlap_ratio:f "
    "leaking_train_fraction:f",
    with_tables(
        """SELECT CAST(overlap > 0 AS INTEGER) AS leakage_detected, gap AS gap_days,
        45 AS horizon_days, overlap AS overlap_days, overlap / 45.0 AS overlap_ratio,
        (SELECT avg(CASE WHEN reference_date + 45 >= first_val THEN 1 ELSE 0 END) FROM scored
         WHERE split = 'train') AS leaking_train_fraction
        FROM (SELECT *, first_val - last_train AS gap,
                greatest(0, 45 - (first_val - last_train)) AS overlap FROM (
          SELECT max(CASE WHEN split = 'train' THEN reference_date END) AS last_train,
            min(CASE WHEN split = 'val' THEN reference_date END) AS first_val FROM scored))""",
        "scored",
    ),
)
def leakage(spark, sf):
    return audits.temporal_leakage(T.scored(spark, sf), 45)


def rate_callbacks():
    """The simplest model an audit can refit: the positive rate of each line number."""

    def train(rows, _val):
        return rows.groupBy("l_linenumber").agg(F.avg(Y).alias("rate"))

    def evaluate(model, rows):
        found = metrics.roc_metrics(rows.join(model, "l_linenumber"), Y, "rate").first()
        return found["roc_auc"]

    return train, evaluate


BUFFERS = (0, 30, 60, 90)
ALL_BUFFERS = range(0, 2 * HORIZON + 1, 5)
BOUNDS = (date(1998, 12, 31), date(2000, 6, 30))


def _rate_auc_sql(train: str, test: str) -> str:
    counts = _counts_sql("rate", "", f"(SELECT t.*, m.rate FROM ({test}) t JOIN (SELECT "
                         f"l_linenumber, avg({Y}) AS rate FROM ({train}) GROUP BY 1) m "
                         "ON m.l_linenumber = t.l_linenumber)")
    return f"SELECT {AUC_SQL} FROM ({counts})"


def _curve_rows(buffers) -> str:
    return " UNION ALL ".join(
        f"""SELECT {b} AS buffer_days, ({_rate_auc_sql(
        f"SELECT * FROM scored WHERE reference_date <= {DATES[0]}",
        f"SELECT * FROM scored WHERE reference_date > {DATES[1]} + {b}")}) AS roc_auc,
    count_if(reference_date <= {DATES[0]}) AS n_train,
    count_if(reference_date > {DATES[0]} + {b} AND reference_date <= {DATES[1]}) AS n_val,
    count_if(reference_date > {DATES[1]} + {b}) AS n_test,
    {max(0, HORIZON - b)} AS type2_overlap_days FROM scored"""
        for b in buffers
    )


@query(
    "leakage_curve",
    "buffer_days:i roc_auc:f n_train:i n_val:i n_test:i type2_overlap_days:i",
    with_tables(_curve_rows(BUFFERS), "scored"),
)
def curve(spark, sf):
    train, evaluate = rate_callbacks()
    return audits.leakage_curve(
        T.scored(spark, sf), train, evaluate, HORIZON, BUFFERS, BOUNDS, uses_val=False
    )


@query(
    "leakage_curve_full",
    "buffer_days:i roc_auc:f n_train:i n_val:i n_test:i type2_overlap_days:i",
    with_tables(_curve_rows(ALL_BUFFERS), "scored"),
)
def full_curve(spark, sf):
    """All default buffers."""
    train, evaluate = rate_callbacks()
    return audits.leakage_curve(
        T.scored(spark, sf), train, evaluate, HORIZON, boundaries=BOUNDS, uses_val=False
    )


def _spatial_rows_sql(km: int) -> str:
    per = max(1, km // 10)
    folded = f"({_cv_sql(per, 'scored')})"
    return " UNION ALL ".join(
        f"""SELECT {km} AS block_size_km, ({_rate_auc_sql(
            f"SELECT * FROM {folded} WHERE fold <> {i}", f"SELECT * FROM {folded} WHERE fold = {i}"
        )}) AS auc"""
        for i in range(5)
    )


@query(
    "spatial_leakage",
    "block_size_km:i mean_auc:f std_auc:f n_folds:i",
    with_tables(
        "SELECT block_size_km, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc, "
        f"count(*) AS n_folds FROM ({_spatial_rows_sql(10)} UNION ALL {_spatial_rows_sql(20)}) "
        "GROUP BY block_size_km",
        "scored",
    ),
)
def spatial_curve(spark, sf):
    train, evaluate = rate_callbacks()
    rows = T.scored(spark, sf).drop("split")
    return audits.spatial_leakage(rows, train, evaluate, (10, 20), 10, order=arithmetic_order)


def _scored_folds_sql(km: int) -> str:
    """Areas of the folds with enough rows on both sides; a small grid has fewer than five."""
    folded = f"({_cv_sql(max(1, km // 10), 'scored')})"
    return " UNION ALL ".join(
        f"""SELECT {km} AS block_size_km, CASE WHEN (SELECT least(count_if(fold = {i}), count_if(fold <> {i}))
          FROM {folded}) >= {audits.MIN_AUDIT_ROWS} THEN ({_rate_auc_sql(
            f"SELECT * FROM {folded} WHERE fold <> {i}", f"SELECT * FROM {folded} WHERE fold = {i}"
        )}) END AS auc"""
        for i in range(5)
    )


ALL_SIZES_SQL = (
    "SELECT block_size_km, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc, count(*) AS n_folds FROM ("
    + " UNION ALL ".join(map(_scored_folds_sql, audits.BLOCK_SIZES_KM))
    + ") WHERE auc IS NOT NULL GROUP BY block_size_km"
)


@query(
    "leakage_report",
    "curve step:i auc:f",
    with_tables(
        f"""SELECT 'temporal' AS curve, buffer_days AS step, roc_auc AS auc FROM ({_curve_rows(ALL_BUFFERS)})
        UNION ALL SELECT 'spatial', block_size_km, mean_auc FROM ({ALL_SIZES_SQL})""",
        "scored",
    ),
)
def base_rate_report(spark, sf):
    """Both curves of the base rates; ``leakage_report_panel`` refits a model of the wide panel."""
    rows = T.scored(spark, sf)
    return report_rows(
        audits.leakage_report(
            rows, rows, HORIZON, "", {}, BOUNDS, callbacks=rate_callbacks(), order=arithmetic_order
        )
    )


def report_rows(curves):
    temporal, spatial = curves
    return temporal.select(
        F.lit("temporal").alias("curve"), F.col("buffer_days").alias("step"), F.col("roc_auc").alias("auc")
    ).unionByName(
        spatial.select(F.lit("spatial").alias("curve"), F.col("block_size_km").alias("step"), F.col("mean_auc").alias("auc"))
    )


@query("spatial_leakage_full", "block_size_km:i mean_auc:f std_auc:f n_folds:i", with_tables(ALL_SIZES_SQL, "scored"))
def full_spatial_curve(spark, sf):
    """All default block sizes."""
    train, evaluate = rate_callbacks()
    rows = T.scored(spark, sf).drop("split")
    return audits.spatial_leakage(rows, train, evaluate, order=arithmetic_order)

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyrogrid.functions import ordered
from pyrogrid.functions.special import correlation_p_value, normal_two_sided
from pyrogrid.functions.multinomial import EqualCells, generator, interval_counts
from pyrogrid.operators import conformal, losses, metrics, models, resampling, roc

Y6, P6 = [0, 0, 1, 1, 0, 1], [0.1, 0.2, 0.8, 0.9, 0.4, 0.7]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def auc_by_pairs(y, s):
    pos, neg = s[y == 1], s[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


@pytest.fixture
def scores():
    rng = np.random.default_rng(11)
    n = 3000
    y = rng.integers(0, 2, n)
    a = np.round(rng.random(n) * 0.6 + 0.4 * y * rng.random(n), 2)
    b = np.round(rng.random(n), 1)
    a[:1000] = 0.5
    sev = np.where(y == 1, np.round(rng.random(n), 2), np.nan)
    return pd.DataFrame({"y": y, "a": a, "b": b, "sev": sev, "g": np.arange(n) % 7})


def test_classification_on_a_separable_sample(spark):
    got = metrics.classification_metrics(frame(spark, y=Y6, p=P6), "y", "p").first()
    assert (got.roc_auc, got.pr_auc, got.f1, got.precision, got.recall) == (1, 1, 1, 1, 1)
    assert got.brier == pytest.approx(np.mean((np.array(P6) - Y6) ** 2))


def test_undefined_metrics_are_nan(spark):
    one = metrics.classification_metrics(frame(spark, y=[1, 1], p=[0.2, 0.3]), "y", "p").first()
    assert math.isnan(one.roc_auc) and math.isnan(one.pr_auc) and one.f1 == 0.0
    none = frame(spark, y=[1], p=[0.5]).where("y = 0")
    assert all(math.isnan(v) for v in metrics.classification_metrics(none, "y", "p").first())


@pytest.mark.parametrize("bucket_rows", [100_000, 150])
def test_areas_with_ties(spark, scores, bucket_rows, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", bucket_rows)
    got = metrics.roc_metrics(spark.createDataFrame(scores), "y", "a").first()
    y, a = scores.y.to_numpy(), scores.a.to_numpy()
    assert got.roc_auc == pytest.approx(auc_by_pairs(y, a))
    ap, last = 0.0, 0.0
    for t in sorted(set(a), reverse=True):
        hit = a >= t
        recall = y[hit].sum() / y.sum()
        ap += (recall - last) * y[hit].mean()
        last = recall
    assert got.pr_auc == pytest.approx(ap)


def test_calibration_edges_follow_the_bin_grid(spark):
    p = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 1.0, 0.95]
    y = [0, 0, 1, 0, 1, 1, 1, 1]
    got = metrics.calibration_error(frame(spark, y=y, p=p), "y", "p").first().ece
    edges, p, y = np.linspace(0, 1, 11), np.array(p), np.array(y)
    want = 0.0
    for i in range(10):
        m = (p >= edges[i]) & ((p < edges[i + 1]) if i < 9 else (p <= 1))
        if m.any():
            want += m.mean() * abs(p[m].mean() - y[m].mean())
    assert got == pytest.approx(want)


def test_regression(spark):
    y = [1.0, 2.0, 3.0, 4.0, 5.0]
    got = metrics.regression_metrics(frame(spark, y=y, p=[v + 0.5 for v in y]), "y", "p").first()
    assert (got.rmse, got.mae, got.bias, got.r2) == pytest.approx((0.5, 0.5, 0.5, 0.875))
    flat = metrics.regression_metrics(frame(spark, y=[2.0] * 3, p=[1.0, 2, 3]), "y", "p").first()
    assert math.isnan(flat.r2)


def midrank(x):
    return pd.Series(x).rank().to_numpy()


def test_spearman_and_p_values(spark, scores):
    rho, p, n = metrics.spearman(spark.createDataFrame(scores), "a", "b")
    want = np.corrcoef(midrank(scores.a), midrank(scores.b))[0, 1]
    assert (rho, n) == (pytest.approx(want), 3000)
    # Known values: t = 2.228 with 10 degrees of freedom and z = 1.96 both leave 5 %.
    r = 2.2281388519649385 / math.sqrt(10 + 2.2281388519649385**2)
    assert correlation_p_value(r, 12) == pytest.approx(0.05, abs=1e-10)
    assert correlation_p_value(0.0, 5) == pytest.approx(1.0)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_ranking_cuts_through_ties(spark, scores):
    df = spark.createDataFrame(scores.assign(k=np.arange(len(scores))))
    df = df.withColumn("sev", F.when(~F.isnan("sev"), F.col("sev")))
    got = metrics.risk_ranking(df, "a", "sev", "y", [F.col("k")]).first()
    s = scores.sort_values("a", ascending=False, kind="stable")
    for pct in (10, 20):
        k = round(pct / 100 * len(s))
        assert got[f"precision_at_{pct}pct"] == pytest.approx((s.y[:k] == 1).mean())
        assert got[f"severity_capture_at_{pct}pct"] == pytest.approx(
            s.sev.fillna(0)[:k].sum() / s.sev.sum()
        )
    assert got.n_evaluable == int(scores.y.sum())
    few = metrics.risk_ranking(df.limit(5), "a", "sev", "y", [F.col("k")]).first()
    assert "warning" in few.asDict() and few.n_test == 5


def test_delong_against_the_definition(spark, scores):
    y = scores.y.to_numpy()

    def parts(s):
        pos, neg = s[y == 1], s[y == 0]
        d = pos[:, None] - neg[None, :]
        w = (d > 0) + 0.5 * (d == 0)
        return w.mean(1), w.mean(0)

    (a1, a0), (b1, b0) = parts(scores.a.to_numpy()), parts(scores.b.to_numpy())
    m, n = (y == 1).sum(), (y == 0).sum()
    df = spark.createDataFrame(scores)
    one = roc.delong_variance(df, "y", "a").first()
    assert one.auc == pytest.approx(a1.mean())
    assert one.variance == pytest.approx(a1.var(ddof=1) / m + a0.var(ddof=1) / n)
    var = (a1 - b1).var(ddof=1) / m + (a0 - b0).var(ddof=1) / n
    two = roc.delong_test(df, "y", "a", "b").first()
    assert two.z == pytest.approx(abs(a1.mean() - b1.mean()) / math.sqrt(var))
    same = roc.delong_test(df.withColumn("c", F.col("a")), "y", "a", "c").first()
    assert (same.z, same.p_value) == (0.0, 1.0)


@pytest.mark.parametrize("flip", [False, True])
def test_delong_of_nearly_perfect_scores(spark, flip):
    """One inverted pair among 3000: raw moments near 1 would lose most digits."""
    k = 1500
    y = np.repeat([0, 1], k)
    a = np.concatenate([np.arange(k), np.arange(k) + k]).astype(float)
    a[k - 1], a[k] = a[k], a[k - 1]
    b = a.copy()
    b[0], b[k + 7] = b[k + 7], b[0]
    if flip:
        a, b = -a, -b
    df = frame(spark, y=y, a=a, b=b)

    def parts(s):
        d = s[y == 1][:, None] - s[y == 0][None, :]
        wins = (d > 0) + 0.5 * (d == 0)
        missed = 1 - wins if not flip else wins
        return missed.mean(axis=1), missed.mean(axis=0)

    (a1, a0), (b1, b0) = parts(a), parts(b)
    one = roc.delong_variance(df, "y", "a").first()
    assert one.variance == pytest.approx(a1.var(ddof=1) / k + a0.var(ddof=1) / k, rel=1e-11)
    two = roc.delong_test(df, "y", "a", "b").first()
    var = (a1 - b1).var(ddof=1) / k + (a0 - b0).var(ddof=1) / k
    assert two.z == pytest.approx(abs(a1.mean() - b1.mean()) / math.sqrt(var), rel=1e-9)


def test_bootstrap_counts_and_intervals(spark, scores):
    df = spark.createDataFrame(scores)
    auc = auc_by_pairs(scores.y.to_numpy(), scores.a.to_numpy())
    for out in (
        resampling.bootstrap_metric(df, "y", "a", n_bootstrap=30),
        resampling.block_bootstrap(df, "g", "y", "a", n_bootstrap=30),
    ):
        row = out.first()
        assert row.n_bootstrap == 30
        assert row.lower <= row.mean <= row.upper
        assert row.mean == pytest.approx(auc, abs=0.02)
    draws = resampling.draw_counts(spark, 5, 100, resampling.hashed_draw(1))
    sizes = {r[0]: r[1] for r in draws.groupBy("rep").agg(F.sum("m")).collect()}
    assert sizes == {i: 100 for i in range(5)}
    with pytest.raises(Exception, match="both classes"):
        resampling.bootstrap_metric(df.where("y = 1"), "y", "a", n_bootstrap=3).collect()


@pytest.mark.parametrize("width,margin,scale", [(1, 0.0, 10.0), (1, 0.3, 10.0), (40, 0.0, 10.0), (40, -7.5, 10.0),
                                                (300, 120.0, 1.0), (1e6, 3.0, 10.0), (30, 0.5, -2.0), (5, 1.0, 0.0)])
def test_ranking_loss_forms_all_pairs_at_any_range(spark, width, margin, scale):
    rng = np.random.default_rng(4)
    r = np.concatenate([rng.random(150) * width, np.full(20, 0.25 * width), [0.0, width]])
    s = np.round(rng.random(len(r)), 1)
    z = scale * (margin - (r[:, None] - r[None, :]))
    loss = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
    pairs = s[:, None] > s[None, :]
    got, n = losses.severity_pairs(frame(spark, r=r, s=s), "r", "s", margin, scale)
    assert n == pairs.sum()
    assert got == pytest.approx(loss[pairs].mean(), rel=1e-9, abs=1e-9)


def weighted_roc(y, score, weight):
    """Area and average precision of weighted rows, score by score."""
    cells = sorted(set(score), reverse=True)
    pos = [float(weight[(score == c) & (y == 1)].sum()) for c in cells]
    neg = [float(weight[(score == c) & (y == 0)].sum()) for c in cells]
    above = raised = wins = gain = 0.0
    for p, q in zip(pos, neg, strict=True):
        wins += q * (above + p / 2)
        above, raised = above + p, raised + p + q
        gain += p * above / raised if raised else 0.0
    return wins / (sum(pos) * sum(neg)), gain / sum(pos)


@pytest.mark.parametrize("metric", ["roc_auc", "pr_auc"])
@pytest.mark.parametrize("drawn", [False, True])
def test_block_replicates_are_weighted_metrics(spark, scores, metric, drawn):
    """Replicates against brute force with the same multiplicities, over many value ranges."""
    df = spark.createDataFrame(scores).withColumn("g", F.col("g").cast("long"))
    patches = sorted(set(scores.g))
    order = F.col("g")
    n, b = len(patches), 20
    if drawn:
        draw = lambda rep, j, n: F.pmod(rep * 7919 + j * j * 31 + rep * j, n)
        counts = np.zeros((n, b), int)
        for r in resampling.draw_counts(spark, b, n, draw).collect():
            counts[r.idx, r.rep] = r.m
    else:
        draw, counts = None, EqualCells(n, b, 42).counts(np.arange(n))
        assert (counts.sum(axis=0) == n).all()
    row = resampling.block_bootstrap(df, "g", "y", "a", metric, b, order=order, draw=draw).first()
    place = scores.g.map({g: i for i, g in enumerate(patches)}).to_numpy()
    values = [
        weighted_roc(scores.y.to_numpy(), scores.a.to_numpy(), counts[place, r])[metric == "pr_auc"]
        for r in range(b)
    ]
    assert row["mean"] == pytest.approx(np.mean(values), abs=1e-12)
    assert row.lower == pytest.approx(np.quantile(values, 0.025), abs=1e-12)


@pytest.mark.parametrize("metric", ["roc_auc", "pr_auc"])
def test_row_replicates_are_weighted_metrics(spark, scores, metric):
    df = spark.createDataFrame(scores)
    b, got = 20, []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "13"):  # the layout changes nothing
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got.append(resampling.bootstrap_metric(df, "y", "a", metric, b).first())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].asDict() == pytest.approx(got[1].asDict(), abs=1e-12)
    sizes = [int((scores.y == 1).sum()), int((scores.y == 0).sum())]
    draws = np.full(b, len(scores))
    n_pos = generator(42).binomial(draws, sizes[0] / len(scores))
    y, score, rows = [], [], []
    for k, label in enumerate((1, 0)):
        part = np.sort(scores.a[scores.y == label].to_numpy())[::-1]
        drawn = (n_pos, draws - n_pos)[k]
        rows.append(interval_counts(drawn, sizes[k], np.arange(sizes[k] + 1), 42, k))
        assert (rows[-1].sum(axis=0) == drawn).all()
        y += [label] * sizes[k]
        score += list(part)
    weight = np.concatenate(rows)
    values = [weighted_roc(np.array(y), np.array(score), weight[:, r])[metric == "pr_auc"] for r in range(b)]
    assert got[0]["mean"] == pytest.approx(np.mean(values), abs=1e-12)


def test_splitting_is_multinomial():
    """Means and variances of cell counts, and agreement of wide and narrow intervals."""
    n, b = 1000, 4000
    draws = np.full(b, n)
    fine = interval_counts(draws, n, np.arange(n + 1), 7)
    wide = interval_counts(draws, n, np.array([0, 3, 500, 977, 1000]), 7)
    assert (wide == np.add.reduceat(fine, [0, 3, 500, 977])).all()
    assert (fine.sum(axis=0) == n).all()
    assert abs(fine.mean(axis=1) - 1).max() < 0.1 and abs(fine.var(axis=1) - 1).max() < 0.2
    assert np.corrcoef(wide[1], wide[2])[0, 1] < -0.8
    one = EqualCells(n, b, 7, most_bytes=1)
    some = np.array([0, 5, 17, 999])
    assert (one.counts(some) == EqualCells(n, b, 7).counts(np.arange(n))[some]).all()


def test_ipw_recovers_the_treated_mean(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=50_000)
    e = 1 / (1 + np.exp(-x))
    d = (rng.random(50_000) < e).astype(float)
    df = frame(spark, y=d * (1 + x), d=d, e=e)
    assert metrics.ipw_mean(df, "y", "d", "e").first()[0] == pytest.approx((1 + x).mean(), abs=0.05)


def test_ipw_weights(spark):
    df = frame(spark, propensity_score=[0.01, 0.5, 0.99], split=["train"] * 3)
    raw = models.ipw_weights(df, normalise=False).orderBy("propensity_score").collect()
    assert [r.ipw_weight for r in raw] == pytest.approx([20.0, 2.0, 1 / 0.95])
    scaled = models.ipw_weights(df).agg(F.sum("ipw_weight")).first()[0]
    assert scaled == pytest.approx(3.0)


@pytest.mark.parametrize("scale,margin", [(10.0, 0.0), (3.0, 0.2), (40.0, 0.0)])
def test_pair_loss_against_all_pairs(spark, scale, margin):
    rng = np.random.default_rng(2)
    risk, sev = rng.random(400), np.round(rng.random(400), 1)
    gap = risk[:, None] - risk[None, :]
    want = np.log1p(np.exp(scale * (margin - gap)))[sev[:, None] > sev[None, :]]
    got = losses.ranking_loss(frame(spark, r=risk, s=sev), "r", "s", margin, scale).first()
    assert got.n_pairs == len(want)
    assert got.rank_loss == pytest.approx(want.mean(), rel=1e-9)


def test_pair_loss_orders_and_degenerates(spark):
    good = losses.ranking_loss(frame(spark, r=[0.9, 0.5, 0.1], s=[3.0, 2, 1]), "r", "s").first()
    bad = losses.ranking_loss(frame(spark, r=[0.1, 0.5, 0.9], s=[3.0, 2, 1]), "r", "s").first()
    assert good.rank_loss < 0.1 < 0.5 < bad.rank_loss
    for r, s in (([0.1], [1.0]), ([0.1, 0.2], [1.0, 1.0])):
        assert losses.ranking_loss(frame(spark, r=r, s=s), "r", "s").first().rank_loss == 0.0


def test_conformal_order_statistic(spark):
    df = frame(spark, p=[0.0, 0.0, 0.0], t=[0.0, 0.0, 10.0])
    assert conformal.calibrate(df, "p", "t", 0.5).q == 10.0
    assert conformal.quantile_position(100, 0.1) == 91
    with pytest.raises(ValueError):
        conformal.calibrate(df.where("t > 99"), "p", "t")


def test_conformal_coverage_and_alerts(spark):
    rng = np.random.default_rng(0)
    p = rng.random(600)
    df = frame(spark, p=p, t=np.clip(p + rng.normal(0, 0.1, 600), 0, None), i=np.arange(600))
    fitted = conformal.calibrate(df.where("i < 300"), "p", "t")
    sets = conformal.intervals(df.where("i >= 300"), fitted, "p")
    got = conformal.coverage(sets, fitted, "t").first()
    assert got.empirical_coverage >= 0.85 and (got.n_calibration, got.n_test) == (300, 300)
    assert sets.where("risk_lower < 0").count() == 0
    loud = conformal.calibrate(df.where("i < 300").withColumn("t", F.col("t") + F.rand(1)), "p", "t")
    assert loud.q > fitted.q
    quiet = conformal.confident_alerts(sets, 99.0).first()
    assert (quiet.n_confident_alerts, quiet.mean_confident_lower) == (0, 0.0)
    few = conformal.Calibration(0.1, 5)
    assert "warning" in conformal.coverage(sets, few, "t").columns


@pytest.mark.parametrize("frequent", [1, 30, 1 << 16])
def test_drawn_rows_of_frequent_and_rare_cells(spark, scores, frequent, monkeypatch):
    """The caller's draws against brute force, whichever cells are counted before the shuffle."""
    monkeypatch.setattr(resampling, "FREQUENT_CELLS", frequent)
    draw, b, n = (lambda rep, j, n: F.pmod(rep * 7919 + j * j * 31 + rep * j, n)), 8, len(scores)
    row = resampling.bootstrap_metric(spark.createDataFrame(scores), "y", "a", n_bootstrap=b, draw=draw).first()
    ranked = scores.sort_values(["a", "y"])
    rep, j = np.meshgrid(np.arange(b), np.arange(n), indexing="ij")
    idx = (rep * 7919 + j * j * 31 + rep * j) % n
    values = [
        weighted_roc(ranked.y.to_numpy(), ranked.a.to_numpy(), np.bincount(idx[r], minlength=n))[0] for r in range(b)
    ]
    assert row["mean"] == pytest.approx(np.mean(values), abs=1e-12)
    assert row.lower == pytest.approx(np.quantile(values, 0.025), abs=1e-12)


def test_counts_of_patches_are_drawn_once_for_all_scores(monkeypatch):
    """More patches than are remembered, every one of them at every score."""
    drawn = []
    descend = EqualCells._descend
    monkeypatch.setattr(EqualCells, "_descend", lambda self, blocks: (drawn.extend(blocks), descend(self, blocks))[1])
    n, b, levels = 400, 3, 6
    cells = EqualCells(n, b, 42, most_bytes=4 * 16 * b * 8)
    part = pd.DataFrame({"score": np.repeat(np.arange(levels, 0, -1.0), n), "idx": np.tile(np.arange(n), levels)})
    part["pos"], part["neg"] = part.idx % 3, part.idx % 2
    pos, neg = resampling._walk(part, cells, b)
    assert len(drawn) == n // 16
    weight = EqualCells(n, b, 42).counts(np.arange(n))
    for got, c in ((pos, "pos"), (neg, "neg")):
        assert (got == part[c].to_numpy()[:n] @ weight).all()


def test_ranges_of_a_task_draw_each_patch_once(monkeypatch):
    """A thousand replicates of many patches are remembered from one range to the next."""
    drawn = []
    descend = EqualCells._descend
    monkeypatch.setattr(EqualCells, "_descend", lambda self, blocks: (drawn.extend(blocks), descend(self, blocks))[1])
    n, b = 9600, 1000
    cells = EqualCells(n, b, 42)
    part = pd.DataFrame({"score": 1.0, "idx": np.arange(n), "pos": 1, "neg": 0})
    for _ in range(3):
        pos, _ = resampling._walk(part, cells, b)
        assert (pos == n).all()
    assert len(drawn) == n // 16


@pytest.mark.parametrize("metric", ["roc_auc", "pr_auc"])
def test_replicates_drawn_in_pieces(spark, scores, metric, monkeypatch):
    """More patches than a task may remember: every piece of the replicates has a draw of its own."""
    df = spark.createDataFrame(scores).withColumn("g", F.col("g").cast("long"))
    n, b, pieces = scores.g.nunique(), 20, 3
    monkeypatch.setattr(resampling, "HELD_BYTES", -(-n * b // pieces))
    row = resampling.block_bootstrap(df, "g", "y", "a", metric, b, order=F.col("g")).first()
    place = scores.g.map({g: i for i, g in enumerate(sorted(set(scores.g)))}).to_numpy()
    edges = [b * k // pieces for k in range(pieces + 1)]
    values = []
    for k in range(pieces):
        counts = EqualCells(n, edges[k + 1] - edges[k], (42, k)).counts(np.arange(n))
        values += [
            weighted_roc(scores.y.to_numpy(), scores.a.to_numpy(), c)[metric == "pr_auc"] for c in counts[place].T
        ]
    assert row.n_bootstrap == b
    assert row["mean"] == pytest.approx(np.mean(values), abs=1e-12)


@pytest.mark.parametrize("frequent", [1, 30, 1 << 20])
def test_plain_draws_equal_column_draws(spark, scores, frequent, monkeypatch):
    """Numbers drawn in tasks are those Spark computes, over several stretches of a replicate."""
    monkeypatch.setattr(resampling, "FREQUENT_CELLS", frequent)
    monkeypatch.setattr(resampling, "TASK_DRAWS", 70)
    monkeypatch.setattr(resampling, "LOOKED_UP", 30)
    draw = lambda rep, j, n: (rep * 7919 + j * j * 31 + rep * j) % n
    df, found = spark.createDataFrame(scores), []
    for kind in (draw, resampling.PlainDraw(draw)):
        found.append(resampling.bootstrap_metric(df, "y", "a", n_bootstrap=8, draw=kind).first().asDict())
    assert found[0] == pytest.approx(found[1], abs=1e-12)


def test_row_bootstrap_query_draws_a_thousand_replicates(spark, sf_dir):
    from pyrogrid.plans.catalog import REGISTRY

    assert REGISTRY["bootstrap_metric"].run(spark, sf_dir).first().n_bootstrap == 1000
    assert "range(0, 1000)" in REGISTRY["bootstrap_metric"].sql

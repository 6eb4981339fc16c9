import math
import statistics
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyrogrid.config import (
    BBox,
    DataConfig,
    ExperimentConfig,
    GridConfig,
    ModelConfig,
    SourceConfig,
    SplitConfig,
    TemporalConfig,
)
from pyrogrid.functions.skew import with_parts
from pyrogrid.sources import grid, nearest, panel, tables, zonal


def temporal(**changes):
    base = {
        "reference_start": date(2020, 1, 1),
        "reference_end": date(2020, 1, 1),
        "reference_stride_days": 7,
        "lookback_days": 60,
        "temporal_windows": (7, 14, 30),
        "horizon_days": 14,
    }
    return TemporalConfig(**{**base, **changes})


def dates(frame):
    return [r[0] for r in frame.orderBy("reference_date").collect()]


def test_spine_padding(spark):
    got = dates(panel.reference_dates(spark, temporal()))
    assert got == [date(2020, 1, 1) + timedelta(days=7 * i) for i in range(4)]
    wide = temporal(temporal_windows=(14, 30))
    assert wide.padding_days == 28
    assert dates(panel.reference_dates(spark, wide))[-1] == date(2020, 1, 29)
    assert wide.n_reference_dates == 5


@pytest.mark.parametrize(
    "change",
    [
        {"temporal_windows": ()},
        {"temporal_windows": (14, 7)},
        {"temporal_windows": (0, 7)},
        {"temporal_windows": (7, 90)},
        {"temporal_windows": (3,)},
        {"reference_end": date(2019, 1, 1)},
        {"horizon_days": 0},
    ],
)
def test_temporal_checks(change):
    with pytest.raises(ValueError):
        temporal(**change)


def test_config_checks():
    box = BBox(100, 101, -1, 1)
    split = SplitConfig(14, date(2020, 1, 1), date(2020, 6, 1), date(2020, 12, 1))
    data = DataConfig(GridConfig(10, box), temporal(), split)
    with pytest.raises(ValueError):
        DataConfig(GridConfig(10, box), temporal(horizon_days=30), split)
    with pytest.raises(ValueError):
        SplitConfig(0, date(2020, 6, 1), date(2020, 1, 1), date(2020, 12, 1))
    with pytest.raises(ValueError):
        BBox(2, 1, 0, 1)
    for task, model in (("occurrence", "regression"), ("severity", "classification")):
        with pytest.raises(ValueError):
            ExperimentConfig("x", task, data, ModelConfig("logreg", model))
    with pytest.raises(ValueError):
        ExperimentConfig("x", "risk", data, ModelConfig("transformer", "classification"))
    ok = ExperimentConfig("x", "occurrence", data, ModelConfig("logreg", "classification"))
    assert ok.target_column == "y_occ_14d"


def test_grid_matches_a_cell_by_cell_walk(spark):
    box, km = BBox(110.0, 110.5, -2.0, -1.6), 15
    got = {
        (r.patch_row, r.patch_col): r
        for r in grid.patch_grid(grid.bbox_frame(spark, box), km).collect()
    }
    step, lat, row, seen = km / 110.574, -2.0, 0, 0
    while lat < box.lat_max - 1e-9:
        top = min(lat + step, box.lat_max)
        width = km / (111.320 * math.cos(math.radians((lat + top) / 2)))
        lon, col = box.lon_min, 0
        while lon < box.lon_max - 1e-9:
            cell = got[(row, col)]
            assert cell.min_lon == pytest.approx(lon)
            assert cell.max_lon == pytest.approx(min(lon + width, box.lon_max))
            assert (cell.min_lat, cell.max_lat) == pytest.approx((lat, top))
            assert cell.geometry_wkt.startswith("POLYGON ((")
            lon, col, seen = min(lon + width, box.lon_max), col + 1, seen + 1
        lat, row = top, row + 1
    assert seen == len(got)


def test_points_land_in_their_cell(spark):
    box, km = BBox(110.0, 110.5, -2.0, -1.6), 15
    cells = grid.patch_grid(grid.bbox_frame(spark, box), km)
    centres = cells.select(
        F.col("patch_id").alias("expected"),
        F.col("centroid_lon").alias("lon"),
        F.col("centroid_lat").alias("lat"),
    )
    bound = grid.assign_patch(centres, box, km)
    assert bound.where(F.col("patch_id") != F.col("expected")).count() == 0
    edge = spark.createDataFrame([(110.5, -1.6), (120.0, 0.0)], "lon double, lat double")
    found = [r.patch_id for r in grid.assign_patch(edge, box, km).collect()]
    assert found[0] is not None and found[1] is None


def small_grid(spark, n=6):
    rows = [(f"{i // 3}_{i % 3}", i // 3, i % 3, 110.0 + i, -1.0) for i in range(n)]
    return spark.createDataFrame(
        rows,
        "patch_id string, patch_row int, patch_col int, centroid_lon double, centroid_lat double",
    )


def test_assemble_strictness(spark):
    t, g = temporal(), small_grid(spark)
    ok = panel.PanelSource(
        lambda: g.select("patch_id", F.lit(1.0).alias("terrain_x")), ["terrain_x"], static=True
    )
    bad = panel.PanelSource(lambda: spark.read.parquet("/no/such/table"), ["optical_x"])
    registry = {"a": ok, "b": bad}
    with pytest.raises(ValueError, match="no source named"):
        panel.assemble_panel(g, t, registry, [SourceConfig("zzz")])
    panel.assemble_panel(g, t, registry, [SourceConfig("zzz", enabled=False)])
    both = [SourceConfig("a"), SourceConfig("b")]
    with pytest.raises(RuntimeError):
        panel.assemble_panel(g, t, registry, both)
    lenient = panel.assemble_panel(g, t, registry, both, strict=False)
    assert lenient.count() == 6 * t.n_reference_dates
    assert lenient.where(F.col("optical_x").isNotNull()).count() == 0
    assert lenient.where(F.col("terrain_x") != 1.0).count() == 0


def test_incremental_builds_only_open_blocks(spark, tmp_path):
    g = small_grid(spark).withColumn("block_id", F.col("patch_row").cast("string"))
    path, calls = str(tmp_path / "panel"), []

    def build(part):
        calls.append(part.count())
        return part.select("block_id", "patch_id")

    assert panel.build_incremental(g.where("patch_row = 0"), build, path) == 3
    assert panel.build_incremental(g, build, path) == 3
    assert panel.build_incremental(g, build, path) == 0
    assert calls == [3, 3]
    assert spark.read.parquet(path).count() == 6
    parts = [panel.patch_slice(g, i, 3) for i in range(3)]
    ids = [r.patch_id for p in parts for r in p.collect()]
    assert sorted(ids) == sorted(r.patch_id for r in g.collect())


def test_missing_geometry_is_an_error(spark):
    needed = spark.createDataFrame([("9_9",)], "patch_id string")
    with pytest.raises(ValueError, match="9_9"):
        panel.require_patches(needed, small_grid(spark))


def observations(spark, rows):
    return spark.createDataFrame(
        rows, "patch_id string, pixel_id int, obs_date date, v double, cloud_pct int"
    )


def test_lookback_edges(spark):
    """[ref - w, ref): the reference day is out, the day w before it is in."""
    t = temporal(temporal_windows=(7,), lookback_days=7)
    ref = date(2020, 1, 8)
    obs = observations(
        spark,
        [("a", 1, ref - timedelta(days=d), float(d), 0) for d in (0, 1, 7, 8)],
    )
    row = zonal.zonal_weather(obs, t, bands=("v",)).where(F.col("reference_date") == ref).first()
    assert (row.weather_v_mean_l7d, row.weather_v_min_l7d) == (4.0, 4.0)
    joined = zonal.lookback_join(obs, t, 7).where(F.col("reference_date") == ref)
    assert sorted(r.gap for r in joined.collect()) == [1, 7]


@pytest.mark.parametrize("stride,windows", [(7, (7, 14, 30)), (5, (3, 7, 11)), (10, (10, 25))])
def test_two_level_statistics_match_pandas(spark, stride, windows):
    import numpy as np

    rng = np.random.default_rng(stride)
    t = temporal(
        reference_stride_days=stride,
        temporal_windows=windows,
        reference_end=date(2020, 4, 1),
    )
    pdf = pd.DataFrame(
        {
            "patch_id": rng.choice(["a", "b"], 800),
            "pixel_id": rng.integers(0, 4, 800),
            "obs_date": [date(2019, 12, 1) + timedelta(days=int(d)) for d in rng.integers(0, 150, 800)],
            "v": rng.normal(size=800),
            "cloud_pct": rng.integers(0, 80, 800),
        }
    )
    obs = spark.createDataFrame(pdf)
    weather = zonal.zonal_weather(obs, t, bands=("v",)).toPandas()
    optical = zonal.zonal_optical(obs, t, bands=("v",)).toPandas()
    checks = 0
    for got, level, clear, prefix in (
        (weather, "mean", False, "weather"),
        (optical, "median", True, "optical"),
    ):
        rows = pdf[pdf.cloud_pct < 40] if clear else pdf
        for r in got.to_dict("records"):
            for w in windows:
                age = rows.obs_date.map(lambda d, r=r: (r["reference_date"] - d).days)
                part = rows[(rows.patch_id == r["patch_id"]) & (age > 0) & (age <= w)]
                pixels = part.groupby("pixel_id").v.agg(level)
                for stat, value in (
                    ("mean", pixels.mean()),
                    ("std", pixels.std(ddof=0)),
                    ("min", pixels.min()),
                    ("max", pixels.max()),
                ):
                    found = r[f"{prefix}_v_{stat}_l{w}d"]
                    if len(pixels):
                        assert found == pytest.approx(value, abs=1e-9)
                        checks += 1
                    else:
                        assert pd.isna(found)
    assert checks > 300


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_large_patches_are_cut_and_merged(spark, partitions):
    """The same statistics whether a patch lies in one part or its pixels in many."""
    rows = [("a", p, date(2020, 1, 1) + timedelta(days=d), float((p * 7 + d) % 13), 0) for p in range(30) for d in range(9)]
    rows += [("b", 1, date(2020, 1, 2), 5.0, 0)]
    obs = observations(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        parts = with_parts(obs, ["patch_id"], F.col("pixel_id"))
        n_parts = {r[0]: r[1] for r in parts.groupBy("patch_id").agg(F.countDistinct("_part")).collect()}
        got = zonal.zonal_weather(obs, temporal(), bands=("v",)).where("reference_date = '2020-01-08'")
        got = {r.patch_id: r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n_parts["b"] == 1 and (n_parts["a"] > 10) == (partitions == "40")
    means = [sum((p * 7 + d) % 13 for d in range(7)) / 7 for p in range(30)]
    row = got["a"]
    assert row.weather_v_mean_l7d == pytest.approx(statistics.fmean(means))
    assert row.weather_v_std_l7d == pytest.approx(statistics.pstdev(means))
    assert (row.weather_v_min_l7d, row.weather_v_max_l7d) == (min(means), max(means))


def test_medians_of_one_long_group(spark):
    values = [float((i * 7919) % 1001) for i in range(6000)] + [None] * 50
    df = spark.createDataFrame([("g", v, i % 60) for i, v in enumerate(values)] + [("h", None, 1)], "g string, v double, gap int")
    spec = {"all": ("v", None), "w9": ("v", 9)}
    got = {r.g: (r["all"], r.w9) for r in zonal.pixel_medians(df, ["g"], spec).collect()}
    near = [v for i, v in enumerate(values) if v is not None and i % 60 <= 9]
    assert got == {"g": (statistics.median(v for v in values if v is not None), statistics.median(near)), "h": (None, None)}


@pytest.mark.parametrize("std", ["pop", "samp"])
def test_streamed_medians_equal_sorted_ones(spark, monkeypatch, std):
    """Cuts between and inside patches change nothing; nothing is sorted or multiplied by Spark."""
    import random
    from functools import partial

    rng = random.Random(7)
    t = temporal(reference_end=date(2020, 3, 25), temporal_windows=(7, 14, 30))
    rows = [
        (rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, None]),
         date(2019, 12, 1) + timedelta(days=rng.randrange(130)),
         rng.choice([None, 0.1, 0.2, rng.random()]), rng.randrange(80))
        for _ in range(500)
    ]
    rows += [("d", p, date(2020, 1, 3), None, 0) for p in (1, 2)] + rows[:40]
    obs = observations(spark, rows).withColumn("u", F.round(F.col("v") * 3, 1))
    run = partial(zonal.zonal_optical, obs, t, bands=("v", "u"), std=std)

    def found(frame):
        return {(r.patch_id, r.reference_date): r.asDict() for r in frame.collect()}

    monkeypatch.setattr(zonal, "has_large_key", lambda *_: False)
    streamed = run()
    plan = streamed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    results = [found(streamed)]
    monkeypatch.setattr(zonal, "streamed_medians", partial(zonal.streamed_medians, chunk=9))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        results.append(found(run()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = zonal.clear_scenes(zonal.visible(obs, t, 30))
    placed = zonal.lookback_join(seen, t, 30)
    spec = {f"{b}_{w}": (b, w) for w in (7, 14, 30) for b in ("v", "u")}
    medians = zonal.pixel_medians(placed, (*zonal.KEY, "pixel_id"), spec)
    stats = [
        c for n in spec for c in zonal.patch_stats(
            F.col(n), f"optical_{n.split('_')[0]}_{{stat}}_l{n.split('_')[1]}d", zonal.STATS, std)
    ]
    want = found(medians.groupBy(*zonal.KEY).agg(*stats))
    assert len(want) > 30 and any(v is None for r in want.values() for v in r.values())
    for got in results:
        assert got.keys() == want.keys()
        for key, row in want.items():
            assert got[key].keys() == row.keys()
            for name, value in row.items():
                assert got[key][name] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value)


def test_empty_optical_window_gives_null_columns(spark):
    t = temporal()
    cloudy = observations(spark, [("0_0", 1, date(2019, 12, 31), 1.0, 40)])
    frame = cloudy.select("*", *[F.col("v").alias(b) for b in zonal.OPTICAL_BANDS])
    stats = zonal.zonal_optical(frame, t)
    joined = panel.panel_skeleton(small_grid(spark), t).join(
        stats, list(panel.PANEL_KEY), "left"
    )
    columns = [c for c in joined.columns if c.startswith("optical_") and c.endswith("_l7d")]
    assert len(columns) == 24
    assert joined.dropna(how="all", subset=columns).count() == 0


def test_burn_windows_use_image_months_and_day_of_year(spark):
    t = temporal(temporal_windows=(7, 14), lookback_days=60)
    obs = spark.createDataFrame(
        [
            ("a", 1, date(2019, 12, 1), 363),  # 2019-12-29
            ("a", 2, date(2019, 12, 1), 0),
            ("a", 2, date(2020, 1, 1), 6),  # 2020-01-06
        ],
        "patch_id string, pixel_id int, obs_date date, burn_doy int",
    )
    rows = {r.reference_date: r for r in zonal.burn_window(obs, t).collect()}
    first = rows[date(2020, 1, 1)]
    assert first.temporal_burn_count_l7d == 0.5
    assert first.temporal_burn_date_l7d == date(2019, 12, 29)
    assert first.temporal_burn_timestamp_l7d == 1577577600000
    second = rows[date(2020, 1, 8)]
    # Only pixel 2 has an image in the months of this window.
    assert second.temporal_burn_count_l7d == 1.0
    assert second.temporal_burn_date_l14d == date(2019, 12, 29)
    whole = {r.reference_date: r for r in zonal.observed_burn(obs, t).collect()}
    assert whole[date(2020, 1, 22)].modis_burn_date == date(2019, 12, 29)


def test_local_peat_share_of_an_empty_patch_is_zero(spark):
    px = spark.createDataFrame(
        [("a", 1.0), ("a", 0.0), ("a", -9.0), ("b", -9.0)], "patch_id string, value double"
    )
    got = {r[0]: r[1] for r in zonal.peat_fraction_local(px, -9.0).collect()}
    assert got == {"a": 0.5, "b": 0.0}


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    p = rng.uniform(0, 2, (40, 2))
    a = rng.uniform(-0.5, 2.5, (150, 2))
    a[:50] = a[0]  # copies
    b = a + rng.uniform(-0.7, 0.7, (150, 2))
    b[:50] = b[0]
    patches = spark.createDataFrame(
        [(str(i), float(x), float(y)) for i, (x, y) in enumerate(p)],
        "patch_id string, centroid_lon double, centroid_lat double",
    )
    roads = spark.createDataFrame(
        [tuple(map(float, (*s, *e))) for s, e in zip(a, b, strict=True)],
        "x1 double, y1 double, x2 double, y2 double",
    )
    got = {r.patch_id: r for r in nearest.nearest_road(patches, roads).collect()}
    for i, q in enumerate(p):
        d = b - a
        t = np.clip(((q - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        dist = np.hypot(*(q - (a + t[:, None] * d)).T)
        row = got[str(i)]
        if dist.min() > 50 / 111:
            assert row.anthropogenic_dist_to_road_km is None
            continue
        assert row.anthropogenic_dist_to_road_km == pytest.approx(dist.min() * 111)
        close = np.hypot(*d.T)[dist < 10 / 111].sum() * 111
        assert row.anthropogenic_road_density_km == pytest.approx(close)
    far = spark.createDataFrame([(50.0, 50.0, "city")], "lon double, lat double, place string")
    alone = nearest.nearest_settlement(patches, far).collect()
    assert {r[1] for r in alone} == {50.0}


@pytest.mark.parametrize("crowd", [0, 4000])
def test_nearest_in_crowds_and_deserts(spark, crowd):
    """Dense towns, long lines, lone features at the edge of reach, against all distances."""
    import numpy as np

    rng = np.random.default_rng(crowd)
    town = rng.normal([10.0, 5.0], 0.003, size=(crowd, 2))
    points = np.concatenate([town, rng.uniform([9, 4], [11, 6], (30, 2)), [[-0.3, -0.2], [-0.3, -0.2]]])
    ends = points + rng.normal(0, 0.002, points.shape)
    ends[-20:] = points[-20:] + rng.uniform(-1.5, 1.5, (20, 2))  # far longer than a cell
    at = np.concatenate([rng.uniform([9, 4], [11, 6], (40, 2)), town[:3], [[0.0, 0.0], [0.15, -0.2], [30, 30]]])
    patches = spark.createDataFrame(
        [(str(i), float(x), float(y)) for i, (x, y) in enumerate(at)], "patch_id string, centroid_lon double, centroid_lat double"
    )
    lines = spark.createDataFrame(np.hstack([points, ends]).tolist(), "x1 double, y1 double, x2 double, y2 double")
    reach = 50 / 111.0
    away = ends - points
    long2 = (away**2).sum(axis=1)
    t = np.clip(((at[:, None] - points) * away).sum(axis=2) / np.where(long2 > 0, long2, 1), 0, 1)
    to_line = np.linalg.norm(at[:, None] - points - t[..., None] * away, axis=2)
    to_point = np.linalg.norm(at[:, None] - points, axis=2)
    roads = {r.patch_id: r for r in nearest.nearest_road(patches, lines).collect()}
    rivers = {r.patch_id: r[1] for r in nearest.nearest_river(patches, lines, "x1", "y1", to=("x2", "y2")).collect()}
    vertices = {r.patch_id: r[1] for r in nearest.nearest_river(patches, lines, "x1", "y1").collect()}
    unique = np.unique(np.hstack([points, ends]), axis=0, return_index=True)[1]
    assert len(unique) >= len(points) - 1
    for i in range(len(at)):
        line, point = to_line[i].min(), to_point[i].min()
        assert rivers[str(i)] == (pytest.approx(line * 111_000) if line <= reach else None)
        assert vertices[str(i)] == (pytest.approx(point * 111_000) if point <= reach else None)
        near = to_line[i] < 10 / 111.0
        want = (np.sqrt(long2) * near).sum() * 111 if line <= reach else None
        assert roads[str(i)].anthropogenic_road_density_km == (None if want is None else pytest.approx(want))
        assert roads[str(i)].anthropogenic_dist_to_road_km == (None if want is None else pytest.approx(line * 111))


def test_cells_of_a_line_come_once_without_a_table_of_them(spark, capsys):
    import numpy as np

    rng = np.random.default_rng(11)
    ends = np.hstack([a := rng.uniform(-1, 1, (60, 2)), a + rng.normal(0, 0.4, (60, 2))])
    ends[0, 2:] = ends[0, :2]
    names = ("x1", "y1", "x2", "y2")
    cells = nearest._cut(spark.createDataFrame(ends.tolist(), ", ".join(f"{n} double" for n in names)), names, 0.1)
    capsys.readouterr()
    cells.explain()
    assert "Aggregate" not in capsys.readouterr().out
    rows = [tuple(r) for r in cells.collect()]
    assert len(rows) == len(set(rows))
    met = {r for r in rows}
    for line in ends.tolist():
        for t in np.linspace(0, 1, 400):
            x, y = line[0] + t * (line[2] - line[0]), line[1] + t * (line[3] - line[1])
            assert (*line, math.floor(x / 0.1), math.floor(y / 0.1)) in met


def test_patches_beside_a_feature_look_at_small_cells_only(spark, monkeypatch):
    points = [(i / 40, j / 40) for i in range(40) for j in range(40)]
    features = spark.createDataFrame(points, "lon double, lat double")
    at = [(str(i), 0.3 + i / 1000, 0.4 + i / 700) for i in range(50)]
    patches = spark.createDataFrame(at, "patch_id string, centroid_lon double, centroid_lat double")

    def never(*_):
        raise AssertionError("went down from the large cells")

    monkeypatch.setattr(nearest, "_descend", never)
    got = {r[0]: r[1] for r in nearest.nearest_river(patches, features).collect()}
    for patch, x, y in at:
        want = min(math.hypot(x - a, y - b) for a, b in points)
        assert got[patch] == pytest.approx(want * 111_000)


def test_stage_preference_and_manifest(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.load_stage(spark, folder, "risk")
    for stage in ("dataset", "features", "labeled_features_risk"):
        frame = spark.createDataFrame([(stage, float("nan"))], "stage string, v double")
        tables.write_stage(frame, folder, stage)
    assert tables.load_stage(spark, folder, "risk").first().stage == "labeled_features_risk"
    row = tables.load_stage(spark, folder, "occurrence").first()
    assert (row.stage, row.v) == ("features", None)
    path = f"{folder}/dataset.parquet"
    first = tables.dataset_manifest(spark, path, {"b": 1, "a": 2}, {"patch_count": 3})
    again = tables.dataset_manifest(spark, path, {"a": 2, "b": 1})
    assert first["row_count"] == 1 and first["patch_count"] == 3
    assert first["dataset_sha256"] == again["dataset_sha256"]
    assert first["config_sha256"] == again["config_sha256"]


def test_skeleton_rows_are_generated_by_several_tasks(spark):
    grid = spark.range(40).select(F.col("id").cast("string").alias("patch_id")).coalesce(1)
    rows = panel.panel_skeleton(grid, temporal())
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
    assert rows.count() == 40 * temporal().n_reference_dates


def test_rows_of_the_panel_key_are_not_broadcast(spark, capsys):
    """Not even where a filter turns the left join into an inner one."""
    grid = spark.range(40).select(F.col("id").cast("string").alias("patch_id"))
    rows = panel.panel_skeleton(grid, temporal())
    found = rows.groupBy("patch_id", "reference_date").agg(F.count(F.lit(1)).alias("n"))
    for joined in (panel.on_panel_key(rows, found), panel.on_panel_key(rows, found).where("n > 0")):
        assert joined.count() == rows.count()
        capsys.readouterr()
        joined.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_patches_of_usual_size_are_shuffled_once(spark, capsys):
    rows = [(f"p{k}", p, date(2020, 1, 1) + timedelta(days=d), float((p * k + d) % 13), 0)
            for k in range(60) for p in range(3) for d in range(9)]
    rows += [("large", p, date(2020, 1, 1) + timedelta(days=d), float(p + d), 0) for p in range(40) for d in range(9)]
    for kept, exchanges in ((rows[: 60 * 27], 1), (rows, None)):
        out = zonal.zonal_weather(observations(spark, kept), temporal(), bands=("v",))
        capsys.readouterr()
        out.explain()
        plan = capsys.readouterr().out
        assert exchanges is None or plan.count("Exchange") == exchanges
        got = {r.patch_id: r for r in out.where("reference_date = '2020-01-08'").collect()}
        assert len(got) == len({r[0] for r in kept})
        for patch, row in got.items():
            of = [r for r in kept if r[0] == patch and 0 < (date(2020, 1, 8) - r[2]).days <= 7]
            pixels = {p: statistics.fmean(r[3] for r in of if r[1] == p) for _, p, *_ in of}
            assert row.weather_v_mean_l7d == pytest.approx(statistics.fmean(pixels.values()))
            assert row.weather_v_max_l7d == max(pixels.values())


@pytest.mark.parametrize("std", ["pop", "samp"])
def test_streamed_means_equal_grouped_ones(spark, monkeypatch, std):
    """Weather rows are multiplied to their dates in the tasks only, nulls and nameless pixels included."""
    import random

    rng = random.Random(11)
    t = temporal(reference_end=date(2020, 3, 25), temporal_windows=(7, 14, 30))
    rows = [
        (rng.choice(["a", "b", None]), rng.choice([1, 2, None]), date(2019, 12, 1) + timedelta(days=rng.randrange(130)),
         rng.choice([None, 0.1, 0.2, float("nan"), rng.random()]), 0)
        for _ in range(300)
    ]
    obs = observations(spark, rows + [("d", 1, date(2020, 1, 3), None, 0)])
    monkeypatch.setattr(zonal, "has_large_key", lambda *_: False)
    streamed = zonal.zonal_weather(obs, t, bands=("v",), std=std)
    plan = streamed._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    seen = zonal.visible(obs, t, 30)
    placed = zonal.lookback_join(seen, t, 30)
    per_pixel = placed.groupBy(*zonal.KEY, "pixel_id").agg(
        *[F.avg(F.when(F.col("gap") <= w, F.col("v"))).alias(f"v{w}") for w in (7, 14, 30)]
    )
    want = per_pixel.groupBy(*zonal.KEY).agg(
        *[c for w in (7, 14, 30) for c in zonal.patch_stats(F.col(f"v{w}"), f"weather_v_{{stat}}_l{w}d", zonal.STATS, std)]
    )
    got, want = ({(r.patch_id, r.reference_date): r.asDict() for r in f.collect()} for f in (streamed, want))
    assert got.keys() == want.keys() and len(got) > 20
    for key, row in want.items():
        assert got[key].keys() == row.keys()
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value)


def test_rounded_equals_round(spark):
    from pyrogrid.plans.registry import rounded

    value = (F.floor(F.rand(3) * 2e7) - 1e7 + 0.5) / 1e6
    frames = [value, value + F.randn(4) * 1e-10, F.randn(5) * F.pow(F.lit(10.0), F.floor(F.rand(6) * 14) - 5)]
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0, 5e-7, -5e-7, 1.0000005, -2.3456785, 1e300, 5.1e4]
    df = spark.createDataFrame([(x,) for x in odd], "v double")
    for c in frames:
        df = df.union(spark.range(20_000).select(c.alias("v")))
    wrong = df.where(~rounded(F.col("v")).eqNullSafe(F.round("v", 6) + F.lit(0.0)))
    assert wrong.count() == 0

"""Queries over grids, spines, panels, zonal aggregation and nearest features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyrogrid.config import SourceConfig
from pyrogrid.operators.metrics import regression_metrics
from pyrogrid.operators.splits import spatial_blocks
from pyrogrid.plans import inputs as T
from pyrogrid.plans.inputs import TEMPORAL, WINDOWS, with_tables
from pyrogrid.plans.registry import KEY, REGISTRY, fields, query
from pyrogrid.session import scratch_path, wide_rows_kept
from pyrogrid.sources import nearest, panel, tables, zonal
from pyrogrid.sources.grid import assign_patch, patch_grid

GRID_KM = 10
STAT_SQL = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}


def _join_columns(columns) -> str:
    return ", ".join(columns)


# --- sources, sinks, panel construction


@query(
    "panel_scan",
    "event_id:i day:d user_id:i event_type value:f",
    "SELECT event_id, CAST(ts AS DATE) AS day, user_id, event_type, value FROM events",
)
def panel_scan(spark, sf):
    stage = tables.load_stage(spark, sf, "occurrence", "events")
    return stage.withColumn("day", F.col("ts").cast("date"))


@query(
    "panel_write",
    "split rows:i positives:i",
    with_tables(
        "SELECT split, count(*) AS rows, sum(y_occ_30d) AS positives FROM scored GROUP BY split",
        "scored",
    ),
)
def panel_write(spark, sf):
    folder = scratch_path(spark, "outputs")
    rows = T.scored(spark, sf)
    scalars = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y_occ_30d").alias("positives")
    )
    tables.write_outputs(rows, scalars, folder, summary=scalars)
    stored = spark.read.parquet(f"{folder}/predictions.parquet")
    return stored.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y_occ_30d").alias("positives")
    )


LAT_STEP = f"({GRID_KM} / 110.574::DOUBLE)"
BOX_SQL = f"""
WITH boxes AS (
  SELECT c_custkey,
    95 + (c_custkey % 40) * 1.0::DOUBLE AS lon_min,
    95 + (c_custkey % 40) * 1.0::DOUBLE + 0.31::DOUBLE AS lon_max,
    -10 + (c_custkey // 40 % 20) * 1.0::DOUBLE AS lat_min,
    -10 + (c_custkey // 40 % 20) * 1.0::DOUBLE + 0.22::DOUBLE AS lat_max
  FROM customer),
r AS (
  SELECT *, unnest(range(0, CAST(ceil((lat_max - 1e-9::DOUBLE - lat_min) / {LAT_STEP}) AS BIGINT)))
    AS patch_row FROM boxes),
s AS (
  SELECT *, lat_min + patch_row * {LAT_STEP} AS min_lat,
    least(lat_min + patch_row * {LAT_STEP} + {LAT_STEP}, lat_max) AS max_lat FROM r),
w AS (
  SELECT *, {GRID_KM} / greatest(111.32::DOUBLE * cos(radians((min_lat + max_lat) / 2)),
    1e-6::DOUBLE) AS step FROM s),
c AS (
  SELECT *, unnest(range(0, CAST(ceil((lon_max - 1e-9::DOUBLE - lon_min) / step) AS BIGINT)))
    AS patch_col FROM w)
SELECT c_custkey, concat(patch_row, '_', patch_col) AS patch_id, patch_row, patch_col,
  lon_min + patch_col * step AS min_lon,
  least(lon_min + patch_col * step + step, lon_max) AS max_lon, min_lat, max_lat,
  (lon_min + patch_col * step + least(lon_min + patch_col * step + step, lon_max)) / 2
    AS centroid_lon,
  (min_lat + max_lat) / 2 AS centroid_lat
FROM c"""


@query(
    "patch_grid",
    "c_custkey:i patch_id patch_row:i patch_col:i min_lon:f max_lon:f min_lat:f max_lat:f "
    "centroid_lon:f centroid_lat:f",
    BOX_SQL,
)
def grids_of_boxes(spark, sf):
    k = F.col("c_custkey")
    lon, lat = F.lit(95) + (k % 40) * 1.0, F.lit(-10) + (F.floor(k / 40) % 20) * 1.0
    boxes = T.table(spark, sf, "customer").select(
        k,
        lon.alias("lon_min"),
        (lon + 0.31).alias("lon_max"),
        lat.alias("lat_min"),
        (lat + 0.22).alias("lat_max"),
    )
    return patch_grid(boxes, GRID_KM, keys=("c_custkey",))


@query(
    "reference_spine",
    "k:i reference_date:d",
    """SELECT k, CAST(unnest(generate_series(a, b + 37, INTERVAL 7 DAY)) AS DATE) AS reference_date
    FROM (SELECT l_suppkey AS k, CAST(min(l_shipdate) AS DATE) AS a,
          CAST(max(l_shipdate) AS DATE) AS b FROM lineitem GROUP BY l_suppkey)""",
)
def reference_spine(spark, sf):
    day = F.col("l_shipdate").cast("date")
    bounds = (
        T.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("k"))
        .agg(F.min(day).alias("reference_start"), F.max(day).alias("reference_end"))
    )
    return panel.reference_spine(bounds, 7, TEMPORAL.padding_days)


SKELETON = f"{KEY} patch_row:i patch_col:i centroid_lon:f centroid_lat:f"


@query("panel_skeleton", SKELETON, with_tables("SELECT * FROM skeleton", "skeleton"))
def panel_skeleton(spark, sf):
    return T.skeleton(spark, sf)


def _pixel_means(bands, windows) -> str:
    """Per-pixel time means of every window, as a SQL subquery body."""
    values = _join_columns(
        f"avg(CASE WHEN ref - obs_date <= {w} THEN {b} END) AS {b}_{w}"
        for w in windows
        for b in bands
    )
    return (
        f"SELECT patch_id, ref AS reference_date, pixel_id, {values} FROM obs JOIN spine "
        f"ON obs_date < ref AND obs_date >= ref - {max(windows)} GROUP BY 1, 2, 3"
    )


def _patch_stats(prefix, bands, windows, inner) -> str:
    stats = _join_columns(
        f"{fn}({b}_{w}) AS {prefix}_{b}_{s}_l{w}d"
        for w in windows
        for b in bands
        for s, fn in STAT_SQL.items()
    )
    return f"SELECT patch_id, reference_date, {stats} FROM ({inner}) GROUP BY 1, 2"


def _stat_names(prefix, bands, windows):
    return [
        f"{prefix}_{b}_{s}_l{w}d" for w in windows for b in bands for s in STAT_SQL
    ]


FIRE_SQL = (
    "SELECT patch_id, reference_date, "
    + _join_columns(f"avg(h_{w}) AS temporal_fire_count_l{w}d" for w in WINDOWS)
    + " FROM (SELECT patch_id, ref AS reference_date, pixel_id, "
    + _join_columns(
        f"sum(CASE WHEN ref - obs_date <= {w} THEN CAST(fire_mask >= 7 AS INTEGER) END) AS h_{w}"
        for w in WINDOWS
    )
    + " FROM obs JOIN spine ON obs_date < ref AND obs_date >= ref - 60 GROUP BY 1, 2, 3) "
    "GROUP BY 1, 2"
)
TERRAIN_NAMES = [f"terrain_elevation_{s}" for s in STAT_SQL] + [
    f"terrain_{v}_{s}" for v in ("slope", "twi") for s in ("mean", "std")
]
TERRAIN_SQL = (
    "SELECT patch_id, "
    + _join_columns(
        f"{STAT_SQL[n.rsplit('_', 1)[1]]}({n.split('_')[1]}) AS {n}" for n in TERRAIN_NAMES
    )
    + " FROM (SELECT *, -ln(greatest(tan(slope * (3.14159::DOUBLE / 180)), 0.001::DOUBLE)) AS twi"
    " FROM pixels) GROUP BY patch_id"
)
ASSEMBLED_BANDS = ("temperature_2m", "total_precipitation_sum")
ASSEMBLED = (
    SKELETON
    + " "
    + fields(
        [
            *TERRAIN_NAMES,
            *[f"temporal_fire_count_l{w}d" for w in WINDOWS],
            *_stat_names("weather", ASSEMBLED_BANDS, WINDOWS),
            "peat_fraction",
        ]
    )
)


@query(
    "panel_assemble",
    ASSEMBLED,
    with_tables(
        f"""SELECT s.*, t.* EXCLUDE (patch_id), f.* EXCLUDE (patch_id, reference_date),
        w.* EXCLUDE (patch_id, reference_date), NULL AS peat_fraction FROM skeleton s
        LEFT JOIN ({TERRAIN_SQL}) t ON t.patch_id = s.patch_id
        LEFT JOIN ({FIRE_SQL}) f
            ON f.patch_id = s.patch_id AND f.reference_date = s.reference_date
        LEFT JOIN ({_patch_stats("weather", ASSEMBLED_BANDS, WINDOWS,
                                 _pixel_means(ASSEMBLED_BANDS, WINDOWS))}) w
            ON w.patch_id = s.patch_id AND w.reference_date = s.reference_date""",
        "skeleton",
        "pixels",
        "obs",
        "spine",
    ),
)
def panel_assemble(spark, sf):
    obs = T.observations(spark, sf)
    registry = {
        "srtm": panel.PanelSource(
            lambda: zonal.zonal_terrain(T.static_pixels(spark, sf)), TERRAIN_NAMES, static=True
        ),
        "modis_fire": panel.PanelSource(
            lambda: zonal.fire_count_window(obs, TEMPORAL),
            [f"temporal_fire_count_l{w}d" for w in WINDOWS],
        ),
        "era5": panel.PanelSource(
            lambda: zonal.zonal_weather(obs, TEMPORAL, ASSEMBLED_BANDS),
            _stat_names("weather", ASSEMBLED_BANDS, WINDOWS),
        ),
        "peat": panel.PanelSource(
            lambda: spark.read.parquet(f"{sf}/no_such_raster.parquet"),
            ["peat_fraction"],
            static=True,
        ),
    }
    sources = [SourceConfig(n) for n in registry] + [SourceConfig("worldpop", enabled=False)]
    return panel.assemble_panel(T.grid(spark, sf), TEMPORAL, registry, sources, strict=False)


@query(
    "panel_incremental",
    f"block_id {KEY}",
    with_tables(
        "SELECT concat(patch_row // 5, '_', patch_col // 5) AS block_id, patch_id, "
        "reference_date FROM skeleton",
        "skeleton",
    ),
)
def panel_incremental(spark, sf):
    """A first slice, then the whole grid: only blocks with open patches are built again."""
    path = scratch_path(spark, "incremental")
    grid = spatial_blocks(T.grid(spark, sf), 50, GRID_KM)

    def build(part):
        return panel.panel_skeleton(part, TEMPORAL, extra=("block_id",))

    panel.build_incremental(panel.patch_slice(grid, 0, 3), build, path)
    panel.build_incremental(grid, build, path)
    return spark.read.parquet(path)


CONFIG_JSON = '{"grid_km": 10, "windows": [7, 14, 30, 60]}'


@query(
    "dataset_manifest",
    "row_count:i patch_count:i reference_date_count:i future_padding_days:i config_sha256",
    with_tables(
        "SELECT count(*) AS row_count, count(DISTINCT patch_id) AS patch_count, "
        "count(DISTINCT reference_date) AS reference_date_count, 37 AS future_padding_days, "
        f"sha256('{CONFIG_JSON}') AS config_sha256 FROM skeleton",
        "skeleton",
    ),
)
def dataset_manifest(spark, sf):
    path = tables.write_stage(T.skeleton(spark, sf), scratch_path(spark, "stage"), "dataset")
    counts = (
        spark.read.parquet(path)
        .agg(
            F.countDistinct("patch_id").alias("patch_count"),
            F.countDistinct("reference_date").alias("reference_date_count"),
        )
        .first()
        .asDict()
    )
    manifest = tables.dataset_manifest(
        spark,
        path,
        {"windows": list(WINDOWS), "grid_km": GRID_KM},
        {**counts, "future_padding_days": TEMPORAL.padding_days},
    )
    return spark.createDataFrame([manifest])


@query(
    "metrics_collect",
    "experiment rmse:f mae:f r2:f bias:f",
    with_tables(
        """SELECT split AS experiment, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
        1 - avg(e * e) / var_pop(y_sev_dnbr) AS r2, avg(e) AS bias
        FROM (SELECT *, severity_prediction - y_sev_dnbr AS e FROM scored
              WHERE y_sev_available = 1) GROUP BY split""",
        "scored",
    ),
)
def metrics_collect(spark, sf):
    folder = scratch_path(spark, "runs")
    known = T.scored(spark, sf).where(F.col("y_sev_available") == 1)
    for split in ("train", "val", "test", "embargo"):
        metrics = regression_metrics(
            known.where(F.col("split") == split), "y_sev_dnbr", "severity_prediction"
        )
        metrics.coalesce(1).write.json(f"{folder}/{split}/metrics.json")
    return tables.collect_metrics(spark, folder)


LON_SQL = "100 + (event_id * 37 % 6000) / 1000.0::DOUBLE"
LAT_SQL = "-3 + (event_id * 91 % 5000) / 1000.0::DOUBLE"
ROWS = f"CAST(ceil((1.5::DOUBLE - 1e-9::DOUBLE + 2.5::DOUBLE) / {LAT_STEP}) AS BIGINT)"


@query(
    "assign_patch",
    "event_id:i patch_id patch_row:f patch_col:f",
    f"""WITH pts AS (SELECT event_id, {LON_SQL} AS lon, {LAT_SQL} AS lat FROM events),
    i AS (SELECT *, lon BETWEEN 100.5 AND 105.5 AND lat BETWEEN -2.5 AND 1.5 AS inside,
      least(CAST(floor((lat + 2.5::DOUBLE) / {LAT_STEP}) AS BIGINT), {ROWS} - 1) AS r FROM pts),
    s AS (SELECT *, {GRID_KM} / greatest(111.32::DOUBLE * cos(radians(
      ((-2.5::DOUBLE + r * {LAT_STEP})
       + least(-2.5::DOUBLE + r * {LAT_STEP} + {LAT_STEP}, 1.5::DOUBLE)) / 2)), 1e-6::DOUBLE)
      AS step FROM i),
    c AS (SELECT *, least(CAST(floor((lon - 100.5::DOUBLE) / step) AS BIGINT),
      CAST(ceil((105.5::DOUBLE - 1e-9::DOUBLE - 100.5::DOUBLE) / step) AS BIGINT) - 1) AS col
      FROM s)
    SELECT event_id, CASE WHEN inside THEN concat(r, '_', col) END AS patch_id,
      CASE WHEN inside THEN r END AS patch_row, CASE WHEN inside THEN col END AS patch_col
    FROM c""",
)
def points_to_patches(spark, sf):
    k = F.col("event_id")
    points = T.table(spark, sf, "events").select(
        k,
        (F.lit(100) + (k * 37 % 6000) / 1000.0).alias("lon"),
        (F.lit(-3) + (k * 91 % 5000) / 1000.0).alias("lat"),
    )
    return assign_patch(points, T.BBOX, GRID_KM)


# --- zonal and temporal aggregation


@query(
    "lookback_join",
    f"{KEY} n:i total:f first_gap:i last_gap:i",
    with_tables(
        """SELECT patch_id, ref AS reference_date, count(*) AS n, sum(q) AS total,
        min(ref - obs_date) AS first_gap, max(ref - obs_date) AS last_gap
        FROM obs JOIN spine ON obs_date < ref AND obs_date >= ref - 30 GROUP BY 1, 2""",
        "obs",
        "spine",
    ),
)
def lookback(spark, sf):
    obs = zonal.visible(T.observations(spark, sf), TEMPORAL, 30)
    return (
        zonal.lookback_join(obs, TEMPORAL, 30)
        .groupBy("patch_id", "reference_date")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("q").alias("total"),
            F.min("gap").alias("first_gap"),
            F.max("gap").alias("last_gap"),
        )
    )


@query(
    "zonal_weather",
    f"{KEY} {fields(_stat_names('weather', zonal.WEATHER_BANDS, WINDOWS))}",
    with_tables(
        _patch_stats(
            "weather", zonal.WEATHER_BANDS, WINDOWS, _pixel_means(zonal.WEATHER_BANDS, WINDOWS)
        ),
        "obs",
        "spine",
    ),
)
def zonal_weather(spark, sf):
    wide_rows_kept(spark)
    return zonal.zonal_weather(T.observations(spark, sf), TEMPORAL)


def _pixel_medians(bands, windows) -> str:
    values = _join_columns(
        f"quantile_cont(CASE WHEN ref - obs_date <= {w} THEN {b} END, 0.5) AS {b}_{w}"
        for w in windows
        for b in bands
    )
    return (
        f"SELECT patch_id, ref AS reference_date, pixel_id, {values} FROM obs JOIN spine "
        f"ON obs_date < ref AND obs_date >= ref - {max(windows)} WHERE cloud_pct < 40 "
        "GROUP BY 1, 2, 3"
    )


OPTICAL_SQL = _patch_stats(
    "optical", zonal.OPTICAL_BANDS, WINDOWS, _pixel_medians(zonal.OPTICAL_BANDS, WINDOWS)
)
OPTICAL = fields(_stat_names("optical", zonal.OPTICAL_BANDS, WINDOWS))


@query(
    "zonal_optical",
    f"{KEY} {OPTICAL}",
    with_tables(
        "SELECT s.patch_id, s.reference_date, z.* EXCLUDE (patch_id, reference_date) "
        f"FROM skeleton s LEFT JOIN ({OPTICAL_SQL}) z "
        "ON z.patch_id = s.patch_id AND z.reference_date = s.reference_date",
        "skeleton",
        "obs",
        "spine",
    ),
)
def zonal_optical(spark, sf):
    wide_rows_kept(spark)
    composites = zonal.zonal_optical(T.observations(spark, sf), TEMPORAL)
    return panel.on_panel_key(T.skeleton(spark, sf), composites)


@query(
    "zonal_terrain",
    f"patch_id {fields(TERRAIN_NAMES)}",
    with_tables(TERRAIN_SQL, "pixels"),
)
def zonal_terrain(spark, sf):
    return zonal.zonal_terrain(T.static_pixels(spark, sf))


@query(
    "fire_count_window",
    f"{KEY} {fields(f'temporal_fire_count_l{w}d' for w in WINDOWS)}",
    with_tables(FIRE_SQL, "obs", "spine"),
)
def fire_counts(spark, sf):
    return zonal.fire_count_window(T.observations(spark, sf), TEMPORAL)


def _burn_sql(windows) -> str:
    """Two-level burn aggregate; images are chosen by month, burns by day."""
    longest = max(windows)

    def image(w):
        return (
            f"obs_date >= date_trunc('month', ref - {w}) "
            "AND obs_date < date_trunc('month', ref) + INTERVAL 1 MONTH"
        )

    inner = _join_columns(
        f"max(CASE WHEN {image(w)} THEN CAST(coalesce(b >= ref - {w} AND b < ref, false) "
        f"AS INTEGER) END) AS b_{w}, "
        f"min(CASE WHEN {image(w)} AND b >= ref - {w} AND b < ref THEN b END) AS d_{w}"
        for w in windows
    )
    outer = _join_columns(f"avg(b_{w}) AS b_{w}, min(d_{w}) AS d_{w}" for w in windows)
    return (
        f"SELECT patch_id, reference_date, {outer} FROM (SELECT patch_id, ref AS reference_date, "
        f"pixel_id, {inner} FROM (SELECT *, CASE WHEN burn_doy > 0 THEN "
        "make_date(CAST(year(obs_date) AS BIGINT), 1, 1) + CAST(burn_doy - 1 AS INTEGER) END AS b "
        f"FROM obs) JOIN spine ON {image(longest)} GROUP BY 1, 2, 3) GROUP BY 1, 2"
    )


MS_SQL = "CAST({0} - DATE '1970-01-01' AS BIGINT) * 86400000"


@query(
    "burn_window",
    f"{KEY} "
    + " ".join(
        f"temporal_burn_count_l{w}d:f temporal_burn_timestamp_l{w}d:f temporal_burn_date_l{w}d:d"
        for w in WINDOWS
    ),
    with_tables(
        "SELECT patch_id, reference_date, "
        + _join_columns(
            f"b_{w} AS temporal_burn_count_l{w}d, "
            f"{MS_SQL.format(f'd_{w}')} AS temporal_burn_timestamp_l{w}d, "
            f"d_{w} AS temporal_burn_date_l{w}d"
            for w in WINDOWS
        )
        + f" FROM ({_burn_sql(WINDOWS)})",
        "obs",
        "spine",
    ),
)
def burn_windows(spark, sf):
    return zonal.burn_window(T.observations(spark, sf), TEMPORAL)


@query(
    "observed_burn",
    f"{KEY} modis_burn_timestamp:f modis_burn_date:d",
    with_tables(
        f"SELECT patch_id, reference_date, {MS_SQL.format('d_60')} AS modis_burn_timestamp, "
        f"d_60 AS modis_burn_date FROM ({_burn_sql([60])})",
        "obs",
        "spine",
    ),
)
def observed_burn(spark, sf):
    return zonal.observed_burn(T.observations(spark, sf), TEMPORAL)


SHARES = [f"landcover_{c}_fraction" for c in zonal.LANDCOVER_CLASSES]


@query(
    "landcover_fraction",
    f"{KEY} {fields(SHARES)}",
    with_tables(
        "SELECT patch_id, reference_date, "
        + _join_columns(
            f"avg(CAST(label = {i} AS INTEGER)) AS {n}" for i, n in enumerate(SHARES)
        )
        + """ FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, reference_date, pixel_id
            ORDER BY n DESC, label) AS place FROM (
            SELECT patch_id, ref AS reference_date, pixel_id, label, count(*) AS n
            FROM obs JOIN spine ON obs_date < ref AND obs_date >= ref - 60
            GROUP BY 1, 2, 3, 4)) WHERE place = 1 GROUP BY 1, 2""",
        "obs",
        "spine",
    ),
)
def landcover(spark, sf):
    return zonal.landcover_fraction(T.observations(spark, sf), TEMPORAL)


@query(
    "peat_fraction",
    "patch_id raster_mean:f valid_share:f",
    with_tables(
        """SELECT patch_id, avg(peat) AS raster_mean,
        count_if(value > 0) / greatest(count_if(value <> -1), 1) AS valid_share
        FROM pixels GROUP BY patch_id""",
        "pixels",
    ),
)
def peat(spark, sf):
    pixels = T.static_pixels(spark, sf)
    mean = zonal.peat_fraction(pixels, "peat").withColumnRenamed("peat_fraction", "raster_mean")
    share = zonal.peat_fraction_local(pixels, -1.0).withColumnRenamed(
        "peat_fraction", "valid_share"
    )
    return mean.join(share, "patch_id")


@query(
    "population_stats",
    f"{KEY} human_population_mean:f human_population_max:f",
    with_tables(
        """SELECT patch_id, ref AS reference_date, human_population_mean, human_population_max
        FROM spine JOIN (SELECT patch_id, y, avg(v) AS human_population_mean,
            max(v) AS human_population_max FROM (
            SELECT patch_id, year(obs_date) AS y, pixel_id, avg(p) AS v FROM (
                SELECT patch_id, obs_date, pixel_id, layer, q AS p FROM obs) GROUP BY 1, 2, 3)
            GROUP BY 1, 2) ON year(ref) = y""",
        "obs",
        "spine",
    ),
)
def population(spark, sf):
    layers = T.observations(spark, sf).select(
        "patch_id", "pixel_id", F.year("obs_date").alias("year"), F.col("q").alias("population")
    )
    return zonal.population_stats(layers, TEMPORAL)


# --- the panel with all sources

DATED = (
    "zonal_weather", "zonal_optical", "fire_count_window", "burn_window", "observed_burn",
    "landcover_fraction", "population_stats",
)
BURNED = [f"temporal_burn_{c}_l{w}d" for w in WINDOWS for c in ("count", "timestamp", "date")]
OBSERVED = ["modis_burn_timestamp", "modis_burn_date"]
PEOPLE = ["human_population_mean", "human_population_max"]
WIDE = " ".join(
    [SKELETON, fields(TERRAIN_NAMES), "peat_fraction:f", fields(_stat_names("weather", zonal.WEATHER_BANDS, WINDOWS)), OPTICAL]
    + [fields(f"temporal_fire_count_l{w}d" for w in WINDOWS)]
    + [f"{c}:{'d' if '_date' in c else 'f'}" for c in (*BURNED, *OBSERVED)]
    + [fields(SHARES), fields(PEOPLE)]
)


def _wide_sql() -> str:
    """The twins of the sources joined to the skeleton."""
    static = [("zonal_terrain", "*"), ("peat_fraction", "patch_id, raster_mean AS peat_fraction")]
    joins = [
        f"LEFT JOIN (SELECT {c} FROM ({REGISTRY[n].sql})) USING (patch_id)" for n, c in static
    ] + [f"LEFT JOIN ({REGISTRY[n].sql}) USING (patch_id, reference_date)" for n in DATED]
    return f"SELECT * FROM ({REGISTRY['panel_skeleton'].sql}) " + " ".join(joins)


@query("panel_assemble_full", WIDE, _wide_sql())
def panel_of_all_sources(spark, sf):
    """All eight sources with all their bands.

    Every dated source ends partitioned by the panel key, so only the skeleton is exchanged to
    join them.
    """
    wide_rows_kept(spark)
    obs, pixels = T.observations(spark, sf), T.static_pixels(spark, sf)
    layers = obs.select(
        "patch_id", "pixel_id", F.year("obs_date").alias("year"), F.col("q").alias("population")
    )

    def burns():
        found = zonal.burn_window(obs, TEMPORAL)
        observed = zonal.observed_burn(obs, TEMPORAL)
        return found.join(observed.hint("merge"), list(panel.PANEL_KEY), "full")

    made = {
        "srtm": (lambda: zonal.zonal_terrain(pixels), TERRAIN_NAMES),
        "peat": (lambda: zonal.peat_fraction(pixels, "peat"), ["peat_fraction"]),
        "era5": (lambda: zonal.zonal_weather(obs, TEMPORAL), _stat_names("weather", zonal.WEATHER_BANDS, WINDOWS)),
        "sentinel2": (lambda: zonal.zonal_optical(obs, TEMPORAL), _stat_names("optical", zonal.OPTICAL_BANDS, WINDOWS)),
        "modis_fire": (lambda: zonal.fire_count_window(obs, TEMPORAL), [f"temporal_fire_count_l{w}d" for w in WINDOWS]),
        "modis_burn": (burns, [*BURNED, *OBSERVED]),
        "dynamic_world": (lambda: zonal.landcover_fraction(obs, TEMPORAL), SHARES),
        "worldpop": (lambda: zonal.population_stats(layers, TEMPORAL), PEOPLE),
    }
    registry = {n: panel.PanelSource(b, c, static=n in ("srtm", "peat")) for n, (b, c) in made.items()}
    sources = [SourceConfig(n) for n in registry]
    return panel.assemble_panel(T.grid(spark, sf), TEMPORAL, registry, sources)


# --- nearest features

CENTRE_SQL = (
    "SELECT c_custkey AS patch_id, 95 + (c_custkey * 6007 % 40000) / 1000.0::DOUBLE AS x, "
    "-10 + (c_custkey * 5003 % 20000) / 1000.0::DOUBLE AS y FROM customer"
)
ROAD_SQL = (
    "SELECT o_orderkey AS k, 95 + (o_orderkey * 7919 % 40000) / 1000.0::DOUBLE AS x1, "
    "-10 + (o_orderkey * 104729 % 20000) / 1000.0::DOUBLE AS y1, "
    "(o_orderkey % 21 - 10) / 100.0::DOUBLE AS ex, (o_orderkey % 13 - 6) / 100.0::DOUBLE AS ey "
    "FROM orders"
)
REACH = "(50 / 111.0::DOUBLE)"


def _centres(spark, sf):
    k = F.col("c_custkey")
    return T.table(spark, sf, "customer").select(
        k.cast("string").alias("patch_id"),
        (F.lit(95) + (k * 6007 % 40000) / 1000.0).alias("centroid_lon"),
        (F.lit(-10) + (k * 5003 % 20000) / 1000.0).alias("centroid_lat"),
    )


def _roads(spark, sf):
    k = F.col("o_orderkey")
    x, y = F.lit(95) + (k * 7919 % 40000) / 1000.0, F.lit(-10) + (k * 104729 % 20000) / 1000.0
    place = F.element_at(
        F.array(*[F.lit(p) for p in ("city", "town", "village", "hamlet", "farm")]),
        (k % 5 + 1).cast("int"),
    )
    return T.table(spark, sf, "orders").select(
        x.alias("x1"),
        y.alias("y1"),
        (x + (k % 21 - 10) / 100.0).alias("x2"),
        (y + (k % 13 - 6) / 100.0).alias("y2"),
        place.alias("place"),
    )


@query(
    "nearest_road",
    "patch_id anthropogenic_dist_to_road_km:f anthropogenic_road_density_km:f",
    f"""WITH c AS ({CENTRE_SQL}), s0 AS ({ROAD_SQL}),
    s AS (SELECT *, x1 + ex AS x2, y1 + ey AS y2 FROM s0),
    n AS (SELECT c.patch_id, s.*, c.x, c.y, (x2 - x1) AS dx, (y2 - y1) AS dy FROM c JOIN s
      ON s.x1 BETWEEN c.x - 0.6 AND c.x + 0.6 AND s.y1 BETWEEN c.y - 0.6 AND c.y + 0.6),
    t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN dx * dx + dy * dy = 0
      THEN 0.0::DOUBLE ELSE ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy) END)) AS t
      FROM n),
    d AS (SELECT *, sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx))
      + (y - (y1 + t * dy)) * (y - (y1 + t * dy))) AS d FROM t),
    f AS (SELECT patch_id, min(d) * 111.0 AS road,
      sum(CASE WHEN d < 10 / 111.0::DOUBLE THEN sqrt(dx * dx + dy * dy) ELSE 0 END) * 111.0
      AS density FROM d WHERE d <= {REACH} GROUP BY patch_id)
    SELECT c.patch_id, road AS anthropogenic_dist_to_road_km,
      density AS anthropogenic_road_density_km FROM c LEFT JOIN f ON f.patch_id = c.patch_id""",
)
def roads(spark, sf):
    return nearest.nearest_road(_centres(spark, sf), _roads(spark, sf))


def _point_sql(filter_sql: str, scale: str, default: str, name: str) -> str:
    return f"""WITH c AS ({CENTRE_SQL}), s AS ({ROAD_SQL}),
    f AS (SELECT c.patch_id, min(sqrt((c.x - x1) * (c.x - x1) + (c.y - y1) * (c.y - y1))) AS d
      FROM c JOIN s ON s.x1 BETWEEN c.x - 0.46 AND c.x + 0.46
        AND s.y1 BETWEEN c.y - 0.46 AND c.y + 0.46
      WHERE {filter_sql} AND sqrt((c.x - x1) * (c.x - x1) + (c.y - y1) * (c.y - y1)) <= {REACH}
      GROUP BY c.patch_id)
    SELECT c.patch_id, coalesce(d * 111.0 * {scale}, {default}) AS {name}
    FROM c LEFT JOIN f ON f.patch_id = c.patch_id"""


@query(
    "nearest_river",
    "patch_id anthropogenic_dist_to_river_m:f",
    _point_sql("true", "1000", "NULL", "anthropogenic_dist_to_river_m"),
)
def rivers(spark, sf):
    return nearest.nearest_river(_centres(spark, sf), _roads(spark, sf), x="x1", y="y1")


@query(
    "nearest_river_lines",
    "patch_id anthropogenic_dist_to_river_m:f",
    f"""WITH c AS ({CENTRE_SQL}), s0 AS ({ROAD_SQL}),
    n AS (SELECT c.patch_id, c.x, c.y, x1, y1, ex AS dx, ey AS dy FROM c JOIN s0
      ON x1 BETWEEN c.x - 0.6 AND c.x + 0.6 AND y1 BETWEEN c.y - 0.6 AND c.y + 0.6),
    t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE,
      least(1.0::DOUBLE, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) END AS t FROM n),
    f AS (SELECT patch_id, min(sqrt(pow(x - x1 - t * dx, 2) + pow(y - y1 - t * dy, 2))) AS d FROM t
      GROUP BY patch_id)
    SELECT c.patch_id, CASE WHEN d <= {REACH} THEN d * 111000.0 END AS anthropogenic_dist_to_river_m
    FROM c LEFT JOIN f ON f.patch_id = c.patch_id""",
)
def river_lines(spark, sf):
    """Rivers as lines from each vertex to the next."""
    return nearest.nearest_river(_centres(spark, sf), _roads(spark, sf), x="x1", y="y1", to=("x2", "y2"))


@query(
    "nearest_settlement",
    "patch_id anthropogenic_dist_to_settlement_km:f",
    _point_sql("k % 5 < 3", "1", "50.0", "anthropogenic_dist_to_settlement_km"),
)
def settlements(spark, sf):
    return nearest.nearest_settlement(_centres(spark, sf), _roads(spark, sf), x="x1", y="y1")

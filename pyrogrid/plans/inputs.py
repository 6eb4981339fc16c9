"""How the given tables stand in for grids, observations, panels and prediction tables.

Each Spark frame has the same definition as a named SQL table expression in ``CTES``, which the
comparison queries of the catalogue are written against.  Factors with many digits keep means off
the halfway points of a rounded comparison.
"""

from __future__ import annotations

from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.config import (
    BBox,
    DataConfig,
    GridConfig,
    SpatialBlockConfig,
    SplitConfig,
    TemporalConfig,
)
from pyrogrid.operators.features import enrich_panel
from pyrogrid.operators.labels import materialize_labels
from pyrogrid.operators.splits import temporal_split
from pyrogrid.session import (
    discard,
    joined_where_they_are,
    materialise,
    scratch_path,
    shuffles_removed,
    wide_rows,
)
from pyrogrid.sources import zonal
from pyrogrid.sources.panel import on_panel_key, panel_skeleton
from pyrogrid.sources.zonal import reduce_lookback, visible

TEMPORAL = TemporalConfig(
    reference_start=date(1995, 3, 6),
    reference_end=date(2001, 8, 27),
    reference_stride_days=7,
    lookback_days=60,
    temporal_windows=(7, 14, 30, 60),
    horizon_days=30,
)
SPLIT = SplitConfig(
    buffer_days=30,
    train_end=date(1998, 12, 31),
    val_end=date(2000, 6, 30),
    test_end=date(2001, 9, 30),
)
BBOX = BBox(lon_min=100.5, lon_max=105.5, lat_min=-2.5, lat_max=1.5)
DATA = DataConfig(
    grid=GridConfig(grid_km=10, bbox=BBOX),
    temporal=TEMPORAL,
    split=SPLIT,
    spatial_blocks=SpatialBlockConfig(block_size_km=20, n_folds=5),
)
HORIZON = TEMPORAL.horizon_days
WINDOWS = TEMPORAL.temporal_windows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def patch_name(k):
    """Ten patches per lattice row."""
    return F.concat_ws("_", F.floor(k / 10).cast("bigint"), (k % 10).cast("bigint"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    row, col = F.floor(k / 10).cast("int"), (k % 10).cast("int")
    return table(spark, sf, "supplier").select(
        patch_name(k).alias("patch_id"),
        row.alias("patch_row"),
        col.alias("patch_col"),
        (F.lit(110.0) + col * 0.1).alias("centroid_lon"),
        (F.lit(-3.0) + row * 0.1).alias("centroid_lat"),
        F.concat(F.lit("POINT ("), col, F.lit(" "), row, F.lit(")")).alias("geometry_wkt"),
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as pixel observations: supplier = patch, line number = pixel."""
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    day = F.col("l_shipdate").cast("date")
    event = (F.col("l_returnflag") == "R") & (q > 45)
    return table(spark, sf, "lineitem").select(
        patch_name(F.col("l_suppkey")).alias("patch_id"),
        F.col("l_linenumber").alias("pixel_id"),
        F.col("l_shipdate").alias("obs_date"),
        F.col("l_partkey").alias("pk"),
        F.col("l_returnflag").alias("layer"),
        q.alias("q"),
        (q + 255).alias("temperature_2m"),
        (q * 0.5 + 250).alias("dewpoint_temperature_2m"),
        (tax * 0.7310586).alias("total_precipitation_sum"),
        (disc * 49.8765432).alias("u_component_of_wind_10m"),
        (tax * 50.1234567).alias("v_component_of_wind_10m"),
        (q + 1000).alias("surface_pressure"),
        (q * 0.1 + 270).alias("soil_temperature_level_1"),
        (disc * 0.9134567).alias("volumetric_soil_water_layer_1"),
        (F.col("l_partkey") % 100).alias("cloud_pct"),
        (disc + 0.1).alias("b2"),
        (tax + 0.1).alias("b3"),
        (q * 0.01).alias("b4"),
        (q * 0.02 + 0.2).alias("b8"),
        (disc * 2 + 0.1).alias("b11"),
        (tax * 5 + 0.1).alias("b12"),
        event.alias("event"),
        F.when(event, F.dayofyear(day)).otherwise(0).alias("burn_doy"),
        F.when(q > 40, 8).otherwise(3).alias("fire_mask"),
        (F.col("l_partkey") % 9).alias("label"),
    )


def burn_events(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).where("event").select(
        "patch_id", F.col("obs_date").cast("date").alias("event_date")
    )


def static_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as terrain and peat pixels of a hundred patches."""
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        patch_name(F.col("p_partkey") % 100).alias("patch_id"),
        (size * 10).cast("double").alias("elevation"),
        (size % 40).cast("double").alias("slope"),
        (size % 2).cast("double").alias("peat"),
        (size % 4 - 1).cast("double").alias("value"),
    )


def skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return panel_skeleton(grid(spark, sf), TEMPORAL)


def label_panel(spark: SparkSession, sf: str, windows: tuple = (7, 14)) -> DataFrame:
    """Skeleton with burn counts, burn dates and burn ratios of the weeks before."""
    obs = visible(observations(spark, sf), TEMPORAL, max(windows))
    gap, rain = F.col("gap"), F.col("total_precipitation_sum")
    week, ratio = F.col("gap") <= 7, (F.col("b8") - F.col("b12")) / (F.col("b8") + F.col("b12"))
    day = F.unix_date("obs_date").cast("bigint") * 86_400_000
    dated = week & F.col("event") & (F.col("pk") % 10 != 0)
    means = [
        F.avg(F.when(week, F.col("event").cast("double"))).alias("temporal_burn_count_l7d"),
        F.min(F.when(dated, day)).alias("temporal_burn_timestamp_l7d"),
        F.avg(F.when(week & ~F.col("event"), ratio)).alias("optical_nbr_mean_l7d"),
        F.avg(F.when(week, F.col("q"))).alias("weather_temperature_2m_mean_l7d"),
        *[
            F.avg(F.when((gap <= w) & kept, x)).alias(f"{name}_mean_l{w}d")
            for w in windows if w > 7
            for name, kept, x in (
                ("optical_nbr", ~F.col("event"), ratio),
                ("weather_temperature_2m", F.lit(True), F.col("q")),
                ("weather_total_precipitation_sum", F.lit(True), rain),
            )
        ],
    ]
    features = reduce_lookback(
        obs, TEMPORAL, max(windows), lambda seen, _: seen.groupBy("patch_id", "reference_date").agg(*means)
    )
    return on_panel_key(skeleton(spark, sf), features)


# Stand-in inputs of the enrichment steps: stem -> value by look-back window.
FEATURE_BANDS = (2, 3, 4, 8, 11, 12)


def feature_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Line items per supplier and week, under the column names enrichment expects.

    The 60-day temperature and the 7-day precipitation are missing where a week has one line.
    """
    q, disc, tax = F.avg("q"), F.avg("disc"), F.avg("tax")
    rows = table(spark, sf, "lineitem").select(
        patch_name(F.col("l_suppkey")).alias("patch_id"),
        F.trunc("l_shipdate", "week").alias("reference_date"),
        F.col("l_quantity").alias("q"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
    )
    several = F.count(F.lit(1)) > 1
    columns = {}
    for w in (3, *WINDOWS):
        temp, rain = q + (255 + w), tax * (w * 0.7310586)
        columns[f"weather_temperature_2m_mean_l{w}d"] = F.when(several, temp) if w == 60 else temp
        columns[f"weather_total_precipitation_sum_mean_l{w}d"] = (
            F.when(several, rain) if w == 7 else rain
        )
    for w in WINDOWS:
        columns[f"weather_temperature_2m_max_l{w}d"] = F.max("q") + (255 + w)
        columns[f"weather_dewpoint_temperature_2m_mean_l{w}d"] = q * 0.5 + (250 + w)
        columns[f"weather_u_component_of_wind_10m_mean_l{w}d"] = disc * (w * 0.9876543)
        columns[f"weather_v_component_of_wind_10m_mean_l{w}d"] = tax * (w * 1.0123457)
        for b in FEATURE_BANDS:
            columns[f"optical_b{b}_mean_l{w}d"] = disc * (b * 0.9753124) + tax * (w / 61.0) + 0.1
    columns["terrain_elevation_min"] = F.min("q")
    columns["terrain_elevation_max"] = F.max("q")
    columns["y_occ_30d"] = F.max((F.col("flag") == "R").cast("int"))
    return rows.groupBy("patch_id", "reference_date").agg(
        *[c.alias(n) for n, c in columns.items()]
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a prediction table: labels, two scores, severity and its prediction."""
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    hit = ((F.col("l_returnflag") == "R") & (q > 20)).cast("int")
    known = (hit == 1) & (F.col("l_linenumber") <= 5)
    k = F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        patch_name(k).alias("patch_id"),
        F.floor(k / 10).cast("int").alias("patch_row"),
        (k % 10).cast("int").alias("patch_col"),
        k.alias("patch_key"),
        F.col("l_shipdate").cast("date").alias("reference_date"),
        hit.alias("y_occ_30d"),
        (q * 0.016 + disc * 0.5 + tax * 0.3 + 0.02).alias("occurrence_prediction"),
        (q * 0.01 + tax * 2.0 + 0.1).alias("second_prediction"),
        (q * 0.016 + disc * 0.5 + tax * 0.3 + 0.02).alias("propensity_score"),
        known.cast("int").alias("y_sev_available"),
        F.when(known, disc * 6.0 + tax).alias("y_sev_dnbr"),
        (disc * 4.0312345 + q * 0.0021357 + 0.05).alias("severity_prediction"),
        (tax + 0.05).alias("sigma"),
    )
    rows = rows.withColumn(
        "risk_score", F.col("occurrence_prediction") * F.col("severity_prediction")
    )
    return temporal_split(rows, SPLIT, HORIZON, validate=False)


@cache
def _model_panel(application: str, sf: str) -> str:
    spark = SparkSession.active()
    path = scratch_path(spark, "panel")
    with wide_rows(spark):
        labelled = materialize_labels(label_panel(spark, sf, WINDOWS), None, HORIZON, 30, 7)
        terrain = zonal.zonal_terrain(static_pixels(spark, sf))
        # Enrichment reads the rows for its statistics, the split for its check.
        with joined_where_they_are(spark):
            panel = materialise(labelled.join(terrain, "patch_id", "left"), "labelled")
        enriched = enrich_panel(panel)
        with shuffles_removed(spark):
            temporal_split(enriched, SPLIT, HORIZON).write.parquet(path)
    discard(panel)
    return path


def model_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled, enriched and split panel of all look-backs, written once per session and scale."""
    return spark.read.parquet(_model_panel(spark.sparkContext.applicationId, sf))


PATCH_SQL = "concat(CAST({k} // 10 AS VARCHAR), '_', CAST({k} % 10 AS VARCHAR))"


def _sql_patch(k: str) -> str:
    return PATCH_SQL.format(k=k)


def _feature_panel_sql() -> str:
    columns = {}
    for w in (3, *WINDOWS):
        temp, rain = f"avg(q) + {255 + w}", f"avg(tax) * {w * 0.7310586!r}::DOUBLE"
        columns[f"weather_temperature_2m_mean_l{w}d"] = (
            f"CASE WHEN count(*) > 1 THEN {temp} END" if w == 60 else temp
        )
        columns[f"weather_total_precipitation_sum_mean_l{w}d"] = (
            f"CASE WHEN count(*) > 1 THEN {rain} END" if w == 7 else rain
        )
    for w in WINDOWS:
        columns[f"weather_temperature_2m_max_l{w}d"] = f"max(q) + {255 + w}"
        columns[f"weather_dewpoint_temperature_2m_mean_l{w}d"] = f"avg(q) * 0.5 + {250 + w}"
        columns[f"weather_u_component_of_wind_10m_mean_l{w}d"] = f"avg(disc) * {w * 0.9876543!r}::DOUBLE"
        columns[f"weather_v_component_of_wind_10m_mean_l{w}d"] = f"avg(tax) * {w * 1.0123457!r}::DOUBLE"
        for b in FEATURE_BANDS:
            columns[f"optical_b{b}_mean_l{w}d"] = (
                f"avg(disc) * {b * 0.9753124!r}::DOUBLE + avg(tax) * {w / 61.0!r}::DOUBLE "
                "+ 0.1::DOUBLE"
            )
    columns["terrain_elevation_min"] = "min(q)"
    columns["terrain_elevation_max"] = "max(q)"
    columns["y_occ_30d"] = "max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END)"
    inner = (
        f"SELECT {_sql_patch('l_suppkey')} AS patch_id, "
        "CAST(date_trunc('week', l_shipdate) AS DATE) AS reference_date, l_quantity AS q, "
        "l_discount AS disc, l_tax AS tax, l_returnflag AS flag FROM lineitem"
    )
    body = ", ".join(f"{c} AS {n}" for n, c in columns.items())
    return (
        f"SELECT patch_id, reference_date, {body} FROM ({inner}) GROUP BY patch_id, reference_date"
    )


N_DATES = TEMPORAL.n_reference_dates

# Name -> (tables it needs, definition).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "spine": (
        (),
        f"SELECT CAST(DATE '{TEMPORAL.reference_start}' + CAST(7 * i AS INTEGER) AS DATE) AS ref "
        f"FROM range(0, {N_DATES}) t(i)",
    ),
    "grid": (
        (),
        f"SELECT s_suppkey AS k, {_sql_patch('s_suppkey')} AS patch_id, "
        "s_suppkey // 10 AS patch_row, s_suppkey % 10 AS patch_col, "
        "110.0::DOUBLE + (s_suppkey % 10) * 0.1::DOUBLE AS centroid_lon, "
        "-3.0::DOUBLE + (s_suppkey // 10) * 0.1::DOUBLE AS centroid_lat FROM supplier",
    ),
    "obs": (
        (),
        f"""SELECT {_sql_patch('l_suppkey')} AS patch_id, l_linenumber AS pixel_id,
        CAST(l_shipdate AS DATE) AS obs_date, l_partkey AS pk, l_returnflag AS layer,
        l_quantity AS q, l_quantity + 255 AS temperature_2m,
        l_quantity * 0.5::DOUBLE + 250 AS dewpoint_temperature_2m,
        l_tax * 0.7310586::DOUBLE AS total_precipitation_sum,
        l_discount * 49.8765432::DOUBLE AS u_component_of_wind_10m,
        l_tax * 50.1234567::DOUBLE AS v_component_of_wind_10m, l_quantity + 1000 AS surface_pressure,
        l_quantity * 0.1::DOUBLE + 270 AS soil_temperature_level_1,
        l_discount * 0.9134567::DOUBLE AS volumetric_soil_water_layer_1, l_partkey % 100 AS cloud_pct,
        l_discount + 0.1::DOUBLE AS b2, l_tax + 0.1::DOUBLE AS b3,
        l_quantity * 0.01::DOUBLE AS b4, l_quantity * 0.02::DOUBLE + 0.2::DOUBLE AS b8,
        l_discount * 2 + 0.1::DOUBLE AS b11, l_tax * 5 + 0.1::DOUBLE AS b12,
        l_returnflag = 'R' AND l_quantity > 45 AS event,
        CASE WHEN l_returnflag = 'R' AND l_quantity > 45
             THEN dayofyear(l_shipdate) ELSE 0 END AS burn_doy,
        CASE WHEN l_quantity > 40 THEN 8 ELSE 3 END AS fire_mask,
        l_partkey % 9 AS label FROM lineitem""",
    ),
    "events_seen": (
        ("obs",),
        "SELECT DISTINCT patch_id, obs_date AS event_date FROM obs WHERE event",
    ),
    "pixels": (
        (),
        f"""SELECT {_sql_patch('(p_partkey % 100)')} AS patch_id,
        CAST(p_size * 10 AS DOUBLE) AS elevation, CAST(p_size % 40 AS DOUBLE) AS slope,
        CAST(p_size % 2 AS DOUBLE) AS peat, CAST(p_size % 4 - 1 AS DOUBLE) AS value
        FROM part""",
    ),
    "skeleton": (
        ("grid", "spine"),
        "SELECT patch_id, patch_row, patch_col, centroid_lon, centroid_lat, "
        "ref AS reference_date FROM grid CROSS JOIN spine",
    ),
    "label_panel": (
        ("obs", "skeleton", "spine"),
        """SELECT s.*, f.* EXCLUDE (p, r) FROM skeleton s LEFT JOIN (
        SELECT patch_id AS p, ref AS r,
        avg(CASE WHEN ref - obs_date <= 7 THEN CAST(event AS INTEGER) END)
            AS temporal_burn_count_l7d,
        min(CASE WHEN ref - obs_date <= 7 AND event AND pk % 10 <> 0
            THEN CAST(obs_date - DATE '1970-01-01' AS BIGINT) * 86400000 END)
            AS temporal_burn_timestamp_l7d,
        avg(CASE WHEN ref - obs_date <= 7 AND NOT event THEN (b8 - b12) / (b8 + b12) END)
            AS optical_nbr_mean_l7d,
        avg(CASE WHEN NOT event THEN (b8 - b12) / (b8 + b12) END) AS optical_nbr_mean_l14d,
        avg(CASE WHEN ref - obs_date <= 7 THEN q END) AS weather_temperature_2m_mean_l7d,
        avg(q) AS weather_temperature_2m_mean_l14d,
        avg(total_precipitation_sum) AS weather_total_precipitation_sum_mean_l14d
        FROM obs JOIN spine ON obs_date < ref AND obs_date >= ref - 14 GROUP BY 1, 2) f
        ON f.p = s.patch_id AND f.r = s.reference_date""",
    ),
    "feature_panel": ((), _feature_panel_sql()),
    "scored": (
        (),
        f"""SELECT *, occurrence_prediction * severity_prediction AS risk_score,
        CASE WHEN reference_date <= DATE '1998-12-31' THEN 'train'
             WHEN reference_date > DATE '1999-01-30' AND reference_date <= DATE '2000-06-30'
             THEN 'val'
             WHEN reference_date > DATE '2000-07-30' AND reference_date <= DATE '2001-09-30'
             THEN 'test' ELSE 'embargo' END AS split
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_sql_patch('l_suppkey')} AS patch_id,
        l_suppkey // 10 AS patch_row, l_suppkey % 10 AS patch_col, l_suppkey AS patch_key,
        CAST(l_shipdate AS DATE) AS reference_date,
        CASE WHEN l_returnflag = 'R' AND l_quantity > 20 THEN 1 ELSE 0 END AS y_occ_30d,
        l_quantity * 0.016::DOUBLE + l_discount * 0.5::DOUBLE + l_tax * 0.3::DOUBLE
            + 0.02::DOUBLE AS occurrence_prediction,
        l_quantity * 0.01::DOUBLE + l_tax * 2.0::DOUBLE + 0.1::DOUBLE AS second_prediction,
        l_quantity * 0.016::DOUBLE + l_discount * 0.5::DOUBLE + l_tax * 0.3::DOUBLE
            + 0.02::DOUBLE AS propensity_score,
        CASE WHEN l_returnflag = 'R' AND l_quantity > 20 AND l_linenumber <= 5
            THEN 1 ELSE 0 END AS y_sev_available,
        CASE WHEN l_returnflag = 'R' AND l_quantity > 20 AND l_linenumber <= 5
            THEN l_discount * 6.0::DOUBLE + l_tax END AS y_sev_dnbr,
        l_discount * 4.0312345::DOUBLE + l_quantity * 0.0021357::DOUBLE + 0.05::DOUBLE
            AS severity_prediction,
        l_tax + 0.05::DOUBLE AS sigma FROM lineitem)""",
    ),
}


def with_tables(query: str, *names: str) -> str:
    """Prefix a query with the table expressions it uses, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    return f"WITH {', '.join(parts)} {query}"

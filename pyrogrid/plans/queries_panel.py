"""Queries over feature enrichment, schema predicates, labels and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyrogrid.functions.scalars import as_event_date, doy_to_date, severity_class
from pyrogrid.operators import features, guard, labels
from pyrogrid.plans import inputs as T
from pyrogrid.plans.audits import severity_side_join
from pyrogrid.plans.inputs import HORIZON, TEMPORAL, WINDOWS, with_tables
from pyrogrid.plans.registry import KEY, fields, query
from pyrogrid.sources.panel import reference_spine, require_patches
from pyrogrid.sources.zonal import earliest_future_burn

# --- enrichment; each step's SQL maps derived column -> expression

TEMP, TEMP_MAX, DEW = features.TEMPERATURE, features.TEMPERATURE_MAX, features.DEWPOINT
RAIN, VPD = features.PRECIPITATION, features.VPD


def _pressure(c: str) -> str:
    return f"0.6108::DOUBLE * exp(17.27::DOUBLE * {c} / ({c} + 237.3::DOUBLE))"


def _celsius(c: str, decided_by: str) -> str:
    return (
        f"({c} - CASE WHEN (SELECT median({decided_by}) FROM feature_panel) > 200 "
        "THEN 273.15::DOUBLE ELSE 0 END)"
    )


def _vpd_sql() -> dict[str, str]:
    out = {}
    for w in WINDOWS:
        mean, top, dew = f"{TEMP}_l{w}d", f"{TEMP_MAX}_l{w}d", f"{DEW}_l{w}d"
        actual = _pressure(_celsius(dew, mean))
        for name, temp in ((VPD, mean), ("weather_vpd_max", top)):
            diff = f"{_pressure(_celsius(temp, temp))} - {actual}"
            out[f"{name}_l{w}d"] = f"CASE WHEN {diff} < 0 THEN 0 ELSE {diff} END"
    return out


def _wind_sql() -> dict[str, str]:
    u, v = features.WIND_U, features.WIND_V
    return {
        f"weather_wind_speed_mean_l{w}d": f"sqrt({u}_l{w}d * {u}_l{w}d + {v}_l{w}d * {v}_l{w}d)"
        for w in WINDOWS
    }


RANGE_SQL = {"terrain_elevation_range": "terrain_elevation_max - terrain_elevation_min"}


def _spectral_sql() -> dict[str, str]:
    out = {}
    for w in WINDOWS:
        b = {i: f"optical_b{i}_mean_l{w}d" for i in T.FEATURE_BANDS}
        for name, i in (("ndvi", 4), ("nbr", 12), ("ndmi", 11)):
            out[f"optical_{name}_mean_l{w}d"] = (
                f"({b[8]} - {b[i]}) / ({b[8]} + {b[i]} + 1e-8::DOUBLE)"
            )
        out[f"optical_evi_mean_l{w}d"] = (
            f"2.5::DOUBLE * (({b[8]} - {b[4]}) / "
            f"({b[8]} + 6 * {b[4]} - 7.5::DOUBLE * {b[2]} + 1 + 1e-8::DOUBLE))"
        )
        out[f"optical_savi_mean_l{w}d"] = (
            f"1.5::DOUBLE * (({b[8]} - {b[4]}) / ({b[8]} + {b[4]} + 0.5::DOUBLE + 1e-8::DOUBLE))"
        )
    return out


def _diff_sql(names) -> dict[str, str]:
    out = {}
    for n in names:
        diff = f"{n} - lag({n}) OVER (PARTITION BY patch_id ORDER BY reference_date)"
        out[f"{n}_diff_7d"], out[f"{n}_rate_7d"] = diff, f"({diff}) / 7"
    return out


def _desiccation_sql() -> dict[str, str]:
    def z(c):
        return f"({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-8::DOUBLE)"

    return {
        f"weather_desiccation_index_l{w}d": f"{z(f'{TEMP}_l{w}d')} - {z(f'{RAIN}_l{w}d')}"
        for w in WINDOWS
    }


def _ratio_sql(with_vpd: bool) -> dict[str, str]:
    out = {}
    for a, b in features.RATIO_WINDOWS:
        for stem in (RAIN, TEMP, VPD):
            if stem == VPD and (not with_vpd or a == 3):
                continue
            out[f"{stem}_ratio_{a}d_{b}d"] = (
                f"CASE WHEN {stem}_l{b}d + 1e-8::DOUBLE <> 0 THEN "
                f"{stem}_l{a}d / ({stem}_l{b}d + 1e-8::DOUBLE) END"
            )
    return out


def _columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def _enriched(exprs: dict[str, str]) -> str:
    return with_tables(
        f"SELECT patch_id, reference_date, {_columns(exprs)} FROM feature_panel", "feature_panel"
    )


def _register(name: str, exprs: dict[str, str], step) -> None:
    output = f"{KEY} {fields(exprs)}"
    query(name, output, _enriched(exprs))(lambda spark, sf: step(T.feature_panel(spark, sf)))


DIFF_INPUTS = (f"{TEMP}_l7d", f"{RAIN}_l7d")
_register("vpd", _vpd_sql(), features.vpd)
_register("wind_speed", _wind_sql(), features.wind_speed)
_register("terrain_range", RANGE_SQL, features.terrain_range)
_register("spectral_indices", _spectral_sql(), features.spectral_indices)
_register(
    "temporal_diff", _diff_sql(DIFF_INPUTS), lambda df: features.temporal_diff(df, DIFF_INPUTS, 7)
)
_register("desiccation_index", _desiccation_sql(), features.desiccation_index)
_register("feature_ratios", _ratio_sql(False), features.feature_ratios)

FIRST = _vpd_sql() | _wind_sql() | RANGE_SQL | _spectral_sql()
SECOND = _diff_sql(features.DIFF_COLUMNS) | _desiccation_sql() | _ratio_sql(True)


@query(
    "enrich_panel",
    f"{KEY} {fields([*FIRST, *SECOND])}",
    with_tables(
        f"SELECT patch_id, reference_date, {', '.join(FIRST)}, {_columns(SECOND)} "
        f"FROM (SELECT *, {_columns(FIRST)} FROM feature_panel)",
        "feature_panel",
    ),
)
def enrich(spark, sf):
    return features.enrich_panel(T.feature_panel(spark, sf), 7)


def _lag(c: str, back: int) -> str:
    order = "OVER (PARTITION BY patch_id ORDER BY reference_date)"
    return f"coalesce(lag({c}, {back}) {order}, 0)" if back else f"coalesce({c}, 0)"


SEQUENCE_INPUTS = (f"{TEMP}_l60d", f"{RAIN}_l7d")
STEPS = 3


@query(
    "sequence_window",
    f"{KEY} sequence_length:i "
    + fields(f"x{t}_{i}" for t in range(STEPS) for i in range(len(SEQUENCE_INPUTS))),
    with_tables(
        "SELECT patch_id, reference_date, least(3, row_number() OVER (PARTITION BY patch_id "
        "ORDER BY reference_date)) AS sequence_length, "
        + ", ".join(
            f"{_lag(c, STEPS - 1 - t)} AS x{t}_{i}"
            for t in range(STEPS)
            for i, c in enumerate(SEQUENCE_INPUTS)
        )
        + " FROM feature_panel",
        "feature_panel",
    ),
)
def sequences(spark, sf):
    out = features.sequence_window(T.feature_panel(spark, sf), SEQUENCE_INPUTS, STEPS)
    return out.select(
        "*",
        *[
            F.col("sequence")[t][i].alias(f"x{t}_{i}")
            for t in range(STEPS)
            for i in range(len(SEQUENCE_INPUTS))
        ],
    )


# --- predicates and schema-driven projections

RAW_FEATURES = (
    [f"{s}_l{w}d" for w in (3, *WINDOWS) for s in (TEMP, RAIN)]
    + [f"{s}_l{w}d" for w in WINDOWS for s in (TEMP_MAX, DEW, features.WIND_U, features.WIND_V)]
    + [f"optical_b{b}_mean_l{w}d" for w in WINDOWS for b in T.FEATURE_BANDS]
    + ["terrain_elevation_min", "terrain_elevation_max"]
)
SHORT_FEATURES = [
    n for n in RAW_FEATURES if not n.endswith(tuple(f"_l{w}d" for w in WINDOWS if w > 14))
]


@query(
    "guarded_projection",
    f"{KEY} {fields(RAW_FEATURES)}",
    with_tables(
        f"SELECT patch_id, reference_date, {', '.join(RAW_FEATURES)} FROM feature_panel",
        "feature_panel",
    ),
)
def guarded(spark, sf):
    return guard.guarded_projection(T.feature_panel(spark, sf), keep=labels.KEY)


@query(
    "max_window_projection",
    f"{KEY} y_occ_30d:i {fields(SHORT_FEATURES)}",
    with_tables(
        f"SELECT patch_id, reference_date, y_occ_30d, {', '.join(SHORT_FEATURES)} "
        "FROM feature_panel",
        "feature_panel",
    ),
)
def short_windows(spark, sf):
    return guard.max_window_projection(T.feature_panel(spark, sf), 14)


@query(
    "label_cutoff",
    KEY,
    with_tables(
        "SELECT patch_id, reference_date FROM skeleton WHERE reference_date <= "
        "(SELECT least(max(reference_date) - 30, DATE '2001-08-27') FROM skeleton)",
        "skeleton",
    ),
)
def cutoff(spark, sf):
    panel = T.skeleton(spark, sf)
    return labels.apply_cutoff(
        panel, labels.label_cutoff(panel, HORIZON, TEMPORAL.reference_end)
    )


LABEL_FEATURES = (
    "temporal_burn_count_l7d",
    "optical_nbr_mean_l7d",
    "optical_nbr_mean_l14d",
    "weather_temperature_2m_mean_l7d",
    "weather_temperature_2m_mean_l14d",
    "weather_total_precipitation_sum_mean_l14d",
)


@query(
    "drop_label_scaffold",
    f"{KEY} patch_row:i patch_col:i {fields(LABEL_FEATURES)}",
    with_tables(
        f"SELECT patch_id, reference_date, patch_row, patch_col, {', '.join(LABEL_FEATURES)} "
        "FROM label_panel",
        "label_panel",
    ),
)
def scaffold(spark, sf):
    return labels.drop_scaffold(T.label_panel(spark, sf), with_severity=False)


# --- joins

NEXT_SQL = """SELECT s.patch_id, s.reference_date, min(e.event_date) AS event_date
FROM {panel} s LEFT JOIN {events} e ON e.patch_id = s.patch_id
    AND e.event_date > s.reference_date AND e.event_date <= s.reference_date + 30
GROUP BY 1, 2"""


@query(
    "next_event",
    f"{KEY} event_date:d",
    with_tables(NEXT_SQL.format(panel="skeleton", events="events_seen"), "skeleton", "events_seen"),
)
def upcoming(spark, sf):
    return labels.next_event(T.skeleton(spark, sf), T.burn_events(spark, sf), HORIZON)


@query(
    "event_ahead",
    f"{KEY} y_occ_7d:i event_date:d",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS patch_id, CAST(ts AS DATE) AS day,
      event_type = 'error' AND value > 100 AS hit FROM events),
    s AS (SELECT patch_id, CAST(unnest(generate_series(a, b, INTERVAL 3 DAY)) AS DATE)
      AS reference_date FROM (SELECT patch_id, min(day) AS a, max(day) AS b FROM e GROUP BY 1))
    SELECT s.patch_id, s.reference_date, CASE WHEN min(day) IS NULL THEN 0 ELSE 1 END AS y_occ_7d,
      min(day) AS event_date
    FROM s LEFT JOIN (SELECT DISTINCT patch_id, day FROM e WHERE hit) h
      ON h.patch_id = s.patch_id AND day > s.reference_date AND day <= s.reference_date + 7
    GROUP BY 1, 2""",
)
def event_ahead(spark, sf):
    """Which users, at which dates, have a severe error within the next week."""
    seen = T.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("patch_id"),
        F.col("ts").cast("date").alias("event_date"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("hit"),
    )
    bounds = seen.groupBy("patch_id").agg(
        F.min("event_date").alias("reference_start"), F.max("event_date").alias("reference_end")
    )
    hits = seen.where("hit").select("patch_id", "event_date")
    found = labels.next_event(reference_spine(bounds, 3), hits, 7)
    return found.withColumn("y_occ_7d", F.col("event_date").isNotNull().cast("int"))


@query(
    "event_exists",
    f"{KEY} y_occ_30d:i",
    with_tables(
        """SELECT s.patch_id, s.reference_date,
        CASE WHEN count(e.event_date) > 0 THEN 1 ELSE 0 END AS y_occ_30d
        FROM (SELECT DISTINCT patch_id, obs_date AS reference_date FROM obs) s
        LEFT JOIN events_seen e ON e.patch_id = s.patch_id
        AND e.event_date > s.reference_date AND e.event_date <= s.reference_date + 30
        GROUP BY 1, 2""",
        "obs",
        "events_seen",
    ),
)
def occurrence(spark, sf):
    days = (
        T.observations(spark, sf)
        .groupBy("patch_id", F.col("obs_date").cast("date").alias("reference_date"))
        .agg(F.max(F.col("event").cast("int")).alias("observed_event"))
    )
    dated = days.withColumn(
        "observed_event_date", F.when(F.col("observed_event") == 1, F.col("reference_date"))
    )
    return labels.event_exists(dated, HORIZON)


DAILY_SQL = """SELECT patch_id, reference_date, avg(occurrence_prediction) AS
occurrence_prediction, {extra} AS severity_prediction FROM scored WHERE {where} GROUP BY 1, 2"""


@query(
    "severity_side_join",
    f"{KEY} {fields(['occurrence_prediction', 'naive_severity_prediction'])} "
    + fields(["ipw_severity_prediction", "severity_prediction", "risk_score"]),
    with_tables(
        f"""SELECT o.patch_id, o.reference_date, o.occurrence_prediction,
        n.severity_prediction AS naive_severity_prediction,
        i.severity_prediction AS ipw_severity_prediction,
        i.severity_prediction, o.occurrence_prediction * i.severity_prediction AS risk_score
        FROM ({DAILY_SQL.format(extra="NULL", where="true")}) o
        LEFT JOIN ({DAILY_SQL.format(extra="avg(severity_prediction)",
                                     where="y_sev_available = 1")}) n
        ON n.patch_id = o.patch_id AND n.reference_date = o.reference_date
        LEFT JOIN ({DAILY_SQL.format(extra="max(severity_prediction)",
                                     where="y_sev_available = 1")}) i
        ON i.patch_id = o.patch_id AND i.reference_date = o.reference_date""",
        "scored",
    ),
)
def side_join(spark, sf):
    rows = T.scored(spark, sf)
    known = rows.where(F.col("y_sev_available") == 1)

    def daily(df, value):
        return df.groupBy(*labels.KEY).agg(value)

    return severity_side_join(
        daily(rows, F.avg("occurrence_prediction").alias("occurrence_prediction")),
        daily(known, F.avg("severity_prediction").alias("severity_prediction")),
        daily(known, F.max("severity_prediction").alias("severity_prediction")),
    )


@query(
    "geometry_lookup",
    "patch_id centroid_lon:f centroid_lat:f",
    with_tables(
        "SELECT patch_id, centroid_lon, centroid_lat FROM grid "
        "WHERE patch_id IN (SELECT patch_id FROM events_seen)",
        "grid",
        "events_seen",
    ),
)
def geometry(spark, sf):
    return require_patches(T.burn_events(spark, sf), T.grid(spark, sf))


# --- labels


@query(
    "parse_event_date",
    "l_orderkey:i l_linenumber:i from_ms:d from_text:d from_stamp:d",
    """SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linenumber < 5 THEN CAST(l_shipdate AS DATE) END AS from_ms,
    CAST(l_shipdate AS DATE) AS from_text, CAST(l_shipdate AS DATE) AS from_stamp FROM lineitem""",
)
def parsed_dates(spark, sf):
    ms = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 86_400_000
    rows = T.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") < 5, ms + 3_600_000)
        .when(F.col("l_linenumber") == 5, F.lit(1_000))
        .when(F.col("l_linenumber") == 6, F.lit(-5))
        .cast("double")
        .alias("ms"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("text"),
        F.col("l_shipdate").alias("stamp"),
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        *[as_event_date(rows, c).alias(f"from_{c}") for c in ("ms", "text", "stamp")],
    )


@query(
    "doy_to_date",
    "l_orderkey:i l_linenumber:i l_partkey:i burned_on:d",
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS ref,
      CAST(round_even(l_partkey % 367 + l_linenumber / 2.0::DOUBLE - 2, 0) AS INTEGER) AS doy
      FROM lineitem),
    c AS (SELECT *, CASE WHEN make_date(CAST(year(ref) AS BIGINT), 1, 1) + (doy - 1) <= ref
      THEN make_date(CAST(year(ref) AS BIGINT), 1, 1) + (doy - 1)
      ELSE make_date(CAST(year(ref) - 1 AS BIGINT), 1, 1) + (doy - 1) END AS day FROM d)
    SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN doy > 0 AND day <= ref AND ref - day <= 60 THEN day END AS burned_on FROM c""",
)
def day_of_year(spark, sf):
    doy = F.col("l_partkey") % 367 + F.col("l_linenumber") / 2.0 - 2
    return T.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        doy_to_date(F.col("l_shipdate").cast("date"), doy, 60).alias("burned_on"),
    )


OBSERVED_SQL = """SELECT *, CASE WHEN temporal_burn_count_l7d > 0
  AND temporal_burn_timestamp_l7d IS NOT NULL THEN 1 ELSE 0 END AS observed_event,
  CAST(DATE '1970-01-01' + CAST(temporal_burn_timestamp_l7d // 86400000 AS INTEGER) AS DATE)
  AS observed_event_date FROM label_panel"""


@query(
    "observed_events",
    f"{KEY} observed_event:i observed_event_date:d",
    with_tables(OBSERVED_SQL, "label_panel"),
)
def observed(spark, sf):
    return labels.observed_events(T.label_panel(spark, sf), 7)


# Severity of an event: the latest row strictly before and strictly after it, within 30 days.
LABELS_SQL = f"""
o AS ({OBSERVED_SQL}),
e AS (SELECT DISTINCT patch_id, observed_event_date AS event_date FROM o WHERE observed_event = 1),
side AS (SELECT e.patch_id, e.event_date,
    max(CASE WHEN o.reference_date < e.event_date THEN o.reference_date END) AS before,
    max(CASE WHEN o.reference_date > e.event_date THEN o.reference_date END) AS after
  FROM e JOIN o ON o.patch_id = e.patch_id AND o.reference_date <> e.event_date
    AND o.reference_date BETWEEN e.event_date - 30 AND e.event_date + 30 GROUP BY 1, 2),
nbr AS (SELECT s.*, coalesce(a.optical_nbr_mean_l7d, a.optical_nbr_mean_l14d) AS pre,
    coalesce(b.optical_nbr_mean_l7d, b.optical_nbr_mean_l14d) AS post
  FROM side s JOIN o a ON a.patch_id = s.patch_id AND a.reference_date = s.before
  JOIN o b ON b.patch_id = s.patch_id AND b.reference_date = s.after),
sev AS (SELECT e.patch_id, e.event_date, pre AS label_nbr_prefire, post AS label_nbr_postfire,
    CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN 1 ELSE 0 END AS y_sev_available,
    CASE WHEN pre - post < 0 THEN 0 ELSE pre - post END AS y_sev_dnbr,
    CASE WHEN pre - post <= 0.1 THEN 'low' WHEN pre - post <= 0.27 THEN 'moderate'
      WHEN pre - post <= 0.66 THEN 'high' WHEN pre - post > 0.66 THEN 'extreme' END AS y_sev_class
  FROM e LEFT JOIN nbr ON nbr.patch_id = e.patch_id AND nbr.event_date = e.event_date)"""

SEVERITY = (
    "label_nbr_prefire:f label_nbr_postfire:f y_sev_available:i y_sev_dnbr:f y_sev_class"
)


def _label_sql(select: str) -> str:
    return with_tables("", "label_panel").rstrip() + f", {LABELS_SQL} {select}"


NEXT_LABEL_SQL = NEXT_SQL.format(panel="o", events="e")


@query(
    "occurrence_label",
    f"{KEY} y_occ_30d:i event_date:d",
    _label_sql(
        "SELECT patch_id, reference_date, CASE WHEN event_date IS NULL THEN 0 ELSE 1 END "
        f"AS y_occ_30d, event_date FROM ({NEXT_LABEL_SQL})"
    ),
)
def occurrence_labels(spark, sf):
    return labels.label_observed_events(T.label_panel(spark, sf), HORIZON, with_severity=False)


@query(
    "local_severity",
    f"patch_id event_date:d {SEVERITY}",
    _label_sql("SELECT * FROM sev"),
)
def severity_of_events(spark, sf):
    marked = labels.observed_events(T.label_panel(spark, sf), 7)
    return labels.local_severity(marked, labels.event_rows(marked), 30)


MATERIALIZED_SQL = f"""SELECT o.patch_id, o.reference_date, {{extra}}
CASE WHEN n.event_date IS NULL THEN 0 ELSE 1 END AS y_occ_30d, n.event_date,
s.label_nbr_prefire, s.label_nbr_postfire, coalesce(s.y_sev_available, 0) AS y_sev_available,
s.y_sev_dnbr, s.y_sev_class
FROM o JOIN ({NEXT_LABEL_SQL}) n
  ON n.patch_id = o.patch_id AND n.reference_date = o.reference_date
LEFT JOIN sev s ON s.patch_id = n.patch_id AND s.event_date = n.event_date
WHERE o.reference_date <= (SELECT max(reference_date) - 30 FROM o)"""


@query(
    "materialize_labels",
    f"{KEY} {fields(LABEL_FEATURES)} y_occ_30d:i event_date:d {SEVERITY}",
    _label_sql(MATERIALIZED_SQL.format(extra=", ".join(LABEL_FEATURES) + ",")),
)
def materialized(spark, sf):
    return labels.materialize_labels(
        T.label_panel(spark, sf), T.grid(spark, sf), HORIZON, 30, 7
    )


@query(
    "label_from_extractors",
    f"{KEY} y_occ_30d:i event_date:d y_sev_available:i y_sev_dnbr:f",
    with_tables(
        f"""SELECT n.patch_id, n.reference_date,
        CASE WHEN n.event_date IS NULL THEN 0 ELSE 1 END AS y_occ_30d, n.event_date,
        CASE WHEN n.event_date IS NULL THEN 0 ELSE 1 END AS y_sev_available,
        CASE WHEN n.event_date IS NULL THEN NULL ELSE s.dnbr END AS y_sev_dnbr
        FROM ({NEXT_SQL.format(panel="skeleton", events="events_seen")}) n
        LEFT JOIN (SELECT patch_id, obs_date AS event_date, max(b8) AS dnbr FROM obs
                   WHERE event GROUP BY 1, 2) s
        ON s.patch_id = n.patch_id AND s.event_date = n.event_date""",
        "skeleton",
        "events_seen",
        "obs",
    ),
)
def extractor_labels(spark, sf):
    """Caller-supplied table functions: next dated burn, and its brightest pixel as severity."""
    obs = T.observations(spark, sf)

    def next_burn(keys, horizon_days):
        return labels.next_event(keys, T.burn_events(spark, sf), horizon_days)

    def brightest(events, _window):
        burned = obs.where("event").groupBy(
            "patch_id", F.col("obs_date").cast("date").alias("event_date")
        )
        found = events.join(burned.agg(F.max("b8").alias("dnbr")), labels.EVENT, "left")
        return found.select(
            *labels.EVENT,
            F.lit(None).cast("double").alias("label_nbr_prefire"),
            F.lit(None).cast("double").alias("label_nbr_postfire"),
            F.col("dnbr").isNotNull().cast("int").alias("y_sev_available"),
            F.col("dnbr").alias("y_sev_dnbr"),
            severity_class(F.col("dnbr")).alias("y_sev_class"),
        )

    return labels.label_from_extractors(
        T.skeleton(spark, sf), T.grid(spark, sf), HORIZON, 30, next_burn, brightest
    )


@query(
    "composite_severity",
    f"patch_id event_date:d {SEVERITY}",
    with_tables(
        """SELECT e.patch_id, e.event_date, pre AS label_nbr_prefire, post AS label_nbr_postfire,
        CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN 1 ELSE 0 END AS y_sev_available,
        CASE WHEN pre - post < 0 THEN 0 ELSE pre - post END AS y_sev_dnbr,
        CASE WHEN pre - post <= 0.1 THEN 'low' WHEN pre - post <= 0.27 THEN 'moderate'
          WHEN pre - post <= 0.66 THEN 'high' WHEN pre - post > 0.66 THEN 'extreme' END
          AS y_sev_class
        FROM events_seen e LEFT JOIN (
          SELECT patch_id, event_date,
            avg(CASE WHEN is_pre THEN (nir - swir) / (nir + swir) END) AS pre,
            avg(CASE WHEN NOT is_pre THEN (nir - swir) / (nir + swir) END) AS post
          FROM (SELECT e.patch_id, event_date, obs_date < event_date AS is_pre, pixel_id,
              median(b8) AS nir, median(b12) AS swir
            FROM events_seen e JOIN obs o ON o.patch_id = e.patch_id AND cloud_pct < 40
              AND obs_date >= event_date - 30 AND obs_date < event_date + 30
            GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) c
        ON c.patch_id = e.patch_id AND c.event_date = e.event_date""",
        "events_seen",
        "obs",
    ),
)
def composites(spark, sf):
    return labels.composite_severity(
        T.observations(spark, sf), T.burn_events(spark, sf), 30
    )


@query(
    "future_burn_label",
    f"{KEY} y_occ_30d:i event_date:d",
    with_tables(
        """SELECT s.patch_id, s.reference_date,
        CASE WHEN min(b) IS NULL THEN 0 ELSE 1 END AS y_occ_30d, min(b) AS event_date
        FROM skeleton s LEFT JOIN (SELECT patch_id, obs_date,
            make_date(CAST(year(obs_date) AS BIGINT), 1, 1) + CAST(burn_doy - 1 AS INTEGER) AS b
            FROM obs WHERE burn_doy > 0) o
        ON o.patch_id = s.patch_id AND b > s.reference_date AND b <= s.reference_date + 30
        AND obs_date >= date_trunc('month', s.reference_date)
        AND obs_date < date_trunc('month', s.reference_date + 30) + INTERVAL 1 MONTH
        GROUP BY 1, 2""",
        "skeleton",
        "obs",
    ),
)
def future_burn(spark, sf):
    found = earliest_future_burn(T.observations(spark, sf), TEMPORAL, HORIZON)
    return T.skeleton(spark, sf).join(found, labels.KEY, "left").withColumn(
        "y_occ_30d", F.col("event_date").isNotNull().cast("int")
    )


@query(
    "severity_class",
    "l_orderkey:i l_linenumber:i l_partkey:i y_sev_dnbr:f y_sev_class",
    with_tables(
        """SELECT l_orderkey, l_linenumber, l_partkey, y_sev_dnbr,
        CASE WHEN y_sev_dnbr <= 0.1 THEN 'low' WHEN y_sev_dnbr <= 0.27 THEN 'moderate'
          WHEN y_sev_dnbr <= 0.66 THEN 'high' WHEN y_sev_dnbr > 0.66 THEN 'extreme' END
          AS y_sev_class FROM scored""",
        "scored",
    ),
)
def classes(spark, sf):
    return T.scored(spark, sf).withColumn("y_sev_class", severity_class(F.col("y_sev_dnbr")))


@query(
    "severity_from_columns",
    "l_orderkey:i l_linenumber:i l_partkey:i y_sev_available:i y_sev_dnbr:f y_sev_class",
    with_tables(
        """SELECT l_orderkey, l_linenumber, l_partkey, y_occ_30d AS y_sev_available,
        CASE WHEN d < 0 THEN 0 ELSE d END AS y_sev_dnbr,
        CASE WHEN d <= 0 THEN NULL WHEN d <= 0.1 THEN 'low' WHEN d <= 0.27 THEN 'moderate'
          WHEN d <= 0.66 THEN 'high' WHEN d > 0.66 THEN 'extreme' END AS y_sev_class
        FROM (SELECT *, CASE WHEN y_occ_30d = 1
          THEN severity_prediction - second_prediction END AS d FROM scored)""",
        "scored",
    ),
)
def severity_columns(spark, sf):
    rows = T.scored(spark, sf).drop("y_sev_available", "y_sev_dnbr")
    event = F.when(F.col("y_occ_30d") == 1, F.col("reference_date"))
    return labels.severity_from_columns(
        rows.select(
            "*",
            event.alias("event_date"),
            F.col("severity_prediction").alias("label_nbr_prefire"),
            F.col("second_prediction").alias("label_nbr_postfire"),
        )
    )

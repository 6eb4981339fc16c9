"""Feature enrichment of the panel.

Each step is a set of named column expressions decided from the schema; ``enrich_panel`` puts
them into two projections around one window and takes all global statistics from one job.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyrogrid.functions.scalars import clip_low

# Column stems, coefficients and window pairs of the derived features.
TEMPERATURE = "weather_temperature_2m_mean"
TEMPERATURE_MAX = "weather_temperature_2m_max"
DEWPOINT = "weather_dewpoint_temperature_2m_mean"
PRECIPITATION = "weather_total_precipitation_sum_mean"
VPD = "weather_vpd_mean"
WIND_U = "weather_u_component_of_wind_10m_mean"
WIND_V = "weather_v_component_of_wind_10m_mean"
EPSILON = 1e-8
KELVIN_OFFSET = 273.15
KELVIN_THRESHOLD = 200
INDEX_WINDOWS = (7, 14, 30, 60)
RATIO_WINDOWS = ((7, 60), (7, 30), (14, 60), (3, 30))
RATIO_STEMS = (PRECIPITATION, TEMPERATURE, VPD)
DIFF_COLUMNS = (f"{TEMPERATURE}_l7d", f"{PRECIPITATION}_l7d", f"{VPD}_l7d")

Derived = dict[str, Column]


def _windows(columns: Sequence[str], stem: str) -> list[int]:
    found = (re.fullmatch(rf"{stem}_l(\d+)d", c) for c in columns)
    return sorted(int(m.group(1)) for m in found if m)


def median_exceeds(df: DataFrame, columns: Sequence[str], threshold: float) -> dict[str, bool]:
    """Whether each column's exact median is above ``threshold``, from one flat aggregation.

    Counting the values above the threshold settles it, except when they are exactly half: then
    the median is the mean of the two values next to the threshold.
    """
    if not columns:
        return {}
    aggs = []
    for i, name in enumerate(columns):
        c = F.col(name).cast("double")
        c = F.when(~F.isnan(c), c)  # NaN would count as above any threshold
        above = c > threshold
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count_if(above).alias(f"a{i}"),
            F.max(F.when(~above, c)).alias(f"l{i}"),
            F.min(F.when(above, c)).alias(f"h{i}"),
        ]
    row = df.agg(*aggs).first()
    out = {}
    for i, name in enumerate(columns):
        n, above = row[f"n{i}"], row[f"a{i}"]
        if n and 2 * above == n:
            out[name] = (row[f"l{i}"] + row[f"h{i}"]) / 2 > threshold
        else:
            out[name] = 2 * above > n
    return out


def _vapour_pressure(celsius: Column) -> Column:
    return F.lit(0.6108) * F.exp(celsius * 17.27 / (celsius + 237.3))


def vpd_inputs(columns: Sequence[str]) -> list[str]:
    out = []
    for w in _windows(columns, TEMPERATURE):
        if f"{DEWPOINT}_l{w}d" in columns:
            out += [
                c
                for c in (f"{TEMPERATURE}_l{w}d", f"{TEMPERATURE_MAX}_l{w}d")
                if c in columns
            ]
    return out


def vpd_columns(columns: Sequence[str], is_kelvin: dict[str, bool]) -> Derived:
    """Vapour pressure deficit per window; the dew point follows the mean temperature's unit."""
    out: Derived = {}

    def celsius(name: str, kelvin: bool) -> Column:
        c = F.col(name).cast("double")
        return c - KELVIN_OFFSET if kelvin else c

    for w in _windows(columns, TEMPERATURE):
        mean, dew, top = (f"{s}_l{w}d" for s in (TEMPERATURE, DEWPOINT, TEMPERATURE_MAX))
        if dew not in columns:
            continue
        actual = _vapour_pressure(celsius(dew, is_kelvin[mean]))
        out[f"{VPD}_l{w}d"] = clip_low(
            _vapour_pressure(celsius(mean, is_kelvin[mean])) - actual
        )
        if top in columns:
            out[f"weather_vpd_max_l{w}d"] = clip_low(
                _vapour_pressure(celsius(top, is_kelvin[top])) - actual
            )
    return out


def wind_columns(columns: Sequence[str]) -> Derived:
    out: Derived = {}
    for u in columns:
        if u.startswith(f"{WIND_U}_l"):
            suffix = u.removeprefix(WIND_U)
            v = WIND_V + suffix
            if v in columns:
                out[f"weather_wind_speed_mean{suffix}"] = F.sqrt(
                    F.col(u) * F.col(u) + F.col(v) * F.col(v)
                )
    return out


def terrain_columns(columns: Sequence[str]) -> Derived:
    low, high = "terrain_elevation_min", "terrain_elevation_max"
    if low in columns and high in columns:
        return {"terrain_elevation_range": F.col(high) - F.col(low)}
    return {}


def spectral_columns(columns: Sequence[str]) -> Derived:
    """Band indices for the windows 7, 14, 30 and 60 whose bands are present."""
    out: Derived = {}
    for w in INDEX_WINDOWS:
        name = {b: f"optical_b{b}_mean_l{w}d" for b in (2, 3, 4, 8, 11, 12)}

        def has(*bands, name=name):
            return all(name[b] in columns for b in bands)

        b2, b4, b8 = (F.col(name[b]) for b in (2, 4, 8))
        for index, other in (("ndvi", 4), ("nbr", 12), ("ndmi", 11)):
            if has(8, other):
                o = F.col(name[other])
                out[f"optical_{index}_mean_l{w}d"] = F.try_divide(b8 - o, b8 + o + EPSILON)
        if has(8, 4, 2):
            out[f"optical_evi_mean_l{w}d"] = 2.5 * F.try_divide(
                b8 - b4, b8 + 6 * b4 - 7.5 * b2 + 1 + EPSILON
            )
        # Present when bands 3 and 11 are, although it is computed from bands 4 and 8.
        if has(8, 3, 11) and has(4):
            out[f"optical_savi_mean_l{w}d"] = 1.5 * F.try_divide(
                b8 - b4, b8 + b4 + 0.5 + EPSILON
            )
    return out


def patch_order(patch: str = "patch_id", day: str = "reference_date"):
    """A patch holds one row per reference date, so its window stays as long as the spine."""
    return W.partitionBy(patch).orderBy(day)


def diff_columns(columns: Sequence[str], wanted: Sequence[str], stride_days: int) -> Derived:
    """Change since the patch's previous row, in date order and whatever the distance."""
    out: Derived = {}
    for name in wanted:
        if name in columns:
            diff = F.col(name) - F.lag(name).over(patch_order())
            out[f"{name}_diff_{stride_days}d"] = diff
            out[f"{name}_rate_{stride_days}d"] = diff / F.lit(stride_days)
    return out


def _desiccation_inputs(columns: Sequence[str]) -> list[tuple[int, str, str]]:
    pairs = [(w, f"{TEMPERATURE}_l{w}d", f"{PRECIPITATION}_l{w}d") for w in INDEX_WINDOWS]
    return [p for p in pairs if p[1] in columns and p[2] in columns]


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of several columns in one job."""
    if not columns:
        return {}
    row = df.agg(
        *[f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in
          (("m", F.avg), ("s", F.stddev_samp))]
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def desiccation_columns(columns: Sequence[str], stats: dict[str, tuple[float, float]]) -> Derived:
    def z(name: str) -> Column:
        mean, std = stats[name]
        if mean is None or std is None:
            return F.lit(None).cast("double")
        return (F.col(name) - mean) / (std + EPSILON)

    return {
        f"weather_desiccation_index_l{w}d": z(temp) - z(rain)
        for w, temp, rain in _desiccation_inputs(columns)
    }


def ratio_columns(columns: Sequence[str]) -> Derived:
    out: Derived = {}
    for short, long in RATIO_WINDOWS:
        for stem in RATIO_STEMS:
            a, b = f"{stem}_l{short}d", f"{stem}_l{long}d"
            if a in columns and b in columns:
                out[f"{stem}_ratio_{short}d_{long}d"] = F.try_divide(
                    F.col(a), F.col(b) + EPSILON
                )
    return out


def add_columns(df: DataFrame, derived: Derived) -> DataFrame:
    """Append or replace columns in one projection."""
    kept = [c for c in df.columns if c not in derived]
    return df.select(*kept, *[c.alias(n) for n, c in derived.items()])


def vpd(df: DataFrame) -> DataFrame:
    kelvin = median_exceeds(df, vpd_inputs(df.columns), KELVIN_THRESHOLD)
    return add_columns(df, vpd_columns(df.columns, kelvin))


def wind_speed(df: DataFrame) -> DataFrame:
    return add_columns(df, wind_columns(df.columns))


def terrain_range(df: DataFrame) -> DataFrame:
    return add_columns(df, terrain_columns(df.columns))


def spectral_indices(df: DataFrame) -> DataFrame:
    return add_columns(df, spectral_columns(df.columns))


def temporal_diff(df: DataFrame, columns: Sequence[str], stride_days: int = 7) -> DataFrame:
    return add_columns(df, diff_columns(df.columns, columns, stride_days))


def _fit_rows(df: DataFrame, fit_on: str | None) -> DataFrame:
    return df if fit_on is None else df.where(F.col("split") == fit_on)


def desiccation_index(df: DataFrame, fit_on: str | None = None) -> DataFrame:
    """z(temperature) - z(precipitation) over the whole frame, or fitted on one split."""
    names = [n for _, *pair in _desiccation_inputs(df.columns) for n in pair]
    return add_columns(
        df, desiccation_columns(df.columns, moments(_fit_rows(df, fit_on), names))
    )


def feature_ratios(df: DataFrame) -> DataFrame:
    return add_columns(df, ratio_columns(df.columns))


def enrich_panel(df: DataFrame, stride_days: int = 7, fit_on: str | None = None) -> DataFrame:
    """All enrichment steps in their fixed order: indices before labels, VPD before its diffs."""
    columns = df.columns
    kelvin = median_exceeds(df, vpd_inputs(columns), KELVIN_THRESHOLD)
    names = [n for _, *pair in _desiccation_inputs(columns) for n in pair]
    stats = moments(_fit_rows(df, fit_on), names)
    out = add_columns(
        df,
        vpd_columns(columns, kelvin)
        | wind_columns(columns)
        | terrain_columns(columns)
        | spectral_columns(columns),
    )
    return add_columns(
        out,
        diff_columns(out.columns, DIFF_COLUMNS, stride_days)
        | desiccation_columns(out.columns, stats)
        | ratio_columns(out.columns),
    )


def sequence_window(
    df: DataFrame, columns: Sequence[str], length: int, name: str = "sequence"
) -> DataFrame:
    """Last ``length`` rows of the patch up to each row, zero-filled and padded on the left."""
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    frame = patch_order().rowsBetween(-(length - 1), 0)
    seen = F.collect_list(row).over(frame)
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(columns)), F.lit(length) - F.size("_seen"))
    return (
        df.withColumn("_seen", seen)
        .withColumn(name, F.concat(zeros, F.col("_seen")))
        .withColumn(f"{name}_length", F.size("_seen"))
        .drop("_seen")
    )

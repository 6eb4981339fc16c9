"""Zonal and temporal aggregation of observation tables onto the panel key.

Every source reduces twice: over time within a pixel, then over the pixels of a patch.  Look-back
windows are half-open, ``[reference_date - w, reference_date)``.

Instead of a range join, an observation is exploded to the few spine dates that can see it, which
is plain day arithmetic.  Before that, observations are summed into *elementary bins*: days
between two consecutive window edges (modulo the stride) are seen by exactly the same windows, so
sums and counts per bin lose nothing and the explosion multiplies bins rather than raw rows.  All
windows of a source come out of one pass over its observations.

Rows are laid out by patch, once and before they multiply; all groupings below keep the patch, so
none shuffles again.  Only patches that would fill a task go another way: they are laid out by
patch, time chunk and pixel part, time is reduced inside that layout, pixels are reduced to mergeable
partial states (count, mean, sum of squared deviations, extremes) there, and those meet at the panel
key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyrogrid.config import TemporalConfig
from pyrogrid.functions.skew import has_large_key, large_keys, with_parts
from pyrogrid.sources.medians import streamed_means, streamed_medians
from pyrogrid.sources.panel import by_patch
from pyrogrid.sources.tables import nan_to_null

# Bands, class labels and thresholds of the source products.
WEATHER_BANDS = (
    "temperature_2m",
    "dewpoint_temperature_2m",
    "total_precipitation_sum",
    "u_component_of_wind_10m",
    "v_component_of_wind_10m",
    "surface_pressure",
    "soil_temperature_level_1",
    "volumetric_soil_water_layer_1",
)
OPTICAL_BANDS = ("b2", "b3", "b4", "b8", "b11", "b12")
LANDCOVER_CLASSES = (
    "water",
    "trees",
    "grass",
    "flooded_vegetation",
    "crops",
    "shrub_and_scrub",
    "built",
    "bare",
    "snow_and_ice",
)
CLOUD_LIMIT = 40
FIRE_CONFIDENCE = 7
TWI_RADIANS = 3.14159 / 180.0
TWI_FLOOR = 0.001
STATS = ("mean", "std", "min", "max")

PIXEL = ("patch_id", "pixel_id")
KEY = ("patch_id", "reference_date")
# The panel key of rows that were exploded in place; groups that keep it need no shuffle.
PLACED = ("patch_id", "_chunk", "_part", "reference_date")


def _std(std: str):
    if std not in ("pop", "samp"):
        raise ValueError("std is 'pop' or 'samp'")
    return F.stddev_pop if std == "pop" else F.stddev_samp


def patch_stats(
    value: Column, name: str, stats: Sequence[str], std: str, weight: Column | None = None
) -> list[Column]:
    """Pixel values to patch statistics, optionally weighted by pixel coverage."""
    if weight is None:
        mean, spread = F.avg(value), _std(std)(value)
    else:
        w = F.when(value.isNotNull(), weight)
        total = F.sum(w)
        mean = F.try_divide(F.sum(w * value), total)
        second = F.try_divide(F.sum(w * value * value), total) - mean * mean
        spread = F.sqrt(F.when(second < 0, 0.0).otherwise(second))
        if std == "samp":
            spread = spread * F.sqrt(F.try_divide(total, total - 1))
    made = {"mean": mean, "std": spread, "min": F.min(value), "max": F.max(value)}
    return [made[s].alias(name.format(stat=s)) for s in stats]


def visible(
    obs: DataFrame,
    temporal: TemporalConfig,
    window: int,
    day: str = "obs_date",
    partition_month: str | None = None,
) -> DataFrame:
    """Drop what no reference date can see; the predicate reaches the scan.  NaN becomes NULL.

    ``partition_month`` names a column holding the month start, when the table is laid out by it.
    """
    first = F.date_sub(F.lit(temporal.reference_start), window)
    last = F.lit(temporal.spine_end)
    out = nan_to_null(obs).where((F.col(day) >= first) & (F.col(day) < last))
    if partition_month:
        out = out.where(
            (F.col(partition_month) >= F.trunc(first, "month"))
            & (F.col(partition_month) <= F.trunc(last, "month"))
        )
    return out.withColumn(day, F.col(day).cast("date"))


def bin_start(day: Column, temporal: TemporalConfig, windows: Sequence[int]) -> Column:
    """First day of the elementary bin ``day`` falls into."""
    stride = temporal.reference_stride_days
    edges = sorted({0} | {-w % stride for w in windows})
    phase = F.pmod(F.datediff(day, F.lit(temporal.reference_start)), F.lit(stride))
    offset = F.lit(edges[0])
    for edge in edges[1:]:
        offset = F.when(phase >= edge, F.lit(edge)).otherwise(offset)
    return F.date_sub(day, (phase - offset).cast("int"))


def _spine_range(
    temporal: TemporalConfig, first_ref: Column, last_ref: Column
) -> tuple[Column, Column]:
    """Positions on the spine of the first and last reference date within two dates."""
    stride, start = temporal.reference_stride_days, F.lit(temporal.reference_start)
    low = F.greatest(F.ceil(F.datediff(first_ref, start) / stride).cast("int"), F.lit(0))
    high = F.least(
        F.floor(F.datediff(last_ref, start) / stride).cast("int"),
        F.lit(temporal.n_reference_dates - 1),
    )
    return low, high


def _spine_date(temporal: TemporalConfig, position: str) -> Column:
    stride = temporal.reference_stride_days
    return F.date_add(F.lit(temporal.reference_start), F.col(position) * stride)


def explode_to_spine(
    df: DataFrame, temporal: TemporalConfig, first_ref: Column, last_ref: Column
) -> DataFrame:
    """One row per spine date within ``[first_ref, last_ref]``; both are date columns."""
    low, high = _spine_range(temporal, first_ref, last_ref)
    return (
        df.select("*", low.alias("_low"), high.alias("_high"))
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("_step", F.explode(F.sequence("_low", "_high")))
        .withColumn("reference_date", _spine_date(temporal, "_step"))
        .drop("_low", "_high", "_step")
    )


def explode_in_place(
    df: DataFrame,
    temporal: TemporalConfig,
    first_ref: Column,
    last_ref: Column,
    reach_days: int,
    counted: DataFrame | None = None,
) -> DataFrame:
    """As ``explode_to_spine``, shuffling rows before they multiply instead of afterwards.

    The spine is cut into chunks about twice as long as the reach, so a row goes to one or two of
    them.  Rows are partitioned by patch, chunk and pixel part and exploded there; every grouping
    that keeps these and the pixel then needs no further shuffle.  Only a patch that would fill a
    task, by its rows in ``counted``, has more than one part.
    """
    size = max(8, -(-2 * reach_days // temporal.reference_stride_days))
    low, high = _spine_range(temporal, first_ref, last_ref)
    placed = (
        with_parts(df, ["patch_id"], F.col("pixel_id"), counted)
        .select("*", low.alias("_low"), high.alias("_high"))
        .where(F.col("_low") <= F.col("_high"))
        .withColumn(
            "_chunk",
            F.explode(F.sequence(F.floor(F.col("_low") / size), F.floor(F.col("_high") / size))),
        )
        .repartition("patch_id", "_chunk", "_part")
    )
    start = F.greatest(F.col("_low"), (F.col("_chunk") * size).cast("int"))
    end = F.least(F.col("_high"), (F.col("_chunk") * size + (size - 1)).cast("int"))
    return (
        placed.withColumn("_step", F.explode(F.sequence(start, end)))
        .withColumn("reference_date", _spine_date(temporal, "_step"))
        .drop("_low", "_high", "_step")
    )


def lookback_join(
    df: DataFrame, temporal: TemporalConfig, window: int, day: str = "obs_date"
) -> DataFrame:
    """Rows paired with every reference date that sees them, with the ``gap`` in days."""
    d = F.col(day)
    return explode_to_spine(
        df, temporal, F.date_add(d, 1), F.date_add(d, window)
    ).withColumn("gap", F.datediff("reference_date", d))


Reduce = Callable[[DataFrame, tuple[str, ...]], DataFrame]


def reduce_by_patch(
    rows: DataFrame,
    temporal: TemporalConfig,
    refs: tuple[Column, Column],
    reach_days: int,
    reduce: Reduce,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    unexploded: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``prepare`` and explode ``rows`` to the reference dates ``refs``, then ``reduce`` them.

    ``reduce(placed, layout)`` returns rows per panel key; its groups by ``layout`` and more columns
    need no shuffle.  ``layout`` is the panel key itself unless the patch is large.  ``unexploded``,
    if given, makes the same rows from patches that are not large, before they multiply.
    """
    prepare = prepare or (lambda df: df)
    ordinary, large = rows, None
    if has_large_key(rows.select("patch_id"), ["patch_id"]):
        keys = F.broadcast(large_keys(rows.select("patch_id"), ["patch_id"]).select("patch_id"))
        ordinary = rows.join(keys, "patch_id", "left_anti")
        large = rows.join(keys, "patch_id", "left_semi")
    if unexploded:
        out = unexploded(by_patch(ordinary))
    else:
        out = reduce(explode_to_spine(prepare(by_patch(ordinary)), temporal, *refs), KEY)
    if large is None:
        return out
    # Parts are counted among all rows, whose share of a task made these patches large.
    placed = explode_in_place(prepare(large), temporal, *refs, reach_days, rows)
    return out.unionByName(reduce(placed, PLACED))


def reduce_lookback(
    rows: DataFrame,
    temporal: TemporalConfig,
    window: int,
    reduce: Reduce,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    day: str = "obs_date",
    unexploded: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``reduce_by_patch`` over the dates that look back on a row, with the ``gap`` in days."""
    d = F.col(day)
    return reduce_by_patch(
        rows, temporal, (F.date_add(d, 1), F.date_add(d, window)), window,
        lambda df, layout: reduce(df.withColumn("gap", F.datediff("reference_date", d)), layout),
        prepare, unexploded,
    )


def _streamed(
    run: Callable[..., DataFrame], rows: DataFrame, temporal: TemporalConfig, day: str,
    bands: Sequence[str], prefix: str, stats: Sequence[str], std: str,
) -> DataFrame:
    """Streamed means or medians of all windows for rows partitioned by patch."""
    windows = temporal.temporal_windows
    refs = F.date_add(day, 1), F.date_add(day, windows[-1])
    return run(
        rows, day, *_spine_range(temporal, *refs), bands, windows,
        temporal.reference_start, temporal.reference_stride_days,
        lambda b, stat, w: f"{prefix}_{b}_{stat}_l{w}d", stats, std,
    )


def _binned(obs, temporal, windows, day, sums, extra=()):
    return (
        obs.groupBy(*PIXEL, *extra, bin_start(F.col(day), temporal, windows).alias(day))
        .agg(*[c.alias(n) for n, c in sums.items()])
    )


def _within(window: int, value: Column) -> Column:
    return F.when(F.col("gap") <= window, value)


def zonal_weather(
    obs: DataFrame,
    temporal: TemporalConfig,
    bands: Sequence[str] = WEATHER_BANDS,
    prefix: str = "weather",
    stats: Sequence[str] = STATS,
    std: str = "pop",
    weight: str | None = None,
    day: str = "obs_date",
    partition_month: str | None = None,
) -> DataFrame:
    """Per window: time mean within a pixel, then mean / std / min / max over pixels.

    Rows without a weight are streamed by patch and date; weighted pixels and a patch that would
    fill a task are grouped by Spark.
    """
    _std(std)
    windows = temporal.temporal_windows
    seen = visible(obs, temporal, windows[-1], day, partition_month)
    sums = {f"s_{b}": F.sum(b) for b in bands} | {f"c_{b}": F.count(b) for b in bands}
    if weight:
        sums["weight"] = F.max(weight)
    share = F.col("weight") if weight else None

    def reduce(placed, layout):
        per_pixel = _per_window(placed, windows).groupBy(*layout, "window", "pixel_id").agg(
            *[F.try_divide(F.sum(f"s_{b}"), F.sum(f"c_{b}")).alias(b) for b in bands],
            *([F.max("weight").alias("weight")] if weight else []),
        )
        long = per_pixel.groupBy(*KEY, "window").agg(
            *[c for b in bands for c in patch_stats(F.col(b), f"{b}_{{stat}}", stats, std, share)]
        )
        return _wide(long, windows, [(b, s) for b in bands for s in stats], prefix)

    def streamed(rows):
        return _streamed(streamed_means, rows, temporal, day, bands, prefix, stats, std)

    seen = seen.select(*PIXEL, day, *bands, *([weight] if weight else []))
    return reduce_lookback(
        seen, temporal, windows[-1], reduce, lambda df: _binned(df, temporal, windows, day, sums), day,
        None if weight else streamed,
    )


def _per_window(placed: DataFrame, windows: Sequence[int]) -> DataFrame:
    """One row per window that reaches back to the observation."""
    reached = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w >= F.col("gap"))
    return placed.withColumn("window", F.explode(reached))


def _wide(
    long: DataFrame, windows: Sequence[int], values: Sequence[tuple[str, str]], prefix: str
) -> DataFrame:
    """Rows per window to columns per window: one aggregate and one projection, however wide."""
    names = [f"{band}_{stat}" for band, stat in values]
    rows = long.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("window", F.struct(*names)))).alias("m")
    )
    picked = rows.select(*KEY, *[F.try_element_at("m", F.lit(w)).alias(f"w{w}") for w in windows])
    return picked.select(
        *KEY,
        *[
            F.col(f"w{w}").getField(f"{band}_{stat}").alias(f"{prefix}_{band}_{stat}_l{w}d")
            for w in windows
            for band, stat in values
        ],
    )


# Output name -> (band, look-back window or None for all rows of the group).
MedianSpec = Mapping[str, tuple[str, int | None]]


def pixel_medians(placed: DataFrame, groups: Sequence[str], spec: MedianSpec) -> DataFrame:
    """Exact median per group for every entry of ``spec``; null where a group holds no value.

    Values are exploded to (band, value) and sorted inside their partition.  Running counts over
    that order, one for each window, tell the middle rows, so a band is sorted once for all its
    windows, nothing is listed, and a group of any size spills.  ``placed`` should be partitioned by
    columns among ``groups``.
    """
    bands = sorted({band for band, _ in spec.values()})
    windows = sorted({w for _, w in spec.values()}, key=lambda w: (w is None, w))
    gap = ["gap"] if windows != [None] else []
    values = F.posexplode(F.array(*[F.col(b).cast("double") for b in bands])).alias("_band", "_v")
    long = placed.select(*groups, *gap, values)
    order = W.partitionBy(*groups, "_band").orderBy("_v")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = {
        w: F.when(F.col("_v").isNotNull() & (F.lit(True) if w is None else F.col("gap") <= w), 1)
        for w in windows
    }
    counted = long.select(
        *groups, "_band", "_v",
        F.row_number().over(order).alias("_row"),
        *[c.alias(f"_one{w}") for w, c in one.items()],
        *[F.count(c).over(upto).alias(f"_upto{w}") for w, c in one.items()],
        *[F.count(c).over(whole).alias(f"_all{w}") for w, c in one.items()],
    )

    def middle(w):
        """Half the value for each of the two middle places a row holds."""
        place, n = F.col(f"_upto{w}") - 1, F.col(f"_all{w}")
        held = (place == F.expr(f"(_all{w} - 1) div 2")).cast("int") + (
            place == F.floor(n / 2)
        ).cast("int")
        return F.when(F.col(f"_one{w}").isNotNull() & (held > 0), F.col("_v") / 2 * held)

    marked = counted.select(
        *groups, "_band", "_row", *[middle(w).alias(f"_m{w}") for w in windows]
    )
    kept = F.col("_row") == 1  # keeps groups without any value
    for w in windows:
        kept = kept | F.col(f"_m{w}").isNotNull()
    return marked.where(kept).groupBy(*groups).agg(
        *[
            F.sum(F.when(F.col("_band") == bands.index(band), F.col(f"_m{w}"))).alias(name)
            for name, (band, w) in spec.items()
        ]
    )


def clear_scenes(obs: DataFrame, cloud: str = "cloud_pct", limit: float = CLOUD_LIMIT):
    return obs.where(F.col(cloud) < limit)


def zonal_optical(
    obs: DataFrame,
    temporal: TemporalConfig,
    bands: Sequence[str] = OPTICAL_BANDS,
    prefix: str = "optical",
    std: str = "pop",
    day: str = "obs_date",
    cloud: str = "cloud_pct",
    partition_month: str | None = None,
) -> DataFrame:
    """Clear scenes only; per window a median composite per pixel, then patch statistics.

    A window without clear scenes yields NULLs, a panel row without any is absent here and gets
    its NULLs from the left join to the skeleton.  A patch that would fill a task is sorted by Spark
    instead (``pixel_medians``).
    """
    windows = temporal.temporal_windows
    seen = clear_scenes(visible(obs, temporal, windows[-1], day, partition_month), cloud)
    seen = seen.select(*PIXEL, day, *bands)

    def reduce(placed, layout):
        medians = pixel_medians(
            placed, (*layout, "pixel_id"), {f"{b}_{w}": (b, w) for w in windows for b in bands}
        )
        return medians.groupBy(*KEY).agg(
            *[
                c
                for w in windows
                for b in bands
                for c in patch_stats(
                    F.col(f"{b}_{w}"), f"{prefix}_{b}_{{stat}}_l{w}d", STATS, std
                )
            ]
        )

    def streamed(rows):
        return _streamed(streamed_medians, rows, temporal, day, bands, prefix, STATS, std)

    _std(std)
    return reduce_lookback(seen, temporal, windows[-1], reduce, day=day, unexploded=streamed)


def zonal_terrain(pixels: DataFrame, std: str = "pop") -> DataFrame:
    """Static elevation, slope and wetness proxy per patch from pixel rows."""
    steepness = F.greatest(F.tan(F.col("slope") * TWI_RADIANS), F.lit(TWI_FLOOR))
    twi = F.when(F.col("slope").isNotNull(), -F.log(steepness))
    two = ("mean", "std")
    return pixels.groupBy("patch_id").agg(
        *patch_stats(F.col("elevation"), "terrain_elevation_{stat}", STATS, std),
        *patch_stats(F.col("slope"), "terrain_slope_{stat}", two, std),
        *patch_stats(twi, "terrain_twi_{stat}", two, std),
    )


def fire_count_window(
    obs: DataFrame, temporal: TemporalConfig, mask: str = "fire_mask", day: str = "obs_date"
) -> DataFrame:
    """Images with a confident fire per pixel and window, averaged over pixels."""
    windows = temporal.temporal_windows
    seen = visible(obs, temporal, windows[-1], day)
    hits = F.sum(F.when(F.col(mask) >= FIRE_CONFIDENCE, 1).when(F.col(mask).isNotNull(), 0))

    def reduce(placed, layout):
        per_pixel = placed.groupBy(*layout, "pixel_id").agg(
            *[F.sum(_within(w, F.col("hits"))).alias(f"h_{w}") for w in windows]
        )
        return per_pixel.groupBy(*KEY).agg(
            *[F.avg(f"h_{w}").alias(f"temporal_fire_count_l{w}d") for w in windows]
        )

    return reduce_lookback(
        seen, temporal, windows[-1], reduce,
        lambda df: _binned(df, temporal, windows, day, {"hits": hits}), day,
    )


def burn_day(image_day: Column, doy: Column) -> Column:
    """Day of a burn from the image year and its day-of-year band; 0 and less mean unburned."""
    new_year = F.make_date(F.year(image_day), F.lit(1), F.lit(1))
    return F.when(doy > 0, F.date_add(new_year, (doy - 1).cast("int")))


def _burn_windows(obs, temporal, windows, day, doy):
    """Per panel key and window: share of burned pixels and earliest burn day.

    An image belongs to a window when its month does, so a pixel's rows shrink to distinct
    (month, burn day) pairs before they are exploded.
    """
    month = F.trunc(F.col(day), "month")
    longest = max(windows)
    seen = obs.where(
        (F.col(day) >= F.trunc(F.date_sub(F.lit(temporal.reference_start), longest), "month"))
        & (F.col(day) < F.add_months(F.trunc(F.lit(temporal.spine_end), "month"), 1))
    )
    pairs = seen.select(
        *PIXEL, month.alias("month"), burn_day(F.col(day), F.col(doy)).alias("burned_on")
    )
    next_month = F.add_months("month", 1)

    def in_images(w):
        return F.col("reference_date") < F.date_add(next_month, w)

    def burned(w):
        return (F.col("burned_on") >= F.date_sub("reference_date", w)) & (
            F.col("burned_on") < F.col("reference_date")
        )

    def reduce(placed, layout):
        per_pixel = placed.groupBy(*layout, "pixel_id").agg(
            *[
                c
                for w in windows
                for c in (
                    F.max(
                        F.when(in_images(w), F.coalesce(burned(w), F.lit(False)).cast("int"))
                    ).alias(f"b_{w}"),
                    F.min(F.when(in_images(w) & burned(w), F.col("burned_on"))).alias(f"d_{w}"),
                )
            ]
        )
        return per_pixel.groupBy(*KEY).agg(
            *[
                c
                for w in windows
                for c in (F.avg(f"b_{w}").alias(f"b_{w}"), F.min(f"d_{w}").alias(f"d_{w}"))
            ]
        )

    refs = F.col("month"), F.date_add(next_month, longest - 1)
    return reduce_by_patch(
        pairs, temporal, refs, longest + 31, reduce, lambda df: df.distinct()
    )


def epoch_ms(day: Column) -> Column:
    return F.unix_date(day).cast("long") * 86_400_000


def burn_window(
    obs: DataFrame, temporal: TemporalConfig, doy: str = "burn_doy", day: str = "obs_date"
) -> DataFrame:
    windows = temporal.temporal_windows
    found = _burn_windows(obs, temporal, windows, day, doy)
    return found.select(
        *KEY,
        *[
            c
            for w in windows
            for c in (
                F.col(f"b_{w}").alias(f"temporal_burn_count_l{w}d"),
                epoch_ms(F.col(f"d_{w}")).alias(f"temporal_burn_timestamp_l{w}d"),
                F.col(f"d_{w}").alias(f"temporal_burn_date_l{w}d"),
            )
        ],
    )


def observed_burn(
    obs: DataFrame, temporal: TemporalConfig, doy: str = "burn_doy", day: str = "obs_date"
) -> DataFrame:
    """Earliest burn over the whole lookback."""
    w = temporal.lookback_days
    found = _burn_windows(obs, temporal, [w], day, doy)
    return found.select(
        *KEY,
        epoch_ms(F.col(f"d_{w}")).alias("modis_burn_timestamp"),
        F.col(f"d_{w}").alias("modis_burn_date"),
    )


def landcover_fraction(
    obs: DataFrame,
    temporal: TemporalConfig,
    label: str = "label",
    day: str = "obs_date",
    classes: Sequence[str] = LANDCOVER_CLASSES,
) -> DataFrame:
    """Most frequent class per pixel over the lookback (smallest on ties), then class shares."""
    w = temporal.lookback_days
    seen = visible(obs.where(F.col(label).isNotNull()), temporal, w, day)
    counted = {"n": F.count(F.lit(1))}

    def reduce(placed, layout):
        votes = placed.groupBy(*layout, "pixel_id", label).agg(F.sum("n").alias("n"))
        modes = votes.groupBy(*layout, "pixel_id").agg(
            F.max_by(label, F.struct("n", -F.col(label))).alias("mode")
        )
        return modes.groupBy(*KEY).agg(
            *[
                F.avg((F.col("mode") == i).cast("double")).alias(f"landcover_{c}_fraction")
                for i, c in enumerate(classes)
            ]
        )

    return reduce_lookback(
        seen, temporal, w, reduce,
        lambda df: _binned(df, temporal, [w], day, counted, extra=(label,)), day,
    )


def peat_fraction(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Mean of a 0..1 raster over each patch."""
    return pixels.groupBy("patch_id").agg(F.avg(value).alias("peat_fraction"))


def peat_fraction_local(pixels: DataFrame, nodata: float, value: str = "value") -> DataFrame:
    """Share of positive pixels among the valid ones; 0 when a patch has no valid pixel."""
    v = F.col(value)
    return pixels.groupBy("patch_id").agg(
        (F.count_if(v > 0) / F.greatest(F.count_if(v != F.lit(nodata)), F.lit(1))).alias(
            "peat_fraction"
        )
    )


def population_stats(
    layers: DataFrame,
    temporal: TemporalConfig,
    year: str = "year",
    value: str = "population",
) -> DataFrame:
    """Layers of the reference date's year: mean over layers per pixel, then mean and max."""
    per_year = (
        layers.groupBy(*PIXEL, year)
        .agg(F.avg(value).alias("v"))
        .groupBy("patch_id", year)
        .agg(
            F.avg("v").alias("human_population_mean"), F.max("v").alias("human_population_max")
        )
    )
    new_year = F.make_date(F.col(year), F.lit(1), F.lit(1))
    last = F.make_date(F.col(year), F.lit(12), F.lit(31))
    return explode_to_spine(per_year, temporal, new_year, last).drop(year)


def composite_nbr(
    scenes: DataFrame,
    events: DataFrame,
    severity_window_days: int,
    day: str = "obs_date",
    cloud: str = "cloud_pct",
    nir: str = "b8",
    swir: str = "b12",
) -> DataFrame:
    """Burn ratio of clear-scene median composites before and after each distinct event.

    Before is ``[event - w, event)``, after is ``[event, event + w)``.  Scenes meet events on
    (patch, time slot): an event looks at the slots of length w around it, so the join is an
    equi-join and a scene meets only events within w days.
    """
    w = severity_window_days
    slot = F.floor(F.unix_date(F.col("_day")) / w)
    event_slot = F.floor(F.unix_date("event_date") / w)
    wanted = (
        events.select("patch_id", "event_date")
        .distinct()
        .withColumn("_slot", F.explode(F.sequence(event_slot - 1, event_slot + 1)))
    )
    seen = clear_scenes(scenes, cloud).select(
        *PIXEL, F.col(day).cast("date").alias("_day"), nir, swir
    )
    met = (
        seen.withColumn("_slot", slot)
        .join(wanted, ["patch_id", "_slot"])
        .withColumn("_lag", F.datediff("_day", "event_date"))
        .where((F.col("_lag") >= -w) & (F.col("_lag") < w))
        .withColumn("side", F.when(F.col("_lag") < 0, "pre").otherwise("post"))
    )
    groups = ("patch_id", "event_date", "side", "pixel_id")
    spec = {"nir": (nir, None), "swir": (swir, None)}
    medians = pixel_medians(met.repartition(*groups), groups, spec)
    ratio = F.try_divide(F.col("nir") - F.col("swir"), F.col("nir") + F.col("swir"))
    return (
        medians.groupBy("patch_id", "event_date")
        .pivot("side", ["pre", "post"])
        .agg(F.avg(ratio))
        .withColumnsRenamed({"pre": "label_nbr_prefire", "post": "label_nbr_postfire"})
    )


def earliest_future_burn(
    obs: DataFrame,
    temporal: TemporalConfig,
    horizon_days: int,
    doy: str = "burn_doy",
    day: str = "obs_date",
) -> DataFrame:
    """Earliest pixel burn in ``(reference_date, reference_date + horizon]``, from burn images.

    Only images of the months the horizon touches count.
    """
    days = (
        obs.select(
            "patch_id",
            F.trunc(F.col(day), "month").alias("month"),
            burn_day(F.col(day), F.col(doy)).alias("event_date"),
        )
        .where(
            (F.col("event_date") > F.lit(temporal.reference_start))
            & (F.col("event_date") <= F.date_add(F.lit(temporal.spine_end), horizon_days))
        )
        .distinct()
    )
    reach = F.date_add("reference_date", horizon_days)
    return (
        explode_to_spine(
            days, temporal, F.date_sub("event_date", horizon_days), F.date_sub("event_date", 1)
        )
        .where(F.col("month").between(F.trunc("reference_date", "month"), F.trunc(reach, "month")))
        .groupBy(*KEY)
        .agg(F.min("event_date").alias("event_date"))
    )

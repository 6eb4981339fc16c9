"""Forward-window occurrence labels and before / after severity labels.

Events and reference dates of a patch are merged into one *timeline* with a single row per
calendar day, however many panel rows or detections fall on it.  Looking ahead for the next event
and around an event for its burn ratios are range frames over that timeline, so a patch's window
is as long as the calendar, not as its observations, and wide panel rows are never sorted.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

from pyrogrid.functions.scalars import as_event_date, clip_low, severity_class
from pyrogrid.operators.features import INDEX_WINDOWS, add_columns
from pyrogrid.sources.panel import on_panel_key, require_patches
from pyrogrid.sources.zonal import composite_nbr

KEY = ["patch_id", "reference_date"]
EVENT = ["patch_id", "event_date"]
SCAFFOLD = ("temporal_burn_date_l", "temporal_burn_timestamp_l")

SeverityFn = Callable[[DataFrame, int], DataFrame]


def occurrence_column(horizon_days: int) -> str:
    return f"y_occ_{int(horizon_days)}d"


def event_window(columns: list[str], stride_days: int) -> int:
    """Smallest burn / fire count window spanning a whole stride."""
    found = (re.fullmatch(r"temporal_(?:burn|fire)_count_l(\d+)d", c) for c in columns)
    windows = sorted({int(m.group(1)) for m in found if m})
    for w in windows:
        if w >= stride_days:
            return w
    raise ValueError(
        "labels need temporal burn or fire counts over a window of at least one stride"
    )


def _dated_burns(df: DataFrame, stride_days: int) -> tuple[Column, Column]:
    """Whether the row's look-back window holds a burn, and the date of its earliest one."""
    w = event_window(df.columns, stride_days)
    count, stamp, day = (
        f"temporal_burn_{kind}_l{w}d" for kind in ("count", "timestamp", "date")
    )
    if count not in df.columns:
        raise ValueError(
            "active-fire counts carry no date; labels require an inferable temporal_burn_date"
        )
    if stamp not in df.columns:
        raise ValueError("burn counts can only be dated with temporal_burn_timestamp features")
    dated = as_event_date(df, stamp)
    if day in df.columns:
        dated = F.coalesce(dated, as_event_date(df, day))
    return F.coalesce(F.col(count).cast("double"), F.lit(0.0)) > 0, dated


def observed_events(df: DataFrame, stride_days: int) -> DataFrame:
    """Mark panel rows whose look-back window holds a dated burn.

    Positive rows without any date are demoted to non-events; ``undated_burns`` counts them.
    """
    positive, dated = _dated_burns(df, stride_days)
    return add_columns(
        df,
        {
            "observed_event": (positive & dated.isNotNull()).cast("int"),
            "observed_event_date": dated,
        },
    )


def undated_burns(df: DataFrame, stride_days: int) -> DataFrame:
    """How many burn-positive rows cannot be dated, hence are demoted."""
    positive, dated = _dated_burns(df, stride_days)
    return df.agg(F.count_if(positive & dated.isNull()).alias("demoted"))


def _day(c: str | Column) -> Column:
    return F.unix_date(F.col(c).cast("date") if isinstance(c, str) else c)


def timeline(
    panel: DataFrame, events: DataFrame, nbr: Column | None = None
) -> DataFrame:
    """One row per patch and calendar day: is it a reference date, an event day, with which NBR.

    ``events`` has ``patch_id, event_date``.  Duplicates on either side collapse in the map-side
    combine of the grouping.
    """
    refs = panel.select("patch_id", _reference_entry(nbr).alias("entry"))
    seen = events.where(F.col("event_date").isNotNull()).select(
        "patch_id", _event_entry("event_date").alias("entry")
    )
    return _collapse(refs.unionByName(seen))


def own_timeline(marked: DataFrame, nbr: Column | None = None) -> DataFrame:
    """Timeline of a panel and the events marked on it, from one pass over its rows."""
    event = F.when(F.col("observed_event") == 1, _event_entry("observed_event_date"))
    entries = F.array_compact(F.array(_reference_entry(nbr), event))
    return _collapse(marked.select("patch_id", F.explode(entries).alias("entry")))


def _entry(day: Column, is_ref: bool, nbr: Column) -> Column:
    return F.struct(
        day.alias("day"),
        F.lit(is_ref).alias("is_ref"),
        F.lit(not is_ref).alias("is_event"),
        nbr.cast("double").alias("nbr"),
    )


def _reference_entry(nbr: Column | None) -> Column:
    return _entry(_day("reference_date"), True, F.lit(None) if nbr is None else nbr)


def _event_entry(day: str) -> Column:
    return _entry(_day(day), False, F.lit(None))


def _collapse(entries: DataFrame) -> DataFrame:
    return (
        entries.select("patch_id", "entry.*")
        .groupBy("patch_id", "day")
        .agg(
            F.max("is_ref").alias("is_ref"),
            F.max("is_event").alias("is_event"),
            F.max("nbr").alias("nbr"),
        )
    )


def _ahead(days: int):
    return W.partitionBy("patch_id").orderBy("day").rangeBetween(1, days)


def _as_date(day: Column) -> Column:
    return F.date_from_unix_date(day)


def next_event(panel: DataFrame, events: DataFrame, horizon_days: int) -> DataFrame:
    """First event in ``(reference_date, reference_date + horizon]`` per distinct panel key."""
    found = F.min(F.when(F.col("is_event"), F.col("day"))).over(_ahead(horizon_days))
    return (
        timeline(panel, events)
        .withColumn("next_day", found)
        .where("is_ref")
        .select(
            "patch_id",
            _as_date(F.col("day")).alias("reference_date"),
            _as_date(F.col("next_day")).alias("event_date"),
        )
    )


def event_rows(df: DataFrame) -> DataFrame:
    """Distinct dated events of a frame with observed-event columns."""
    return (
        df.where(F.col("observed_event") == 1)
        .select("patch_id", F.col("observed_event_date").alias("event_date"))
        .where(F.col("event_date").isNotNull())
        .distinct()
    )


def event_exists(
    df: DataFrame,
    horizon_days: int = 30,
    indicator: str = "observed_event",
    event_day: str = "observed_event_date",
    group: str = "patch_id",
    day: str = "reference_date",
) -> DataFrame:
    """0/1 label: does any event of the group fall in the horizon ahead of the row."""
    lacking = sorted({indicator, event_day, group, day} - set(df.columns))
    if lacking:
        raise ValueError(f"occurrence labels need the columns {', '.join(lacking)}")
    positive = F.coalesce(F.col(indicator).cast("int"), F.lit(0)) == 1
    undated = df.where(positive & F.col(event_day).isNull()).count()
    if undated:
        raise ValueError(f"{undated} positive rows have no {event_day}")
    keyed = df.withColumn(day, F.col(day).cast("date"))
    panel = keyed.select(F.col(group).alias("patch_id"), F.col(day).alias("reference_date"))
    events = df.where(positive).select(
        F.col(group).alias("patch_id"), F.col(event_day).cast("date").alias("event_date")
    )
    found = next_event(panel, events, horizon_days).select(
        F.col("patch_id").alias(group),
        F.col("reference_date").alias(day),
        F.col("event_date").isNotNull().cast("int").alias(occurrence_column(horizon_days)),
    )
    return keyed.join(found.hint("merge"), [group, day], "left")


def nbr_value(columns: list[str]) -> Column:
    """Burn ratio of a row: the first of its windows 7, 14, 30, 60 that has a value."""
    names = [f"optical_nbr_mean_l{w}d" for w in INDEX_WINDOWS]
    present = [F.col(n).cast("double") for n in names if n in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def severity_columns(pre: Column, post: Column) -> dict[str, Column]:
    """Severity from the two burn ratios; available when both are known."""
    dnbr = clip_low(pre - post)
    return {
        "label_nbr_prefire": pre,
        "label_nbr_postfire": post,
        "y_sev_available": (pre.isNotNull() & post.isNotNull()).cast("int"),
        "y_sev_dnbr": dnbr,
        "y_sev_class": severity_class(dnbr),
    }


def _with_event_nbr(line: DataFrame, severity_window_days: int) -> DataFrame:
    """Burn ratio of the latest reference row before, and the latest one after, each day.

    Without a row on either side both stay NULL; a row without a value counts as a row.
    """
    order = W.partitionBy("patch_id").orderBy("day")
    before = order.rangeBetween(-severity_window_days, -1)
    after = order.rangeBetween(1, severity_window_days)
    ref_day = F.when(F.col("is_ref"), F.col("day"))
    both = F.max(ref_day).over(before).isNotNull() & F.max(ref_day).over(after).isNotNull()
    return line.select(
        "*",
        F.when(both, F.max_by("nbr", ref_day).over(before)).alias("pre"),
        F.when(both, F.max_by("nbr", ref_day).over(after)).alias("post"),
    )


def local_severity(
    panel: DataFrame, events: DataFrame, severity_window_days: int = 30
) -> DataFrame:
    """Severity of each distinct event from the patch's own rows around it."""
    line = timeline(panel, events, nbr_value(panel.columns))
    found = _with_event_nbr(line, severity_window_days).where("is_event")
    return found.select(
        "patch_id",
        _as_date(F.col("day")).alias("event_date"),
        *[c.alias(n) for n, c in severity_columns(F.col("pre"), F.col("post")).items()],
    )


def composite_severity(
    scenes: DataFrame, events: DataFrame, severity_window_days: int = 30, **columns
) -> DataFrame:
    """Severity of each distinct event from clear-scene composites around it."""
    ratios = composite_nbr(scenes, events, severity_window_days, **columns)
    pre, post = F.col("label_nbr_prefire"), F.col("label_nbr_postfire")
    return (
        events.select(*EVENT)
        .distinct()
        .join(ratios, EVENT, "left")
        .select(*EVENT, *[c.alias(n) for n, c in severity_columns(pre, post).items()])
    )


SEVERITY_TYPES = {
    "label_nbr_prefire": "double",
    "label_nbr_postfire": "double",
    "y_sev_available": "int",
    "y_sev_dnbr": "double",
    "y_sev_class": "string",
}


def _empty_severity() -> dict[str, Column]:
    return {n: F.lit(None).cast(t) for n, t in SEVERITY_TYPES.items()}


def label_observed_events(
    df: DataFrame,
    horizon_days: int,
    severity_window_days: int = 30,
    stride_days: int = 7,
    severity: SeverityFn | None = None,
    grid: DataFrame | None = None,
    with_severity: bool = True,
) -> DataFrame:
    """Occurrence and severity labels from the panel's own dated burns.

    With the panel's own burn ratios everything is read off the timeline in one pass; a custom
    ``severity(events, window) -> (patch_id, event_date, ...)`` is evaluated once per distinct
    event and joined.
    """
    marked = observed_events(df, stride_days)
    # Label columns of an earlier run are replaced, not joined to.
    labels = {occurrence_column(horizon_days), "event_date", *SEVERITY_TYPES}
    marked = marked.drop(*labels.intersection(marked.columns))
    local = with_severity and severity is None
    line = own_timeline(marked, nbr_value(marked.columns) if local else None)
    if local:
        line = _with_event_nbr(line, severity_window_days)
    fields = ["day", "pre", "post"] if local else ["day"]
    upcoming = F.min(F.when(F.col("is_event"), F.struct(*fields))).over(_ahead(horizon_days))
    found = line.withColumn("next", upcoming).where("is_ref")
    occurred = F.col("next").isNotNull()
    labelled = found.select(
        "patch_id",
        _as_date(F.col("day")).alias("reference_date"),
        occurred.cast("int").alias(occurrence_column(horizon_days)),
        _as_date(F.col("next.day")).alias("event_date"),
        *(
            [c.alias(n) for n, c in severity_columns(
                F.col("next.pre"), F.col("next.post")
            ).items()]
            if local
            else []
        ),
    )
    if with_severity and severity is not None:
        events = event_rows(marked)
        if grid is not None:
            require_patches(events, grid)
        labelled = labelled.join(severity(events, severity_window_days), EVENT, "left")
        labelled = labelled.withColumn("y_sev_available", F.coalesce("y_sev_available", F.lit(0)))
    if not with_severity:
        labelled = labelled.select(
            "*", *[c.alias(n) for n, c in _empty_severity().items()]
        ).withColumn("y_sev_available", F.lit(0))
    return on_panel_key(marked, labelled)


def label_from_extractors(
    df: DataFrame,
    grid: DataFrame,
    horizon_days: int,
    severity_window_days: int,
    occurrence: Callable[[DataFrame, int], DataFrame],
    severity: SeverityFn | None,
    with_severity: bool = True,
) -> DataFrame:
    """Labels from caller-supplied table functions.

    ``occurrence(keys, horizon)`` gets the panel keys with their geometry and returns
    ``patch_id, reference_date, event_date``; ``severity(events, window)`` is as for observed
    events and sees each distinct event once.
    """
    geometry = require_patches(df, grid).select("patch_id", "geometry_wkt")
    keys = df.select(*KEY).distinct().join(geometry, "patch_id")
    found = occurrence(keys, horizon_days).select(*KEY, "event_date")
    out = on_panel_key(df, found).withColumn(
        occurrence_column(horizon_days), F.col("event_date").isNotNull().cast("int")
    )
    if with_severity and severity is not None:
        events = found.where(F.col("event_date").isNotNull()).select(*EVENT).distinct()
        out = out.join(
            severity(events.join(geometry, "patch_id"), severity_window_days).select(
                *EVENT, *SEVERITY_TYPES
            ),
            EVENT,
            "left",
        )
        return out.withColumn("y_sev_available", F.coalesce("y_sev_available", F.lit(0)))
    return add_columns(out, _empty_severity() | {"y_sev_available": F.lit(0)})


def label_cutoff(
    df: DataFrame, horizon_days: int, label_reference_end: date | None = None
) -> date:
    """Last reference date whose horizon is fully observed."""
    row = df.agg(F.date_sub(F.max(F.col("reference_date").cast("date")), horizon_days)).first()
    observed = row[0]
    if label_reference_end is None or observed is None:
        return observed
    return min(label_reference_end, observed)


def apply_cutoff(df: DataFrame, cutoff: date) -> DataFrame:
    return df.where(F.col("reference_date") <= F.lit(cutoff))


def drop_scaffold(df: DataFrame, with_severity: bool = True) -> DataFrame:
    """Drop columns that only served to date events; they would leak wall-clock time."""
    gone = [c for c in df.columns if c.startswith(SCAFFOLD)]
    if not with_severity:
        gone += ["label_nbr_prefire", "label_nbr_postfire"]
    return df.drop(*gone)


def materialize_labels(
    features: DataFrame,
    grid: DataFrame | None,
    horizon_days: int,
    severity_window_days: int = 30,
    stride_days: int = 7,
    label_reference_end: date | None = None,
    occurrence: Callable[[DataFrame, int], DataFrame] | None = None,
    severity: SeverityFn | None = None,
    with_severity: bool = True,
) -> DataFrame:
    """The labelled panel: label, cut off what is not fully observed, drop the scaffold."""
    day_type = features.schema["reference_date"].dataType
    if not isinstance(day_type, DateType):
        day = F.col("reference_date")
        if isinstance(day_type, StringType):
            day = F.to_timestamp(day)
        features = features.withColumn("reference_date", day.cast("date"))
    if occurrence is not None:
        cutoff = label_reference_end or features.agg(F.max("reference_date")).first()[0]
        out = label_from_extractors(
            features, grid, horizon_days, severity_window_days, occurrence, severity,
            with_severity,
        )
    else:
        cutoff = label_cutoff(features, horizon_days, label_reference_end)
        out = label_observed_events(
            features, horizon_days, severity_window_days, stride_days, severity, grid,
            with_severity,
        )
    return drop_scaffold(apply_cutoff(out, cutoff), with_severity)


def materialize_labels_from_paths(
    spark, features_path: str, grid_path: str, output_path: str, horizon_days: int, **options
) -> str:
    labelled = materialize_labels(
        spark.read.parquet(features_path), spark.read.parquet(grid_path), horizon_days, **options
    )
    labelled.write.mode("overwrite").parquet(output_path)
    return output_path


def severity_from_columns(
    df: DataFrame,
    event_day: str = "event_date",
    pre: str = "label_nbr_prefire",
    post: str = "label_nbr_postfire",
    occurrence: str | None = None,
) -> DataFrame:
    """Severity columns from stored burn ratios.

    Available means an event happened, even when a ratio is missing, and a dnbr of exactly 0 has
    no class: both differ from ``local_severity``.
    """
    if occurrence is None:
        found = [c for c in df.columns if c.startswith("y_occ_")]
        if len(found) != 1:
            raise ValueError("name the occurrence column: there is not exactly one y_occ_*")
        occurrence = found[0]
    lacking = sorted({event_day, pre, post, occurrence} - set(df.columns))
    if lacking:
        raise ValueError(f"severity labels need the columns {', '.join(lacking)}")
    burned = F.col(event_day).isNotNull() & F.coalesce(F.col(occurrence) == 1, F.lit(False))
    dnbr = clip_low(F.col(pre) - F.col(post))

    def otherwise(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    return add_columns(
        df,
        {
            "y_sev_available": burned.cast("int"),
            "y_sev_dnbr": F.when(burned, dnbr).otherwise(otherwise("y_sev_dnbr", "double")),
            "y_sev_class": F.when(burned, severity_class(dnbr, zero_is_low=False)).otherwise(
                otherwise("y_sev_class", "string")
            ),
        },
    )

"""Panel construction: reference-date spine, skeleton, source attachment, incremental builds."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType

from pyrogrid.sources.tables import absent
from pyrogrid.config import SourceConfig, TemporalConfig

log = logging.getLogger(__name__)

PANEL_KEY = ("patch_id", "reference_date")
SKELETON_COLUMNS = ("patch_id", "patch_row", "patch_col", "centroid_lon", "centroid_lat")


def by_patch(df: DataFrame) -> DataFrame:
    """``df`` partitioned by patch; frames so laid out meet on the panel key without a shuffle.

    The number of tasks is set, because rows multiply after this: sizes at the shuffle tell nothing.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, "patch_id")


def on_panel_key(panel: DataFrame, frame: DataFrame) -> DataFrame:
    """Left join on the panel key.

    Sizes are estimated before dates multiply the rows, so neither side may be broadcast by them.
    """
    return panel.join(frame.hint("merge"), list(PANEL_KEY), "left")


def spine_array(start: Column, end: Column, stride_days: int) -> Column:
    return F.sequence(start, end, F.expr(f"interval {int(stride_days)} days"))


def reference_spine(bounds: DataFrame, stride_days: int, padding_days: int = 0) -> DataFrame:
    """Explode ``reference_start`` .. ``reference_end`` (+ padding) of every row into dates.

    The padding (horizon plus event window) lets labels of the last dates be fully observed.
    """
    end = F.date_add("reference_end", padding_days)
    return bounds.select(
        *[c for c in bounds.columns if c not in ("reference_start", "reference_end")],
        F.explode(spine_array(F.col("reference_start"), end, stride_days)).alias(
            "reference_date"
        ),
    )


def reference_dates(spark: SparkSession, temporal: TemporalConfig) -> DataFrame:
    bounds = spark.range(1).select(
        F.lit(temporal.reference_start).alias("reference_start"),
        F.lit(temporal.reference_end).alias("reference_end"),
    )
    return reference_spine(bounds, temporal.reference_stride_days, temporal.padding_days)


def panel_skeleton(
    grid: DataFrame, temporal: TemporalConfig, extra: Sequence[str] = ()
) -> DataFrame:
    """Patch rows times spine dates, generated per row without a join.

    The grid, a small file, is dealt over all tasks first, or one task would generate every row.
    """
    spine = spine_array(
        F.lit(temporal.reference_start),
        F.lit(temporal.spine_end),
        temporal.reference_stride_days,
    )
    kept = [c for c in (*SKELETON_COLUMNS, *extra) if c in grid.columns]
    return by_patch(grid.select(*kept)).select("*", F.explode(spine).alias("reference_date"))


@dataclass(frozen=True)
class PanelSource:
    """A feature table to attach: how to build it and which columns it contributes."""

    build: Callable[[], DataFrame]
    columns: Sequence[str]
    static: bool = False
    types: Mapping[str, DataType] = field(default_factory=dict)


def assemble_panel(
    grid: DataFrame,
    temporal: TemporalConfig,
    registry: Mapping[str, PanelSource],
    sources: Iterable[SourceConfig],
    strict: bool = True,
) -> DataFrame:
    """Attach every enabled source to the skeleton.

    Static sources join the grid before it is multiplied by dates.  Dated sources all join on the
    panel key; those that come out partitioned by patch, as the skeleton is, need no shuffle for it.  When a source cannot be built, strict mode fails and lenient mode fills NULL columns.
    """
    static, dated, missing = [], [], []
    for config in sources:
        if not config.enabled:
            continue
        if config.name not in registry:
            raise ValueError(
                f"no source named {config.name!r}; known sources: {', '.join(sorted(registry))}"
            )
        source = registry[config.name]
        try:
            frame = source.build()
            frame.schema  # noqa: B018 - resolves the plan, so a bad table surfaces here
        except (AnalysisException, OSError, KeyError, ValueError) as error:
            if strict:
                raise RuntimeError(f"source {config.name!r} could not be built") from error
            log.warning("source %r left out: %s", config.name, error)
            missing += [
                F.lit(None).cast(source.types.get(c, DoubleType())).alias(c)
                for c in source.columns
            ]
            continue
        (static if source.static else dated).append(frame.select(
            *(PANEL_KEY[:1] if source.static else PANEL_KEY), *source.columns
        ))
    wide_grid, carried = grid, []
    for frame in static:
        wide_grid = wide_grid.join(frame, "patch_id", "left")
        carried += [c for c in frame.columns if c != "patch_id"]
    panel = panel_skeleton(wide_grid, temporal, extra=carried)
    for frame in dated:
        panel = on_panel_key(panel, frame)
    return panel.select("*", *missing) if missing else panel


def patch_slice(grid: DataFrame, index: int, count: int) -> DataFrame:
    """Disjoint slice ``index`` of ``count``; the slices of a grid add up to the grid."""
    if not 0 <= index < count:
        raise ValueError("slice index has to be within [0, count)")
    return grid.where(F.pmod(F.xxhash64("patch_id"), F.lit(count)) == index)


def build_incremental(
    grid: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    block: str = "block_id",
) -> int:
    """Build only what ``path`` does not hold yet; returns the number of patches built.

    The table is partitioned by spatial block and a block is the unit of overwrite: a block with
    any patch missing is rebuilt whole, so a crash halfway leaves nothing to clean up.
    """
    spark = grid.sparkSession
    try:
        built = spark.read.parquet(path).select("patch_id").distinct()
        open_blocks = grid.join(built, "patch_id", "left_anti").select(block).distinct()
        pending = grid.join(open_blocks, block, "left_semi")
    except AnalysisException as error:
        if not absent(error):
            raise
        pending = grid
    n = pending.count()
    if n:
        build(pending).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(block).parquet(path)
    return n


def require_patches(needed: DataFrame, grid: DataFrame) -> DataFrame:
    """Grid rows (geometry) of the needed patches; a patch the grid lacks is an error."""
    wanted = needed.select("patch_id").distinct()
    lacking = wanted.join(grid, "patch_id", "left_anti").take(1)
    if lacking:
        raise ValueError(f"the grid has no geometry for patch {lacking[0][0]!r}")
    return grid.join(wanted, "patch_id", "left_semi")

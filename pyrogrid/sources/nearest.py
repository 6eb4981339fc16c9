"""Distances from patch centroids to roads, rivers and settlements.

The nearest feature is found by narrowing cells.  Features are bound to square cells so small that
the fullest holds few of them.  A patch first meets the 3 x 3 small cells around it; what it finds
there is the nearest, or tells how far around it must look.  Patches that find nothing start with
the large cells around them and go down to the occupied cells inside, keeping those that may hold
something nearer than what some cell surely holds.  So a patch meets the features of a few small
cells, however many lie within its radius.

Sums over a radius meet all features in the 3 x 3 cells of that size.  There the patch side (one row
per patch, times nine cells) is replicated; identical geometries are collapsed first, and a cell
that holds a large share of all features is cut into parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyrogrid.functions.skew import large_keys, with_parts
from pyrogrid.session import materialise

# Kilometres per degree, search radius, density radius and the default distance.
KM_PER_DEGREE = 111.0
SEARCH_RADIUS_KM = 50.0
DENSITY_RADIUS_DEGREES = 10 / 111.0
NO_SETTLEMENT_KM = 50.0
METRES = 1000.0

# The smallest cells hold about this many features; their side is the radius halved so often at most.
CELL_FEATURES = 32
HALVINGS = 12


def point_distance(x: Column, y: Column, px: Column, py: Column) -> Column:
    return F.sqrt((x - px) * (x - px) + (y - py) * (y - py))


def segment_distance(x: Column, y: Column) -> Column:
    """Planar distance from (x, y) to the segment (x1, y1)-(x2, y2)."""
    return _segment(x, y, *map(F.col, ("x1", "y1", "x2", "y2")))


def _segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, length2), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return point_distance(x, y, x1 + t * dx, y1 + t * dy)


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def _halvings(x: Column, y: Column, features: DataFrame, size: float) -> int:
    """How often to halve the cells until the fullest one holds ``CELL_FEATURES`` at most.

    Levels go in twos.  Counts are rolled up from the smallest cells, one row per level comes back.
    """
    fine = size / 2**HALVINGS
    cells = features.groupBy(_cell(x, fine).alias("_cx"), _cell(y, fine).alias("_cy")).agg(
        F.count(F.lit(1)).alias("n")
    )
    up = F.explode(F.array(*[F.lit(k) for k in range(0, HALVINGS + 1, 2)])).alias("up")
    fullest = (
        cells.select(up, "_cx", "_cy", "n")
        .groupBy("up", F.expr("shiftright(_cx, up)").alias("_cx"), F.expr("shiftright(_cy, up)").alias("_cy"))
        .agg(F.sum("n").alias("n"))
        .groupBy("up")
        .agg(F.max("n").alias("n"))
        .collect()
    )
    return min((HALVINGS - r["up"] for r in fullest if r["n"] <= CELL_FEATURES), default=HALVINGS)


def _side(v: str, c: str, g: float) -> tuple[Column, Column]:
    """Least and largest distance along one axis from a place to a cell."""
    low, high = F.col(c) * g, (F.col(c) + 1) * g
    v = F.col(v)
    return F.greatest(low - v, v - high, F.lit(0.0)), F.greatest(F.abs(v - low), F.abs(v - high))


def _nearest(
    patches: DataFrame, features: DataFrame, ends: Sequence[str], size: float, lon: str, lat: str
) -> DataFrame:
    """``patch_id, d``: distance to the nearest point (two ``ends``) or segment (four) within ``size``.

    A segment is bound to the cells of pieces no longer than a cell; a piece may pass beside a
    cell that its bounding box touches, but no farther than one cell.
    """
    line = len(ends) == 4
    x1, y1 = F.col(ends[0]), F.col(ends[1])
    x2, y2 = (F.col(ends[2]), F.col(ends[3])) if line else (x1, y1)
    # Dealt before they are made distinct, so a task's table of them does not grow with its file.
    distinct = features.select(*ends).dropna().repartition(*ends).distinct()
    levels = _halvings((x1 + x2) / 2, (y1 + y2) / 2, distinct, size)
    fine = size / 2**levels
    if line:
        bound = _cut(distinct, ends, fine)
    else:
        bound = distinct.select(*ends, _cell(x1, fine).alias("_cx"), _cell(y1, fine).alias("_cy"))
    bound = materialise(bound, "cells")
    x, y = F.col("_x"), F.col("_y")
    distance = _segment(x, y, x1, y1, x2, y2) if line else point_distance(x, y, x1, y1)

    at = patches.select("patch_id", F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y")).dropna()
    place = ["patch_id", "_x", "_y"]

    def least(cells):
        return cells.join(bound, ["_cx", "_cy"]).groupBy(*place).agg(F.min(distance).alias("d"))

    at = materialise(at.join(least(_around(at, fine)), place, "left"), "near")
    # What lies within a cell's side of a place is bound to the 3 x 3 cells around it.
    near = F.col("d") <= fine * (1 - 1e-9)
    wider = at.where(~near).withColumn("_r", F.ceil(F.col("d") / fine))
    for c, v in (("_cx", "_x"), ("_cy", "_y")):
        own = _cell(F.col(v), fine)
        wider = wider.withColumn(c, F.explode(F.sequence(own - F.col("_r"), own + F.col("_r"))))
    (nx, _), (ny, _) = _side("_x", "_cx", fine), _side("_y", "_cy", fine)
    wider = wider.where(F.sqrt(nx * nx + ny * ny) <= F.col("d") * (1 + 1e-9)).select(*place, "_cx", "_cy")
    found = at.where(near).select("patch_id", "d").unionByName(least(wider).select("patch_id", "d"))
    others = at.where("d IS NULL").drop("d")
    if not others.isEmpty():
        found = found.unionByName(_descend(others, bound, distance, size, levels, fine if line else 0.0))
    return found.where(F.col("d") <= size).groupBy("patch_id").agg(F.min("d").alias("d"))


def _cut(segments: DataFrame, ends: Sequence[str], fine: float) -> DataFrame:
    """Segments in every cell that the bounding box of one of their pieces touches, each cell once.

    Along a segment the cells of a piece move one way on both axes, so the pieces that touch a cell
    follow one another and the first is the one whose predecessor does not touch it.
    """
    x1, y1, x2, y2 = map(F.col, ends)
    pieces = F.greatest(F.ceil(point_distance(x1, y1, x2, y2) / fine), F.lit(1))
    cut = segments.withColumn("_k", pieces).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_k"))))

    def touched(a, b, i):
        p, q = (a + (i - 1) / F.col("_k") * (b - a)), (a + i / F.col("_k") * (b - a))
        return _cell(F.least(p, q), fine), _cell(F.greatest(p, q), fine)

    i = F.col("_i")
    across = touched(x1, x2, i), touched(y1, y2, i)
    before = touched(x1, x2, i - 1), touched(y1, y2, i - 1)
    cells = cut.withColumn("_cx", F.explode(F.sequence(*across[0]))).withColumn("_cy", F.explode(F.sequence(*across[1])))
    seen = F.col("_cx").between(*before[0]) & F.col("_cy").between(*before[1])
    return cells.where((i == 1) | ~seen).select(*ends, "_cx", "_cy")


def _around(at: DataFrame, g: float) -> DataFrame:
    """Places in the 3 x 3 cells of side ``g`` around them."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return at.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).select(
        "patch_id", "_x", "_y", (_cell(F.col("_x"), g) + F.col("_dx")).alias("_cx"),
        (_cell(F.col("_y"), g) + F.col("_dy")).alias("_cy"),
    )


def _descend(
    at: DataFrame, bound: DataFrame, distance: Column, size: float, levels: int, slack: float
) -> DataFrame:
    """``patch_id, d``: distances to the features of the small cells that may hold the nearest."""
    found = None
    for level in range(0, levels + 1, 2):
        g = size / 2**level
        occupied = bound.select(
            *[F.expr(f"shiftright({c}, {levels - level})").alias(c) for c in ("_cx", "_cy")]
        ).distinct()
        if found is None:
            found = _around(at, g).join(occupied, ["_cx", "_cy"])
        else:
            inner = occupied.select(
                "_cx", "_cy", F.expr("shiftright(_cx, 2)").alias("_px"), F.expr("shiftright(_cy, 2)").alias("_py")
            )
            found = found.withColumnsRenamed({"_cx": "_px", "_cy": "_py"}).join(inner, ["_px", "_py"])
        (nx, fx), (ny, fy) = _side("_x", "_cx", g), _side("_y", "_cy", g)
        sure = F.min(F.sqrt(fx * fx + fy * fy) + slack).over(W.partitionBy("patch_id"))
        # Rounding of the cell edges must not rule a cell out.
        found = (
            found.select("patch_id", "_x", "_y", "_cx", "_cy", F.sqrt(nx * nx + ny * ny).alias("_near"), sure.alias("_sure"))
            .where((F.col("_near") <= F.col("_sure") * (1 + 1e-9)) & (F.col("_near") <= size * (1 + 1e-9)))
            .drop("_near", "_sure")
        )
    return found.join(bound, ["_cx", "_cy"]).select("patch_id", distance.alias("d"))


def _reachable(
    patches: DataFrame,
    features: DataFrame,
    low: tuple[Column, Column],
    high: tuple[Column, Column],
    identity: Sequence[str],
    size: float,
    lon: str,
    lat: str,
) -> DataFrame:
    """Patch-feature candidates in neighbouring cells, each pair exactly once.

    A feature is registered in every cell its bounding box touches.  When a pair meets in several
    cells only the lowest common one keeps it.
    """
    placed = features.select(
        "*",
        _cell(low[0], size).alias("_fx"),
        _cell(low[1], size).alias("_fy"),
        _cell(high[0], size).alias("_gx"),
        _cell(high[1], size).alias("_gy"),
    )
    placed = placed.withColumn("_cx", F.explode(F.sequence("_fx", "_gx"))).withColumn(
        "_cy", F.explode(F.sequence("_fy", "_gy"))
    )
    cell = ["_cx", "_cy"]
    px, py = _cell(F.col(lon), size), _cell(F.col(lat), size)
    around = patches.select(
        "patch_id",
        F.col(lon).alias("_x"),
        F.col(lat).alias("_y"),
        (px - 1).alias("_px"),
        (py - 1).alias("_py"),
        F.explode(F.sequence(px - 1, px + 1)).alias("_cx"),
    )
    around = around.withColumn("_cy", F.explode(F.sequence("_py", F.col("_py") + 2)))
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)
    around = around.join(F.broadcast(large_keys(placed, cell)), cell, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return with_parts(placed, cell, F.struct(*identity)).join(around, [*cell, "_part"]).where(
        (F.col("_cx") == F.greatest("_px", "_fx")) & (F.col("_cy") == F.greatest("_py", "_fy"))
    )


def nearest_road(
    patches: DataFrame,
    segments: DataFrame,
    lon: str = "centroid_lon",
    lat: str = "centroid_lat",
    radius_km: float = SEARCH_RADIUS_KM,
) -> DataFrame:
    """Distance to the nearest road segment and road length close by.

    ``segments`` has end points ``x1, y1, x2, y2`` in degrees.  Without a road within reach both
    columns are NULL.
    """
    size = radius_km / KM_PER_DEGREE
    ends = ("x1", "y1", "x2", "y2")
    nearest = _nearest(patches, segments, ends, size, lon, lat)
    distinct = segments.repartition(*ends).groupBy(*ends).agg(F.count(F.lit(1)).alias("copies"))
    low = (F.least("x1", "x2"), F.least("y1", "y2"))
    high = (F.greatest("x1", "x2"), F.greatest("y1", "y2"))
    density = min(DENSITY_RADIUS_DEGREES, size)
    d = segment_distance(F.col("_x"), F.col("_y"))
    length = point_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    close = (
        _reachable(patches, distinct, low, high, ends, density, lon, lat)
        .where((d < DENSITY_RADIUS_DEGREES) & (d <= size))
        .groupBy("patch_id")
        .agg(F.sum(length * F.col("copies")).alias("length"))
    )
    return patches.select("patch_id").join(nearest, "patch_id", "left").join(close, "patch_id", "left").select(
        "patch_id",
        (F.col("d") * KM_PER_DEGREE).alias("anthropogenic_dist_to_road_km"),
        F.when(F.col("d").isNotNull(), F.coalesce("length", F.lit(0.0)) * KM_PER_DEGREE).alias(
            "anthropogenic_road_density_km"
        ),
    )


def nearest_river(
    patches: DataFrame,
    rivers: DataFrame,
    x: str = "lon",
    y: str = "lat",
    lon: str = "centroid_lon",
    lat: str = "centroid_lat",
    radius_km: float = SEARCH_RADIUS_KM,
    to: tuple[str, str] | None = None,
) -> DataFrame:
    """Distance in metres to the nearest river; NULL without one within reach.

    Rivers are vertices ``x, y``, or with ``to`` lines from there to the columns it names.
    """
    found = _nearest(patches, rivers, (x, y, *(to or ())), radius_km / KM_PER_DEGREE, lon, lat)
    return patches.select("patch_id").join(
        found.select(
            "patch_id", (F.col("d") * KM_PER_DEGREE * METRES).alias("anthropogenic_dist_to_river_m")
        ),
        "patch_id",
        "left",
    )


def nearest_settlement(
    patches: DataFrame,
    places: DataFrame,
    x: str = "lon",
    y: str = "lat",
    kind: str = "place",
    lon: str = "centroid_lon",
    lat: str = "centroid_lat",
    radius_km: float = SEARCH_RADIUS_KM,
) -> DataFrame:
    """Distance to the nearest city, town or village; 50 km when none is within reach."""
    settled = places.where(F.col(kind).isin("city", "town", "village"))
    found = _nearest(patches, settled, (x, y), radius_km / KM_PER_DEGREE, lon, lat)
    km = F.col("d") * KM_PER_DEGREE
    return patches.select("patch_id").join(found, "patch_id", "left").select(
        "patch_id",
        F.coalesce(km, F.lit(NO_SETTLEMENT_KM)).alias("anthropogenic_dist_to_settlement_km"),
    )

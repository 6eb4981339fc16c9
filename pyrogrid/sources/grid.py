"""Spatial grid: tiling of bounding boxes and binding of points to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.config import BBox

# Kilometres per degree and the tolerance at the far edges.
KM_PER_LAT_DEGREE = 110.574
KM_PER_LON_DEGREE = 111.320
MIN_KM_PER_LON_DEGREE = 1e-6
EDGE_TOLERANCE = 1e-9


def lat_step(grid_km: float) -> float:
    return grid_km / KM_PER_LAT_DEGREE


def lon_step(grid_km: float, latitude: Column) -> Column:
    return F.lit(float(grid_km)) / F.greatest(
        F.lit(KM_PER_LON_DEGREE) * F.cos(F.radians(latitude)), F.lit(MIN_KM_PER_LON_DEGREE)
    )


def _cells(low: Column, high: Column, step: Column) -> Column:
    """How many cells of ``step`` it takes to cover [low, high); a sliver below 1e-9 is no cell."""
    return F.ceil((high - EDGE_TOLERANCE - low) / step).cast("int")


def _numbers(count: Column) -> Column:
    """0 to ``count`` - 1, or nothing; a sequence down to -1 would count backwards."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1))


def bbox_frame(spark: SparkSession, bbox: BBox) -> DataFrame:
    edges = ("lon_min", "lon_max", "lat_min", "lat_max")
    return spark.range(1).select(*[F.lit(float(getattr(bbox, e))).alias(e) for e in edges])


def patch_grid(boxes: DataFrame, grid_km: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tile every bounding box row into cells of about ``grid_km``.

    ``boxes`` has ``lon_min, lon_max, lat_min, lat_max``; ``keys`` are carried through when there
    are several boxes.  Rows are spread over the cluster before their cells are generated.
    """
    step = lat_step(grid_km)
    rows = boxes.select(
        *keys,
        "lon_min",
        "lon_max",
        "lat_min",
        "lat_max",
        F.explode(
            _numbers(_cells(F.col("lat_min"), F.col("lat_max"), F.lit(step)))
        ).alias("patch_row"),
    ).repartition(*keys, "patch_row")
    south = F.col("lat_min") + F.col("patch_row") * step
    rows = rows.select(
        *keys,
        "patch_row",
        "lon_min",
        "lon_max",
        south.alias("min_lat"),
        F.least(south + step, F.col("lat_max")).alias("max_lat"),
    ).withColumn("_step", lon_step(grid_km, (F.col("min_lat") + F.col("max_lat")) / 2))
    cells = rows.select(
        "*",
        F.explode(
            _numbers(_cells(F.col("lon_min"), F.col("lon_max"), F.col("_step")))
        ).alias("patch_col"),
    )
    west = F.col("lon_min") + F.col("patch_col") * F.col("_step")
    cells = cells.select(
        *keys,
        F.concat_ws("_", "patch_row", "patch_col").alias("patch_id"),
        "patch_row",
        "patch_col",
        west.alias("min_lon"),
        F.least(west + F.col("_step"), F.col("lon_max")).alias("max_lon"),
        "min_lat",
        "max_lat",
    )
    corners = [
        ("min_lon", "min_lat"),
        ("max_lon", "min_lat"),
        ("max_lon", "max_lat"),
        ("min_lon", "max_lat"),
        ("min_lon", "min_lat"),
    ]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", x, y) for x, y in corners])
    return cells.select(
        "*",
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("centroid_lon"),
        ((F.col("min_lat") + F.col("max_lat")) / 2).alias("centroid_lat"),
        F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("geometry_wkt"),
    )


def assign_patch(
    points: DataFrame, bbox: BBox, grid_km: float, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Bind points to cells by arithmetic: no join, no polygon test, no shuffle.

    A cell owns its southern and western edge; the outermost edges belong to the last cell.
    Points outside the box get a null ``patch_id``.
    """
    step = lat_step(grid_km)
    south, north = F.lit(float(bbox.lat_min)), F.lit(float(bbox.lat_max))
    west, east = F.lit(float(bbox.lon_min)), F.lit(float(bbox.lon_max))
    inside = F.col(lat).between(south, north) & F.col(lon).between(west, east)
    row = F.least(
        F.floor((F.col(lat) - south) / step).cast("int"),
        _cells(south, north, F.lit(step)) - 1,
    )
    low = south + F.col("patch_row") * step
    middle = (low + F.least(low + step, north)) / 2
    col = F.least(
        F.floor((F.col(lon) - west) / F.col("_step")).cast("int"),
        _cells(west, east, F.col("_step")) - 1,
    )
    return (
        points.withColumn("patch_row", F.when(inside, row))
        .withColumn("_step", lon_step(grid_km, middle))
        .withColumn("patch_col", F.when(inside, col))
        .withColumn(
            "patch_id", F.when(inside, F.concat_ws("_", "patch_row", "patch_col"))
        )
        .drop("_step")
    )

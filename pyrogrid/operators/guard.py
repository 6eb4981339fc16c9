"""Schema-level predicates: which columns a model may see."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

# Feature namespaces, and name parts that mark labels, keys and split columns.
ALLOWED_PREFIXES = (
    "weather_",
    "optical_",
    "terrain_",
    "temporal_",
    "landcover_",
    "anthropogenic_",
    "peat_",
    "human_",
)
FORBIDDEN_PATTERNS = (
    "y_occ_",
    "y_sev_",
    "y_sev_available",
    "dnbr",
    "delta_nbr",
    "prefire",
    "postfire",
    "viirs_future_",
    "label_window_",
    "event_date",
    "reference_date",
    "patch_id",
    "split",
    "block_id",
    "patch_row",
    "patch_col",
    "centroid_lat",
    "centroid_lon",
)


class LeakageError(ValueError):
    """A feature list contains something a model must not see."""


def check_features(columns: Sequence[str]) -> None:
    for name in columns:
        hit = next((p for p in FORBIDDEN_PATTERNS if p in name.lower()), None)
        if hit:
            raise LeakageError(f"feature {name!r} contains the reserved part {hit!r}")
        if not name.startswith(ALLOWED_PREFIXES):
            raise LeakageError(f"feature {name!r} belongs to no known namespace")


def feature_columns(df: DataFrame) -> list[str]:
    """Columns in a feature namespace; fails when one of them carries a reserved part."""
    names = [c for c in df.columns if c.startswith(ALLOWED_PREFIXES)]
    check_features(names)
    return names


def guarded_projection(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *feature_columns(df))


def within_window(columns: Sequence[str], max_window: int) -> list[str]:
    """Drop features looking back more than ``max_window`` days; names without a window stay."""
    def window(name: str) -> int | None:
        found = re.fullmatch(r".*_l(\d+)d+", name)
        return int(found.group(1)) if found else None

    return [c for c in columns if window(c) is None or window(c) <= max_window]


def max_window_projection(df: DataFrame, max_window: int) -> DataFrame:
    features = feature_columns(df)
    dropped = set(features) - set(within_window(features, max_window))
    return df.select(*[c for c in df.columns if c not in dropped])


def features_by_namespace(columns: Sequence[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in columns:
        out.setdefault(name.split("_", 1)[0], []).append(name)
    return out

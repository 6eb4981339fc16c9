"""All registered queries."""

from pyrogrid.plans import (
    queries_evaluation,
    queries_models,
    queries_panel,
    queries_sources,
)
from pyrogrid.plans.registry import REGISTRY

__all__ = [
    "REGISTRY",
    "queries_evaluation",
    "queries_models",
    "queries_panel",
    "queries_sources",
]

"""Typed parameters of an experiment, checked on construction."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import date, timedelta

MODEL_TASKS = ("classification", "regression")
# Which model task an experiment task needs; risk pairs a classifier with a severity regressor.
TASK_MODEL = {"occurrence": "classification", "severity": "regression", "risk": "classification"}
SEVERITY_FAMILIES = ("xgboost", "random_forest", "logreg")


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class BBox:
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float

    def __post_init__(self):
        _require(self.lon_min < self.lon_max, "the western edge has to lie west of the eastern edge")
        _require(self.lat_min < self.lat_max, "the southern edge has to lie south of the northern edge")


@dataclass(frozen=True)
class GridConfig:
    grid_km: int
    bbox: BBox

    def __post_init__(self):
        _require(self.grid_km >= 1, "grid_km must be >= 1")


@dataclass(frozen=True)
class TemporalConfig:
    reference_start: date
    reference_end: date
    reference_stride_days: int
    lookback_days: int
    temporal_windows: tuple[int, ...]
    horizon_days: int

    def __post_init__(self):
        windows = tuple(self.temporal_windows)
        object.__setattr__(self, "temporal_windows", windows)
        for name in ("reference_stride_days", "lookback_days", "horizon_days"):
            _require(getattr(self, name) >= 1, f"{name} must be >= 1")
        _require(bool(windows), "give at least one look-back window")
        _require(all(w > 0 for w in windows), "look-back windows are positive day counts")
        _require(
            list(windows) == sorted(set(windows)),
            "look-back windows have to be distinct and ascending",
        )
        _require(
            self.reference_start <= self.reference_end,
            "the reference period ends before it starts",
        )
        _require(
            windows[-1] <= self.lookback_days, "the longest window reaches beyond the lookback"
        )
        _require(
            windows[-1] >= self.reference_stride_days,
            "no window spans a whole stride, so events between reference dates would go unseen",
        )

    @property
    def event_window_days(self) -> int:
        """Smallest look-back window that leaves no day between two reference dates unseen."""
        return next(w for w in self.temporal_windows if w >= self.reference_stride_days)

    @property
    def padding_days(self) -> int:
        return self.horizon_days + self.event_window_days

    @property
    def spine_end(self) -> date:
        """Last day a reference date may fall on so that every label is fully observed."""
        return self.reference_end + timedelta(days=self.padding_days)

    @property
    def n_reference_dates(self) -> int:
        return (self.spine_end - self.reference_start).days // self.reference_stride_days + 1


@dataclass(frozen=True)
class SplitConfig:
    buffer_days: int
    train_end: date
    val_end: date
    test_end: date

    def __post_init__(self):
        _require(self.buffer_days >= 0, "a buffer is not negative")
        _require(
            self.train_end < self.val_end < self.test_end,
            "train, val and test have to end in that order",
        )


@dataclass(frozen=True)
class SpatialBlockConfig:
    block_size_km: int
    n_folds: int
    seed: int = 42

    def __post_init__(self):
        _require(self.block_size_km >= 1, "block_size_km must be >= 1")
        _require(self.n_folds >= 2, "n_folds must be >= 2")


@dataclass(frozen=True)
class SourceConfig:
    name: str
    enabled: bool = True
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class DataConfig:
    grid: GridConfig
    temporal: TemporalConfig
    split: SplitConfig
    spatial_blocks: SpatialBlockConfig | None = None
    sources: tuple[SourceConfig, ...] = ()

    def __post_init__(self):
        _require(
            self.split.buffer_days >= self.temporal.horizon_days,
            "a purge buffer shorter than the label horizon leaks labels",
        )

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class ModelConfig:
    name: str
    task: str
    params: dict = field(default_factory=dict)
    severity_name: str | None = None
    severity_params: dict = field(default_factory=dict)

    def __post_init__(self):
        _require(self.task in MODEL_TASKS, f"task must be one of {sorted(MODEL_TASKS)}")


@dataclass(frozen=True)
class ExperimentConfig:
    name: str
    task: str
    data: DataConfig
    model: ModelConfig
    bootstrap_samples: int = 1000
    confidence_level: float = 0.95

    def __post_init__(self):
        _require(
            self.task in TASK_MODEL, f"experiment task must be one of {sorted(TASK_MODEL)}"
        )
        _require(
            self.model.task == TASK_MODEL[self.task],
            f"{self.task} experiments require model.task == '{TASK_MODEL[self.task]}'",
        )
        if self.task == "risk":
            _require(
                (self.model.severity_name or self.model.name) in SEVERITY_FAMILIES,
                f"risk needs a severity family among {sorted(SEVERITY_FAMILIES)}",
            )
        _require(self.bootstrap_samples >= 0, "bootstrap_samples must be >= 0")
        _require(0.0 < self.confidence_level < 1.0, "confidence_level must be within (0, 1)")

    @property
    def target_column(self) -> str:
        if self.task == "risk":
            raise ValueError("risk is derived from occurrence and severity, not trained directly")
        return (
            "y_sev_dnbr"
            if self.task == "severity"
            else f"y_occ_{self.data.temporal.horizon_days}d"
        )

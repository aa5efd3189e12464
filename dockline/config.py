"""One place for the grid, feature, split and endpoint parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
import os


@dataclass(frozen=True)
class GridSpec:
    """Everything counted in steps, so the bin size stays a parameter."""

    step: int = 300
    lags: tuple[int, ...] = (1, 2, 3)
    roll: int = 6
    fill_limit: int = 2
    horizons: tuple[int, ...] = (3, 6, 12, 24)
    embargo: int = 24
    test_fraction: float = 0.2
    sequence: int = 12

    def __post_init__(self) -> None:
        if self.embargo < max(self.horizons):
            raise ValueError("the embargo must cover the longest horizon")

    @property
    def minutes(self) -> int:
        return self.step // 60

    @property
    def feature_columns(self) -> list[str]:
        return ["bikes", "docks", "capacity", "fill_ratio", *(f"bikes_lag{n * self.minutes}" for n in self.lags),
                f"bikes_roll_mean{self.roll * self.minutes}", f"bikes_roll_std{self.roll * self.minutes}", "hour_utc", "dow", "is_weekend"]

    @property
    def target_columns(self) -> list[str]:
        return [f"target_{n * self.minutes}" for n in self.horizons]


@dataclass(frozen=True)
class Endpoints:
    """Addresses of the outside world; every one is a parameter with an environment default."""

    kafka: str = field(default_factory=lambda: os.environ.get("DOCKLINE_KAFKA", "localhost:9092"))
    topic: str = field(default_factory=lambda: os.environ.get("DOCKLINE_TOPIC", "stations.raw"))
    jdbc_url: str = field(default_factory=lambda: os.environ.get("DOCKLINE_JDBC", ""))
    history: str = field(default_factory=lambda: os.environ.get("DOCKLINE_HISTORY", "history/stations"))
    checkpoints: str = field(default_factory=lambda: os.environ.get("DOCKLINE_CHECKPOINTS", "checkpoints"))

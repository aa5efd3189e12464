"""What a client can ask, as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.operators.forecast import Persistence


def health(spark: SparkSession, probe=None) -> dict[str, str]:
    """``ok``/``up``, or ``degraded``/``down`` if the probe (by default a trivial query) fails."""
    try:
        ok = bool(probe() if probe else spark.range(1).count() == 1)
    except Exception:
        ok = False
    return {"status": "ok" if ok else "degraded", "database": "up" if ok else "down"}


def stations(state: DataFrame) -> DataFrame:
    return state.select(
        "station_id", "station_code", "window_end", F.col("avg_bikes_available").alias("bikes_available"), F.col("avg_docks_available").alias("docks_available"), "n_observations", "updated_at").orderBy("station_id")


def station(state: DataFrame, station_id: int) -> DataFrame:
    """One row or none; the id is a literal, so it reaches the scan as a pushed filter."""
    return stations(state.where(F.col("station_id") == F.lit(station_id)))


def forecast(state: DataFrame, station_id: int) -> DataFrame:
    rows = station(state, station_id).select("station_id", F.col("bikes_available").alias("bikes_now"))
    return Persistence(now="bikes_now").predict(rows)


class Served:
    """Latest rows and models held for many lookups: read once, again after :meth:`refresh`."""

    def __init__(self, read_latest: Callable[[], DataFrame], load_models: Callable[[], dict[str, object]]):
        self.read_latest, self.load_models = read_latest, load_models
        self._latest: DataFrame | None = None
        self._models: dict[str, object] = {}

    def refresh(self) -> None:
        if self._latest is not None:
            self._latest.unpersist()
        self._latest, self._models = self.read_latest().persist(), self.load_models()

    def forecast(self, station_id: int) -> DataFrame:
        if self._latest is None:
            self.refresh()
        return model_forecast(self._latest, station_id, self._models)


def model_forecast(latest: DataFrame, station_id: int, models: dict[str, object]) -> DataFrame:
    """(station_id, as_of, bikes_ref, one column per horizon, method) from the latest feature row; no row if it is unknown."""
    rows = latest.where(F.col("station_id") == F.lit(station_id))
    for m in models.values():
        rows = m.predict(rows)
    preds = [F.round(f"pred_{m.target}", 1).alias(name) for name, m in models.items()]
    return rows.select("station_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("as_of"), F.round("bikes", 1).alias("bikes_ref"), *preds, F.lit(next(iter(models.values())).method if models else "none").alias("method"))

"""The keyed current state: newest window per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(windows: DataFrame) -> DataFrame:
    """One row per station: its newest window, the larger code on a tie. Partial aggregation, no sort."""
    rest = [c for c in windows.columns if c != "station_id"]
    order = F.struct("window_start", F.col("station_code").isNotNull(), F.coalesce("station_code", F.lit("")))
    return windows.groupBy("station_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("station_id", "r.*")


def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Current state after a batch of windows: newest wins, an older window never replaces a newer one, an equal one does."""
    rest = [c for c in current.columns if c != "station_id"]
    both = current.withColumn("__side", F.lit(0)).unionByName(newest(batch).select(*current.columns).withColumn("__side", F.lit(1)))
    return both.groupBy("station_id").agg(F.max_by(F.struct(*rest), F.struct("window_start", "__side")).alias("r")).select("station_id", "r.*")

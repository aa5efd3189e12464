"""Chronological split and forecast metrics, all horizons in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.config import GridSpec
from dockline.functions import clip, gain


def by_horizon(rows: DataFrame, spec: GridSpec) -> DataFrame:
    """One row per station, time and horizon with an observed target ``y``."""
    keep = [c for c in rows.columns if c not in spec.target_columns]
    return rows.unpivot(keep, spec.target_columns, "horizon", "y").where("y is not null")


def cuts(long_rows: DataFrame, spec: GridSpec) -> DataFrame:
    """(horizon, cut): the interpolated quantile of times; a horizon's rows are first counted per time."""
    counts = long_rows.groupBy("horizon", "epoch").agg(F.count("*").alias("k"))
    return counts.groupBy("horizon").agg(F.percentile("epoch", F.lit(1 - spec.test_fraction), F.col("k")).alias("cut"))


def split(long_rows: DataFrame, spec: GridSpec) -> DataFrame:
    """Adds ``part``: train up to the cut less the embargo, test after the cut, the band between dropped. One row per horizon is broadcast."""
    gap = spec.embargo * spec.step
    part = F.when(F.col("epoch") <= F.col("cut") - gap, "train").when(F.col("epoch") > F.col("cut"), "test")
    return long_rows.join(F.broadcast(cuts(long_rows, spec)), "horizon").withColumn("part", part).where("part is not null")


def errors(rows: DataFrame, y: str, prediction: str, *keys: str) -> DataFrame:
    e = F.col(y) - F.col(prediction)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def moved_errors(rows: DataFrame, y: str, prediction: str, now: str, *keys: str) -> DataFrame:
    """Errors over rows that moved by at least one, and their share."""
    e, moved = F.abs(F.col(y) - F.col(prediction)), F.abs(F.col(y) - F.col(now)) >= 1
    return rows.groupBy(*keys).agg(F.count_if(moved).alias("n_moved"), F.avg(moved.cast("int")).alias("share_moved"), F.avg(F.when(moved, e)).alias("mae_moved"))


def lift(base: DataFrame, model: DataFrame, *keys: str) -> DataFrame:
    """Gain in per cent of ``model`` over ``base`` by MAE and RMSE."""
    b, m = base.select(*keys, F.col("mae").alias("mae_base"), F.col("rmse").alias("rmse_base")), model.select(*keys, F.col("mae").alias("mae_model"), F.col("rmse").alias("rmse_model"))
    return b.join(m, list(keys)).withColumn("gain_mae", gain(F.col("mae_base"), F.col("mae_model"))).withColumn("gain_rmse", gain(F.col("rmse_base"), F.col("rmse_model")))


def reconstruct(now, delta, capacity):
    """now + delta bounded to [0, capacity]."""
    return clip(now + delta, F.lit(0.0), capacity)

"""Dense grid, leakage-free features and shifted targets.

One row per station and step, so a window holds a station's timeline and no
more. Features read the filled series up to the row, targets the raw series
after it; targets are never filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockline.config import GridSpec
from dockline.functions import bin_start, epoch_ntz, monday_zero, ratio
from dockline.operators.regular_grid import explode_cells


def latest_per_bin(measures: DataFrame, step: int) -> DataFrame:
    """The freshest measure of each (station, bin); ties go to the later report, then the larger counts."""
    order = F.struct("ingested_at", F.coalesce("last_reported", F.lit(-1)), F.coalesce("num_bikes_available", F.lit(-1)), F.coalesce("num_docks_available", F.lit(-1)), F.coalesce("station_code", F.lit("")))
    return (
        measures.where("station_id is not null and ingested_at is not null")
        .groupBy("station_id", bin_start(F.col("ingested_at"), step).alias("bin_epoch"))
        .agg(F.max_by(F.struct("station_code", "num_bikes_available", "num_docks_available"), order).alias("r"))
        .select("station_id", F.col("r.station_code").alias("station_code"), "bin_epoch", epoch_ntz(F.col("bin_epoch")).alias("ts"), F.col("r.num_bikes_available").alias("bikes"), F.col("r.num_docks_available").alias("docks"))
    )


def dense(grid: DataFrame, spec: GridSpec) -> DataFrame:
    """Every step from a station's first to its last, NULL where nothing was observed; repeated rows count once."""
    once = grid.where("station_id is not null and bin_epoch is not null").groupBy("station_id", "bin_epoch").agg(F.max(F.struct("bikes", "docks")).alias("r"))
    # each row opens into itself and the steps up to the next one: no spine to make and join
    following = F.coalesce(F.lead("bin_epoch").over(_timeline()) - spec.step, F.col("bin_epoch"))
    opened = explode_cells(once.withColumn("own", F.col("bin_epoch")).withColumn("upto", F.greatest(following, F.col("bin_epoch"))), "own", "upto", spec.step, "bin_epoch")
    seen = F.col("bin_epoch") == F.col("own")
    return opened.select("station_id", "bin_epoch", F.when(seen, F.col("r.bikes")).alias("bikes_raw"), F.when(seen, F.col("r.docks")).alias("docks_raw"))


def _timeline():
    return Window.partitionBy("station_id").orderBy("bin_epoch")


def filled(dense_rows: DataFrame, spec: GridSpec) -> DataFrame:
    """Adds ``bikes`` and ``docks``: the last observation at most ``fill_limit`` steps old, each column by itself."""
    w = _timeline().rowsBetween(-spec.fill_limit, 0)
    return dense_rows.withColumns({c: F.last(f"{c}_raw", ignorenulls=True).over(w).cast("double") for c in ("bikes", "docks")})


def features(dense_rows: DataFrame, spec: GridSpec) -> DataFrame:
    """All features and targets, before incomplete rows are dropped. Every window shares one partitioning and order."""
    w, m = _timeline(), spec.minutes
    roll = w.rowsBetween(-(spec.roll - 1), 0)
    full = F.count("bikes").over(roll) == spec.roll
    ts = epoch_ntz(F.col("bin_epoch"))
    return (
        filled(dense_rows, spec)
        .withColumns({
            "ts": ts, "capacity": F.col("bikes") + F.col("docks"),
            **{f"bikes_lag{n * m}": F.lag("bikes", n).over(w) for n in spec.lags},
            f"bikes_roll_mean{spec.roll * m}": F.when(full, F.avg("bikes").over(roll)),
            f"bikes_roll_std{spec.roll * m}": F.when(full, F.stddev_samp("bikes").over(roll)),
            **{f"target_{n * m}": F.lead("bikes_raw", n).over(w).cast("double") for n in spec.horizons}})
        .withColumns({"fill_ratio": ratio(F.col("bikes"), F.col("capacity")), "hour_utc": F.hour("ts"), "dow": monday_zero(F.col("ts"))})
        .withColumn("is_weekend", (F.col("dow") >= 5).cast("int"))
        .select("station_id", "ts", *spec.feature_columns, *spec.target_columns)
    )


def dataset(grid: DataFrame, spec: GridSpec = GridSpec()) -> DataFrame:
    """Rows with all features and at least one observed target."""
    return features(dense(grid, spec), spec).na.drop(subset=spec.feature_columns).where(F.coalesce(*spec.target_columns).isNotNull())

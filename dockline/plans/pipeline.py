"""The batch chain: messages to measures to grid to dataset to scores, one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.config import GridSpec
from dockline.operators import clean, evaluate, features


def measures(messages: DataFrame) -> DataFrame:
    return clean.to_measures(clean.parse(messages).withColumnRenamed("stationCode", "station_code"))


def grid(measure_rows: DataFrame, spec: GridSpec = GridSpec()) -> DataFrame:
    return features.latest_per_bin(measure_rows, spec.step)


def dataset(grid_rows: DataFrame, spec: GridSpec = GridSpec()) -> DataFrame:
    return features.dataset(grid_rows, spec)


def write_dataset(rows: DataFrame, path: str) -> None:
    """The dataset in order of time, then station: sorted by range, so that no task sorts it all."""
    rows.orderBy("ts", "station_id").write.mode("overwrite").parquet(path)


def persistence_scores(rows: DataFrame, spec: GridSpec = GridSpec()) -> DataFrame:
    """Errors of the current value as forecast, per horizon, on the test part."""
    long_rows = evaluate.by_horizon(rows.withColumn("epoch", F.unix_timestamp("ts")), spec)
    return evaluate.errors(evaluate.split(long_rows, spec).where("part = 'test'"), "y", "bikes", "horizon")

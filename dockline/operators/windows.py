"""Tumbling availability windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.operators.panes import partial_sums
from dockline.schemas import WINDOWED


def availability(rows: DataFrame, duration: str = "5 minutes") -> DataFrame:
    """Average bikes and docks (one decimal, half up) and rows per station, code and window; NULL counts are left out of averages only."""
    sums = partial_sums(["num_bikes_available", "num_docks_available"])
    panes = rows.groupBy(F.window("event_time", duration).alias("w"), "station_id", "station_code").agg(*sums)
    means = {f"avg_{v}": F.round(F.try_divide(f"sum_num_{v}", f"n_num_{v}"), 1) for v in ("bikes_available", "docks_available")}
    return panes.withColumns(means).select("w.start", "w.end", "station_id", "station_code", *means, "n").toDF(*WINDOWED.fieldNames())

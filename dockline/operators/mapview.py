"""Map join, fill and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.functions import fill_colour, map_fill


def reference(info: DataFrame) -> DataFrame:
    """One row per station id; of several the one with the largest name (a file gives no order)."""
    rest = [c for c in info.columns if c != "station_id"]
    return info.where("station_id is not null").groupBy("station_id").agg(F.max_by(F.struct(*rest), F.coalesce("name", F.lit(""))).alias("r")).select("station_id", "r.*")


def map_rows(state: DataFrame, info: DataFrame) -> DataFrame:
    """Stations that can be drawn. The reference side is left to the optimizer: broadcast while it is small, by hash beyond."""
    joined = state.join(reference(info).where("lat is not null"), "station_id")
    fill = map_fill(F.col("bikes_available"), F.col("capacity"))
    return joined.select(
        "station_id", "name", "station_code", F.coalesce("bikes_available", F.lit(0.0)).alias("bikes_available"), "docks_available",
        F.coalesce("capacity", F.lit(0)).alias("capacity"), "lat", "lon", F.round(fill, 2).alias("fill_ratio"), fill_colour(fill).alias("color"))


def figure_rows(state: DataFrame, info: DataFrame) -> DataFrame:
    """Variant for the figure: stations without capacity are left out as well."""
    joined = state.join(reference(info).where("lat is not null and capacity > 0"), "station_id")
    return joined.select("station_id", "lat", "lon", map_fill(F.col("bikes_available"), F.col("capacity")).alias("fill"))


def key_figures(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_stations"), F.coalesce(F.sum("bikes_available"), F.lit(0)).cast("long").alias("bikes"),
        F.coalesce(F.sum("docks_available"), F.lit(0)).cast("long").alias("docks"), F.count_if(F.col("bikes_available") == 0).alias("n_empty"))


def labels(rows: DataFrame) -> DataFrame:
    return rows.select("station_id", F.concat("name", F.lit("  ("), F.coalesce("station_code", F.lit("")), F.lit(")")).alias("label")).orderBy("label", "station_id")


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of ``left`` the other side has."""
    a, b = left.where(F.col(key).isNotNull()).select(key).distinct(), right.select(key).distinct().withColumn("hit", F.lit(1))
    return a.join(b, key, "left").agg(F.count("*").alias("n_keys"), F.count("hit").alias("n_matched"), (F.count("*") - F.count("hit")).alias("n_unmatched"))

"""Contiguous runs and fixed-length sequences of feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockline.config import GridSpec


def contiguous(rows: DataFrame, spec: GridSpec) -> DataFrame:
    """Adds ``run_len``: rows so far in the stretch of exactly ``step``-second steps that ends here."""
    w = Window.partitionBy("station_id").orderBy("epoch")
    breaks = F.coalesce((F.expr("(epoch - lag_epoch) div 60") != spec.minutes).cast("int"), F.lit(1))
    return (
        rows.withColumn("lag_epoch", F.lag("epoch").over(w)).withColumn("island", F.sum(breaks).over(w))
        .withColumn("run_len", F.row_number().over(Window.partitionBy("station_id", "island").orderBy("epoch"))).drop("lag_epoch")
    )


def sequences(rows: DataFrame, target: str, spec: GridSpec) -> DataFrame:
    """(station_id, epoch, steps, y_delta, bikes, capacity) of rows that end ``sequence`` contiguous steps and have the target."""
    w = Window.partitionBy("station_id").orderBy("epoch").rowsBetween(-(spec.sequence - 1), 0)
    steps = F.collect_list(F.struct(*spec.feature_columns)).over(w)
    return (
        contiguous(rows, spec).withColumn("steps", steps).where((F.col("run_len") >= spec.sequence) & F.col(target).isNotNull())
        .select("station_id", "epoch", "steps", (F.col(target) - F.col("bikes")).alias("y_delta"), "bikes", "capacity")
    )


def scaler(seqs: DataFrame, spec: GridSpec) -> DataFrame:
    """(feature, mean, std): over all steps of all sequences, so a row weighs as often as it is used; population deviation."""
    flat = seqs.select(F.explode("steps").alias("s")).select(*[F.col(f"s.{c}").cast("double").alias(c) for c in spec.feature_columns])
    return flat.unpivot([], spec.feature_columns, "feature", "x").groupBy("feature").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-6).alias("std"))


def systematic_sample(ids: DataFrame, column: str, n: int) -> DataFrame:
    """``n`` of the distinct ids, evenly spread over their order; all if there are fewer.

    Ids are ranked by range partition: a count per partition and a row number
    inside it, so no single task sorts them all.
    """
    once = ids.where(F.col(column).isNotNull()).select(F.col(column).alias("id")).distinct()
    parts = once.repartitionByRange("id").withColumn("part", F.spark_partition_id())
    sizes = parts.groupBy("part").agg(F.count("*").alias("k"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("total", F.sum("k").over(Window.partitionBy(F.lit(0))))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("id"))).join(offsets, "part").withColumn("pos", F.col("offset") + F.col("r") - 1)
    # position p is taken if some i in 0..n-1 has i * (total - 1) div (n - 1) = p
    span = F.greatest(F.col("total") - 1, F.lit(1))
    i = F.ceil(F.col("pos") * (n - 1) / span)
    taken = (i < n) & (F.floor(i * (F.col("total") - 1) / (n - 1)) == F.col("pos")) if n > 1 else F.col("pos") == 0
    return ranked.where((F.col("total") <= n) | taken).select(F.col("id").alias(column))

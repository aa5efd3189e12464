"""Profiles of a history: volume, coverage, gaps. Each is one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.operators.ordering import lagged

ACCURACY = 1_000_000


def duplication(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Total and distinct rows and their ratio (0 for no rows). Rows are first reduced per key, then summed."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("distinct_rows")).withColumn("factor", F.coalesce(F.try_divide("total_rows", "distinct_rows"), F.lit(0.0)))


def coverage(rows: DataFrame, entity: str, epoch: str) -> DataFrame:
    return rows.agg(
        F.min(epoch).alias("first_epoch"), F.max(epoch).alias("last_epoch"), F.countDistinct(F.expr(f"{epoch} div 86400")).alias("n_days"), F.countDistinct(entity).alias("n_entities"))


def entity_counts(rows: DataFrame, entity: str) -> DataFrame:
    return rows.groupBy(entity).agg(F.count("*").alias("n_rows"))


def distribution(values: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    return values.agg(
        F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"),
        *[F.percentile_approx(column, q, ACCURACY).alias(name) for name, q in points.items()])


def gaps(rows: DataFrame, entity: str, epoch: str) -> DataFrame:
    """(entity, epoch, gap): seconds since the entity's report time before, first ones left out; equal times are one."""
    once = rows.where(F.col(entity).isNotNull() & F.col(epoch).isNotNull()).select(entity, epoch).distinct().withColumn("day", F.expr(f"{epoch} div 86400"))
    return lagged(once, [entity], "day", epoch, [epoch]).where("prev is not null").select(entity, epoch, (F.col(epoch) - F.col(f"prev.{epoch}")).alias("gap_s"))


def big_gap_share(gap_rows: DataFrame, limit: int = 900) -> DataFrame:
    """Per cent of gaps longer than ``limit`` seconds; 0 if there are none."""
    return gap_rows.agg(F.count("*").alias("n_gaps"), F.count_if(F.col("gap_s") > limit).alias("n_big")).withColumn("share", F.coalesce(F.try_divide(100 * F.col("n_big"), F.col("n_gaps")), F.lit(0.0)))

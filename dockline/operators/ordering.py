"""Order-dependent work over one entity without giving a hot entity to one task.

An entity's rows are numbered in two levels (a count per coarse bucket of the
order column, then a row number inside the bucket), and cut into chunks of a
fixed number of rows. Windows then run per (entity, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column, per_bucket: DataFrame | None = None, carry: list[str] = ()) -> DataFrame:
    """Add ``rank`` (0, 1, ...) per ``keys`` in the order of ``order``.

    ``bucket`` must rise with the first order column. ``per_bucket`` may hold one
    row per ``keys`` with ``carry`` columns to take along.
    """
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    if per_bucket is not None:
        offsets = offsets.join(per_bucket, keys, "left")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return (
        rows.withColumn("__rn", F.row_number().over(inside))
        .join(offsets, [*keys, "__bucket"])
        .withColumn("rank", F.col("__offset") + F.col("__rn") - 1)
        .drop("__rn", "__offset", "__bucket")
    )


def with_halo(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Give each ranked row its ``chunk`` of ``size`` rows, and repeat rows near a border
    in the neighbouring chunk; ``own`` tells a chunk's own rows from the borrowed ones."""
    home, place = F.expr(f"rank div {size}"), F.col("rank") % size
    others = F.array_compact(F.array(
        home,
        F.when((place < halo) & (home > 0), home - 1),
        F.when(place >= size - halo, home + 1),
    ))
    return df.withColumn("__home", home).withColumn("chunk", F.explode(others)).withColumn("own", F.col("chunk") == F.col("__home")).drop("__home")


def lagged(df: DataFrame, keys: list[str], chunk: str, order: str, carry: list[str]) -> DataFrame:
    """Add ``prev``, a struct of ``carry`` of the row before in ``order`` (unique per ``keys``).

    The lag runs per (keys, chunk); a chunk's first row gets the last row of the
    chunk before it through a small table of chunk ends.
    """
    payload = F.struct(*carry)
    inner = Window.partitionBy(*keys, chunk).orderBy(order)
    ends = df.groupBy(*keys, chunk).agg(F.max_by(payload, F.col(order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(chunk)
    ends = ends.withColumn("__carry", F.lag("__last").over(across)).drop("__last")
    return (
        df.withColumn("__prev", F.lag(payload).over(inner))
        .join(ends, [*keys, chunk], "left")
        .withColumn("prev", F.coalesce("__prev", "__carry"))
        .drop("__prev", "__carry")
    )

"""Rolling totals over trailing periods.

Both forms use RANGE frames over integer step or day numbers on sparse rows, so
a period without rows takes part with its number rather than as a row, and the
denominators are fixed.

Defined results: rows without entity, time or value take no part; repeated rows
count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockline.session import shuffle_partitions

#: Steps of a calendar block.
_CALENDAR = 4096


def filled_steps(df: DataFrame, entity: str, time: str, value: str, step: int, fill_limit: int) -> DataFrame:
    """(entity, step_no, value): each step with the value of the freshest row at most ``fill_limit`` steps before.

    Every row stands for its own step and the ``fill_limit`` after it; the
    youngest claim on a step wins. One hash aggregation, no window. Of several
    rows of one step the smallest value counts (rows are expected to be equal).
    """
    base = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        F.col(entity).alias("entity"), F.expr(f"cast(`{time}` as bigint) div {step}").alias("s"), F.col(value).cast("long").alias("v"))
    claims = base.withColumn("age", F.explode(F.array(*[F.lit(i) for i in range(fill_limit + 1)])))
    return (
        claims.groupBy("entity", (F.col("s") + F.col("age")).alias("step_no"))
        .agg(F.min(F.struct("age", "v")).alias("m"))
        .select("entity", "step_no", F.col("m.v").alias("value"), (F.col("m.age") > 0).alias("is_filled"))
    )


def rolling_steps(filled: DataFrame, width: int, block: int = 288) -> DataFrame:
    """(entity, step_no, value, is_filled, mean, std): over ``width`` steps ending at the step, NULL unless all are known.

    Steps are cut into blocks of ``block``, or of ``width`` if that is more; a
    step is also given to every later block whose windows reach back to it, so
    no entity is one task, whatever the width. Sums are of integers, so mean and
    sample deviation carry no accumulated error. A width of 1 has no deviation.
    """
    if width < 1:
        raise ValueError("a window has at least one step")
    block = max(block, width)
    in_block = lambda n: ((n - F.pmod(n, F.lit(block))) / block).cast("bigint")
    spread = filled.withColumn("home", in_block(F.col("step_no"))).withColumn("blk", F.explode(F.sequence(F.col("home"), in_block(F.col("step_no") + (width - 1)))))
    w = Window.partitionBy("entity", "blk").orderBy("step_no").rangeBetween(-(width - 1), 0)
    v = F.col("value")
    return (
        spread.select("entity", "step_no", "home", "blk", "value", "is_filled", F.count("*").over(w).alias("n"), F.sum(v).over(w).alias("s"), F.sum(v * v).over(w).alias("q"))
        .where(F.col("home") == F.col("blk"))
        .select(
            "entity", "step_no", "value", "is_filled",
            F.when(F.col("n") == width, F.col("s") / width).alias("mean"),
            F.when((F.col("n") == width) & (width > 1), F.sqrt((F.col("q") * width - F.col("s") * F.col("s")) / max(width * (width - 1), 1))).alias("std"))
    )


def every_step(rolled: DataFrame) -> DataFrame:
    """``rolled`` with a calendar row for each step between an entity's first and last row; unknown values are NULL.

    Claims beyond the last row are left out. The calendar is made from two numbers
    per entity, in blocks that are dealt out before they are opened, and joined
    by hash on (entity, step).
    """
    own = rolled.where("not is_filled").groupBy("entity").agg(F.min("step_no").alias("a"), F.max("step_no").alias("z"))
    # a block opens into thousands of rows: by its size alone the next exchange would be one task
    blocks = own.select("entity", "z", F.explode(F.sequence("a", "z", F.lit(_CALENDAR).cast("bigint"))).alias("a")).repartition(shuffle_partitions(rolled.sparkSession), "entity", "a")
    calendar = blocks.select("entity", F.explode(F.sequence("a", F.least("z", F.col("a") + (_CALENDAR - 1)))).alias("step_no"))
    return calendar.join(rolled, ["entity", "step_no"], "left").withColumn("is_filled", F.coalesce("is_filled", F.lit(False)))


def wrong_features(stored: DataFrame, entity: str, time: str, mean: str, std: str, rolled: DataFrame, step: int, tolerance: float) -> DataFrame:
    """(entity, step_no) of stored rows whose mean or deviation is off by more than ``tolerance``.

    A stored row of a step without a full window has nothing to differ from.
    """
    s = stored.select(F.col(entity).alias("entity"), F.expr(f"cast(`{time}` as bigint) div {step}").alias("step_no"), F.col(mean).alias("have_mean"), F.col(std).alias("have_std"))
    off = (F.abs(F.col("have_mean") - F.col("mean")) > tolerance) | (F.abs(F.col("have_std") - F.col("std")) > tolerance)
    return s.join(rolled.select("entity", "step_no", "mean", "std"), ["entity", "step_no"]).where(off).select("entity", "step_no").distinct()


def trailing_days(df: DataFrame, entity: str, time: str, value: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, day_no, total, rows, total_N, avg_N ...): one row per calendar day from an entity's first to its last.

    Days without rows get a calendar row of total 0. ``avg_N`` divides by N
    whether or not the entity existed that long. ``df`` must hold each reading once.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(
        F.col(entity).alias("entity"), F.expr(f"cast(`{time}` as bigint) div 86400").alias("day_no"), F.col(value).cast("long").alias("v"))
    daily = rows.groupBy("entity", "day_no").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"), F.count("*").alias("n_rows"))
    calendar = (
        daily.groupBy("entity").agg(F.min("day_no").alias("a"), F.max("day_no").alias("z"))
        .select("entity", F.explode(F.sequence("a", "z")).alias("day_no"))
    )
    full = calendar.join(daily, ["entity", "day_no"], "left").na.fill(0, ["total", "n_rows"])
    out = full
    for n in periods:
        w = Window.partitionBy("entity").orderBy("day_no").rangeBetween(-(n - 1), 0)
        out = out.withColumn(f"total_{n}", F.sum("total").over(w)).withColumn(f"avg_{n}", F.col(f"total_{n}") / F.lit(float(n)))
    return out

"""Irregular readings onto a regular grid.

Readings are differenced against the reading before them. For a gauge the
freshest reading of a cell stands for the cell, and the stretch between two
consecutive covered cells is an uncovered interval whose cells are marked. For
a cumulative counter the increment between two readings (the reading itself
after a reset) is spread over the cells in proportion to the overlap.

Defined results: rows without entity, time or value cover nothing; of several
readings with one time the larger value counts; repeated rows count once; an
empty table gives an empty grid; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockline.operators.ordering import lagged

_BLOCK = 4096


def _cells(first, last, step: int):
    """All cell starts from ``first`` to ``last``, in two levels so that no array is longer than a block."""
    return F.sequence(first, last, F.lit(step * _BLOCK).cast("long"))


def explode_cells(df: DataFrame, first: str, last: str, step: int, out: str) -> DataFrame:
    """A row per cell ``out`` from ``first`` to ``last``, both included, however far apart."""
    return (
        df.withColumn("__block", F.explode(_cells(F.col(first), F.col(last), step)))
        .withColumn(out, F.explode(F.sequence(F.col("__block"), F.least(F.col(last), F.col("__block") + step * (_BLOCK - 1)), F.lit(step).cast("long"))))
        .drop("__block")
    )


def covered_cells(df: DataFrame, entity: str, time: str, value: str, step: int) -> DataFrame:
    """(entity, cell, value): the freshest reading of each cell. Partial aggregation keeps a hot entity spread."""
    t = F.col(time).cast("long")
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        F.col(entity).alias("entity"), t.alias("time"), (t - F.pmod(t, F.lit(step))).alias("cell"), F.col(value).alias("value"))
    return rows.groupBy("entity", "cell").agg(F.max(F.struct("time", "value")).alias("m")).select("entity", "cell", F.col("m.value").alias("value"))


def uncovered_intervals(cells: DataFrame, step: int) -> DataFrame:
    """(entity, first, last): the stretches of cells between consecutive covered ones.

    An entity has at most one row per cell here, however many readings it sent,
    so the window is bounded by the length of the timeline.
    """
    following = F.lead("cell").over(Window.partitionBy("entity").orderBy("cell"))
    return (
        cells.select("entity", "cell", following.alias("next"))
        .where(F.col("next") - F.col("cell") > step)
        .select("entity", (F.col("cell") + step).alias("first"), (F.col("next") - step).alias("last"))
    )


def missing_cells(df: DataFrame, entity: str, time: str, value: str, step: int) -> DataFrame:
    """(entity, cell) of every uncovered cell between an entity's first and last covered cell."""
    gaps = uncovered_intervals(covered_cells(df, entity, time, value, step), step)
    return explode_cells(gaps, "first", "last", step, "cell").select("entity", "cell")


def regular_grid(df: DataFrame, entity: str, time: str, value: str, step: int) -> DataFrame:
    """(entity, cell, value, is_missing): all cells from the first to the last covered one."""
    cells = covered_cells(df, entity, time, value, step)
    gaps = explode_cells(uncovered_intervals(cells, step), "first", "last", step, "cell")
    kind = cells.schema["value"].dataType
    return cells.select("entity", "cell", "value", F.lit(False).alias("is_missing")).unionByName(
        gaps.select("entity", "cell", F.lit(None).cast(kind).alias("value"), F.lit(True).alias("is_missing")))


def counter_grid(df: DataFrame, entity: str, time: str, value: str, step: int, max_gap: int | None = None) -> DataFrame:
    """(entity, cell, increment, covered_s, resets, is_missing) of a cumulative counter.

    A reading below the one before it is a reset: the counter began again at 0,
    so the increment is the reading itself. An interval longer than ``max_gap``
    seconds is uncovered: its increment isn't placed, and cells that no other
    interval overlaps are marked missing with a NULL increment.
    """
    day = 86_400
    t = F.col(time).cast("long")
    readings = (
        df.where(F.col(entity).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull())
        .select(F.col(entity).alias("entity"), t.alias("time"), F.col(value).cast("double").alias("value"))
        .groupBy("entity", "time").agg(F.max("value").alias("value"))
        .withColumn("day", F.expr(f"time div {day}"))
    )
    steps = (
        lagged(readings, ["entity"], "day", "time", ["time", "value"])
        .where(F.col("prev").isNotNull())
        .select(
            "entity", F.col("prev.time").alias("t0"), F.col("time").alias("t1"),
            (F.col("value") < F.col("prev.value")).alias("reset"),
            F.when(F.col("value") < F.col("prev.value"), F.col("value")).otherwise(F.col("value") - F.col("prev.value")).alias("inc"))
        .withColumn("open", F.lit(False) if max_gap is None else F.col("t1") - F.col("t0") > max_gap)
        .withColumn("c0", F.col("t0") - F.pmod(F.col("t0"), F.lit(step)))
        .withColumn("c1", F.col("t1") - 1 - F.pmod(F.col("t1") - 1, F.lit(step)))
    )
    spread = explode_cells(steps, "c0", "c1", step, "cell").withColumn(
        "overlap", F.least(F.col("t1"), F.col("cell") + step) - F.greatest(F.col("t0"), F.col("cell")))
    placed = ~F.col("open")
    return (
        spread.groupBy("entity", "cell").agg(
            F.sum(F.when(placed, F.col("inc") * F.col("overlap") / (F.col("t1") - F.col("t0")))).alias("increment"),
            F.coalesce(F.sum(F.when(placed, F.col("overlap"))), F.lit(0)).alias("covered_s"),
            F.sum((F.col("reset") & (F.col("t1") - F.pmod(F.col("t1"), F.lit(step)) == F.col("cell"))).cast("long")).alias("resets"))
        .withColumn("is_missing", F.col("covered_s") == 0)
    )

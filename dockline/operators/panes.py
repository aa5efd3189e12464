"""Late and out-of-order events by stream slicing.

The stream is cut into non-overlapping panes. On the event axis a pane holds the
partial sums of one entity and one window boundary interval; a window is the
merge of the panes it covers, so a late event changes one pane and only the
windows over that pane are made again. On the arrival axis a pane holds the
largest event time seen, whose running maximum is the entity's watermark.

Defined results: rows without entity, event time or arrival time take no part
in lateness (and no pane); repeated rows are separate rows; equal arrival times
don't see each other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arrivals(df: DataFrame, entity: str, event: str, arrival: str, keep: list[str] = ()) -> DataFrame:
    ok = F.col(entity).isNotNull() & F.col(event).isNotNull() & F.col(arrival).isNotNull()
    return df.where(ok).select(F.col(entity).alias("entity"), F.col(event).cast("long").alias("event"), F.col(arrival).cast("long").alias("arrival"), *keep)


def watermarks(rows: DataFrame, pane: int = 3600) -> DataFrame:
    """(entity, arrival, seen): the largest event time that arrived strictly before.

    Arrivals are reduced to one row per (entity, second), then to one per
    (entity, pane). The running maximum over panes is a short window; inside a
    pane there are at most ``pane`` rows.
    """
    slices = rows.groupBy("entity", "arrival").agg(F.max("event").alias("top")).withColumn("pane", F.expr(f"arrival div {pane}"))
    before = Window.partitionBy("entity").orderBy("pane").rowsBetween(Window.unboundedPreceding, -1)
    panes = slices.groupBy("entity", "pane").agg(F.max("top").alias("pane_top")).withColumn("carried", F.max("pane_top").over(before)).drop("pane_top")
    inside = Window.partitionBy("entity", "pane").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.withColumn("inner", F.max("top").over(inside))
        .join(panes, ["entity", "pane"])
        .select("entity", "arrival", F.greatest("inner", "carried").alias("seen"))
    )


def lateness(rows: DataFrame, cutoff: int, pane: int = 3600) -> DataFrame:
    """``rows`` with ``lateness``: ``on_time``, ``late`` or, more than ``cutoff`` behind, ``too_late``."""
    behind = F.col("seen") - F.col("event")
    kind = F.when(F.col("seen").isNull() | (behind <= 0), "on_time").when(behind > cutoff, "too_late").otherwise("late")
    return rows.join(watermarks(rows, pane), ["entity", "arrival"]).withColumn("lateness", kind).drop("seen")


def partial_sums(values: list[str]) -> list[Column]:
    """Rows, and sum and count of each value: what panes are merged by."""
    return [F.count("*").alias("n"), *[f(v).alias(f"{k}_{v}") for v in values for k, f in (("sum", F.sum), ("n", F.count))]]


def event_panes(rows: DataFrame, width: int, values: list[str], extra: list[str] = ()) -> DataFrame:
    """(entity, pane_start, n, sum and count of each value): mergeable partial sums."""
    start = F.col("event") - F.pmod(F.col("event"), F.lit(width))
    return rows.withColumn("pane_start", start).groupBy("entity", "pane_start", *extra).agg(*partial_sums(values))


def compose_windows(panes: DataFrame, width: int, per_window: int, values: list[str], extra: list[str] = ()) -> DataFrame:
    """Windows of ``per_window`` panes, one beginning at each pane boundary that has a row under it."""
    if per_window == 1:
        return panes.withColumnRenamed("pane_start", "window_start")
    spread = panes.withColumn("window_start", F.explode(F.array(*[F.col("pane_start") - i * width for i in range(per_window)])))
    aggs = [F.sum("n").alias("n")]
    for v in values:
        aggs += [F.sum(f"sum_{v}").alias(f"sum_{v}"), F.sum(f"n_{v}").alias(f"n_{v}")]
    return spread.groupBy("entity", "window_start", *extra).agg(*aggs)


def emissions(rows: DataFrame, width: int, batch: int, values: list[str], cutoff: int, pane: int = 3600, per_window: int = 1) -> DataFrame:
    """What a consumer would see: each window again after every arrival batch that changed one of its panes.

    (entity, window_start, batch, revision, n, sum_*, n_*): revision 0 is the
    first result; later ones are corrections by late rows. Rows past the cut-off
    change nothing. A window covers ``per_window`` panes; the running merge is
    over the batches that touched it.
    """
    kept = lateness(rows, cutoff, pane).where(F.col("lateness") != "too_late").withColumn("batch", F.expr(f"arrival div {batch}"))
    parts = compose_windows(event_panes(kept, width, values, ["batch"]), width, per_window, values, ["batch"])
    order = Window.partitionBy("entity", "window_start").orderBy("batch")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    columns = ["n", *[f"{k}_{v}" for v in values for k in ("sum", "n")]]
    return parts.select("entity", "window_start", "batch", (F.row_number().over(order) - 1).alias("revision"), *[F.sum(c).over(w).alias(c) for c in columns])


def merge_panes(state: DataFrame, changed: DataFrame, values: list[str]) -> DataFrame:
    """Fold the panes of a new batch into the stored ones (both as made by :func:`event_panes`)."""
    columns = ["n", *[f"{k}_{v}" for v in values for k in ("sum", "n")]]
    return state.unionByName(changed).groupBy("entity", "pane_start").agg(*[F.sum(c).alias(c) for c in columns])

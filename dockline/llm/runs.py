"""Repeated consecutive events, collapsed by pointer doubling.

Events with one time and one value are first merged into nodes (no order
matters between them). A node that matches the node before it points to it; in
each round every open pointer is replaced by the pointer of its target, so a
run of n nodes reaches its start after log2(n) self-joins. Nodes that have
reached their start leave the rounds and are only looked up.

Defined results: rows without entity, order or value take no part; equal order
values are read by tie-breaker; exact repeats are events of their own and
lengthen a run; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockline.session import cut_lineage

#: Units of order in a numbering bucket, tie-breakers in a block, nodes above which a bucket is cut by moment and block.
_BUCKET, _BLOCK, _CROWDED = 21_600, 65_536, 500_000
#: Open nodes that a round may broadcast: three longs each.
_BROADCAST_OPEN = 100_000


def event_nodes(df: DataFrame, entity: str, order: str, tie: str, value: str) -> DataFrame:
    """(entity, at, min_tie, max_tie, value, n): maximal merges within one order value.

    An order value with one distinct value is one node by plain aggregation,
    however many events it has. One with several values is split by runs of the
    tie-breaker, in blocks of tie-breakers so that no task gets all of them.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(order).isNotNull() & F.col(value).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(order).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    moments = rows.groupBy("entity", "at").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"), F.min("tie").alias("min_tie"), F.max("tie").alias("max_tie"))
    plain = moments.where(F.col("lo") == F.col("hi")).select("entity", "at", "min_tie", "max_tie", F.col("lo").alias("value"), "n")
    mixed = rows.join(moments.where(F.col("lo") != F.col("hi")).select("entity", "at"), ["entity", "at"], "left_semi").withColumn("block", F.expr(f"tie div {_BLOCK}"))
    w = Window.partitionBy("entity", "at", "block").orderBy("tie")
    change = F.coalesce((F.col("value") != F.lag("value").over(w)).cast("int"), F.lit(1))
    split = (
        mixed.withColumn("change", change)
        .withColumn("seg", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("entity", "at", "block", "seg")
        .agg(F.min("tie").alias("min_tie"), F.max("tie").alias("max_tie"), F.first("value").alias("value"), F.count("*").alias("n"))
        .select("entity", "at", "min_tie", "max_tie", "value", "n")
    )
    return plain.unionByName(split)


def numbered(nodes: DataFrame, crowded: int = _CROWDED) -> DataFrame:
    """``nodes`` with ``id`` (0, 1, ... per entity) and ``before``, the value of the node before.

    Two levels: numbers inside buckets of the order, offsets and last values from
    one row per bucket. A bucket with more than ``crowded`` nodes (one report
    time with ever changing values) is cut by moment and block of tie-breakers.
    """
    rows = nodes.withColumn("bucket", F.expr(f"cast(at as bigint) div {_BUCKET}"))
    full = rows.groupBy("entity", "bucket").agg(F.count("*").alias("k")).where(F.col("k") > crowded).select("entity", "bucket", F.lit(True).alias("full"))
    keys = ["entity", "bucket"]
    if not full.isEmpty():
        rows = rows.join(full, ["entity", "bucket"], "left")
        rows = rows.withColumn("bucket", F.struct("bucket", F.when(F.col("full"), F.col("at")).alias("at"), F.when(F.col("full"), F.expr(f"min_tie div {_BLOCK}")).alias("block"))).drop("full")
    inside = Window.partitionBy(*keys).orderBy("at", "min_tie")
    across = Window.partitionBy("entity").orderBy("bucket")
    ends = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.max_by("value", F.struct("at", "min_tie")).alias("last"))
    ends = ends.select(*keys, F.coalesce(F.sum("k").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lag("last").over(across).alias("carried"))
    return (
        rows.withColumn("rn", F.row_number().over(inside)).withColumn("inner", F.lag("value").over(inside))
        .join(ends, keys)
        .withColumn("id", F.col("offset") + F.col("rn") - 1)
        .withColumn("before", F.when(F.col("rn") == 1, F.col("carried")).otherwise(F.col("inner")))
        .drop("rn", "inner", "offset", "carried", "bucket"))


def double_pointers(starts: DataFrame, followers: DataFrame, max_rounds: int = 64) -> list[DataFrame]:
    """The ``followers`` (entity, id, ptr, ...), in parts, with every pointer moved to the start of its chain.

    ``starts`` has (entity, id, ptr = id, ...). Only open rows are joined and written
    again in a round. They are looked up in the starts, the rows finished in
    earlier rounds and each other, without an exchange of those once few enough are open.
    """
    looked_up = lambda p, done: p.select("entity", F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.lit(done).alias("done2"))
    rest = [c for c in followers.columns if c != "ptr"]
    opened, finished = followers, [starts]
    count = opened.count()
    for _ in range(max_rounds):
        if count == 0:
            return finished[1:]
        lookup = _union([*[looked_up(p, True) for p in finished], looked_up(opened, False)])
        few = count <= _BROADCAST_OPEN
        moved = (F.broadcast(opened) if few else opened).join(lookup, ["entity", "ptr"]).select(*rest, F.col("ptr2").alias("ptr"), F.col("done2").alias("done"))
        # few rows out of a scan of all parts: without an exchange each round would have as many tasks as all before it together
        moved = cut_lineage(moved.repartition(1 + count // 25_000) if few else moved)
        finished.append(moved.where("done").drop("done"))
        opened = moved.where("not done").drop("done")
        count = opened.count()
    raise RuntimeError(f"a chain is longer than 2^{max_rounds}")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collapse_runs(df: DataFrame, entity: str, order: str, tie: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """(entity, value, n, first_at, last_at, duration, min_tie, max_tie): one row per longest run.

    With ``tolerance`` neighbours match when they differ by at most that much
    (values must then be numeric), and ``value`` is the run's first.
    """
    nodes = numbered(cut_lineage(event_nodes(df, entity, order, tie, value)))
    match = F.abs(F.col("value") - F.col("before")) <= tolerance if tolerance else F.col("value") == F.col("before")
    linked = cut_lineage(nodes.withColumn("follows", F.coalesce(match, F.lit(False))).drop("before"))
    starts = linked.where("not follows").drop("follows").withColumn("ptr", F.col("id"))
    found = double_pointers(starts, linked.where("follows").drop("follows").withColumn("ptr", F.col("id") - 1))
    return (
        _union([starts, *found])
        .groupBy("entity", "ptr")
        .agg(
            F.min_by("value", "id").alias("value"), F.sum("n").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
            F.min("min_tie").alias("min_tie"), F.max("max_tie").alias("max_tie"))
        .withColumn("duration", F.col("last_at") - F.col("first_at"))
        .drop("ptr")
    )

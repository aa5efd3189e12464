"""What changed between full snapshots.

Each delivered snapshot is unpivoted into cells (key, field, value) that count
+1 in the transition to it and -1 in the transition to the next one, plus a
presence marker per key. Equal cells cancel; what is left over classifies the
key and names the changed fields.

Defined results: rows without snapshot number or key take no part; of several
rows of a key in one snapshot the one with the largest row number counts; NULL
equals NULL only; the first snapshot yields nothing; a snapshot number that was
never delivered is skipped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Deliveries that may be broadcast: at two longs each, under 2 MB.
_BROADCAST_DELIVERIES = 100_000


def deliveries(df: DataFrame, number: str) -> DataFrame:
    """(number, next_number) of the delivered snapshots; one row per delivery, so a single small window."""
    seen = df.where(F.col(number).isNotNull()).select(F.col(number).alias("number")).distinct()
    return seen.withColumn("next_number", F.lead("number").over(Window.orderBy("number"))).withColumn("is_first", F.lag("number").over(Window.orderBy("number")).isNull())


def snapshot_changes(df: DataFrame, number: str, key: str, row_no: str, fields: list[str]) -> DataFrame:
    """(number, key, change_kind, changed_fields) between each snapshot and the one delivered before it."""
    state = (
        df.where(F.col(number).isNotNull() & F.col(key).isNotNull())
        .select(F.col(number).alias("number"), F.col(key).alias("key"), F.col(row_no).alias("row_no"), F.struct(*[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)]).alias("cells"))
        .groupBy("number", "key").agg(F.max_by("cells", "row_no").alias("cells"))
    )
    order = deliveries(df, number)
    if df.select(number).distinct().limit(_BROADCAST_DELIVERIES + 1).count() <= _BROADCAST_DELIVERIES:
        order = F.broadcast(order)
    signed = (
        state.join(order, "number")
        .withColumn("into", F.explode(F.array_compact(F.array(
            F.when(~F.col("is_first"), F.struct(F.col("number").alias("number"), F.lit(1).alias("sign"))),
            F.when(F.col("next_number").isNotNull(), F.struct(F.col("next_number").alias("number"), F.lit(-1).alias("sign")))))))
        .select(F.col("into.number").alias("number"), "key", F.col("into.sign").alias("sign"), "cells")
        # both sides of a transition meet here; the cell sums below then need no further exchange
        .repartition("number", "key")
    )
    cells = F.array(
        F.struct(F.lit("").alias("field"), F.lit("").alias("value")),
        *[F.struct(F.lit(c).alias("field"), F.col(f"cells.f{i}").alias("value")) for i, c in enumerate(fields)])
    left = (
        signed.withColumn("cell", F.explode(cells))
        .groupBy("number", "key", F.col("cell.field").alias("field"), F.col("cell.value").alias("value"))
        .agg(F.sum("sign").alias("sign"))
        .where(F.col("sign") != 0)
    )
    presence = F.sum(F.when(F.col("field") == "", F.col("sign")).otherwise(0))
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return (
        left.groupBy("number", "key")
        .agg(presence.alias("presence"), F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("f"))
        .select("number", "key", kind.alias("change_kind"), F.when(F.col("presence") == 0, F.col("f")).alias("changed_fields"))
    )

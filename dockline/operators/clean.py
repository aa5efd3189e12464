"""Parsing, validation and deduplication of station messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.schemas import STATION_MESSAGE


def parse(messages: DataFrame, value: str = "value", schema=STATION_MESSAGE, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON bytes to typed columns plus ``event_time``, beside the columns to ``keep``. Malformed text and non-objects give NULLs; a field of a wrong type is NULL alone."""
    return messages.select(*keep, F.from_json(F.col(value).cast("string"), schema).alias("s")).select(*keep, "s.*").withColumn("event_time", F.timestamp_seconds("last_reported"))


def validate(rows: DataFrame) -> DataFrame:
    """Rows of installed stations with an id and an event time. Stateless, so it serves batch and stream alike."""
    return rows.where(F.col("station_id").isNotNull() & F.col("last_reported").isNotNull() & (F.col("is_installed") == 1))


def deduplicate(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per ``keys``: the one with the smallest ``order``. A hash aggregation with partial merge, so repeats of a hot key vanish before the exchange."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def deduplicate_stream(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream form. The watermarked column is one of the keys, so state is dropped once the watermark passes."""
    return rows.withWatermark("event_time", delay).dropDuplicates(["station_id", "last_reported", "event_time"])


def to_measures(rows: DataFrame) -> DataFrame:
    """Measures for the history: installed stations with a capture time, partition column ``ingest_date``."""
    return rows.where("station_id is not null and is_installed = 1 and ingested_at is not null").select(
        "station_id", "station_code", "num_bikes_available", "num_docks_available", "last_reported", "ingested_at", F.to_date(F.timestamp_seconds("ingested_at")).alias("ingest_date"))


def to_messages(rows: DataFrame, ingested_at: int | None = None) -> DataFrame:
    """(key, value): station id as text and the row as JSON, stamped once per cycle if ``ingested_at`` is given."""
    if ingested_at is not None:
        rows = rows.withColumn("ingested_at", F.lit(ingested_at).cast("long"))
    return rows.select(F.col("station_id").cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))

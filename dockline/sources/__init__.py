"""Readers. Each returns a DataFrame; addresses and paths are parameters."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from dockline.schemas import SNAPSHOT_FILE, STATION_MESSAGE, STATION_REFERENCE


def snapshot_file(spark: SparkSession, path: str) -> DataFrame:
    """Stations of landed poll results (one JSON document per file)."""
    doc = F.from_json("value", SNAPSHOT_FILE)
    return spark.read.text(path, wholetext=True).select(F.explode(doc["data"]["stations"]).alias("s")).select("s.*")


def kafka_batch(spark: SparkSession, servers: str, topic: str, start: str = "earliest", end: str = "latest") -> DataFrame:
    """A bounded read of a topic; needs the connector on the class path."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).option("endingOffsets", end).load()


def kafka_stream(spark: SparkSession, servers: str, topic: str, start: str = "latest") -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()


def file_stream(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str = "key string, value binary", files_per_trigger: int | None = None) -> DataFrame:
    """Stand-in for the topic: files of messages as they land."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def history(spark: SparkSession, path: str, column: str = "event_date", first: str | None = None, last: str | None = None) -> DataFrame:
    """Date-partitioned history; the range prunes partitions before anything is listed or read."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col(column) >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col(column) <= F.lit(last).cast("date"))
    return df


def peek(messages: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` messages by partition and offset."""
    return messages.select("partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).orderBy("partition", "offset").limit(n)


def station_reference(spark: SparkSession, path: str) -> DataFrame:
    """The reference list (a JSON array of objects)."""
    return spark.read.schema(STATION_REFERENCE).option("multiLine", True).json(path)


def synthetic_grid(spark: SparkSession, stations: int = 15, days: int = 4, seed: int = 42, start: int = 1_781_913_600, kept: float = 0.95) -> DataFrame:
    """A seeded day cycle with noise and missing bins; the same distribution as the usual test grid."""
    bins = days * 288
    cell = spark.range(stations * bins).select((F.col("id") % stations + 1000).alias("station_id"), F.expr(f"id div {stations}").alias("k"))
    capacity = F.pmod(F.xxhash64("station_id", F.lit(seed)), F.lit(20)) + 20
    level = capacity * (0.5 + 0.35 * F.sin(2 * 3.141592653589793 * F.col("k") / 288 + F.col("station_id"))) + 2 * F.randn(seed)
    bikes = F.greatest(F.lit(0), F.least(capacity, F.round(level))).cast("int")
    return (
        cell.withColumns({"bikes": bikes, "keep": F.rand(seed + 1) < kept}).where("keep")
        .select("station_id", F.format_string("%04d", "station_id").alias("station_code"), (F.lit(start) + F.col("k") * 300).alias("bin_epoch"), "bikes", (capacity - F.col("bikes")).cast("int").alias("docks"))
        .withColumn("ts", F.timestamp_seconds("bin_epoch").cast("timestamp_ntz"))
    )


class _PollReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.timeout, self.pause = options["url"], float(options.get("timeout", 15)), float(options.get("interval", 60))
        self.last = 0.0

    def initialOffset(self) -> dict:
        return {"cycle": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """One cycle if the interval is over. A failed fetch is an empty cycle and is tried again."""
        if time.time() - self.last < self.pause:
            return iter([]), start
        self.last = time.time()
        try:
            from urllib.request import urlopen

            with urlopen(self.url, timeout=self.timeout) as r:
                found = json.load(r)["data"]["stations"]
        except (OSError, ValueError, KeyError):
            return iter([]), start
        stamp = int(self.last)
        names = STATION_MESSAGE.fieldNames()
        rows = [tuple(stamp if n == "ingested_at" else s.get(n) for n in names) for s in found]
        return iter(rows), {"cycle": start["cycle"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        raise NotImplementedError("a poll can't be repeated; restart from the landed messages")


class PollSource(DataSource):
    """Streaming source that polls a station feed: ``spark.dataSource.register(PollSource)``, format ``station_poll``, option ``url``."""

    @classmethod
    def name(cls) -> str:
        return "station_poll"

    def schema(self) -> StructType:
        return STATION_MESSAGE

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _PollReader(self.options)


__all__ = ["PollSource", "file_stream", "history", "kafka_batch", "kafka_stream", "peek", "snapshot_file", "station_reference", "synthetic_grid"]

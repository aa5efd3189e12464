"""Declared schemas of messages, states and served records."""

from pyspark.sql import types as T

STATION_MESSAGE = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("stationCode", T.StringType()),
    T.StructField("num_bikes_available", T.IntegerType()),
    T.StructField("num_docks_available", T.IntegerType()),
    T.StructField("is_installed", T.IntegerType()),
    T.StructField("is_renting", T.IntegerType()),
    T.StructField("is_returning", T.IntegerType()),
    T.StructField("last_reported", T.LongType()),
    T.StructField("ingested_at", T.LongType()),
])

WINDOWED = T.StructType([
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("station_id", T.LongType()),
    T.StructField("station_code", T.StringType()),
    T.StructField("avg_bikes_available", T.DoubleType()),
    T.StructField("avg_docks_available", T.DoubleType()),
    T.StructField("n_observations", T.LongType()),
])

HOT_STATE = T.StructType([*WINDOWED.fields, T.StructField("updated_at", T.TimestampType(), False)])

HOT_STATE_DDL = """CREATE TABLE {table} (
    "station_id" BIGINT PRIMARY KEY,
    "station_code" VARCHAR(64),
    "window_start" TIMESTAMP,
    "window_end" TIMESTAMP,
    "avg_bikes_available" DOUBLE PRECISION,
    "avg_docks_available" DOUBLE PRECISION,
    "n_observations" BIGINT,
    "updated_at" TIMESTAMP NOT NULL
)"""

SNAPSHOT_FILE = "struct<data:struct<stations:array<struct<station_id:bigint,stationCode:string,num_bikes_available:int,num_docks_available:int,is_installed:int,is_renting:int,is_returning:int,last_reported:bigint>>>>"

STATION_REFERENCE = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("capacity", T.IntegerType()),
])

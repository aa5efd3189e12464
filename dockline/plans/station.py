"""Queries of the station pipeline over the Parquet tables, each with its SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.config import GridSpec
from dockline.functions import bin_start, epoch_ntz
from dockline.operators import clean, evaluate, features, forecast, hotstate, mapview, profile, sequences, serving, windows
from dockline.session import cut_lineage, table

SPEC = GridSpec()
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- messages -----------------------------------------------------------------

_FIELDS = {"station_id": "BIGINT", "stationCode": "TEXT", "num_bikes_available": "INTEGER", "num_docks_available": "INTEGER", "is_installed": "INTEGER", "is_renting": "INTEGER", "is_returning": "INTEGER", "last_reported": "BIGINT", "ingested_at": "BIGINT"}


def _json_field(name: str, kind: str) -> str:
    at = f"json_extract(j, '$.{name}')"
    if kind == "TEXT":
        return f"CASE json_type({at}) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string(j, '$.{name}') ELSE CAST({at} AS VARCHAR) END AS station_code"
    return f"CASE WHEN json_type({at}) IN ('UBIGINT', 'BIGINT') THEN TRY_CAST({at} AS {kind}) END AS {name}"


@query(f"""WITH t AS (SELECT feed_id, file_no, line_no, decode(msg_value) AS s FROM raw_messages),
o AS (SELECT feed_id, file_no, line_no, CASE WHEN json_valid(s) AND json_type(s) = 'OBJECT' THEN s::JSON END AS j FROM t)
SELECT feed_id, file_no, line_no, {', '.join(_json_field(n, k) for n, k in _FIELDS.items())} FROM o""")
def parse_messages(spark: SparkSession, d: str) -> DataFrame:
    return clean.parse(table(spark, d, "raw_messages"), "msg_value", keep=("feed_id", "file_no", "line_no")).drop("event_time").withColumnRenamed("stationCode", "station_code")


@query("SELECT feed_id, file_no, line_no, msg_key FROM raw_messages ORDER BY feed_id, file_no, line_no LIMIT 5")
def peek_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_messages").select("feed_id", "file_no", "line_no", "msg_key").orderBy("feed_id", "file_no", "line_no").limit(5)


@query("SELECT msg_id, CAST(station_id AS VARCHAR) AS key, num_bikes_available AS bikes_back, ingested_at AS ingested_back FROM station_status")
def to_messages(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: rows to keyed JSON messages and back."""
    rows = table(spark, d, "station_status").select("msg_id", "station_id", "num_bikes_available", "ingested_at")
    sent = clean.to_messages(rows)
    back = F.from_json("value", "msg_id bigint, num_bikes_available int, ingested_at bigint")
    return sent.select("key", back.alias("s")).select(F.col("s.msg_id").alias("msg_id"), "key", F.col("s.num_bikes_available").alias("bikes_back"), F.col("s.ingested_at").alias("ingested_back"))


def _status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "station_status").select("msg_id", "station_id", "station_code", "num_bikes_available", "num_docks_available", "is_installed", "last_reported", "ingested_at")
    return rows.withColumn("event_time", F.timestamp_seconds("last_reported"))


_VALID = "station_id IS NOT NULL AND last_reported IS NOT NULL AND is_installed = 1"


@query(f"SELECT msg_id, station_id, last_reported FROM station_status WHERE {_VALID}")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.validate(_status(spark, d)).select("msg_id", "station_id", "last_reported")


def _deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return clean.deduplicate(clean.validate(_status(spark, d)), ["station_id", "last_reported"], "msg_id")


_DEDUP = f"SELECT * FROM station_status WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY station_id, last_reported ORDER BY msg_id) = 1"


@query(f"SELECT station_id, last_reported, msg_id FROM ({_DEDUP})")
def dedup_measures(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d).select("station_id", "last_reported", "msg_id")


_WINDOWS = f"""SELECT make_timestamp(w * 300000000) AS window_start, make_timestamp((w + 1) * 300000000) AS window_end, station_id, station_code, round(avg(num_bikes_available), 1) AS avg_bikes_available,
round(avg(num_docks_available), 1) AS avg_docks_available, count(*) AS n_observations FROM (SELECT *, last_reported // 300 AS w FROM ({_DEDUP})) GROUP BY w, station_id, station_code"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.availability(_deduplicated(spark, d))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(_WINDOWS)
def tumbling_availability(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


# --- hot state ----------------------------------------------------------------

_NEWEST = "QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY window_start DESC, station_code IS NULL, station_code DESC) = 1"
_HOT = f"SELECT * FROM ({_WINDOWS}) {_NEWEST}"
_HOT_COLUMNS = "station_id, station_code, window_start, window_end, avg_bikes_available, avg_docks_available, n_observations"


@query(f"SELECT {_HOT_COLUMNS} FROM ({_HOT})")
def hot_state(spark: SparkSession, d: str) -> DataFrame:
    return hotstate.newest(_windows(spark, d)).select(*_HOT_COLUMNS.split(", "))


@query(f"SELECT {_HOT_COLUMNS} FROM ({_HOT})")
def upsert_hot_state(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of windows merged one after the other, the later first: the state never goes back."""
    # both batches are read from the windows: made once
    w = cut_lineage(_windows(spark, d).select(*_HOT_COLUMNS.split(", ")))
    odd = F.minute("window_start") % 10 == 0
    return hotstate.merge(hotstate.merge(w.limit(0), w.where(odd)), w.where(~odd))


def _state(spark: SparkSession, d: str) -> DataFrame:
    return hot_state(spark, d).withColumn("updated_at", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))


_LIST = f"SELECT station_id, station_code, window_end, avg_bikes_available AS bikes_available, avg_docks_available AS docks_available, n_observations, TIMESTAMP '2026-01-01 00:00:00' AS updated_at FROM ({_HOT})"


@query(_LIST + " ORDER BY station_id")
def hot_list(spark: SparkSession, d: str) -> DataFrame:
    return serving.stations(_state(spark, d))


_POINT = 20480011


@query(_LIST + f" WHERE station_id = {_POINT}")
def hot_point(spark: SparkSession, d: str) -> DataFrame:
    return serving.station(_state(spark, d), _POINT)


@query(f"SELECT station_id, bikes_available AS bikes_now, bikes_available AS pred_t15, bikes_available AS pred_t30, 'persistence' AS method FROM ({_LIST}) WHERE station_id = {_POINT}")
def forecast_point(spark: SparkSession, d: str) -> DataFrame:
    return serving.forecast(_state(spark, d), _POINT)


@query(f"SELECT station_id, bikes_available, docks_available, bikes_available AS pred_t15, bikes_available AS pred_t30, 'persistence' AS method FROM ({_LIST})")
def persistence_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecast.Persistence(now="bikes_available").predict(serving.stations(_state(spark, d)).select("station_id", "bikes_available", "docks_available"))


# --- history ------------------------------------------------------------------


@query("SELECT CAST(CAST(make_timestamp(last_reported * 1000000) AS DATE) AS VARCHAR) AS event_date, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations FROM station_status WHERE " + _VALID + " GROUP BY 1")
def history_partitions(spark: SparkSession, d: str) -> DataFrame:
    return clean.validate(_status(spark, d)).groupBy(F.to_date("event_time").cast("string").alias("event_date")).agg(F.count("*").alias("n_rows"), F.countDistinct("station_id").alias("n_stations"))


@query("SELECT station_id, station_code, num_bikes_available, num_docks_available, last_reported, ingested_at, CAST(CAST(make_timestamp(ingested_at * 1000000) AS DATE) AS VARCHAR) AS ingest_date FROM station_status WHERE station_id IS NOT NULL AND is_installed = 1 AND ingested_at IS NOT NULL")
def backfill_measures(spark: SparkSession, d: str) -> DataFrame:
    return clean.to_measures(table(spark, d, "station_status")).withColumn("ingest_date", F.col("ingest_date").cast("string"))


@query("SELECT station_id, station_code, num_bikes_available, num_docks_available, last_reported, ingested_at FROM station_measures WHERE ingest_date >= DATE '2026-03-05'")
def scan_history(spark: SparkSession, d: str) -> DataFrame:
    """A date range of the history; the filter reaches the scan."""
    return table(spark, d, "station_measures").where("ingest_date >= date'2026-03-05'").select("station_id", "station_code", "num_bikes_available", "num_docks_available", "last_reported", "ingested_at")


@query("SELECT station_id, ts, bikes FROM station_dataset")
def scan_projected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "station_dataset").select("station_id", "ts", "bikes")


_KNOWN = "station_id IS NOT NULL AND last_reported IS NOT NULL"


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n) AS DOUBLE) / count(*) AS factor
FROM (SELECT count(*) AS n FROM station_status WHERE {_KNOWN} GROUP BY station_id, last_reported)""")
def duplication_factor(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplication(table(spark, d, "station_status").where(_KNOWN), ["station_id", "last_reported"])


@query(f"SELECT min(last_reported) AS first_epoch, max(last_reported) AS last_epoch, count(DISTINCT last_reported // 86400) AS n_days, count(DISTINCT station_id) AS n_entities FROM station_status WHERE {_KNOWN}")
def time_coverage(spark: SparkSession, d: str) -> DataFrame:
    return profile.coverage(table(spark, d, "station_status").where(_KNOWN), "station_id", "last_reported")


@query("SELECT station_id, count(*) AS n_rows FROM station_measures GROUP BY station_id")
def per_entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.entity_counts(table(spark, d, "station_measures"), "station_id")


@query("""SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90
FROM (SELECT count(*) AS n FROM station_measures GROUP BY station_id)""")
def per_entity_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = profile.distribution(profile.entity_counts(table(spark, d, "station_measures"), "station_id"), "n_rows", {"p50": 0.5, "p90": 0.9})
    return out.withColumn("mean", F.round("mean", 6))


_GAPS = f"""SELECT * FROM (SELECT station_id, last_reported, last_reported - lag(last_reported) OVER (PARTITION BY station_id ORDER BY last_reported) AS gap_s
FROM (SELECT DISTINCT station_id, last_reported FROM station_status WHERE {_KNOWN})) WHERE gap_s IS NOT NULL"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return profile.gaps(table(spark, d, "station_status"), "station_id", "last_reported")


@query(_GAPS)
def entity_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d)


@query(f"SELECT max(gap_s) AS most, quantile_disc(gap_s, 0.5) AS p50, quantile_disc(gap_s, 0.9) AS p90, quantile_disc(gap_s, 0.99) AS p99 FROM ({_GAPS})")
def gap_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(_gaps(spark, d), "gap_s", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).select("most", "p50", "p90", "p99")


@query(f"SELECT count(*) AS n_gaps, count(*) FILTER (WHERE gap_s > 900) AS n_big, 100.0::DOUBLE * count(*) FILTER (WHERE gap_s > 900) / count(*) AS share FROM ({_GAPS})")
def big_gap_share(spark: SparkSession, d: str) -> DataFrame:
    return profile.big_gap_share(_gaps(spark, d))


# --- grid, features, targets --------------------------------------------------

_LATEST = """SELECT station_id, station_code, ingested_at // 300 * 300 AS bin_epoch, make_timestamp(ingested_at // 300 * 300000000) AS ts, num_bikes_available AS bikes, num_docks_available AS docks FROM station_measures
QUALIFY row_number() OVER (PARTITION BY station_id, ingested_at // 300 ORDER BY ingested_at DESC, coalesce(last_reported, -1) DESC, coalesce(num_bikes_available, -1) DESC, coalesce(num_docks_available, -1) DESC, coalesce(station_code, '') DESC) = 1"""


@query(_LATEST)
def grid_latest(spark: SparkSession, d: str) -> DataFrame:
    return features.latest_per_bin(table(spark, d, "station_measures"), SPEC.step)


@query(f"SELECT count(*) AS n_points, count(DISTINCT station_id) AS n_stations FROM ({_LATEST})")
def grid_summary(spark: SparkSession, d: str) -> DataFrame:
    return features.latest_per_bin(table(spark, d, "station_measures"), SPEC.step).agg(F.count("*").alias("n_points"), F.countDistinct("station_id").alias("n_stations"))


_ONCE = "SELECT station_id, bin_epoch, max(bikes) AS bikes, arg_max(docks, bikes) AS docks FROM station_grid GROUP BY station_id, bin_epoch"
_DENSE = f"""SELECT s.station_id, s.bin_epoch, g.bikes AS bikes_raw, g.docks AS docks_raw FROM
(SELECT station_id, unnest(generate_series(a, z, 300)) AS bin_epoch FROM (SELECT station_id, min(bin_epoch) AS a, max(bin_epoch) AS z FROM station_grid GROUP BY station_id)) s
LEFT JOIN ({_ONCE}) g USING (station_id, bin_epoch)"""
_W = "PARTITION BY station_id ORDER BY bin_epoch"
_FILLED = f"""SELECT *, CAST(last_value(bikes_raw IGNORE NULLS) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS bikes,
CAST(last_value(docks_raw IGNORE NULLS) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS docks FROM ({_DENSE})"""
_R = f"OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_FEATURES = f"""SELECT station_id, bin_epoch, make_timestamp(bin_epoch * 1000000) AS ts, bikes, docks, bikes + docks AS capacity, bikes / nullif(bikes + docks, 0) AS fill_ratio,
lag(bikes, 1) OVER ({_W}) AS bikes_lag5, lag(bikes, 2) OVER ({_W}) AS bikes_lag10, lag(bikes, 3) OVER ({_W}) AS bikes_lag15,
CASE WHEN count(bikes) {_R} = 6 THEN avg(bikes) {_R} END AS bikes_roll_mean30, CASE WHEN count(bikes) {_R} = 6 THEN stddev_samp(bikes) {_R} END AS bikes_roll_std30,
CAST(bin_epoch // 3600 % 24 AS INTEGER) AS hour_utc, CAST((bin_epoch // 86400 + 3) % 7 AS INTEGER) AS dow, CAST((bin_epoch // 86400 + 3) % 7 >= 5 AS INTEGER) AS is_weekend,
CAST(lead(bikes_raw, 3) OVER ({_W}) AS DOUBLE) AS target_15, CAST(lead(bikes_raw, 6) OVER ({_W}) AS DOUBLE) AS target_30, CAST(lead(bikes_raw, 12) OVER ({_W}) AS DOUBLE) AS target_60, CAST(lead(bikes_raw, 24) OVER ({_W}) AS DOUBLE) AS target_120
FROM ({_FILLED})"""
_DATASET = f"""SELECT * FROM ({_FEATURES}) WHERE bikes IS NOT NULL AND docks IS NOT NULL AND fill_ratio IS NOT NULL AND bikes_lag5 IS NOT NULL AND bikes_lag10 IS NOT NULL AND bikes_lag15 IS NOT NULL
AND bikes_roll_mean30 IS NOT NULL AND bikes_roll_std30 IS NOT NULL AND coalesce(target_15, target_30, target_60, target_120) IS NOT NULL"""


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return features.dense(table(spark, d, "station_grid"), SPEC)


def _built(spark: SparkSession, d: str) -> DataFrame:
    return features.features(_dense(spark, d), SPEC)


def _dataset(spark: SparkSession, d: str) -> DataFrame:
    return features.dataset(table(spark, d, "station_grid"), SPEC)


@query(_DENSE)
def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d)


@query(f"SELECT station_id, bin_epoch, bikes, docks FROM ({_FILLED})")
def bounded_ffill(spark: SparkSession, d: str) -> DataFrame:
    return features.filled(_dense(spark, d), SPEC).select("station_id", "bin_epoch", "bikes", "docks")


@query(f"SELECT station_id, ts, bikes_lag5, bikes_lag10, bikes_lag15 FROM ({_FEATURES})")
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).select("station_id", "ts", "bikes_lag5", "bikes_lag10", "bikes_lag15")


@query(f"SELECT station_id, ts, target_15, target_30, target_60, target_120 FROM ({_FEATURES})")
def shifted_targets(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).select("station_id", "ts", *SPEC.target_columns)


@query(f"SELECT station_id, ts, round(bikes_roll_mean30, 6) AS bikes_roll_mean30, round(bikes_roll_std30, 6) AS bikes_roll_std30 FROM ({_FEATURES})")
def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).select("station_id", "ts", F.round("bikes_roll_mean30", 6).alias("bikes_roll_mean30"), F.round("bikes_roll_std30", 6).alias("bikes_roll_std30"))


_ROUNDED = ["fill_ratio", "bikes_roll_mean30", "bikes_roll_std30"]
_ALL = ["station_id", "ts", *SPEC.feature_columns, *SPEC.target_columns]


@query(f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c in _ROUNDED else c for c in _ALL)} FROM ({_DATASET})")
def dataset_rows(spark: SparkSession, d: str) -> DataFrame:
    return _dataset(spark, d).withColumns({c: F.round(c, 6) for c in _ROUNDED}).select(*_ALL)


@query(f"SELECT count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, min(ts) AS first_ts, max(ts) AS last_ts, count(target_15) AS n_target_15, count(target_30) AS n_target_30, count(target_60) AS n_target_60, count(target_120) AS n_target_120 FROM ({_DATASET})")
def target_availability(spark: SparkSession, d: str) -> DataFrame:
    return _dataset(spark, d).agg(
        F.count("*").alias("n_rows"), F.countDistinct("station_id").alias("n_stations"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[F.count(t).alias(f"n_{t}") for t in SPEC.target_columns])


@query("SELECT station_id, bin_epoch, bikes, 'grid' AS origin FROM station_grid UNION ALL SELECT station_id, ingested_at // 300 * 300, num_bikes_available, 'measures' FROM station_measures")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "station_grid").select("station_id", "bin_epoch", "bikes", F.lit("grid").alias("origin"))
    b = table(spark, d, "station_measures").select("station_id", bin_start(F.col("ingested_at"), SPEC.step).alias("bin_epoch"), F.col("num_bikes_available").alias("bikes"), F.lit("measures").alias("origin"))
    return a.unionByName(b)


# --- stored dataset: split, metrics, sequences --------------------------------


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "station_dataset").select("station_id", "ts", *SPEC.feature_columns, *SPEC.target_columns).distinct().withColumn("epoch", F.unix_timestamp("ts"))


_STORED = "SELECT *, CAST(epoch(ts) AS BIGINT) AS epoch FROM (SELECT DISTINCT * FROM station_dataset)"
_LONG = " UNION ALL ".join(f"SELECT station_id, epoch, bikes, capacity, 'target_{m}' AS horizon, target_{m} AS y FROM stored WHERE target_{m} IS NOT NULL" for m in (15, 30, 60, 120))
_SPLIT = f"""WITH stored AS ({_STORED}), longer AS ({_LONG}), cuts AS (SELECT horizon, quantile_cont(CAST(epoch AS DOUBLE), 0.8) AS cut FROM longer GROUP BY horizon),
split AS (SELECT longer.*, CASE WHEN epoch <= cut - 7200 THEN 'train' WHEN epoch > cut THEN 'test' END AS part FROM longer JOIN cuts USING (horizon))
"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.by_horizon(_stored(spark, d).select("station_id", "epoch", "bikes", "capacity", *SPEC.target_columns), SPEC)


@query(_SPLIT + "SELECT horizon, cut FROM cuts")
def split_cut(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cuts(_long(spark, d), SPEC)


@query(_SPLIT + "SELECT horizon, part, count(*) AS n_rows, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM split WHERE part IS NOT NULL GROUP BY horizon, part")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.split(_long(spark, d), SPEC).groupBy("horizon", "part").agg(F.count("*").alias("n_rows"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))


def _test_part(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.split(_long(spark, d), SPEC).where("part = 'test'")


@query(_SPLIT + "SELECT horizon, count(*) AS n, round(avg(abs(y - bikes)), 6) AS mae, round(sqrt(avg((y - bikes) * (y - bikes))), 6) AS rmse FROM split WHERE part = 'test' GROUP BY horizon")
def persistence_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.errors(_test_part(spark, d), "y", "bikes", "horizon").withColumns({c: F.round(c, 6) for c in ("mae", "rmse")})


@query(_SPLIT + "SELECT horizon, count(*) FILTER (WHERE abs(y - bikes) >= 1) AS n_moved, round(avg(CAST(abs(y - bikes) >= 1 AS INTEGER)), 6) AS share_moved, round(avg(abs(y - bikes)) FILTER (WHERE abs(y - bikes) >= 1), 6) AS mae_moved FROM split WHERE part = 'test' GROUP BY horizon")
def moved_subset_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.moved_errors(_test_part(spark, d), "y", "bikes", "bikes", "horizon").withColumns({c: F.round(c, 6) for c in ("share_moved", "mae_moved")})


@query(_SPLIT + """, e AS (SELECT horizon, avg(abs(y - bikes)) AS mb, sqrt(avg((y - bikes) * (y - bikes))) AS rb, avg(abs(y - capacity / 2)) AS mm, sqrt(avg((y - capacity / 2) * (y - capacity / 2))) AS rm FROM split WHERE part = 'test' GROUP BY horizon)
SELECT horizon, round(mb, 6) AS mae_base, round(rb, 6) AS rmse_base, round(mm, 6) AS mae_model, round(rm, 6) AS rmse_model, round(100 * (mb - mm) / mb, 4) AS gain_mae, round(100 * (rb - rm) / rb, 4) AS gain_rmse FROM e""")
def lift_table(spark: SparkSession, d: str) -> DataFrame:
    """Lift of a half-full forecast over persistence, as measured on the test part."""
    test = _test_part(spark, d).withColumn("half", F.col("capacity") / 2)
    out = evaluate.lift(evaluate.errors(test, "y", "bikes", "horizon"), evaluate.errors(test, "y", "half", "horizon"), "horizon")
    return out.withColumns({c: F.round(c, 4 if c.startswith("gain") else 6) for c in out.columns if c != "horizon"})


@query(f"SELECT station_id, ts, target_15 - bikes AS delta_15, target_30 - bikes AS delta_30, target_60 - bikes AS delta_60, target_120 - bikes AS delta_120 FROM ({_STORED})")
def delta_target(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select("station_id", "ts", *[(F.col(t) - F.col("bikes")).alias(t.replace("target", "delta")) for t in SPEC.target_columns])


@query(f"SELECT station_id, ts, least(greatest(bikes + 2 * (bikes - bikes_lag15), 0), capacity) AS pred FROM ({_STORED})")
def clip_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    delta = 2 * (F.col("bikes") - F.col("bikes_lag15"))
    return _stored(spark, d).select("station_id", "ts", evaluate.reconstruct(F.col("bikes"), delta, F.col("capacity")).alias("pred"))


_LAST = f"SELECT * FROM ({_STORED}) QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts DESC, bikes_roll_mean30 DESC, bikes_roll_std30 DESC) = 1"


@query(f"SELECT station_id, ts, bikes, docks, capacity, hour_utc, dow FROM ({_LAST})")
def latest_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return forecast.latest_rows(_stored(spark, d)).select("station_id", "ts", "bikes", "docks", "capacity", "hour_utc", "dow")


@query(f"SELECT station_id, ts, bikes, round(bikes, 1) AS pred_t15, round(bikes, 1) AS pred_t30 FROM ({_LAST}) ORDER BY station_id LIMIT 8")
def predict_head(spark: SparkSession, d: str) -> DataFrame:
    rows = forecast.Persistence().predict(forecast.latest_rows(_stored(spark, d)))
    return rows.select("station_id", "ts", "bikes", F.round("pred_t15", 1).alias("pred_t15"), F.round("pred_t30", 1).alias("pred_t30")).orderBy("station_id").limit(8)


#: Small trees, so that four horizons are fitted in seconds; the reported shape, not the size, is what these queries are for.
_TREES = {"trees": 8, "depth": 4, "rate": 0.3, "seed": 7}


def _models(spark: SparkSession, d: str) -> tuple[dict, DataFrame]:
    """A fitted model per horizon, each trained up to its cut less the embargo, and the split rows."""
    rows = cut_lineage(evaluate.split(evaluate.by_horizon(_stored(spark, d), SPEC), SPEC))
    train = lambda t: rows.where((F.col("horizon") == t) & (F.col("part") == "train")).withColumnRenamed("y", t)
    return {t: forecast.Trees(t, **_TREES).fit(train(t)) for t in SPEC.target_columns if not train(t).isEmpty()}, rows


@query()
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees against the current value on the test part, per horizon, with gains in per cent. Fitted models have no SQL."""
    models, rows = _models(spark, d)
    test = rows.where("part = 'test'")
    scored = [m.predict(test.where(F.col("horizon") == t)).select("horizon", "y", F.col(f"pred_{t}").alias("pred")) for t, m in models.items()]
    if not scored:
        scored = [test.select("horizon", "y", F.col("bikes").alias("pred"))]
    out = evaluate.lift(evaluate.errors(test, "y", "bikes", "horizon"), evaluate.errors(functools.reduce(DataFrame.unionByName, scored), "y", "pred", "horizon"), "horizon")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "horizon"})


@query()
def predict_latest(spark: SparkSession, d: str) -> DataFrame:
    """The fitted models on the latest row of every station, rounded to one decimal."""
    models, _ = _models(spark, d)
    rows = forecast.latest_rows(_stored(spark, d))
    for m in models.values():
        rows = m.predict(rows)
    preds = [(F.round(f"pred_{t}", 1) if t in models else F.lit(None).cast("double")).alias(t.replace("target_", "pred_t")) for t in SPEC.target_columns]
    return rows.select("station_id", F.col("ts").alias("as_of"), F.round("bikes", 1).alias("bikes_ref"), *preds)


# the dataset holds a few stored rows twice with other rolling values; one row per step is kept for sequences
_STEPS = f"SELECT * FROM ({_STORED}) QUALIFY row_number() OVER (PARTITION BY station_id, epoch ORDER BY bikes_roll_mean30, bikes_roll_std30) = 1"
_RUNS = f"""SELECT *, row_number() OVER (PARTITION BY station_id, island ORDER BY epoch) AS run_len FROM (SELECT *, sum(b) OVER (PARTITION BY station_id ORDER BY epoch) AS island FROM
(SELECT *, coalesce(CAST((epoch - lag(epoch) OVER (PARTITION BY station_id ORDER BY epoch)) // 60 <> 5 AS INTEGER), 1) AS b FROM ({_STEPS})))"""


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return clean.deduplicate(_stored(spark, d).withColumn("o", F.struct("bikes_roll_mean30", "bikes_roll_std30")), ["station_id", "epoch"], "o").drop("o")


@query(f"SELECT station_id, epoch, run_len FROM ({_RUNS})")
def contiguous_runs(spark: SparkSession, d: str) -> DataFrame:
    return sequences.contiguous(_steps(spark, d), SPEC).select("station_id", "epoch", F.col("run_len").cast("bigint").alias("run_len"))


_SEQ = f"""SELECT station_id, epoch, target_15 - bikes AS y_delta, bikes, capacity, sum(bikes) OVER w AS seq_bikes, first_value(bikes) OVER w AS first_bikes, run_len, target_15
FROM ({_RUNS}) WINDOW w AS (PARTITION BY station_id ORDER BY epoch ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""


@query(f"SELECT station_id, epoch, y_delta, bikes, capacity, seq_bikes, first_bikes, CAST(12 AS INTEGER) AS n_steps FROM ({_SEQ}) WHERE run_len >= 12 AND target_15 IS NOT NULL")
def contiguous_sequences(spark: SparkSession, d: str) -> DataFrame:
    seq = sequences.sequences(_steps(spark, d), "target_15", SPEC)
    total = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["bikes"])
    return seq.select("station_id", "epoch", "y_delta", "bikes", "capacity", total.alias("seq_bikes"), F.col("steps")[0]["bikes"].alias("first_bikes"), F.size("steps").alias("n_steps"))


_EXPLODED = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM used" for c in SPEC.feature_columns)


@query(f"""WITH runs AS ({_RUNS}), ends AS (SELECT station_id, epoch FROM runs WHERE run_len >= 12 AND target_15 IS NOT NULL),
cut AS (SELECT quantile_cont(CAST(epoch AS DOUBLE), 0.8) AS c FROM ends), train AS (SELECT ends.* FROM ends, cut WHERE epoch <= c - 7200),
used AS (SELECT r.* FROM train t JOIN runs r ON r.station_id = t.station_id AND r.epoch BETWEEN t.epoch - 3300 AND t.epoch), flat AS ({_EXPLODED})
SELECT feature, round(avg(x), 5) AS mean, round(stddev_pop(x) + 1e-6, 5) AS std FROM flat GROUP BY feature""")
def train_scaler(spark: SparkSession, d: str) -> DataFrame:
    seq = sequences.sequences(_steps(spark, d), "target_15", SPEC)
    counts = seq.groupBy("epoch").agg(F.count("*").alias("k"))
    cut = counts.agg(F.percentile("epoch", F.lit(0.8), F.col("k")).alias("cut"))
    train = seq.crossJoin(F.broadcast(cut)).where(F.col("epoch") <= F.col("cut") - SPEC.embargo * SPEC.step)
    return sequences.scaler(train, SPEC).withColumns({c: F.round(c, 5) for c in ("mean", "std")})


_SAMPLE = 40


@query(f"""WITH ids AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS pos, count(*) OVER () AS total FROM (SELECT DISTINCT station_id FROM station_info WHERE station_id IS NOT NULL)),
picks AS (SELECT DISTINCT i * ((SELECT max(total) FROM ids) - 1) // {_SAMPLE - 1} AS pos FROM range({_SAMPLE}) r(i))
SELECT station_id FROM ids WHERE total <= {_SAMPLE} OR pos IN (SELECT pos FROM picks)""")
def station_subsample(spark: SparkSession, d: str) -> DataFrame:
    return sequences.systematic_sample(table(spark, d, "station_info"), "station_id", _SAMPLE)


_PICKED = f"""WITH ids AS (SELECT station_id, row_number() OVER (ORDER BY station_id) - 1 AS pos, count(*) OVER () AS total FROM (SELECT DISTINCT station_id FROM station_dataset)),
picks AS (SELECT DISTINCT i * ((SELECT max(total) FROM ids) - 1) // 4 AS pos FROM range(5) r(i)), picked AS (SELECT station_id FROM ids WHERE total <= 5 OR pos IN (SELECT pos FROM picks))
"""


@query(_PICKED + "SELECT station_id, ts, bikes FROM (SELECT DISTINCT station_id, ts, bikes FROM station_dataset) WHERE station_id IN (SELECT station_id FROM picked)")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of five evenly spread stations."""
    rows = table(spark, d, "station_dataset").select("station_id", "ts", "bikes").distinct()
    return rows.join(sequences.systematic_sample(rows, "station_id", 5), "station_id", "left_semi")


# --- map ----------------------------------------------------------------------

_INFO = "SELECT station_id, station_name AS name, lat, lon, capacity FROM station_info WHERE station_id IS NOT NULL"
_FILL = "CASE WHEN capacity > 0 THEN least(coalesce(bikes_available, 0) / CAST(capacity AS DOUBLE), 1.0) ELSE 0.0 END"
_MAP = f"""SELECT station_id, name, station_code, coalesce(bikes_available, 0.0) AS bikes_available, docks_available, coalesce(capacity, 0) AS capacity, lat, lon, {_FILL} AS fill
FROM ({_LIST}) JOIN ({_INFO}) USING (station_id) WHERE lat IS NOT NULL"""


def _info(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "station_info").select("station_id", F.col("station_name").alias("name"), "lat", "lon", "capacity")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return hot_state(spark, d).select("station_id", "station_code", F.col("avg_bikes_available").alias("bikes_available"), F.col("avg_docks_available").alias("docks_available"))


@query(f"""SELECT station_id, name, station_code, bikes_available, docks_available, capacity, lat, lon, round(fill, 6) AS fill,
CAST(trunc(255 * (1 - fill)) AS INTEGER) AS red, CAST(trunc(180 * fill) AS INTEGER) + 40 AS green, CAST(60 AS INTEGER) AS blue FROM ({_MAP})""")
def map_join(spark: SparkSession, d: str) -> DataFrame:
    rows = mapview.map_rows(_listed(spark, d), _info(spark, d))
    from dockline.functions import map_fill as fill

    return rows.select(*[c for c in rows.columns if c not in ("fill_ratio", "color")], F.round(fill(F.col("bikes_available"), F.col("capacity")), 6).alias("fill"), *[F.col("color")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))])


@query(f"SELECT station_id, lat, lon, round(fill, 6) AS fill FROM ({_MAP}) WHERE capacity > 0")
def map_fill(spark: SparkSession, d: str) -> DataFrame:
    return mapview.figure_rows(_listed(spark, d), _info(spark, d)).withColumn("fill", F.round("fill", 6))


@query(f"SELECT count(*) AS n_stations, CAST(trunc(sum(bikes_available)) AS BIGINT) AS bikes, CAST(trunc(coalesce(sum(docks_available), 0)) AS BIGINT) AS docks, count(*) FILTER (WHERE bikes_available = 0) AS n_empty FROM ({_MAP})")
def map_kpis(spark: SparkSession, d: str) -> DataFrame:
    return mapview.key_figures(mapview.map_rows(_listed(spark, d), _info(spark, d)))


@query(f"SELECT station_id, name || '  (' || coalesce(station_code, '') || ')' AS label FROM ({_MAP}) ORDER BY label, station_id")
def station_labels(spark: SparkSession, d: str) -> DataFrame:
    return mapview.labels(mapview.map_rows(_listed(spark, d), _info(spark, d)))


@query("SELECT count(*) AS n_keys, count(i.station_id) AS n_matched, count(*) - count(i.station_id) AS n_unmatched FROM (SELECT DISTINCT station_id FROM station_status WHERE station_id IS NOT NULL) s LEFT JOIN (SELECT DISTINCT station_id FROM station_info) i USING (station_id)")
def unmatched_keys(spark: SparkSession, d: str) -> DataFrame:
    return mapview.key_overlap(table(spark, d, "station_status"), _info(spark, d), "station_id")


# --- scalar functions in one projection ---------------------------------------


@query("""SELECT msg_id, CAST(last_reported - last_reported % 300 AS BIGINT) AS bin_start, make_timestamp(last_reported * 1000000) AS event_ts, num_bikes_available / nullif(CAST(num_docks_available AS DOUBLE), 0) AS ratio,
CAST((last_reported // 86400 + 3) % 7 AS INTEGER) AS dow FROM station_status WHERE last_reported IS NOT NULL""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    from dockline.functions import monday_zero, ratio

    ts = epoch_ntz(F.col("last_reported"))
    return table(spark, d, "station_status").where("last_reported is not null").select(
        "msg_id", bin_start(F.col("last_reported"), 300).alias("bin_start"), ts.alias("event_ts"), ratio(F.col("num_bikes_available"), F.col("num_docks_available").cast("double")).alias("ratio"), monday_zero(ts).alias("dow"))

"""The pN_ queries of the core operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.operators import drift, panes, regular_grid, rolling, snapshots, spikes
from dockline.session import cut_lineage, table

STEP = 300
SNAPSHOT_FIELDS = ["station_code", "num_bikes_available", "num_docks_available", "is_installed", "is_renting"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.missing_cells(table(spark, d, "station_measures"), "station_id", "ingested_at", "num_bikes_available", STEP).select(
        F.col("entity").alias("station_id"), F.col("cell").alias("bin_epoch"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(table(spark, d, "station_measures"), "station_id", "ingested_at", "num_bikes_available", STEP).select(
        F.col("entity").alias("station_id"), F.col("cell").alias("bin_epoch"), F.col("value").alias("bikes"), "is_missing")


def p1_counter(spark: SparkSession, d: str) -> DataFrame:
    """Docks read as a counter: every fall is a reset. Intervals over an hour are uncovered."""
    return regular_grid.counter_grid(table(spark, d, "station_measures"), "station_id", "ingested_at", "num_docks_available", STEP, 3600).select(
        F.col("entity").alias("station_id"), F.col("cell").alias("bin_epoch"), F.round("increment", 6).alias("increment"), "covered_s", "resets", "is_missing")


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_steps(rolling.filled_steps(table(spark, d, "station_grid"), "station_id", "bin_epoch", "bikes", STEP, 2), 6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "station_dataset").select("station_id", F.unix_timestamp("ts").alias("epoch"), "bikes_roll_mean30", "bikes_roll_std30")
    return rolling.wrong_features(stored, "station_id", "epoch", "bikes_roll_mean30", "bikes_roll_std30", _rolled(spark, d), STEP, 0.01).select(
        F.col("entity").alias("station_id"), (F.col("step_no") * STEP).alias("bin_epoch"))


def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    """A row for every step of a station's timeline, those without rows included."""
    return rolling.every_step(_rolled(spark, d)).select(
        F.col("entity").alias("station_id"), (F.col("step_no") * STEP).alias("bin_epoch"), F.col("value").alias("bikes"), "is_filled",
        F.round("mean", 6).alias("bikes_roll_mean30"), F.round("std", 6).alias("bikes_roll_std30"))


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "station_grid").select("station_id", "bin_epoch", "bikes").distinct()
    out = rolling.trailing_days(once, "station_id", "bin_epoch", "bikes")
    return out.select(
        F.col("entity").alias("station_id"), "day_no", F.col("total").alias("bikes_total"), "n_rows",
        "total_7", F.round("avg_7", 6).alias("avg_7"), "total_30", F.round("avg_30", 6).alias("avg_30"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = panes.arrivals(table(spark, d, "station_status"), "station_id", "last_reported", "ingested_at", ["msg_id"])
    return panes.lateness(rows, 600).where("lateness <> 'on_time'").select("msg_id", "lateness")


def p3_windows(spark: SparkSession, d: str) -> DataFrame:
    """Availability per station and 5 minutes of event time, late rows included, those past the cut-off counted apart."""
    values = ["num_bikes_available", "num_docks_available"]
    rows = panes.lateness(panes.arrivals(table(spark, d, "station_status"), "station_id", "last_reported", "ingested_at", values), 600)
    late = F.col("lateness") == "too_late"
    kept = rows.select("entity", "event", F.when(~late, F.lit(1)).alias("kept"), late.cast("long").alias("set_aside"), *[F.when(~late, F.col(v)).alias(v) for v in values])
    out = panes.event_panes(kept, STEP, ["kept", "set_aside", *values])
    return out.select(
        F.col("entity").alias("station_id"), F.col("pane_start").alias("window_start"), F.coalesce("sum_kept", F.lit(0)).alias("n_observations"), F.col("sum_set_aside").alias("n_too_late"),
        *[F.round(F.try_divide(f"sum_{v}", f"n_{v}"), 4).alias(f"avg_{v[4:]}") for v in values])


def p3_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 15 minutes that begin every 5 minutes, each the merge of the three panes it covers."""
    rows = panes.arrivals(table(spark, d, "station_status"), "station_id", "last_reported", "ingested_at", ["num_bikes_available"])
    kept = panes.event_panes(panes.lateness(rows, 600).where("lateness <> 'too_late'"), STEP, ["num_bikes_available"])
    return panes.compose_windows(kept, STEP, 3, ["num_bikes_available"]).select(
        F.col("entity").alias("station_id"), "window_start", F.col("n").alias("n_observations"), F.round(F.try_divide("sum_num_bikes_available", "n_num_bikes_available"), 4).alias("avg_bikes"))


def p3_emissions(spark: SparkSession, d: str) -> DataFrame:
    """Every result that is sent out with arrival batches of a minute, first ones and corrections."""
    rows = panes.arrivals(table(spark, d, "station_status"), "station_id", "last_reported", "ingested_at", ["num_bikes_available"])
    out = panes.emissions(rows, STEP, 60, ["num_bikes_available"], 600)
    return out.select(
        F.col("entity").alias("station_id"), "window_start", (F.col("batch") * 60).alias("batch_start"), "revision", F.col("n").alias("n_observations"),
        F.round(F.try_divide("sum_num_bikes_available", "n_num_bikes_available"), 4).alias("avg_bikes"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "station_snapshots"), "snapshot_no", "station_id", "row_no", SNAPSHOT_FIELDS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select(F.col("number").alias("snapshot_no"), F.col("key").alias("station_id"), "change_kind")


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).where("change_kind = 'changed'").select(
        F.col("number").alias("snapshot_no"), F.col("key").alias("station_id"), F.explode("changed_fields").alias("field_name"))


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "station_status"), "station_id", "last_reported", "msg_id", "num_bikes_available", "num_docks_available").select(
        F.col("tie").alias("msg_id"), "reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_reasons(spark, d).select("msg_id").distinct()


_RAW = ("feed_id", "file_no", "line_no", "msg_value")


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.migrations(table(spark, d, "raw_messages"), *_RAW).select(F.col("feed").alias("feed_id"), "file_no", "change_kind", "field_name", "old_name", "old_kind", "new_kind")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_changes(spark, d).select("feed_id", "file_no", "change_kind", "field_name")


def p7_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return drift.fingerprints(drift.profiles(drift.fields(table(spark, d, "raw_messages"), *_RAW))).select(F.col("feed").alias("feed_id"), "file_no", "fingerprint", "version")


def _routed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, d, "raw_messages")
    # read by the profiles and by the table: parsed once
    cells = cut_lineage(drift.fields(raw, *_RAW))
    return cells, drift.routes(drift.profiles(cells), drift.migrations(raw, *_RAW, cells))


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(*_routed(spark, d)).withColumnRenamed("feed", "feed_id")


def p7_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Fields of one file that go to the same column."""
    return drift.conflicts(_routed(spark, d)[1]).withColumnRenamed("feed", "feed_id")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_grid, p1_counter, p2_found, p2_steps, p2_daily, p3_found, p3_windows, p3_sliding, p3_emissions, p4_found, p4_fields,
    p5_found, p5_reasons, p7_found, p7_changes, p7_fingerprints, p7_table, p7_conflicts)}

# --- the same in SQL ----------------------------------------------------------

_CELLS = """SELECT station_id, ingested_at // 300 * 300 AS b, max({'t': ingested_at, 'v': num_bikes_available}).v AS bikes FROM station_measures
WHERE station_id IS NOT NULL AND ingested_at IS NOT NULL AND num_bikes_available IS NOT NULL GROUP BY 1, 2"""
_GRID = f"""WITH cells AS ({_CELLS}), spine AS (SELECT station_id, unnest(generate_series(a, z, 300)) AS b FROM (SELECT station_id, min(b) AS a, max(b) AS z FROM cells GROUP BY station_id))
SELECT station_id, b AS bin_epoch, bikes, bikes IS NULL AS is_missing FROM spine LEFT JOIN cells USING (station_id, b)"""
_COUNTER = """WITH r AS (SELECT station_id, ingested_at AS t, CAST(max(num_docks_available) AS DOUBLE) AS v FROM station_measures WHERE station_id IS NOT NULL AND ingested_at IS NOT NULL AND num_docks_available IS NOT NULL GROUP BY 1, 2),
i AS (SELECT station_id, lag(t) OVER w AS t0, t AS t1, v < lag(v) OVER w AS reset, CASE WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS inc FROM r WINDOW w AS (PARTITION BY station_id ORDER BY t)),
c AS (SELECT *, unnest(generate_series(t0 // 300 * 300, (t1 - 1) // 300 * 300, 300)) AS cell FROM i WHERE t0 IS NOT NULL),
o AS (SELECT *, least(t1, cell + 300) - greatest(t0, cell) AS overlap, t1 - t0 > 3600 AS far FROM c)
SELECT station_id, cell AS bin_epoch, round(sum(CASE WHEN NOT far THEN inc * overlap / (t1 - t0) END), 6) AS increment, CAST(coalesce(sum(CASE WHEN NOT far THEN overlap END), 0) AS BIGINT) AS covered_s,
CAST(sum(CAST(reset AND t1 // 300 * 300 = cell AS INTEGER)) AS BIGINT) AS resets, coalesce(sum(CASE WHEN NOT far THEN overlap END), 0) = 0 AS is_missing FROM o GROUP BY station_id, cell"""
_FILL = """WITH g AS (SELECT station_id, bin_epoch // 300 AS s, min(bikes) AS v FROM station_grid GROUP BY 1, 2),
f AS (SELECT station_id, s + a AS step_no, arg_min(v, a) AS value, min(a) > 0 AS is_filled FROM g, range(3) r(a) GROUP BY 1, 2),
w AS (SELECT *, count(*) OVER r AS n, avg(value) OVER r AS m, stddev_samp(value) OVER r AS d FROM f WINDOW r AS (PARTITION BY station_id ORDER BY step_no RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)),
rolled AS (SELECT station_id, step_no, value, is_filled, CASE WHEN n = 6 THEN m END AS mean, CASE WHEN n = 6 THEN d END AS std FROM w)
"""
_DAILY = """WITH once AS (SELECT DISTINCT station_id, bin_epoch, bikes FROM station_grid), daily AS (SELECT station_id, bin_epoch // 86400 AS day_no, sum(bikes) AS t, count(*) AS n FROM once GROUP BY 1, 2),
cal AS (SELECT station_id, unnest(generate_series(a, z)) AS day_no FROM (SELECT station_id, min(day_no) AS a, max(day_no) AS z FROM daily GROUP BY 1)),
f AS (SELECT station_id, day_no, coalesce(t, 0) AS t, coalesce(n, 0) AS n FROM cal LEFT JOIN daily USING (station_id, day_no))
SELECT station_id, day_no, CAST(t AS BIGINT) AS bikes_total, n AS n_rows, CAST(sum(t) OVER a AS BIGINT) AS total_7, round(sum(t) OVER a / 7.0::DOUBLE, 6) AS avg_7, CAST(sum(t) OVER b AS BIGINT) AS total_30, round(sum(t) OVER b / 30.0::DOUBLE, 6) AS avg_30
FROM f WINDOW a AS (PARTITION BY station_id ORDER BY day_no RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), b AS (PARTITION BY station_id ORDER BY day_no RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)"""
_LATE = """WITH x AS (SELECT *, max(last_reported) OVER (PARTITION BY station_id ORDER BY ingested_at RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM station_status
WHERE station_id IS NOT NULL AND last_reported IS NOT NULL AND ingested_at IS NOT NULL),
late AS (SELECT *, CASE WHEN seen IS NULL OR seen <= last_reported THEN 'on_time' WHEN seen - last_reported > 600 THEN 'too_late' ELSE 'late' END AS lateness FROM x)
"""
_SNAP = """WITH s AS (SELECT * FROM station_snapshots WHERE snapshot_no IS NOT NULL AND station_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_no, station_id ORDER BY row_no DESC) = 1),
o AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM s)),
a AS (SELECT s.*, o.before FROM s JOIN o USING (snapshot_no) WHERE before IS NOT NULL), b AS (SELECT s.*, o.snapshot_no AS into_no FROM s JOIN o ON o.before = s.snapshot_no)
"""
_DIFFERS = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in SNAPSHOT_FIELDS)
_BOTH = "a JOIN b ON b.into_no = a.snapshot_no AND b.station_id = a.station_id"
_SPIKES = """WITH r AS (SELECT msg_id, station_id AS s, last_reported AS t, num_bikes_available AS a, num_docks_available AS b FROM station_status WHERE station_id IS NOT NULL AND last_reported IS NOT NULL),
z AS (SELECT s, median(a + b) AS size FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY s),
long AS (SELECT msg_id, s, t, 'a' AS c, a AS v FROM r UNION ALL SELECT msg_id, s, t, 'b', b FROM r),
u AS (SELECT s, c, t, min(v) AS lo, max(v) AS hi, arg_max(v, msg_id) FILTER (v IS NOT NULL) AS rep FROM long GROUP BY s, c, t),
h AS (SELECT u.*, z.size, median(rep) OVER w AS med, list(rep) OVER w AS near FROM u LEFT JOIN z USING (s) WINDOW w AS (PARTITION BY s, c ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
e AS (SELECT *, hi IS NOT NULL AND size IS NOT NULL AND greatest(abs(hi - med), abs(lo - med)) > greatest(0.3::DOUBLE * size, 1.4826::DOUBLE * list_median(list_transform(list_filter(near, lambda x: x IS NOT NULL), lambda x: abs(x - med)))) AS dev FROM h),
k AS (SELECT *, sum(CAST(dev AS INTEGER)) OVER (PARTITION BY s, c ORDER BY t) AS seen FROM e),
l AS (SELECT *, CASE WHEN hi IS NOT NULL AND size IS NOT NULL AND NOT dev THEN {'v': rep, 'k': seen} END AS calm FROM k),
n AS (SELECT *, last_value(calm IGNORE NULLS) OVER (PARTITION BY s, c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(calm IGNORE NULLS) OVER (PARTITION BY s, c ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM l),
far AS (SELECT s, c, t, size, p.v AS p, q.v AS q FROM n WHERE dev AND q.k - p.k <= 3 AND abs(p.v - q.v) <= 0.4::DOUBLE * size AND greatest(abs(hi - p.v), abs(lo - p.v)) > 0.4::DOUBLE * size AND greatest(abs(hi - q.v), abs(lo - q.v)) > 0.4::DOUBLE * size),
i AS (SELECT *, CASE WHEN a = lag(a) OVER w AND b = lag(b) OVER w THEN 0 ELSE 1 END AS br FROM r WINDOW w AS (PARTITION BY s ORDER BY t, msg_id)),
g AS (SELECT *, sum(br) OVER (PARTITION BY s ORDER BY t, msg_id) AS isl FROM i),
reasons AS (SELECT msg_id, 'bounds' AS reason FROM r LEFT JOIN z USING (s) WHERE a < 0 OR b < 0 OR a > 1.3::DOUBLE * size OR b > 1.3::DOUBLE * size
UNION SELECT long.msg_id, 'spike' FROM long JOIN far USING (s, c, t) WHERE least(abs(v - p), abs(v - q)) > 0.4::DOUBLE * size
UNION SELECT msg_id, 'stuck' FROM (SELECT *, count(DISTINCT t) OVER (PARTITION BY s, isl) AS times FROM g WHERE a IS NOT NULL AND b IS NOT NULL) WHERE times >= 60)
"""
_FIELDS = """WITH m AS (SELECT feed_id, file_no, decode(msg_value) AS s FROM raw_messages),
o AS (SELECT feed_id, file_no, CASE WHEN json_valid(s) AND json_type(s) = 'OBJECT' THEN s::JSON END AS j FROM m),
k AS (SELECT feed_id, file_no, j, unnest(json_keys(j)) AS name FROM o WHERE j IS NOT NULL),
f AS (SELECT feed_id, file_no, name, CASE json_type(json_extract(j, '$."' || name || '"')) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind FROM k),
c AS (SELECT feed_id, file_no, name, kind, count(*) AS n FROM f WHERE kind IS NOT NULL GROUP BY ALL),
p AS (SELECT feed_id, file_no, name, kind FROM c QUALIFY row_number() OVER (PARTITION BY feed_id, file_no, name ORDER BY n DESC, kind) = 1)"""
_DRIFT = _FIELDS + """, files AS (SELECT feed_id, file_no, lag(file_no) OVER (PARTITION BY feed_id ORDER BY file_no) AS prev_no FROM (SELECT DISTINCT feed_id, file_no FROM raw_messages WHERE feed_id IS NOT NULL AND file_no IS NOT NULL)),
a AS (SELECT p.* FROM p JOIN files USING (feed_id, file_no) WHERE prev_no IS NOT NULL), b AS (SELECT p.feed_id, files.file_no, name, kind FROM p JOIN files ON files.feed_id = p.feed_id AND files.prev_no = p.file_no),
x AS (SELECT feed_id, file_no, name, a.kind AS new_kind, b.kind AS old_kind FROM a FULL JOIN b USING (feed_id, file_no, name)),
y AS (SELECT *, count(*) FILTER (new_kind IS NULL) OVER s AS gone, count(*) FILTER (old_kind IS NULL) OVER s AS come FROM x WINDOW s AS (PARTITION BY feed_id, file_no)),
steps AS (SELECT feed_id, file_no, 'retyped' AS change_kind, name AS field_name, name AS old_name, old_kind, new_kind FROM y WHERE new_kind <> old_kind
UNION ALL SELECT n.feed_id, n.file_no, 'renamed', n.name, o.name, o.old_kind, n.new_kind FROM y n JOIN y o USING (feed_id, file_no) WHERE n.old_kind IS NULL AND o.new_kind IS NULL AND n.gone = 1 AND n.come = 1
UNION ALL SELECT feed_id, file_no, 'added', name, NULL, NULL, new_kind FROM y WHERE old_kind IS NULL AND NOT (gone = 1 AND come = 1)
UNION ALL SELECT feed_id, file_no, 'removed', name, name, old_kind, NULL FROM y WHERE new_kind IS NULL AND NOT (gone = 1 AND come = 1))
"""

SQL = {
    "p5_found": _SPIKES + "SELECT DISTINCT msg_id FROM reasons",
    "p5_reasons": _SPIKES + "SELECT msg_id, reason FROM reasons",
    # a field gone and a field come are the only ones of their step in these tables, so no values need be compared
    "p7_found": _DRIFT + "SELECT feed_id, file_no, change_kind, field_name FROM steps",
    "p7_changes": _DRIFT + "SELECT * FROM steps",
    "p7_fingerprints": _FIELDS + """, l AS (SELECT feed_id, file_no, substr(sha256(string_agg(name || ':' || kind, ',' ORDER BY name || ':' || kind)), 1, 16) AS fingerprint FROM p GROUP BY 1, 2),
w AS (SELECT *, coalesce(CAST(fingerprint <> lag(fingerprint) OVER (PARTITION BY feed_id ORDER BY file_no) AS INTEGER), 1) AS new FROM l)
SELECT feed_id, file_no, fingerprint, CAST(sum(new) OVER (PARTITION BY feed_id ORDER BY file_no) AS INTEGER) AS version FROM w""",
    "p1_found": f"SELECT station_id, bin_epoch FROM ({_GRID}) WHERE is_missing",
    "p1_grid": _GRID,
    "p1_counter": _COUNTER,
    "p2_found": _FILL + """SELECT DISTINCT d.station_id, r.step_no * 300 AS bin_epoch FROM station_dataset d JOIN rolled r ON r.station_id = d.station_id AND r.step_no = CAST(epoch(d.ts) AS BIGINT) // 300
WHERE abs(d.bikes_roll_mean30 - r.mean) > 0.01 OR abs(d.bikes_roll_std30 - r.std) > 0.01""",
    "p2_steps": _FILL + """, cal AS (SELECT station_id, unnest(generate_series(a, z)) AS step_no FROM (SELECT station_id, min(s) AS a, max(s) AS z FROM g GROUP BY 1))
SELECT station_id, step_no * 300 AS bin_epoch, CAST(value AS BIGINT) AS bikes, coalesce(is_filled, false) AS is_filled, round(mean, 6) AS bikes_roll_mean30, round(std, 6) AS bikes_roll_std30 FROM cal LEFT JOIN rolled USING (station_id, step_no)""",
    "p2_daily": _DAILY,
    "p3_found": _LATE + "SELECT msg_id, lateness FROM late WHERE lateness <> 'on_time'",
    "p3_windows": _LATE + """SELECT station_id, last_reported // 300 * 300 AS window_start, count(*) FILTER (WHERE lateness <> 'too_late') AS n_observations, count(*) FILTER (WHERE lateness = 'too_late') AS n_too_late,
round(avg(num_bikes_available) FILTER (WHERE lateness <> 'too_late'), 4) AS avg_bikes_available, round(avg(num_docks_available) FILTER (WHERE lateness <> 'too_late'), 4) AS avg_docks_available FROM late GROUP BY 1, 2""",
    "p3_sliding": _LATE + """, o AS (SELECT station_id, last_reported // 300 * 300 - i * 300 AS window_start, num_bikes_available AS v FROM late, range(3) r(i) WHERE lateness <> 'too_late')
SELECT station_id, window_start, count(*) AS n_observations, round(avg(v), 4) AS avg_bikes FROM o GROUP BY 1, 2""",
    "p3_emissions": _LATE + """, p AS (SELECT station_id, last_reported // 300 * 300 AS window_start, ingested_at // 60 * 60 AS batch_start, count(*) AS n, sum(num_bikes_available) AS s, count(num_bikes_available) AS k FROM late WHERE lateness <> 'too_late' GROUP BY 1, 2, 3)
SELECT station_id, window_start, batch_start, CAST(row_number() OVER w - 1 AS INTEGER) AS revision, CAST(sum(n) OVER w AS BIGINT) AS n_observations, round(sum(s) OVER w / nullif(sum(k) OVER w, 0), 4) AS avg_bikes FROM p WINDOW w AS (PARTITION BY station_id, window_start ORDER BY batch_start)""",
    "p4_found": _SNAP + f"""SELECT a.snapshot_no, a.station_id, 'changed' AS change_kind FROM {_BOTH} WHERE {_DIFFERS}
UNION ALL SELECT snapshot_no, station_id, 'added' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.into_no = a.snapshot_no AND b.station_id = a.station_id)
UNION ALL SELECT into_no, station_id, 'removed' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.into_no = a.snapshot_no AND b.station_id = a.station_id)""",
    "p4_fields": _SNAP + " UNION ALL ".join(f"SELECT a.snapshot_no, a.station_id, '{c}' AS field_name FROM {_BOTH} WHERE a.{c} IS DISTINCT FROM b.{c}" for c in SNAPSHOT_FIELDS),
}

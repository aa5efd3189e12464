"""The streaming job over files of messages."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from dockline import sources
from dockline.operators import panes
from dockline.streaming import job, sinks

BASE = 1_772_400_000


def land(spark, path, number, rows):
    """rows: (station, last_reported, bikes, is_installed) relative to BASE."""
    out = [(str(s), bytearray(json.dumps({"station_id": s, "stationCode": f"{s:04d}", "num_bikes_available": b, "num_docks_available": 20 - b, "is_installed": i, "last_reported": None if t is None else BASE + t, "ingested_at": BASE + 1}).encode())) for s, t, b, i in rows]
    spark.createDataFrame(out, "key string, value binary").coalesce(1).write.mode("append").parquet(f"{path}/{number}")


def stream(spark, path):
    return sources.file_stream(spark, f"{path}/*", files_per_trigger=1)


def test_hot_and_cold_sinks_and_restart(spark, tmp_path):
    src, state = str(tmp_path / "in"), sinks.VersionedTable(spark, str(tmp_path / "state"))
    land(spark, src, 1, [(1, 10, 5, 1), (1, 10, 5, 1), (2, 20, 3, 1), (3, 30, 3, 0), (4, None, 1, 1)])
    hot = lambda: job.start_hot(stream(spark, src), sinks.hot_state_writer(state), str(tmp_path / "cp"), availableNow=True)
    hot().awaitTermination()
    first = {r.station_id: (r.avg_bikes_available, r.n_observations) for r in state.read().collect()}
    assert first == {1: (5.0, 1), 2: (3.0, 1)}, "the repeat counts once, uninstalled and timeless rows not at all"
    land(spark, src, 2, [(1, 10, 5, 1), (1, 110, 7, 1), (2, 400, 9, 1)])
    hot().awaitTermination()
    second = {r.station_id: (r.avg_bikes_available, r.n_observations) for r in state.read().collect()}
    assert second == {1: (6.0, 2), 2: (9.0, 1)}, "after the restart the repeat is still known"
    job.start_cold(stream(spark, src), str(tmp_path / "history"), str(tmp_path / "cp2"), availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "history")).count() == 6
    assert len(state.versions()) <= 3


def test_rows_below_the_watermark_are_dropped_and_state_is_freed(spark, tmp_path):
    src = str(tmp_path / "in")
    for n, rows in enumerate([[(1, 0, 5, 1)], [(1, 7200, 5, 1)], [(1, 7300, 5, 1)], [(1, 60, 9, 1)], [(1, 7400, 5, 1)]]):
        land(spark, src, n, rows)
    seen = []
    q = job.availability(stream(spark, src)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, i: seen.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    removed = sum(op["numRowsRemoved"] for p in q.recentProgress for op in p["stateOperators"])
    assert dropped >= 1 and removed >= 1
    assert not any(r.avg_bikes_available == 9.0 for r in seen)


def test_empty_source(spark, tmp_path):
    src, state = str(tmp_path / "in"), sinks.VersionedTable(spark, str(tmp_path / "state"))
    land(spark, src, 1, [(3, 30, 3, 0)])
    job.start_hot(stream(spark, src), sinks.hot_state_writer(state), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert state.read() is None or state.read().count() == 0


def test_panes_kept_by_a_stream_equal_the_batch(spark, tmp_path):
    src, values = str(tmp_path / "in"), ["num_bikes_available"]
    rows = [(1, t, t % 7, 1) for t in (0, 10, 310, 620, 20, 900, 15)]
    for n in range(0, len(rows), 2):
        land(spark, src, n, rows[n : n + 2])
    state = sinks.VersionedTable(spark, str(tmp_path / "panes"))
    arrived = panes.arrivals(job.parsed(stream(spark, src)), "station_id", "last_reported", "ingested_at", values)
    arrived.writeStream.foreachBatch(sinks.pane_writer(state, 300, values)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    whole = panes.event_panes(panes.arrivals(job.parsed(spark.read.parquet(f"{src}/*")), "station_id", "last_reported", "ingested_at", values), 300, values)
    key = lambda df: sorted(tuple(r) for r in df.select(*whole.columns).collect())
    assert key(state.read()) == key(whole)


def test_late_rows_correct_a_stream_and_the_cutoff_sets_apart(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = sorted(((i, rng.choice([1, 2]), 10 * i - rng.choice([0, 0, 0, 50, 400, 900]), 10 * i + rng.randint(0, 3), i % 9) for i in range(120)), key=lambda r: r[3])
    df = spark.createDataFrame(rows, "id int, s int, ev long, ar long, v int")
    agg = sinks.LateAggregator(spark, str(tmp_path / "late"), 300, ["v"], 600)
    bounds = [0, 300, 700, 2000]
    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = panes.arrivals(df.where((F.col("ar") >= a) & (F.col("ar") < b)), "s", "ev", "ar", ["id", "v"])
        agg.write(part, n)
        agg.write(part, n)
    judged = panes.lateness(panes.arrivals(df, "s", "ev", "ar", ["id", "v"]), 600)
    whole = panes.event_panes(judged.where("lateness <> 'too_late'"), 300, ["v"])
    key = lambda d: sorted(tuple(r) for r in d.select(*whole.columns).collect())
    assert key(agg.all_panes()) == key(whole)
    aside = {r.id for r in spark.read.parquet(f"{tmp_path}/late/set_aside").collect()}
    assert aside == {r.id for r in judged.where("lateness = 'too_late'").collect()} and aside
    assert spark.read.parquet(f"{tmp_path}/late/emitted").count() > whole.count(), "some windows were sent out again"


def test_sliding_windows_over_changed_panes_and_a_state_that_stops_growing(spark, tmp_path):
    rows = [(1, 60 * i, 60 * i + 1, 1) for i in range(200)] + [(1, 5900, 6300, 1), (1, 100, 6301, 1)]
    df = spark.createDataFrame(rows, "s int, ev long, ar long, v int")
    agg, kept = sinks.LateAggregator(spark, str(tmp_path / "late"), 300, ["v"], 600, per_window=3), []
    for n in range(5):
        part = panes.arrivals(df.where((F.col("ar") >= 2500 * n) & (F.col("ar") < 2500 * (n + 1))), "s", "ev", "ar", ["v"])
        agg.write(part, n)
        kept.append(agg.panes.read().count())
    assert max(kept) <= 600 // 300 + 2 * 3 and len(agg.panes.versions()) <= 3
    judged = panes.lateness(panes.arrivals(df, "s", "ev", "ar", ["v"]), 600).where("lateness <> 'too_late'")
    want = {(r.window_start, r.n) for r in panes.compose_windows(panes.event_panes(judged, 300, ["v"]), 300, 3, ["v"]).collect()}
    sent = spark.read.parquet(f"{tmp_path}/late/emitted").groupBy("window_start").agg(F.max_by("n", "batch").alias("n")).collect()
    assert {(r.window_start, r.n) for r in sent} == want
    assert spark.read.parquet(f"{tmp_path}/late/set_aside").count() == 1


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    state = sinks.VersionedTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a", 1)], "station_id long, station_code string, window_start long")
    for i, b in ((0, df), (1, df.withColumn("window_start", F.lit(5).cast("long"))), (1, df.withColumn("window_start", F.lit(9).cast("long")))):
        sinks.hot_state_writer(state)(b, i)
    assert state.read().first().window_start == 5


def test_jdbc_merge(spark):
    url = "jdbc:derby:memory:docks;create=true"
    try:
        sinks.create_jdbc_state(spark, url, "current_state")
    except Exception as e:  # the driver isn't on every class path
        pytest.skip(str(e)[:80])
    write = sinks.jdbc_writer(url, "current_state", "staging", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    rows = "station_id long, station_code string, window_start timestamp, window_end timestamp, avg_bikes_available double, avg_docks_available double, n_observations long"
    batch = lambda h, b: spark.sql(f"select 1L station_id, 'a' station_code, timestamp'2026-01-01 0{h}:00:00' window_start, timestamp'2026-01-01 0{h}:05:00' window_end, {b}D avg_bikes_available, 1D avg_docks_available, 2L n_observations")
    assert rows
    for i, (h, b) in enumerate([(5, 1), (4, 2), (5, 3)]):
        write(batch(h, b), i)
    got = spark.read.format("jdbc").options(url=url, dbtable="current_state").load().collect()
    assert [r.avg_bikes_available for r in got] == [3.0]


def test_poll_source(spark, tmp_path):
    class Feed(BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"data": {"stations": [{"station_id": 1, "num_bikes_available": 4}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(sources.PollSource)
    df = spark.readStream.format("station_poll").option("url", f"http://127.0.0.1:{server.server_port}/").option("interval", "0").load()
    q = df.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            if spark.table("polled").count():
                break
            q.awaitTermination(1)
        r = spark.table("polled").first()
        assert r.station_id == 1 and r.num_bikes_available == 4 and r.ingested_at > 0
    finally:
        q.stop()
        server.shutdown()

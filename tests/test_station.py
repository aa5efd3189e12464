"""Pipeline operators: served records, map, parsing, features, split, state."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockline.config import GridSpec
from dockline.functions import clip, fill_colour
from dockline.operators import clean, evaluate, features, forecast, hotstate, mapview, sequences, serving
from dockline.plans import pipeline
from dockline import sources

T = dt.datetime


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame([(42, "0042", T(2026, 6, 26, 11, 40), T(2026, 6, 26, 11, 45), 10.0, 5.0, 3, T(2026, 6, 26, 11, 45, 28))], "station_id long, station_code string, window_start timestamp, window_end timestamp, avg_bikes_available double, avg_docks_available double, n_observations long, updated_at timestamp")


def test_health(spark):
    assert serving.health(spark) == {"status": "ok", "database": "up"}
    assert serving.health(spark, lambda: 1 / 0) == {"status": "degraded", "database": "down"}


def test_list_lookup_and_persistence(state):
    assert serving.stations(state).first().bikes_available == 10.0
    assert serving.station(state, 42).count() == 1 and serving.station(state, 999999).count() == 0
    r = serving.forecast(state, 42).first()
    assert r.bikes_now == r.pred_t15 == r.pred_t30 == 10.0 and r.method == "persistence"
    assert serving.forecast(state, 999999).count() == 0


def test_model_forecast(spark):
    class Fixed:
        method, target = "trees", "target_15"

        def predict(self, rows):
            return rows.withColumn("pred_target_15", F.lit(4.23))

    latest = spark.createDataFrame([(42, T(2026, 7, 5, 10, 35), 4.0)], "station_id long, ts timestamp, bikes double")
    r = serving.model_forecast(latest, 42, {"pred_t15": Fixed()}).first()
    assert (r.as_of, r.bikes_ref, r.pred_t15, r.method) == ("2026-07-05T10:35:00", 4.0, 4.2, "trees")
    assert serving.model_forecast(latest, 1, {"pred_t15": Fixed()}).count() == 0


def test_map_join(spark):
    avail = spark.createDataFrame([(1, "0001", 5.0, 5.0), (2, "0002", 0.0, 10.0), (3, "0003", 3.0, 2.0)], "station_id long, station_code string, bikes_available double, docks_available double")
    info = spark.createDataFrame([(1, "A", 48.8, 2.3, 10), (2, "B", 48.9, 2.4, 10), (1, None, 1.0, 1.0, 1)], "station_id long, name string, lat double, lon double, capacity int")
    rows = {r.station_id: r for r in mapview.map_rows(avail, info).collect()}
    assert set(rows) == {1, 2} and rows[1].fill_ratio == 0.5 and rows[2].fill_ratio == 0.0 and rows[1].name == "A"
    assert rows[2].color == [255, 40, 60]
    bare = spark.createDataFrame([(1, "A", 48.8, 2.3, None)], info.schema)
    full = spark.createDataFrame([(1, "0001", 4.0, 0.0)], avail.schema)
    assert mapview.map_rows(full, bare).first().fill_ratio == 0.0 and mapview.figure_rows(full, bare).count() == 0


def test_clip_keeps_null(spark):
    r = spark.range(1).select(clip(F.lit(None).cast("double"), F.lit(0.0), F.lit(30.0)).alias("n"), clip(F.lit(44.0), F.lit(0.0), F.lit(30.0)).alias("h"), fill_colour(F.lit(1.0)).alias("c")).first()
    assert r.n is None and r.h == 30.0 and r.c == [0, 220, 60]


def test_parse_is_permissive(spark):
    cases = ['{"station_id": 1, "num_bikes_available": 3}', '{"station_id": 1, "num_bikes_available": "3"}', '{"station_id": 1, "num_bikes_available": 3.0}', '{"station_id": 1, "num_bikes_available": true}', '{"station_id": 1, "num_bikes_available": 99999999999}', "{bad", "[1]", None]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c.encode())) for i, c in enumerate(cases)], "i int, value binary")
    got = [(r.station_id, r.num_bikes_available) for r in clean.parse(df.orderBy("i").coalesce(1)).collect()]
    assert got == [(1, 3), (1, None), (1, None), (1, None), (1, None), (None, None), (None, None), (None, None)]


def test_messages_round_trip(spark):
    rows = spark.createDataFrame([(7, 3)], "station_id long, num_bikes_available int")
    r = clean.to_messages(rows, 123).first()
    assert r.key == "7" and '"ingested_at":123' in r.value


def _windows(spark, rows):
    full = [(k, c, T(2026, 1, 1, h), T(2026, 1, 1, h, 5), b, 1.0, 1) for k, c, h, b in rows]
    return spark.createDataFrame(full, "station_id long, station_code string, window_start timestamp, window_end timestamp, avg_bikes_available double, avg_docks_available double, n_observations long")


def test_upsert_never_goes_back(spark):
    current = _windows(spark, [(1, "a", 5, 1.0), (2, "b", 5, 2.0)])
    batch = _windows(spark, [(1, "a", 4, 9.0), (2, "b", 5, 8.0), (2, "b", 3, 7.0), (3, None, 1, 6.0)])
    got = {r.station_id: r.avg_bikes_available for r in hotstate.merge(current, batch).collect()}
    assert got == {1: 1.0, 2: 8.0, 3: 6.0}
    assert hotstate.merge(current.limit(0), batch).count() == 3


def test_features_agree_with_pandas(spark):
    rng = np.random.default_rng(5)
    frames, want = [], []
    for sid in (1, 2):
        k = np.flatnonzero(rng.random(400) > 0.3)
        frames.append(pd.DataFrame({"station_id": sid, "bin_epoch": 1_772_000_000 // 300 * 300 + k * 300, "bikes": rng.integers(0, 20, len(k)), "docks": rng.integers(0, 20, len(k))}))
        g = frames[-1].set_index("bin_epoch").reindex(range(frames[-1].bin_epoch.min(), frames[-1].bin_epoch.max() + 1, 300))
        raw, ff = g.bikes, g.bikes.ffill(limit=2)
        want.append(pd.DataFrame({"station_id": sid, "bin_epoch": g.index.to_numpy(), "bikes": ff, "bikes_lag10": ff.shift(2), "bikes_roll_std30": ff.rolling(6).std(), "target_30": raw.shift(-6)}).reset_index(drop=True))
    got = features.features(features.dense(spark.createDataFrame(pd.concat(frames)), GridSpec()), GridSpec()).withColumn("bin_epoch", F.unix_timestamp("ts")).toPandas()
    want = pd.concat(want)
    m = got.merge(want, on=["station_id", "bin_epoch"], suffixes=("", "_w"))
    assert len(m) == len(want) == len(got)
    for c in ("bikes", "bikes_lag10", "bikes_roll_std30", "target_30"):
        assert np.allclose(m[c].astype(float), m[c + "_w"].astype(float), equal_nan=True, atol=1e-9), c


def test_features_do_not_see_the_future(spark):
    grid = sources.synthetic_grid(spark, 2, 1)
    cut = 1_781_913_600 + 150 * 300
    changed = grid.withColumn("bikes", F.when(F.col("bin_epoch") > cut, F.lit(99)).otherwise(F.col("bikes")))
    spec = GridSpec()
    f = lambda g: {tuple(r) for r in features.features(features.dense(g, spec), spec).where(F.unix_timestamp("ts") <= cut).select("station_id", "ts", *spec.feature_columns).collect()}
    assert f(grid) == f(changed)


def test_split_keeps_the_embargo(spark):
    spec = GridSpec()
    data = pipeline.dataset(sources.synthetic_grid(spark, 3, 3), spec).withColumn("epoch", F.unix_timestamp("ts"))
    parts = evaluate.split(evaluate.by_horizon(data.select("station_id", "epoch", "bikes", *spec.target_columns), spec), spec)
    r = parts.groupBy("horizon").agg(F.max(F.when(F.col("part") == "train", F.col("epoch"))).alias("a"), F.min(F.when(F.col("part") == "test", F.col("epoch"))).alias("b"), F.first("cut").alias("cut")).collect()
    assert len(r) == 4 and all(x.a + 7200 <= x.cut < x.b for x in r)
    scores = {x.horizon: x for x in pipeline.persistence_scores(data.drop("epoch"), spec).collect()}
    assert scores["target_15"].mae < scores["target_120"].mae


def test_embargo_must_cover_horizons():
    with pytest.raises(ValueError):
        GridSpec(embargo=6)


@pytest.mark.parametrize("n,total", [(1, 5), (2, 9), (7, 50), (10, 10), (20, 6)])
def test_systematic_sample(spark, n, total):
    ids = spark.range(total).selectExpr("id * 3 as k")
    got = sorted(r.k for r in sequences.systematic_sample(ids, "k", n).collect())
    want = list(range(0, 3 * total, 3)) if total <= n else [3 * i for i in sorted(set(np.linspace(0, total - 1, n).astype(int)))]
    assert got == want


def test_trees_beat_nothing_but_run(spark, tmp_path):
    spec = GridSpec()
    data = pipeline.dataset(sources.synthetic_grid(spark, 2, 2), spec)
    for delta in (False, True):
        m = forecast.Trees("target_15", delta, trees=3, depth=3).fit(data)
        m.save(str(tmp_path / f"m{delta}"))
        again = forecast.Trees("target_15", delta).load(str(tmp_path / f"m{delta}"))
        rows = again.predict(forecast.latest_rows(data)).collect()
        assert len(rows) == 2 and all(r.pred_target_15 is not None for r in rows)
    with pytest.raises(ValueError):
        forecast.Trees("target_15").predict(data)
    with pytest.raises(ValueError):
        forecast.Trees("target_15", trees=1).fit(data.limit(0))


def test_snapshot_and_reference_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"data": {"stations": [{"station_id": 1, "stationCode": "01", "num_bikes_available": 2}, {"station_id": 2}]}}')
    (tmp_path / "r.json").write_text('[{"station_id": 1, "name": "A", "lat": 1.0, "lon": 2.0, "capacity": null}]')
    assert sorted(r.station_id for r in sources.snapshot_file(spark, str(tmp_path / "s.json")).collect()) == [1, 2]
    assert sources.station_reference(spark, str(tmp_path / "r.json")).first().name == "A"


def test_history_prunes_partitions(spark, tmp_path):
    spark.sql("select id, date'2026-01-01' + cast(id as int) as event_date from range(5)").write.partitionBy("event_date").parquet(str(tmp_path / "h"))
    df = sources.history(spark, str(tmp_path / "h"), first="2026-01-03", last="2026-01-04")
    assert df.count() == 2 and "PartitionFilters: [isnotnull(event_date" in df._jdf.queryExecution().toString()


def test_measures_are_rebuilt_by_date(spark, tmp_path):
    from dockline.streaming import sinks

    message = '{"station_id": 1, "stationCode": "1", "num_bikes_available": 2, "is_installed": 1, "last_reported": 5, "ingested_at": %s}'
    rows = spark.createDataFrame([(bytearray((message % t).encode()),) for t in (1_772_400_000, 1_772_500_000, "null")], "value binary")
    for _ in range(2):
        sinks.write_measures(pipeline.measures(rows), str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 2 and back.select("ingest_date").distinct().count() == 2
    assert pipeline.grid(back).count() == 2


def test_peek(spark):
    df = spark.createDataFrame([(1, 5, b"k", b"v"), (0, 9, b"a", b"b")], "partition int, offset long, key binary, value binary")
    assert [tuple(r) for r in sources.peek(df, 1).collect()] == [(0, 9, "a", "b")]


def test_served_rows_are_read_once(spark):
    class Fixed:
        method, target = "trees", "target_15"

        def predict(self, rows):
            return rows.withColumn("pred_target_15", F.lit(4.25))

    latest, reads = spark.createDataFrame([(42, T(2026, 7, 5, 10, 35), 4.0)], "station_id long, ts timestamp, bikes double"), []
    served = serving.Served(lambda: reads.append(1) or latest, lambda: {"pred_t15": Fixed()})
    assert served.forecast(42).first().pred_t15 == 4.3 and served.forecast(7).count() == 0 and len(reads) == 1
    served.refresh()
    assert len(reads) == 2


def test_dataset_is_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(2, 3), (1, 3), (5, 1), (1, 2)], "station_id int, ts int")
    pipeline.write_dataset(rows, str(tmp_path / "d"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "d")).coalesce(1).select("ts", "station_id").collect()] == [(1, 5), (2, 1), (3, 1), (3, 2)]


def test_models_are_scored_and_applied(spark, tiny):
    from dockline.plans.station import QUERIES

    scores, latest = QUERIES["model_metrics"](spark, tiny), QUERIES["predict_latest"](spark, tiny)
    assert scores.columns == ["horizon", "mae_base", "rmse_base", "mae_model", "rmse_model", "gain_mae", "gain_rmse"] and scores.count() == 4
    assert latest.columns == ["station_id", "as_of", "bikes_ref", "pred_t15", "pred_t30", "pred_t60", "pred_t120"] and latest.count() == spark.read.parquet(f"{tiny}/station_dataset.parquet").select("station_id").distinct().count()

"""The core training-data operators against plain versions and odd inputs."""

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pytest

import brute
import variants
from conftest import DATA
from dockline.operators import drift, panes, regular_grid, rolling, snapshots, spikes
from dockline.plans.training import QUERIES

COLUMNS = {
    "p1_found": ["station_id", "bin_epoch"], "p2_found": ["station_id", "bin_epoch"], "p3_found": ["msg_id", "lateness"], "p4_found": ["snapshot_no", "station_id", "change_kind"],
    "p5_reasons": ["msg_id", "reason"], "p7_found": ["feed_id", "file_no", "change_kind", "field_name"]}


def frame(d, name):
    return ds.dataset(f"{d}/{name}.parquet").to_table().to_pandas()


def result(spark, name, d):
    rows = QUERIES[name](spark, d).select(COLUMNS[name]).collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows), "duplicates"
    return out


def expected(name, d):
    if name == "p2_found":
        data = frame(d, "station_dataset")
        data["ts"] = data.ts.dt.tz_localize("UTC")
        return brute.p2(frame(d, "station_grid"), data)
    f, t = {"p1_found": (brute.p1, "station_measures"), "p3_found": (brute.p3, "station_status"), "p4_found": (brute.p4, "station_snapshots"), "p5_reasons": (brute.p5, "station_status"), "p7_found": (brute.p7, "raw_messages")}[name]
    return f(frame(d, t))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_against_plain_version(spark, name, sf):
    d = f"{DATA}/{sf}"
    assert result(spark, name, d) == expected(name, d)


@pytest.mark.parametrize("change", [variants.with_null_rows, variants.with_clashes])
def test_null_rows_and_clashing_columns_change_nothing(spark, tiny, tmp_path, change):
    d = variants.write(tiny, str(tmp_path), change)
    for name in COLUMNS:
        assert result(spark, name, d) == result(spark, name, tiny), name


def test_repeated_rows_count_once(spark, tiny, tmp_path):
    d = variants.write(tiny, str(tmp_path), variants.repeated)
    for name in ("p1_found", "p2_found", "p4_found", "p7_found"):
        assert result(spark, name, d) == result(spark, name, tiny), name


def test_grid_marks_gaps_and_takes_the_freshest(spark):
    df = spark.createDataFrame([(1, 299, 5), (1, 300, 6), (1, 310, 7), (1, 1205, 8), (1, 900, None), (None, 300, 1)], "e int, t long, v int")
    got = [tuple(r) for r in regular_grid.regular_grid(df, "e", "t", "v", 300).orderBy("cell").collect()]
    assert got == [(1, 0, 5, False), (1, 300, 7, False), (1, 600, None, True), (1, 900, None, True), (1, 1200, 8, False)]


def test_grid_survives_a_very_long_gap(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 300 * 1_000_000, 1)], "e int, t long, v int")
    assert regular_grid.missing_cells(df, "e", "t", "v", 300).count() == 999_999


def test_counter_spreads_increments_and_sees_resets(spark):
    df = spark.createDataFrame([(1, 100, 10.0), (1, 400, 40.0), (1, 700, 5.0), (1, 100_000, 9.0)], "e int, t long, v double")
    got = {r.cell: r for r in regular_grid.counter_grid(df, "e", "t", "v", 300, max_gap=3600).collect()}
    assert got[0].increment == pytest.approx(20) and got[300].increment == pytest.approx(10 + 5 * 200 / 300) and got[600].increment == pytest.approx(5 / 3)
    assert got[600].resets == 1 and got[600].covered_s == 100 and not got[600].is_missing
    assert got[900].is_missing and got[900].increment is None
    whole = regular_grid.counter_grid(df, "e", "t", "v", 300)
    assert whole.agg({"increment": "sum"}).first()[0] == pytest.approx(30 + 5 + 4)


def test_rolling_agrees_with_pandas(spark):
    rng = np.random.default_rng(3)
    steps = np.flatnonzero(rng.random(900) > 0.3)
    values = rng.integers(0, 40, len(steps))
    df = spark.createDataFrame(pd.DataFrame({"e": 7, "t": steps * 300, "v": values}))
    got = rolling.rolling_steps(rolling.filled_steps(df, "e", "t", "v", 300, 2), 6, block=50).toPandas().set_index("step_no").sort_index()
    full = pd.Series(values, index=steps, dtype=float).reindex(range(steps.min(), steps.max() + 1)).ffill(limit=2)
    for column, want in (("mean", full.rolling(6).mean()), ("std", full.rolling(6).std())):
        have = got[column].reindex(full.index)
        assert (have.isna() == want.isna()).all() and np.allclose(have.dropna(), want.dropna(), atol=1e-9)


@pytest.mark.parametrize("width", [1, 2, 289, 300, 2016])
def test_rolling_of_any_width(spark, width):
    rng = np.random.default_rng(8)
    values = rng.integers(0, 40, 5000)
    df = spark.createDataFrame(pd.DataFrame({"e": 7, "t": np.arange(-500, 4500) * 300, "v": values}))
    got = rolling.rolling_steps(rolling.filled_steps(df, "e", "t", "v", 300, 0), width).toPandas().set_index("step_no").sort_index()
    full = pd.Series(values, index=range(-500, 4500), dtype=float)
    for column, want in (("mean", full.rolling(width).mean()), ("std", full.rolling(width).std())):
        have = got[column].astype(float)
        assert (have.isna() == want.isna()).all() and np.allclose(have.dropna(), want.dropna(), atol=1e-9)


def test_trailing_days_fill_the_calendar(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 10, 6), (1, 86400 * 8, 7)], "e int, t long, v int")
    got = {r.day_no: (r.total, r.total_7, r.avg_7, r.total_30) for r in rolling.trailing_days(df, "e", "t", "v").collect()}
    assert len(got) == 9 and got[0] == (10, 10, 10 / 7, 10) and got[6][1] == 10 and got[7] == (0, 0, 0.0, 10) and got[8] == (7, 7, 1.0, 17)


def test_lateness_ignores_equal_arrivals(spark):
    df = spark.createDataFrame([(1, 1, 1000, 10), (2, 1, 500, 10), (3, 1, 900, 11), (4, 1, 100, 12), (5, 2, 1, 5)], "id int, e int, ev long, ar long")
    got = {r.id: r.lateness for r in panes.lateness(panes.arrivals(df, "e", "ev", "ar", ["id"]), 600).collect()}
    assert got == {1: "on_time", 2: "on_time", 3: "late", 4: "too_late", 5: "on_time"}


def test_a_late_event_changes_only_windows_over_its_pane(spark):
    base = [(1, e, e + 1, 1) for e in range(0, 3000, 100)]
    values = ["v"]
    make = lambda rows: {(r.window_start): r.n for r in panes.compose_windows(panes.event_panes(panes.arrivals(spark.createDataFrame(rows, "e int, ev long, ar long, v int"), "e", "ev", "ar", values), 300, values), 300, 3, values).collect()}
    before, after = make(base), make([*base, (1, 1250, 9000, 1)])
    assert {k for k in after if after[k] != before.get(k)} == {600, 900, 1200}


def test_emissions_are_revised(spark):
    df = spark.createDataFrame([(1, 10, 15, 2), (1, 320, 325, 4), (1, 20, 400, 4), (1, 5000, 5001, 1), (1, 30, 6000, 9)], "e int, ev long, ar long, v int")
    out = panes.emissions(panes.arrivals(df, "e", "ev", "ar", ["v"]), 300, 60, ["v"], 600).collect()
    first = sorted((r.revision, r.n, r.sum_v) for r in out if r.window_start == 0)
    assert first == [(0, 1, 2), (1, 2, 6)], "the row past the cut-off changes nothing"


def test_snapshots_skip_missing_numbers_and_compare_nulls(spark):
    rows = [(1, 1, 1, "a", 1), (2, 1, 2, None, None), (3, 3, 1, "a", 2), (4, 3, 2, None, None), (5, 3, 1, "b", 1), (6, 3, 3, "c", 0), (7, 4, 3, "c", 0), (8, 4, 2, "x", None)]
    df = spark.createDataFrame(rows, "row_no int, no int, k int, f string, g int")
    got = {(r.number, r.key, r.change_kind, tuple(r.changed_fields or ())) for r in snapshots.snapshot_changes(df, "no", "k", "row_no", ["f", "g"]).collect()}
    assert got == {(3, 1, "changed", ("f",)), (3, 3, "added", ()), (4, 1, "removed", ()), (4, 2, "changed", ("f",))}


def _walk(n, seed):
    rng = np.random.default_rng(seed)
    bikes = np.clip(20 + np.cumsum(rng.integers(-1, 2, n)), 3, 37)
    return [[i + 1, 1, 1000 + 60 * i, int(b), int(40 - b)] for i, b in enumerate(bikes)]


def _implausible(spark, rows, **more):
    df = spark.createDataFrame([tuple(r) for r in rows], "id long, s int, t long, a int, b int")
    return {(r.tie, r.reason) for r in spikes.implausible(df, "s", "t", "id", "a", "b", **more).collect()}


def test_spikes_bounds_and_moves(spark):
    rows = _walk(300, 1)
    for i, v in ((50, -3), (90, 99), (91, 99)):
        rows[i][3] = v
    for i in (150, 151, 152):
        rows[i][3], rows[i][4] = (rows[149][3] + 20) % 41, 20
    for i in range(220, 300):  # a move that stays
        rows[i][3] = 39 if rows[219][3] < 20 else 0
    got = _implausible(spark, rows)
    frame_ = pd.DataFrame(rows, columns=["msg_id", "station_id", "last_reported", "num_bikes_available", "num_docks_available"])
    assert got == brute.p5(frame_)
    assert {(51, "bounds"), (91, "bounds"), (92, "bounds")} <= got and not any(221 < i < 279 and k == "spike" for i, k in got)


@pytest.mark.parametrize("nulls", [0, 7, 8, 10, 100, 5000])
def test_levels_are_found_beyond_any_stretch_without_values(spark, nulls):
    """Also over the borders of chunks."""
    head, tail = _walk(4090, 1), _walk(300, 5)
    tail = [[4090 + nulls + i + 1, 1, 1000 + 60 * (4090 + nulls + i), head[-1][3], head[-1][4]] for i, _ in enumerate(tail)]
    gap = [[4090 + i + 1, 1, 1000 + 60 * (4090 + i), None, None] for i in range(nulls)]
    for i, r in enumerate(tail):
        r[3], r[4] = r[3] + i % 2, r[4] - i % 2
    spike = head[-1][3] + (20 if head[-1][3] < 20 else -20)
    for at in (-2, -1):
        head[at] = [*head[at][:3], spike, 20]
    for r in head[-40:-2]:
        r[3], r[4] = tail[0][3], tail[0][4]
    rows = [*head, *gap, *tail]
    got = {i for i, k in _implausible(spark, rows) if k == "spike"}
    frame_ = pd.DataFrame(rows, columns=["msg_id", "station_id", "last_reported", "num_bikes_available", "num_docks_available"])
    assert {4089, 4090} <= got and got == {i for i, k in brute.p5(frame_) if k == "spike"}


def test_measures_with_fractions(spark):
    rows = [[i + 1, 1, 60 * i, 10.0 + (0.25 if i % 2 else 0.0), 10.0] for i in range(200)]
    rows[100][3] = 17.9
    for i in range(120, 190):
        rows[i][3] = 10.5
    df = spark.createDataFrame([tuple(r) for r in rows], "id long, s int, t long, a double, b double")
    got = {(r.tie, r.reason) for r in spikes.implausible(df, "s", "t", "id", "a", "b", share=0.3, suspect=0.2).collect()}
    assert got == {(101, "spike")} | {(i + 1, "stuck") for i in range(120, 190)}


def test_stuck_stretch_over_chunk_borders(spark):
    rows = _walk(9000, 2)
    for i in range(4050, 4250):
        rows[i][3], rows[i][4] = 20, 20
    rows[4200][3] = None
    got = {i for i, k in _implausible(spark, rows) if k == "stuck"}
    assert set(range(4052, 4200)) <= got and 4201 not in got and 4230 not in got
    old = [[i + 1, 1, 5, 4, 6] for i in range(500)]
    assert not _implausible(spark, old), "one old report time sent again and again is no case"


def _messages(spark, files):
    rows = [(1, n + 1, i, None if v is None else v.encode()) for n, lines in enumerate(files) for i, v in enumerate(lines)]
    return spark.createDataFrame(rows, "feed_id int, file_no int, line_no int, msg_value binary")


def test_drift_steps(spark):
    a = ['{"station_id": 5, "is_renting": 1, "old": "x"}'] * 3 + ["", "null", "[1]", '{"station_id": 5, "odd', None]
    b = ['{"sid": 5, "is_renting": true, "tag": {"k": 1}}'] * 3 + ['{"sid": "6"}']
    c = ['{"sid": 5, "is_renting": true, "tag": {"k": 1}, "n": null}', '{"sid": 6.5}']
    got = {(r.file_no, r.change_kind, r.field_name) for r in drift.migrations(_messages(spark, [a, b, c]), "feed_id", "file_no", "line_no", "msg_value").collect()}
    assert got == {(2, "renamed", "sid"), (2, "retyped", "is_renting"), (2, "removed", "old"), (2, "added", "tag")}


def test_two_renames_in_one_step(spark):
    a = [f'{{"is_renting": {i % 2}, "is_returning": {i % 2}}}' for i in range(4)]
    b = [f'{{"rentalOpen": {i % 2}, "returning": {i % 2}}}' for i in range(4)]
    m = _messages(spark, [a, b])
    steps = drift.migrations(m, "feed_id", "file_no", "line_no", "msg_value")
    assert {(r.change_kind, r.old_name, r.field_name) for r in steps.collect()} == {("renamed", "is_renting", "rentalOpen"), ("renamed", "is_returning", "returning")}


def test_what_is_a_record(spark):
    lines = ['\t{"k": 1}\r\n', '{"k": 1} {"k": 2}', '{"k": "a} {b"}', '{"k": 1} x', '{"k": 12345678901234567890}', '{"k": 2.0}', '{"k": NaN}', '{"k": null}', "{'k': 1}"]
    got = {(r.line_no, r.name, r.kind) for r in drift.fields(_messages(spark, [lines]), "feed_id", "file_no", "line_no", "msg_value").collect()}
    assert got == {(0, "k", "integer"), (2, "k", "string"), (4, "k", "integer"), (5, "k", "number")}


def test_versions_count_changes(spark):
    a, b = ['{"x": 1}'], ['{"x": "1"}']
    prints = drift.fingerprints(drift.profiles(drift.fields(_messages(spark, [a, a, b, a]), "feed_id", "file_no", "line_no", "msg_value"))).orderBy("file_no").collect()
    assert [r.version for r in prints] == [1, 1, 2, 3] and prints[0].fingerprint == prints[3].fingerprint != prints[2].fingerprint


RAW = ("feed_id", "file_no", "line_no", "msg_value")


def _table(spark, files, **more):
    m = _messages(spark, files)
    cells = drift.fields(m, *RAW)
    routed = drift.routes(drift.profiles(cells), drift.migrations(m, *RAW))
    return drift.unified(cells, routed, **more).orderBy("file_no", "line_no").collect(), routed


def test_unified_table_casts_and_follows_names(spark):
    a = ['{"station_id": 5, "is_renting": 1, "ingested_at": 1772582460, "num_bikes_available": 7}']
    b = ['{"weird": 6, "is_renting": "yes", "ingested_at": "2026-03-04T00:01:00Z", "num_bikes_available": 7.5}']
    rows, _ = _table(spark, [a, b])
    assert [(r.station_id, r.is_renting, r.ingested_at, r.num_bikes_available, r.station_code) for r in rows] == [(5, 1, 1772582460, 7, None), (6, 1, 1772582460, 7, None)]


def test_names_are_followed_forward_and_defaults_fill(spark):
    a = [f'{{"bike_count": {i}, "u": "x{i}"}}' for i in range(20)]
    b = [f'{{"num_bikes_available": {i}, "u": "x{i}"}}' for i in range(20)]
    rows, _ = _table(spark, [a, b], defaults={"is_installed": 1})
    assert [r.num_bikes_available for r in rows] == [*range(20), *range(20)] and {r.is_installed for r in rows} == {1} and {r.is_renting for r in rows} == {None}


def test_two_fields_for_one_column_are_reported(spark):
    rows, routed = _table(spark, [['{"num_bikes_available": 3, "nbikes": 9}', '{"nbikes": 8}']])
    assert [r.num_bikes_available for r in rows] == [3, 8]
    assert [(r.target, r.kept, r.others) for r in drift.conflicts(routed).collect()] == [("num_bikes_available", "num_bikes_available", ["nbikes"])]


def test_only_changed_fingerprints_are_compared(spark):
    a, b = ['{"x": 1}'], ['{"x": "1"}']
    m = _messages(spark, [a, a, b, [], b])
    changed = drift.changed_files(drift.files(m.unionByName(spark.createDataFrame([(1, 4, 0, None)], m.schema)), *RAW[:2]), drift.fingerprints(drift.profiles(drift.fields(m, *RAW))))
    assert sorted(r.file_no for r in changed.collect()) == [3, 4, 5]

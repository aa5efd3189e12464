"""Runs of repeated events against a plain version."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pytest

import variants
from conftest import DATA
from dockline.llm import queries, runs


def plain(status):
    by = defaultdict(list)
    for r in status.to_dict("records"):
        if not any(pd.isna(r[c]) for c in ("station_id", "last_reported", "num_bikes_available")):
            by[int(r["station_id"])].append((r["last_reported"], int(r["msg_id"]), r["num_bikes_available"]))
    out = set()
    for s, rows in by.items():
        rows.sort()
        i = 0
        while i < len(rows):
            j = i
            while j + 1 < len(rows) and rows[j + 1][2] == rows[i][2]:
                j += 1
            ids = [r[1] for r in rows[i : j + 1]]
            out.add((s, min(ids), max(ids), j - i + 1, int(rows[j][0] - rows[i][0])))
            i = j + 1
    return out


def got(rows):
    return {(r.entity, r.min_tie, r.max_tie, r.n, r.duration) for r in rows.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_found_against_plain_version(spark, sf):
    rows = [tuple(r) for r in queries.p6_found(spark, f"{DATA}/{sf}").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {r[:3] for r in plain(ds.dataset(f"{DATA}/{sf}/station_status.parquet").to_table().to_pandas()) if r[3] >= 5}


@pytest.mark.parametrize("change", [variants.with_null_rows, variants.with_clashes])
def test_null_rows_and_clashing_columns_change_nothing(spark, tiny, tmp_path, change):
    d = variants.write(tiny, str(tmp_path), change)
    assert {tuple(r) for r in queries.p6_found(spark, d).collect()} == {tuple(r) for r in queries.p6_found(spark, tiny).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_runs_against_plain_version(spark, seed, monkeypatch):
    monkeypatch.setattr(runs, "_BROADCAST_OPEN", [0, 50, 100_000][seed])
    rng = np.random.default_rng(seed)
    n = 4000
    f = pd.DataFrame({"msg_id": np.arange(n), "station_id": rng.choice([1, 1, 1, 2], n), "last_reported": np.sort(rng.integers(0, 90_000, n) // (1 if seed else 5000)), "num_bikes_available": (np.cumsum(rng.random(n) < 0.02) % 3).astype(int)})
    assert got(runs.collapse_runs(spark.createDataFrame(f), "station_id", "last_reported", "msg_id", "num_bikes_available")) == plain(f)


def test_one_moment_with_changing_values_is_cut(spark, monkeypatch):
    monkeypatch.setattr(runs, "_BLOCK", 64)
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"msg_id": rng.permutation(3000), "station_id": 1, "last_reported": np.r_[np.full(2500, 7), np.arange(500)], "num_bikes_available": rng.integers(0, 2, 3000)})
    nodes = runs.event_nodes(spark.createDataFrame(f), "station_id", "last_reported", "msg_id", "num_bikes_available")
    whole, cut = (sorted((r.at, r.min_tie, r.id, r.before if r.before is not None else -1) for r in runs.numbered(nodes, k).collect()) for k in (10_000, 100))
    assert whole == cut and len({r[2] for r in cut}) == len(cut)


def test_one_long_run_reaches_its_start(spark):
    f = spark.range(3000).selectExpr("id as m", "1 as s", "id * 7 as t", "5 as v")
    r = runs.collapse_runs(f, "s", "t", "m", "v").collect()
    assert [(x.n, x.first_at, x.last_at, x.min_tie, x.max_tie) for x in r] == [(3000, 0, 2999 * 7, 0, 2999)]


def test_near_identical_runs(spark):
    f = spark.createDataFrame([(i, 1, i, float(v)) for i, v in enumerate([1, 1.4, 1.9, 5, 5.2, 9])], "m int, s int, t int, v double")
    assert sorted((r.n, r.value) for r in runs.collapse_runs(f, "s", "t", "m", "v", tolerance=0.5).collect()) == [(1, 9.0), (2, 5.0), (3, 1.0)]


def test_no_rows(spark):
    assert runs.collapse_runs(spark.createDataFrame([], "s int, t long, m long, v int"), "s", "t", "m", "v").count() == 0

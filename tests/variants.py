"""Copies of the smallest tables with something odd about them."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq

#: Names that the operators use inside.
CLASHES = ["entity", "cell", "value", "time", "rank", "chunk", "own", "n", "key", "number", "seg", "at", "a", "b", "v", "r", "size", "prev", "json", "kind", "name", "text_", "copies", "leaf", "p", "__bucket", "__n"]
TABLES = ["station_info", "station_status", "station_measures", "station_grid", "station_dataset", "station_snapshots", "raw_messages", "documents", "mix_targets"]


def write(source: str, target: str, change) -> str:
    os.makedirs(target, exist_ok=True)
    for t in TABLES:
        pq.write_table(change(t, pq.read_table(f"{source}/{t}.parquet")), f"{target}/{t}.parquet")
    return target


def empty(_, t: pa.Table) -> pa.Table:
    return t.slice(0, 0)


def with_null_rows(_, t: pa.Table) -> pa.Table:
    nulls = pa.table({f.name: pa.nulls(3, f.type) for f in t.schema}, schema=t.schema)
    return pa.concat_tables([nulls, t, nulls])


def with_clashes(_, t: pa.Table) -> pa.Table:
    for c in CLASHES:
        if c not in t.column_names:
            t = t.append_column(c, pa.array(["x"] * len(t)))
    return t


def repeated(_, t: pa.Table) -> pa.Table:
    return pa.concat_tables([t, t])

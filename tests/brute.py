"""Plain row-at-a-time versions of the operators, written from the problem statements only."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from statistics import median


def _rows(frame):
    return [{k: (None if v is None or v != v else v) for k, v in r.items()} for r in frame.to_dict("records")]


def p1(measures):
    bins = defaultdict(set)
    for r in _rows(measures):
        if None not in (r["station_id"], r["ingested_at"], r["num_bikes_available"]):
            bins[int(r["station_id"])].add(int(r["ingested_at"]) // 300 * 300)
    return {(s, b) for s, have in bins.items() for b in range(min(have), max(have), 300) if b not in have}


def p2(grid, dataset):
    have = {(int(r["station_id"]), int(r["bin_epoch"]) // 300): int(r["bikes"]) for r in _rows(grid)}

    def at(s, k):
        return next((have[s, k - i] for i in range(3) if (s, k - i) in have), None)

    out = set()
    for s, ts, m, d in zip(dataset.station_id, dataset.ts, dataset.bikes_roll_mean30, dataset.bikes_roll_std30):
        k = int(ts.timestamp()) // 300
        v = [at(s, k - i) for i in range(6)]
        if None in v:
            continue
        mean = sum(v) / 6
        std = (sum((x - mean) ** 2 for x in v) / 5) ** 0.5
        if abs(m - mean) > 0.01 or abs(d - std) > 0.01:
            out.add((int(s), k * 300))
    return out


def p3(status):
    by = defaultdict(list)
    for r in _rows(status):
        if None not in (r["station_id"], r["last_reported"], r["ingested_at"]):
            by[r["station_id"]].append((r["ingested_at"], r["last_reported"], int(r["msg_id"])))
    out = set()
    for rows in by.values():
        rows.sort()
        top, pending, at = None, None, None
        for arrival, event, msg in rows:
            if arrival != at:
                top, pending, at = pending, pending, arrival
            if top is not None and top > event:
                out.add((msg, "too_late" if top - event > 600 else "late"))
            pending = event if pending is None else max(pending, event)
    return out


def p4(snaps):
    cols = ["station_code", "num_bikes_available", "num_docks_available", "is_installed", "is_renting"]
    state = defaultdict(dict)
    for r in sorted(_rows(snaps), key=lambda r: r["row_no"]):
        state[int(r["snapshot_no"])][int(r["station_id"])] = tuple(r[c] for c in cols)
    out, numbers = set(), sorted(state)
    for a, b in zip(numbers, numbers[1:]):
        x, y = state[a], state[b]
        out |= {(b, k, "added") for k in y.keys() - x.keys()} | {(b, k, "removed") for k in x.keys() - y.keys()}
        out |= {(b, k, "changed") for k in x.keys() & y.keys() if x[k] != y[k]}
    return out


def p5(status):
    by = defaultdict(list)
    for r in _rows(status):
        if r["station_id"] is not None and r["last_reported"] is not None:
            by[r["station_id"]].append((r["last_reported"], int(r["msg_id"]), r["num_bikes_available"], r["num_docks_available"]))
    out = {}
    for rows in by.values():
        rows.sort()
        sums = [b + d for _, _, b, d in rows if b is not None and d is not None]
        size = median(sums) if sums else None
        for _, m, b, d in rows:
            for v in (b, d):
                if v is not None and (v < 0 or size is not None and v > 1.3 * size):
                    out.setdefault(m, set()).add("bounds")
        # stuck
        i = 0
        while i < len(rows):
            j = i
            while j + 1 < len(rows) and rows[j + 1][2:] == rows[i][2:]:
                j += 1
            if None not in rows[i][2:] and len({r[0] for r in rows[i : j + 1]}) >= 60:
                for r in rows[i : j + 1]:
                    out.setdefault(r[1], set()).add("stuck")
            i = j + 1
        # leaves its level for at most three report times, then comes back
        if size is None:
            continue
        far = 0.4 * size
        for c in (2, 3):
            at = defaultdict(list)
            for r in rows:
                if r[c] is not None:
                    at[r[0]].append((r[c], r[1]))
            times = sorted(at)
            level = [at[t][-1][0] for t in times]
            i = 1
            while i < len(times):
                base = level[i - 1]
                for w in (1, 2, 3):
                    if i + w >= len(times):
                        break
                    back = level[i + w]
                    if any(max(min(abs(v - base), abs(v - back)) for v, _ in at[times[i + q]]) <= far for q in range(w)):
                        continue
                    if abs(back - base) <= far and all(abs(v - base) <= far for v, _ in at[times[i + w]]):
                        # the level after must hold, else the return is itself the excursion
                        around = level[max(0, i - 4) : i] + level[i + w : i + w + 4]
                        if sum(abs(v - base) <= far for v in around) > len(around) / 2:
                            for q in range(w):
                                for v, m in at[times[i + q]]:
                                    if min(abs(v - base), abs(v - back)) > far:
                                        out.setdefault(m, set()).add("spike")
                            for q in range(w):
                                level[i + q] = base
                        break
                i += 1
    return {(m, k) for m, ks in out.items() for k in ks}


def _kind(v):
    return {bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(v)]


def p7(raw):
    """Without judging values: a field gone and one new in the same step are a rename if they are the only ones."""
    files = defaultdict(lambda: defaultdict(Counter))
    for f, n, v in zip(raw.feed_id, raw.file_no, raw.msg_value):
        files[f, n]
        try:
            o = json.loads(v)
        except (ValueError, TypeError):
            continue
        if isinstance(o, dict):
            for k, x in o.items():
                if x is not None:
                    files[f, n][k][_kind(x)] += 1
    out = set()
    for f, n in files:
        before = max((m for g, m in files if g == f and m < n), default=None)
        if before is None:
            continue
        a, b = files[f, before], files[f, n]
        gone, new = a.keys() - b.keys(), b.keys() - a.keys()
        if len(gone) == len(new) == 1:
            out.add((f, n, "renamed", next(iter(new))))
        else:
            out |= {(f, n, "added", x) for x in new} | {(f, n, "removed", x) for x in gone}
        out |= {(f, n, "retyped", x) for x in a.keys() & b.keys() if a[x].most_common(1)[0][0] != b[x].most_common(1)[0][0]}
    return out

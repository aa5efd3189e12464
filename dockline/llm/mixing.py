"""Mixing sources to target weights by pivotal dependent rounding.

A source's expected number of copies per record follows from its share; the
whole part is given to every record, the fraction is a copy probability. In
pivotal rounding two probabilities meet and mass (probability times size) moves
at random between them until one is 0 or 1, so the expected size of the mixture
is kept. Records of one leaf group meet in falling order of size; the one record
a leaf leaves open goes up a reduction tree of fan-in ``FAN``. Sizes are taken
in tiers: what the last draw of a tier leaves over or short shifts the
probabilities of the next, smaller tier, so a source misses its share by about
one small record.

Defined results: records without source, of a source without target, and
records of size 0 are never used; a NULL or negative share counts as 0, a NULL
limit as 1; shares are scaled to the sources that have records; the same seed
gives the same mixture; an empty table gives an empty mixture.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.session import cut_lineage

LEAF, FAN = 20_000, 1_000
#: Least size of a tier, falling. What a tier's last draw leaves over or short is asked of the next, smaller one.
TIERS = (4096, 1024, 256, 64, 0)
_EPS = 1e-12


def _tier(i: int):
    inside = F.col("size") >= TIERS[i]
    return inside & (F.col("size") < TIERS[i - 1]) if i else inside


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, share, limit, tokens, records, copies): expected copies per record.

    ``sizes`` has (key, source, size). Without ``total`` the mixture is the
    largest in which every source reaches its share within its limit.
    """
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("asked"), F.greatest(F.coalesce(F.min("max_repeats"), F.lit(1)), F.lit(0)).alias("limit"))
    have = sizes.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("records"))
    both = cut_lineage(want.join(have, "source", "left").withColumn("usable", F.coalesce((F.col("tokens") > 0) & (F.col("asked") > 0) & (F.col("limit") > 0), F.lit(False))))
    # two numbers come to the driver: what the usable sources were asked for together, and how far the tightest of them reaches
    asked = both.where("usable").agg(F.sum("asked")).first()[0] or 1.0
    share = F.when(F.col("usable"), F.col("asked") / asked).otherwise(0.0)
    reach = total if total else both.where("usable").agg(F.min(F.col("limit") * F.col("tokens") / share)).first()[0] or 0.0
    copies = F.least(F.col("limit").cast("double"), F.lit(float(reach)) * share / F.col("tokens"))
    near = F.round(copies)
    return both.select(
        "source", "asked", share.alias("share"), "limit", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"),
        F.when(F.col("usable"), F.when(F.abs(copies - near) < 1e-9, near).otherwise(copies)).otherwise(0.0).alias("copies"))


def _pivot(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``p`` so that the sum of p times size is kept; the index still open, or -1."""
    out, open_at = p.copy(), -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if out[j] <= _EPS or out[j] >= 1 - _EPS:
            out[j] = round(out[j])
            continue
        if open_at < 0:
            open_at = j
            continue
        i, ratio = open_at, sizes[j] / sizes[open_at]
        rise, fall = min(1 - out[i], out[j] * ratio), min(out[i], (1 - out[j]) * ratio)
        move = rise if draws[j] * (rise + fall) < fall else -fall
        out[i] += move
        out[j] -= move / ratio
        open_at = -1
        for k in (i, j):
            if out[k] <= _EPS or out[k] >= 1 - _EPS:
                out[k] = round(out[k])
            else:
                open_at = k
    return out, open_at


def _rounder(seed: int, level: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "key"], ascending=False, kind="stable")
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{level}/{group['source'].iloc[0]}/{group['leaf'].iloc[0]}".encode()))
        p, left = _pivot(group["p"].to_numpy(), group["size"].to_numpy(), rng)
        if last and left >= 0:
            p[left], left = float(rng.random() < p[left]), -1
        return group.assign(p=p, is_open=np.arange(len(p)) == left)

    return run


def pivotal_rounding(fractions: DataFrame, depth: int, seed: int = 1) -> DataFrame:
    """(key, source, size, p) with p rounded to 0 or 1; sums of p times size are kept but for the last draw of a source.

    ``fractions`` has (key, source, size, p, leaf); ``depth`` is the number of levels above the leaves.
    """
    schema = fractions.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", is_open boolean"
    done, level, current = [], 0, fractions
    while True:
        out = cut_lineage(current.groupBy("source", "leaf").applyInPandas(_rounder(seed, level, level == depth), schema))
        done.append(out.where("not is_open").drop("is_open", "leaf"))
        if level == depth:
            break
        current = out.where("is_open").drop("is_open").withColumn("leaf", F.expr(f"leaf div {FAN}"))
        level += 1
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def mixture(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1) -> DataFrame:
    """(key, source, size, copies) of the records used, from (key, source, size)."""
    usable = sizes.where(F.col("source").isNotNull() & (F.col("size") > 0))
    plans = cut_lineage(plan(usable, targets, total).where("copies > 0"))
    largest = plans.agg(F.max("records")).first()[0] or 0
    depth, groups = 0, -(-largest // LEAF)
    while groups > 1:
        depth, groups = depth + 1, -(-groups // FAN)
    # the plan has one row per source of the targets; above a thousand it isn't broadcast
    small = F.broadcast(plans) if plans.count() <= 1_000 else plans
    leaves = F.greatest(F.lit(1), F.ceil(F.col("records") / LEAF))
    each = usable.join(small.select("source", "copies", "records"), "source").withColumn("whole", F.floor("copies"))
    fractions = each.select("key", "source", "size", (F.col("copies") - F.col("whole")).alias("p"), F.pmod(F.xxhash64("key"), leaves).cast("bigint").alias("leaf"))
    # one row per source and tier
    tiers = cut_lineage(fractions.groupBy("source").agg(*[
        f(F.when(_tier(i), e)).alias(f"{n}_{i}") for i in range(len(TIERS)) for n, f, e in (("tokens", F.sum, F.col("size")), ("asked", F.sum, F.col("p") * F.col("size")))]))
    parts, carried = [], tiers.select("source", F.lit(0.0).alias("owed"))
    for i in range(len(TIERS)):
        shift = F.coalesce(F.try_divide(F.col("owed"), F.col(f"tokens_{i}")), F.lit(0.0))
        shifts = carried.join(tiers, "source").select("source", shift.alias("shift"))
        now = fractions.where(_tier(i)).join(shifts, "source").withColumn("p", F.when((F.col("p") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.col("shift")))).otherwise(0.0)).drop("shift")
        parts.append(pivotal_rounding(now.select("key", "source", "size", "p", "leaf"), depth, seed + i))
        got = parts[-1].groupBy("source").agg(F.sum(F.col("p") * F.col("size")).alias("got"))
        carried = cut_lineage(carried.join(tiers, "source").join(got, "source", "left").select(
            "source", (F.col("owed") + F.coalesce(f"asked_{i}", F.lit(0.0)) - F.coalesce("got", F.lit(0.0))).alias("owed")))
    rounded = _union(parts)
    wholes = small.select("source", F.floor("copies").alias("whole"))
    return rounded.join(wholes, "source").select("key", "source", "size", (F.col("whole") + F.col("p")).cast("int").alias("copies")).where("copies > 0")


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, records, copies, most_repeats, max_repeats) in per cent; targets without records appear with 0."""
    by = mixed.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.count("*").alias("records"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    everything = by.agg(F.sum("tokens")).first()[0] or 0
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    return out.select(
        "source", "target_share", F.round(F.coalesce(F.try_divide(100 * F.col("tokens"), F.lit(everything)), F.lit(0.0)), 4).alias("actual_share"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "records", "copies", "most_repeats")], "max_repeats")

"""Implausible spikes in measurements.

Per source: a Hampel filter (rolling median and median absolute deviation over
the neighbouring report times), run lengths of stuck values, and physical
bounds. The source's size is the median of bikes plus docks.

Defined results: rows without source or report time take no part; a NULL
measurement is never a spike and ends a stretch; report times are read once
however often they are repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockline.operators.ordering import ranked, with_halo
from dockline.session import cut_lineage

_BUCKET = 21_600


def _median(sorted_array: Column) -> Column:
    n = F.size(sorted_array)
    return (F.element_at(sorted_array, 1 + ((n - 1) / 2).cast("int")) + F.element_at(sorted_array, 1 + (n / 2).cast("int"))) / 2


def source_sizes(rows: DataFrame) -> DataFrame:
    """(source, size): median of a + b, from counts per sum so that a hot source is pre-aggregated."""
    sums = rows.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("source", (F.col("a") + F.col("b")).alias("s")).agg(F.count("*").alias("n"))
    return sums.groupBy("source").agg(F.percentile("s", F.lit(0.5), F.col("n")).alias("size"))


def _pair(narrow: bool) -> Column:
    """Both measures as one comparable value, NULL if either is; of two 32-bit integers one long, which aggregates without sorting."""
    both = F.shiftleft(F.col("a").cast("bigint"), 32).bitwiseOR(F.col("b").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))) if narrow else F.struct("a", "b")
    return F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), both)


def report_times(rows: DataFrame) -> DataFrame:
    """One row per (source, at): extremes and last value of each measure, first and last pair, whether all pairs are equal."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("tie")))
    return rows.groupBy("source", "at").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("a", "b") for n, f in (("lo", F.min), ("hi", F.max), ("rep", last))],
        F.min_by("pair", "tie").alias("enter"), F.max_by("pair", "tie").alias("leave"),
        ((F.count("pair") == 0) | ((F.count("pair") == F.count("*")) & (F.min("pair") == F.max("pair")))).alias("pure"))


def _apart(c: str, level: Column) -> Column:
    """How far the furthest value of a time is from a level."""
    return F.greatest(F.abs(F.col(f"hi_{c}") - level), F.abs(F.col(f"lo_{c}") - level))


def deviations(times: DataFrame, measures: tuple[str, ...], suspect: float, sigmas: float, reach: int, chunk: int = 4096) -> DataFrame:
    """Of ``times`` (ranked, with ``size``) the suspect ones and the calm ones beside a time that isn't calm, with ``chunk``, ``dev_*`` and ``calm_*`` per measure.

    A time is suspect if one of its values is further from the rolling median
    over ``reach`` times on either side than ``suspect`` sizes and ``sigmas``
    scaled median absolute deviations.
    """
    near = Window.partitionBy("source", "chunk").orderBy("rank").rowsBetween(-reach, reach)
    out = with_halo(times, chunk, reach)
    for c in measures:
        out = out.withColumn(f"near_{c}", F.collect_list(f"rep_{c}").over(near))
    out = out.where("own")
    for c in measures:
        hi, lo, known = F.col(f"hi_{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}").isNotNull() & F.col("size").isNotNull()
        # most neighbourhoods are too narrow for any suspect; only the others are sorted
        wide = F.greatest(F.array_max(f"near_{c}"), hi) - F.least(F.array_min(f"near_{c}"), lo) > F.col("size") * suspect
        out = out.withColumn(f"med_{c}", F.when(known & wide, _median(F.sort_array(f"near_{c}"))))
        off = F.coalesce(_apart(c, F.col(f"med_{c}")), F.lit(0.0)) > F.col("size") * suspect
        out = out.withColumn(f"mad_{c}", F.when(known & wide & off, _median(F.sort_array(F.expr(f"transform(near_{c}, x -> abs(x - med_{c}))")))))
        dev = F.when(known, F.coalesce(_apart(c, F.col(f"med_{c}")) > F.greatest(F.col("size") * suspect, F.col(f"mad_{c}") * (1.4826 * sigmas)), F.lit(False)))
        out = out.withColumn(f"dev_{c}", dev).drop(f"near_{c}", f"mad_{c}", f"med_{c}")
    along, needed = Window.partitionBy("source", "chunk").orderBy("rank"), F.lit(False)
    for c in measures:
        out = out.withColumn(f"calm_{c}", F.coalesce(~F.col(f"dev_{c}"), F.lit(False))).withColumn(f"dev_{c}", F.coalesce(f"dev_{c}", F.lit(False)))
    for c in measures:
        # the first and the last row of a chunk have no neighbour, so a chunk's outermost calm times stay
        alone = ~F.coalesce(F.lag(f"calm_{c}").over(along), F.lit(False)) | ~F.coalesce(F.lead(f"calm_{c}").over(along), F.lit(False))
        out = out.withColumn(f"beside_{c}", F.col(f"calm_{c}") & alone)
        needed = needed | F.col(f"dev_{c}") | F.col(f"beside_{c}")
    return out.where(needed).select("source", "chunk", "rank", "at", "size", *[f"{k}_{c}" for c in measures for k in ("hi", "lo", "rep", "dev", "calm", "beside")])


def spikes(suspected: DataFrame, c: str, share: float, longest: int) -> DataFrame:
    """(source, at, level, back): times at which measure ``c`` spikes, with the levels before and after.

    A spike is a stretch of at most ``longest`` suspect times between two calm ones
    that agree, with a value more than ``share`` sizes from both, however many
    times without a value lie between. Levels beyond a chunk come from one row per chunk.
    """
    along, back = Window.partitionBy("source", "chunk").orderBy("rank"), Window.partitionBy("source", "chunk").orderBy(F.desc("rank"))
    few = suspected.where(f"dev_{c} or beside_{c}").select("source", "chunk", "rank", "at", "size", f"hi_{c}", f"lo_{c}", F.col(f"rep_{c}").alias("v"), F.col(f"dev_{c}").alias("dev"), F.col(f"calm_{c}").alias("calm"))
    seen = F.sum(F.col("dev").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    level = F.when(F.col("calm"), F.struct("v", "seen"))
    few = few.withColumn("seen", seen).withColumn("level", level)
    latest = F.last("level", ignorenulls=True)
    few = few.withColumn("p", latest.over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn("q", latest.over(back.rowsBetween(Window.unboundedPreceding, -1)))
    # one row per chunk: suspect times before it, the last level of the chunks before and the first of those after
    ends = few.groupBy("source", "chunk").agg(F.count_if("dev").alias("k"), F.min_by("level", F.when(F.col("calm"), F.col("rank"))).alias("head"), F.max_by("level", F.when(F.col("calm"), F.col("rank"))).alias("tail"))
    chunks, rchunks = Window.partitionBy("source").orderBy("chunk"), Window.partitionBy("source").orderBy(F.desc("chunk"))
    before = ends.withColumn("offset", F.coalesce(F.sum("k").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    moved = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.col(f"{x}.v").alias("v"), (F.col(f"{x}.seen") + F.col("offset")).alias("seen")))
    before = before.withColumns({"head": moved("head"), "tail": moved("tail")})
    before = before.withColumn("p_far", F.last("tail", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))).withColumn("q_far", F.last("head", ignorenulls=True).over(rchunks.rowsBetween(Window.unboundedPreceding, -1)))
    judged = few.where("dev").join(before.select("source", "chunk", "offset", "p_far", "q_far"), ["source", "chunk"]).withColumn("p", F.coalesce(moved("p"), "p_far")).withColumn("q", F.coalesce(moved("q"), "q_far"))
    a, b, far = F.col("p.v"), F.col("q.v"), F.col("size") * share
    return judged.where((F.col("q.seen") - F.col("p.seen") <= longest) & (F.abs(a - b) <= far) & (_apart(c, a) > far) & (_apart(c, b) > far)).select("source", "at", a.alias(f"from_{c}"), b.alias(f"back_{c}"))


def stuck_halves(times: DataFrame, least: int, chunk: int = 4096) -> DataFrame:
    """(source, at, half) of report times inside a stretch of at least ``least`` times with equal pairs.

    A time with several pairs ends one stretch with its first pair (half 0) and
    may begin another with its last (half 1). Stretches are counted per chunk;
    those that touch a chunk's border are joined over the few border rows.
    """
    halves = F.when(F.col("pure"), F.array(F.struct(F.lit(0).alias("half"), F.col("enter").alias("pair")))).otherwise(
        F.array(F.struct(F.lit(0).alias("half"), F.col("enter").alias("pair")), F.struct(F.lit(1).alias("half"), F.col("leave").alias("pair"))))
    items = times.select("source", "at", "rank", F.expr(f"rank div {chunk}").alias("chunk"), F.explode(halves).alias("h")).select("source", "at", "rank", "chunk", "h.half", "h.pair")
    w = Window.partitionBy("source", "chunk").orderBy("rank", "half")
    whole = F.col("pair").isNotNull()
    joins = whole & (F.col("half") == 0) & F.coalesce(F.col("pair") == F.lag("pair").over(w), F.lit(False))
    segmented = (
        items.withColumn("joins", joins)
        .withColumn("seg", F.sum((~F.col("joins")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("at_end", F.lead("rank").over(w).isNull())
    )
    parts = segmented.groupBy("source", "chunk", "seg").agg(
        F.first("pair").alias("pair"), F.count("*").alias("n"), F.max("at_end").alias("at_end"), F.min("half").alias("half"), F.min(F.struct("rank", "half")).alias("lead"))
    parts = parts.withColumn("at_start", F.col("seg") == 1)
    alone = parts.where(~F.col("at_start") & ~F.col("at_end") & (F.col("n") >= least) & whole).select("source", "chunk", "seg")
    edge = Window.partitionBy("source").orderBy("chunk", "seg")
    prev = F.lag(F.struct("chunk", "at_end", "pair")).over(edge)
    goes_on = F.col("at_start") & whole & (F.col("lead.half") == 0) & F.coalesce((F.col("prev.chunk") == F.col("chunk") - 1) & F.col("prev.at_end") & (F.col("prev.pair") == F.col("pair")), F.lit(False))
    border = (
        parts.where("at_start or at_end").withColumn("prev", prev)
        .withColumn("run", F.sum((~goes_on).cast("int")).over(edge.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy("source", "run")))
        .where((F.col("total") >= least) & whole)
        .select("source", "chunk", "seg")
    )
    found = alone.unionByName(border)
    return segmented.where(whole).join(found, ["source", "chunk", "seg"], "left_semi").select("source", "at", "half")


def implausible(df: DataFrame, source: str, at: str, tie: str, a: str, b: str, share: float = 0.4, above: float = 1.3, longest: int = 3, stuck: int = 60, reach: int = 6, suspect: float = 0.3, sigmas: float = 1.0) -> DataFrame:
    """(tie, reason): rows out of bounds, spiking or stuck; a row may have several reasons."""
    rows = df.where(F.col(source).isNotNull() & F.col(at).isNotNull()).select(
        F.col(source).alias("source"), F.col(at).cast("long").alias("at"), F.col(tie).alias("tie"), F.col(a).alias("a"), F.col(b).alias("b"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("a", "b")]
    narrow = set(kinds) <= {"int", "smallint", "tinyint"}
    # integers are widened before sums, anything else is read as double
    wide = "bigint" if set(kinds) <= {"int", "smallint", "tinyint", "bigint"} else "double"
    rows = rows.withColumns({c: F.col(c).cast(wide) for c in ("a", "b")})
    times = cut_lineage(ranked(report_times(rows.withColumn("pair", _pair(narrow))), ["source"], ["at"], F.expr(f"at div {_BUCKET}"), source_sizes(rows)))
    suspected = cut_lineage(deviations(times, ("a", "b"), suspect, sigmas, reach))
    # few rows: a time that spikes in both measures has two
    levels = [f"{k}_{c}" for c in ("a", "b") for k in ("from", "back")]
    found = spikes(suspected, "a", share, longest).unionByName(spikes(suspected, "b", share, longest), allowMissingColumns=True)
    judged = found.groupBy("source", "at").agg(*[F.max(c).alias(c) for c in levels])
    halves = stuck_halves(times, stuck).groupBy("source", "at").agg(F.max(F.col("half") == 0).alias("stuck_0"), F.max(F.col("half") == 1).alias("stuck_1"))
    bad = (F.col("lo_a") < 0) | (F.col("lo_b") < 0) | F.coalesce((F.col("hi_a") > F.col("size") * above) | (F.col("hi_b") > F.col("size") * above), F.lit(False))
    suspects = (
        times.select("source", "at", "size", "enter", "leave", "pure", bad.alias("bad"))
        .join(judged, ["source", "at"], "left").join(halves, ["source", "at"], "left")
        .where(F.col("bad") | F.col("from_a").isNotNull() | F.col("from_b").isNotNull() | F.col("stuck_0") | F.col("stuck_1"))
    )
    hit = cut_lineage(rows.join(suspects, ["source", "at"]).withColumn("pair", _pair(narrow)))
    out_of = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) > F.col("size") * above), F.lit(False))
    spiking = lambda c: F.coalesce(F.least(F.abs(F.col(c) - F.col(f"from_{c}")), F.abs(F.col(c) - F.col(f"back_{c}"))) > F.col("size") * share, F.lit(False)) & F.col(f"from_{c}").isNotNull()
    # in a time with several pairs only the rows before the first change, or from the last one on, belong to the stretch
    mixed = hit.where((F.col("stuck_0") | F.col("stuck_1")) & ~F.col("pure"))
    same = lambda p: F.col("pair").eqNullSafe(F.col(p))
    ends = mixed.groupBy("source", "at").agg(F.min(F.when(~same("enter"), F.col("tie"))).alias("until"), F.max(F.when(~same("leave"), F.col("tie"))).alias("since"))
    held = (F.col("stuck_0") & (F.col("pure") | (F.col("tie") < F.col("until")))) | (F.col("stuck_1") & (F.col("tie") > F.col("since")))
    reasons = F.array_compact(F.array(
        F.when(out_of("a") | out_of("b"), F.lit("bounds")), F.when(spiking("a") | spiking("b"), F.lit("spike")), F.when(F.coalesce(held, F.lit(False)), F.lit("stuck"))))
    return hit.join(ends, ["source", "at"], "left").select("tie", "source", "at", F.explode(reasons).alias("reason"))

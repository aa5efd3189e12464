"""Schemas that drift between files.

Each file gets a fingerprint (its fields and their types); a version of a feed's
schema is a stretch of files with one fingerprint. Only where the fingerprint
changes are the two versions compared and the difference written as explicit
migration steps: added, removed, renamed, retyped. Records are then routed by
version: a field's names are followed through the chained renames, back and
forward, to a target column, values are cast, missing ones get the default.

Defined results: bytes that aren't one JSON object (truncated text, empty
values, arrays, bare null) are no records; JSON null is as a field left out; a
field's type is the one most of its values have, the alphabetically first on a
tie; a file without records has no fields; an object with a name twice is no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockline.session import cut_lineage

#: Other names of the target columns, without case and punctuation.
ALIASES = {
    "station_id": ["stationid", "sid"],
    "station_code": ["stationcode", "code"],
    "num_bikes_available": ["numbikesavailable", "bikesavailable", "nbikes"],
    "num_docks_available": ["numdocksavailable", "docksavailable", "freedocks"],
    "is_installed": ["isinstalled", "installed"],
    "is_renting": ["isrenting", "renting", "rentalopen"],
    "is_returning": ["isreturning", "returning"],
    "last_reported": ["lastreported", "lastreport", "reportedat"],
    "ingested_at": ["ingestedat", "capturedat", "polltime"],
}
#: What a field that a record doesn't have counts as.
DEFAULTS: dict[str, object] = {c: None for c in ALIASES}
TARGET = {c: "string" if c == "station_code" else "long" if c in ("station_id", "last_reported", "ingested_at") else "int" for c in ALIASES}


def fields(messages: DataFrame, feed: str, file_no: str, line_no: str, value: str) -> DataFrame:
    """(feed, file_no, line_no, name, kind, text): every field that isn't null of every record."""
    text = F.btrim(F.col(value).cast("string"), F.lit(" \t\r\n"))
    # the parser stops after the first value; a second object behind it, outside of strings, makes the text malformed
    bare = F.regexp_replace("json", r'"(?:[^"\\]++|\\.)*+"', "")
    trailing = F.col("json").rlike(r"\}\s*\{") & bare.rlike(r"\}\s*\{")
    records = (
        messages.select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), F.col(line_no).alias("line_no"), text.alias("json"))
        .where(F.col("json").startswith("{") & F.col("json").endswith("}") & ~trailing)
        .withColumn("v", F.try_parse_json("json"))
        .where(F.col("v").isNotNull())
    )
    cell = F.expr("schema_of_variant(value)")
    kind = (
        F.when(cell == "BIGINT", "integer").when(cell.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")
        .when(cell.startswith("DECIMAL") | cell.isin("DOUBLE", "FLOAT"), "number")
        .when(cell == "STRING", "string").when(cell == "BOOLEAN", "boolean")
        .when(cell.startswith("OBJECT"), "object").when(cell.startswith("ARRAY"), "array")
    )
    exploded = records.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return exploded.select("feed", "file_no", "line_no", F.col("key").alias("name"), kind.alias("kind"), F.expr("cast(value as string)").alias("text")).where(F.col("kind").isNotNull())


def profiles(cells: DataFrame) -> DataFrame:
    """(feed, file_no, name, kind, n, mean, chars, digits): a field's type and what its values look like."""
    number = F.expr("coalesce(try_cast(text as double), case when lower(text) in ('true', 'yes') then 1.0D when lower(text) in ('false', 'no') then 0.0D end)")
    by_kind = cells.groupBy("feed", "file_no", "name", "kind").agg(
        F.count("*").alias("n"), F.sum(number).alias("s"), F.count(number).alias("m"),
        F.sum(F.length("text")).alias("chars"), F.sum(F.length(F.regexp_replace("text", r"\D", ""))).alias("digits"))
    top = F.max_by(F.struct("kind", "n", "s", "m", "chars", "digits"), F.struct(F.col("n"), -F.ascii("kind")))
    return by_kind.groupBy("feed", "file_no", "name").agg(top.alias("t")).select(
        "feed", "file_no", "name", F.col("t.kind").alias("kind"), F.col("t.n").alias("n"),
        F.when(F.col("t.m") * 2 > F.col("t.n"), F.col("t.s") / F.col("t.m")).alias("mean"), (F.col("t.chars") / F.col("t.n")).alias("chars"), (F.col("t.digits") / F.col("t.n")).alias("digits"))


def files(messages: DataFrame, feed: str, file_no: str) -> DataFrame:
    """(feed, file_no, next_no) of the files delivered, whether or not they hold a record."""
    w = Window.partitionBy("feed").orderBy("file_no")
    return messages.select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no")).where("feed is not null and file_no is not null").distinct().withColumn("prev_no", F.lag("file_no").over(w))


def fingerprints(profile: DataFrame) -> DataFrame:
    """(feed, file_no, fingerprint, version): a hash of the sorted field:type list, and how often it changed in the feed so far, from 1."""
    listing = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "kind"))), ",")
    prints = profile.groupBy("feed", "file_no").agg(F.sha2(listing, 256).substr(1, 16).alias("fingerprint"))
    w = Window.partitionBy("feed").orderBy("file_no")
    new = F.coalesce((F.col("fingerprint") != F.lag("fingerprint").over(w)).cast("int"), F.lit(1))
    return prints.withColumn("new", new).withColumn("version", F.sum("new").over(w).cast("int")).drop("new")


def changed_files(order: DataFrame, prints: DataFrame) -> DataFrame:
    """(feed, file_no, prev_no) of the files whose fingerprint differs from that of the file delivered before; a file without fields has an empty one."""
    w = Window.partitionBy("feed").orderBy("file_no")
    own = F.coalesce("fingerprint", F.lit(""))
    return order.join(prints, ["feed", "file_no"], "left").withColumn("own", own).withColumn("last", F.lag("own").over(w)).where("prev_no is not null and own <> last").select("feed", "file_no", "prev_no")


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _alike(p: str, q: str) -> Column:
    """Distance of two fields' values; NULL if they can't be the same field."""
    pm, qm = F.col(f"{p}.mean"), F.col(f"{q}.mean")
    scale = F.abs(F.log1p(F.abs(pm)) - F.log1p(F.abs(qm)))
    shape = F.abs(F.log1p(F.col(f"{p}.chars")) - F.log1p(F.col(f"{q}.chars"))) + F.abs(F.log1p(F.col(f"{p}.digits")) - F.log1p(F.col(f"{q}.digits")))
    far = F.when(pm.isNotNull() & qm.isNotNull(), scale).when(pm.isNull() & qm.isNull(), shape)
    return F.when((F.col(f"{p}.kind") == F.col(f"{q}.kind")) & (far <= 0.9), far)


def _closest(pairs: DataFrame) -> DataFrame:
    """The pairs to take in each step: from the closest on, each whose fields are both still free."""
    listed = pairs.groupBy("feed", "file_no").agg(F.array_sort(F.collect_list(F.struct("far", "old_name", "new_name", "old", "new"))).alias("all"))
    kind = listed.schema["all"].dataType.simpleString()
    taken = F.aggregate(
        "all", F.array().cast(kind),
        lambda acc, p: F.when(F.exists(acc, lambda x: (x["old_name"] == p["old_name"]) | (x["new_name"] == p["new_name"])), acc).otherwise(F.concat(acc, F.array(p))))
    return listed.select("feed", "file_no", F.inline(taken))


def migrations(messages: DataFrame, feed: str, file_no: str, line_no: str, value: str, cells: DataFrame | None = None) -> DataFrame:
    """(feed, file_no, change_kind, field_name, old_name, old_kind, new_kind): the steps between neighbouring files.

    Only files with another fingerprint than the file before are compared. A
    removed and an added field of one step are a rename when they have the same
    type and values of the same scale and shape; with several candidates the
    closest pair, values first and names second, is taken on both sides, then the
    closest of the fields left over, until no pair is left. Candidates are the
    few fields that one step adds and removes. ``cells`` may hold the parsed :func:`fields`.
    """
    # a row per file and field: read by every comparison below, so the records are parsed once
    profile = cut_lineage(profiles(fields(messages, feed, file_no, line_no, value) if cells is None else cells))
    after = cut_lineage(changed_files(files(messages, feed, file_no), fingerprints(profile)))
    now = profile.join(after, ["feed", "file_no"])
    then = profile.join(after.select("feed", F.col("file_no").alias("next_no"), F.col("prev_no").alias("file_no")), ["feed", "file_no"]).drop("file_no").withColumnRenamed("next_no", "file_no")
    look = ["kind", "mean", "chars", "digits"]
    # a row per field of a changed file
    both = cut_lineage(
        now.select("feed", "file_no", "name", F.struct(*look).alias("new"))
        .join(then.select("feed", "file_no", "name", F.struct(*look).alias("old")), ["feed", "file_no", "name"], "full")
    )
    retyped = both.where("new.kind <> old.kind").select("feed", "file_no", F.lit("retyped").alias("change_kind"), F.col("name").alias("field_name"), F.col("name").alias("old_name"), F.col("old.kind").alias("old_kind"), F.col("new.kind").alias("new_kind"))
    added = both.where("old is null").select("feed", "file_no", F.col("name").alias("new_name"), "new")
    removed = both.where("new is null").select("feed", "file_no", F.col("name").alias("old_name"), "old")
    close = _alike("old", "new") + F.levenshtein(_bare(F.col("old_name")), _bare(F.col("new_name"))) / (F.length("old_name") + F.length("new_name"))
    pairs = removed.join(added, ["feed", "file_no"]).withColumn("far", close).where("far is not null")
    pairs = cut_lineage(_closest(pairs))
    renamed = pairs.select("feed", "file_no", F.lit("renamed").alias("change_kind"), F.col("new_name").alias("field_name"), "old_name", F.col("old.kind").alias("old_kind"), F.col("new.kind").alias("new_kind"))
    gone = removed.join(renamed.select("feed", "file_no", "old_name"), ["feed", "file_no", "old_name"], "left_anti").select(
        "feed", "file_no", F.lit("removed").alias("change_kind"), F.col("old_name").alias("field_name"), "old_name", F.col("old.kind").alias("old_kind"), F.lit(None).cast("string").alias("new_kind"))
    new = added.join(renamed.select("feed", "file_no", F.col("field_name").alias("new_name")), ["feed", "file_no", "new_name"], "left_anti").select(
        "feed", "file_no", F.lit("added").alias("change_kind"), F.col("new_name").alias("field_name"), F.lit(None).cast("string").alias("old_name"), F.lit(None).cast("string").alias("old_kind"), F.col("new.kind").alias("new_kind"))
    return retyped.unionByName(renamed).unionByName(gone).unionByName(new)


def _cast(text: Column, kind: str) -> Column:
    flag = F.when(F.lower(text).isin("true", "yes"), 1).when(F.lower(text).isin("false", "no"), 0).cast("double")
    number = F.expr("try_cast(text as double)")
    stamp = F.unix_timestamp(F.expr("try_cast(text as timestamp)")).cast("double")
    if kind == "string":
        return text
    if kind == "int":
        return F.coalesce(number, flag).cast("int")
    return F.coalesce(F.expr("try_cast(text as bigint)"), F.coalesce(number, F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), stamp)).cast("long"))


def routes(profile: DataFrame, steps: DataFrame) -> DataFrame:
    """(feed, file_no, name, target, place): the target column of each field of each file that has one.

    A field goes where its own name says, else where the names it had in earlier
    or gets in later files say (a feed's renames are one short list: its schema
    changes, not its rows), each first as it stands and then by its aliases. Of
    several fields of a file with one target the one found first has ``place`` 1;
    the others only count where it has no value.
    """
    versions = fingerprints(profile)
    named = profile.select("feed", "file_no", "name").join(versions.select("feed", "file_no", "version"), ["feed", "file_no"])
    per_version = named.groupBy("feed", "version", "name").agg(F.min("file_no").alias("since"))
    rename = F.struct("file_no", "old_name", "field_name")
    chains = steps.where("change_kind = 'renamed'").groupBy("feed").agg(F.array_sort(F.collect_list(rename)).alias("chain"))
    chained = per_version.join(chains, "feed", "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<struct<file_no:int,old_name:string,field_name:string>>")))
    back = F.reverse(F.filter("chain", lambda r: r["file_no"] <= F.col("since")))
    ahead = F.filter("chain", lambda r: r["file_no"] > F.col("since"))
    one = F.array("name")
    former = F.aggregate(back, one, lambda acc, r: F.when(r["field_name"] == F.element_at(acc, -1), F.concat(acc, F.array(r["old_name"]))).otherwise(acc))
    later = F.aggregate(ahead, one, lambda acc, r: F.when(r["old_name"] == F.element_at(acc, -1), F.concat(acc, F.array(r["field_name"]))).otherwise(acc))
    target = F.coalesce(*[F.when(F.col("called") == c, c) for c in ALIASES], *[F.when(_bare(F.col("called")).isin(_plain(c), *others), c) for c, others in ALIASES.items()])
    # the own name counts before former names, those before later ones
    known = chained.select("feed", "version", "name", F.posexplode(F.concat(former, later)).alias("no", "called")).withColumn("target", target).where("target is not null")
    first = known.groupBy("feed", "version", "name").agg(F.min_by("target", "no").alias("target"), F.min("no").alias("no"), F.min_by(F.col("called") != F.col("target"), "no").alias("alias"))
    place = F.row_number().over(Window.partitionBy("feed", "version", "target").orderBy("alias", "no", "name"))
    return named.join(first.withColumn("place", place), ["feed", "version", "name"]).select("feed", "file_no", "name", "target", "place")


def conflicts(routed: DataFrame) -> DataFrame:
    """(feed, file_no, target, kept, others): files in which several fields go to one target column."""
    return routed.groupBy("feed", "file_no", "target").agg(F.min_by("name", "place").alias("kept"), F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.col("name")))).alias("others")).where(F.size("others") > 0)


def unified(cells: DataFrame, routed: DataFrame, defaults: dict[str, object] = DEFAULTS) -> DataFrame:
    """(feed, file_no, line_no, target columns): one table for all records of all files.

    ``cells`` are the :func:`fields`, ``routed`` the :func:`routes`. Numbers with a
    fraction are cut to integers, yes/no and booleans become 1/0, time texts
    become unix seconds; what can't be cast is NULL; what isn't there gets its default.
    """
    placed = cells.join(routed, ["feed", "file_no", "name"], "left")
    columns = []
    for c, kind in TARGET.items():
        mine = F.col("target") == c
        value = F.min_by(F.when(mine, _cast(F.col("text"), kind)), F.when(mine, F.col("place")))
        default = defaults.get(c)
        columns.append((value if default is None else F.when(F.count_if(mine) == 0, F.lit(default)).otherwise(value)).alias(c))
    return placed.groupBy("feed", "file_no", "line_no").agg(*columns)


def _plain(name: str) -> str:
    return name.replace("_", "")

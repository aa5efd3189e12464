"""The pN_ queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.llm import bpe, mixing, residue, runs
from dockline.session import cut_lineage, table


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    out = runs.collapse_runs(table(spark, d, "station_status"), "station_id", "last_reported", "msg_id", "num_bikes_available")
    return out.select(
        F.col("entity").alias("station_id"), F.col("value").alias("num_bikes_available"), F.col("n").alias("n_messages"), F.col("first_at").alias("first_reported"), F.col("last_at").alias("last_reported"),
        F.col("duration").alias("duration_s"), F.col("min_tie").alias("min_msg_id"), F.col("max_tie").alias("max_msg_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_runs(spark, d).where("n_messages >= 5").select("station_id", "min_msg_id", "max_msg_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("source is not null")
    sizes = cut_lineage(docs.select(F.col("doc_id").alias("key"), "source", bpe.token_count(F.col("text")).alias("size")))
    targets = table(spark, d, "mix_targets")
    return mixing.mixture(sizes, targets), targets


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    mixed, _ = _mixture(spark, d)
    return mixed.select(F.col("key").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, targets = _mixture(spark, d)
    return mixing.reached(cut_lineage(mixed), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"), "doc_id", "text", "url")


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What decided on each document: an aligned slot or the form alone, cues, learned page templates or one text under many addresses."""
    return residue.judged(table(spark, d, "documents"), "doc_id", "text", "url").select(F.col("key").alias("doc_id"), "how").distinct()


def p10_rest(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents"), "doc_id", "text", "url").select("doc_id", "source", "n_chars")


QUERIES = {f.__name__: f for f in (p6_found, p6_runs, p8_ids, p9_mixture, p9_shares, p10_found, p10_reasons, p10_rest)}

_RUNS = """WITH r AS (SELECT station_id, last_reported AS t, msg_id, num_bikes_available AS v, num_bikes_available IS DISTINCT FROM lag(num_bikes_available) OVER w AS b FROM station_status
WHERE station_id IS NOT NULL AND last_reported IS NOT NULL AND num_bikes_available IS NOT NULL WINDOW w AS (PARTITION BY station_id ORDER BY last_reported, msg_id)),
i AS (SELECT *, sum(CAST(b AS INTEGER)) OVER (PARTITION BY station_id ORDER BY t, msg_id) AS island FROM r),
runs AS (SELECT station_id, any_value(v) AS num_bikes_available, count(*) AS n_messages, min(t) AS first_reported, max(t) AS last_reported, max(t) - min(t) AS duration_s, min(msg_id) AS min_msg_id, max(msg_id) AS max_msg_id FROM i GROUP BY station_id, island)
"""
SQL: dict[str, str] = {
    "p6_found": _RUNS + "SELECT station_id, min_msg_id, max_msg_id FROM runs WHERE n_messages >= 5",
    "p6_runs": _RUNS + "SELECT * FROM runs",
}

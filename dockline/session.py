"""Session factory and the few session-level helpers every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "dockline", master: str | None = None, s3: dict[str, str] | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution on.

    ``s3`` takes ``endpoint``, ``access_key``, ``secret_key`` for an S3-compatible
    store (path-style, plain HTTP unless the endpoint is https).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if s3:
        settings |= {
            "spark.hadoop.fs.s3a.endpoint": s3["endpoint"],
            "spark.hadoop.fs.s3a.access.key": s3["access_key"],
            "spark.hadoop.fs.s3a.secret.key": s3["secret_key"],
            "spark.hadoop.fs.s3a.path.style.access": "true",
            "spark.hadoop.fs.s3a.connection.ssl.enabled": str(s3["endpoint"].startswith("https")).lower(),
        }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"dockline-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Unlike a local checkpoint the files outlive any executor. The folder is the
    one named by ``spark.checkpoint.dir``; a temporary one is used only where
    that is unset and the master is local.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

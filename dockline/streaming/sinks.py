"""Sinks: keyed current state (Parquet or JDBC), date-partitioned history, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.operators import hotstate, panes
from dockline.schemas import HOT_STATE_DDL


class VersionedTable:
    """A table kept as numbered Parquet snapshots.

    A batch is merged into the newest snapshot and written to the next number;
    a snapshot counts once its ``_SUCCESS`` exists, and the path being read is
    never overwritten. Numbers are batch ids, so a repeated batch is a no-op.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path)) if s.isDirectory()]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def read_before(self, version: int) -> DataFrame | None:
        """The newest snapshot older than ``version``."""
        found = [v for v in self.versions() if v < version]
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def merge(self, batch: DataFrame, batch_id: int, fold) -> None:
        found = self.versions()
        if found and found[-1] >= batch_id:
            return
        current = self.read()
        self.replace(fold(current if current is not None else batch.limit(0), batch), batch_id)

    def replace(self, rows: DataFrame, version: int) -> None:
        """``rows`` as the snapshot ``version``, unless that or a later one exists."""
        found = self.versions()
        if found and found[-1] >= version:
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        fs, path = self._fs()
        for old in found[: max(0, len(found) + 1 - self.keep)]:
            fs.delete(path(f"{self.path}/v={old}"), True)


def hot_state_writer(state: VersionedTable):
    """foreachBatch function: newest window per station, never an older one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        state.merge(batch, batch_id, hotstate.merge)

    return write


def pane_writer(state: VersionedTable, width: int, values: list[str]):
    """foreachBatch function: panes changed by the batch's rows are folded into the stored panes."""

    def fold(current: DataFrame, batch: DataFrame) -> DataFrame:
        changed = panes.event_panes(batch, width, values)
        return panes.merge_panes(current, changed, values) if "pane_start" in current.columns else changed

    def write(batch: DataFrame, batch_id: int) -> None:
        state.merge(batch, batch_id, fold)

    return write


class LateAggregator:
    """Windows of ``per_window`` panes by event time, corrected as late rows arrive, with a cut-off per entity.

    Kept under ``path``: ``panes`` (partial sums of the panes a row may still
    change or a changed window may still cover), ``tops`` (largest event time per
    entity), and a folder per batch of ``closed`` (panes that left the state),
    ``set_aside`` (rows past the cut-off) and ``emitted`` (the windows over the
    panes that the batch changed, made again). An entity keeps at most
    cutoff / width + 2 * per_window panes, however long the stream. Batches must
    come in order of arrival; a repeated batch rewrites its own folders and changes no state.
    """

    def __init__(self, spark: SparkSession, path: str, width: int, values: list[str], cutoff: int, per_window: int = 1):
        self.spark, self.path, self.width, self.values, self.cutoff, self.per_window = spark, path.rstrip("/"), width, values, cutoff, per_window
        self.panes, self.tops = VersionedTable(spark, f"{self.path}/panes"), VersionedTable(spark, f"{self.path}/tops")

    def _classified(self, batch: DataFrame, batch_id: int) -> DataFrame:
        rows = panes.lateness(batch, self.cutoff)
        tops = self.tops.read_before(batch_id)
        if tops is None:
            return rows
        seen = F.col("top") - F.col("event")
        worse = F.when(seen > self.cutoff, "too_late").when((seen > 0) & (F.col("lateness") == "on_time"), "late").otherwise(F.col("lateness"))
        return rows.join(tops, "entity", "left").withColumn("lateness", worse).drop("top")

    def _is_closed(self):
        """No row that still counts can reach a window over the pane."""
        return F.col("pane_start") + self.width * self.per_window <= F.col("top") - self.cutoff

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` as made by :func:`panes.arrivals`."""
        rows = self._classified(batch, batch_id).persist()
        try:
            rows.where("lateness = 'too_late'").write.mode("overwrite").parquet(f"{self.path}/set_aside/batch={batch_id}")
            changed = panes.event_panes(rows.where("lateness <> 'too_late'"), self.width, self.values)
            before, tops = self.panes.read_before(batch_id), self.tops.read_before(batch_id)
            now = rows.groupBy("entity").agg(F.max("event").alias("top"))
            tops = now if tops is None else tops.unionByName(now).groupBy("entity").agg(F.max("top").alias("top"))
            merged = (changed if before is None else panes.merge_panes(before, changed, self.values)).join(tops, "entity").persist()
            touched = changed.select("entity", F.explode(F.array(*[F.col("pane_start") - i * self.width for i in range(self.per_window)])).alias("window_start")).distinct()
            windows = panes.compose_windows(merged.drop("top"), self.width, self.per_window, self.values)
            windows.join(touched, ["entity", "window_start"], "left_semi").write.mode("overwrite").parquet(f"{self.path}/emitted/batch={batch_id}")
            merged.where(self._is_closed()).drop("top").write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch_id}")
            self.panes.replace(merged.where(~self._is_closed()).drop("top"), batch_id)
            self.tops.replace(tops, batch_id)
            merged.unpersist()
        finally:
            rows.unpersist()

    def all_panes(self) -> DataFrame:
        """Open and closed panes together."""
        return self.panes.read().unionByName(self.spark.read.parquet(f"{self.path}/closed").drop("batch"))


def jdbc_writer(url: str, table: str, staging: str, **options: str):
    """foreachBatch function: stage the batch's newest windows, then merge them under the guard. Works with any MERGE dialect."""

    def connect(spark: SparkSession):
        return spark._jvm.java.sql.DriverManager.getConnection(url, options.get("user", ""), options.get("password", ""))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = hotstate.newest(batch).withColumn("updated_at", F.current_timestamp())
        rows.write.format("jdbc").options(url=url, dbtable=staging, **options).mode("overwrite").save()
        others = [c for c in rows.columns if c != "station_id"]
        quoted = ", ".join(f'"{c}"' for c in rows.columns)
        sql = f'''MERGE INTO {table} cur USING {staging} new ON cur."station_id" = new."station_id"
            WHEN MATCHED AND new."window_start" >= cur."window_start" THEN UPDATE SET {", ".join(f'"{c}" = new."{c}"' for c in others)}
            WHEN NOT MATCHED THEN INSERT ({quoted}) VALUES ({", ".join(f'new."{c}"' for c in rows.columns)})'''
        conn = connect(spark)
        try:
            st = conn.createStatement()
            st.execute(sql)
            st.close()
        finally:
            conn.close()

    return write


def create_jdbc_state(spark: SparkSession, url: str, table: str, user: str = "", password: str = "") -> None:
    conn = spark._jvm.java.sql.DriverManager.getConnection(url, user, password)
    try:
        st = conn.createStatement()
        st.execute(HOT_STATE_DDL.format(table=table))
        st.close()
    finally:
        conn.close()


def start_history(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Append validated rows, one folder per event date."""
    dated = rows.withColumn("event_date", F.to_date("event_time"))
    return dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("event_date").outputMode("append").trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def write_measures(rows: DataFrame, path: str) -> None:
    """Rebuild the measures, one folder per capture date."""
    rows.write.mode("overwrite").partitionBy("ingest_date").parquet(path)


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """(key, value) rows to a topic; needs the connector on the class path."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


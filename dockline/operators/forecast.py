"""Forecasters: a DataFrame of features in, the same with predictions out."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.config import GridSpec
from dockline.operators.evaluate import reconstruct


class Forecaster(Protocol):
    method: str

    def predict(self, rows: DataFrame) -> DataFrame: ...


class Persistence:
    """Every horizon is the current value."""

    method = "persistence"

    def __init__(self, horizons: tuple[str, ...] = ("pred_t15", "pred_t30"), now: str = "bikes"):
        self.horizons, self.now = horizons, now

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({h: F.col(self.now) for h in self.horizons}).withColumn("method", F.lit(self.method))


class Trees:
    """Boosted trees for one target: absolute with squared loss, or the change with absolute loss."""

    def __init__(self, target: str, delta: bool = False, spec: GridSpec = GridSpec(), trees: int = 300, depth: int = 6, rate: float = 0.05, seed: int = 0):
        self.target, self.delta, self.spec = target, delta, spec
        self.method = "trees_delta" if delta else "trees"
        self.stages = [
            VectorAssembler(inputCols=spec.feature_columns, outputCol="features"),
            GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", lossType="absolute" if delta else "squared", seed=seed)]
        self.model: PipelineModel | None = None

    def fit(self, rows: DataFrame) -> "Trees":
        label = F.col(self.target) - F.col("bikes") if self.delta else F.col(self.target)
        train = rows.where(F.col(self.target).isNotNull()).withColumn("label", label)
        if train.limit(1).isEmpty():
            raise ValueError(f"no training rows for {self.target}")
        self.model = Pipeline(stages=self.stages).fit(train)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("the model isn't fitted or loaded")
        out = self.model.transform(rows).drop("features")
        value = reconstruct(F.col("bikes"), F.col("prediction"), F.col("capacity")) if self.delta else F.col("prediction")
        return out.withColumn(f"pred_{self.target}", value).drop("prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "Trees":
        self.model = PipelineModel.load(path)
        return self


def latest_rows(rows: DataFrame, order: str = "ts") -> DataFrame:
    """The last row per station."""
    rest = [c for c in rows.columns if c != "station_id"]
    return rows.groupBy("station_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("station_id", "r.*")


class RecurrentAdapter:
    """Hands prepared sequences to a trainer given by the caller (no recurrent library is assumed here)."""

    method = "recurrent"

    def __init__(self, trainer):
        self.trainer = trainer

    def fit(self, sequences: DataFrame, scaler: DataFrame):
        return self.trainer(sequences, scaler)

"""Fitted models kept together: what one folder holds loads by its path alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from logwarden import rules
from logwarden.operators.anomaly import Forest, anomaly_tier
from logwarden.operators.calibrate import PlattModel
from logwarden.operators.classify import Tier, model_tier
from logwarden.operators.learn import TextModel

VERSION = 1


@dataclass(frozen=True)
class Bundle:
    """A classifier with its classes, its calibration and an anomaly forest; any of them can be missing."""

    model: TextModel | None = None
    platt: PlattModel | None = None
    forest: Forest | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """Each part in a folder of its own; what is there is written down last, so a broken save holds nothing."""
        parts = [(name, VERSION) for name in ("model", "platt", "forest") if getattr(self, name) is not None]
        if self.model:
            self.model.save(f"{path}/model")
        if self.platt:
            self.platt.save(spark, f"{path}/platt")
        if self.forest:
            self.forest.save(spark, f"{path}/forest")
        spark.createDataFrame(parts, "part string, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/contents")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        """What the folder holds; an empty bundle if there is no such folder. A later version is refused."""
        try:
            rows = spark.read.schema("part string, version int").parquet(f"{path}/contents").collect()  # three at most
        except AnalysisException as why:
            if why.getCondition() != "PATH_NOT_FOUND":
                raise
            return Bundle()
        if any(r.version > VERSION for r in rows):
            raise ValueError(f"{path} was written by a later version")
        held = {r.part for r in rows}
        return Bundle(
            TextModel.load(f"{path}/model") if "model" in held else None,
            PlattModel.load(spark, f"{path}/platt") if "platt" in held else None,
            Forest.load(spark, f"{path}/forest") if "forest" in held else None,
        )

    def tiers(self, threshold: float = rules.MODEL_THRESHOLD, text: str = "log_message", embedding: str = "embedding") -> list[Tier]:
        """The model tier and the anomaly tier; a missing part declines every line."""
        model = self.model
        return [model_tier(model.model if model else None, model.classes if model else None, threshold, text), anomaly_tier(self.forest, embedding)]

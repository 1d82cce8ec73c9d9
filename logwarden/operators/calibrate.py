"""Confidence calibration: temperature scaling and Platt scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.functions.arrays import array_sum, negative_log_likelihood
from logwarden.session import stored


def temperature_losses(df: DataFrame, logits: str, truth: str) -> DataFrame:
    """Mean loss for each temperature of the grid 0.1, 0.2, ... 5.0.

    Each row works out its 50 losses as one array; they meet only in 50 running
    means per task, so the grid adds no shuffle beyond 50 rows per task.
    """
    grid = F.transform(F.sequence(F.lit(1), F.lit(rules.TEMPERATURE_STEPS)), lambda i: i / 10.0)
    losses = F.transform(grid, lambda t: negative_log_likelihood(F.col(logits), F.col(truth), t))
    each = df.select(F.posexplode(losses).alias("step", "loss"))
    means = each.groupBy("step").agg(F.avg("loss").alias("loss"))
    return means.select(((F.col("step") + 1) / 10.0).alias("temperature"), "loss")


def fit_temperature(df: DataFrame, logits: str, truth: str) -> DataFrame:
    """One row: the temperature of least loss, the lowest one on a tie."""
    losses = temperature_losses(df, logits, truth)
    return losses.agg(
        F.min_by("temperature", F.struct("loss", "temperature")).alias("temperature"), F.min("loss").alias("loss")
    )


@dataclass(frozen=True)
class PlattModel:
    """A sigmoid ``1 / (1 + exp(-(a p + b)))`` per class, in class order."""

    classes: list
    slope: list[float]
    offset: list[float]

    def apply(self, probabilities: Column) -> Column:
        """Calibrated probabilities that sum to 1; uniform if every sigmoid is 0."""
        parts = [
            1.0 / (1.0 + F.exp(-(F.lit(a) * F.get(probabilities, F.lit(i)) + F.lit(b))))
            for i, (a, b) in enumerate(zip(self.slope, self.offset))
        ]
        raw = F.array(*parts)
        total = array_sum(raw)
        even = F.array(*[F.lit(1.0 / len(parts))] * len(parts))
        return F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(even)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, str(c), a, b) for i, (c, a, b) in enumerate(zip(self.classes, self.slope, self.offset))]
        schema = "pos int, class string, slope double, offset double"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PlattModel:
        rows = spark.read.parquet(path).orderBy("pos").collect()  # one row per class
        return PlattModel([r["class"] for r in rows], [r["slope"] for r in rows], [r["offset"] for r in rows])


def fit_platt(df: DataFrame, probabilities: str, truth: str, classes: list) -> PlattModel:
    """Fit a sigmoid per class against the rest.

    Platt's smoothed targets are soft; each row enters a class's fit twice, as a
    positive and a negative example whose weights are the target and its rest.
    The input is written once and read for every class.
    """
    base = stored(df.select(F.col(probabilities).alias("p"), F.col(truth).alias("y")), "platt")
    counts = base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    seen = {r["y"]: r["n"] for r in counts}
    total = sum(seen.values())
    slope, offset = [], []
    for i, c in enumerate(classes):
        pos = seen.get(c, 0)
        high, low = (pos + 1.0) / (pos + 2.0), 1.0 / (total - pos + 2.0)
        target = F.when(F.col("y") == c, high).otherwise(low)
        sides = F.array(
            F.struct(F.lit(1.0).alias("label"), target.alias("w")),
            F.struct(F.lit(0.0).alias("label"), (1.0 - target).alias("w")),
        )
        rows = base.select(array_to_vector(F.array(F.get("p", F.lit(i)))).alias("features"), F.explode(sides).alias("s"))
        fitted = LogisticRegression(
            family="binomial", weightCol="w", regParam=0.0, standardization=False, maxIter=100, tol=1e-10
        ).fit(rows.select("features", "s.*"))
        slope.append(float(fitted.coefficients[0]))
        offset.append(float(fitted.intercept))
    return PlattModel(list(classes), slope, offset)

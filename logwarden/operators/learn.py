"""Text features, classifier training, stratified splits, cross-validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.operators.calibrate import PlattModel, fit_platt
from logwarden.operators.metrics import class_report, evaluate, pair_counts
from logwarden.session import stored

#: Rows of a label that are ranked together, about; a label's hash range is cut until its slices are that short.
SLICE_ROWS = 4096
_COARSE, _FINE = 12, 20  # bits of the first cut, bits of the second at most


def text_features(text: str = "log_message", size: int = 4096) -> list:
    """Hashed, IDF-weighted word counts: a featurizer that needs no outside model.

    Words are split at white space, as the explainer takes them away one by one.
    """
    words = SQLTransformer(
        statement=f"SELECT *, filter(split(coalesce({text}, ''), '(?U)\\\\s+'), w -> w != '') AS _words FROM __THIS__"
    )
    return [
        words,
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="features"),
    ]


def embed_text(df: DataFrame, text: str = "log_message", size: int = 4096) -> DataFrame:
    """Add the feature vector of every line."""
    return Pipeline(stages=text_features(text, size)).fit(df).transform(df).drop("_words", "_tf")


def vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """An ``ARRAY<FLOAT>`` embedding column as ``features``."""
    return df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))


#: Classes of a model at most: each is a row of its weights and a branch of its verdict.
MOST_CLASSES = 10_000


def class_names(df: DataFrame, label: str) -> list[str]:
    """The labels in order; a label with too many different values is refused before they are gathered."""
    names = df.select(F.col(label).cast("string").alias("l")).distinct().orderBy("l").limit(MOST_CLASSES + 1)
    found = [r[0] for r in names.collect()]
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label} has over {MOST_CLASSES} different values")
    return found


def label_index(label: str, classes: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1).cast("double")


def regression(rows: int) -> LogisticRegression:
    """Multinomial regression with the L2 penalty of C = 1: ``1 / n`` per mean loss."""
    return LogisticRegression(
        featuresCol="features", labelCol="_y", family="multinomial", maxIter=rules.MAX_ITER,
        regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False,
    )


@dataclass(frozen=True)
class TextModel:
    """A fitted pipeline with the names of its classes."""

    model: PipelineModel
    classes: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities`` and ``predicted``."""
        keep = df.columns
        scored = self.model.transform(df).select(*keep, vector_to_array("probability").alias("probabilities"))
        names = F.array(*[F.lit(c) for c in self.classes])
        at = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return scored.withColumn("predicted", F.element_at(names, at))

    def save(self, path: str) -> None:
        """The pipeline, and its classes beside it."""
        self.model.write().overwrite().save(path)
        spark = SparkSession.active()
        rows = spark.createDataFrame(list(enumerate(self.classes)), "pos int, class string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")

    @staticmethod
    def load(path: str, classes: list[str] | None = None) -> TextModel:
        """Read a model; its classes are those saved with it unless others are handed in."""
        if classes is None:
            rows = SparkSession.active().read.parquet(f"{path}/classes").orderBy("pos").collect()  # one row per class
            classes = [r["class"] for r in rows]
        return TextModel(PipelineModel.load(path), classes)


def train(df: DataFrame, label: str, stages: list | None = None, classes: list[str] | None = None) -> TextModel:
    """Fit the classifier; ``stages`` make ``features`` where the table has none."""
    classes = class_names(df, label) if classes is None else classes
    rows = df.withColumn("_y", label_index(label, classes))
    fitted = Pipeline(stages=[*(stages or []), regression(df.count())]).fit(rows)
    return TextModel(fitted, classes)


# --- stratified splits ------------------------------------------------------


def stratified_position(df: DataFrame, label: str, key: str, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add each row's shuffled position within its label and the label's size.

    One window per label would put a third of all rows in one task if a label
    holds that many. Two histograms over the hash say where a row stands: the
    first cuts a label into 4,096 parts, the second each part into slices of
    about ``slice_rows`` rows, as many as it needs. Only within a slice are rows
    ranked, so no window grows with the table (up to 2^32 slices a label).
    """
    sliced = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_part", F.shiftright("_h", 64 - _COARSE))
    parts = sliced.groupBy(F.col(label).alias("_l"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bits = F.greatest(F.lit(0), F.least(F.lit(_FINE), F.ceil(F.log2(F.col("_n") / slice_rows)))).cast("int")
    parts = parts.select(
        "_l", "_p", bits.alias("_bits"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("_l")).alias("stratum_size"),
    )
    same = F.col(label).eqNullSafe(F.col("_l")) & (F.col("_part") == F.col("_p"))
    placed = sliced.join(parts, same).drop("_l", "_p")
    placed = placed.withColumn("_slice", F.expr(f"shiftright(_h, {64 - _COARSE} - _bits)"))
    slices = placed.groupBy(F.col(label).alias("_l"), F.col("_part").alias("_p"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_l", "_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_l", "_p", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(label, "_part", "_slice").orderBy("_h", key)
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1).join(slices, same & (F.col("_slice") == F.col("_s")))
    ranked = ranked.withColumn("position", F.col("_start") + F.col("_before") + F.col("_rank"))
    return ranked.drop("_h", "_part", "_bits", "_start", "_slice", "_l", "_p", "_s", "_before", "_rank")


def assign_folds(df: DataFrame, label: str, key: str, folds: int = rules.CV_FOLDS) -> DataFrame:
    """Stratified folds: every label spread evenly over them."""
    placed = stratified_position(df, label, key)
    return placed.withColumn("fold", (F.col("position") % folds).cast("int")).drop("position", "stratum_size")


def assign_split(df: DataFrame, label: str, key: str, test_share: float = rules.TEST_SHARE) -> DataFrame:
    """Stratified holdout: the last ``test_share`` of every label's shuffled rows."""
    placed = stratified_position(df, label, key)
    held = F.col("position") >= F.round(F.col("stratum_size") * (1.0 - test_share))
    return placed.withColumn("is_test", held).drop("position", "stratum_size")


def calibrated_holdout(
    df: DataFrame, label: str, key: str, stages: list | None = None, folds: int = rules.CV_FOLDS
) -> tuple[TextModel, PlattModel, DataFrame]:
    """A model, its calibration and the rows to judge both by, from three disjoint parts of every label.

    Of the stratified folds the last is scored, the one before it calibrates, the
    others train. The scored rows have ``probabilities``, ``predicted`` and ``calibrated``.
    """
    data = stored(assign_folds(df, label, key, folds), "folds")
    classes = class_names(df, label)
    model = train(data.where(F.col("fold") < folds - 2), label, stages, classes)
    text = F.col(label).cast("string")
    second = model.predict(data.where(F.col("fold") == folds - 2)).withColumn("_truth", text)
    platt = fit_platt(second, "probabilities", "_truth", classes)
    scored = model.predict(data.where(F.col("fold") == folds - 1))
    return model, platt, scored.withColumn("calibrated", platt.apply(F.col("probabilities")))


def cross_validate(df: DataFrame, label: str, key: str, stages: list | None = None, folds: int = rules.CV_FOLDS) -> DataFrame:
    """Macro F1 of every fold; the folded table is written once and read by all fits."""
    classes = class_names(df, label)
    data = stored(assign_folds(df, label, key, folds), "folds")
    scores = None
    for k in range(folds):
        fitted = train(data.filter(F.col("fold") != k), label, stages, classes)
        tested = fitted.predict(data.filter(F.col("fold") == k)).withColumn("_t", F.col(label).cast("string"))
        score = evaluate(tested, "_t", "predicted").select(F.lit(k).alias("fold"), "f1_macro", "accuracy", "total_samples")
        scores = score if scores is None else scores.unionByName(score)
    return scores


def cross_validation_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f1_macro").alias("f1_macro_mean"), F.stddev_pop("f1_macro").alias("f1_macro_std"))


def holdout_report(df: DataFrame, label: str, key: str, stages: list | None = None) -> DataFrame:
    """Class report of a model fitted on 80 % of each label and tested on the rest."""
    data = stored(assign_split(df, label, key), "split")
    fitted = train(data.filter(~F.col("is_test")), label, stages, class_names(df, label))
    tested = fitted.predict(data.filter("is_test")).withColumn("_t", F.col(label).cast("string"))
    return class_report(pair_counts(tested, "_t", "predicted"))

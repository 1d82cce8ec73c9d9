"""Classification metrics, all derived from pair counts.

The only pass over the data counts ``(by, truth, prediction)`` triples with
map-side combine. What follows works on that count table, whose size is the
square of the number of labels, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.operators.classify import Cascade, label_with_each


def pair_counts(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    hits = F.sum(F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0))
    return pairs.groupBy(*by).agg((hits / F.sum("n")).alias("accuracy"), F.sum("n").alias("total_samples"))


def label_domain(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Every label that occurs as truth or prediction."""
    both = df.select(F.explode(F.array(F.col(truth), F.col(predicted))).alias("label"))
    return both.distinct().orderBy("label")


def confusion_matrix(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Dense matrix in long form: a row per truth and prediction, zeros included.

    A group's rows are spelled out from its own label list, so the zero cells
    come from a generator, not from joining all labels with all labels.
    """
    labels = F.array_distinct(F.flatten(F.collect_set(F.array("truth", "predicted")))).alias("labels")
    groups = pairs.groupBy(*by).agg(labels)
    grid = groups.select(*by, F.explode("labels").alias("truth"), "labels").select(
        *by, "truth", F.explode("labels").alias("predicted")
    )
    cells = pairs.unionByName(grid.withColumn("n", F.lit(0).cast("bigint")))
    return cells.groupBy(*by, "truth", "predicted").agg(F.sum("n").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_report(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; a ratio over nothing is 0."""
    hit = F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), hit.cast("bigint").alias("tp"), F.col("n").alias("support"), none.alias("called")),
        F.struct(F.col("predicted").alias("label"), none.alias("tp"), none.alias("support"), F.col("n").alias("called")),
    )
    sums = (
        pairs.select(*by, F.explode(sides).alias("s"))
        .select(*by, "s.*")
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    )
    scored = sums.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("called")), "recall": _ratio(F.col("tp"), F.col("support"))}
    )
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select(*by, "label", "precision", "recall", f1.alias("f1"), "support", "tp")


def averages(report: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro and support-weighted means of a class report, with accuracy and sample count."""
    def weighted(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))

    return report.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        F.sum("support").alias("total_samples"),
    )


def evaluate(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The metric row (per group) of a table of truths and predictions."""
    return averages(class_report(pair_counts(df, truth, predicted, by), by), by)


def compare_approaches(
    labelled: DataFrame, approaches: dict[str, Cascade], truth: str = "target_label", by: tuple[str, ...] = ()
) -> DataFrame:
    """One metric row per approach (and group): a cascade each, all on the same scan.

    The cascades run side by side on each line; the line is read once and leaves
    the task only as a count.
    """
    each = label_with_each(labelled, approaches).select(*by, F.col(truth).alias("truth"), F.explode("labels").alias("a"))
    return evaluate(each.select(*by, "truth", "a.*"), "truth", "predicted", (*by, "approach"))


def method_distribution(classified: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return classified.groupBy(*by, "method").agg(F.count(F.lit(1)).alias("n"))

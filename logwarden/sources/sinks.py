"""Batch sinks: classified CSV, analysis reports as JSON, feedback as JSON lines."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.entities import entities_json
from logwarden.operators.classify import classified_table, classify
from logwarden.operators.reports import Analysis

CLASSIFIED_COLUMNS = ["source", "log_message", "classification", "method", "confidence", "entities", "reasoning"]


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_classified_csv(df: DataFrame, path: str) -> None:
    """Input columns plus label, method, confidence and reasoning."""
    _csv(classified_table(df), path)


def write_classified_rows(df: DataFrame, path: str) -> None:
    """All result columns, entities as JSON text."""
    keep = [c for c in ("log_id",) if c in df.columns]
    rows = classify(df).withColumn("entities", entities_json("entities"))
    _csv(rows.select(*keep, *CLASSIFIED_COLUMNS), path)


#: Tables beside the reports: what may be long.
LONG_TABLES = ("events", "ip_frequency", "suspicious_ips", "suspicious_patterns", "source_distribution")


def write_analysis_json(analysis: Analysis, path: str, run: str | None = None) -> str:
    """A folder for this run: a report per input (``analysis.by``) and the tables its lists are cut from; returns its path.

    ``report`` holds one JSON record per input. The long tables are JSON lines
    beside it, with the input's columns in each row. Nothing is gathered: each
    table is written by the tasks that made it, and a run never replaces another.
    """
    folder = f"{path}/run={run or uuid.uuid4().hex}"
    analysis.report.write.option("ignoreNullFields", False).json(f"{folder}/report")
    for name in LONG_TABLES:
        getattr(analysis, name).write.json(f"{folder}/{name}")
    return folder


FEEDBACK_SCHEMA = (
    "id string, log_message string, predicted_label string, predicted_confidence double, predicted_method string, "
    "is_correct boolean, correct_label string, analyst_id string, notes string, created_at string"
)


def append_feedback(rows: DataFrame, path: str) -> None:
    names = [f.split()[0] for f in FEEDBACK_SCHEMA.split(", ")]
    rows.select(*names).write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """All feedback rows; an empty table if nothing was stored yet.

    A line that is no JSON object fails the read, or is left out with ``skip_broken``.
    """
    try:
        lines = spark.read.text(path).filter(F.trim("value") != "")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FEEDBACK_SCHEMA)
    if not skip_broken:
        return lines.select(F.from_json("value", FEEDBACK_SCHEMA, {"mode": "FAILFAST"}).alias("f")).select("f.*")
    read = lines.select(F.from_json("value", f"{FEEDBACK_SCHEMA}, _corrupt_record string").alias("f")).select("f.*")
    return read.where("_corrupt_record is null").drop("_corrupt_record")


def clear_feedback(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], FEEDBACK_SCHEMA).write.mode("overwrite").json(path)

"""Analyst feedback: validation and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED_ERROR = "correct_label is required when is_correct=false"


def validate(requests: DataFrame) -> DataFrame:
    """Add ``accepted`` and ``error``: a wrong prediction needs its right label."""
    lacking = ~F.col("is_correct") & (F.coalesce("correct_label", F.lit("")) == "")
    return requests.withColumns(
        {"accepted": ~lacking, "error": F.when(lacking, F.lit(REQUIRED_ERROR))}
    )


def stamp(accepted: DataFrame) -> DataFrame:
    """Give rows an id and the time in UTC."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return accepted.withColumns({"id": F.uuid(), "created_at": F.concat(now, F.lit("+00:00"))})


def corrections(feedback: DataFrame) -> DataFrame:
    return feedback.filter(~F.col("is_correct") & (F.coalesce("correct_label", F.lit("")) != ""))


def stats(feedback: DataFrame) -> DataFrame:
    """One row of totals; zeros if there is no feedback."""
    counted = feedback.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_correct").alias("correct"),
        F.count_if(~F.col("is_correct")).alias("incorrect"),
    )
    share = F.coalesce(F.round(F.try_divide(F.col("correct"), F.col("total")), 4), F.lit(0.0))
    return counted.withColumn("accuracy", share)


def stats_by_method(feedback: DataFrame) -> DataFrame:
    method = F.coalesce(F.nullif("predicted_method", F.lit("")), F.lit("unknown"))
    return feedback.groupBy(method.alias("method")).agg(
        F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("incorrect")
    )


def training_rows(feedback: DataFrame) -> DataFrame:
    return corrections(feedback).select("log_message", "correct_label")

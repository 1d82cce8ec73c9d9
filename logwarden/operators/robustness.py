"""Robustness suites: unseen formats, evasion, injected instructions, label flips."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.operators.classify import DEFAULT_CASCADE, Cascade
from logwarden.operators.metrics import evaluate


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist(rows))


# --- unseen formats ---------------------------------------------------------


def unseen_samples(spark: SparkSession) -> DataFrame:
    """The 20 fixed samples with their position."""
    rows = [
        {"ord": i, "source": s, "log_message": m, "expected_label": e} for i, (s, m, e) in enumerate(rules.UNSEEN_SAMPLES)
    ]
    return _rows(spark, rows)


def few_shot_samples(spark: SparkSession) -> DataFrame:
    return unseen_samples(spark).filter(F.col("ord") < rules.FEW_SHOT_SIZE)


def unseen_details(samples: DataFrame, cascade: Cascade = DEFAULT_CASCADE) -> DataFrame:
    """Each sample with its prediction; the text is cut for display."""
    done = cascade.classify(samples)
    return done.select(
        *[c for c in ("ord", "log_id") if c in samples.columns],
        "source",
        F.substring("log_message", 1, rules.SAMPLE_TEXT_CUT).alias("message"),
        F.col("expected_label").alias("expected"),
        F.col("classification").alias("predicted"),
        "method",
        "confidence",
        (F.col("classification") == F.col("expected_label")).alias("correct"),
    )


def unseen_by_source(details: DataFrame) -> DataFrame:
    return details.groupBy("source").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))


def unseen_metrics(details: DataFrame) -> DataFrame:
    return evaluate(details, "expected", "predicted")


# --- evasion ----------------------------------------------------------------


def evasion_variants(msg: Column) -> Column:
    """The five disguises of a message as an array of ``(attack, poisoned)``."""
    look_alike = F.translate(msg, "ae", rules.CYRILLIC_A + rules.CYRILLIC_E)
    spaced = F.replace(msg, F.lit(" "), F.lit(rules.WHITESPACE_FILL))
    letters = F.transform(F.split(msg, ""), lambda c, i: F.when(i % 2 == 0, F.upper(c)).otherwise(F.lower(c)))
    split = F.replace(msg, F.lit("fail"), F.lit("f" + rules.ZERO_WIDTH_SPACE + "ail"))
    texts = [look_alike, spaced, F.array_join(letters, ""), F.concat(F.lit(rules.BENIGN_PREFIX), msg), split]
    return F.array(
        *[F.struct(F.lit(n).alias("attack"), t.alias("poisoned")) for n, t in zip(rules.EVASION_NAMES, texts)]
    )


def evasion_attacks(messages: DataFrame, text: str = "log_message") -> DataFrame:
    """Five rows per message: the disguised text next to the original."""
    others = [c for c in messages.columns if c != text]
    each = messages.select(*others, F.col(text).alias("original"), F.explode(evasion_variants(F.col(text))).alias("v"))
    return each.select(*others, "original", "v.*")


def evasion_results(messages: DataFrame, text: str = "log_message", cascade: Cascade = DEFAULT_CASCADE) -> DataFrame:
    """Whether each disguise keeps the original's label.

    The original is classified before its five variants are spelled out.
    """
    keep = messages.columns
    first = cascade.classify(messages, text).select(*keep, F.col("classification").alias("original_label"))
    attacks = evasion_attacks(first, text)
    done = cascade.classify(attacks, "poisoned").withColumnRenamed("classification", "poisoned_label")
    return done.select(*attacks.columns, "poisoned_label", (F.col("poisoned_label") == F.col("original_label")).alias("passed"))


# --- injected instructions --------------------------------------------------


def injection_payloads(spark: SparkSession) -> DataFrame:
    """The five fixed payloads."""
    return _rows(spark, [{"attack": n, "log_message": lead + line} for n, lead, line in rules.INJECTION_PAYLOADS])


def injection_attacks(alerts: DataFrame, text: str = "log_message") -> DataFrame:
    """The payloads' lead-ins put before every alert line of a table."""
    others = [c for c in alerts.columns if c != text]
    leads = F.array(
        *[
            F.struct(F.lit(n).alias("attack"), F.concat(F.lit(lead), F.col(text)).alias(text))
            for n, lead, _ in rules.INJECTION_PAYLOADS
        ]
    )
    return alerts.select(*others, F.explode(leads).alias("a")).select(*others, "a.*")


def label_flips(spark: SparkSession) -> DataFrame:
    """The three fixed benign lines that talk about attacks."""
    return _rows(spark, [{"attack": n, "description": d, "log_message": m} for n, d, m in rules.LABEL_FLIPS])


def flip_attacks(benign: DataFrame, text: str = "log_message") -> DataFrame:
    """The fixed lines' wording put before every benign line of a table."""
    others = [c for c in benign.columns if c != text]
    flips = F.array(
        *[
            F.struct(F.lit(n).alias("attack"), F.lit(d).alias("description"), F.concat(F.lit(m + " "), F.col(text)).alias(text))
            for n, d, m in rules.LABEL_FLIPS
        ]
    )
    return benign.select(*others, F.explode(flips).alias("a")).select(*others, "a.*")


def alert_expected(attacks: DataFrame, expected: bool, cascade: Cascade = DEFAULT_CASCADE) -> DataFrame:
    """Classify attack lines; they pass if they are (or are not) called Security Alert."""
    is_alert = F.col("classification") == "Security Alert"
    done = cascade.classify(attacks)
    return done.select(
        *[c for c in attacks.columns if c != "log_message"],
        F.col("classification").alias("classified_as"),
        "confidence",
        (is_alert if expected else ~is_alert).alias("passed"),
    )


def suite_summary(suites: dict[str, DataFrame]) -> DataFrame:
    """Totals per suite and, as suite ``summary``, over all of them."""
    long = None
    for name, df in suites.items():
        part = df.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))
        part = part.select(F.lit(name).alias("suite"), "total", "passed")
        long = part if long is None else long.unionByName(part)
    out = long.rollup("suite").agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"))
    return out.select(
        F.coalesce("suite", F.lit("summary")).alias("suite"),
        "total",
        "passed",
        (F.col("total") - F.col("passed")).alias("failed"),
        F.round(F.col("passed") / F.greatest(F.col("total"), F.lit(1)), 4).alias("pass_rate"),
    )

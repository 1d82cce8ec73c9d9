"""Security events: which classified lines are events, and what they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pyarrow as pa

from logwarden import rules
from logwarden.functions import entities as ent
from logwarden.functions.text import case_sql, contains_any, folded, message, record_sql, sql_text, words_case

EVENT_COLUMNS = [
    "event_type", "log_message", "severity", "confidence", "source_ips", "url_pattern", "attack_type",
    "http_method", "status_code", "username", "timestamp", "requires_attention", "root_cause",
    "recommendation", "mitre_technique", "related_events",
]


def attack_signature(lower: str) -> Column:
    """Attack type and severity of an alert line; unknown attacks are HIGH."""
    cases = [
        (contains_any(lower, words), record_sql(attack_type=attack, severity=severity))
        for words, attack, severity in rules.ATTACK_SIGNATURES
    ]
    return F.expr(case_sql(cases, record_sql(attack_type="UNKNOWN", severity="HIGH")))


def event_verdict(label: str, lower: str, status: str) -> Column:
    """Severity, attack type, attention flag and event type; NULL if the line is no event.

    ``label``, ``lower`` and ``status`` name columns. Type NULL inside the
    verdict stands for the label itself.
    """

    def verdict(kind: str | None, severity: str, attack: str, attention: bool) -> str:
        return record_sql(event_type=kind, severity=severity, attack_type=attack, requires_attention=attention)

    signatures = case_sql(
        [
            (contains_any(lower, words), verdict("Security Alert", severity, attack, True))
            for words, attack, severity in rules.ATTACK_SIGNATURES
        ],
        verdict("Security Alert", "HIGH", "UNKNOWN", True),
    )
    name = f"lower({label})"
    scan = verdict("Suspicious HTTP Activity", "LOW", "ENUMERATION", False)
    return F.expr(
        case_sql(
            [
                (f"{label} = 'Security Alert'", signatures),
                (f"{label} = 'Critical Error'", verdict("Critical Error", "HIGH", "UNKNOWN", True)),
                (contains_any(name, ["error", "fail"]), verdict(None, "MEDIUM", "UNKNOWN", False)),
                (f"{label} = 'HTTP Status'", f"CASE WHEN startswith({status}, '4') THEN {scan} END"),
                (contains_any(lower, rules.SUSPICIOUS_WORDS), verdict("Suspicious Activity", "MEDIUM", "UNKNOWN", True)),
            ]
        )
    )


def judge(classified: DataFrame, label: str = "classification", text: str = "log_message") -> DataFrame:
    """Add ``_lower``, ``_status`` and the nullable struct ``_event`` to every classified line.

    Reuses the cascade's ``entities`` column where it is there.
    """
    if "entities" in classified.columns:
        status = F.col("entities")["status_code"]
    else:
        status = ent.status_code(text)
    df = classified.withColumns({"_lower": F.lower(message(text)), "_status": status})
    return df.withColumn("_event", event_verdict(label, "_lower", "_status"))


def only_events(judged: DataFrame) -> DataFrame:
    """Keep the rows with an event.

    Goes through a generator on purpose. As a filter, the condition would be
    pushed below the projections that compute it and the whole cascade would run
    twice on each line.
    """
    others = [c for c in judged.columns if c != "_event"]
    hit = F.when(F.col("_event").isNotNull(), F.array("_event"))
    return judged.select(*others, F.explode(hit).alias("_event"))


def extract_events(classified: DataFrame, label: str = "classification", text: str = "log_message") -> DataFrame:
    """One row per security event, with the input's id columns in front."""
    found = only_events(judge(classified, label, text))
    e = F.col("_event")
    if "entities" in classified.columns:
        parts = {k: F.col("entities")[k] for k in ("url", "http_method", "status_code", "username")}
        parts["ips"] = F.coalesce(F.col("entities")["ip_addresses"], F.array().cast("array<string>"))
    else:
        fold = folded(message(text))
        parts = {
            "ips": ent.ip_addresses(text), "url": ent.url(text), "http_method": ent.http_method(text),
            "status_code": ent.status_code(text, fold), "username": ent.username(text, fold),
        }
    ids = [c for c in ("log_id", "source") if c in classified.columns]
    return found.select(
        *ids,
        F.coalesce(e["event_type"], F.col(label)).alias("event_type"),
        message(text).alias("log_message"),
        e["severity"].alias("severity"),
        F.col("confidence"),
        parts["ips"].alias("source_ips"),
        parts["url"].alias("url_pattern"),
        e["attack_type"].alias("attack_type"),
        parts["http_method"].alias("http_method"),
        parts["status_code"].alias("status_code"),
        parts["username"].alias("username"),
        F.lit(None).cast("string").alias("timestamp"),
        e["requires_attention"].alias("requires_attention"),
        F.array().cast("array<int>").alias("related_events"),
        F.col("_lower"),
    )


# --- enrichment -------------------------------------------------------------


def root_cause(lower: str, event_type: str) -> Column:
    """Likely cause by keyword; otherwise a sentence naming the event type."""
    head, tail = rules.ROOT_CAUSE_DEFAULT
    default = f"concat({sql_text(head)}, {event_type}, {sql_text(tail)})"
    return F.expr(words_case(lower, rules.ROOT_CAUSES, default))


def attack_table(spark: SparkSession) -> DataFrame:
    """One row per attack type with its technique and advice: 11 rows, always safe to broadcast."""
    advice = dict(rules.RECOMMENDATIONS)
    rows = [
        {
            "attack_type": attack,
            "mitre_technique": {"technique_id": t, "name": n, "tactic": c, "url": rules.TECHNIQUE_URL + t},
            "advice": advice[attack],
        }
        for attack, t, n, c in rules.TECHNIQUES
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def add_root_cause(events: DataFrame) -> DataFrame:
    return events.withColumn("root_cause", root_cause("lower(log_message)", "event_type"))


def add_technique(events: DataFrame) -> DataFrame:
    """Left lookup of the ATT&CK technique by attack type; UNKNOWN has none."""
    table = attack_table(events.sparkSession).select("attack_type", "mitre_technique")
    return events.join(F.broadcast(table), "attack_type", "left")


def recommendation_text(severity: Column, advice: Column) -> Column:
    prefix = F.lit("")
    for level, words in reversed(rules.SEVERITY_PREFIXES):
        prefix = F.when(severity == level, words).otherwise(prefix)
    return F.concat(prefix, F.coalesce(advice, F.lit(rules.RECOMMENDATION_DEFAULT)))


def add_recommendation(events: DataFrame) -> DataFrame:
    table = attack_table(events.sparkSession).select("attack_type", "advice")
    joined = events.join(F.broadcast(table), "attack_type", "left")
    return joined.withColumn("recommendation", recommendation_text(F.col("severity"), F.col("advice"))).drop("advice")


def enrich(events: DataFrame) -> DataFrame:
    """Root cause, technique and recommendation with one broadcast lookup and no shuffle."""
    lower = "_lower" if "_lower" in events.columns else "lower(log_message)"
    ids = [c for c in events.columns if c not in EVENT_COLUMNS and c != "_lower"]
    joined = events.withColumn("root_cause", root_cause(lower, "event_type")).join(
        F.broadcast(attack_table(events.sparkSession)), "attack_type", "left"
    )
    joined = joined.withColumn("recommendation", recommendation_text(F.col("severity"), F.col("advice")))
    return joined.select(*ids, *EVENT_COLUMNS)


def security_events(classified: DataFrame) -> DataFrame:
    """Events of a classified table, enriched; the 16 event columns after the ids."""
    return enrich(extract_events(classified))


# --- reports over events ----------------------------------------------------


def technique_catalogue(spark: SparkSession) -> DataFrame:
    return attack_table(spark).select("attack_type", "mitre_technique.*")


def technique_coverage(events: DataFrame, order: str = "log_id") -> DataFrame:
    """Techniques seen, one row each, with the first event's id (at most 10 rows)."""
    seen = events.select(F.col("mitre_technique.technique_id").alias("technique_id"), F.col(order).alias("_o"))
    first = seen.filter(F.col("technique_id").isNotNull()).groupBy("technique_id").agg(F.min("_o").alias("first_seen"))
    names = technique_catalogue(events.sparkSession).drop("attack_type").distinct()
    return first.join(F.broadcast(names), "technique_id")


def distinct_recommendations(events: DataFrame, order: str = "log_id") -> DataFrame:
    """Each recommendation once, with the first event's id (at most 60 rows)."""
    return events.groupBy("recommendation").agg(F.min(order).alias("first_seen"))

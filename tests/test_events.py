from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logwarden.operators import classify as cl
from logwarden.operators import events as ev
from logwarden.operators import reports as rp


@pytest.fixture
def events(lines):
    def make(*rows):
        return ev.security_events(cl.classify(lines(*rows))).orderBy("log_id").collect()

    return make


def test_five_lines_end_to_end(events):
    got = events(
        ("WebServer", "Multiple failed login attempts from 10.0.0.1"),
        ("App", "Suspicious sql injection on /admin"),
        ("Sys", "Backup completed successfully."),
        ("Web", "GET /admin HTTP/1.1 status: 404"),
        ("Job", "task failed: out of memory"),
    )
    kinds = [(e.event_type, e.severity, e.attack_type) for e in got]
    assert kinds[0] == ("Security Alert", "HIGH", "BRUTE_FORCE")
    assert kinds[1] == ("Security Alert", "CRITICAL", "SQL_INJECTION")
    assert kinds[2] == ("Suspicious HTTP Activity", "LOW", "ENUMERATION")
    assert kinds[3] == ("Workflow Error", "MEDIUM", "UNKNOWN")
    assert got[0].mitre_technique.technique_id == "T1110" and got[3].mitre_technique is None
    assert got[0].source_ips == ["10.0.0.1"] and got[0].requires_attention
    assert got[0].root_cause.startswith("Authentication failure") and got[3].root_cause.startswith("Memory exhaustion")
    assert got[3].recommendation == "[MEDIUM] Schedule review — Investigate the event, review related logs, and assess impact."
    assert got[2].url_pattern == "/admin" and got[2].status_code == "404" and got[2].timestamp is None
    assert got[0].related_events == []


def test_no_events(events):
    assert events(("Sys", "Backup completed successfully."), ("Sys", "The sky is blue today")) == []


def test_other_branches(spark):
    rows = [(0, "benign", "an unusual thing"), (1, "HTTP Status", "unusual status: 200"), (2, "My Error", "x"), (3, "Critical Error", "y")]
    table = spark.createDataFrame(rows, "log_id bigint, classification string, log_message string").withColumn("confidence", F.lit(1.0))
    got = {e.log_id: (e.event_type, e.severity, e.requires_attention) for e in ev.security_events(table).collect()}
    assert got == {
        0: ("Suspicious Activity", "MEDIUM", True),
        2: ("My Error", "MEDIUM", False),
        3: ("Critical Error", "HIGH", True),
    }


def test_keywords_are_substrings(events):
    assert events("unauthorized executive access")[0].attack_type == "COMMAND_INJECTION"


def test_default_root_cause_names_the_type(events):
    assert events("unauthorized thing")[0].root_cause == (
        "Event of type 'Security Alert' detected — manual investigation recommended."
    )


def test_signature_struct(spark):
    row = spark.createDataFrame([("a trojan",), ("odd",)], "m string").select(ev.attack_signature("m").alias("a")).collect()
    assert [(r.a.attack_type, r.a.severity) for r in row] == [("MALWARE", "CRITICAL"), ("UNKNOWN", "HIGH")]


def test_catalogue_and_coverage(lines):
    done = ev.security_events(cl.classify(lines("unauthorized xss", "unauthorized lfi", "unauthorized sqli", "unauthorized")))
    assert ev.technique_catalogue(done.sparkSession).count() == 11
    seen = ev.technique_coverage(done).orderBy("first_seen").collect()
    assert [(r.technique_id, r.first_seen) for r in seen] == [("T1189", 0), ("T1190", 1)]


def test_lookup_is_a_broadcast_without_shuffle(lines):
    plan = ev.security_events(cl.classify(lines("x")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


# --- reports ----------------------------------------------------------------


def test_ip_levels(lines):
    rows = ["login from 10.0.0.1"] * 10 + ["seen 10.0.0.2 and 10.0.0.2"] * 3 + ["10.0.0.3"]
    got = rp.suspicious_ips(rp.ip_frequency(lines(*rows))).collect()
    assert [(r.ip, r.request_count, r.suspicion_level) for r in got] == [("10.0.0.1", 10, "HIGH"), ("10.0.0.2", 6, "MEDIUM")]


def test_url_reports(lines):
    rows = ["GET /b?x=1'", "GET /a", "GET /a?q", "POST /b", "PUT /c/../<script"]
    df = lines(*rows)
    from logwarden.functions.entities import url

    top = rp.top_urls(rp.url_counts(df, url("log_message")), 2).orderBy("rank").collect()
    assert [(r.url, r.n, r.rank) for r in top] == [("/b", 2, 1), ("/a", 2, 2)]
    assert rp.unique_urls(df, url("log_message")).first().total_unique_urls == 3
    bad = rp.suspicious_urls(df, url("log_message"), ["log_id"]).orderBy("log_id", "pattern").collect()
    assert [(r.log_id, r.pattern) for r in bad] == [
        (0, "Potential SQL Injection"), (4, "Potential Path Traversal"), (4, "Potential XSS"),
    ]


def test_overview_and_summary(lines):
    df = cl.classify(lines(*["Multiple failed login attempts from 10.0.0.1"] * 11, "Suspicious sqli", "Backup ended"))
    row = rp.analyze(df).overview.first()
    assert row.highest_severity == "CRITICAL" and row.requires_immediate_attention
    assert row.summary == (
        "Analysed 13 log entries, identified 12 security events. 1 CRITICAL severity event(s) require immediate attention. "
        "11 HIGH severity event(s) detected. 1 suspicious IP address(es) identified."
    )
    quiet = rp.analyze(cl.classify(lines("Backup ended"))).overview.first()
    assert quiet.summary.endswith("No security events detected in the analysed logs.")
    assert quiet.highest_severity is None and not quiet.requires_immediate_attention


def test_analysis_tables_agree_with_direct_reports(spark, sf):
    from checks.logs_view import logs

    df = cl.classify(logs(spark, sf))
    a = rp.analyze(df)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(a.ip_frequency.select("ip", "request_count", "first_seen")) == key(rp.ip_frequency(df))
    assert key(a.label_distribution) == key(rp.distribution(df, "classification"))
    assert key(a.recommendations.select("recommendation", "first_seen")) == key(ev.distinct_recommendations(a.events))
    assert key(a.technique_coverage.select("technique_id", "first_seen")) == key(
        ev.technique_coverage(a.events).select("technique_id", "first_seen")
    )
    by = rp.analyze(df, ("source",))
    assert by.overview.count() == df.select("source").distinct().count()
    assert by.top_urls.groupBy("source").count().agg(F.max("count")).first()[0] <= 20

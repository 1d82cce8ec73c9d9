from __future__ import annotations

import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.functions import entities as ent
from logwarden.functions.text import caseless_search, folded, simplify_search
from logwarden.operators import classify as cl


def labels(df):
    return [r.classification for r in df.orderBy("log_id").collect()]


def test_pattern_tier_labels(lines):
    df = lines(
        "Multiple failed login attempts from 10.0.0.1",
        "GET /api HTTP/1.1",
        "User bob logged in",
        "Backup completed successfully.",
        "memory usage at 90%",
        "API is deprecated",
        "task failed to start",
        "some exception here",
        "ADMIN rights ESCALATED",
        "The sky is blue today",
    )
    only = cl.Cascade([cl.pattern_tier()])
    assert labels(only.classify(df)) == [
        "Security Alert", "HTTP Status", "User Action", "System Notification", "Resource Usage",
        "Deprecation Warning", "Workflow Error", "Error", "Security Alert", "Unclassified",
    ]
    last = only.classify(df).orderBy(F.desc("log_id")).first()
    assert (last.method, last.confidence, last.reasoning) == ("regex", 0.0, rules.REASON_FALLBACK)


def test_default_cascade_records(lines):
    rows = cl.classify(lines("critical thing", "The sky is blue today", "Backup ended", None)).orderBy("log_id").collect()
    assert (rows[0].classification, rows[0].method, round(rows[0].confidence, 6)) == ("Critical Error", "llm", 0.6)
    assert rows[0].reasoning == "Classified via LLM analysis (confidence: 0.60)."
    assert (rows[1].classification, rows[1].method, rows[1].confidence) == ("Unclassified", "llm", 0.0)
    assert rows[1].reasoning == "Classified via LLM analysis (confidence: 0.00)."
    assert (rows[2].confidence, rows[2].reasoning) == (1.0, "Matched rule-based pattern.")
    assert rows[3].classification == "Unclassified"


def test_entities(lines):
    row = cl.classify(lines("User admin got GET /x?y=1 HTTP/1.1 status: 404 from 10.0.0.1 and 10.0.0.1")).first()
    e = row.entities
    assert (e.ip_addresses, e.http_method, e.status_code, e.username, e.url) == (
        ["10.0.0.1", "10.0.0.1"], "GET", "404", "admin", "/x?y=1",
    )
    none = cl.classify(lines("nothing here. at all")).select(ent.entities_json("entities").alias("j")).first()
    assert none.j == "{}"


def test_unicode_user_name_and_plain_access_log_status(lines):
    df = lines("User müller logged in", 'x "GET / HTTP/1.1" 404 12').orderBy("log_id")
    rows = df.select(ent.username("log_message").alias("u"), ent.status_code("log_message").alias("s")).collect()
    assert rows[0].u == "müller"
    assert rows[1].s is None


def test_custom_order_and_custom_patterns(lines):
    df = lines("error: backup failed", "hello world")
    assert labels(cl.Cascade([cl.keyword_tier(), cl.pattern_tier()]).classify(df)) == ["Critical Error", "Unclassified"]
    mine = cl.Cascade([cl.pattern_tier([(r".*hello\s+world.*", "Greeting")]), cl.keyword_tier()])
    assert labels(mine.classify(df)) == ["Critical Error", "Greeting"]


def test_failing_python_tier_is_skipped_and_sees_open_lines_only(lines):
    def down(messages: pd.Series) -> pd.DataFrame:
        raise RuntimeError

    def echo(messages: pd.Series) -> pd.DataFrame:
        if messages.str.contains("failed login").any():
            raise AssertionError("a decided line reached the tier")
        known = messages.str.contains("sky")
        return pd.DataFrame({"label": ["Weather" if k else None for k in known], "confidence": 0.9}, index=messages.index)

    tiers = [cl.pattern_tier(), cl.BatchTier("bert", down), cl.BatchTier("bert", echo), cl.keyword_tier()]
    rows = cl.Cascade(tiers).classify(lines("failed login", "the sky", "a crash")).orderBy("log_id").collect()
    assert [r.classification for r in rows] == ["Security Alert", "Weather", "Critical Error"]
    assert round(rows[1].confidence, 6) == 0.85
    assert rows[1].reasoning == "Classified with BERT embeddings (confidence: 0.85)."


def test_completion_tier(lines):
    def complete(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: "<category> Error </category><reasoning>r</reasoning>" if "odd" in p else "no idea")

    tiers = [cl.pattern_tier(), cl.completion_tier(complete)]
    rows = cl.Cascade(tiers).classify(lines("odd line", "plain line", "Backup started")).orderBy("log_id").collect()
    assert [(r.classification, r.method) for r in rows] == [
        ("Error", "llm"), ("Unclassified", "llm"), ("System Notification", "regex"),
    ]
    assert round(rows[0].confidence, 6) == 0.75


@pytest.mark.parametrize(
    "text,category,reasoning",
    [
        ("<category>\n Error\n</category> x <reasoning>a\nb</reasoning>", "Error", "a\nb"),
        ("nothing", "Unclassified", ""),
        ("<category></category>", "", ""),
    ],
)
def test_completion_parsing(spark, text, category, reasoning):
    row = spark.createDataFrame([(text,)], "t string").select(cl.parse_completion("t").alias("k")).first().k
    assert (row.category, row.confidence, row.reasoning, row.raw_response) == (category, 0.85, reasoning, text)


def test_probability_verdict(spark):
    df = spark.createDataFrame([([0.2, 0.7, 0.1],), ([0.4, 0.35, 0.25],)], "p array<double>")
    rows = df.select(cl.probability_verdict(F.col("p"), ["a", "b", "c"]).alias("v")).collect()
    assert [(r.v.label, r.v.confidence) for r in rows] == [("b", 0.7), (None, 0.4)]


def test_confidence_shift(spark):
    one = spark.range(1)
    shift = lambda p, m: one.select(cl.adjust_confidence(F.lit(p), m).alias("c")).first().c
    assert shift(0.9, "regex") == 0.9
    assert shift(0.9, "bert") == pytest.approx(0.85)
    assert shift(0.8, "llm") == pytest.approx(0.7)
    assert shift(0.03, "llm") == 0.0
    assert shift(0.9, "other") == 0.9


def test_simplify_search():
    assert simplify_search(r".*a.*|.*b.*") == "a|b"
    assert simplify_search(r".*(?:x|y)\s+z.*") == r"(?:x|y)\s+z"
    assert simplify_search(r"a\.*") == r"a\.*"
    assert simplify_search(r"[|].*") == "[|]"


WORDS = [
    "authentication fail", "Failed LOGIN", "suſpicious", "brute  force", "admin x escalated", "GET /a HTTP/1", "get /a http/1",
    "User bob logged in", "user  Al\tlogged out", "logged inside", "Backup ended", "System reboot", "CPU usage", "tasK failed",
    "wiıl be removed", "FAİL", "is outdated", "exception", "process failed", "File x uploaded successfully by user ", "\n",
]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=4), min_size=25, max_size=25))
def test_pattern_tier_agrees_with_python_re(spark, combos):
    texts = [" ".join(c) for c in combos]
    compiled = [(re.compile(p, re.IGNORECASE), label) for p, label in rules.PATTERN_RULES]
    df = spark.createDataFrame([(t,) for t in texts], "m string").withColumn("f", folded("m"))
    got = [r.x for r in df.select(cl.pattern_label("m", "f").alias("x")).collect()]
    assert got == [next((lab for p, lab in compiled if p.search(t)), None) for t in texts]


def test_plain_word_patterns_never_reach_the_regex_engine():
    assert "RLIKE" not in caseless_search("m", "f", r".*error.*|.*exception.*")
    assert "RLIKE" in caseless_search("m", "f", r"task\s+failed")


def test_required_words():
    from logwarden.functions.text import required_words, simplify_search

    assert required_words(r"abc*defg|xyz+w") == ["defg", "xyz"]
    assert required_words(r"(?:GET|POST)\s+\S+\s+HTTP/\d") == ["http/"]
    assert required_words(r"a{2}bcd|[xyz]q") == [] and required_words(r"\d+") == []
    compiled = [re.compile(p, re.IGNORECASE) for p, _ in rules.PATTERN_RULES]
    for text in WORDS:
        for (pattern, _), search in zip(rules.PATTERN_RULES, compiled):
            needs = required_words(simplify_search(pattern))
            if needs and text.isascii() and search.search(text):
                assert any(w in text.lower() for w in needs)


def test_filter_on_the_outcome_does_not_repeat_the_cascade(spark, sf):
    from checks.logs_view import logs

    done = cl.classify(logs(spark, sf)).filter("classification = 'Security Alert'").select("log_id", "classification")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("authentication fail") == 2  # once per tier: the cascade is worked out once


def test_a_tier_that_fails_on_some_lines_keeps_the_others(spark):
    import pandas as pd

    def decide(lines: pd.Series) -> pd.DataFrame:
        if lines.str.contains("poison").any():
            raise ValueError("poisoned")
        return pd.DataFrame({"label": "Found", "confidence": 0.9}, index=lines.index)

    rows = spark.createDataFrame([(i, "poison" if i == 7 else f"zzz {i}") for i in range(40)], "log_id bigint, log_message string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "4", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            done = cl.Cascade([cl.BatchTier("bert", decide)], entities=None).classify(rows)
            assert {r.log_id for r in done.where("classification = 'Found'").collect()} == set(range(40)) - {7}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_reasoning_writes_confidences_as_their_binary_values_round(spark):
    values = [k / 1000 for k in range(1001)] + [0.125, 0.375, 0.5051, 1.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", cl.reasoning("bert", F.col("v")).alias("s"))
    got = [r.s for r in df.orderBy("i").collect()]
    assert got == [None if v is None else f"Classified with BERT embeddings (confidence: {v:.2f})." for v in values]

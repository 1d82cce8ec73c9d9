from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logwarden.operators import classify as cl
from logwarden.operators import feedback as fb
from logwarden.operators import metrics as mt
from logwarden.sources import sinks


def entries(spark, rows):
    schema = "log_message string, predicted_label string, predicted_method string, is_correct boolean, correct_label string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"predicted_confidence": F.lit(0.5), "analyst_id": F.lit(""), "notes": F.lit("")})


def test_feedback_round_trip(spark, folder):
    path = f"{folder}/fb"
    assert sinks.read_feedback(spark, path).count() == 0
    assert tuple(fb.stats(sinks.read_feedback(spark, path)).first()) == (0, 0, 0, 0.0)
    rows = entries(spark, [("log1", "Error", "regex", False, "Security Alert"), ("log2", "Error", "", True, None)])
    sinks.append_feedback(fb.stamp(rows), path)
    back = sinks.read_feedback(spark, path)
    assert back.select("id").distinct().count() == 2
    assert back.first().created_at.endswith("+00:00")
    assert tuple(fb.stats(back).first()) == (2, 1, 1, 0.5)
    assert {tuple(r) for r in fb.stats_by_method(back).collect()} == {("regex", 0, 1), ("unknown", 1, 0)}
    assert [tuple(r) for r in fb.training_rows(back).collect()] == [("log1", "Security Alert")]
    sinks.clear_feedback(spark, path)
    assert sinks.read_feedback(spark, path).count() == 0


def test_validation(spark):
    rows = [("a", "E", "m", False, None), ("b", "E", "m", False, ""), ("c", "E", "m", False, "X"), ("d", "E", "m", True, None)]
    got = fb.validate(entries(spark, rows)).orderBy("log_message").collect()
    assert [r.accepted for r in got] == [False, False, True, True]
    assert got[0].error and got[3].error is None


PAIRS = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("d", "e")]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(PAIRS, "t string, p string")


def test_metrics_by_hand(pairs):
    counts = mt.pair_counts(pairs, "t", "p")
    report = {r.label: r for r in mt.class_report(counts).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].f1, report["a"].support) == (0.5, 0.5, 0.5, 2)
    assert report["b"].precision == pytest.approx(2 / 3) and report["b"].recall == 1.0
    assert (report["c"].precision, report["c"].recall, report["c"].f1) == (0.0, 0.0, 0.0)
    assert (report["e"].support, report["e"].precision) == (0, 0.0)
    row = mt.evaluate(pairs, "t", "p").first()
    assert row.accuracy == 0.5 and row.total_samples == 6
    assert row.f1_macro == pytest.approx((0.5 + 0.8) / 5)
    assert row.f1_weighted == pytest.approx((0.5 * 2 + 0.8 * 2) / 6)


def test_confusion_matrix_is_dense_and_sums_to_n(pairs):
    cells = mt.confusion_matrix(mt.pair_counts(pairs, "t", "p")).collect()
    assert len(cells) == 25 and sum(r.n for r in cells) == len(PAIRS)
    assert [r.label for r in mt.label_domain(pairs, "t", "p").collect()] == ["a", "b", "c", "d", "e"]


def test_approaches_match_their_cascades(lines):
    df = lines("failed login", "a crash", "blue sky").withColumn("target_label", F.lit("Security Alert"))
    both = {"p": cl.Cascade([cl.pattern_tier()], entities=None), "k": cl.Cascade([cl.keyword_tier()], entities=None)}
    got = {r.approach: r.accuracy for r in mt.compare_approaches(df, both).collect()}
    assert got == {"p": pytest.approx(1 / 3), "k": 0.0}


def test_approach_with_a_python_tier(lines):
    import pandas as pd

    def always(messages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"label": "X", "confidence": 1.0}, index=messages.index)

    df = lines("failed login", "blue").withColumn("target_label", F.lit("X"))
    mine = {"m": cl.Cascade([cl.pattern_tier(), cl.BatchTier("bert", always)], entities=None), "p": cl.Cascade([cl.pattern_tier()])}
    assert {r.approach: r.accuracy for r in mt.compare_approaches(df, mine).collect()} == {"m": 0.5, "p": 0.0}


def test_broken_feedback_lines(spark, folder):
    import os

    os.makedirs(f"{folder}/store")
    with open(f"{folder}/store/a.json", "w") as f:
        f.write('{"id": "1", "log_message": "m", "is_correct": true}\n\nnot json\n')
    assert [r.id for r in sinks.read_feedback(spark, f"{folder}/store", skip_broken=True).collect()] == ["1"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        sinks.read_feedback(spark, f"{folder}/store").collect()
    assert sinks.read_feedback(spark, f"{folder}/nowhere").count() == 0

from __future__ import annotations

from logwarden import rules
from logwarden.operators import robustness as rb


def test_fixed_sets(spark):
    assert rb.unseen_samples(spark).count() == 20
    assert rb.few_shot_samples(spark).count() == 12
    assert {r.source for r in rb.unseen_samples(spark).collect()} == {
        "WindowsEventLog", "CloudTrail", "Kubernetes", "Firewall", "PostgreSQL", "SCADA",
    }
    assert rb.injection_payloads(spark).count() == 5
    assert rb.label_flips(spark).count() == 3


def test_unseen_evaluation(spark):
    details = rb.unseen_details(rb.unseen_samples(spark))
    by_source = {r.source: (r.correct, r.total) for r in rb.unseen_by_source(details).collect()}
    assert sum(t for _, t in by_source.values()) == 20
    assert by_source["WindowsEventLog"][1] == 4
    metrics = rb.unseen_metrics(details).first()
    assert metrics.accuracy == sum(c for c, _ in by_source.values()) / 20
    assert max(len(r.message) for r in details.collect()) <= 80


def test_evasion_variants(spark):
    df = spark.createDataFrame([("a failed test",)], "log_message string")
    got = {r.attack: r.poisoned for r in rb.evasion_attacks(df).collect()}
    assert got == {
        "unicode_homoglyph": "а fаilеd tеst",
        "whitespace_injection": "a  \t failed  \t test",
        "case_randomisation": "A FaIlEd tEsT",
        "benign_prefix": "System health check OK. a failed test",
        "zero_width_split": "a f​ailed test",
    }


def test_fixed_suites_summary(spark):
    base = spark.createDataFrame([(m,) for m in rules.EVASION_MESSAGES], "log_message string")
    suites = {
        "evasion": rb.evasion_results(base),
        "prompt_injection": rb.alert_expected(rb.injection_payloads(spark), True),
        "label_flipping": rb.alert_expected(rb.label_flips(spark), False),
    }
    rows = {r.suite: r for r in rb.suite_summary(suites).collect()}
    assert (rows["evasion"].total, rows["prompt_injection"].total, rows["label_flipping"].total) == (20, 5, 3)
    assert rows["summary"].total == 28
    assert rows["summary"].passed == sum(rows[s].passed for s in suites)
    assert rows["summary"].pass_rate == round(rows["summary"].passed / 28, 4)
    passed = {r.attack: r.passed for r in suites["label_flipping"].collect()}
    assert passed == {"keyword_stuffing": False, "quoted_attack_string": True, "negated_threat": False}

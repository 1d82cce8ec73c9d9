from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.functions.arrays import softmax
from logwarden.operators import anomaly, calibrate, classify as cl, explain, learn


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def test_softmax(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.5],), ([1000.0, 0.0, -1000.0],)], "z array<double>")
    cold, hot = (df.select(softmax(F.col("z"), t).alias("p")).collect() for t in (0.5, 5.0))
    for r in cold + hot:
        assert sum(r.p) == pytest.approx(1.0)
    assert max(hot[0].p) < max(cold[0].p)
    z = np.exp(np.array([2.0, 1.0, 0.5]) / 5.0)
    assert hot[0].p == pytest.approx(list(z / z.sum()))


def test_temperature_fit_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(200, 4)) * 3
    y = np.array([rng.choice(4, p=np.exp(r / 2) / np.exp(r / 2).sum()) for r in z])
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(z, y)], "z array<double>, y int")
    grid = np.arange(1, 51) / 10

    def loss(t):
        s = z / t
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    got = calibrate.fit_temperature(df, "z", "y").first()
    assert got.temperature == pytest.approx(min(grid, key=loss))
    assert got.loss == pytest.approx(min(map(loss, grid)))


def test_platt_agrees_with_newton(spark, folder):
    rng = np.random.default_rng(2)
    p = rng.random(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(4 * p - 2)))).astype(int)
    df = spark.createDataFrame([([1 - a, a], str(b)) for a, b in zip(p.tolist(), y.tolist())], "p array<double>, y string")
    model = calibrate.fit_platt(df, "p", "y", ["0", "1"])
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    x = np.stack([p, np.ones_like(p)], axis=1)
    for _ in range(50):
        s = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x, x.T @ (s - t))
    assert (model.slope[1], model.offset[1]) == pytest.approx(tuple(w), rel=1e-3)
    model.save(spark, f"{folder}/platt")
    again = calibrate.PlattModel.load(spark, f"{folder}/platt")
    rows = df.select(again.apply(F.col("p")).alias("c")).collect()
    assert all(sum(r.c) == pytest.approx(1.0) for r in rows)


def test_stratified_positions_and_splits(spark):
    # One label holds well over a third of the rows.
    rows = [(i, "hot" if i % 3 else f"l{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, label string")
    placed = learn.stratified_position(df, "label", "id").collect()
    by = {}
    for r in placed:
        by.setdefault(r.label, []).append(r.position)
        assert r.stratum_size == sum(1 for _, lab in rows if lab == r.label)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = learn.assign_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    for lab in by:
        n = [r["count"] for r in sizes if r.label == lab]
        assert max(n) - min(n) <= 1
    held = {r.label: r.n for r in learn.assign_split(df, "label", "id").groupBy("label").agg(F.count_if("is_test").alias("n")).collect()}
    assert all(abs(held[lab] - 0.2 * len(v)) <= 1 for lab, v in by.items())


def test_forest(spark, vectors, folder):
    far = spark.createDataFrame([(10_000_000, [50.0] * 64, 0)], "vec_id bigint, embedding array<float>, label int")
    rows = vectors.select("vec_id", "embedding", "label").unionByName(far)
    forest = anomaly.fit_forest(rows)
    n = rows.count()
    done = anomaly.score_anomalies(rows, forest).collect()
    flagged = [r for r in done if r.is_anomaly]
    assert any(r.vec_id == 10_000_000 for r in flagged)
    assert 0.02 <= len(flagged) / n <= 0.07
    assert all(0 <= r.anomaly_score <= 1 for r in done) and all(r.anomaly_score == 0 for r in done if not r.is_anomaly)
    forest.save(spark, f"{folder}/forest")
    again = anomaly.score_anomalies(rows, anomaly.Forest.load(spark, f"{folder}/forest")).collect()
    assert {(r.vec_id, r.is_anomaly) for r in again} == {(r.vec_id, r.is_anomaly) for r in done}
    none = anomaly.score_anomalies(rows, None).first()
    assert (none.is_anomaly, none.anomaly_score) == (False, 0.0)


def test_forest_samples_have_exact_size_and_no_repeats(vectors):
    n = vectors.count()
    got = anomaly.tree_samples(vectors.select("vec_id", "embedding"), "vec_id", n, 20, 32, 7)
    per = got.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("d")).collect()
    assert len(per) == 20 and all(r.n == r.d == min(32, n) for r in per)


def test_forest_score_by_hand(spark):
    import pandas as pd

    # One tree: a cut at 0.5; left leaf holds 1 row, right leaf 3.
    nodes = pd.DataFrame(
        [[0, 0, 0, 0.5, 1, 2, 0, 4], [0, 1, -1, 0.0, -1, -1, 1, 1], [0, 2, -1, 0.0, -1, -1, 1, 3]],
        columns=["tree", "node", "feature", "threshold", "left", "right", "depth", "size"],
    )
    df = spark.createDataFrame([([0.0],), ([1.0],)], "embedding array<float>")
    got = [r.raw_score for r in anomaly.raw_score(df, anomaly.Forest(nodes, 4, 0.0)).collect()]
    c = lambda n: 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    assert got == pytest.approx([-(2 ** (-1 / c(4))), -(2 ** (-(1 + c(3)) / c(4)))])


def test_anomaly_tier(spark, vectors):
    forest = anomaly.fit_forest(vectors)
    df = vectors.withColumn("log_message", F.lit("quiet"))
    done = cl.Cascade([cl.pattern_tier(), anomaly.anomaly_tier(forest), cl.keyword_tier()], entities=None).classify(df)
    got = {(r.classification, r.method) for r in done.select("classification", "method").distinct().collect()}
    assert got == {("Anomaly", "anomaly"), ("Unclassified", "llm")}


@pytest.fixture(scope="module")
def text_model(spark, sf):
    from checks.logs_view import logs

    rows = logs(spark, sf).select("log_id", "log_message", "target_label")
    return rows, learn.train(rows, "target_label", learn.text_features(size=512))


def test_text_model_beats_the_majority_class(text_model, folder):
    rows, model = text_model
    done = model.predict(rows)
    share = done.agg(F.avg((F.col("predicted") == F.col("target_label")).cast("int")).alias("a")).first().a
    top = rows.groupBy("target_label").count().agg(F.max("count")).first()[0] / rows.count()
    assert share > top
    model.save(f"{folder}/lr")
    again = learn.TextModel.load(f"{folder}/lr", model.classes).predict(rows)
    assert again.join(done.select("log_id", F.col("predicted").alias("p")), "log_id").filter("predicted <> p").count() == 0


def test_model_tier_in_the_cascade(lines, text_model):
    _, model = text_model
    df = lines("Backup completed successfully.", "zzz qqq", "a crash of the sky")
    tops = [max(r.probabilities) for r in model.predict(df).orderBy("log_id").collect()]
    line = (max(tops) + min(tops)) / 2
    tiers = [cl.model_tier(model.model, model.classes, threshold=line), cl.keyword_tier()]
    rows = cl.Cascade(tiers).classify(df).orderBy("log_id").collect()
    assert (rows[0].classification, rows[0].method) == ("System Notification", "bert")
    assert [r.method for r in rows] == ["bert" if t >= line else "llm" for t in tops]


def test_models_see_undecided_lines_only(spark, lines, text_model):
    _, model = text_model
    df = lines("Backup completed successfully.", "zzz qqq", "a crash of the sky")
    fits = cl.Cascade([cl.pattern_tier(), cl.model_tier(model.model, model.classes, threshold=0.0), cl.keyword_tier()], entities=None)
    done = fits.classify(df)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN isnull\(_best#\d+\) THEN log_message#\d+", plan)
    alone = {r.log_id: r.predicted for r in model.predict(df).collect()}
    rows = done.orderBy("log_id").collect()
    assert [(r.classification, r.method) for r in rows] == [("System Notification", "regex"), (alone[1], "bert"), (alone[2], "bert")]
    assert [r.log_message for r in rows] == ["Backup completed successfully.", "zzz qqq", "a crash of the sky"]


def test_vector_tier_keeps_bad_vectors_apart(spark):
    import numpy as np

    seen = spark.sparkContext.accumulator(0)
    tier = cl.vector_tier(np.array([[1.0, 0.0], [0.0, 1.0]]), np.zeros(2), ["left", "right"], threshold=0.6)
    watched = cl.BatchTier(tier.method, lambda v: (seen.add(len(v)), tier.decide(v))[1], tier.reads)
    vectors = [[4.0, 0.0], [0.0, 3.0], [1.0, 1.0], [1.0], [float("nan"), 1.0], None, [5.0, 1.0]]
    messages = ["q"] * 6 + ["Backup started"]
    df = spark.createDataFrame(list(zip(range(7), messages, vectors)), "log_id int, log_message string, embedding array<double>").coalesce(1)
    failures = cl.Failures(spark)
    done = cl.Cascade([cl.pattern_tier(), watched, cl.keyword_tier()], entities=None).classify(df, failures=failures).collect()
    assert [r.classification for r in done] == ["left", "right", "Unclassified", "Unclassified", "Unclassified", "Unclassified", "System Notification"]
    assert failures.lines() == {"bert": 2} and seen.value > 5
    assert done[0].confidence == pytest.approx(1 / (1 + math.exp(-4)) - 0.05)


def test_a_broken_tier_is_asked_a_set_number_of_times(spark):
    calls = spark.sparkContext.accumulator(0)

    def down(lines):
        calls.add(1)
        raise RuntimeError("down")

    df = spark.range(500).select(F.col("id").alias("log_id"), F.lit("zzz").alias("log_message")).coalesce(1)
    failures = cl.Failures(spark)
    tiers = [cl.BatchTier("bert", down, tries=20), cl.keyword_tier()]
    done = cl.Cascade(tiers, entities=None).classify(df, failures=failures)
    assert {r.method for r in done.collect()} == {"llm"}
    assert calls.value == 20 and failures.lines() == {"bert": 500}


def test_a_step_that_cannot_be_built_is_left_out(spark, lines):
    failures = cl.Failures(spark)
    tiers = [cl.FrameTier("bert", lambda df: df.select("no_such_column")), cl.keyword_tier()]
    with pytest.warns(UserWarning, match="left out"):
        done = cl.Cascade(tiers).classify(lines("zzz"), failures=failures)
    assert done.first().method == "llm" and list(failures.not_built) == ["bert"]


def test_anomaly_tier_scores_undecided_lines_only(spark, vectors):
    forest = anomaly.fit_forest(vectors)
    df = vectors.withColumn("log_message", F.when(F.col("vec_id") % 2 == 0, "Backup started").otherwise("quiet"))
    done = cl.Cascade([cl.pattern_tier(), anomaly.anomaly_tier(forest), cl.keyword_tier()], entities=None).classify(df)
    want = anomaly.score_anomalies(vectors, forest).where("is_anomaly and vec_id % 2 = 1").select("vec_id").collect()
    got = done.where("classification = 'Anomaly'").select("vec_id").collect()
    assert sorted(got) == sorted(want) and got
    assert done.where("vec_id % 2 = 0 and method <> 'regex'").count() == 0


def test_word_importance_equals_masking(lines, text_model):
    _, model = text_model
    df = lines("task failed: job 7 timed out", "Backup", "memory usage at 9 percent memory", "", "  a   b ")
    key = lambda d: sorted((r.log_id, r.pos, r.word, r.predicted_label, round(r.importance, 3)) for r in d.collect())
    fast = explain.explain_words(df, model)
    slow = explain.explain_masked(df, model.predict, model.classes)
    assert key(fast) == key(slow)
    one = [r for r in fast.collect() if r.log_id == 1]
    assert [(r.word, r.importance) for r in one] == [("Backup", 1.0)]


def test_word_hash_is_the_featurizers(spark):
    from pyspark.ml.feature import HashingTF

    words = ["a", "ab", "abc", "abcd", "Übung", "日本", "👍🏽 x", "memory", "z" * 31]
    rows = spark.createDataFrame([([w],) for w in words], "w array<string>")
    got = HashingTF(inputCol="w", outputCol="v", numFeatures=4096).transform(rows).collect()
    signed = lambda h: h - (1 << 32) if h >> 31 else h
    assert [int(r.v.indices[0]) for r in got] == [signed(explain.word_hash(r.w[0].encode())) % 4096 for r in got]


def test_explained_where_the_line_is(lines, text_model):
    _, model = text_model
    df = lines("task failed: job 7 timed out", "Backup", "memory usage at 9 percent memory", "", "  a   b ", None)
    done = explain.explain_batch(df, model, n=3)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1
    words = explain.explain_words(df, model)
    want = explain.top_words(words, n=3).select(done.columns).collect()
    assert sorted(map(str, done.collect())) == sorted(map(str, want)) and want


def test_top_words_order(spark):
    rows = [(1, p, w, i) for p, (w, i) in enumerate([("a", 0.1), ("b", -0.3), ("c", 0.1), ("d", 0.0005), ("e", 0.3)])]
    df = spark.createDataFrame(rows, "log_id int, pos int, word string, importance double")
    got = [r.word for r in explain.top_words(df, n=4).orderBy("rank").collect()]
    assert got == ["b", "e", "a", "c"]
    assert [r.word for r in explain.top_words(df, n=5).orderBy("rank").collect()] == got


def test_cross_validation_runs_on_every_fold(vectors):
    rows = learn.vectors(vectors).select("vec_id", "label", "features")
    scores = learn.cross_validate(rows, "label", "vec_id", folds=2)
    assert {r.fold for r in scores.collect()} == {0, 1}
    assert sum(r.total_samples for r in scores.collect()) == rows.count()


def test_folds_keep_rows_without_label(spark):
    from logwarden.operators.learn import assign_folds

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(30)], "log_id bigint, y string")
    assert assign_folds(rows, "y", "log_id").count() == 30


def test_models_load_by_their_folder(spark, lines, text_model, vectors, folder):
    from logwarden.operators.bundle import Bundle

    _, model = text_model
    forest = anomaly.fit_forest(vectors)
    platt = calibrate.PlattModel(model.classes, [1.0] * len(model.classes), [0.0] * len(model.classes))
    Bundle(model, platt, forest).save(spark, f"{folder}/models")
    again = Bundle.load(spark, f"{folder}/models")
    assert (again.model.classes, again.platt.slope, again.forest.offset) == (model.classes, platt.slope, forest.offset)
    df = lines("Backup completed successfully.", "zzz qqq")
    key = lambda m: [(r.predicted, r.probabilities) for r in m.predict(df).orderBy("log_id").collect()]
    assert key(again.model) == key(model)
    Bundle(forest=forest).save(spark, f"{folder}/one")
    assert Bundle.load(spark, f"{folder}/one").model is None
    nothing = Bundle.load(spark, f"{folder}/not there")
    assert nothing == Bundle()
    done = cl.Cascade([*nothing.tiers(), cl.keyword_tier()]).classify(df)
    assert {r.method for r in done.collect()} == {"llm"}


def test_three_parts_of_a_held_out_run_are_disjoint(spark, vectors):
    rows = learn.vectors(vectors).select("vec_id", "label", "features")
    folds = learn.assign_folds(rows, "label", "vec_id")
    parts = [{r.vec_id for r in folds.where(w).collect()} for w in ("fold < 3", "fold = 3", "fold = 4")]
    assert sum(map(len, parts)) == len(set.union(*parts)) == rows.count()
    _, _, scored = learn.calibrated_holdout(rows, "label", "vec_id")
    got = scored.collect()
    assert {r.vec_id for r in got} == parts[2] and all(sum(r.calibrated) == pytest.approx(1.0) for r in got)


def test_slices_of_a_large_label_are_ranked_in_order(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 = 0, NULL, 'hot') AS label")
    got = learn.stratified_position(df, "label", "id", slice_rows=1).collect()  # cuts every part further
    for label, n in ((None, 500), ("hot", 4500)):
        mine = [r for r in got if r.label == label]
        assert sorted(r.position for r in mine) == list(range(n)) and {r.stratum_size for r in mine} == {n}


def test_explaining_many_words_takes_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    weights = explain.WordWeights.__new__(explain.WordWeights)
    weights.table, weights.bias, weights._at = np.random.default_rng(0).normal(size=(64, 10)), np.zeros(10), {}
    lines = pa.array([[f"w{(i * 7 + k) % 50}" for k in range(200)] if i % 9 else [] for i in range(3000)])
    tracemalloc.start()
    got = weights.explain(lines, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all 533,200 words at once take over 100 MB
    assert got.equals(pa.concat_arrays([weights.explain(lines.slice(k, 1), None) for k in range(len(lines))]))
    assert len(weights.explain(lines.slice(0, 0), None)) == 0

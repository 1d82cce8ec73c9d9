"""The context model of operator 5 learns from every training text."""

from __future__ import annotations

import numpy as np
import pytest

from logwarden.llm import lm_scoring


def test_context_is_learned_without_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAMPLE", 0)
    text = "alpha beta gamma delta " * 500
    docs = spark.range(600, numPartitions=2).selectExpr("id AS doc_id", f"'{text}' AS text")
    rows = lm_scoring.score_documents(docs, docs.where(~lm_scoring.held_out())).collect()
    assert len(rows) == 600
    assert min(r.score / r.n_tokens for r in rows) > -0.3  # counts alone give log10(1/4) = -0.6


@pytest.mark.parametrize("size", [1, 2, 40, 300_000])
def test_every_id_is_learned_once(size):
    ids = np.random.default_rng(1).integers(0, 50, size)
    counts = np.bincount(ids, minlength=lm_scoring.IDS).astype(float)
    lesson = lm_scoring.Lesson(lm_scoring.train(np.zeros((0, lm_scoring.CONTEXT + 1), np.int64), counts))
    met = np.zeros(lm_scoring.IDS)

    def step(windows, rate):
        met[:] += np.bincount(windows[:, 1:].ravel(), minlength=lm_scoring.IDS)

    lesson.learner.step = step
    lesson.add(np.array([lm_scoring.END]))
    for part in np.array_split(ids, 7):
        lesson.add(part)
    sums = list(lesson.sums())
    assert (met == counts).all()
    assert sums[0][2][-1] == size


def test_equal_lessons_merge_to_themselves():
    ids = np.random.default_rng(1).integers(0, 50, 5000)
    start = lm_scoring.train(np.zeros((0, lm_scoring.CONTEXT + 1), np.int64), np.bincount(ids, minlength=lm_scoring.IDS).astype(float))
    sums = {}
    lessons = [lm_scoring.Lesson(lm_scoring.Model({k: v.copy() for k, v in start.values.items()}, start.kind, start.place, start.within)) for _ in range(2)]
    for lesson in lessons:
        lesson.add(ids)
        for block, place, x in lesson.sums():
            size = int(place.max()) + 1 if block < 0 else lm_scoring.ROWS_A_BLOCK * (lm_scoring.WIDTH + 1)
            np.add.at(sums.setdefault(block, np.zeros(size)), place, x)
    model = lm_scoring.merged(start, sums)
    for k, v in lessons[0].learner.model.values.items():
        assert np.allclose(v, model.values[k], atol=1e-5), k
    assert not np.allclose(start.values["near"], model.values["near"])


def test_gradient():
    ids = np.random.default_rng(1).integers(0, 60, (5, lm_scoring.CONTEXT + 1))
    model = lm_scoring.train(ids, np.bincount(ids.ravel(), minlength=lm_scoring.IDS).astype(float), steps=5)
    model.values = {k: v.astype("f8") for k, v in model.values.items()}
    _, at, grads = model.gradient(ids[:, :-1], ids[:, 1:])
    full = np.zeros_like(model.values["embed"])
    full[at] = grads["embed"]
    grads["embed"] = full
    assert grads.keys() == model.values.keys()
    for k, v in model.values.items():
        spot = np.unravel_index(np.abs(grads[k]).argmax(), v.shape)
        old, found = v[spot], []
        for e in (1e-5, -1e-5):
            v[spot] = old + e
            found.append(model.gradient(ids[:, :-1], ids[:, 1:])[0])
        v[spot] = old
        assert grads[k][spot] == pytest.approx((found[0] - found[1]) / 2e-5, rel=1e-3), k


def test_windows_score_like_single_ids():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 60, (40, lm_scoring.CONTEXT + 1))
    model = lm_scoring.train(ids, np.bincount(ids.ravel(), minlength=lm_scoring.IDS).astype(float), steps=5)
    texts = [np.concatenate([[lm_scoring.END], rng.integers(0, 60, n), [lm_scoring.END]]) for n in (0, 1, 30, 31, 32, 33, 55, 56, 57, 200)]
    step = lm_scoring.CONTEXT - lm_scoring.LEAD
    for text, score in zip(texts, model.score(texts), strict=True):
        want = 0.0
        for k in range(1, len(text)):
            lo = max((k - 1 - lm_scoring.LEAD) // step, 0) * step
            h = model._layer(text[None, lo:k])["h"][-1:]
            want += float(model.logs(h, text[k : k + 1])[0][0])
        assert score == pytest.approx(want / np.log(10), rel=1e-5)


def test_texts_that_are_learned_and_scored_are_encoded_once(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEPS", 20)
    docs = spark.range(60, numPartitions=2).selectExpr("id AS doc_id", "repeat(concat('Alpha w', id % 7, ' rare', id, ' '), 40) AS text")
    tables = []

    def stored(df, name, compression=None):
        tables.append((name, df.cache()))
        return tables[-1][1]

    monkeypatch.setattr(lm_scoring, "stored", stored)
    got = lm_scoring.score_documents(docs, ~lm_scoring.held_out()).collect()
    texts = dict(tables)["texts"].where("ids IS NOT NULL")
    assert texts.count() == 60
    assert texts.where("learned").count() == docs.where(~lm_scoring.held_out()).count()
    want = lm_scoring.score_documents(docs, docs.where(~lm_scoring.held_out())).collect()
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a.base_score == pytest.approx(b.base_score)
        assert a.score == pytest.approx(b.score, rel=0.05)  # other tasks, other means


def test_numbered_words():
    path = lm_scoring.tokenizer_path(lm_scoring.VOCABULARY)
    words, plain = lm_scoring.NumberedWords(path, {b"": 9, b"alpha": 99}), lm_scoring.Words(path)
    text = [b"alpha", b"rare1", "ü$\xa0".encode(), b"alpha", b"x" * 99, b""]
    for _ in range(2):
        ids, numbers = words.numbered(text)
        assert ids.tolist() == plain.text(text[:-1])[1:].tolist()
        assert numbers.tolist() == [2, 0, 0, 2, 0, 1]
    assert words.logs.tolist() == [0, 1, 2]

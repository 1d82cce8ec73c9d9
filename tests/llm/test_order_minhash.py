"""Order MinHash fingerprints against a plain version, and what they are for."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from logwarden.llm import order_minhash as om

SCHEMA = "doc_id bigint, text string, lang string, tie string, n_chars string, fingerprint int, order__ int, range__ int"


def signed(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def chained(*numbers: int) -> int:
    h = 42
    for x in numbers:
        h = signed(x.to_bytes(8, "little", signed=True), h)
    return h


def fingerprint(text, k=om.K, components=om.COMPONENTS, chosen=om.CHOSEN):
    if not text:
        return ""
    tokens = [t.encode() for word in text.split(" ") for t in ([word] if len(word) <= om.LONG else word)]
    kmers = [tokens[i : i + k] for i in range(max(1, len(tokens) - k + 1))]
    seen, points = Counter(), []
    for place, kmer in enumerate(kmers, 1):
        h = 42
        for t in kmer:
            h = signed(t, h)
        h >>= 32
        points.append(((chained(h, seen[h]) >> 32) if seen[h] else h, place))
        seen[h] += 1
    points.sort()
    out = ""
    for j in range(components):
        first = sum(p[0] < (j << 32) // components for p in points)
        taken = [points[(first + t) % len(points)] for t in range(min(chosen, len(points)))]
        out += f"{chained(*[h for h, _ in sorted(taken, key=lambda p: p[1])]) & 0xFFFF:04x}"
    return out


def near(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "of", "naïve", "日本語", "👍🏽", "alpha", "beta", "\n", "ab", "."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    texts += [None, "", "a", "seven77", "eight888", "z" * 2500, "ab" * 400, "👍" * 70, "á" * 40, " ".join(rng.choice(words) for _ in range(5000)), texts[0], texts[0]]
    out = [(3 * i - 20, t) for i, t in enumerate(texts)]
    return [*out, (None, "no id at all"), (1, "same id"), (1, "same id"), (1, "other text of this id")]


@pytest.mark.parametrize("range_rows", [1, 3, 10, om.RANGE_ROWS])
def test_fingerprints_against_plain_version(spark, rows, range_rows):
    docs = spark.createDataFrame([(i, t, "en", "t", "n", 1, 2, 3) for i, t in rows], SCHEMA).repartition(4)
    got = om.fingerprints(docs, range_rows=range_rows).collect()
    tie = dict(spark.createDataFrame([(t or "",) for _, t in rows], "t string").distinct().select("t", F.xxhash64("t")).collect())
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b = fingerprint(t), fingerprint(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, fingerprint(after))))
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_order_and_edits_show(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    text = " ".join(words)
    swapped = " ".join(words[300:] + words[:300])
    few = text[:500] + "X" + text[501:1500] + text[1510:]
    frame = spark.createDataFrame([(text, few, swapped, " ".join(sorted(words)))], "a string, b string, c string, d string")
    for c in "abcd":
        frame = om.with_fingerprint(frame, c, f"f{c}")
    row = frame.select(*[om.likeness("fa", f"f{c}") for c in "abcd"]).first()
    assert row[0] == 1.0 and row[1] > 0.8 and 0.3 < row[2] < 0.8 and row[3] < 0.3


def test_other_parameters(spark, rows):
    docs = spark.createDataFrame([(t,) for _, t in rows], "t string")
    got = om.with_fingerprint(docs, "t", "f", k=2, components=10, chosen=4).collect()
    assert all(r.f == fingerprint(r.t, 2, 10, 4) for r in got)


def test_no_rows_and_one_row(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert om.fingerprints(docs).collect() == []
    row = om.fingerprints(spark.createDataFrame([(7, "only one text here")], "doc_id bigint, text string")).first()
    assert row.near_next == 1.0 and row.n_chars == 18


def test_fingerprints_run_without_python(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    plan = om.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "InPandas", "InArrow", "CartesianProduct", "NestedLoop"))

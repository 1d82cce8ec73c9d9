"""Collocations against counts of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from logwarden.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, f string, score int, phrase string, w1 string"


def brute(rows, least, share, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for size in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    q = p[i : i + size]
                    inside[q] = max(inside[q], a)
        best = []
        for p, a in found.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["of", "the", "New", "York", "city", "Österreich", "ÖSTERREICH", "naïve", "a b", "x-y", " z", "日本"]
    texts = []
    for i in range(150):
        words = [rng.choice(vocabulary[: rng.choice([4, 12])]) for _ in range(rng.randint(0, 40))]
        texts.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for w in words), rng.choice(["en", "de", "und", None])))
    texts += [(None, "en"), ("", "en"), (" \t ", None), ("...", "xx"), ("one", "only"), ("The the THE the the the", "en")]
    texts += [("hot line of words, " * 3000, "en")] * 2 + [texts[0]] * 3
    return texts


@pytest.mark.parametrize(
    ("coded", "block", "least", "share", "first"),
    [(collocations.CODED, collocations.BLOCK, 2, 80, 2000), (0, 700, 3, 50, 7), (6, 64, 2, 50, 2000), (1, 5000, 3, 80, 7)],
)
def test_collocations_against_brute_force(spark, rows, coded, block, least, share, first):
    docs = spark.createDataFrame([(i, t, x, "s", 1, "f", 2, "p", "w") for i, (t, x) in enumerate(rows)], SCHEMA).repartition(5)
    got = collocations.collocations(docs, least, share, first, coded, block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, share, first)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(docs).collect() == []


def test_sums_past_64_bits(spark):
    big = 1 << 62
    counts = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big), ("en", "", 0, big)], "lang string, phrase string, size int, f bigint")
    row = collocations.scored(counts).first()
    assert row.score == 2000000 * (big - 1) // (2 * big) and row.l == row.r == big

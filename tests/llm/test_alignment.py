"""Links of two tokenizers' tokens against whole-text encodings and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from logwarden.llm import alignment
from logwarden.llm.tokens import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, chunk string, n_a string, a string, pairs int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["alpha", "Übung", "naïve", "don't", "x=1;", "日本語", "👍🏽", "12345", " ", "é", "internationalization", "<|endoftext|>", "</s>", "<0x41>"]
    out = [None, "", " ", "  ", "\n", "\n\n a", " lead", "trail ", "a  b   c", "x\n\ny\r\nz}\r\n", "\t\ttab", "mark ▁ inside", "a▁b", "\x00\x01\x1c nul", "z" * 3000, "ab" * 700]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", ". ", "\t", "　", "  "]) for _ in range(rng.randint(1, 40))))
    return out + [out[20], out[20], out[21] * 60]


def tokens_of(text):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    whole = tokens_of.__dict__.setdefault("tokenizer", Tokenizer.from_file(tokenizer_path(alignment.BYTES)))
    whole.encode_special_tokens = True
    pieces = tokens_of.__dict__.setdefault("pieces", SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECES)))
    if not text:
        return None
    enc = whole.encode(" " + text, add_special_tokens=False)
    byte = alignment._bytes_of_characters()
    a = [(i, bytes(byte[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
    b = []
    for i in pieces.encode(text):
        p = pieces.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else None


def ends(tokens):
    return np.cumsum([len(x) for _, x in tokens]).tolist()


def groups_of(text):
    both = tokens_of(text)
    if both is None:
        return []
    cut = sorted(set(ends(both[0])) & set(ends(both[1])))
    out = [([], []) for _ in cut]
    for side in (0, 1):
        for (i, _), e in zip(both[side], ends(both[side])):
            out[int(np.searchsorted(cut, e))][side].append(i)
    return out


def overlaps_of(text):
    both = tokens_of(text)
    if both is None:
        return []
    spans = [[(e - len(x), e) for (_, x), e in zip(t, ends(t))] for t in both]
    return [(i, j, min(p[1], q[1]) - max(p[0], q[0])) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if max(p[0], q[0]) < min(p[1], q[1])]


@pytest.fixture(scope="module")
def expected(texts):
    groups = [groups_of(t) for t in texts]
    links = [Counter() for _ in texts]
    for g, n in zip(groups, links):
        for a, b in g:
            for i, x in Counter(a).items():
                for j, y in Counter(b).items():
                    n[i, j] += x * y
    held = Counter(p for n in links for p in n)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = []
    for i, (g, n) in enumerate(zip(groups, links)):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        rows.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
            sum(c for p, c in n.items() if held[p] == best[p[0]]), sum(c * held[p] for p, c in n.items()),
        ))
    return rows


@pytest.mark.parametrize("chunk", [1, 300, alignment.CHUNK])
def test_alignment_against_brute_force(spark, texts, expected, chunk):
    docs = spark.createDataFrame([(i, t, "en", "c", "n", "a", 5) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = alignment.aligned(docs, chunk).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted(map(tuple, got.collect())) == expected


def test_overlaps_against_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.links for r in alignment.overlap_links(docs).collect()}
    counts = {r.doc_id: r.n_overlaps for r in alignment.aligned(docs).collect()}
    for i, t in enumerate(texts):
        if len(t or "") < 1000:
            assert [(x.a_at, x.b_at, x.bytes) for x in got[i]] == overlaps_of(t)
            assert counts[i] == len(got[i])


def test_products_in_blocks():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (30, 40)) * rng.integers(0, 2, (30, 40)), rng.integers(0, 3, (40, 20))
    sparse = [alignment.Csr(np.append(0, np.cumsum((m != 0).sum(1))), np.nonzero(m)[1], m[m != 0], m.shape[1]) for m in (a, b)]
    for terms in (1, 50, 10**6):
        out = np.zeros((30, 20), dtype=int)
        for rows, columns, values in sparse[0].times(sparse[1], terms):
            out[rows, columns] += values
        assert (out == a @ b).all()
    back = sparse[0].transposed().transposed()
    assert (back.columns == sparse[0].columns).all() and (back.values == sparse[0].values).all()


def test_alignment_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id bigint, text string")
    got = alignment.aligned(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"] and {r.count_sum for r in got} == {3 * got[0].n_links}
    assert alignment.aligned(docs.limit(0)).collect() == []

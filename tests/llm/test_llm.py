"""The llm operators against brute force, over awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from logwarden.llm import embedding_dedup, exact_dedup, language_id, lm_scoring, mixing, packing, sharding, simhash, token_counts, tokens, toxicity
from logwarden.llm.common import ROW, by_number, components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard int, row bigint, h string, digest string, fp bigint, label int"


def words(n, rng):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "Übung", "naïve"]) + rng.choice(["", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [words(rng.randint(1, 60), rng) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "Two Words", "two words", "TWO WORDS", "a  b   c", " lead", "trail ", "x\n\ny\nz", "<|endoftext|> in a text"]
    texts += [words(9000, rng), "z" * 20000, texts[0], texts[0], texts[1].upper()]
    near = texts[5].split() * 6
    texts += [" ".join(near), " ".join(near[:-1] + ["changed"])]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4]) for i, t in enumerate(texts)]
    out += [(3, texts[3], "en", "s1"), (3, texts[3], "en", "s1"), (None, "no id", "en", "s1"), (-5, texts[0], None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "h", "d", 5, 6) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def utf8(t):
    return (t or "").encode()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_vectors_of_extreme_length_link(spark):
    base = [0.5, -1.0, 0.25, 2.0]
    rows = [(i, [x * scale for x in base], 1) for i, scale in enumerate((1e-200, 1e200, 1.0, 5e-308, 8e307))]
    rows += [(10, [-x for x in base], 1), (11, [x * 1e200 for x in base], 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {**dict.fromkeys(range(5), (4, 0)), 10: (0, 10), 11: (0, 11)}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_sharding(spark, docs, rows, nothing):
    got = sharding.range_shards(docs, 4).collect()
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == Counter((i, zlib.crc32(utf8(t)), len(utf8(t)) + 8) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(4))
    assert sharding.range_shards(nothing).count() == 0


def test_hot_text_is_divided(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    sizes = [r["s"] for r in sharding.range_shards(d, 6).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 6 and max(sizes) < 1.05 * sum(sizes) / 6 and min(sizes) > 0.95 * sum(sizes) / 6


def test_exact_duplicates(docs, rows, nothing):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[hashlib.sha256(utf8(t).lower()).hexdigest()].append(i)
    for counters in (1, 2, 1024):
        got = exact_dedup.exact_duplicates(docs, counters=counters).collect()
        assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, d) for d, ids in by.items() for i in ids)
        for r in got:
            ids = [i for i in by[r.text_sha256] if i is not None]
            assert r.keep_id == max(ids, default=None) and r.group_size == len(by[r.text_sha256])
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by.keys())
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def print_of(t, n):
    w = utf8(t).lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_cover():
    rng = random.Random(5)
    for radius in (2, 4):
        masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
        assert all(any(not m & bits for m in masks) for bits in (sum(1 << i for i in rng.sample(range(64), radius)) for _ in range(3000)))


@pytest.mark.parametrize("bucket", [48, 1])
def test_simhash(docs, rows, nothing, bucket):
    got = simhash.simhash_groups(docs, bucket=bucket).collect()
    prints = {t: print_of(t, 3) for _, t, *_ in rows}
    links = [(a, b) for a in set(prints.values()) for b in set(prints.values()) if a < b and bin(a ^ b).count("1") <= 2]
    root = roots(set(prints.values()), links)
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[root[prints[t]]] = min(least.get(root[prints[t]], i), i)
    want = Counter((i, f"{prints[t]:016x}", least.get(root[prints[t]])) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_groups(nothing).count() == 0


def test_similar_groups(spark):
    rng = random.Random(9)
    base = words(300, rng).split()
    texts = [" ".join(base), " ".join(base[:150] + ["new"] + base[151:]), words(300, rng), "short", "SHORT ", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), f"{ROW} bigint, text string")
    got = {r[ROW]: r.component for r in simhash.similar_groups(d, ROW).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}


def shingles_of(t, n=5):
    w = utf8(t).lower().split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {b" ".join(w)}


def edited(w, n, rng):
    """The words with ``n`` of them replaced, far enough apart that each changes five shingles."""
    w = list(w)
    for k in rng.sample(range(len(w) // 6), n):
        w[6 * k + 2] = f"new{rng.random()}"
    return w


def similar_pairs(texts):
    sets = [shingles_of(t) for t in texts]
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(sets)) for j in range(i)]
    return [(i, j, s) for i, j, s in pairs if s >= 0.8]


def recall(spark, texts, links, **how):
    """Share of the links whose ends get one component; nothing else may be joined."""
    d = spark.createDataFrame(list(enumerate(texts)), f"{ROW} bigint, text string").repartition(5)
    got = {r[ROW]: r.component for r in simhash.similar_groups(d, ROW, **how).collect()}
    want = roots(range(len(texts)), [(i, j) for i, j, _ in links])
    assert all(want[i] == want[got[i]] for i in got)
    found = sum(got[i] == got[j] for i, j, _ in links) / max(len(links), 1)
    print(f"{len(links)} links, recall {found:.3f}")
    if found == 1:
        assert got == want
    return found


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 450))]
        least, most = len(base) // 100, len(base) // 44
        texts += [" ".join(base), " ".join(edited(base, rng.randint(least, most), rng))]
    links = similar_pairs(texts)
    assert sum(s < 0.85 for *_, s in links) > 20 and sum(s < 0.95 for *_, s in links) > 100
    assert recall(spark, texts, links) == 1


@pytest.fixture(scope="module")
def crowd():
    """Copies of few texts, edited at places of their own, and copies of some copies: one key has many texts, few of them are similar."""
    rng = random.Random(22)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(50):
            copy = edited(base, rng.randint(6, 9), rng)
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                texts.append(" ".join(edited(copy, rng.randint(3, 6), rng)))
    return texts, similar_pairs(texts)


@pytest.mark.parametrize("most, chunk", [(24, 512), (1, 9)])
def test_crowded_keys_against_brute_force(spark, crowd, most, chunk):
    texts, links = crowd
    assert len(links) > 40 and max(Counter(s for t in texts for s in shingles_of(t)).values()) > 24
    assert recall(spark, texts, links, crowd=most, chunk=chunk) == 1


def test_fingerprints_join_near_copies_by_themselves(spark, monkeypatch):
    rng = random.Random(23)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join(base[:-1] + ["end"]), " ".join(base).upper()]
    prints = [simhash.fingerprint(utf8(t), 5) for t in texts]
    sets = [shingles_of(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 2]
    assert len(near) > 100 and all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in near)
    d = spark.createDataFrame(list(enumerate(texts)), f"{ROW} bigint, text string").repartition(3)
    monkeypatch.setattr(simhash, "_keys", lambda frames, **_: iter(()))  # nothing comes by the way for the rest
    got = {r[ROW]: r.component for r in simhash.similar_groups(d, ROW).collect()}
    assert got == roots(range(len(texts)), near)


def test_a_key_over_several_frames_keeps_its_leader():
    key, row = np.zeros(60, np.int64), np.arange(60)
    frame = pd.DataFrame({"key": key, "row": row, "size": np.full(60, 9, np.int32), "place": np.zeros(60, np.int32)})
    runs = simhash._with_key_runs
    cut = [frame.iloc[:50], frame.iloc[50:]]
    simhash._with_key_runs = lambda frames: runs(frames, most=40)
    try:
        out = pd.concat(list(simhash._bucket_pairs(iter(cut), 0.8)))
    finally:
        simhash._with_key_runs = runs
    pairs = out[out["key"].isna()]
    counts = Counter([*pairs["a"], *pairs["b"]])
    assert counts.most_common(1)[0][1] >= 59 and sorted(out[~out["key"].isna()]["a"]) == row.tolist()


def test_targets_are_the_fixed_point(spark):
    sizes = {"b": 10, "a": 1000, None: 500, "c": 40, "d": 0}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        left, rest = total - sum(full.values()), [n for n in names if n not in full]
        share = {n: left * weight[n] / sum(weight[m] for m in rest) for n in rest}
        if not (over := [n for n in rest if share[n] > 2 * sizes[n]]):
            break
        full |= {n: 2 * sizes[n] for n in over}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == full | share


def test_mix(spark, docs, rows, nothing):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(utf8(t).split())) for i, t, *_ in rows)
    assert all(r.taken == r["size"] * r.copies and r.taken <= 2 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mix(nothing).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 50).cast("int")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    sums = mixing.mix(many, "doc_id").join(many.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 1 for r in sums)


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path(packing.VOCABULARY))
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.update((i, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(nothing).count() == 0


def test_best_fit_decreasing_takes_the_tightest_window():
    lengths = np.random.default_rng(0).integers(1, 101, 500)
    place, offset = packing.best_fit_decreasing(lengths, 100)
    free: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(100 - n)
    used = np.bincount(place, lengths)
    assert len(used) == len(free) and used.max() <= 100


def test_token_counts(docs, rows, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = token_counts.unigram_vocabulary(tokens.tokenizer_path(token_counts.VOCABULARY))
    exact = Tokenizer(models.Unigram(pieces, unknown, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert got == Counter((i, len(exact.encode(t, add_special_tokens=False).ids) if t else 0) for i, t, *_ in rows)
    assert token_counts.token_counts(nothing).count() == 0


def test_linked_vectors(spark, nothing):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centre[i % 12] + rng.normal(size=16) * (0.1 if i % 3 else 0.3)
        rows.append((i, v.tolist(), [1, 2, None][i % 7 % 3]))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [math.nan] * 16, 1), (2003, [None] * 16, 1), (2004, [], 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1)]
    good = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows if r[0] < 2000 or r[0] > 2004}
    label = {r[0]: r[2] for r in rows}
    pairs = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and label[a] is not None and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98]
    links, root = Counter(x for p in pairs for x in p), roots(good, pairs)
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, cell string")
    for chunk in (1024, 7):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.linked_vectors(d, chunk=chunk).collect()}
        assert got == {i: (links[i], root.get(i, i), root.get(i, i) == i) for i, *_ in rows}
    assert embedding_dedup.linked_vectors(d.limit(0)).count() == 0


def test_toxicity_chain(spark, docs, nothing):
    rng = random.Random(2)
    bad = ["vile", "nasty", "awful"]
    texts, junk, toxic = [], [], []
    for i in range(600):
        w = words(30, rng).split()
        junk.append(int(i % 5 == 0))
        toxic.append(int(i % 4 == 0))
        w += ["%%junk%%"] * junk[-1] + [rng.choice(bad)] * toxic[-1]
        rng.shuffle(w)
        texts.append(" ".join(w).encode())
    chain = toxicity.fit_chain(texts[:400], {"junk": np.array(junk[:400]), "toxic": np.array(toxic[:400])})
    p = chain.predict(texts[400:])
    assert ((p[:, 1] > 0.5) == (np.array(toxic[400:]) == 1)).mean() > 0.97
    assert len(chain.models[1].earlier) == 1
    got = toxicity.toxicity(docs, chain)
    assert got.count() == docs.count() and got.where("toxic is null").count() == 0
    assert toxicity.toxicity(docs, chain, keep_columns=True).columns == [*docs.columns, "toxic__"]
    assert toxicity.toxicity(nothing, chain).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    empty = toxicity.fit(nothing, labels, toxicity.label_categories())
    assert toxicity.toxicity(docs, empty).where("toxic").count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(8)
    texts = [(words(1500, rng) + (" vile nasty" if i % 3 == 0 else " calm kind") + f" {words(20, rng)}").encode() for i in range(300)]
    flags = np.array([int(i % 3 == 0) for i in range(300)])
    assert min(t.find(b"vile") for t in texts[::3]) > 8192
    d = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2, int(f)) for i, f in enumerate(flags)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(d, labels, toxicity.label_categories())
    assert ((chain.predict(texts)[:, 1] > 0.5) == (flags == 1)).all()
    rows = toxicity.training_rows(d, labels, toxicity.label_categories())
    whole = toxicity.fit_chain([texts[i] for i in range(300)], {"low_quality": np.arange(300) % 2, "toxic": flags})
    assert len(rows) == 300 and set(whole.known) & set(toxicity.features(b"vile")) and max(len(x) for x in rows["features"]) < 40


def test_language(spark, docs, nothing):
    en, de = "the cat and the dog of that house were there ", "der hund und die katze sind nicht mit ihnen ich "
    net = language_id.train([(en if i % 2 else de).encode()[k : k + 64] * 2 for i in range(40) for k in (0,)], ["en", "de"] * 0 + ["de" if i % 2 == 0 else "en" for i in range(40)], steps=120)
    names, score = net.predict([en * 30, de, None, "", "123 !?", en])
    assert names == ["en", "de", "und", "und", "und", "en"] and (score >= 0).all() and (score <= 1).all()
    got = language_id.identify(docs, net).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert language_id.identify(nothing, language_id.fit(nothing)).count() == 0


def test_language_gradient():
    net = language_id.train([b"x" * 64] * 4, ["a", "b", "a", "b"], steps=1)
    net.table, net.inner, net.out, net.bias = (v.astype("f8") for v in (net.table, net.inner, net.out, net.bias))
    data, target = np.random.default_rng(1).integers(97, 105, (9, 5)), np.array([0, 1, 0, 1, 1])
    _, grads = net.train_step(data, target)
    for v, g in zip((net.table, net.inner, net.out, net.bias), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, found = v[at], []
        for e in (1e-3, -1e-3):
            v[at] = old + e
            found.append(net.train_step(data, target)[0])
        v[at] = old
        assert g[at] == pytest.approx((found[0] - found[1]) / 2e-3, rel=1e-2)


def test_scores(docs, rows, nothing):
    training = docs.where(~lm_scoring.held_out())
    got = lm_scoring.score_documents(docs, training).collect()
    counts = Counter()
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(utf8(t).lower().split() + [b""])
    n, v, want = sum(counts.values()), len(counts), Counter()
    for i, t, *_ in rows:
        w = utf8(t).lower().split() + [b""]
        want[(i, len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_documents(nothing, nothing).count() == 0


def test_scores_add_up_to_one():
    ids = np.random.default_rng(0).integers(0, 300, (40, lm_scoring.CONTEXT + 1))
    model = lm_scoring.train(ids, np.bincount(ids.ravel(), minlength=lm_scoring.IDS).astype(float), steps=5)
    h = model._layer(ids[:1, :4])["h"][-1:]
    logs, _ = model.logs(np.repeat(h, lm_scoring.IDS, axis=0), np.arange(lm_scoring.IDS))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    table = docs.select(*corpus_pipeline.COLUMNS)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "exact_dedup":
            kept = [utf8(r.text).lower() for r in now.collect()]
            assert len(kept) == len(set(kept))
        if name != "packing":
            assert now.columns == corpus_pipeline.COLUMNS
    assert now.count() > 0


@pytest.mark.parametrize("most", [0, 10])
def test_rows_by_number_sent_or_shuffled(spark, most):
    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(6)], "n bigint, text string")
    some = spark.createDataFrame([(1,), (3,), (9,)], "n bigint")
    kept = by_number(rows, some, "n", most=most).collect()
    assert sorted((r.n, r.text) for r in kept if r.n != 3) == [(1, "t1")] and len(kept) == 2
    assert sorted(r.n for r in by_number(rows, some, "n", "left_anti", most).collect()) == [0, 2, 4, 5]
    assert by_number(rows, some.limit(0), "n", "left_anti", most).count() == 6

"""Toxicity by a chain of linear models over categories (operator 3)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import drawn, utf8
from logwarden.session import stored

#: Labelled rows that the chain is fitted on at most, those with the smallest hashes, with their whole texts.
SAMPLE = 6_000
#: A word or prefix is a feature if its share among texts of a category is so many standard errors off; the strongest ones.
STRENGTH, FEATURES = 4.5, 8_000
PREFIXES = (4, 5, 6, 7)
FOLDS, ROUNDS, PENALTY = 4, 150, 1e-4
#: Probability of the last category from which on a document is toxic.
THRESHOLD = 0.5
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_set(data: bytes) -> set[bytes]:
    """The different words of a text: runs of letters, A-Z lower-cased, everything else of ASCII splits."""
    return set(data.translate(_WORDS).split())


def features(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings, which words of one stem share."""
    return [xxhash.xxh64_intdigest(f) - (1 << 63) for f in (word, *(b"^" + word[:n] for n in PREFIXES if len(word) > n))]


def feature_set(data: bytes) -> np.ndarray:
    """The different features of a whole text."""
    return np.unique(np.array([f for w in word_set(data) for f in features(w)], dtype=np.int64))


@dataclass
class Linear:
    """A logistic model on the presence of features and the probabilities of earlier categories."""

    weights: dict[int, float]
    earlier: np.ndarray
    bias: float

    def probability(self, rows: list[set[int]], earlier: np.ndarray) -> np.ndarray:
        get = self.weights.get
        z = np.array([sum(get(i, 0.0) for i in r) for r in rows]) + earlier @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def strongest(index: np.ndarray, owner: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Features whose share differs between the texts with ``y`` 1 and 0 by ``STRENGTH`` standard errors, ``FEATURES`` at most."""
    n1, n0 = y.sum(), len(y) - y.sum()
    with_1 = np.bincount(index, y[owner], width)
    every = np.bincount(index, minlength=width)
    share = every / len(y)
    z = np.abs(with_1 / n1 - (every - with_1) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    z[every < 3] = 0
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return best[z[best] >= STRENGTH]


def fit_linear(index: np.ndarray, owner: np.ndarray, earlier: np.ndarray, y: np.ndarray, width: int) -> Linear:
    """Logistic regression on text ``owner[k]`` having feature ``index[k]``, by Nesterov steps over all texts.

    Both outcomes weigh the same in sum. Each coordinate's step follows from the curvature that its own texts can bring.
    """
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return Linear({}, np.zeros(earlier.shape[1]), 8.0 if share == 1 else -8.0)
    chosen = strongest(index, owner, y, width)
    at = np.full(width, -1)
    at[chosen] = np.arange(len(chosen))
    owner, index = owner[at[index] >= 0], at[index[at[index] >= 0]]
    width = len(chosen)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    size = weight * (np.bincount(owner, minlength=len(y)) + 1 + (earlier**2).sum(1))
    step_w = 4 / (np.bincount(index, size[owner], width) + 4 * PENALTY)
    step_e = 4 / ((earlier**2 * size[:, None]).sum(0) + 4 * PENALTY)
    step_b = 4 / size.sum()
    w, e, b = np.zeros(width), np.zeros(earlier.shape[1]), 0.0
    w0, e0, b0 = w, e, b
    for k in range(ROUNDS):
        m = k / (k + 3)
        vw, ve, vb = w + m * (w - w0), e + m * (e - e0), b + m * (b - b0)
        z = np.bincount(owner, vw[index], len(y)) + earlier @ ve + vb
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        w0, e0, b0 = w, e, b
        w = vw - step_w * (np.bincount(index, error[owner], width) + PENALTY * vw)
        e = ve - step_e * (earlier.T @ error + PENALTY * ve)
        b = vb - step_b * error.sum()
    return Linear(dict(zip(chosen.tolist(), w.tolist(), strict=True)), e, b)


@dataclass
class Chain:
    """Categories in order, each with a linear model that also sees the probabilities of those before it."""

    categories: list[str]
    known: dict[int, int]
    models: list[Linear]

    def __post_init__(self):
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def row(self, text: bytes) -> set[int]:
        seen, out = self.seen, set()
        for word in word_set(text):
            ids = seen.get(word)
            if ids is None:
                ids = tuple(i for f in features(word) if (i := self.known.get(f)) is not None)
                if len(seen) >= 300_000:
                    seen.clear()
                if len(word) <= 64:
                    seen[word] = ids
            if ids:
                out.update(ids)
        return out

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """One row a text, one column a category."""
        rows = [self.row(t) for t in texts]
        p = np.zeros((len(texts), 0))
        for model in self.models:
            p = np.column_stack([p, model.probability(rows, p)])
        return p


def fit_chain(texts: list[bytes], targets: dict[str, np.ndarray], folds: list[int] | None = None) -> Chain:
    """A chain over ``targets`` (category to 0/1 per text), in their order."""
    return fit_features([feature_set(t) for t in texts], targets, folds)


def fit_features(rows: list[np.ndarray], targets: dict[str, np.ndarray], folds: list[int] | None = None) -> Chain:
    """A chain over ``targets`` (category to 0/1 per text), in their order, from the texts' feature sets.

    The probabilities that later models are trained with are out of fold: a text's come from models (and features chosen)
    that haven't seen its fold (``folds``, else by place), as they will be when the chain meets new texts.
    """
    names, index = np.unique(np.concatenate([*rows, np.zeros(0, dtype=np.int64)]), return_inverse=True)
    index = index.astype(np.int32)
    rows = np.split(index, np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    fold = np.array(folds if folds is not None else np.arange(len(rows)), dtype=np.int64) % FOLDS
    outside, models = np.zeros((len(rows), 0)), []
    for target in targets.values():
        y = np.asarray(target, dtype=float)
        models.append(fit_linear(index, owner, outside, y, len(names)))
        p = np.zeros(len(rows))
        for k in range(FOLDS):
            seen, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            at = np.cumsum(fold != k) - 1
            mine = (fold != k)[owner]
            part = fit_linear(index[mine], at[owner[mine]], outside[seen], y[seen], len(names))
            p[held] = part.probability([rows[i].tolist() for i in held], outside[held])
        outside = np.column_stack([outside, p])
    used = {i for m in models for i in m.weights}
    return Chain(list(targets), {int(names[i]): i for i in sorted(used)}, models)


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], limit: int = SAMPLE) -> pd.DataFrame:
    """Features and 0/1 columns of the categories for at most ``limit`` labelled texts, chosen by a hash of id and text; repeated rows count once.

    Features are those of the whole text that ``strongest`` can choose for a category, over all rows or without a fold; they are
    found and counted in the tasks, so the driver gets neither texts nor the features that no model uses.

    ``categories`` are expressions over the labels' columns and ``text``; rows where one is null are left out. Labels with
    several rows for an id count once for each category, as the largest.
    """
    name = {c: f"category_{i}" for i, c in enumerate(categories)}
    flags = [F.max(c.cast("int")).alias(name[k]) for k, c in categories.items()]
    marked = labels.groupBy("doc_id").agg(*flags).dropna()
    h = F.xxhash64(F.lit(17), "doc_id", "text").alias("h")
    chosen = drawn(docs.select("doc_id", h).join(marked, "doc_id"), limit, marked.count())
    # only the chosen rows' texts move; the chosen ids are at most ``limit`` rows
    udf = F.pandas_udf(lambda data: pd.Series([feature_set(bytes(x)) for x in data], dtype=object), "array<bigint>")
    data = docs.select(h, utf8("text").alias("data")).join(F.broadcast(chosen), "h")
    rows = stored(data.select("h", *name.values(), udf("data").alias("features")).dropDuplicates(["h"]), "features")
    strong = np.sort(np.array([r[0] for r in _strong(rows, list(name.values())).collect()], dtype=np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(strong)
    keep = F.pandas_udf(lambda sets: pd.Series([x[np.isin(x, sent.value)] for x in sets], dtype=object), "array<bigint>")
    return rows.orderBy("h").select(keep("features").alias("features"), "h", *name.values()).toPandas().rename(columns={v: k for k, v in name.items()})


def _strong(rows: DataFrame, flags: list[str]) -> DataFrame:
    """The features that pass ``strongest``'s count and standard errors for some category, over all ``rows`` or without one fold."""
    fold = F.pmod("h", F.lit(FOLDS))
    one = {c: F.lit(1) if c == "n" else F.col(c) for c in ("n", *flags)}
    sums = [F.sum(F.when(fold == k, x).otherwise(0)).alias(f"{c}_{k}") for c, x in one.items() for k in range(FOLDS)]
    total = rows.agg(*sums).first()
    counts = rows.select(F.explode("features").alias("feature"), "h", *flags).groupBy("feature").agg(*sums)
    passes = F.lit(False)
    for without in (None, *range(FOLDS)):
        folds = [k for k in range(FOLDS) if k != without]
        n = sum(total[f"n_{k}"] or 0 for k in folds)
        every = sum((F.col(f"n_{k}") for k in folds), F.lit(0))
        for c in flags:
            n1 = sum(total[f"{c}_{k}"] or 0 for k in folds)
            if 0 < n1 < n:
                with_1, share = sum((F.col(f"{c}_{k}") for k in folds), F.lit(0)), every / n
                error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / (n - n1)))
                passes |= (every >= 3) & (F.abs(with_1 / n1 - (every - with_1) / (n - n1)) / error >= STRENGTH - 1e-6)
    return counts.where(passes).select("feature")


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]) -> Chain:
    rows = training_rows(docs, labels, categories)
    sets = [np.array(x, dtype=np.int64) for x in rows["features"]]
    return fit_features(sets, {c: rows[c].to_numpy() for c in categories}, [int(h) % FOLDS for h in rows["h"]])




def label_categories() -> dict[str, Column]:
    """Categories of the labels table, in order: text of low quality, then toxic text."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxicity(docs: DataFrame, chain: Chain, keep_columns: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, one probability p_<category> per category, toxic (the last one reaches ``threshold``) for every row of ``docs``.

    With ``keep_columns`` the rows keep all columns of ``docs`` and get ``toxic__`` alone. Whole texts are read, in one pass
    without a shuffle; null and empty texts have no words, so their probability is the models' bias. Repeated rows stay; no
    rows give no rows. The chain is broadcast; its size is bounded by ``FEATURES`` a category.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))
    n = len(chain.categories)

    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model: Chain = pickle.loads(sent.value)
        for data in batches:
            p = model.predict([bytes(x) for x in data])
            yield pd.DataFrame({f"c{i}": p[:, i] for i in range(n)})

    probabilities.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(probabilities, ", ".join(f"c{i} double" for i in range(n)))
    p = udf(utf8("text"))
    if keep_columns:
        return docs.withColumn("toxic__", p[f"c{n - 1}"] >= threshold)
    scored = docs.select("doc_id", p.alias("p"))
    named = [F.col(f"p.c{i}").alias(f"p_{c}") for i, c in enumerate(chain.categories)]
    return scored.select("doc_id", *named, (F.col(f"p.c{n - 1}") >= threshold).alias("toxic"))

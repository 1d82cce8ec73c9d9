"""Isolation forest on embedding columns.

Fitting needs only ``trees * sample`` rows however large the table is: rows are
picked by hash in the scan, each tree is grown from its few hundred rows in a
task of its own, and the forest is a table of nodes. Scoring broadcasts that
table; its size is at most ``trees * (2 * sample - 1)`` nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden import rules

NODES = "tree int, node int, feature int, threshold double, left int, right int, depth int, size long"
_SPREAD = float(1 << 40)
# Rows are picked at this multiple of the sample size, then cut to the exact size.
_SLACK = 1.5
EULER = 0.5772156649015329


def _unit_hash(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(_SPREAD)


def tree_samples(df: DataFrame, key: str, rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` rows without repeats for every tree, chosen by hash.

    First a row is let in or not, at a rate that yields enough rows for all
    trees; only those few draw the trees they belong to.
    """
    size = min(sample, rows)
    wanted = size if size == rows else _SLACK * size + 20
    share = min(1.0, trees * wanted / max(rows, 1))
    per_tree = min(1.0, wanted / max(rows * share, 1e-12))
    let_in = df.filter(_unit_hash(F.col(key), F.lit(seed)) < share)
    mine = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: _unit_hash(F.col(key), t, F.lit(seed + 1)) < per_tree,
    )
    drawn = let_in.select("*", F.explode(mine).alias("tree"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.col(key), F.col("tree"), F.lit(seed + 2)), key)
    return drawn.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= size).drop("_r")


@dataclass(frozen=True)
class Forest:
    """Node table, rows per tree and the score below which a row is an outlier."""

    nodes: pd.DataFrame
    sample: int
    offset: float

    def save(self, spark: SparkSession, path: str) -> None:
        table = spark.createDataFrame(self.nodes, NODES)
        table.select("*", F.lit(self.sample).alias("sample"), F.lit(self.offset).alias("offset")).write.mode(
            "overwrite"
        ).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        rows = spark.read.parquet(path).toPandas()
        return Forest(rows.drop(columns=["sample", "offset"]), int(rows["sample"][0]), float(rows["offset"][0]))


def grow_trees(samples: DataFrame, embedding: str, sample: int, seed: int) -> DataFrame:
    """Grow each tree from its rows: random feature, random cut, until alone or deep enough."""
    max_depth = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(pdf[embedding].to_numpy()).astype(float)
        out: list[list] = []
        todo = [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            node = len(out)
            out.append([tree, node, -1, 0.0, -1, -1, depth, len(rows)])
            if parent >= 0:
                out[parent][4 + side] = node
            if depth >= max_depth or len(rows) <= 1:
                continue
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(high > low)
            if not len(usable):
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            goes_left = x[rows, feature] <= cut
            out[node][2], out[node][3] = feature, cut
            todo.append((rows[~goes_left], depth + 1, node, 1))
            todo.append((rows[goes_left], depth + 1, node, 0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

    return samples.groupBy("tree").applyInPandas(grow, NODES)


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean path length of a search among ``n`` rows."""
    n = n.astype(float)
    long = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


class Scorer:
    """``-2^(-E(h)/c)`` of vectors under a forest, on any machine."""

    def __init__(self, forest: Forest):
        self.trees = []
        for _, t in forest.nodes.sort_values(["tree", "node"]).groupby("tree"):
            leaf = t["depth"].to_numpy() + _path_length(t["size"].to_numpy())
            columns = [t[c].to_numpy() for c in ("feature", "threshold", "left", "right")]
            self.trees.append((*columns, leaf))
        self.norm = float(_path_length(np.array([forest.sample]))[0]) or 1.0
        self.steps = int(forest.nodes["depth"].max()) if len(forest.nodes) else 0

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, leaf in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.steps):
                inner = feature[at] >= 0
                value = x[rows, np.maximum(feature[at], 0)]
                down = np.where(value <= threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
            depth += leaf[at]
        return -np.power(2.0, -depth / len(self.trees) / self.norm)


def raw_score(df: DataFrame, forest: Forest, embedding: str = "embedding", name: str = "raw_score") -> DataFrame:
    """Add ``-2^(-E(h)/c)``: near -1 for outliers, near 0 for the crowd; NULL where there is no vector."""
    shared = df.sparkSession.sparkContext.broadcast(Scorer(forest))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = pd.Series(np.nan, vectors.index)
            given = vectors[vectors.notna()]
            if len(given):
                out[given.index] = shared.value.score(np.stack(given.to_numpy()).astype(float))
            yield out.where(vectors.notna(), None)

    return df.withColumn(name, F.pandas_udf(score, "double")(F.col(embedding)))


def fit_forest(
    df: DataFrame, embedding: str = "embedding", key: str = "vec_id", trees: int = rules.FOREST_TREES,
    sample: int = rules.FOREST_SAMPLE, contamination: float = rules.FOREST_CONTAMINATION, seed: int = rules.FOREST_SEED,
) -> Forest:
    """Fit on a table of embeddings.

    The outlier line is the ``contamination`` quantile of the training scores,
    taken with a mergeable sketch (rank error at most 1 in 100,000).
    """
    rows = df.count()
    samples = tree_samples(df.select(key, embedding), key, rows, trees, sample, seed)
    nodes = grow_trees(samples, embedding, min(sample, rows), seed).toPandas()  # trees * (2 * sample - 1) at most
    forest = Forest(nodes, min(sample, rows), 0.0)
    line = raw_score(df.select(embedding), forest, embedding).agg(
        F.percentile_approx("raw_score", contamination, 100_000).alias("q")
    )
    return Forest(nodes, forest.sample, float(line.first()["q"]))


def score_anomalies(df: DataFrame, forest: Forest | None, embedding: str = "embedding") -> DataFrame:
    """Add ``is_anomaly`` and ``anomaly_score``; without a forest nothing is an anomaly."""
    if forest is None:
        return df.withColumns({"is_anomaly": F.lit(False), "anomaly_score": F.lit(0.0)})
    scored = raw_score(df, forest, embedding, "_raw")
    decision = F.col("_raw") - F.lit(forest.offset)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (decision + 0.5)))
    return scored.withColumns(
        {"is_anomaly": decision < 0, "anomaly_score": F.when(decision < 0, score).otherwise(0.0)}
    ).drop("_raw")


def anomaly_tier(forest: Forest | None, embedding: str = "embedding"):
    """The forest as a cascade tier: outliers are labelled ``Anomaly``, the rest declined.

    Only vectors of undecided lines are scored; one that can't be is a failure of its line.
    """
    from logwarden.operators.classify import BatchTier, ColumnTier

    if forest is None:
        return ColumnTier("anomaly", lambda line: [])
    scorer, offset = Scorer(forest), forest.offset

    def decide(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(float)
        if not np.isfinite(x).all():
            raise ValueError("not a number in a vector")
        decision = scorer.score(x) - offset
        found = decision < 0
        confidence = np.where(found, np.clip(0.5 - decision, 0.0, 1.0), 0.0)
        return pd.DataFrame({"label": np.where(found, "Anomaly", None), "confidence": confidence}, index=vectors.index)

    return BatchTier("anomaly", decide, embedding)

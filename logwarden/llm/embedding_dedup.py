"""Near-duplicate vectors by collision-counting projections (operator 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import bounds, components, forest, whole_groups
from logwarden.session import stored

#: Share of the pairs at the threshold itself that the search may miss; closer pairs are missed less.
MISS = 1e-4
#: Projections whose collisions are counted; of each sort, projections that split it into cells, and a cell's width and
#: a window's half width in terms of the distance at the threshold.
PROJECTIONS, SPLITTING, CELL, REACH = 32, 6, 6.0, 2.0
#: Vectors of a cell worked on together; a cell with more is dealt into chunks, and every two chunks meet in one task.
CHUNK = 1024


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


@dataclass
class Plan:
    """Sizes that follow from the threshold: projections are normal, so a pair at distance d differs by d times a normal.

    A sort orders the vectors of each cell by one projection. A pair at the threshold falls into one cell and one window
    with chance ``seen``; ``sorts`` sorts miss it with ``MISS`` / 2. It collides in at least ``least`` of all projections
    but for ``MISS`` / 2 (an exact binomial tail).
    """

    threshold: float

    def __post_init__(self):
        self.by_dims: dict[int, tuple] = {}
        self.distance = math.sqrt(max(2 - 2 * self.threshold, 1e-12))
        collide = 2 * _phi(REACH) - 1
        same = 2 * _phi(CELL) - 1 - 2 / (math.sqrt(2 * math.pi) * CELL) * (1 - math.exp(-(CELL**2) / 2))
        self.seen = same**SPLITTING * collide
        self.sorts = math.ceil(math.log(MISS / 2) / math.log(1 - self.seen))
        tail, self.least = 0.0, 0
        for k in range(PROJECTIONS + 1):
            tail += math.comb(PROJECTIONS, k) * collide**k * (1 - collide) ** (PROJECTIONS - k)
            if tail > MISS / 2:
                self.least = k
                break

    def drawn(self, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Projections (dims, n): counted ones, and per sort the splitting ones with their offsets; the same everywhere."""
        if dims not in self.by_dims:
            rng = np.random.default_rng(1000 + dims)
            counted = rng.normal(size=(dims, PROJECTIONS))
            splitting = rng.normal(size=(dims, self.sorts * SPLITTING))
            self.by_dims[dims] = counted, splitting, rng.random(self.sorts * SPLITTING)
        return self.by_dims[dims]

    def cells(self, units: np.ndarray) -> np.ndarray:
        """(vectors, sorts): a hash of the cell of each vector in each sort."""
        _, splitting, offset = self.drawn(units.shape[1])
        at = np.floor(units @ splitting / (CELL * self.distance) + offset).astype(np.int64).reshape(len(units), self.sorts, SPLITTING)
        mix = np.zeros(at.shape[:2], dtype=np.uint64)
        for k in range(SPLITTING):
            mix = (mix ^ at[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
        return mix.astype(np.int64)


def _units(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # by a power of two: squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_vectors(vectors: DataFrame, threshold: float = 0.98, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Two vectors link when their labels are equal and not null, they have the same number of components and their cosine
    in double precision is at least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do rows without label: n_links 0, their own id as component. n_links counts rows,
    copies included; rows without id link and count, but can't be the component's smallest id (null only if none has one).
    Other columns are not looked at. No rows give no rows.

    Copies (equal vectors and labels) become one representative with a count. Representatives are projected; each of
    several sorts puts them into cells of label and a few coarse projections, orders a cell by one projection and looks at
    the pairs within a window around each vector; such a pair's collisions over all projections are counted, and from the
    plan's count on the cosine is worked out. A pair that several sorts see belongs to the first. A cell of more than
    ``chunk`` vectors is dealt into chunks, and each two of them meet in a task of their own, so no task holds more than
    two chunks; only link counts and a forest of links leave a task, never its pairs.
    """
    plan = Plan(threshold)
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) <= 1.7e308D) and exists(embedding, x -> x <> 0)"
    usable = f"coalesce(label is not null and size(embedding) > 0 and {finite}, false)"
    rows = vectors.select("vec_id", F.col("label"), F.expr(f"if({usable}, embedding, null)").alias("embedding"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("print", F.when(F.col("embedding").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>")), 256)))
    rows = stored(rows, "vectors")
    good = rows.where("embedding is not null")
    copies = good.groupBy("print").agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = good.join(copies.select(F.col("rep").alias("row"), "copies"), "row").select("row", "copies", F.col("label").cast("string").alias("label"), "embedding")
    reps = stored(reps, "representatives")

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, g in f.groupby(f["embedding"].map(len), sort=False):
                cells = plan.cells(_units(g["embedding"].tolist()))
                tag = pd.util.hash_pandas_object(g["label"] + "/" + g["embedding"].map(len).astype(str), index=False).to_numpy().view(np.int64)
                yield pd.DataFrame({
                    "row": np.repeat(g["row"].to_numpy(), plan.sorts),
                    "sort": np.tile(np.arange(plan.sorts), len(g)).astype(np.int32),
                    "cell": (cells ^ tag[:, None]).ravel(),
                })

    placed = stored(reps.mapInPandas(dealt, "row bigint, sort int, cell bigint"), "cells")
    crowded = placed.groupBy("sort", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk)
    met = placed.join(crowded, ["sort", "cell"]).withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "row"), F.col("chunks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    met = met.select("row", "sort", "cell", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = met.join(reps, "row")

    def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, keys):
            for _, g in f.groupby(f["embedding"].map(len), sort=False):
                a, b, n = _search(g, plan)
                yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": pd.array(b, dtype="Int64"), "n": np.array(n, dtype=np.int64)})

    keys = ["sort", "cell", "i", "j"]
    spread = met.repartition("sort", "cell", "i", "j").sortWithinPartitions("sort", "cell", "i", "j", "row")
    found = stored(spread.mapInPandas(searched, "a bigint, b bigint, n bigint"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    classes = copies.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    classes = stored(classes.withColumn("component", F.coalesce("component", "rep")), "classes")
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "component").select("print", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "print").join(classes, "print", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def _search(frame: pd.DataFrame, plan: Plan) -> tuple[list, list, list]:
    """The links in whole groups of (sort, cell, i, j): counts (a, none, n) and a forest (a, b, 0)."""
    keys = ["sort", "cell", "i", "j"]
    units = _units(frame["embedding"].tolist())
    p = units @ plan.drawn(units.shape[1])[0]
    sort = frame["sort"].to_numpy()
    lead = p[np.arange(len(p)), sort % PROJECTIONS]
    cut = bounds(frame, keys)
    group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((lead, group))
    units, p, lead, sort, group = units[order], p[order], lead[order], sort[order], group[order]
    rows, copies, own = (frame[c].to_numpy()[order] for c in ("row", "copies", "own"))
    across = (frame["i"] != frame["j"]).to_numpy()[order]
    reach = REACH * plan.distance
    cells = plan.cells(units)
    total, x, y = np.zeros(len(rows), dtype=np.int64), [], []
    query, lag = np.arange(len(rows)), 0
    while len(query):  # each query vector against the next ones in its group, as long as its window lasts
        lag += 1
        query = query[query + lag < len(rows)]
        other = query + lag
        stay = (group[query] == group[other]) & (lead[other] - lead[query] <= reach)
        query = query[stay]
        s, t = query, query + lag
        new = ~(across[s] & (own[s] == own[t]))
        s, t = s[new], t[new]
        if not len(s):
            continue
        collisions = (np.abs(p[s] - p[t]) <= reach).sum(axis=1)
        s, t = s[collisions >= plan.least], t[collisions >= plan.least]
        near = np.einsum("ij,ij->i", units[s], units[t]) >= plan.threshold
        s, t = s[near], t[near]
        if not len(s):
            continue
        # a pair that an earlier sort sees, in one cell and window, is counted there
        k = np.arange(plan.sorts)
        seen = (cells[s] == cells[t]) & (np.abs(p[s] - p[t])[:, k % PROJECTIONS] <= reach) & (k[None, :] < sort[s, None])
        new = ~seen.any(axis=1)
        s, t = s[new], t[new]
        np.add.at(total, s, copies[t])
        np.add.at(total, t, copies[s])
        x += rows[s].tolist()
        y += rows[t].tolist()
        if len(x) > 200_000:
            tree = forest(x, y)
            x, y = [r[0] for r in tree], [r[1] for r in tree]
    sums = pd.Series(total).groupby(rows).sum()
    sums = sums[sums > 0]
    tree = forest(x, y)
    a = sums.index.tolist() + [r[0] for r in tree]
    b = [None] * len(sums) + [r[1] for r in tree]
    return a, b, sums.tolist() + [0] * len(tree)

"""Helpers that the operators share: row numbers, local grouping of sorted rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.session import stored

ROW = "row_number__"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row, written down so that it stays the same when a task runs again.

    Rows that repeat with all their columns can only be told apart by such a number.
    """
    return stored(docs.drop(ROW).withColumn(ROW, F.monotonically_increasing_id()), "numbered", "zstd")


def utf8(text: str):
    """The text's UTF-8 bytes, none for null."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


#: Row numbers that are sent to every task, at most (some 50 MB as a hash table).
SENT = 1 << 21


def by_number(rows: DataFrame, numbers: DataFrame, key: str, how: str = "left_semi", most: int = SENT) -> DataFrame:
    """``rows`` joined with the table of distinct row ``numbers`` in its column ``key``.

    Up to ``most`` numbers go to all tasks, so that the rows with their texts stay where they are; more are joined by shuffle.
    """
    numbers = stored(numbers.select(key), "numbers")
    return rows.join(F.broadcast(numbers) if numbers.count() <= most else numbers, key, how)


def drawn(rows: DataFrame, limit: int, n: int | None = None) -> DataFrame:
    """About ``limit`` of the ``n`` rows at most, by the hash in column ``h``; the same rows each time, equal hashes once.

    A threshold on the hash is put to the rows first, so what leaves the tasks is bounded by ``limit``, not by the tasks.
    """
    share = min(1.0, 1.5 * limit / max(rows.count() if n is None else n, 1))
    low = rows.where(F.shiftrightunsigned("h", 11) < F.lit(int(share * (1 << 53))))
    return low.dropDuplicates(["h"]).orderBy("h").limit(limit)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames cut so that no group of equal ``keys`` crosses two of them; the rows must come sorted by ``keys``.

    Holds one batch and one group at most, so the groups must be bounded.
    """
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[keys].iloc[-1]
        cut = int(np.flatnonzero(~(frame[keys] == last).all(axis=1).to_numpy()).max(initial=-1)) + 1
        if rest and cut == 0 and bool((rest[-1][keys].iloc[-1] == last).all()):
            rest.append(frame)
            continue
        whole = pd.concat([*rest, frame.iloc[:cut]], ignore_index=True)
        if len(whole):
            yield whole
        rest = [frame.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of equal ``keys`` begin in sorted rows, and the number of rows at the end."""
    new = np.zeros(len(frame), dtype=bool)
    new[:1] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def forest(a, b) -> list[tuple]:
    """(node, smallest node of its tree) for every node of these edges that isn't the smallest."""
    parent: dict = {}

    def root(x):
        path = []
        while (p := parent.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            parent[y] = x
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(parent)]


def _local_forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f = f.dropna()
        yield pd.DataFrame(forest(f["a"].tolist(), f["b"].tolist()), columns=["a", "b"]).astype("int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b: bigint), for every node that has an edge.

    Batches of edges shrink to forests first; then large-star and small-star rounds run until nothing changes. A round
    is two shuffles of at most as many rows as there are edges, and is written down to cut the lineage. A node with very
    many edges is a hot join key, which adaptive execution splits; minima combine before they are shuffled.
    Self-edges and nulls are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    edges = stored(edges.mapInPandas(_local_forests, "a bigint, b bigint").distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

"""Exact duplicates by digest, frequent digests apart from the others (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import utf8
from logwarden.session import stored

#: Counters of a Misra-Gries summary; a digest with more than 1/COUNTERS of all rows is frequent for certain.
COUNTERS = 1024


def _sha256(data: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(bytes(x).lower()).hexdigest() for x in data], dtype=object)


def summary(batches: Iterator[pd.DataFrame], counters: int = COUNTERS) -> Iterator[pd.DataFrame]:
    """Misra-Gries over one partition's digests: at most ``counters`` rows (digest, at_least), whatever it reads."""
    held: dict[str, int] = {}
    for frame in batches:
        for digest, n in frame["digest"].value_counts().items():
            held[digest] = held.get(digest, 0) + int(n)
        if len(held) > counters:  # the batch and the summary merge: all lose the largest count that goes
            cut = sorted(held.values(), reverse=True)[counters]
            held = {d: n - cut for d, n in held.items() if n > cut}
    yield pd.DataFrame({"digest": list(held), "at_least": list(held.values())}).astype({"digest": object, "at_least": "int64"})


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests of ``rows`` (digest, ord) that may be frequent, each verified: (digest, best, group_size), ``counters`` rows at most.

    The candidates come from merged Misra-Gries summaries; a second pass counts them exactly and finds their largest ``ord``.
    """
    parts = rows.select("digest").mapInPandas(lambda it: summary(it, counters), "digest string, at_least bigint")
    candidates = parts.groupBy("digest").agg(F.sum("at_least").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)
    return (
        rows.join(F.broadcast(candidates.select("digest")), "digest")
        .groupBy("digest")
        .agg(F.max("ord").alias("best"), F.count(F.lit(1)).alias("group_size"))
    )


def exact_duplicates(docs: DataFrame, row: str | None = None, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text), and ``row`` if it names a column.

    Texts are equal when they are the same bytes after lower-casing A-Z; null counts as empty. The row with the largest
    doc_id stays (nulls come before all ids); of rows that repeat with their doc_id one stays, whichever has the larger
    number. Other columns are not looked at. No rows give no rows.

    Texts are read once and never shuffled. Digests that Misra-Gries summaries find frequent are verified, and their
    winners (``counters`` rows at most) are broadcast: such rows are decided where they are. All other digests are
    grouped and joined by an ordinary shuffle, in which no group has more than about 1/``counters`` of the rows.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    slim = docs.select("doc_id", number.alias("row__"), F.pandas_udf(_sha256, "string")(utf8("text")).alias("digest"))
    slim = stored(slim, "digests").withColumn("ord", F.struct("doc_id", "row__"))
    winners = stored(frequent(slim, counters), "winners")
    joined = slim.join(F.broadcast(winners), "digest", "left")
    rest = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("ord").alias("best"), F.count(F.lit(1)).alias("group_size"))
    decided = joined.where("best is not null").unionByName(rest.join(groups, "digest"))
    return decided.select(
        *([F.col("row__").alias(row)] if row else []),
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row__") == F.col("best.row__")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )

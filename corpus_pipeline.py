"""A corpus for training, in five stages: toxic documents go, copies go, near copies go, sources are mixed, texts are packed.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has kept, and returns the columns of documents;
the last one returns packed pieces. A stage's rows are to be written and read again as the next one's documents, as ``run``
does: when a stage begins, the work tables of the stages before it are removed.

Null and empty texts pass all stages but mixing, which takes nothing of them where a source needs less than one copy.
Extra columns are left behind; empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import exact_dedup, mixing, packing, simhash, toxicity
from logwarden.llm.common import ROW, by_number, numbered
from logwarden.session import gathered, release, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[list[str]] = []


def stage(fn: Stage) -> Stage:
    """Removes the work tables that earlier stages have left, then runs the stage."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            release(spark, _left.pop())
        with gathered() as paths:
            result = fn(spark, docs, sf_dir)
        _left.append(paths)
        return result

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; texts without words stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit(docs, labels, toxicity.label_categories())
    return toxicity.toxicity(docs.select(*COLUMNS), chain, keep_columns=True).where("not toxic__").drop("toxic__")


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id."""
    rows = numbered(docs.select(*COLUMNS))
    gone = exact_dedup.exact_duplicates(rows, ROW).where("not kept").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*COLUMNS)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: five-word shingles, similarity 0.8 or more; the first row of the group stays.

    SimHash fingerprints under covering masks bring near copies together; an exact way for the rest adds links of prints further apart.
    """
    rows = numbered(docs.select(*COLUMNS))
    gone = simhash.similar_groups(rows, ROW).where(F.col(ROW) != F.col("component")).select(ROW)
    return by_number(rows, gone, ROW, "left_anti").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeats are rows of their own, documents that it leaves out go."""
    rows = numbered(docs.select(*COLUMNS))
    taken = mixing.mix(rows, ROW).where("copies > 0").select(ROW, "copies")
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return rows.join(taken, ROW).withColumn("time__", times).select(*COLUMNS)


@stage
def pack_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids placed in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_texts),
]

#: Trained models, hashes and token ids aren't for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES:
        docs = stored(fn(spark, docs, sf_dir), name)
    return docs

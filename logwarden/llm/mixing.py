"""Mixing sources to target weights by Pareto order sampling (operator 8). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logwarden.session import stored

#: Ranks of the draw are found in two steps: so many bins, then as many again within the bin that is cut.
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words in the text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from ``sizes`` (source, source_size): shares by weight, none above ``most`` times its source.

    The sources in order of code points, null last, have the weights in turn. What a source can't take is shared again by
    weight: in order of most * size / weight, the sources that fill up come first, and the first one that fits tells the
    level of all others. One row a source, so the windows hold no more rows than there are sources.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    taken = F.coalesce(F.sum("cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - taken) / left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("water", F.first(fits, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, row: str | None = None, seed: int = 5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (and ``row`` if it names a column) for every row of ``docs`` (doc_id, text, source).

    A source needs target / source_size copies of each of its words. The whole part of that is certain for all its
    documents. Of the rest, documents get an inclusion probability in proportion to log2(2 + size), so that longer texts
    are likelier to be repeated; a document for which that is 1 or more gets one more whole copy for certain and the
    others share what is left. The remaining documents are ranked by their random odds over their inclusion odds
    (Pareto order sampling), and as many from the front are taken as don't pass the words that are left: the size of the
    draw is fixed in words. What is missing then, less than one document, goes to the longest other text that fits.

    ``taken`` is size * copies. Random numbers are hashes of seed, doc_id and text, so reruns agree; repeated rows with the
    same draw are ordered by their number. Null texts and texts without words have size 0 and take 0 words; null is a
    source of its own; a source without words has target 0. Other columns are not looked at. No rows give no rows.

    Each source's rank is found through two histograms of ``BINS`` bins, then a window over the one bin that is cut, so a source with
    a third of all rows is never sorted by one task. What is broadcast has one row a source or bin.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(
        "doc_id", "source", number.alias("row__"), words(F.col("text")).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).alias("draw"),
    )
    rows = stored(rows, "sizes").withColumn("class", F.floor(F.log2(F.col("size") + 2)).cast("int"))
    by_class = rows.groupBy("source", "class").agg(F.sum("size").alias("words"))
    by_class = stored(by_class, "classes")
    plan = stored(targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("whole", whole).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    # inclusion probabilities: classes from the longest down are certain until the rest's probabilities are below 1
    classes = by_class.join(plan, by_class["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    certain = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("words") * F.col("class")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    classes = classes.withColumn("scale", F.when(mass > 0, (F.col("want") - certain) / mass).otherwise(F.lit(0.0)))
    fits = F.when(F.col("scale") * F.col("class") < 1, F.col("scale"))
    scale = F.first(fits, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chance = F.coalesce(scale, F.lit(1.0)) * F.col("class")
    classes = classes.withColumn("chance", F.when(chance >= 1, F.lit(1.0)).otherwise(F.greatest(chance, F.lit(0.0))))
    classes = classes.withColumn("left", F.col("want") - F.sum(F.when(F.col("chance") >= 1, F.col("words")).otherwise(F.lit(0))).over(Window.partitionBy("source")))
    classes = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), "source_size", "target", "whole", "chance", "left")
    full = rows.join(F.broadcast(classes), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c")
    u = (F.col("draw") + 0.5) / F.lit(float(1 << 53))
    rank = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    # rank / (1 + rank) keeps the order and lies between 0 and 1
    full = full.withColumn("open", (F.col("chance") > 0) & (F.col("chance") < 1) & (F.col("size") > 0))
    full = full.withColumn("place", F.when(F.col("open"), rank / (1 + rank)))
    full = stored(full.withColumn("bin", F.least(F.floor(F.col("place") * BINS), F.lit(BINS - 1)).cast("int")), "ranked")
    first, cut = _cut(full.where("open"), "bin", ["source"])
    inner = full.where("open").join(F.broadcast(cut), full["source"].eqNullSafe(cut["source__"]) & (F.col("bin") == F.col("bin__")))
    inner = inner.withColumn("left", F.col("left__")).drop("source__", "bin__", "left__")
    fine = F.least(F.floor((F.col("place") * BINS - F.col("bin")) * BINS), F.lit(BINS - 1)).cast("int")
    inner = stored(inner.withColumn("fine", fine), "inner")
    second, last = _cut(inner, "fine", ["source"])
    edge = inner.join(F.broadcast(last), inner["source"].eqNullSafe(last["source__"]) & (F.col("fine") == F.col("fine__")))
    order = Window.partitionBy("source").orderBy("place", "doc_id", "row__")
    edge = edge.withColumn("goes", F.sum("size").over(order) <= F.col("left__"))
    taken_rows = (
        full.join(F.broadcast(first), F.col("source").eqNullSafe(F.col("source__")) & F.col("open") & (F.col("bin") < F.col("bin__")), "left_semi")
        .select("row__", "source", "size")
        .unionByName(
            inner.join(F.broadcast(second), F.col("source").eqNullSafe(F.col("source__")) & (F.col("fine") < F.col("fine__")), "left_semi").select("row__", "source", "size")
        )
        .unionByName(edge.where("goes").select("row__", "source", "size"))
    )
    taken_rows = stored(taken_rows, "drawn")
    # what is still missing: the longest text that fits, if there is one
    got = taken_rows.groupBy(F.col("source").alias("source__")).agg(F.sum("size").alias("got"))
    need = full.where("open").select("source", "left").distinct()
    need = need.join(got, need["source"].eqNullSafe(got["source__"]), "left").select(F.col("source").alias("s"), (F.col("left") - F.coalesce("got", F.lit(0))).alias("miss"))
    others = full.where("open").join(F.broadcast(need), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") <= F.col("miss")))
    others = others.join(taken_rows.select("row__").hint("merge"), "row__", "left_anti")
    extra = others.groupBy("source").agg(F.max_by("row__", F.struct("size", "draw", "row__")).alias("row__"))
    more = taken_rows.select("row__").unionByName(extra.select("row__")).withColumn("more", F.lit(1))
    copies = F.col("whole") + F.when(F.col("chance") >= 1, F.lit(1)).otherwise(F.coalesce("more", F.lit(0)))
    out = full.join(more.hint("merge"), "row__", "left").withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.col("whole")).cast("bigint"))
    return out.select(
        *([F.col("row__").alias(row)] if row else []),
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


def _cut(rows: DataFrame, bin: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per source: the bin in which the words before it and its own pass what is left, as (source__, bin__), and with what is left there."""
    sums = rows.groupBy("source", bin).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(bin))
    sums = stored(sums.withColumn("upto", upto).withColumn("over", F.col("upto") > F.col("left")), "bins")
    top = sums.groupBy("source").agg(
        F.min(F.when(F.col("over"), F.struct(F.col(bin).alias("b"), (F.col("left") - F.col("upto") + F.col("words")).alias("l")))).alias("cut")
    )
    named = top.select(F.col("source").alias("source__"), F.coalesce("cut.b", F.lit(BINS)).alias(f"{bin}__"), F.col("cut.l").alias("left__"))
    return named.select("source__", f"{bin}__"), named.where("left__ is not null")

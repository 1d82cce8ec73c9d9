"""Shards of near-equal size by sampled splitters (operator 1). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logwarden.session import stored

#: Key ranges for each shard at least and at most, rows for each range, and drawn keys for each range.
RANGES, MOST_RANGES, RANGE_ROWS, DRAWN = 128, 2048, 50_000, 16
_CELL = 52  # a key's first 12 bits are its cell


def splitters(rows: DataFrame, total: int, ranges: int, drawn: int = DRAWN) -> DataFrame:
    """(splitter): borders of ``ranges`` key ranges of about equal size, from a size-weighted draw of keys.

    A row of ``rows`` (id, size, key) is drawn with a probability in proportion to its size, by a hash of id and key, so
    about ranges * drawn keys are drawn whatever the table's size; a row too large for that counts with its whole size.
    """
    step = total / (ranges * drawn)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(11), "id", "key"), 11) / F.lit(float(1 << 53))
    sample = rows.where(chance * step < F.col("size")).select("key", F.greatest(F.col("size"), F.lit(step)).alias("weight"))
    upto = F.sum("weight").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    placed = sample.select("key", F.floor(F.coalesce(upto, F.lit(0.0)) * ranges / total).alias("range"))
    return placed.groupBy("range").agg(F.min("key").alias("splitter")).select("splitter").distinct()


def range_shards(docs: DataFrame, shards: int = 24, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text): shards of near-equal size.

    Size is the text's UTF-8 bytes plus 8. Records are keyed by a hash of their text, so equal texts lie together.
    Splitters from a size-weighted draw cut the keys into many ranges, whose sizes are then measured; a range with over
    twice its share (a hot text) is subdivided by doc_id. The ranges, in order, fill the shards; a shard is off its
    share by one range or one document at most. ``slot`` is gapless from 0 in each shard.

    A null text has no bytes and the checksum of none. Null ids and repeated rows are placed like any other row. Other
    columns are not looked at. No rows give no rows; fewer documents than shards leave shards empty.

    Only (id, size, key) is shuffled. What is broadcast is bounded by the number of ranges (``MOST_RANGES`` a shard at
    most), not by the rows; a window holds one range.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = stored(rows, "keys")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    count = min(max(shards * ranges, n // range_rows), shards * max(ranges, MOST_RANGES))
    borders = splitters(rows, max(total, 1), count).withColumn("cell", F.shiftright("splitter", _CELL))
    cells = (
        docs.sparkSession.range(-(1 << 11), 1 << 11, 1, 1)
        .select(F.col("id").alias("cell"))
        .join(F.broadcast(borders.groupBy("cell").agg(F.array_sort(F.collect_list("splitter")).alias("borders"))), "cell", "left")
        .withColumn("borders", F.coalesce("borders", F.array().cast("array<bigint>")))
        .withColumn("before", F.coalesce(F.sum(F.size("borders")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    inside = F.size(F.filter("borders", lambda s: s <= F.col("key")))
    ranged = rows.withColumn("cell", F.shiftright("key", _CELL)).join(F.broadcast(cells), "cell")
    ranged = stored(ranged.select("id", "size", "text_crc32", "key", (F.col("before") + inside).alias("range")), "ranges")
    share = max(total / max(count, 1), 1.0)
    measured = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.ceil(F.col("bytes") / share), F.ceil(F.col("n") / range_rows))
    over = (F.col("bytes") > 2 * share) | (F.col("n") > 2 * range_rows)
    measured = measured.select("range", F.when(over, parts).otherwise(F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(13), "id"), F.col("parts"))
    divided = ranged.join(F.broadcast(measured), "range").withColumn("part", part).drop("parts")
    divided = stored(divided, "divided")
    order = Window.orderBy("range", "part")
    pieces = divided.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    middle = F.sum("bytes").over(order) - F.col("bytes") / 2
    pieces = pieces.withColumn("shard", F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int"))
    pieces = pieces.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part")) - F.col("n"))
    place = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "id"))
    return divided.join(F.broadcast(pieces.select("range", "part", "shard", "first")), ["range", "part"]).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", "shard", (F.col("first") + place - 1).alias("slot")
    )

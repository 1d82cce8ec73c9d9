"""Fingerprints that are near when few edits lead from one text to the other (operator 13). DataFrame functions only.

Order MinHash: of a text's k-mers, each numbered by its occurrence, some are chosen by a random order, put back into text
order and hashed together. Two texts agree in such a hash if the same k-mers are chosen and stand in the same order. All
components use one hash of (k-mer, occurrence), seen as a point on a circle: component j chooses the first ones from
point j / components on, which is a random order of its own for every j.

A k-mer is k tokens in a row. Tokens are what stands between spaces, empty ones too; where that is long, as in scripts
that don't part words, its characters. Together they are the whole text, so every edit shows in some k-mer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a k-mer, components of a fingerprint, k-mers chosen for each.
K, COMPONENTS, CHOSEN = 3, 64, 2
#: Code points of a word at most; longer ones are taken character by character.
LONG = 64
#: Rows of a range of ids, and ranges at most (their borders are broadcast, 8 bytes each).
RANGE_ROWS, MOST_RANGES = 4096, 1 << 20
_PLACE = 31  # bits of a place; the 32 above hold a hash
_LOW = (1 << _PLACE) - 1


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _packed(hashed: Column, place: Column) -> Column:
    """The hash's upper 32 bits over a place of 31 bits, never negative."""
    return F.shiftleft(F.shiftrightunsigned(hashed, 32), _PLACE) + place


def _hash(x: Column) -> Column:
    return F.shiftright(x, _PLACE)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _numbers(first: Column, last: Column) -> Column:
    """The numbers from first to last, none if there are none."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _tokens(text: Column) -> Column:
    words = F.split(text, " ", -1)
    cut = F.transform(words, lambda w: F.when(F.length(w) <= LONG, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))))
    none = F.array().cast("array<string>")
    return F.when(text == "", none).when(text.rlike(f"[^ ]{{{LONG + 1}}}"), F.flatten(cut)).otherwise(words)


def _kmers(tokens: Column, k: int) -> Column:
    """Every k-mer's hash over its place from 1 on, sorted. A text of fewer tokens is one k-mer."""

    def hashed(i: Column) -> Column:
        return _packed(F.xxhash64(*[F.get(tokens, i + j) for j in range(-1, k - 1)]), i.cast("bigint"))

    size = F.size(tokens)
    every = F.transform(F.sequence(F.lit(1), F.greatest(size - (k - 1), F.lit(1))), hashed)
    return F.sort_array(F.when(size > 0, every).otherwise(F.array().cast("array<bigint>")))


def _repeated(rest: Column) -> Column:
    """k-mers that stood before, sorted, hashed anew with the number of their occurrence."""
    size = F.size(rest)
    starts = F.filter(_numbers(F.lit(0), size - 1), lambda i: (i == 0) | (_hash(F.get(rest, i)) != _hash(F.get(rest, i - 1))))

    def run(starts: Column) -> Column:
        def renumbered(start: Column, j: Column) -> Column:
            last = F.coalesce(F.get(starts, j + 1), size) - 1
            return F.transform(
                F.sequence(start, last),
                lambda i: _packed(F.xxhash64(_hash(F.get(rest, start)), (i - start + 1).cast("bigint")), _place(F.get(rest, i))),
            )

        return F.flatten(F.transform(starts, renumbered))

    return F.coalesce(F.filter(_let(starts, run), lambda x: x.isNotNull()), F.array().cast("array<bigint>"))


def with_fingerprint(rows: DataFrame, text: str, name: str, k: int = K, components: int = COMPONENTS, chosen: int = CHOSEN) -> DataFrame:
    """``rows`` with the fingerprint of its column ``text`` (null counts as empty) in ``name``: 4 hex digits a component.

    An empty text's fingerprint is the empty string. Work is linear in the text but for sorting its k-mers' hashes.
    """
    held = rows.columns
    tokens, all_, first, rest, points, marked = (f"{name}__{i}" for i in range(6))
    # what a step makes is a column that the next one reads more than once, so that steps aren't merged
    rows = rows.withColumn(tokens, _tokens(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn(all_, _kmers(F.col(tokens), k))
    new = F.filter(all_, lambda x, i: x.bitwiseXOR(F.get(F.col(all_), i - 1)) > _LOW)  # another hash than the one before
    rows = rows.withColumn(first, F.concat(F.slice(all_, 1, 1), new))
    rows = rows.withColumn(rest, F.array_except(all_, first))
    rows = rows.withColumn(points, F.sort_array(F.concat(F.col(first), _repeated(F.col(rest)))))
    marks = F.array(*[F.lit((j << 32) // components << _PLACE).cast("bigint") for j in range(components)])
    rows = rows.withColumn(marked, F.sort_array(F.concat(F.col(points), marks)))
    n = F.size(points)
    at = F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: _place(F.get(F.col(marked), i)) == 0)  # where the marks are

    def component(mark: Column, j: Column) -> Column:
        taken = F.transform(F.sequence(F.lit(0), F.least(F.lit(chosen), n) - 1), lambda t: F.get(F.col(points), F.pmod(mark - j + t, n)))
        placed = F.array_sort(F.transform(taken, lambda x: F.shiftleft(_place(x), 32) + _hash(x)))
        code = F.xxhash64(F.transform(placed, lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))))
        return F.lpad(F.lower(F.hex(code.bitwiseAND(F.lit(0xFFFF)))), 4, "0")

    return rows.select(*held, F.when(n > 0, F.array_join(F.transform(at, component), "")).otherwise("").alias(name))


def likeness(a: str, b: str, components: int = COMPONENTS) -> Column:
    """The share of equal components of two fingerprints; 1 for two empty ones, 0 if one is empty."""
    same = F.filter(F.sequence(F.lit(0), F.lit(components - 1)), lambda i: F.substring(F.col(a), i * 4 + 1, F.lit(4)) == F.substring(F.col(b), i * 4 + 1, F.lit(4)))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(F.size(same) / F.lit(float(components)))


def _below(borders: Column, key: Column) -> Column:
    return F.size(F.filter(borders, lambda b: b <= key))


def with_next(rows: DataFrame, key: str, tie: str, values: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with the ``values`` of the row that comes next by ``key`` (bigint, nulls first) and ``tie``, as next_<value>; the first one's after the last.

    Quantiles of the keys cut the table into ranges of about ``range_rows`` rows (``MOST_RANGES`` at most; beyond that
    they grow). A range's first row also goes to the range before it, so each range can be looked through by itself:
    rows are shuffled once. Rows that share a key share a range.
    """
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("bigint"))
    keys = rows.select(order.alias("order__"))
    ranges = max(1, min(MOST_RANGES, -(-keys.count() // range_rows)))
    cells = math.isqrt(ranges - 1) + 1
    fine = -(-ranges // cells)
    at = F.percentile_approx("order__", [i / cells for i in range(1, cells)] or [0.5], 50 * cells)
    tops = sorted(set(keys.agg(at.alias("at")).first()["at"] or []))
    cell = _below(F.array(*[F.lit(t).cast("bigint") for t in tops]), F.col("order__"))
    keys = keys.withColumn("cell__", cell)
    about = keys.groupBy("cell__").agg(F.percentile_approx("order__", [i / fine for i in range(1, fine)] or [0.5], 50 * fine).alias("about__"))
    firsts = keys.join(F.broadcast(about), "cell__").groupBy("cell__", _below(F.col("about__"), F.col("order__")).alias("part")).agg(F.min("order__").alias("first"))
    borders = firsts.groupBy("cell__").agg(F.array_sort(F.collect_list("first")).alias("borders__"))
    before = F.sum(F.size("borders__")).over(Window.orderBy("cell__").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum(F.size("borders__")).over(Window.partitionBy())
    borders = borders.select("cell__", "borders__", F.coalesce(before, F.lit(0)).alias("before__"), total.alias("total__"))
    ranged = rows.withColumn("order__", order).withColumn("cell__", cell).join(F.broadcast(borders), "cell__")
    ranged = ranged.withColumn("inside__", _below(F.col("borders__"), F.col("order__")))
    number = F.col("before__") + F.col("inside__") - 1
    own = F.struct(number.alias("range__"), F.lit(False).alias("guest__"))
    guest = F.struct(F.pmod(number - 1, F.col("total__")).alias("range__"), F.lit(True).alias("guest__"))
    leads = F.get(F.col("borders__"), F.col("inside__") - 1) == F.col("order__")
    ranged = ranged.withColumn("place__", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))))
    ranged = ranged.select(*rows.columns, "order__", "place__.range__", "place__.guest__")
    window = Window.partitionBy("range__").orderBy("guest__", "order__", tie)
    seen = ranged.withColumns({f"next_{v}": F.lead(v).over(window) for v in values})
    return seen.where("not guest__").drop("order__", "range__", "guest__")


def fingerprints(docs: DataFrame, k: int = K, components: int = COMPONENTS, chosen: int = CHOSEN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs`` (doc_id, text).

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's, by doc_id; the first document follows the last. Near are the shares of equal components of the
    text's fingerprint with the edited text's and with the next document's.

    Null counts as empty; two empty texts have likeness 1, an empty and another 0. A text of fewer tokens than a k-mer is
    one k-mer. Null ids come first; rows of one id follow each other by a hash of their text. Repeated rows are rows of
    their own. Other columns are not looked at; no rows give no rows, and a single row is its own next one.

    Fingerprints are worked out where texts are read; texts are shuffled once, to stand beside the next one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), F.xxhash64(text).alias("tie"))
    rows = with_fingerprint(rows, "text", "fingerprint", k, components, chosen)
    rows = with_next(rows, "doc_id", "tie", ["text", "fingerprint"], range_rows)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", k, components, chosen)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", components).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", components).alias("near_next"),
    )

"""Personal data: spans, masking, audit — all as column expressions.

Masking and counting are native. Spans need every match's place: that is one Arrow
pass over the texts that can hold such data at all, linear in their matches.
Patterns mean the same to both engines.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.functions.text import CASED, folded, has_any, message

Pattern = tuple[str, str, str]  # type, pattern, token

SPAN = "array<struct<pii_type:string,value:string,start:int,end:int,replacement:string>>"


def pii_patterns(mask_ips: bool = False, custom: list[Pattern] | None = None) -> list[Pattern]:
    """The patterns in order; addresses only on request, custom ones last."""
    return [p for p in rules.PII_PATTERNS if mask_ips or p[0] != "ipv4"] + list(custom or [])


# Each pattern's core, without the word boundaries and optional parts that make it
# slow to search: a text without the core cannot match the pattern.
_CORES = {
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d(?:[ -]*\d){12}",
    "phone_us": r"\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ipv4": r"\d\.\d",
}


def _possible(kind: str, text: Column) -> Column:
    """Cheap test that a text could hold such data at all."""
    if kind == "email":
        return text.contains("@")
    if kind == "aws_key":
        return has_any(text, ["AKIA", "ABIA", "ACCA", "ASIA"])
    if kind == "generic_secret":
        return has_any(text, ["=", ":"]) & has_any(folded(text), ["passw", "pwd", "secret", "token", "api"])
    return text.rlike(CASED + _CORES[kind]) if kind in _CORES else F.lit(True)


def _java(pattern: str) -> str:
    return CASED + pattern.replace("(?i)", "(?ui)")


def _finder(patterns: list[Pattern]):
    """Arrow function (texts, bits of the patterns that are possible) -> spans."""
    kind = pa.struct([("pii_type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())])

    def find(texts: pa.Array, possible: pa.Array) -> pa.Array:
        compiled = [(1 << i, k, re.compile(p), token) for i, (k, p, token) in enumerate(patterns)]
        columns: list[list] = [[], [], [], [], []]
        ends = [0]
        for text, bits in zip(texts.to_pylist(), possible.to_pylist(), strict=True):
            if bits:
                for bit, k, search, token in compiled:
                    if bits & bit:
                        for m in search.finditer(text):
                            for column, x in zip(columns, (k, m[0], m.start(), m.end(), token), strict=True):
                                column.append(x)
            ends.append(len(columns[0]))
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return F.arrow_udf(find, SPAN)


def pii_spans(text: str | Column, patterns: list[Pattern] | None = None) -> Column:
    """All spans, pattern by pattern, each pattern's in text order."""
    chosen = pii_patterns() if patterns is None else patterns
    text = message(text)
    possible = F.lit(0).cast("bigint")
    for i, (kind, _, _) in enumerate(chosen):
        possible = possible + F.when(_possible(kind, text), F.lit(1 << i)).otherwise(0)
    return _finder(chosen)(F.when(possible > 0, text), possible)


def mask_pii(text: str | Column, patterns: list[Pattern] | None = None) -> Column:
    """Replace personal data by its token, pattern after pattern."""
    out = message(text)
    for kind, pattern, token in pii_patterns() if patterns is None else patterns:
        quoted = token.replace("\\", "\\\\").replace("$", "\\$")
        out = F.when(_possible(kind, out), F.regexp_replace(out, _java(pattern), quoted)).otherwise(out)
    return out


def mask_column(df: DataFrame, column: str, patterns: list[Pattern] | None = None) -> DataFrame:
    """Mask one column.

    Every pattern gets a projection of its own: each step reads the text of the
    step before twice (test, replace), and nesting the steps in one expression
    would double the work with every pattern.
    """
    for p in pii_patterns() if patterns is None else patterns:
        df = df.withColumn(column, mask_pii(column, [p]))
    return df


def audit_of_spans(text: str | Column, spans: Column) -> Column:
    """Report on spans found earlier; it holds positions but no values."""
    return F.struct(
        F.length(message(text)).alias("original_length"),
        F.size(spans).alias("pii_found"),
        F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["pii_type"]))).alias("pii_types"),
        F.transform(
            spans,
            lambda s: F.struct(
                s["pii_type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"),
                s["replacement"].alias("replacement"),
            ),
        ).alias("details"),
    )


def audit(df: DataFrame, text: str, patterns: list[Pattern] | None = None) -> DataFrame:
    """Add ``audit``; the spans are computed once, in a projection below it."""
    spanned = df.withColumn("_spans", pii_spans(text, patterns))
    return spanned.withColumn("audit", audit_of_spans(text, F.col("_spans"))).drop("_spans")


def audit_totals(df: DataFrame, text: str, patterns: list[Pattern] | None = None) -> DataFrame:
    """Hits and affected rows per type over a whole table, in one shuffle of type totals."""
    chosen = pii_patterns() if patterns is None else patterns
    counted = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("pii_type"),
                        F.when(
                            _possible(kind, message(text)),
                            F.regexp_count(message(text), F.lit(_java(pattern))),
                        ).otherwise(0).alias("hits"),
                    )
                    for kind, pattern, _ in chosen
                ]
            )
        ).alias("c")
    ).select("c.*")
    return (
        counted.groupBy("pii_type")
        .agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("rows_hit"))
        .filter("hits > 0")
    )


def mask_events(events: DataFrame, columns: tuple[str, ...] = ("log_message", "root_cause")) -> DataFrame:
    """Mask the free-text columns of an event table; the rest passes through."""
    for c in columns:
        events = mask_column(events, c)
    return events

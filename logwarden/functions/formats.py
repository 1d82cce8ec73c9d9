"""Line-format detection and parsing as column expressions.

A format is a ``FormatSpec``: a name, a detect expression and a parse
expression that yields the shared superset struct. Detection is one CASE over
the specs, parsing another, so a mixed table is parsed in a single projection.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.session import stored
from logwarden.functions.text import CASED, first_match, message, sql_text, strip_text

PARSED_FIELDS = [
    "ip_address", "timestamp", "request", "http_method", "url", "protocol", "status_code", "bytes_sent",
    "hostname", "process", "service", "date", "time", "process_id", "level", "component", "name", "message",
]


def parsed_struct(raw: str, block_ids: str | None = None, **fields: str) -> Column:
    """Superset record: the given fields (SQL text), NULL for the others, always ``raw``."""
    parts = [f"'{f}', {fields.get(f, 'CAST(NULL AS STRING)')}" for f in PARSED_FIELDS]
    parts += [f"'block_ids', {block_ids or 'CAST(NULL AS ARRAY<STRING>)'}", f"'raw', {raw}"]
    return F.expr("named_struct(" + ", ".join(parts) + ")")


@dataclass(frozen=True)
class FormatSpec:
    """A format: both functions get the SQL name of the line and return a Column."""

    name: str
    detect: Callable[[str], Column]
    parse: Callable[[str], Column]


def _searches(name: str) -> Callable[[str], Column]:
    return lambda line: F.expr(f"{line} RLIKE {sql_text(CASED + rules.DETECT[name])}")


def _groups(line: str, pattern: str, names: list[str]) -> tuple[Column, dict[str, str]]:
    """Condition 'the line starts with pattern' and the SQL of its groups by name."""
    anchored = sql_text(CASED + "^" + pattern)
    groups = {n: f"regexp_extract({line}, {anchored}, {i + 1})" for i, n in enumerate(names)}
    return F.expr(f"{line} RLIKE {anchored}"), groups


def parse_web(line: str) -> Column:
    ok, g = _groups(line, rules.WEB_LINE, ["ip_address", "timestamp", "request", "status_code", "bytes_sent"])
    ends, gap = sql_text(r"(?U)^\s+|\s+\z"), sql_text(r"(?U)\s+")
    parts = f"split(regexp_replace({g['request']}, {ends}, ''), {gap})"
    for i, part in enumerate(["http_method", "url", "protocol"]):
        g[part] = f"coalesce(get({parts}, {i}), '')"
    return F.when(ok, parsed_struct(line, **g)).otherwise(parsed_struct(line))


def parse_syslog(line: str) -> Column:
    ok, g = _groups(line, rules.SYSLOG_LINE, ["timestamp", "hostname", "process", "message"])
    return F.when(ok, parsed_struct(line, **g)).otherwise(parsed_struct(line))


def parse_security(line: str) -> Column:
    names = ["timestamp", "hostname", "service", "message"]
    ok, g = _groups(line, rules.SECURITY_LINE, names)
    plain_ok, plain = _groups(line, rules.SYSLOG_LINE, names)
    return (
        F.when(ok, parsed_struct(line, **g))
        .when(plain_ok, parsed_struct(line, **plain))
        .otherwise(parsed_struct(line))
    )


def parse_hdfs(line: str) -> Column:
    ok, g = _groups(line, rules.HDFS_LINE, ["date", "time", "process_id", "level", "component", "message"])
    blocks = f"regexp_extract_all({line}, {sql_text(CASED + rules.HDFS_BLOCK)}, 0)"
    return F.when(ok, parsed_struct(line, block_ids=blocks, **g)).otherwise(parsed_struct(line))


def parse_openstack(line: str) -> Column:
    ok, g = _groups(line, rules.OPENSTACK_LINE, ["component", "process_id", "level", "name", "message"])
    return F.when(ok, parsed_struct(line, **g)).otherwise(parsed_struct(line))


GENERIC = FormatSpec("generic", lambda line: F.lit(True), lambda line: parsed_struct(line))

BUILT_IN = [
    FormatSpec("security", _searches("security"), parse_security),
    FormatSpec("web_server", _searches("web_server"), parse_web),
    FormatSpec("hdfs", _searches("hdfs"), parse_hdfs),
    FormatSpec("openstack", _searches("openstack"), parse_openstack),
    # A security line is one of its own format, also where this spec stands alone.
    FormatSpec("syslog", lambda line: _searches("syslog")(line) & ~_searches("security")(line), parse_syslog),
]


class Formats:
    """The formats in detection order, with the catch-all last."""

    def __init__(self, specs: list[FormatSpec] | None = None) -> None:
        self.specs = list(BUILT_IN if specs is None else specs)

    def register(self, spec: FormatSpec) -> Formats:
        """A new list with ``spec`` placed after the known ones, before the catch-all."""
        return Formats([*self.specs, spec])

    def detect(self, line: str) -> Column:
        cases = [(s.detect(line), F.lit(s.name)) for s in self.specs]
        return first_match(cases, F.lit(GENERIC.name)) if cases else F.lit(GENERIC.name)

    def parse_as(self, line: str, log_type: str | Column) -> Column:
        """Parse with the named format; an unknown name falls back to ``raw`` only."""
        if isinstance(log_type, str):
            known = {s.name: s for s in self.specs}
            return known.get(log_type, GENERIC).parse(line)
        cases = [(log_type == s.name, s.parse(line)) for s in self.specs]
        return first_match(cases, GENERIC.parse(line)) if cases else GENERIC.parse(line)

    # --- table operators ----------------------------------------------------

    def parse_lines(self, df: DataFrame, line: str = "log_message") -> DataFrame:
        """Detect and parse every line on its own; adds ``log_type`` and ``parsed``.

        The type is worked out in a projection of its own, so the parse CASE
        reads a column instead of repeating the detection.
        """
        typed = df.withColumn("log_type", self.detect(line))
        return typed.withColumn("parsed", self.parse_as(line, F.col("log_type")))

    def parse_batch(self, df: DataFrame, log_type: str, line: str = "log_message") -> DataFrame:
        """Parse all non-blank lines with one forced format."""
        kept = df.filter(strip_text(message(line)) != "")
        return kept.withColumn("log_type", F.lit(log_type)).withColumn("parsed", self.parse_as(line, log_type))

    def batch_types(self, df: DataFrame, batch: list[str], order: list[str], line: str = "log_message") -> DataFrame:
        """One row per batch: its format, read off the first non-blank line.

        ``min_by`` keeps a single candidate per batch and combines on the map
        side, so a batch that holds a third of all lines costs no more to
        shuffle than any other. (Its string buffer makes Spark sort each task's
        lines by batch first; that is local and cheaper than a second scan.)
        """
        lines = df.filter(strip_text(message(line)) != "")
        first = lines.groupBy(*batch).agg(F.min_by(line, F.struct(*order)).alias("first_line"))
        return first.select(*batch, self.detect("first_line").alias("log_type"))

    def parse_batches(self, df: DataFrame, batch: list[str], order: list[str], line: str = "log_message") -> DataFrame:
        """Parse each batch (say, a file) with the format of its first non-blank line.

        The table of batch types is written first. Its real size then decides
        the join: broadcast if it is small, else a shuffle join; the lines are
        never shuffled only to find out.
        """
        lines = df.filter(strip_text(message(line)) != "")
        types = stored(self.batch_types(df, batch, order, line), "types")
        types = types.select(*[F.col(c).alias(f"{c}__type") for c in batch], "log_type")
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}__type")) for c in batch])
        typed = lines.join(types, same).drop(*[f"{c}__type" for c in batch])
        return typed.withColumn("parsed", self.parse_as(line, F.col("log_type")))


DEFAULT_FORMATS = Formats()

"""Reports over classified lines: addresses, URLs, distributions, summaries.

Every report is a count per key with the id of the key's first line, so that
"in order of appearance" survives distribution. Counts combine on the map side;
a key that holds a third of all lines shuffles as one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.functions import entities as ent
from logwarden.functions.text import CASELESS, first_match
from logwarden.operators import events as ev


def line_ips(df: DataFrame, text: str) -> Column:
    if "entities" in df.columns:
        return F.coalesce(F.col("entities")["ip_addresses"], F.array().cast("array<string>"))
    return ent.ip_addresses(text)


def _url(df: DataFrame, text: str) -> Column:
    return F.col("entities")["url"] if "entities" in df.columns else ent.url(text)


def url_path(url: Column) -> Column:
    """The URL up to its query string."""
    return F.substring_index(url, "?", 1)


# --- addresses --------------------------------------------------------------


def ip_frequency(df: DataFrame, text: str = "log_message", order: str = "log_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of every address over all lines, repeats in a line counted."""
    each = df.select(*by, F.col(order).alias("_o"), F.explode(line_ips(df, text)).alias("ip"))
    return each.groupBy(*by, "ip").agg(F.count(F.lit(1)).alias("request_count"), F.min("_o").alias("first_seen"))


def suspicion_level(count: Column) -> Column:
    return first_match([(count >= rules.IP_HIGH, F.lit("HIGH")), (count >= rules.IP_MEDIUM, F.lit("MEDIUM"))])


def suspicious_ips(frequency: DataFrame) -> DataFrame:
    """Addresses seen often enough to matter, busiest first, ties by appearance."""
    kept = frequency.filter(F.col("request_count") >= rules.IP_MEDIUM)
    return kept.withColumn("suspicion_level", suspicion_level(F.col("request_count"))).orderBy(
        F.desc("request_count"), "first_seen", "ip"
    )


# --- URLs -------------------------------------------------------------------


def _with_url(df: DataFrame, url: Column, keys: list[str]) -> DataFrame:
    """``keys`` and ``url`` of the lines that have one.

    Handed on through a generator, so that the filter doesn't go below it and search the line a second time.
    """
    return df.select(*keys, F.explode(F.array(url)).alias("url")).filter(F.col("url").isNotNull())


def url_counts(df: DataFrame, url: Column, order: str = "log_id") -> DataFrame:
    each = _with_url(df, url_path(url), [F.col(order).alias("_o")])
    return each.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first_seen"))


def top_urls(counts: DataFrame, k: int = rules.TOP_URLS) -> DataFrame:
    """The k busiest paths with their rank, ties by appearance.

    A top-k, so each task keeps k rows; the rank is numbered over those k.
    """
    order = [F.desc("n"), "first_seen", "url"]
    return counts.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def unique_urls(df: DataFrame, url: Column) -> DataFrame:
    return df.agg(F.countDistinct(url_path(url)).alias("total_unique_urls"))


def url_sketches(df: DataFrame, by: tuple[str, ...], path: str = "path") -> DataFrame:
    """Per group a sketch of its distinct paths (about 2 % off at worst, 4 KB each): kept, they merge into any total later."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(path, 12).alias("paths"))


def sketched_urls(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct paths per ``by`` from sketches of finer groups."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("paths").alias("paths"))
    return merged.select(*by, F.hll_sketch_estimate("paths").alias("unique_urls"))


def suspicious_url_rules(url: Column) -> Column:
    """Names of the URL rules that hit, in rule order."""
    hits = [F.when(url.rlike(CASELESS + p), F.lit(name)) for p, name in rules.URL_RULES]
    return F.array_compact(F.array(*hits))


def suspicious_urls(df: DataFrame, url: Column, keys: list[str]) -> DataFrame:
    """One row per line and rule that its URL breaks."""
    named = _with_url(df, url, keys)
    return named.select(*keys, "url", F.explode(suspicious_url_rules(F.col("url"))).alias("pattern"))


# --- distributions ----------------------------------------------------------


def distribution(df: DataFrame, key: str, order: str = "log_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Lines per key, with the first line's id for ties."""
    return df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


# --- severity and summary ---------------------------------------------------


def severity_rank(severity: Column) -> Column:
    """0 for the worst."""
    return first_match([(severity == s, F.lit(i)) for i, s in enumerate(rules.SEVERITIES)])


def highest_severity(severity: Column) -> Column:
    """Aggregate: the worst severity, NULL over no events.

    Takes the least rank and names it afterwards: with a string in its buffer
    Spark would sort all rows by group instead of hashing them.
    """
    names = F.array(*[F.lit(s) for s in rules.SEVERITIES])
    return F.get(names, F.min(severity_rank(severity)))


def immediate_attention(highest: Column) -> Column:
    return F.coalesce(highest.isin("CRITICAL", "HIGH"), F.lit(False))


def summary_text(logs: Column, events: Column, critical: Column, high: Column, ips: Column) -> Column:
    """The summary sentence; parts that have nothing to report are left out."""
    def text(c: Column) -> Column:
        return c.cast("string")

    def part(count: Column, wording: str) -> Column:
        return F.when(count > 0, F.concat(text(count), F.lit(wording)))

    head, middle, tail = rules.SUMMARY_TOTALS
    return F.concat_ws(
        " ",
        F.concat(F.lit(head), text(logs), F.lit(middle), text(events), F.lit(tail)),
        part(critical, rules.SUMMARY_CRITICAL), part(high, rules.SUMMARY_HIGH), part(ips, rules.SUMMARY_ADDRESSES),
        F.when(events == 0, F.lit(rules.SUMMARY_NOTHING)),
    )


# --- the whole analysis -----------------------------------------------------

FACT = "array<struct<kind:string,key:string>>"


def _fact(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))


def fact_counts(classified: DataFrame, by: tuple[str, ...] = (), order: str = "log_id", label: str = "classification") -> DataFrame:
    """Everything the reports count, in one scan and one shuffle.

    Each line yields its facts – label, source, addresses, URL path, event
    severity, technique, recommendation – and all of them are counted by
    ``(by, kind, key)`` together. The result holds one row per distinct key and
    feeds every report, so the lines are read and classified once.
    """
    judged = ev.judge(classified, label)
    attack, severity = F.col("_event")["attack_type"], F.col("_event")["severity"]
    advice = F.create_map(*[F.lit(x) for row in rules.RECOMMENDATIONS for x in row])
    technique = F.create_map(*[F.lit(x) for a, t, _, _ in rules.TECHNIQUES for x in (a, t)])
    url = _url(classified, "log_message")
    some = F.array(
        _fact("label", F.col(label)),
        _fact("source", F.col("source")),
        F.when(url.isNotNull(), _fact("url", url_path(url))),
        F.when(F.col("_event").isNotNull(), _fact("severity", severity)),
        F.when(attack != "UNKNOWN", _fact("technique", F.try_element_at(technique, attack))),
        F.when(
            F.col("_event").isNotNull(),
            _fact("recommendation", ev.recommendation_text(severity, F.try_element_at(advice, attack))),
        ),
    )
    ips = F.transform(line_ips(classified, "log_message"), lambda ip: _fact("ip", ip))
    each = judged.select(*by, F.col(order).alias("_o"), F.explode(F.concat(some.cast(FACT), ips.cast(FACT))).alias("f"))
    return (
        each.filter(F.col("f").isNotNull())
        .groupBy(*by, F.col("f.kind").alias("kind"), F.col("f.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first_seen"))
    )


def overview(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per report: totals, worst severity, attention flag, summary."""
    kind, key, n = F.col("kind"), F.col("key"), F.col("n")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")

    severity = F.when(kind == "severity", key)
    base = facts.groupBy(*by).agg(
        total(kind == "label").alias("total_logs"),
        total(kind == "severity").alias("event_count"),
        total((kind == "severity") & (key == "CRITICAL")).alias("critical"),
        total((kind == "severity") & (key == "HIGH")).alias("high"),
        F.count_if((kind == "ip") & (n >= rules.IP_MEDIUM)).alias("suspicious_ip_count"),
        F.count_if(kind == "url").alias("total_unique_urls"),
        highest_severity(severity).alias("highest_severity"),
    )
    return base.select(
        *by, "total_logs", "event_count", "suspicious_ip_count", "total_unique_urls", "highest_severity",
        immediate_attention(F.col("highest_severity")).alias("requires_immediate_attention"),
        summary_text(
            F.col("total_logs"), F.col("event_count"), F.col("critical"), F.col("high"), F.col("suspicious_ip_count")
        ).alias("summary"),
    )


def top_per_group(counts: DataFrame, by: tuple[str, ...], k: int, key: str) -> DataFrame:
    """The k first rows of every group by count, then by appearance."""
    if not by:
        return counts.orderBy(F.desc("n"), "first_seen", key).limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first_seen", key)
    # A rank limit right on the window: each task keeps k rows per group before the shuffle.
    return counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


@dataclass(frozen=True)
class Analysis:
    """The outcome of an analysis; each table is planned when it is first asked for.

    With ``by`` every table is per group (an input file, a source): first seen,
    ranks and limits are the group's own.
    """

    classified: DataFrame
    facts: DataFrame
    by: tuple[str, ...] = ()
    order: str = "log_id"
    lines: DataFrame | None = None

    def _of(self, kind: str, name: str) -> DataFrame:
        return self.facts.filter(F.col("kind") == kind).select(*self.by, F.col("key").alias(name), "n", "first_seen")

    @cached_property
    def overview(self) -> DataFrame:
        return overview(self.facts, self.by)

    @cached_property
    def events(self) -> DataFrame:
        return ev.security_events(self.classified)

    @cached_property
    def ip_frequency(self) -> DataFrame:
        return self._of("ip", "ip").withColumnRenamed("n", "request_count")

    @cached_property
    def suspicious_ips(self) -> DataFrame:
        return suspicious_ips(self.ip_frequency)

    @cached_property
    def top_urls(self) -> DataFrame:
        return top_per_group(self._of("url", "url"), self.by, rules.TOP_URLS, "url")

    @cached_property
    def suspicious_patterns(self) -> DataFrame:
        """Reads the lines without the cascade's columns where they were handed in."""
        df = self.classified if self.lines is None else self.lines
        return suspicious_urls(df, _url(df, "log_message"), [*self.by, self.order])

    @cached_property
    def label_distribution(self) -> DataFrame:
        return self._of("label", "label").orderBy(F.desc("n"), "first_seen")

    @cached_property
    def source_distribution(self) -> DataFrame:
        """Lines per source; the column is ``line_source`` where reports are split by source."""
        return self._of("source", "line_source" if "source" in self.by else "source").orderBy(F.desc("n"), "first_seen")

    @cached_property
    def recommendations(self) -> DataFrame:
        return self._of("recommendation", "recommendation").orderBy("first_seen")

    @cached_property
    def technique_coverage(self) -> DataFrame:
        names = ev.technique_catalogue(self.facts.sparkSession).drop("attack_type").distinct()
        return self._of("technique", "technique_id").join(F.broadcast(names), "technique_id").orderBy("first_seen")

    @cached_property
    def report(self) -> DataFrame:
        return report_rows(self.facts, self.by)


#: Entries of a list in a report row, at most; the tables beside it hold them all.
LISTED = 1000


def report_rows(facts: DataFrame, by: tuple[str, ...] = (), urls: int = rules.TOP_URLS, listed: int = LISTED) -> DataFrame:
    """One nested row per report: the overview, and of each list its first entries.

    ``ip_analysis`` holds the suspicious addresses, busiest first, ``url_analysis``
    the ``urls`` busiest paths, ``time_analysis`` labels and sources, busiest first;
    recommendations and techniques come in order of appearance. Lists are cut at
    ``listed`` entries, which only addresses and sources can reach. A rank limit
    in each task comes before the shuffle, so a task sees no more than the
    entries of a list times the tasks, whatever the size of an input.
    """
    busy = (F.col("kind") != "ip") | (F.col("n") >= rules.IP_MEDIUM)
    appears = F.col("kind").isin("recommendation", "technique")
    kinds = F.col("kind").isin("ip", "url", "label", "source", "recommendation", "technique")
    place = F.row_number().over(Window.partitionBy(*by, "kind").orderBy(F.when(appears, 0).otherwise(-F.col("n")), "first_seen", "key"))
    first = facts.where(kinds & busy).withColumn("place", place).where(F.col("place") <= listed)
    first = first.where((F.col("kind") != "url") | (F.col("place") <= urls))
    entry = F.struct("place", "key", "n")
    lists = first.groupBy(*by).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))).alias(f"_{k}") for k in ("ip", "url", "label", "source", "recommendation", "technique")]
    )
    known = {t: (t, n, c, rules.TECHNIQUE_URL + t) for _, t, n, c in rules.TECHNIQUES}
    names = {t: F.struct(*[F.lit(v).alias(k) for k, v in zip(("technique_id", "name", "tactic", "url"), row, strict=True)]) for t, row in known.items()}
    technique = F.create_map(*[x for t, s in names.items() for x in (F.lit(t), s)])

    def counted(kind: str, name: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(x["key"].alias(name), x["n"].alias("n")))

    whole = overview(facts, by)
    joined = whole.join(lists, [*by], "left") if by else whole.join(lists, F.lit(True), "left")
    suspicious = F.transform("_ip", lambda x: F.struct(x["key"].alias("ip"), x["n"].alias("request_count"), suspicion_level(x["n"]).alias("suspicion_level")))
    return joined.select(
        *by, "event_count",
        F.struct(F.col("suspicious_ip_count").alias("suspicious_count"), suspicious.alias("suspicious")).alias("ip_analysis"),
        F.struct(counted("url", "url").alias("top_urls"), "total_unique_urls").alias("url_analysis"),
        F.struct("total_logs", counted("label", "label").alias("label_distribution"), counted("source", "source").alias("source_distribution")).alias("time_analysis"),
        "highest_severity", "requires_immediate_attention", "summary",
        F.transform("_recommendation", lambda x: x["key"]).alias("recommendations"),
        F.transform("_technique", lambda x: F.element_at(technique, x["key"])).alias("mitre_coverage"),
    )


def analyze(
    classified: DataFrame, by: tuple[str, ...] = (), order: str = "log_id", facts: DataFrame | None = None,
    lines: DataFrame | None = None,
) -> Analysis:
    """All reports of a classified table, for the whole or per ``by`` group.

    Pass ``facts`` read back from storage (it is small: one row per distinct
    key) to keep the reports from counting anew for each table, and ``lines``,
    the table before its classification, to spare ``suspicious_patterns`` it.
    """
    return Analysis(classified, fact_counts(classified, by, order) if facts is None else facts, by, order, lines)


def input_info(df: DataFrame, log_type: Column, order: str = "log_id", text: str = "log_message", by: tuple[str, ...] = ()) -> DataFrame:
    """Line count and the format of the first line; ``log_type`` reads column ``first_line``."""
    first = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_logs"), F.min_by(text, order).alias("first_line"))
    return first.select(*by, log_type.alias("detected_type"), "total_logs")

"""Entities in a log line: addresses, URL, verb, status code, user name.

``text`` is SQL text (a column name) or a Column. ``fold`` is the folded copy of
the line where the caller has one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.functions.text import CASED, CASELESS, Text, column, folded, has_any, search_first

URL_VERBS = ["GET", "POST", "PUT", "DELETE", "HEAD"]
ALL_VERBS = URL_VERBS + ["OPTIONS", "TRACE", "CONNECT"]


def ip_addresses(text: Text) -> Column:
    """Every dotted quad in order, repeats kept, octets not range-checked."""
    found = F.regexp_extract_all(column(text), F.lit(CASED + rules.IP_PATTERN), F.lit(0))
    return F.when(has_any(text, ["."]), found).otherwise(F.array().cast("array<string>"))


def url(text: Text) -> Column:
    return search_first(text, CASED + rules.URL_PATTERN, 1, has_any(text, URL_VERBS))


def http_method(text: Text) -> Column:
    return search_first(text, CASED + rules.VERB_PATTERN, 1, has_any(text, ALL_VERBS))


def status_code(text: Text, fold: Text | None = None) -> Column:
    fold = folded(text) if fold is None else fold
    return search_first(text, CASELESS + rules.STATUS_PATTERN, 1, has_any(fold, ["status:", "http", "code"]))


def username(text: Text, fold: Text | None = None) -> Column:
    fold = folded(text) if fold is None else fold
    return search_first(text, CASELESS + rules.USER_PATTERN, 1, has_any(fold, ["user"]))


def entities(text: Text, fold: Text | None = None) -> Column:
    """All entities as one struct; what is absent is NULL, so JSON leaves it out."""
    found = ip_addresses(text)
    # The gate keeps lines without a dot away from the regex; none found reads as absent.
    ips = F.get(F.filter(F.array(found), lambda a: F.size(a) > 0), F.lit(0))
    return F.struct(
        F.when(has_any(text, ["."]), ips).alias("ip_addresses"),
        http_method(text).alias("http_method"),
        status_code(text, fold).alias("status_code"),
        username(text, fold).alias("username"),
        url(text).alias("url"),
    )


def entities_json(col: str) -> Column:
    """The struct as a JSON object without the absent keys."""
    return F.to_json(F.col(col))

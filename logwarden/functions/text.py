"""Text helpers: one regex dialect, case folding, first-match rule lists.

Patterns are written once in plain form. ``(?dU)`` makes Java's engine read
``\\w \\d \\s \\b`` as Unicode classes and end lines only at ``\\n``; ``ui`` adds
case-insensitive matching over all of Unicode.

Cost matters more here than anywhere else in the package, because these run on
every line. Two habits keep it low:

* a pattern that is only a list of plain words becomes substring tests on a
  folded copy of the line (no regex engine at all);
* any other pattern runs only on lines that hold a word the pattern cannot
  match without (``required_words``), so most lines never reach the engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CASED = "(?dU)"
CASELESS = "(?dUui)"

# Letters that a case-insensitive regex treats as ASCII letters but lower() does not.
ODD_LETTERS = "ſıİ"
ODD_LETTERS_AS = "sii"

_SPECIAL = set(r".^$*+?{}[]\|()")


Text = str | Column  # SQL text (a column name, most of the time) or a Column


def sql_text(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(text: Text) -> Column:
    return F.expr(text) if isinstance(text, str) else text


def contains_any(text: str, words: list[str]) -> str:
    """SQL text: ``text`` contains one of ``words`` as a plain substring.

    Rule lists are put together as SQL text and handed to Spark in one piece;
    built from Column calls, a plan with hundreds of words takes seconds to make.
    """
    return "(" + " OR ".join(f"contains({text}, {sql_text(w)})" for w in words) + ")"


def has_any(text: Text, words: list[str]) -> Column:
    if isinstance(text, str):
        return F.expr(contains_any(text, words))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def case_sql(cases: list[tuple[str, str]], default: str = "NULL") -> str:
    """SQL text of a CASE; the first true condition wins."""
    if not cases:
        return default
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


def words_case(text: str, rules: list[tuple[list[str], str]], default: str = "NULL") -> str:
    """SQL text of a CASE over word lists with string results."""
    return case_sql([(contains_any(text, words), sql_text(value)) for words, value in rules], default)


def record_sql(**fields: str | float | bool | None) -> str:
    """SQL text of a struct of constants."""
    def constant(v: str | float | bool | None) -> str:
        if v is None:
            return "CAST(NULL AS STRING)"
        if isinstance(v, bool):
            return str(v).lower()
        return sql_text(v) if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"

    return "named_struct(" + ", ".join(f"'{k}', {constant(v)}" for k, v in fields.items()) + ")"


def message(col: Text) -> Column:
    """The line to work on; a missing line counts as an empty one."""
    return F.expr(f"coalesce({col}, '')") if isinstance(col, str) else F.coalesce(col, F.lit(""))


def folded(text: Text) -> Column:
    """Lower-cased copy in which a caseless literal search is a substring test."""
    text = column(text)
    odd = has_any(text, list(ODD_LETTERS))
    return F.when(odd, F.lower(F.translate(text, ODD_LETTERS, ODD_LETTERS_AS))).otherwise(F.lower(text))


def strip_text(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def search_first(text: Text, pattern: str, group: int, needs: Column | None = None) -> Column:
    """First match's group, NULL without a match; ``needs`` gates the regex.

    The empty string of a failed search is dropped through a one-element array:
    ``nullif`` would run the regex twice.
    """
    if isinstance(text, str):
        found = F.expr(f"get(array_remove(array(regexp_extract({text}, {sql_text(pattern)}, {group})), ''), 0)")
    else:
        found = F.get(F.array_remove(F.array(F.regexp_extract(text, pattern, group)), ""), F.lit(0))
    return found if needs is None else F.when(needs, found)


def _alternatives(pattern: str) -> list[str]:
    """Split at the ``|`` that are outside groups and character classes."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return parts + [pattern[start:]]


def simplify_search(pattern: str) -> str:
    """Drop ``.*`` at both ends of every alternative.

    A search does not need them, and with them a line that does not match costs
    quadratic time.
    """
    parts = []
    for part in _alternatives(pattern):
        while part.startswith(".*") and part[2:3] not in ("?", "+"):
            part = part[2:]
        while part.endswith(".*") and not part.endswith("\\.*"):
            part = part[:-2]
        parts.append(part)
    return "|".join(parts)


def _literal(part: str) -> str:
    """The longest plain text that every match of one alternative holds, in lower case."""
    runs, depth, i = [""], 0, 0
    while i < len(part):
        c = part[i]
        if c == "\\":
            i += 1
            runs.append("")
        elif c == "[":
            i = part.index("]", i + 2)
            runs.append("")
        elif c in "()":
            depth += 1 if c == "(" else -1
            runs.append("")
        elif c in "*?{" and depth == 0:  # what stands before may be missing
            runs[-1] = runs[-1][:-1]
            i = part.index("}", i) if c == "{" else i
            runs.append("")
        elif c in _SPECIAL or depth:
            runs.append("")
        else:
            runs[-1] += c
        i += 1
    return max(runs, key=len).lower()


def required_words(pattern: str) -> list[str]:
    """Words of which the folded line holds one if the caseless pattern matches; none if that can't be told."""
    words = [_literal(part) for part in _alternatives(pattern)]
    return words if all(len(w) > 2 and w.isascii() for w in words) else []


def caseless_search(text: str, fold: str, pattern: str) -> str:
    """SQL text: case-insensitive ``search(pattern)`` as the cheapest equal expression."""
    pattern = simplify_search(pattern)
    words = _alternatives(pattern)
    if all(w and w.isascii() and not (_SPECIAL & set(w)) for w in words):
        return contains_any(fold, [w.lower() for w in words])
    hit = f"{text} RLIKE {sql_text(CASELESS + pattern)}"
    needs = required_words(pattern)
    return f"({contains_any(fold, needs)} AND {hit})" if needs else f"({hit})"


def first_match(cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE WHEN over ``(condition, value)`` columns; the first true one wins."""
    (cond, value), *rest = cases
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)

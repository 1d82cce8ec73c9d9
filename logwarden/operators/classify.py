"""The classification cascade.

A tier is a name plus a way to decide a line. Three kinds exist:

* ``ColumnTier`` – a Spark expression (patterns, keywords, an array of class
  probabilities). A row of such tiers becomes one CASE, which stops at the first
  tier that decides a line.
* ``FrameTier`` – a ``DataFrame -> DataFrame`` step that adds a verdict, such as
  a fitted ``pyspark.ml`` model. The columns it names in ``reads`` are NULL on
  the lines decided before it, so the model has nothing to work out there. A step
  that can't be built on the table is left out and counted.
* ``BatchTier`` – any Python function over batches of one column: the line, or
  another one it names in ``reads``, such as an embedding. Spark calls Python
  functions for every row whatever a CASE says, so the cascade passes such a tier
  NULL for the lines decided before it and calls it on the rest only. A line on
  which it fails goes to the next tier and is counted.

``Failures`` holds these counts, one accumulator a tier.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.functions import entities as ent
from logwarden.functions.text import (
    Text, case_sql, caseless_search, contains_any, first_match, folded, has_any, message, record_sql, sql_text,
)

VERDICT = "label string, confidence double"
BEST = "struct<label:string,method:string,confidence:double,reasoning:string>"


@dataclass(frozen=True)
class Line:
    """SQL names of what an expression tier may read: the line, its lower-case and folded copies."""

    text: str = "_text"
    lower: str = "_lower"
    fold: str = "_fold"


# Condition, label, confidence; the first true condition of a tier decides the line.
# Label and confidence are plain values where they can be, columns otherwise.
Case = tuple[Column, str | Column, float | Column]


@dataclass(frozen=True)
class ColumnTier:
    method: str
    cases: Callable[[Line], list[Case]]


@dataclass(frozen=True)
class FrameTier:
    method: str
    decide: Callable[[DataFrame], DataFrame]  # adds struct "_verdict"
    reads: tuple[str, ...] = ()  # columns that are NULL where a line is decided


@dataclass(frozen=True)
class BatchTier:
    """``tries``: calls per batch at most while failing lines are looked for; then the rest goes to the next tier."""

    method: str
    decide: Callable[[pd.Series], pd.DataFrame]  # messages or values of ``reads`` -> label, confidence
    reads: str = "_text"
    tries: int = 1000


Tier = ColumnTier | FrameTier | BatchTier


class Failures:
    """Lines that a tier failed on, by method, and tiers that couldn't be built; counted while results are worked out.

    A task that runs again counts again, so these are for watching, not for accounts.
    """

    def __init__(self, spark: SparkSession):
        self._context = spark.sparkContext
        self._lines: dict[str, Accumulator] = {}
        self.not_built: dict[str, str] = {}

    def of(self, method: str) -> Accumulator:
        return self._lines.setdefault(method, self._context.accumulator(0))

    def lines(self) -> dict[str, int]:
        return {m: a.value for m, a in self._lines.items()}


def _verdict(label: Column, confidence: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), confidence.cast("double").alias("confidence"))


def best(label: str | Column, method: str, raw: float | Column) -> Column:
    """The final record of a decision: label, method, adjusted confidence, wording."""
    if isinstance(label, str) and isinstance(raw, float):
        sure = min(1.0, max(0.0, raw + rules.ADJUSTMENTS.get(method, 0.0)))
        said = REASONS.get(method, "")
        return F.expr(record_sql(label=label, method=method, confidence=sure, reasoning=said % sure if "%" in said else said))
    label = F.lit(label) if isinstance(label, str) else label
    confidence = adjust_confidence(F.lit(raw) if isinstance(raw, float) else raw, method)
    return F.struct(
        label.cast("string").alias("label"),
        F.lit(method).alias("method"),
        confidence.cast("double").alias("confidence"),
        reasoning(method, confidence).alias("reasoning"),
    )


# --- pattern tier -----------------------------------------------------------


def pattern_label(text: str = "_text", fold: str = "_fold", patterns: list[tuple[str, str]] | None = None) -> Column:
    """Label of the first pattern found in the line, else NULL."""
    chosen = rules.PATTERN_RULES if patterns is None else patterns
    return F.expr(case_sql([(caseless_search(text, fold, p), sql_text(label)) for p, label in chosen])).cast("string")


def pattern_tier(patterns: list[tuple[str, str]] | None = None) -> ColumnTier:
    chosen = rules.PATTERN_RULES if patterns is None else patterns
    return ColumnTier(
        "regex",
        lambda line: [(F.expr(caseless_search(line.text, line.fold, p)), label, 1.0) for p, label in chosen],
    )


# --- keyword tier -----------------------------------------------------------


def keyword_decision(lower: str) -> Column:
    """Keyword label with confidence and wording; undecided lines are Unclassified."""

    def answer(label: str, confidence: float, reason: str) -> str:
        return record_sql(
            category=label, confidence=confidence, reasoning=rules.KEYWORD_REASON_PREFIX + reason, raw_response=""
        )

    cases = [
        (contains_any(lower, words), answer(label, rules.KEYWORD_CONFIDENCE, reason))
        for words, label, reason in rules.KEYWORD_RULES
    ]
    return F.expr(case_sql(cases, answer(rules.UNCLASSIFIED, 0.0, rules.KEYWORD_NO_REASON)))


def keyword_tier() -> ColumnTier:
    def cases(line: Line) -> list[Case]:
        known = [(has_any(line.lower, words), label, rules.KEYWORD_CONFIDENCE) for words, label, _ in rules.KEYWORD_RULES]
        return [*known, (F.lit(True), rules.UNCLASSIFIED, 0.0)]

    return ColumnTier("llm", cases)


# --- completion tier --------------------------------------------------------


def prompt(text: Text) -> Column:
    """The classification prompt for a line."""
    return F.concat(F.lit(rules.PROMPT_HEAD), message(text))


def _tag(text: Column, pattern: str, missing: str) -> Column:
    pattern = "(?s)" + pattern
    inner = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"(?U)^\s+|\s+\z", "")
    return F.when(text.rlike(pattern), inner).otherwise(F.lit(missing))


def parse_completion(text: Text) -> Column:
    """Read the category and reasoning tags of a completion."""
    text = message(text)
    return F.struct(
        _tag(text, rules.CATEGORY_TAG, rules.UNCLASSIFIED).alias("category"),
        F.lit(rules.COMPLETION_CONFIDENCE).alias("confidence"),
        _tag(text, rules.REASONING_TAG, "").alias("reasoning"),
        text.alias("raw_response"),
    )


def completion_tier(complete: Callable[[pd.Series], pd.Series]) -> BatchTier:
    """A tier that asks ``complete`` (prompts -> completions) and reads its tags.

    Runs on undecided lines only. A failing call leaves the batch undecided.
    """
    head, category_tag = rules.PROMPT_HEAD, rules.CATEGORY_TAG
    unknown, sure = rules.UNCLASSIFIED, rules.COMPLETION_CONFIDENCE

    def decide(messages: pd.Series) -> pd.DataFrame:
        found = complete(head + messages).str.extract("(?s)" + category_tag, expand=False)
        return pd.DataFrame({"label": found.str.strip().fillna(unknown), "confidence": sure}, index=messages.index)

    return BatchTier("llm", decide)


# --- model tier -------------------------------------------------------------


def probability_verdict(
    probabilities: Column, labels: list[str], threshold: float = rules.MODEL_THRESHOLD
) -> Column:
    """Best class of a probability array; declined below the threshold, confidence kept."""
    best = F.array_max(probabilities)
    at = F.array_position(probabilities, best).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), at)
    return F.when(best >= threshold, _verdict(label, best)).otherwise(_verdict(F.lit(None), best))


def model_tier(
    model=None, labels: list[str] | None = None, threshold: float = rules.MODEL_THRESHOLD,
    text_column: str = "log_message",
) -> Tier:
    """A fitted text model as a tier; with no model it declines every line.

    It reads ``text_column``, NULL (no words) on decided lines.
    """
    if model is None:
        return ColumnTier("bert", lambda line: [])

    from pyspark.ml.functions import vector_to_array

    def decide(df: DataFrame) -> DataFrame:
        keep = df.columns
        scored = model.transform(df).withColumn("_p", vector_to_array("probability"))
        return scored.select(*keep, probability_verdict(F.col("_p"), labels, threshold).alias("_verdict"))

    return FrameTier("bert", decide, (text_column,))


def vector_tier(
    weights: np.ndarray, bias: np.ndarray, labels: list[str], threshold: float = rules.MODEL_THRESHOLD,
    embedding: str = "embedding",
) -> BatchTier:
    """A linear model over an embedding column as a tier: ``weights`` has a row per class, ``bias`` a number.

    A vector of another length, or with parts that are no numbers, is a failure of its line alone.
    """
    names = np.array(labels, dtype=object)

    def decide(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(float)
        if not np.isfinite(x).all():
            raise ValueError("not a number in a vector")
        margins = x @ weights.T + bias
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        top = p.max(axis=1)
        return pd.DataFrame({"label": np.where(top >= threshold, names[p.argmax(axis=1)], None), "confidence": top}, index=vectors.index)

    return BatchTier("bert", decide, embedding)


# --- confidence and wording -------------------------------------------------


def adjust_confidence(raw: Column, method: str | Column) -> Column:
    """Shift a tier's confidence by its habit of overrating itself, kept in [0, 1]."""
    if isinstance(method, str):
        shift = F.lit(rules.ADJUSTMENTS.get(method, 0.0))
    else:
        shift = first_match([(method == m, F.lit(a)) for m, a in rules.ADJUSTMENTS.items()], F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw + shift))


REASONS = {"regex": rules.REASON_PATTERN, "bert": rules.REASON_MODEL, "llm": rules.REASON_COMPLETION}


def hundredths(x: Column) -> Column:
    """``x`` at two places by its exact binary value, a tie to the even digit; formatting alone rounds its shortest decimal form up.

    A product that lands between two hundredths may have been rounded there: what it lost, exact by halves of 26 bits, decides.
    """
    x = x.cast("double")
    p = x * 100
    high = x * 134217729.0 - (x * 134217729.0 - x)
    lost = (high * 100 - p) + (x - high) * 100
    near = F.when(lost > 0, F.ceil(p)).otherwise(F.floor(p)).cast("double")
    between = (p - F.floor(p) == 0.5) & (lost != 0)
    return F.when(between, near).otherwise(F.rint(p)) / 100


def reasoning(method: str, confidence: Column) -> Column:
    """The sentence that goes with a decision."""
    said = REASONS.get(method, "")
    if "%" not in said:
        return F.lit(said)
    told = F.format_string(said, hundredths(confidence))
    for odd, written in (("NaN", "nan"), ("Infinity", "inf")):
        told = F.replace(told, F.lit(odd), F.lit(written))
    return F.when(confidence.isNotNull(), told)


OUTCOME = ["classification", "method", "confidence", "reasoning", "entities"]


# --- the cascade ------------------------------------------------------------


@dataclass(frozen=True)
class Cascade:
    """Tiers in order; the first that gives a label decides the line."""

    tiers: list[Tier] = field(default_factory=lambda: [pattern_tier(), model_tier(), keyword_tier()])
    entities: Callable[[str, str], Column] | None = ent.entities

    def classify(self, df: DataFrame, text: str = "log_message", failures: Failures | None = None) -> DataFrame:
        """Add ``classification, method, confidence, reasoning`` and ``entities``, replacing columns so named.

        Expression tiers cost one projection and no tier shuffles. Runs of
        expression tiers share one CASE whose results are literals; its
        conditions read the folded line from the projection below.
        """
        keep = [c for c in df.columns if c not in OUTCOME]
        work = df.withColumn("_text", message(F.col(text))).select(*keep, "_text")
        work = work.withColumns({"_lower": F.lower("_text"), "_fold": folded("_text")})
        line = Line()
        decided = F.lit(None).cast(BEST)
        cases: list[tuple[Column, Column]] = []
        for tier in self.tiers:
            if isinstance(tier, ColumnTier):
                cases += [(cond, best(label, tier.method, conf)) for cond, label, conf in tier.cases(line)]
                continue
            work = self._once(work, self._settle(decided, cases))
            cases, decided = [], F.col("_best")
            work = (self._frame if isinstance(tier, FrameTier) else self._batches)(work, tier, failures)
        work = self._once(work, self._settle(decided, cases))

        b = F.col("_best")
        found = {
            "classification": F.coalesce(b["label"], F.lit(rules.UNCLASSIFIED)),
            "method": F.coalesce(b["method"], F.lit("regex")),
            "confidence": F.coalesce(b["confidence"], F.lit(0.0)),
            "reasoning": F.coalesce(b["reasoning"], F.lit(rules.REASON_FALLBACK)),
        }
        if self.entities:
            found["entities"] = self.entities("_text", "_fold")
        return work.select(*keep, *[c.alias(name) for name, c in found.items()])

    def column_tiers(self) -> list[ColumnTier] | None:
        """The tiers if all of them are expressions."""
        return self.tiers if all(isinstance(t, ColumnTier) for t in self.tiers) else None

    @staticmethod
    def _once(df: DataFrame, outcome: Column) -> DataFrame:
        """Add ``_best``, handed on through a generator: neither what reads it nor a later filter on it can slip below
        and make Spark work out the whole cascade a second time."""
        others = [c for c in df.columns if c != "_best"]
        return df.withColumn("_best", outcome).select(*others, F.explode(F.array("_best")).alias("_best"))

    @staticmethod
    def _settle(decided: Column, cases: list[tuple[Column, Column]]) -> Column:
        return F.coalesce(decided, first_match(cases)) if cases else decided

    @staticmethod
    def _frame(df: DataFrame, tier: FrameTier, failures: Failures | None) -> DataFrame:
        """Apply the step with what it reads hidden on decided lines, and put the columns back behind it."""
        others = [c for c in df.columns if c != "_best"]
        hidden = [c for c in tier.reads if c in others]
        work = df.withColumns({f"_own_{c}": F.col(c) for c in hidden})
        work = work.withColumns({c: F.when(F.col("_best").isNull(), F.col(c)) for c in hidden})
        verdict = F.col("_verdict")
        mine = F.when(verdict["label"].isNotNull(), best(verdict["label"], tier.method, verdict["confidence"]))
        back = [F.col(f"_own_{c}").alias(c) if c in hidden else F.col(c) for c in others]
        try:
            return tier.decide(work).select(*back, F.coalesce(F.col("_best"), mine).alias("_best"))
        except Exception as why:
            warnings.warn(f"tier {tier.method} is left out: {why}", stacklevel=2)
            if failures:
                failures.not_built[tier.method] = str(why)
            return df

    @staticmethod
    def _batches(df: DataFrame, tier: BatchTier, failures: Failures | None) -> DataFrame:
        """Run a Python tier as an Arrow UDF on the undecided lines.

        Only the column it reads travels to Python, and as NULL where the line is
        decided; the other columns stay in the JVM.
        """
        others = [c for c in df.columns if c != "_best"]
        decide, tries = tier.decide, tier.tries
        failed = failures.of(tier.method) if failures else None

        def settle(values: pd.Series, out: pd.DataFrame) -> None:
            """A line on which the tier fails is left to the next tier; halving finds it, whatever the batch."""
            todo, left = [values], tries
            while todo:
                part = todo.pop()
                left -= 1
                try:
                    if left < 0:
                        raise RuntimeError("no more tries")
                    got = decide(part)
                    label, confidence = got["label"].to_numpy(), got["confidence"].astype(float).to_numpy()
                    out.loc[part.index, "label"], out.loc[part.index, "confidence"] = label, confidence
                except Exception:
                    half = len(part) // 2
                    if half and left >= 0:
                        todo += [part.iloc[half:], part.iloc[:half]]
                    elif failed is not None:
                        failed.add(len(part))

        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for values in batches:
                out = pd.DataFrame({"label": pd.Series(None, values.index, object), "confidence": pd.Series(None, values.index, float)})
                undecided = values.notna()
                if undecided.any():
                    settle(values[undecided], out)
                yield out

        asked = F.pandas_udf(ask, VERDICT)(F.when(F.col("_best").isNull(), F.col(tier.reads)))
        verdict = F.col("_verdict")
        mine = F.when(verdict["label"].isNotNull(), best(verdict["label"], tier.method, verdict["confidence"]))
        return df.withColumn("_verdict", asked).select(*others, F.coalesce(F.col("_best"), mine).alias("_best"))


def label_with_each(df: DataFrame, cascades: dict[str, Cascade], text: str = "log_message") -> DataFrame:
    """Add ``labels``, an array of ``(approach, predicted)`` with one entry per cascade.

    A tier object that several cascades share is worked out once per line.
    """
    keep = df.columns
    shared: dict[int, str] = {}
    work = df.withColumn("_text", message(F.col(text)))
    work = work.withColumns({"_lower": F.lower("_text"), "_fold": folded("_text")})
    for cascade in cascades.values():
        for tier in cascade.column_tiers() or []:
            if id(tier) in shared:
                continue
            cases = [(cond, F.lit(label) if isinstance(label, str) else label) for cond, label, _ in tier.cases(Line())]
            if cases:
                shared[id(tier)] = f"_tier_{len(shared)}"
                work = work.withColumn(shared[id(tier)], first_match(cases))
    if shared:  # through a generator, as in classify(): each label is worked out once
        tiers = F.explode(F.array(F.struct(*shared.values()))).alias("_tiers")
        work = work.select(*[c for c in work.columns if c not in shared.values()], tiers)
    entries = []
    for i, (name, cascade) in enumerate(cascades.items()):
        if cascade.column_tiers() is None:
            done = cascade.classify(work, text)
            work = done.select(*work.columns, F.col("classification").alias(f"_own_{i}"))
            label = F.col(f"_own_{i}")
        else:
            given = [F.col("_tiers")[shared[id(t)]] for t in cascade.tiers if id(t) in shared]
            label = F.coalesce(*given, F.lit(rules.UNCLASSIFIED))
        entries.append(F.struct(F.lit(name).alias("approach"), label.alias("predicted")))
    return work.select(*keep, F.array(*entries).alias("labels"))


DEFAULT_CASCADE = Cascade()


def classify(df: DataFrame, text: str = "log_message") -> DataFrame:
    """Classify a table of lines with the default cascade."""
    return DEFAULT_CASCADE.classify(df, text)


def classified_table(df: DataFrame) -> DataFrame:
    """Input columns plus ``target_label, method, confidence, reasoning``, as the CSV export has them."""
    keep = [c for c in df.columns if c not in ("target_label", *OUTCOME)]
    done = classify(df.select(*keep)).withColumnRenamed("classification", "target_label")
    return done.select(*keep, "target_label", "method", "confidence", "reasoning")

"""Probability arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden import rules


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Softmax of ``logits / T``, shifted by the maximum so that it cannot overflow."""
    t = F.greatest(F.lit(temperature) if isinstance(temperature, (int, float)) else temperature, F.lit(rules.TEMPERATURE_FLOOR))
    powers = held(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp((z - top) / t)))
    return held(powers, lambda p: held(array_sum(p), lambda s: F.transform(p, lambda e: e / s)))


def negative_log_likelihood(logits: Column, truth: Column, temperature: Column) -> Column:
    """``-ln softmax(logits / T)[truth]`` without forming the probabilities."""
    t = F.greatest(temperature, F.lit(rules.TEMPERATURE_FLOOR))

    def loss(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp((z - top) / t))
        return F.ln(total) - (F.get(logits, truth.cast("int")) - top) / t

    return held(F.array_max(logits), loss)

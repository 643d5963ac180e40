"""Numeric, decimal and date expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kilograms in a pound, pounds in a stone, retry waits in minutes, normal quantile of 95 %.
KG_PER_POUND, POUNDS_PER_STONE = "0.45359237", 14
RETRY_MINUTES = {"email": [1, 10, 60], "message": [1, 5, 15], "document": [5, 10]}
Z95 = 1.959963984540054


def imperial_to_kg(stones: Column, pounds: Column) -> Column:
    """Exact decimal kilograms of whole, non-negative stones and pounds; null otherwise."""
    total = stones.cast("decimal(12,0)") * POUNDS_PER_STONE + pounds.cast("decimal(12,0)")
    whole = (stones == F.floor(stones)) & (pounds == F.floor(pounds)) & (stones >= 0) & (pounds >= 0)
    return F.when(whole, total * F.lit(KG_PER_POUND).cast("decimal(9,8)"))


def canonical_quantity(system: Column, value: Column, converted: Column, places: int) -> Column:
    """Values of the canonical system as they are; others converted and rounded half up."""
    return F.when(system == "metric", value.cast(f"decimal(20,{places})")).otherwise(F.round(converted, places).cast(f"decimal(20,{places})"))


def plain_number(value: Column) -> Column:
    """Decimal notation without exponent or trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def decimal_places(text: Column) -> Column:
    """Decimal places of a number's text: digits after the point (final zeros included) less the exponent, and none below 0."""
    mantissa = F.regexp_extract(text, r"^[^eE]*", 0)
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)\s*$", 1).try_cast("int"), F.lit(0))
    digits = F.length(F.regexp_extract(mantissa, r"\.(\d*)", 1))
    return F.when(text.isNotNull(), F.greatest(digits - exponent, F.lit(0)))


def percent_points(a: Column, b: Column) -> Column:
    return (a - b) * 100


def backoff_minutes(attempt: Column, kind: str) -> Column:
    """Wait before the next attempt (counted from 1); null when the schedule is exhausted."""
    waits = RETRY_MINUTES[kind]
    return F.when(attempt <= len(waits), F.element_at(F.array(*map(F.lit, waits)), F.greatest(attempt, F.lit(1)).cast("int")))


def warmup_decay(step: Column, warmup: int, total: int) -> Column:
    """Linear rise to 1, then linear fall to 0."""
    return F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), (F.lit(float(total)) - step) / max(1, total - warmup)))


def worst_half_width(n: Column) -> Column:
    return F.when(n > 0, F.lit(Z95) * F.sqrt(F.lit(0.25) / n))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, x: a + x))


def argmax(scores: Column) -> Column:
    """Index of the largest score; of equal ones the lowest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_with_margin(scores: Column, margin: Column, gated: int = 1) -> Column:
    """The gated class must win by ``margin`` over the runner-up, or the runner-up is taken."""
    rest = F.transform(scores, lambda s, i: F.when(i == gated, F.lit(None)).otherwise(s))
    runner = (F.array_position(rest, F.array_max(rest)) - 1).cast("int")
    top = argmax(scores)
    return F.when((top == gated) & (F.element_at(scores, gated + 1) - F.array_max(rest) < margin), runner).otherwise(top)


def binomial_tail(k: int, n: int) -> float:
    """Two-sided binomial p-value at one half.

    Below 1,000 draws the terms are whole numbers. Beyond, the largest term comes from log-gamma and each further
    one from its ratio to the last, until none changes the sum in doubles: some multiples of the root of ``n``.
    """
    k = min(k, n - k)
    if n < 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    total, term = 0.0, 1.0
    for i in range(k, -1, -1):
        if total + term == total:
            break
        total, term = total + term, term * i / (n - i + 1)
    return min(1.0, 2 * total * math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)))


@F.pandas_udf(T.DoubleType())
def binomial_two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
    """``binomial_tail`` of whole numbers."""
    return pd.Series([binomial_tail(int(a), int(b)) for a, b in zip(k, n)])


def age_in_years(born: Column, today: Column) -> Column:
    """Whole years: the year difference, less one before the birthday."""
    return F.year(today) - F.year(born) - F.when(F.date_format(today, "MMdd") < F.date_format(born, "MMdd"), 1).otherwise(0)

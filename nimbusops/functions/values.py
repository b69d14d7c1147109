"""Column functions for numbers, keys and labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentinel_number(text: Column, trace: float | None = None) -> Column:
    """Number from report text: 'M' is missing, 'T' is a trace, any other text must be a number."""
    return (
        F.when(text == "M", F.lit(None).cast("double"))
        .when(text == "T", F.lit(trace).cast("double"))
        .otherwise(text.cast("double"))
    )


def rounded(value: Column, digits: int) -> Column:
    """Round half away from zero by scaling, as the documented results are rounded. F.round goes through
    decimal text: far slower per row, and different on values like 1.005 that have no exact double."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def fahrenheit_to_celsius(degrees: Column) -> Column:
    return rounded((degrees - 32) * 5 / 9, 1)


def scaled(value: Column, factor: float, digits: int = 0) -> Column:
    return rounded(value * factor, digits)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL for an empty whole."""
    return part / F.nullif(whole, F.lit(0))


def rate(part: Column, whole: Column) -> Column:
    """ratio with the four digits that all stored rates have; thresholds compare this value."""
    return rounded(ratio(part, whole), 4)


def if_enough(sample: Column, minimum: int, value: Column) -> Column:
    """value only when the sample is large enough."""
    return F.when(sample >= minimum, value)


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def surrogate_key(*parts: str | Column) -> Column:
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *texts))


def decode(column: Column, meanings: dict[str, str]) -> Column:
    return _chain([(column == code, F.lit(text)) for code, text in meanings.items()])


def first_label(cases: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Label of the first condition that is true."""
    chain = _chain([(condition, F.lit(label)) for condition, label in cases])
    return chain if default is None else chain.otherwise(default)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(condition: Column, value: Column) -> Column:
    """Sum over the matching rows, NULL when none matches."""
    return F.sum(F.when(condition, value))


def within(value: Column, first: Column, last: Column) -> Column:
    """Inclusive range test that is false for unknown bounds."""
    return F.coalesce(value.between(first, last), F.lit(False))


def _chain(cases: Sequence[tuple[Column, Column]]) -> Column:
    head, *rest = cases
    return reduce(lambda chain, case: chain.when(*case), rest, F.when(*head))

"""Numeric helpers that return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.missing import _col

# Fixed value: the 97.5% point of the standard normal distribution.
Z975 = 1.959963984540054


def inverse_logit(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def relative_effect(x: str | Column) -> Column:
    """Log-scale effect as a relative change."""
    return F.exp(_col(x)) - 1.0


def is_finite(x: str | Column) -> Column:
    x = _col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def interval(estimate: str | Column, se: str | Column) -> tuple[Column, Column]:
    """Normal 95% interval."""
    e, s = _col(estimate), _col(se)
    return e - Z975 * s, e + Z975 * s


def deciles(x: str | Column) -> Column:
    return _col(x) * 10

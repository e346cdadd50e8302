"""Column expressions with the missing-value rules of the source system.

Spark skips NULL in aggregates and lets it fall through conditions; the rules
below differ, so every plan states which one it wants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_missing(x: str | Column) -> Column:
    """Aggregate: does every row of the group have a value?"""
    return F.count(_col(x)) == F.count(F.lit(1))


def strict_sum(x: str | Column) -> Column:
    """Sum that is NULL as soon as one member is NULL."""
    return F.when(no_missing(x), F.sum(_col(x)))


def strict_avg(x: str | Column) -> Column:
    """Mean that is NULL as soon as one member is NULL."""
    return F.when(no_missing(x), F.avg(_col(x)))


def strict_sd(x: str | Column) -> Column:
    """Sample deviation that is NULL as soon as one member is NULL."""
    return F.when(no_missing(x), F.stddev_samp(_col(x)))


def sum_or_zero(x: str | Column) -> Column:
    """Sum over the known values; an all-NULL group sums to zero."""
    total = F.sum(_col(x))
    return F.coalesce(total, F.lit(0).cast("long"))


def any_true(x: str | Column) -> Column:
    """Was the flag ever true? NULL counts as no."""
    return F.coalesce(F.bool_or(_col(x)), F.lit(False))


def not_in(x: str | Column, values: Sequence) -> Column:
    """Membership test in which NULL is simply not a member."""
    return ~F.coalesce(_col(x).isin(list(values)), F.lit(False))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that stays NULL when the condition is NULL."""
    return F.when(cond, yes).when(~cond, no)


def count_values(x: str | Column) -> Column:
    """Number of distinct values, NULL being one of them."""
    x = _col(x)
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))


def flag(x: str | Column) -> Column:
    """Boolean to 0/1, NULL kept."""
    return _col(x).cast("int")

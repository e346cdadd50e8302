"""Projection, filtering, ordering and union."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication (NULLs compare equal)."""
    return df.dropDuplicates()


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def columns_of(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def to_front(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])


def across(
    df: DataFrame,
    names: Iterable[str],
    change: Callable[[Column], Column],
    name: str = "{}",
) -> DataFrame:
    """Apply one expression to many columns; ``name`` may build new names."""
    return df.withColumns({name.format(c): change(F.col(c)) for c in names})


def keep(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """Rows that satisfy every condition of a reusable list (NULL drops)."""
    return df.filter(reduce(lambda a, b: a & b, conditions))


def members(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is in a literal list or in another table's column."""
    if isinstance(values, DataFrame):
        only = values.select(F.col(values.columns[0]).alias(column))
        return df.join(only, column, "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def matches(df: DataFrame, text: str, pattern: str, regex: bool = False) -> DataFrame:
    """Rows whose text contains the value of another column.

    The other column is taken literally unless ``regex`` says that it holds
    patterns.
    """
    if regex:
        return df.filter(F.rlike(F.col(text), F.col(pattern)))
    return df.filter(F.contains(F.col(text), F.col(pattern)))


def ordered(df: DataFrame, *names: str) -> DataFrame:
    """Sort with missing values last; ``-name`` sorts downwards."""
    keys = [
        F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last()
        for n in names
    ]
    return df.orderBy(*keys)


def most_frequent(df: DataFrame, *by: str, k: int | None = None) -> DataFrame:
    """Group counts, largest first; ties by the group itself."""
    out = ordered(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "-n", *by)
    return out if k is None else out.limit(k)


def sort_key(x: str, levels: Sequence[str]) -> Column:
    """Integer order of a category: listed levels first, the rest after them."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(x))
    return F.when(pos > 0, pos).otherwise(F.lit(len(levels) + 1)).cast("int")


def stacked(tables: Mapping[str, DataFrame], id_column: str = "source") -> DataFrame:
    """Union by name with the table's name as a column; gaps become NULL."""
    tagged = [df.select(F.lit(key).alias(id_column), "*") for key, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

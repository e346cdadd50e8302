"""Joins with the source system's rules for missing keys and equal names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands that travel in one array, on average.
SLAB_BANDS = 1000


def _conjunction(left: DataFrame, right: DataFrame, pairs, na_matches: str) -> Column:
    tests = [
        left[a].eqNullSafe(right[b]) if na_matches == "na" else left[a] == right[b]
        for a, b in pairs
    ]
    return reduce(lambda a, b: a & b, tests)


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    na_matches: str = "na",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join where NULL keys match each other by default.

    Other columns that occur on both sides get a suffix. ``<=>`` is still an
    equi-join for Spark, so hash and sort-merge plans stay available.
    """
    on = list(on)
    if how in ("left_semi", "left_anti"):
        tagged = right.select(*[F.col(k).alias(f"__{k}") for k in on])
        pairs = [(k, f"__{k}") for k in on]
        return left.join(tagged, _conjunction(left, tagged, pairs, na_matches), how)
    clash = (set(left.columns) & set(right.columns)) - set(on)
    lhs = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    rhs = right.withColumnsRenamed(
        {c: c + suffixes[1] for c in clash} | {k: f"__{k}" for k in on}
    )
    joined = lhs.join(rhs, _conjunction(lhs, rhs, [(k, f"__{k}") for k in on], na_matches), how)
    keys = {
        k: F.coalesce(F.col(k), F.col(f"__{k}"))
        if how in ("full", "right", "outer")
        else F.col(k)
        for k in on
    }
    return joined.select(
        *[keys[c].alias(c) if c in keys else F.col(c) for c in lhs.columns],
        *[F.col(c) for c in rhs.columns if c not in {f"__{k}" for k in on}],
    )


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "left", na_matches: str = "na"
) -> DataFrame:
    """Join on every column name the two sides share."""
    on = [c for c in left.columns if c in right.columns]
    return keyed_join(left, right, on, how, na_matches)


def unique_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", **kw
) -> DataFrame:
    """Join that must not multiply rows: fails if the right key repeats."""
    repeats = right.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeats.isEmpty():
        raise ValueError(f"join key {list(on)} is not unique on the right side")
    return keyed_join(left, right, on, how, **kw)


def with_scalar(df: DataFrame, one_row: DataFrame, column: str, name: str) -> DataFrame:
    """Attach a single computed value to every row as a scalar subquery."""
    return df.withColumn(name, one_row.select(column).scalar())


def agreement(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_value: str, right_value: str
) -> DataFrame:
    """How often do two sources say the same? NULL where one does not say."""
    both = keyed_join(
        left.select(*on, F.col(left_value).alias("a")),
        right.select(*on, F.col(right_value).alias("b")),
        on,
        "full",
    )
    return both.groupBy((F.col("a") == F.col("b")).alias("agree")).agg(
        F.count(F.lit(1)).alias("n")
    )


def in_band(value: str | Column, bands: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the fixed band ``[low, high)`` that holds a value."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(bands)):
        out = F.when((v >= low) & (v < high), F.lit(label)).otherwise(out)
    return out


def band_join(
    df: DataFrame, bands: DataFrame, by: str, value: str, label: str = "level"
) -> DataFrame:
    """Band lookup with per-group bands held in a table (by, low, high, label).

    The scale is cut into slabs at quantiles of the bands' lower ends. A band
    goes to every slab that it overlaps and a value to the one that holds it,
    so the join is an equi-join on (group, slab): the bands of a group and slab
    travel as one short array, however many there are in all.
    """
    slabs = -(-bands.count() // SLAB_BANDS)
    cuts = sorted(set(bands.select(F.col("low").cast("double")).approxQuantile("low", [i / slabs for i in range(1, slabs)], 0.25 / slabs))) if slabs > 1 else []
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")

    def slab(x: Column) -> Column:
        return F.size(F.filter(edges, lambda c: c <= x.cast("double")))

    spread = F.explode(F.sequence(slab(F.col("low")), F.greatest(slab(F.col("low")), slab(F.col("high")))))
    packed = bands.withColumn("__slab", spread).groupBy(by, "__slab").agg(
        F.array_sort(F.collect_set(F.struct("low", "high", label))).alias("__bands")
    )
    hit = F.get(
        F.filter("__bands", lambda b: (F.col(value) >= b["low"]) & (F.col(value) < b["high"])), F.lit(0)
    )
    placed = df.withColumn("__slab", slab(F.col(value)))
    return placed.join(packed, [by, "__slab"], "left").withColumn(label, hit[label]).drop("__bands", "__slab")

"""Grouped counts, shares, means and intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.missing import flag, strict_avg, strict_sd
from cohortlab.functions.numbers import interval


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def count_by(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group; NULL is a group of its own."""
    return df.groupBy(*by).agg(_n())


def count_of_counts(df: DataFrame, *by: str) -> DataFrame:
    """How many groups have one row, two rows, ..."""
    return count_by(df, *by).groupBy("n").agg(F.count(F.lit(1)).alias("nn"))


def share_within(
    df: DataFrame, value: str, by: Sequence[str] = (), name: str = "share"
) -> DataFrame:
    """Value as a share of its group's total (or of everything)."""
    if not by:
        total = df.agg(F.sum(value).alias("t"))
        return df.withColumn(name, F.try_divide(F.col(value), total.select("t").scalar()))
    totals = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum(value).alias("__total"))
    cond = [df[c].eqNullSafe(F.col(f"__{c}")) for c in by]
    return (
        df.join(totals, cond, "left")
        .withColumn(name, F.try_divide(value, "__total"))
        .drop("__total", *[f"__{c}" for c in by])
    )


def shares_of(df: DataFrame, names: Sequence[str], n: str, suffix: str = "_share") -> DataFrame:
    """``<x>_share = x / n`` for a range of count columns."""
    return df.withColumns({c + suffix: F.col(c) / F.col(n) for c in names})


def ever(df: DataFrame, by: Sequence[str], test: Column, name: str) -> DataFrame:
    """Was the test ever true within the group? Unknown counts as no."""
    return df.groupBy(*by).agg(F.coalesce(F.bool_or(test), F.lit(False)).alias(name))


def mean_of_means(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """One row: strict mean per entity, then the mean over known entities."""
    inner = df.groupBy(*by).agg(strict_avg(value).alias("__m"))
    return inner.agg(F.avg("__m").alias(name))


def mean_interval(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, deviation, size, standard error and 95% interval per group.

    ``n`` counts all rows, and one missing value makes the group's mean
    missing, as in the source system.
    """
    out = df.groupBy(*by).agg(
        strict_avg(value).alias("mean"), strict_sd(value).alias("sd"), _n()
    )
    out = out.withColumn("se", F.col("sd") / F.sqrt("n"))
    low, high = interval("mean", "se")
    return out.withColumns({"ci_lo": low, "ci_hi": high})


def entity_mean_interval(
    df: DataFrame, value: str, entity: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Average within entities first, then :func:`mean_interval` over them."""
    inner = df.groupBy(*by, *entity).agg(strict_avg(value).alias(value))
    return mean_interval(inner, value, by)


def mean_se(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean with one standard error either side, over the known values."""
    return (
        df.groupBy(*by)
        .agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
        .withColumns({"low": F.col("mean") - F.col("se"), "high": F.col("mean") + F.col("se")})
    )


def flag_mean(df: DataFrame, test: str, by: Sequence[str], name: str) -> DataFrame:
    """Group size and mean of a boolean column."""
    return df.groupBy(*by).agg(_n(), strict_avg(flag(test)).alias(name))


def group_gap(
    df: DataFrame,
    gap: str,
    entity: Sequence[str],
    group: str,
    person: Sequence[str],
    reference: str,
    name: str = "dmg",
) -> DataFrame:
    """Mean gap per (entity, group) relative to a reference group.

    The reference is the mean over its members of their own mean gap. Cells
    without a known gap, and all cells when there is no reference, are left out.
    """
    ref = mean_of_means(df.filter(F.col(group) == reference), gap, person, "ref")
    cells = df.groupBy(*entity, group).agg(F.avg(gap).alias("__m"))
    out = cells.select(*entity, group, (F.col("__m") - ref.select("ref").scalar()).alias(name))
    return out.filter(F.col(name).isNotNull())


def linear_trend(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Least-squares line per group."""
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(
        F.regr_count(yy, xx).alias("n"),
        F.regr_slope(yy, xx).alias("slope"),
        F.regr_intercept(yy, xx).alias("intercept"),
        F.regr_r2(yy, xx).alias("r2"),
    )


def distinct_by(df: DataFrame, by: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Distinct values per group, ``{output: column}``.

    Each value is first reduced to one row, so a large group costs rows, not
    memory.
    """
    return df.groupBy(*by).agg(*[F.count_distinct(c).alias(n) for n, c in names.items()])


def marginal_profile(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of each value of several categorical columns."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"))
            for c in names
        ]
    )
    long = df.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.*")
    counts = count_by(long, *by, "variable", "value")
    return share_within(counts, "n", [*by, "variable"])


def composition(df: DataFrame, members: DataFrame, by: str, entity: str) -> DataFrame:
    """Per group: rows in the facts next to entities in the dimension."""
    rows = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    entities = members.groupBy(by).agg(F.count_distinct(entity).alias("n_entities"))
    return rows.join(entities, by, "full")

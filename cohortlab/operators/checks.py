"""Assertions as tables: one row per check, so a job can log or stop on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and whether the key is unique (NULL is a key)."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.max("n") == 1, F.lit(True)).alias("is_unique"),
    )


def size_report(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of groups with the smallest and the largest group."""
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
    )


def holds(df: DataFrame, test: Column, name: str = "holds") -> DataFrame:
    """One row: is the test true for every row?"""
    return df.agg(
        F.coalesce(F.bool_and(test), F.lit(True)).alias(name),
        F.count_if(~F.coalesce(test, F.lit(False))).alias("n_not_true"),
    )


def require(report: DataFrame, column: str, message: str) -> None:
    """Stop unless the (one-row) report says yes."""
    if not report.select(F.col(column)).head()[0]:
        raise AssertionError(message)


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    names = df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    )
    return one.unpivot(["__n"], names, "variable", "empty").select(
        "variable", "empty", (F.col("empty") / F.col("__n")).alias("frac")
    )

"""Exact stratified train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import staged


def key_text(*parts: Column) -> Column:
    """One text per combination of values: every part with its length, NULL without one."""

    def part(x: Column) -> Column:
        x = x.cast("string")
        return F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return F.concat(*[part(x) for x in parts])


def stratified_split(
    df: DataFrame,
    strata: Sequence[str],
    key: Sequence[str],
    share: float = 0.25,
    seed: int = 2003,
    name: str = "is_test",
) -> DataFrame:
    """Flag exactly ``round(n * share)`` rows of every stratum.

    Rows are ordered by a hash of their (unique) key and the seed, so the
    choice does not depend on partitioning. The n-th smallest hash of a stratum
    is found by counting hash prefixes and then ranking only the rows that
    share the deciding prefix: a stratum is never sorted as a whole. The two
    small tables in between (one row per stratum) are stored, so Spark knows
    their size when it decides how to join them. Rows with one key are refused:
    nothing tells them apart.
    """
    repeats = df.groupBy(*key).count().filter("count > 1")
    if not repeats.isEmpty():
        raise ValueError(f"the key {list(key)} is not unique")
    text = key_text(*[F.col(k) for k in key], F.lit(seed))
    rows = df.select(*[F.col(s).alias(f"__{s}") for s in strata], F.md5(text).alias("__h"))
    marks = [f"__{s}" for s in strata]
    rows = rows.withColumn("__bin", F.substring("__h", 1, 4))
    bins = rows.groupBy(*marks, "__bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*marks).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumns(
        {
            "upto": F.sum("n").over(upto),
            "want": F.rint(F.sum("n").over(Window.partitionBy(*marks)) * F.lit(share)),
        }
    )
    edge = bins.filter((F.col("upto") - F.col("n") < F.col("want")) & (F.col("want") <= F.col("upto")))
    edge = edge.select(
        *[F.col(m).alias(f"_{m}") for m in marks],
        F.col("__bin").alias("__edge"),
        (F.col("want") - (F.col("upto") - F.col("n"))).alias("need"),
    )
    edge = staged(edge, "split_edges")
    same = [rows[m].eqNullSafe(F.col(f"_{m}")) for m in marks]
    border = rows.join(edge, [*same, rows["__bin"] == edge["__edge"]])
    place = F.row_number().over(Window.partitionBy(*marks).orderBy("__h"))
    cut = (
        border.withColumn("__place", place)
        .filter(F.col("__place") == F.col("need"))
        .select(*[F.col(m) for m in marks], F.col("__h").alias("__cut"))
    )
    cut = staged(cut, "split_cuts")
    on = [df[s].eqNullSafe(F.col(f"__{s}")) for s in strata]
    return (
        df.join(cut, on, "left")
        .withColumn(name, F.coalesce(F.md5(text) <= F.col("__cut"), F.lit(False)))
        .drop("__cut", *marks)
    )

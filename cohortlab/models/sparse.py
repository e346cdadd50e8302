"""Designs with factors of very many levels.

The dense design has one column per level, which suits tens of levels. Here a row is a
short list of cells instead: every term has one cell at most, a label and a value, because
a factor is at one level only. Labels are data, so neither the plan nor the driver grows
with the levels.

`fit_absorbed` is least squares with such a factor: its normal equations are a diagonal
block for the levels and a small dense rest, so the levels are eliminated one by one in
their own sums (a Schur complement) and only the rest is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.models.kernels import independent_columns, scaled_inverse
from cohortlab.session import staged

CELLS = "array<struct<label:string,value:double>>"


def _kind(df: DataFrame, name: str, logs: Sequence[str]) -> str:
    kind = df.schema[name].dataType
    if name in logs:
        return "log10"
    return "flag" if isinstance(kind, T.BooleanType) else "factor" if isinstance(kind, T.StringType) else "number"


def references(df: DataFrame, factors: Sequence[str], first: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """The reference level of each factor: the pinned one, where rows have it, or the first."""
    if not factors:
        return {}
    first = first or {}
    cells = [F.min(c).alias(f"least_{c}") for c in factors]
    cells += [F.bool_or(F.col(c) == first[c]).alias(f"pinned_{c}") for c in factors if c in first]
    one = df.agg(*cells).first()
    return {c: first[c] if c in first and one[f"pinned_{c}"] else one[f"least_{c}"] for c in factors}


def sparse_design(
    df: DataFrame,
    terms: Sequence[tuple[str, ...]],
    keep: Sequence[str] = (),
    first: Mapping[str, str] | None = None,
    logs: Sequence[str] = (),
) -> DataFrame:
    """Complete rows as (keep, cells): the terms of a spec by label, the intercept among them.

    Labels are those of the dense design. A term whose factors are at their reference has
    no cell in the row; numbers of value zero have one.
    """
    names = list(dict.fromkeys(v for term in terms for v in term))
    kinds = {n: _kind(df, n, logs) for n in names}
    base = references(df, [n for n in names if kinds[n] == "factor"], first)

    def cell(name: str) -> tuple[Column, Column]:
        """Label and value; a NULL value is no cell."""
        x = F.col(name)
        if kinds[name] == "factor":
            return F.concat(F.lit(name), x), F.when(x != F.lit(base[name]), 1.0)
        if kinds[name] == "log10":
            return F.lit(f"log10({name})"), F.when(x > 0, F.log10(x.cast("double")))
        if kinds[name] == "flag":
            return F.lit(f"{name}TRUE"), x.cast("int").cast("double")
        return F.lit(name), x.cast("double")

    cells = [F.struct(F.lit("(Intercept)").alias("label"), F.lit(1.0).alias("value"))]
    for term in terms:
        parts = [cell(v) for v in term]
        value = parts[0][1]
        for _, more in parts[1:]:
            value = value * more
        label = F.concat_ws(":", *(p[0] for p in parts))
        cells.append(F.when(value.isNotNull(), F.struct(label.alias("label"), value.alias("value"))))
    complete = df.where(F.lit(True))
    for name in names:
        known = cell(name)[1] if kinds[name] == "log10" else F.col(name)
        complete = complete.where(known.isNotNull())
    return complete.select(*keep, F.array_compact(F.array(*cells)).cast(CELLS).alias("cells"))


def column_sums(design: DataFrame) -> DataFrame:
    """(label, n, total) of every design column that has a cell."""
    each = design.select(F.explode("cells").alias("c")).select("c.*")
    return each.groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def cross_products(design: DataFrame) -> DataFrame:
    """(a, b, total) with a <= b: the cross products that are not empty.

    A row gives at most one product for each pair of terms; they are added up map-side.
    """
    order = F.array_sort("cells")
    pairs = F.flatten(
        F.transform(order, lambda p, i: F.transform(F.slice(order, i + 1, F.size(order)), lambda q: F.struct(p["label"].alias("a"), q["label"].alias("b"), (p["value"] * q["value"]).alias("v"))))
    )
    each = design.select(F.explode(pairs).alias("p")).select("p.*")
    return each.groupBy("a", "b").agg(F.sum("v").alias("total"))


def fit_absorbed(df: DataFrame, outcome: str, numbers: Sequence[str], factor: str) -> tuple[DataFrame, DataFrame]:
    """Least squares of ``outcome`` on ``numbers`` with an intercept for every level of ``factor``.

    (coefficients, levels): (term, estimate, se, n_rows) of the numbers, and (factor,
    estimate, se, n_rows) of each level's own intercept. Rows with a missing value are left
    out. Numbers spanned by the levels and the numbers before them have no coefficient.
    """
    names = [f"x{i}" for i in range(len(numbers))]
    x = {name: F.col(c).cast("double").alias(name) for name, c in zip(names, numbers)}
    rows = df.select(F.col(factor), F.col(outcome).cast("double").alias("y"), *x.values()).dropna()
    # shifting by the overall means keeps the sums of squares from cancelling
    centre = rows.agg(F.avg("y").alias("y"), *(F.avg(n).alias(n) for n in names)).first()
    rows = rows.withColumns({n: F.col(n) - F.lit(centre[n] or 0.0) for n in ("y", *names)})
    every = ["y", *names]
    products = [(a, b) for i, a in enumerate(every) for b in every[i:]]
    sums = [F.count("*").alias("n"), *(F.sum(a).alias(f"s_{a}") for a in every), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in products)]
    levels = staged(rows.groupBy(factor).agg(*sums), "levels")

    # what is left of every product within the levels
    left = [F.sum(F.col(f"{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")).alias(f"{a}_{b}") for a, b in products]
    total = levels.agg(F.sum("n").alias("n"), F.count("*").alias("levels"), *left).first()
    schema = "term string, estimate double, se double, n_rows long"
    if not total["levels"]:
        spark = df.sparkSession
        return spark.createDataFrame([], schema), levels.select(factor, F.lit(0.0).alias("estimate"), F.lit(0.0).alias("se"), F.col("n").alias("n_rows"))
    p = len(names)
    gram, with_y = np.zeros((p, p)), np.zeros(p)
    for i, a in enumerate(names):
        with_y[i] = total[f"y_{a}"]
        for j in range(i, p):
            gram[i, j] = gram[j, i] = total[f"{a}_{names[j]}"]
    kept = independent_columns(gram)
    inverse = scaled_inverse(gram[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    beta = inverse @ with_y[kept]
    free = total["n"] - total["levels"] - len(kept)
    spread = max(float(total["y_y"]) - float(beta @ with_y[kept]), 0.0) / free if free > 0 else float("nan")
    coefficients = [(numbers[j], float(b), float(np.sqrt(spread * inverse[i, i])), int(total["n"])) for i, (j, b) in enumerate(zip(kept, beta))]

    mean = {names[j]: F.col(f"s_{names[j]}") / F.col("n") for j in kept}
    own, quadratic = F.col("s_y") / F.col("n") + F.lit(float(centre["y"])), F.lit(0.0)
    for i, j in enumerate(kept):
        own = own - F.lit(float(beta[i])) * (mean[names[j]] + F.lit(float(centre[names[j]])))
        for k, m in enumerate(kept):
            raw = [mean[names[q]] + F.lit(float(centre[names[q]])) for q in (j, m)]
            quadratic = quadratic + F.lit(float(inverse[i, k])) * raw[0] * raw[1]
    effects = levels.select(factor, own.alias("estimate"), F.sqrt(F.lit(float(spread)) * (1 / F.col("n") + quadratic)).alias("se"), F.col("n").alias("n_rows"))
    return df.sparkSession.createDataFrame(coefficients, schema), effects

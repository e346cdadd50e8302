"""Column profiles, correlations and principal components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.recode import level_index
from cohortlab.operators.scans import running_totals
from cohortlab.session import staged


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, value, n) of numeric columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in names])
    long = df.select(F.explode(cells).alias("cell")).select("cell.*").filter("value is not null")
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles(counts: DataFrame, probs: Mapping[str, float], chunks: int | None = None) -> DataFrame:
    """Exact interpolated quantiles of many columns, without gathering one.

    ``counts`` is :func:`value_counts`, best stored. The counts are accumulated
    chunk by chunk, and the two order statistics around each quantile are
    picked by rank.
    """
    ranked = running_totals(counts, {"upto": F.col("n")}, ["value"], ["variable"], chunks=chunks)
    sizes = counts.groupBy("variable").agg(F.sum("n").alias("size"))
    ranked = ranked.join(sizes, "variable")
    out = []
    for name, p in probs.items():
        rank = (F.col("size") - 1) * F.lit(float(p))
        below, above = F.floor(rank), F.ceil(rank)
        first = F.col("upto") - F.col("n")

        def at(k):
            return F.max(F.when((first <= k) & (k < F.col("upto")), F.col("value")))

        weight = F.max(rank - below)
        out.append((at(below) + weight * (at(above) - at(below))).alias(name))
    return ranked.groupBy("variable").agg(*out)


def numeric_profile(
    df: DataFrame, names: Sequence[str], counts: DataFrame | None = None
) -> DataFrame:
    """Missing, complete, mean, deviation and the five quartile points."""
    if counts is None:
        counts = staged(value_counts(df, names), "value_counts")
    exprs = []
    for c in names:
        x = F.col(c).cast("double")
        exprs.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.count_if(x.isNull()).alias("missing"),
                F.count(x).alias("complete"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("sd"),
            ).alias(c)
        )
    one = df.agg(*exprs).select(F.explode(F.array(*names)).alias("v")).select("v.*")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    return one.join(quantiles(counts, probs), "variable", "left")


def column_profile(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = 8, k: int = 4
) -> DataFrame:
    """One row per column: what is missing, how it is spread, what is frequent.

    Numeric columns carry mean, deviation, quartile points and an equal-width
    histogram as an array; categorical ones the number of distinct values and
    their most frequent values as text.
    """
    counts = staged(value_counts(df, numeric), "value_counts")
    spread = numeric_profile(df, numeric, counts)
    ends = counts.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cells = counts.join(ends, "variable")
    place = F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    cells = cells.withColumn(
        "bin", F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(bins - 1))).otherwise(0)
    )
    heights = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)) for i in range(bins)]
    hist = cells.groupBy("variable").agg(F.array(*heights).alias("hist"))
    left = spread.join(hist, "variable", "left").withColumn("kind", F.lit("numeric"))
    gaps = df.agg(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.count_if(F.col(c).isNull()).alias("missing"),
                F.count(c).alias("complete"),
            ).alias(c)
            for c in categorical
        ]
    )
    gaps = gaps.select(F.explode(F.array(*categorical)).alias("v")).select("v.*")
    text = F.concat(F.col("value"), F.lit(": "), F.col("n").cast("string"))
    # at most k rows per column
    top = top_values(df, categorical, k).groupBy("variable", "n_unique").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), ", "
        ).alias("top_counts")
    )
    right = gaps.join(top, "variable", "left").withColumn("kind", F.lit("categorical"))
    return left.unionByName(right, allowMissingColumns=True)


def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """Equal-width histogram between the smallest and the largest value."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    k = F.floor((x - lo) / ((hi - lo) / bins))
    return (
        df.filter(x.isNotNull())
        .select(F.when(hi == lo, F.lit(0)).otherwise(F.least(k, F.lit(bins - 1))).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(df: DataFrame, names: Sequence[str], k: int = 4) -> DataFrame:
    """The k most frequent values of each categorical column, with distinct counts."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"))
            for c in names
        ]
    )
    long = df.select(F.explode(cells).alias("cell")).select("cell.*").filter("value is not null")
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("variable").orderBy(F.desc("n"), F.asc("value"))
    distinct = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("n_unique"))
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(distinct, "variable")


#: Columns of a block of cross products.
GRAM_BLOCK = 32


def _gram_blocks(names: Sequence[str], shift: Sequence[float], block: int):
    """Task function: rows to the cross products of every pair of column blocks.

    Of each pair of columns, over the rows that have both: how many, the sums of either,
    of their squares, and of their product.
    """
    cuts = [(i, min(i + block, len(names))) for i in range(0, len(names), block)]

    def run(batches):
        sums = {}
        for batch in batches:
            has = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = np.stack([c.fill_null(m).to_numpy(zero_copy_only=False) - m for c, m in zip(batch.columns, shift)])
            for i, (a, b) in enumerate(cuts):
                for j, (c, d) in enumerate(cuts[: i + 1]):
                    here = np.stack(
                        [has[a:b] @ has[c:d].T, x[a:b] @ has[c:d].T, has[a:b] @ x[c:d].T, x[a:b] ** 2 @ has[c:d].T, has[a:b] @ (x[c:d] ** 2).T, x[a:b] @ x[c:d].T]
                    )
                    sums[i, j] = sums.get((i, j), 0.0) + here
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in sums], pa.int32()),
                    pa.array([j for _, j in sums], pa.int32()),
                    pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64())),
                ],
                names=["i", "j", "sums"],
            )

    return run


def _pairs_of_blocks(names: Sequence[str], block: int):
    """Task function: added-up blocks to one row per pair of columns."""

    def run(batches):
        for batch in batches:
            for i, j, sums in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "sums"))):
                mine, other = names[i * block : (i + 1) * block], names[j * block : (j + 1) * block]
                n, x, y, xx, yy, xy = np.asarray(sums).reshape(6, len(mine), len(other))
                with np.errstate(all="ignore"):
                    spread = [np.where(q / n - (s / n) ** 2 > 1e-12 * q / n, q / n - (s / n) ** 2, 0.0) for s, q in ((x, xx), (y, yy))]
                    cor = (xy / n - x * y / n**2) / np.sqrt(spread[0] * spread[1])
                    known = (spread[0] * spread[1] != 0) & (n > 0)
                rows = [(a, b, float(cor[p, q]) if known[p, q] else None) for p, a in enumerate(mine) for q, b in enumerate(other) if a > b]
                columns = zip(*rows) if rows else ([], [], [])
                types = (pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["Var1", "Var2", "cor"])

    return run


def correlations(
    df: DataFrame, names: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None, block: int = GRAM_BLOCK
) -> DataFrame:
    """Pairwise-complete correlations, long form, each pair once (Var1 > Var2).

    Categorical columns enter as the position of the value in their level list. The cross
    products of values and of marks of presence are formed as matrix products where the
    rows are, block of columns by block, and added up by block: the plan does not grow with
    the number of pairs, and no pair reaches the driver. A pair that is constant in one
    column has no correlation.
    """
    levels, names = levels or {}, sorted(names)
    df = df.select(
        *[
            (level_index(c, levels[c]) if c in levels else F.col(c)).cast("double").alias(c)
            for c in names
        ]
    )
    # about the means, sums of squares don't cancel
    means = [m if m is not None and np.isfinite(m) else 0.0 for m in df.agg(*[F.avg(c) for c in names]).first()]
    parts = df.mapInArrow(_gram_blocks(names, means, block), "i int, j int, sums array<double>")
    total = parts.groupBy("i", "j").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    total = total.select("i", "j", vector_to_array("sums").alias("sums"))
    return total.mapInArrow(_pairs_of_blocks(names, block), "Var1 string, Var2 string, cor double")


def strong_pairs(cors: DataFrame, above: float = 0.8) -> DataFrame:
    return cors.filter(F.abs("cor") > above).orderBy(F.abs("cor").desc())


def principal_components(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Centred, unscaled components: deviation, share and loadings.

    Rows with a missing value are left out. The sign of a component is fixed
    by making its largest loading positive.
    """
    # the passes read the numbers alone, not what they are made from
    rows = staged(df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna(), "components")
    vectors = VectorAssembler(inputCols=list(names), outputCol="v").transform(rows).select("v")
    model = PCA(k=len(names), inputCol="v", outputCol="pc").fit(vectors)
    total = rows.agg(sum(F.var_samp(c) for c in names)).head()[0]
    loadings = model.pc.toArray()
    out = []
    for j, share in enumerate(model.explainedVariance.toArray()):
        axis = loadings[:, j]
        axis = axis * (1.0 if axis[np.argmax(np.abs(axis))] >= 0 else -1.0)
        sdev = float(np.sqrt(max(share * total, 0.0)))
        out += [(j + 1, sdev, float(share), c, float(a)) for c, a in zip(names, axis)]
    return df.sparkSession.createDataFrame(
        out, "component int, sdev double, share double, variable string, loading double"
    )

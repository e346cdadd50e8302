"""ROC curves and observed-versus-fitted counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.numbers import inverse_logit
from cohortlab.operators.joins import keyed_join
from cohortlab.operators.scans import running_totals
from cohortlab.session import staged


def score_counts(df: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, with totals below it.

    The counts are stored, so the rows are scored and scanned once although
    the running totals pass over the counts several times.
    """
    return counted(_scored(df, score, truth, by), by)


def counted(per: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored (threshold, pos, neg) counts with their totals below each score."""
    per = staged(per, "score_counts")
    return running_totals(
        per, {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}, ["threshold"], by
    )


def _scored(df: DataFrame, score: str, truth: str, by: Sequence[str]) -> DataFrame:
    return (
        df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*by, F.col(score).alias("threshold"))
        .agg(
            F.count_if(F.col(truth)).alias("pos"),
            F.count_if(~F.col(truth)).alias("neg"),
        )
    )


def _totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def _with_totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = _totals(counts, by)
    if by:
        tagged = totals.withColumnsRenamed({c: f"__{c}" for c in by})
        same = [counts[c].eqNullSafe(F.col(f"__{c}")) for c in by]
        return counts.join(tagged, same).drop(*[f"__{c}" for c in by])
    return counts.withColumns(
        {"P": totals.select("P").scalar(), "N": totals.select("N").scalar()}
    )


def roc_curve(df: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, specificity, sensitivity); positive when score >= threshold.

    The two infinite end thresholds are part of the curve.
    """
    return curve_of(score_counts(df, score, truth, by), by)


def curve_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The curve of counted scores."""
    full = _with_totals(counts, by)
    inner = full.select(
        *by,
        "threshold",
        (F.col("neg_upto") - F.col("neg")).alias("tn"),
        (F.col("P") - F.col("pos_upto") + F.col("pos")).alias("tp"),
        "P",
        "N",
    )
    ends = _totals(counts, by).select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.lit(float("-inf")).alias("threshold"), F.lit(0).cast("long").alias("tn"), F.col("P").alias("tp")
                ),
                F.struct(
                    F.lit(float("inf")).alias("threshold"), F.col("N").alias("tn"), F.lit(0).cast("long").alias("tp")
                ),
            )
        ).alias("e"),
        "P",
        "N",
    ).select(*by, "e.*", "P", "N")
    return inner.unionByName(ends).select(
        *by,
        "threshold",
        F.try_divide("tn", "N").alias("specificity"),
        F.try_divide("tp", "P").alias("sensitivity"),
    )


def roc_auc(df: DataFrame, score: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by mid-ranks of the distinct scores."""
    return area_of(score_counts(df, score, truth, by), by)


def area_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The area under the curve of counted scores."""
    pairs = F.sum(F.col("pos") * ((F.col("neg_upto") - F.col("neg")) + F.col("neg") / 2))
    size = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return counts.groupBy(*by).agg(F.try_divide(pairs, size).alias("auc"))


def threshold_sensitivity(curve: DataFrame, is_linear: Column) -> DataFrame:
    """Finite thresholds on the probability scale with their sensitivity."""
    return curve.filter(F.abs("threshold") != float("inf")).withColumn(
        "threshold", F.when(is_linear, F.col("threshold")).otherwise(inverse_logit("threshold"))
    )


def count_rootogram(
    df: DataFrame, outcome: str, fitted: str, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per observed count next to rows per rounded fitted mean.

    Fitted means fall into bins of width one centred on the integers, closed
    on the right.
    """
    observed = (
        df.filter(F.col(outcome).isNotNull())
        .groupBy(*by, F.col(outcome).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("observed"))
    )
    expected = (
        df.filter(F.col(fitted).isNotNull())
        .groupBy(*by, F.ceil(F.col(fitted) - 0.5).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("fitted"))
    )
    return side_by_side(observed, expected, [*by, "bin"])


def binary_rootogram(
    df: DataFrame,
    outcome: str,
    fitted: str,
    threshold: float = 0.5,
    delogit: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows per observed class next to rows per predicted class."""
    score = inverse_logit(fitted) if delogit else F.col(fitted)
    observed = df.groupBy(*by, F.col(outcome).alias("bin")).agg(F.count(F.lit(1)).alias("observed"))
    expected = df.groupBy(*by, (score > threshold).alias("bin")).agg(F.count(F.lit(1)).alias("fitted"))
    return side_by_side(
        observed.filter("bin is not null"), expected.filter("bin is not null"), [*by, "bin"]
    )


def side_by_side(observed: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    both = keyed_join(observed, expected, on, "full").na.fill(0, ["observed", "fitted"])
    return both.withColumns(
        {"sqrt_observed": F.sqrt("observed"), "sqrt_fitted": F.sqrt("fitted")}
    )


def rootogram(df: DataFrame, outcome: str, fitted: str, kinds: dict[str, str], **kw) -> DataFrame:
    """Pick the rootogram for an outcome: ``kinds`` says binary or count."""
    kind = kinds.get(outcome)
    if kind == "binary":
        return binary_rootogram(df, outcome, fitted, **kw)
    if kind == "count":
        return count_rootogram(df, outcome, fitted, **kw)
    raise ValueError(f"no rootogram for outcome {outcome}")

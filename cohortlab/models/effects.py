"""Focal effects out of coefficient tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.numbers import interval, is_finite, relative_effect
from cohortlab.operators.joins import in_band
from cohortlab.operators.verbs import columns_of, keep
from pyspark.sql import types as T

INF = float("inf")

# Cut points of the effect-size bands, upwards, per model group.
BAND_LEVELS = ["strong", "moderate", "negligible", "moderate", "strong"]
BAND_CUTS = {
    "linear": [-INF, -0.06, -0.25 * 0.06, 0.25 * 0.06, 0.06, INF],
    "logistic": [0 - 1, 1 / 2 - 1, 1 / 1.25 - 1, 1.25 - 1, 2 - 1, INF],
    "count": [0 - 1, 1 / 2 - 1, 1 / 1.25 - 1, 1.25 - 1, 2 - 1, INF],
}

# Model type to the group it is drawn with.
MODEL_GROUPS = {
    "lm": "linear",
    "logistic": "logistic",
    "bias-reduced logistic": "logistic",
    "Poisson": "count",
    "hurdle count": "count",
    "hurdle zero": "logistic",
}


def focal_effects(
    coefs: DataFrame,
    group: str = "demographic",
    reference: str = "M.White",
    regex: bool = False,
    baseline: str = "first",
    covariances: DataFrame | None = None,
) -> DataFrame:
    """Effects of each model's focal variable, per group for interactions.

    ``coefs`` has model_idx, focal_var, formula ("full" or "interaction"),
    hurdle_component, term_idx, term, estimate and se. In an interaction model
    a group's effect is the baseline (the first matching row) plus its own
    deviation, and the standard errors add in squares; that leaves out the
    covariance and also widens the reference group. ``baseline="per_component"``
    takes the baseline within each focal column and hurdle component instead,
    and ``covariances`` (model_idx, hurdle_component, term, cov_base) gives the
    exact standard error.
    """
    match = F.rlike("term", "focal_var") if regex else F.contains("term", "focal_var")
    rows = coefs.filter(match)
    bits = F.split("term", ":")
    inside = F.filter(bits, lambda b: b.contains(group))
    outside = F.filter(bits, lambda b: ~b.contains(group))
    crossed = F.col("formula") == "interaction"
    who = F.when(
        crossed,
        F.coalesce(F.replace(F.get(inside, F.lit(0)), F.lit(group), F.lit("")), F.lit(reference)),
    ).otherwise("combined")
    rows = rows.withColumns(
        {"process": F.when(crossed, F.get(outside, F.lit(0))).otherwise(F.col("term")), "__who": who}
    )
    part = F.coalesce("hurdle_component", F.lit(""))
    rows = rows.withColumn("__part", part)
    if baseline == "per_component":
        on, first_of = ["model_idx", "__part", "process"], F.col("__who") == reference
    else:
        on, first_of = ["model_idx"], F.lit(True)
    at = F.struct("__part", "term_idx")
    base = (
        rows.filter(crossed & first_of)
        .groupBy(*on)
        .agg(F.min_by(F.struct("estimate", "se"), at).alias("__b"))
    )
    rows = rows.join(base, on, "left")
    own = F.col("__who") == reference
    estimate = F.when(crossed & ~own, F.col("estimate") + F.col("__b.estimate")).otherwise(
        F.col("estimate")
    )
    summed = F.sqrt(F.pow("se", F.lit(2)) + F.pow("__b.se", F.lit(2)))
    if covariances is None:
        se = F.when(crossed, summed).otherwise(F.col("se"))
    else:
        covs = covariances.select(
            "model_idx", F.coalesce("hurdle_component", F.lit("")).alias("__part"), "term", "cov_base"
        )
        rows = rows.join(covs, ["model_idx", "__part", "term"], "left")
        exact = F.sqrt(
            F.pow("se", F.lit(2)) + F.pow("__b.se", F.lit(2)) + 2 * F.coalesce("cov_base", F.lit(0.0))
        )
        se = F.when(crossed & ~own, exact).otherwise(F.col("se"))
    rows = rows.withColumns({"estimate_comb": estimate, "se_comb": se})
    low, high = interval("estimate_comb", "se_comb")
    who_bits = F.split("__who", r"\.")
    return rows.select(
        *[c for c in coefs.columns if c != "term"],
        "process",
        F.col("__who").alias("term"),
        F.when(crossed, F.get(who_bits, F.lit(0))).otherwise("combined").alias("gender"),
        F.when(crossed, F.get(who_bits, F.lit(1))).otherwise("combined").alias("race"),
        "estimate_comb",
        "se_comb",
        low.alias("ci_low"),
        high.alias("ci_high"),
    )


def with_model_group(effects: DataFrame) -> DataFrame:
    """Hurdle components as model types of their own, and the model group."""
    kind = F.when(
        F.col("hurdle_component").isNotNull(),
        F.concat("model_type", F.lit(" "), "hurdle_component"),
    ).otherwise(F.col("model_type"))
    out = effects.withColumn("model_type", kind)
    group = F.lit(None).cast("string")
    for name, g in MODEL_GROUPS.items():
        group = F.when(F.col("model_type") == name, F.lit(g)).otherwise(group)
    return out.withColumn("model_group", group)


def back_transformed(effects: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Log-scale numbers as relative changes, standard errors included.

    ``keep_raw`` adds the untransformed columns with the suffix ``_raw``.
    """
    names = columns_of(effects, T.DoubleType)
    linear = F.col("model_type") == "lm"
    raw = {f"{c}_raw": F.col(c) for c in names} if keep_raw else {}
    return effects.withColumns(raw).withColumns(
        {c: F.when(linear, F.col(c)).otherwise(relative_effect(c)) for c in names}
    )


def with_band(effects: DataFrame, value: str = "estimate_comb") -> DataFrame:
    """Effect-size band of each estimate within its model group."""
    level = F.lit(None).cast("string")
    for group, cuts in BAND_CUTS.items():
        bands = list(zip(cuts[:-1], cuts[1:], BAND_LEVELS))
        level = F.when(F.col("model_group") == group, in_band(value, bands)).otherwise(level)
    return effects.withColumn("level", level)


def plottable(effects: DataFrame) -> DataFrame:
    """Informative estimates without the bias-reduced duplicates."""
    return keep(
        effects,
        [
            F.col("ci_high") < 4,
            is_finite("se_comb"),
            F.col("model_type") != "bias-reduced logistic",
        ],
    )


def highlights(
    coefs: DataFrame, focal: Sequence[str], flipped: Sequence[str] = ("admission_type",)
) -> DataFrame:
    """Linear full-model effects of a few focal variables with intervals.

    Variables in ``flipped`` are reported for the opposite level.
    """
    rows = coefs.filter(
        F.col("focal_var").isin(list(focal))
        & (F.col("formula") == "full")
        & (F.col("model_type") == "lm")
        & F.contains("term", "focal_var")
    )
    estimate = F.when(F.col("focal_var").isin(list(flipped)), -F.col("estimate")).otherwise(
        F.col("estimate")
    )
    rows = rows.withColumn("estimate", estimate)
    low, high = interval("estimate", "se")
    return rows.withColumns({"ci_low": low, "ci_high": high}).orderBy("ci_high")

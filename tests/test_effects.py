"""Focal effects from a literal coefficient table."""

import math

import pytest

from cohortlab.functions.numbers import Z975
from cohortlab.models import effects

SCHEMA = (
    "model_idx string, focal_var string, formula string, model_type string, hurdle_component string, "
    "term_idx int, term string, estimate double, se double"
)


@pytest.fixture()
def coefs(spark):
    return spark.createDataFrame(
        [
            ("1", "dmg", "full", "lm", None, 0, "(Intercept)", 0.1, 0.01),
            ("1", "dmg", "full", "lm", None, 1, "dmg", 0.07, 0.02),
            ("2", "dmg", "interaction", "logistic", None, 1, "dmg", 0.5, 0.3),
            ("2", "dmg", "interaction", "logistic", None, 2, "demographicF.White", 9.0, 9.0),
            ("2", "dmg", "interaction", "logistic", None, 3, "dmg:demographicF.White", 0.2, 0.4),
            ("3", "dmg", "interaction", "hurdle", "count", 1, "dmg", 0.5, 0.3),
            ("3", "dmg", "interaction", "hurdle", "count", 3, "dmg:demographicF.White", 0.2, 0.4),
            ("3", "dmg", "interaction", "hurdle", "zero", 1, "dmg", 1.5, 0.3),
            ("3", "dmg", "interaction", "hurdle", "zero", 3, "dmg:demographicF.White", 0.2, 0.4),
        ],
        SCHEMA,
    )


def by_key(df):
    return {(r["model_idx"], r["hurdle_component"], r["term"]): r for r in df.collect()}


def test_default_combination(coefs):
    out = by_key(effects.focal_effects(coefs))
    assert len(out) == 7
    one = out[("1", None, "combined")]
    assert (one["gender"], one["race"], one["process"]) == ("combined", "combined", "dmg")
    assert one["ci_low"] == pytest.approx(0.07 - Z975 * 0.02)
    base = out[("2", None, "M.White")]
    assert base["estimate_comb"] == 0.5
    assert base["se_comb"] == pytest.approx(math.sqrt(0.18))  # widened like the others
    own = out[("2", None, "F.White")]
    assert (own["gender"], own["race"], own["process"]) == ("F", "White", "dmg")
    assert own["estimate_comb"] == pytest.approx(0.7)
    assert own["se_comb"] == pytest.approx(0.5)
    # the first row of all components is the baseline
    assert out[("3", "zero", "F.White")]["estimate_comb"] == pytest.approx(0.7)


def test_baseline_per_component(coefs):
    out = by_key(effects.focal_effects(coefs, baseline="per_component"))
    assert out[("3", "zero", "F.White")]["estimate_comb"] == pytest.approx(1.7)
    assert out[("3", "count", "F.White")]["estimate_comb"] == pytest.approx(0.7)


def test_exact_standard_error(spark, coefs):
    covs = spark.createDataFrame(
        [("2", None, "dmg:demographicF.White", -0.09)],
        "model_idx string, hurdle_component string, term string, cov_base double",
    )
    out = by_key(effects.focal_effects(coefs, covariances=covs))
    assert out[("2", None, "F.White")]["se_comb"] == pytest.approx(math.sqrt(0.09 + 0.16 - 0.18))
    assert out[("2", None, "M.White")]["se_comb"] == pytest.approx(0.3)


def test_focal_name_as_pattern(spark):
    df = spark.createDataFrame(
        [("1", "a.b", "full", "lm", None, 0, "axb", 1.0, 1.0), ("1", "a.b", "full", "lm", None, 1, "a.b", 1.0, 1.0)], SCHEMA
    )
    assert effects.focal_effects(df).count() == 1
    assert effects.focal_effects(df, regex=True).count() == 2


def test_groups_scale_and_bands(coefs):
    out = effects.with_model_group(effects.focal_effects(coefs))
    out = effects.with_band(effects.back_transformed(out, keep_raw=True))
    got = by_key(out)
    assert got[("1", None, "combined")]["estimate_comb"] == 0.07  # linear stays
    assert got[("1", None, "combined")]["level"] == "strong"
    row = got[("3", "zero", "M.White")]
    assert (row["model_type"], row["model_group"]) == ("hurdle zero", "logistic")
    assert row["estimate_comb"] == pytest.approx(math.exp(1.5) - 1)
    assert row["se_comb"] == pytest.approx(math.exp(row["se_comb_raw"]) - 1)
    assert row["level"] == "strong"


def test_plottable_drops_uninformative(spark):
    df = spark.createDataFrame(
        [(1.0, 0.1, "lm"), (5.0, 0.1, "lm"), (1.0, float("inf"), "lm"), (1.0, None, "lm"), (1.0, 0.1, "bias-reduced logistic")],
        "ci_high double, se_comb double, model_type string",
    )
    assert effects.plottable(df).count() == 1


def test_highlights_flip_and_sort(spark):
    rows = [
        ("1", "admission_type", "full", "lm", None, 1, "admission_typeTransfer", 0.2, 0.01),
        ("2", "poc_share", "full", "lm", None, 1, "poc_share", 0.05, 0.01),
        ("3", "poc_share", "interaction", "lm", None, 1, "poc_share", 0.9, 0.01),
        ("4", "poc_share", "full", "logistic", None, 1, "poc_share", 0.9, 0.01),
    ]
    out = effects.highlights(spark.createDataFrame(rows, SCHEMA), ["admission_type", "poc_share"]).collect()
    assert [(r["focal_var"], r["estimate"]) for r in out] == [("admission_type", -0.2), ("poc_share", 0.05)]

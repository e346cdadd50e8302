"""One test per missing-value rule."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import missing, recode, text
from cohortlab.models.design import build_design, complete_cases, variables_of
from cohortlab.models.spec import ModelSpec
from cohortlab.operators import joins, profiles, summaries
from conftest import rows


@pytest.fixture()
def groups(spark):
    return spark.createDataFrame(
        [("a", 1.0, True), ("a", None, None), ("b", 2.0, False), ("b", 4.0, None), ("c", None, None)],
        "g string, x double, f boolean",
    )


def by_group(df, expr):
    return {r["g"]: r["v"] for r in df.groupBy("g").agg(expr.alias("v")).collect()}


def test_strict_sum_is_null_with_one_gap(groups):
    assert by_group(groups, missing.strict_sum("x")) == {"a": None, "b": 6.0, "c": None}


def test_sum_of_nothing_is_zero(groups):
    assert by_group(groups, missing.sum_or_zero("x")) == {"a": 1.0, "b": 6.0, "c": 0.0}


def test_mean_of_nothing_stays_null(groups):
    assert by_group(groups, F.avg("x"))["c"] is None


def test_strict_mean_inside_plain_mean_outside(groups):
    out = summaries.mean_of_means(groups, "x", ["g"], "m")
    assert rows(out) == [(3.0,)]


def test_ever_is_false_when_unknown(groups):
    assert by_group(groups, missing.any_true("f")) == {"a": True, "b": False, "c": False}


def test_null_is_not_a_member(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "v string")
    assert [r[0] for r in df.select(missing.not_in("v", ["x"])).collect()] == [False, True, True]


def test_choice_keeps_null_condition(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    out = df.select(missing.if_else(F.col("c"), F.lit(1), F.lit(2)))
    assert [r[0] for r in out.collect()] == [1, 2, None]


def test_case_falls_through_null(spark):
    df = spark.createDataFrame([(None,), ("Native",)], "e string")
    out = df.select(F.when(text.mentions("e", "Native"), "yes").otherwise("no"))
    assert [r[0] for r in out.collect()] == ["no", "yes"]


def test_filter_drops_null(spark):
    df = spark.createDataFrame([("M",), (None,), ("N",)], "g string")
    assert rows(df.filter(F.col("g") != "N")) == [("M",)]


def test_null_keys_match_or_not(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, v int")
    assert rows(joins.natural_join(a, b), "i", "v") == [(1, 10), (2, 20)]
    assert rows(joins.natural_join(a, b, na_matches="never"), "i", "v") == [(1, None), (2, 20)]


def test_concat_with_null_is_null(spark):
    df = spark.createDataFrame([("M", None), ("F", "White")], "g string, r string")
    assert [r[0] for r in df.select(recode.cross_label("g", "r")).collect()] == [None, "F.White"]


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None,), (None,), ("x",)], "k string")
    assert rows(summaries.count_by(df, "k")) == [("x", 1), (None, 2)]


def test_null_group_keeps_its_gap(spark):
    df = spark.createDataFrame(
        [(1, "c", "ref", 1.0), (2, "c", None, 3.0), (3, "c", "o", None)],
        "id int, course string, g string, gap double",
    )
    out = summaries.group_gap(df, "gap", ["course"], "g", ["id"], "ref")
    assert rows(out, "g", "dmg") == [("ref", 0.0), (None, 2.0)]


def test_null_counts_as_a_value(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",)], "k string")
    assert rows(df.agg(missing.count_values("k").alias("n"))) == [(2,)]


def test_complete_cases_differ_per_spec(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, None), (2.0, None, 1.0), (None, 1.0, 1.0), (3.0, 2.0, 2.0)], "y double, a double, b double"
    )
    specs = [
        ModelSpec("1", "y", "a", "full", "lm", (("a",),)),
        ModelSpec("2", "y", "b", "full", "lm", (("a",), ("b",))),
    ]
    design = build_design(df, variables_of(df, ["a", "b"]), ["y"])
    assert rows(complete_cases(design, specs), "model_idx", "n_rows") == [("1", 2), ("2", 1)]


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, None, 5.0), (4.0, 8.0, 6.0), (5.0, 10.0, 9.0)],
        "a double, b double, c double",
    )
    out = {(r["Var1"], r["Var2"]): r["cor"] for r in profiles.correlations(df, ["a", "b", "c"]).collect()}
    assert math.isclose(out[("b", "a")], 1.0)
    assert set(out) == {("b", "a"), ("c", "a"), ("c", "b")}


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    assert profiles.correlations(df, ["a", "b"]).head()["cor"] is None


def test_share_of_an_empty_total_is_null(spark):
    df = spark.createDataFrame([("g", 0.0), ("h", 2.0)], "k string, n double")
    assert rows(summaries.share_within(df, "n", ["k"]), "k", "share") == [("g", None), ("h", 1.0)]


def test_trend_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 4.0)], "k string, x double, y double")
    row = summaries.linear_trend(df, "y", "x", ["k"]).head()
    assert row["n"] == 2 and row["slope"] is None and row["r2"] is None

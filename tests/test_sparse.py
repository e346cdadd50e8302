"""Sparse designs and absorbed factors against the dense ones."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlab.models import design, sparse
from cohortlab.models.design import build_design, variables_of
from cohortlab.models.fits import fit_sweep, tidy
from cohortlab.models.spec import ModelSpec
from conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    out = []
    for _ in range(600):
        k = rng.choice(["b", "c", "a", "d", None])
        out.append((k, rng.choice(["u", "v"]), rng.choice([None, 1.5, 2.0, -3.0, 0.0, 7.25]), rng.choice([True, False]), rng.random() * 5, 3.0))
    return spark.createDataFrame(out, "k string, g string, x double, f boolean, y double, same double")


def test_column_sums_and_products_equal_the_dense_design(spark, data):
    terms = [("k",), ("g",), ("x",), ("f",), ("x", "k"), ("k", "g"), ("k", "g", "f")]
    first = {"k": "c", "g": "none such"}
    cells = sparse.sparse_design(data, terms, keep=["y"], first=first)
    dense = build_design(data, variables_of(data, ["k", "g", "x", "f"], first), ["y"])
    columns = dense.columns_for(ModelSpec("1", "y", "k", "full", "lm", tuple(terms)))
    complete = dense.table.dropna()
    assert cells.count() == complete.count()
    sums = {r.label: round(r.total, 6) for r in sparse.column_sums(cells).collect()}
    one = complete.agg(*[F.sum(dense.term(idx)).alias(f"s{i}") for i, (_, idx) in enumerate(columns)]).first()
    expected = {label: round(one[i], 6) for i, (label, _) in enumerate(columns)}
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in expected.items() if v}
    products = {(r.a, r.b): r.total for r in sparse.cross_products(cells).collect()}
    for i, (a, x) in enumerate(columns):
        for b, z in columns[i:]:
            both = complete.agg(F.sum(dense.term(x) * dense.term(z))).first()[0] if (a, b) == ("x", "kd:gv") or a == b == "x" else None
            if both is not None:
                assert products.get(tuple(sorted((a, b))), 0.0) == pytest.approx(both)


def test_absorbed_factor_equals_its_dummies(spark, data):
    coefficients, levels = sparse.fit_absorbed(data, "y", ["x", "same"], "k")
    spec = ModelSpec("1", "y", "x", "full", "lm", (("k",), ("x",)))
    dense = build_design(data, variables_of(data, ["k", "x"]), ["y"])
    plain = {r.term: r for r in tidy(spark, [spec], fit_sweep(dense, [spec])).collect()}
    got = {r.term: r for r in coefficients.collect()}
    # a number that is the same in all rows is spanned by the levels
    assert set(got) == {"x"}
    assert got["x"].estimate == pytest.approx(plain["x"].estimate) and got["x"].se == pytest.approx(plain["x"].se)
    own = {r.k: r for r in levels.collect()}
    assert own["a"].estimate == pytest.approx(plain["(Intercept)"].estimate) and own["a"].se == pytest.approx(plain["(Intercept)"].se)
    for k in "bcd":
        assert own[k].estimate - own["a"].estimate == pytest.approx(plain[f"k{k}"].estimate)
    none = sparse.fit_absorbed(data.where("k = 'nothing'"), "y", ["x"], "k")
    assert none[0].collect() == [] and none[1].collect() == []


def test_a_hundred_thousand_levels(spark):
    n = 300_000
    df = spark.range(n).select(F.concat(F.lit("k"), F.col("id") % 100_000).alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    df = df.withColumn("y", 2 * F.col("x") + F.length("k"))
    sums = sparse.column_sums(sparse.sparse_design(df, [("k",), ("x",)]))
    assert sums.count() == 100_001 and rows(sums.agg(F.min("n").alias("a"), F.sum("n").alias("b"))) == [(3, n + n + n - 3)]
    coefficients, levels = sparse.fit_absorbed(df, "y", ["x"], "k")
    assert coefficients.first().estimate == pytest.approx(2.0) and levels.count() == 100_000
    assert levels.where(F.abs(F.col("estimate") - F.length("k")) > 1e-6).isEmpty()
    with pytest.raises(ValueError, match="levels"):
        design.factor_levels(df, ["k"])

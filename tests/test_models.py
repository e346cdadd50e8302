"""Fits against numpy and MLlib, splits, diagnostics."""

import ast
import math
import os
import subprocess
import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from cohortlab.models import diagnostics
from cohortlab.models import fits as fits_module
from cohortlab.models.design import Variable, build_design, factor_levels, variables_of
from cohortlab.models.diagnostics import area_of, counted
from cohortlab.models.fits import (
    baseline_covariances,
    fit_sweep,
    model_bin_counts,
    model_score_counts,
    score_models,
    tidy,
)
from cohortlab.models.kernels import (
    BiasReduced,
    Block,
    Poisson,
    Positive,
    TruncatedCount,
    independent_columns,
)
from cohortlab.models.spec import ModelSpec, expand, right_hand_side, spec_grid
from cohortlab.models.split import stratified_split
from conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(size=n)
    g = rng.integers(0, 3, size=n)
    eta = -0.7 + 0.8 * x + 0.5 * (g == 1) - 0.4 * (g == 2)
    y = rng.random(n) < 1 / (1 + np.exp(-eta))
    lam = rng.gamma(2.0, np.exp(0.3 + 0.4 * x) / 2.0)
    c = rng.poisson(lam)
    rows_ = [
        (float(x[i]) if i % 50 else None, "abc"[g[i]], bool(y[i]), int(c[i])) for i in range(n)
    ]
    return spark.createDataFrame(rows_, "x double, g string, y boolean, c int").repartition(8).cache()


TERMS = (("x",), ("g",), ("x", "g"))


def spec(outcome, kind, terms=TERMS, idx="1"):
    return ModelSpec(idx, outcome, "x", "full", kind, terms)


def fit_one(df, s, first=None):
    design = build_design(df, variables_of(df, s.variables(), first), [s.outcome])
    return design, fit_sweep(design, [s])[s.model_idx]


def matrix(df, outcome):
    pdf = df.filter("x is not null").toPandas()
    x = pdf.x.to_numpy()
    cols = [np.ones(len(x)), x, pdf.g == "b", pdf.g == "c", x * (pdf.g == "b"), x * (pdf.g == "c")]
    return np.column_stack([np.asarray(c, float) for c in cols]), pdf[outcome].to_numpy().astype(float)


def test_linear_equals_lstsq(data):
    _, fit = fit_one(data, spec("c", "lm"))
    a, y = matrix(data, "c")
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    rss = ((y - a @ beta) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rss / (len(y) - 6))
    got = fit.parts[None].results()
    assert [t for t, _, _ in got] == ["(Intercept)", "x", "gb", "gc", "x:gb", "x:gc"]
    np.testing.assert_allclose([b for _, b, _ in got], beta, rtol=1e-8)
    np.testing.assert_allclose([s for _, _, s in got], se, rtol=1e-8)


@pytest.mark.parametrize("outcome,kind,family", [("y", "logistic", "binomial"), ("c", "Poisson", "poisson")])
def test_glm_equals_mllib(data, outcome, kind, family):
    _, fit = fit_one(data, spec(outcome, kind))
    xb, xc = F.col("x") * (F.col("g") == "b").cast("int"), F.col("x") * (F.col("g") == "c").cast("int")
    df = data.filter("x is not null").select(
        "x",
        (F.col("g") == "b").cast("double").alias("b"),
        (F.col("g") == "c").cast("double").alias("cc"),
        xb.alias("xb"),
        xc.alias("xc"),
        F.col(outcome).cast("double").alias("label"),
    )
    v = VectorAssembler(inputCols=["x", "b", "cc", "xb", "xc"], outputCol="features").transform(df)
    m = GeneralizedLinearRegression(family=family, regParam=0.0, tol=1e-12, maxIter=50).fit(v)
    got = fit.parts[None].results()
    np.testing.assert_allclose([b for _, b, _ in got], [m.intercept, *m.coefficients], rtol=1e-6)
    se = m.summary.coefficientStandardErrors  # intercept last
    np.testing.assert_allclose([s for _, _, s in got], [se[-1], *se[:-1]], rtol=1e-5)


def numpy_firth(a, y):
    beta = np.zeros(a.shape[1])
    for _ in range(200):
        mu = 1 / (1 + np.exp(-a @ beta))
        w = mu * (1 - mu)
        inv = np.linalg.inv((a * w[:, None]).T @ a)
        h = w * np.einsum("ij,jk,ik->i", a, inv, a)
        beta = beta + inv @ (a.T @ (y - mu + h * (0.5 - mu)))
    return beta, np.sqrt(np.diag(inv))


def test_bias_reduced_equals_numpy(data):
    _, fit = fit_one(data, spec("y", "bias-reduced logistic"))
    beta, se = numpy_firth(*matrix(data, "y"))
    got = fit.parts[None].results()
    np.testing.assert_allclose([b for _, b, _ in got], beta, rtol=1e-6)
    np.testing.assert_allclose([s for _, _, s in got], se, rtol=1e-5)


def test_bias_reduced_survives_separation(spark):
    df = spark.createDataFrame([(0.0, False)] * 6 + [(1.0, True)] * 5, "x double, y boolean")
    _, fit = fit_one(df, spec("y", "bias-reduced logistic", (("x",),)))
    got = {t: b for t, b, _ in fit.parts[None].results()}
    assert got["(Intercept)"] == pytest.approx(math.log(0.5 / 6.5), abs=1e-6)
    assert got["x"] == pytest.approx(math.log(5.5 / 0.5) - math.log(0.5 / 6.5), abs=1e-6)


def truncated_loglik(a, y, beta, log_theta):
    th, mu = math.exp(log_theta), np.exp(a @ beta)
    p0 = (th / (th + mu)) ** th
    lg = np.vectorize(math.lgamma)
    return (
        lg(y + th) - math.lgamma(th) - lg(y + 1) + th * np.log(th) + y * np.log(mu) - (y + th) * np.log(th + mu) - np.log(1 - p0)
    ).sum()


def test_hurdle_parts(data):
    design, fit = fit_one(data, spec("c", "hurdle", (("x",),)))
    count, zero = fit.parts["count"], fit.parts["zero"]
    assert count.converged and zero.converged
    a, y = matrix(data, "c")
    a, keep = a[:, :2], y > 0
    b, lt = count.beta, count.log_theta
    best = truncated_loglik(a[keep], y[keep], b, lt)
    for i in range(3):
        for step in (-1e-3, 1e-3):
            d = np.eye(3)[i] * step
            assert truncated_loglik(a[keep], y[keep], b + d[:2], lt + d[2]) < best
    assert np.abs(count.gradient).max() < 1e-3
    assert np.exp(lt) == pytest.approx(2.0, rel=0.3)
    assert [t for t, _, _ in count.results()] == ["(Intercept)", "x", "Log(theta)"]
    # expected count: P(y > 0) times the truncated mean
    th = math.exp(lt)
    got = design.table.select("x0", fit.response(design).alias("m")).filter("x0 is not null").limit(20).collect()
    for r in got:
        mu = math.exp(b[0] + b[1] * r["x0"])
        pi = 1 / (1 + math.exp(-(zero.beta[0] + zero.beta[1] * r["x0"])))
        assert r["m"] == pytest.approx(pi * mu / (1 - (th / (mu + th)) ** th), rel=1e-9)


def test_truncated_derivatives():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=300), rng.poisson(2, size=300).astype(float)
    m = TruncatedCount(["1", "x"], [(), (0,)], "y")
    block = Block([x], {"y": y})
    m.beta, m.log_theta = np.array([0.3, -0.2]), 0.4

    def at(d):
        t = TruncatedCount(["1", "x"], [(), (0,)], "y")
        t.beta, t.log_theta = m.beta + d[:2], m.log_theta + d[2]
        return t.unpack(t.local(block))

    n, value, grad, info = at(np.zeros(3))
    assert n == (y > 0).sum()
    for i in range(3):
        e = np.eye(3)[i] * 1e-5
        (_, up, gu, _), (_, down, gd, _) = at(e), at(-e)
        assert (up - down) / 2e-5 == pytest.approx(grad[i], rel=1e-5)
        np.testing.assert_allclose(-(gu - gd) / 2e-5, info[i], rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("log_theta", [-2.0, 0.4, 5.0])
def test_truncated_likelihood_is_the_textbook_one(log_theta):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=200), rng.poisson(4, size=200).astype(float)
    m = TruncatedCount(["1", "x"], [(), (0,)], "y")
    m.beta, m.log_theta = np.array([0.8, 0.3]), log_theta
    value = m.unpack(m.local(Block([x], {"y": y})))[1]
    a, keep = np.column_stack([np.ones(200), x]), y > 0
    assert value == pytest.approx(truncated_loglik(a[keep], y[keep], m.beta, log_theta), rel=1e-9)


def test_truncated_likelihood_tends_to_the_poisson_one():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=200), rng.poisson(3, size=200).astype(float)
    m = TruncatedCount(["1", "x"], [(), (0,)], "y")
    m.beta = np.array([0.9, 0.2])
    mu, keep = np.exp(m.beta[0] + m.beta[1] * x), y > 0
    lg = np.vectorize(math.lgamma)
    poisson = (y * np.log(mu) - mu - lg(y + 1) - np.log(-np.expm1(-mu)))[keep].sum()
    for log_theta in (20.0, 30.0):
        m.log_theta = log_theta
        assert m.unpack(m.local(Block([x], {"y": y})))[1] == pytest.approx(poisson, rel=1e-7)


def test_counts_without_extra_spread_end_at_the_poisson_boundary(spark):
    # less spread than Poisson counts have: no dispersion fits better than none
    df = spark.createDataFrame([(float(i % 3), [0, 2, 3, 2, 3, 2][i % 6]) for i in range(600)], "x double, c long")
    _, fit = fit_one(df, spec("c", "hurdle", (("x",),)))
    count = fit.parts["count"]
    assert count.status == "Poisson boundary" and count.converged
    assert math.isnan(count.results()[-1][2])
    assert fit.parts["zero"].status == "converged"


def test_factor_of_many_levels(spark):
    df = spark.range(1400).select(F.concat(F.lit("v"), F.col("id") % 700).alias("a"), F.concat(F.lit("w"), F.col("id") % 2).alias("b"))
    out = factor_levels(df, ["a", "b"], {"b": "w1"})
    assert len(out["a"]) == 700 and out["b"] == ("w1", "w0")


def test_models_take_turns_when_their_sums_are_many(spark, data, monkeypatch):
    specs = [spec("y", "logistic", (("x",),), "1"), spec("y", "lm", (("x",), ("g",)), "2")]
    design = build_design(data, variables_of(data, ["x", "g"]), ["y"])
    together = {k: f.parts[None].beta for k, f in fit_sweep(design, specs).items()}
    monkeypatch.setattr(fits_module, "ROUND_SUMS", 5)
    for k, f in fit_sweep(design, specs).items():
        np.testing.assert_allclose(f.parts[None].beta, together[k], rtol=1e-9)


def test_counts_of_scores_and_bins_per_model(spark, data):
    specs = [spec("c", "Poisson", (("x",),), "1"), spec("c", "hurdle", (("x",),), "2"), spec("c", "Poisson", (("x",),), "3")]
    design = build_design(data, variables_of(data, ["x"]), ["c"])
    fits = fit_sweep(design, specs)
    plain = score_models(design, specs, fits, "c", response=True).withColumn("bin", F.ceil(F.col("score") - 0.5))
    # the rows without an outcome have a fitted value too
    known = replace(design, table=design.table.filter("y_c is not null"))
    got = model_bin_counts(known, specs, fits, "c")
    assert rows(got, "model_idx", "bin", "fitted") == rows(plain.groupBy("model_idx", "bin").agg(F.count("*").alias("n")), "model_idx", "bin", "n")
    whole = model_bin_counts(design, specs, fits, "c").groupBy("model_idx").agg(F.sum("fitted").alias("n")).collect()
    assert {r["n"] for r in whole} == {design.table.filter("x0 is not null").count()}


def test_scores_are_counted_per_distinct_value(spark, data):
    specs = [spec("y", "logistic", (("g",),), "1"), spec("y", "lm", (("g",),), "2")]
    design = build_design(data, variables_of(data, ["g"]), ["y"])
    fits = fit_sweep(design, specs)
    plain = score_models(design, specs, fits, "y").groupBy("model_idx", F.col("score").alias("threshold")).agg(
        F.count_if(F.col("y") > 0.5).alias("pos"), F.count_if(F.col("y") <= 0.5).alias("neg")
    )
    names = ["model_idx", "threshold", "pos", "neg"]
    assert rows(model_score_counts(design, specs, fits, "y"), *names) == rows(plain, *names)


def test_aliased_columns_are_left_out(spark, data):
    df = data.withColumns({"twice": F.col("x") * 2, "k": F.lit(1.0)})
    _, fit = fit_one(df, spec("c", "lm", (("x",), ("twice",), ("k",), ("g",))))
    assert [t for t, _, _ in fit.parts[None].results()] == ["(Intercept)", "x", "gb", "gc"]


def test_split_keys_that_look_alike(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("a|b", "c"), ("a", "b|c"), ("1:a", ""), ("1", "a")], "a string, b string")
    out = stratified_split(df.withColumn("s", F.lit(1)), ["s"], ["a", "b"], 0.5)
    assert out.filter("is_test").count() == 3
    with pytest.raises(ValueError):
        stratified_split(df.union(df).withColumn("s", F.lit(1)), ["s"], ["a", "b"], 0.5)


def test_unknown_group_has_a_whole_curve(spark):
    df = spark.createDataFrame([(g, s, s > 2) for g in ("a", None) for s in (1.0, 2.0, 3.0, 4.0)], "g string, s double, y boolean")
    curve = diagnostics.roc_curve(df, "s", "y", ["g"])
    assert rows(curve.groupBy("g").count()) == [("a", 6), (None, 6)]
    assert rows(diagnostics.roc_auc(df, "s", "y", ["g"])) == [("a", 1.0), (None, 1.0)]


def test_independent_columns():
    a = np.array([[1, 0, 1], [1, 1, 2], [1, 2, 3], [1, 3, 4]], float)
    assert independent_columns(a.T @ a) == [0, 1]


def test_reference_level_is_pinned(data):
    _, fit = fit_one(data, spec("c", "lm", (("g",),)), {"g": "c"})
    assert [t for t, _, _ in fit.parts[None].results()] == ["(Intercept)", "ga", "gb"]


def test_equal_formulas_share_a_fit(data):
    specs = [spec("y", "logistic", (("x",),), "1"), spec("y", "logistic", (("x",),), "2"), spec("y", "lm", (("x",),), "3")]
    design = build_design(data, variables_of(data, ["x"]), ["y"])
    fits = fit_sweep(design, specs)
    assert fits["1"] is fits["2"] and fits["3"] is not fits["1"]
    out = tidy(data.sparkSession, specs, fits)
    assert out.count() == 6 and out.filter("model_idx = '2'").count() == 2


def test_unknown_model_type(data):
    design = build_design(data, {"x": Variable("x", "number")}, ["y"])
    with pytest.raises(ValueError):
        fit_sweep(design, [spec("y", "probit", (("x",),))])


def test_baseline_covariances(data):
    s = ModelSpec("1", "c", "x", "interaction", "lm", (("x",), ("g",), ("x", "g")))
    design = build_design(data, variables_of(data, ["x", "g"]), ["c"])
    fits = fit_sweep(design, [s])
    out = {r["term"]: r["cov_base"] for r in baseline_covariances(data.sparkSession, [s], fits, group="g").collect()}
    assert set(out) == {"x:gb", "x:gc"}
    assert all(v < 0 for v in out.values())


def test_spec_grid():
    specs = spec_grid(
        {"class": [["a"]], "n": [["class"], ["b"]]},
        ["year"],
        {"class": ["low", "first"]},
        {"y": ["lm"], "c": ["Poisson"]},
        {"c": ["y"]},
        {"n": "peers"},
    )
    # class stands for two focal variables that share their terms
    assert len(specs) == 2 * (2 * 2 + 2 * 2)
    assert len({s.formula for s in specs}) == 2 * (2 + 2 * 2)
    one = next(s for s in specs if s.focal_var == "low" and s.outcome == "c" and s.form == "interaction")
    assert one.terms == (("a",), ("year",), ("low",), ("first",), ("demographic",), ("y",), ("low", "demographic"), ("first", "demographic"))
    assert {s.covar_group for s in specs if s.focal_var == "n"} == {"peers"}
    assert expand(["class", "z"], {"class": ["low", "first"]}) == ["low", "first", "z"]
    assert right_hand_side(["a"], [], ["a"], False) == (("a",),)


def test_split_is_exact_in_a_hot_stratum(spark):
    df = spark.range(5003).select("id", F.when(F.col("id") < 5000, "hot").when(F.col("id") < 5002, None).otherwise("one").alias("s"))
    out = stratified_split(df, ["s"], ["id"], 0.25)
    got = {r["s"]: (r["n"], r["k"]) for r in out.groupBy("s").agg(F.count("*").alias("n"), F.count_if("is_test").alias("k")).collect()}
    # half-even rounding: 0.25 * 2 = 0.5 -> 0
    assert got == {"hot": (5000, 1250), None: (2, 0), "one": (1, 0)}
    again = stratified_split(df.repartition(3), ["s"], ["id"], 0.25)
    assert rows(again) == rows(out)
    other = stratified_split(df, ["s"], ["id"], 0.25, seed=1)
    assert rows(other) != rows(out)


def brute_roc(scores, truth):
    out = []
    pos, neg = sum(truth), len(truth) - sum(truth)
    for t in [-math.inf, *sorted(set(scores)), math.inf]:
        tp = sum(1 for s, y in zip(scores, truth) if y and s >= t)
        tn = sum(1 for s, y in zip(scores, truth) if not y and s < t)
        out.append((t, tn / neg, tp / pos))
    return out


def test_roc_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    truth = rng.random(400) < 0.3
    scores = np.round(rng.normal(size=400) + truth, 1)
    df = spark.createDataFrame([(float(s), bool(t)) for s, t in zip(scores, truth)], "s double, y boolean")
    got = sorted(tuple(r) for r in diagnostics.roc_curve(df, "s", "y").collect())
    assert got == [pytest.approx(r) for r in brute_roc(list(scores), list(truth))]
    wins = sum((p > q) + 0.5 * (p == q) for p in scores[truth] for q in scores[~truth])
    auc = diagnostics.roc_auc(df, "s", "y").head()["auc"]
    assert auc == pytest.approx(wins / (truth.sum() * (~truth).sum()))


def test_rootogram_dispatch(spark):
    df = spark.createDataFrame([(0, 0.4), (1, 0.5), (2, 1.6)], "c int, f double")
    out = diagnostics.rootogram(df, "c", "f", {"c": "count"})
    assert rows(out, "bin", "observed", "fitted") == [(0, 1, 2), (1, 1, 0), (2, 1, 1)]
    flags = spark.createDataFrame([(True, 0.5), (False, 0.6)], "y boolean, f double")
    out = diagnostics.rootogram(flags, "y", "f", {"y": "binary"}, threshold=0.5)
    assert rows(out, "bin", "observed", "fitted") == [(False, 1, 1), (True, 1, 1)]
    with pytest.raises(ValueError):
        diagnostics.rootogram(df, "z", "f", {"c": "count"})


def settle(model, x, y):
    """All rounds of one model over a block, and the sums that travelled."""
    sizes = []
    while not model.done:
        total = model.local(Block(x, {"y": y}))
        sizes.append(len(total))
        model.advance(total)
    return sizes


def test_bias_reduced_steps_need_one_scan_and_no_cubes():
    """Ten columns settle in a few scans of squares, at the zero of the adjusted score."""
    rng = np.random.default_rng(5)
    x = [rng.normal(size=500) for _ in range(9)]
    y = (rng.random(500) < 0.3).astype(float)
    m = BiasReduced([str(i) for i in range(10)], [(), *[(i,) for i in range(9)]], "y")
    sizes = settle(m, x, y)
    assert m.converged and len(sizes) <= 12 and max(sizes) == 2 + 10 + 100
    a = np.vstack([np.ones(500), *x])
    mu = 1 / (1 + np.exp(-m.beta @ a))
    w = mu * (1 - mu)
    inverse = np.linalg.inv((a * w) @ a.T)
    adjusted = a @ (y - mu + w * ((inverse @ a) * a).sum(axis=0) * (0.5 - mu))
    assert np.abs(inverse @ adjusted / np.sqrt(np.diag(inverse))).max() < 1e-6


@pytest.mark.parametrize("width", [2, 8])
def test_bias_reduced_goes_on_with_exact_leverages(width):
    """A separated group: steps with the leverages of the round before don't settle."""
    rng = np.random.default_rng(6)
    x = [(np.arange(40) < 3).astype(float), *[rng.normal(size=40) for _ in range(width - 2)]]
    y = np.where(np.arange(40) < 3, 1.0, (rng.random(40) < 0.2).astype(float))
    m = BiasReduced([str(i) for i in range(width)], [(), *[(i,) for i in range(width - 1)]], "y")
    settle(m, x, y)
    assert m.converged
    a = np.vstack([np.ones(40), *x])
    mu = 1 / (1 + np.exp(-m.beta @ a))
    w = mu * (1 - mu)
    inverse = np.linalg.inv((a * w) @ a.T)
    adjusted = a @ (y - mu + w * ((inverse @ a) * a).sum(axis=0) * (0.5 - mu))
    assert np.abs(inverse @ adjusted / np.sqrt(np.diag(inverse))).max() < 1e-5


def test_counts_are_tabled_alike():
    y = np.array([1.0, 3.0, 3.0, 7.0])
    for some in (y, y + 0.5, y + 5000, y[:0]):
        counts, back, factorials = TruncatedCount.tabled(some)
        assert (np.asarray(counts)[back] == some).all()
        assert factorials[back] == pytest.approx([math.lgamma(v + 1) for v in some], rel=1e-12)


def test_a_grid_is_reported_when_asked_for(spark, monkeypatch):
    """Effects don't wait for the counts of scores."""
    from cohortlab.plans import regressions

    df = spark.createDataFrame(
        [(i, i, i % 3 == 0, i % 4, "M.White" if i % 2 else "F.White", float(i % 7)) for i in range(400)],
        "id int, course_id int, ever_phil boolean, n_later_phil int, demographic string, dmg double",
    )
    specs = [ModelSpec("1", "ever_phil", "dmg", "full", "logistic", (("dmg",),)), ModelSpec("2", "n_later_phil", "dmg", "full", "Poisson", (("dmg",),))]
    asked = []
    real = regressions.model_score_counts
    monkeypatch.setattr(regressions, "model_score_counts", lambda *a: asked.append(1) or real(*a))
    out = regressions.run(df, specs)
    assert out["estimates"].count() == 2 and out["rootograms"].count() > 0 and asked == []
    assert out["auc"].count() == 1 and out["roc"].count() > 2 and asked == [1]


def test_rows_of_a_block_are_the_complete_ones():
    """Holes, numbers too large for products, and outcomes that leave rows out, against plain sums."""
    rng = np.random.default_rng(8)
    x = [rng.normal(size=60) for _ in range(4)]
    x[1][::7], x[2][3], x[3][5] = np.nan, np.inf, 1e200
    y = rng.integers(0, 4, 60).astype(float)
    y[::11] = np.nan
    block = Block(x, {"y": y})
    for columns in [((), (0,)), ((), (0,), (1,)), ((2,), (0, 1)), ((3,), (3, 3)), ((0, 1, 2), (0,)), ((0,), (0, 0, 0, 0))]:
        a = np.array([np.prod([x[i] for i in idx], axis=0) if idx else np.ones(60) for idx in columns])
        for kind in (Poisson, Positive, TruncatedCount):
            with np.errstate(all="ignore"):
                seen = kind.outcome(y)
                ok = np.isfinite(a.sum(axis=0)) & np.isfinite(seen)
                design, values, _ = block.rows(columns, "y", kind.outcome)
                whole, known = block.design(columns)
            np.testing.assert_array_equal(design, a[:, ok])
            np.testing.assert_array_equal(values, seen[ok])
            np.testing.assert_array_equal(known, np.isfinite(a.sum(axis=0)))
            np.testing.assert_array_equal(whole, a)


def test_a_block_does_not_hold_the_designs_of_all_models():
    """Rows of a block are shared between models of one design and go after them."""
    rng = np.random.default_rng(4)
    x, y = [rng.normal(size=50) for _ in range(30)], rng.integers(0, 3, 50).astype(float)
    block = Block(x, {"y": y})
    models = [kind(["1", "x"], [(), (i,)], "y") for i in range(30) for kind in (Poisson, Positive)]
    made = [m.rows(block)[0] for m in models]
    assert all(made[k] is made[k + 1] for k in range(0, 60, 2))
    assert len(block.built) < 10


@pytest.mark.parametrize("part, cuts", [(1 << 21, 20_000), (40, 150), (3, 400)])
def test_areas_of_packed_scores(spark, data, monkeypatch, part, cuts):
    specs = [spec("y", "logistic", (("g",),), "1"), spec("y", "lm", (("x",), ("g",)), "2"), spec("y", "lm", (("x",), ("g",)), "3")]
    design = build_design(data, variables_of(data, ["x", "g"]), ["y"])
    design = replace(design, table=design.table.repartition(3))
    fits = fit_sweep(design, specs)
    plain = area_of(counted(model_score_counts(design, specs, fits, "y"), ["model_idx"]), ["model_idx"]).collect()
    monkeypatch.setattr(fits_module, "PART_ROWS", part)
    monkeypatch.setattr(fits_module, "CUT_ROWS", cuts)
    monkeypatch.setattr(fits_module, "CHUNK_ROWS", 50)
    got = fits_module.model_areas(design, specs, fits, "y").collect()
    assert {r["model_idx"]: r["auc"] for r in got} == pytest.approx({r["model_idx"]: r["auc"] for r in plain}, rel=1e-12)
    assert len(got) == 3


def test_areas_store_no_row_for_a_score(spark, data, monkeypatch):
    from cohortlab.plans import regressions

    df = data.select(F.monotonically_increasing_id().alias("id"), F.lit(1).alias("course_id"), F.col("y").alias("ever_phil"), "x", F.col("g").alias("demographic"))
    out = regressions.run(df, [spec("ever_phil", "lm", (("x",),), "1")])
    asked = []
    real = regressions.counted
    monkeypatch.setattr(regressions, "counted", lambda *a: asked.append(1) or real(*a))
    area = out["auc"].collect()
    assert asked == []
    whole = area_of(out["score_counts"], ["model_idx"]).collect()
    assert asked == [1] and area[0]["auc"] == pytest.approx(whole[0]["auc"], rel=1e-12)


def test_areas_with_one_class_or_no_rows(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)], "x double, y double")
    specs = [spec("y", "lm", (("x",),), "1")]
    design = build_design(df, variables_of(df, ["x"]), ["y"])
    fits = fit_sweep(design, specs)
    assert [r["auc"] for r in fits_module.model_areas(design, specs, fits, "y").collect()] == [None]
    none = replace(design, table=design.table.filter("x0 < 0"))
    assert fits_module.model_areas(none, specs, fits, "y").count() == 0


def test_kernels_travel_by_value(tmp_path):
    """A worker that cannot import the package gets all that the models need."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=40), rng.integers(0, 3, 40).astype(float)
    models = [kind(["1", "x"], [(), (0,)], "y") for kind in fits_module.FITTERS["hurdle"].values()]
    for m in models:
        for _ in range(2):
            m.advance(m.local(Block([x], {"y": y})))
    code = "import sys; from pyspark import cloudpickle; f, a = cloudpickle.loads(sys.stdin.buffer.read()); print(repr([v.tolist() for v in f(*a)]))"

    def sums(block, some, x, y):
        return [m.local(block([x], {"y": y})) for m in some]

    sent = cloudpickle.dumps((sums, (Block, models, x, y)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=sent, cwd=tmp_path, env=env, capture_output=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    got = ast.literal_eval(done.stdout.decode())
    for a, b in zip(got, sums(Block, models, x, y)):
        np.testing.assert_allclose(a, b, rtol=1e-9)

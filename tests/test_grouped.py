"""One formula in every group: equal to the sweep over each group's rows alone."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.models import grouped
from cohortlab.models.design import build_design, variables_of
from cohortlab.models.fits import fit_sweep, tidy
from cohortlab.models.spec import ModelSpec


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for group, n in (("big", 900), ("small", 60), (None, 80), ("one level", 50)):
        for _ in range(n):
            x, level = round(float(rng.normal()), 1), "a" if group == "one level" else str(rng.choice(["a", "b", "c"]))
            eta = 0.4 * x + (level == "b") * 0.7 - 0.2
            count = int(rng.poisson(math.exp(eta)))
            out.append((group, 1, None if rng.random() < 0.05 else x, level, bool(rng.random() < 1 / (1 + math.exp(-eta))), count, eta + float(rng.normal())))
    # no complete row at all
    out.append(("empty", 1, None, "a", True, 1, 0.0))
    df = spark.createDataFrame(out, "g string, h int, x double, level string, y boolean, n long, z double")
    return grouped.staged(df, "rows")


@pytest.mark.parametrize("kind, outcome", [("lm", "z"), ("logistic", "y"), ("bias-reduced logistic", "y"), ("Poisson", "n"), ("hurdle", "n")])
def test_groups_equal_their_own_sweeps(spark, rows, kind, outcome):
    spec = ModelSpec("1", outcome, "x", "full", kind, (("x",), ("level",)))
    variables = variables_of(rows, ["x", "level"])
    got = {}
    for r in grouped.fit_groups(rows, ["g", "h"], spec, variables, block=64).collect():
        got[r.g, r.h, r.hurdle_component, r.term] = (r.estimate, r.se, r.n_rows, r.converged)
    expected = {}
    for g in ("big", "small", None, "one level"):
        design = build_design(rows.where(F.col("g").eqNullSafe(g)), variables, [outcome])
        for r in tidy(spark, [spec], fit_sweep(design, [spec])).collect():
            expected[g, 1, r.hurdle_component, r.term] = (r.estimate, r.se, r.n_rows, r.converged)
    assert set(got) == set(expected)
    for key, (estimate, se, n, converged) in expected.items():
        assert got[key][2:] == (n, converged), key
        assert got[key][0] == pytest.approx(estimate, abs=2e-5, rel=1e-5), key
        if math.isfinite(se):
            assert got[key][1] == pytest.approx(se, rel=1e-4), key


def test_a_group_of_a_third_of_all_rows_is_many_blocks(spark):
    hot = spark.range(6000).select(F.lit("hot").alias("g"), (F.col("id") % 3000).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    same = spark.range(6000).select(F.lit("same").alias("g"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    many = spark.range(6000).select((F.col("id") % 500).cast("string").alias("g"), F.col("id").cast("double").alias("x"), F.lit(0.5).alias("y"))
    blocks, groups = grouped.pack(hot.union(same).union(many), ["g"], ["x"], "y", block=200)
    sizes = blocks.select("__group", F.size("cells").alias("n")).groupBy("__group").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    sizes = {r["__group"]: (r.most, r["all"]) for r in sizes.collect()}
    assert sizes['{"g":"same"}'] == (1, 1)
    assert sizes['{"g":"hot"}'][1] == 3000 and sizes['{"g":"hot"}'][0] < 400
    assert groups.count() == 502


def test_blocks_are_not_dealt_again(spark, rows, monkeypatch):
    plans = []
    real = grouped.staged

    def spy(df, name):
        plans.append((name, df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")))
        return real(df, name)

    monkeypatch.setattr(grouped, "staged", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spec = ModelSpec("1", "z", "x", "full", "lm", (("x",),))
        assert grouped.fit_groups(rows, ["g"], spec, block=32).count() == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rounds = [plan for name, plan in plans if name == "states" and "cells" in plan]
    assert rounds
    for plan in rounds:
        # the scan of the blocks reaches its join without an exchange
        scan = next(i for i, line in enumerate(plan.splitlines()) if "cells" in line and "FileScan" in line)
        above = [line for line in plan.splitlines()[:scan]]
        join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in above[join + 1 :]), plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cohortlab_")]


def test_intercept_alone_and_unknown_kind(spark, rows):
    spec = ModelSpec("1", "z", "x", "full", "lm", ())
    means = {r.g: r.estimate for r in grouped.fit_groups(rows, ["g"], spec).collect()}
    plain = {r.g: r.m for r in rows.groupBy("g").agg(F.avg("z").alias("m")).collect()}
    assert means == pytest.approx(plain) or {k: round(v, 9) for k, v in means.items()} == {k: round(v, 9) for k, v in plain.items()}
    with pytest.raises(ValueError):
        grouped.fit_groups(rows, ["g"], ModelSpec("1", "z", "x", "full", "probit", ()))


def test_a_sweep_equals_each_of_its_fits(spark, rows):
    specs = [
        ModelSpec("1", "z", "x", "full", "lm", (("x",),)),
        ModelSpec("2", "n", "x", "full", "hurdle", (("level",),)),
        ModelSpec("3", "z", "level", "full", "lm", (("x",),)),
        ModelSpec("4", "z", "level", "full", "lm", (("level",),)),
    ]
    variables = variables_of(rows, ["x", "level"])
    key = lambda r: (r.g, r.hurdle_component, r.term, round(r.estimate, 9), r.n_rows)
    got = {}
    for r in grouped.sweep_groups(rows, ["g"], specs, variables, block=100).collect():
        got.setdefault(r.model_idx, []).append(key(r))
    assert sorted(got["1"], key=repr) == sorted(got["3"], key=repr)
    for s in specs[1:]:
        alone = [key(r) for r in grouped.fit_groups(rows, ["g"], s, variables, block=100).collect()]
        assert sorted(got[s.model_idx], key=repr) == sorted(alone, key=repr)
    # a row without x counts in the models that don't ask for it
    assert max(r[4] for r in got["4"]) > max(r[4] for r in got["1"])


def test_weighted_rows_take_few_calls():
    """Rows of many small weights are repeated in one part, a heavy one is multiplied."""
    x, w = np.arange(41.0).reshape(-1, 1), np.array([float(1 + i % 20) for i in range(40)] + [1e6])
    parts = grouped.parts_of(x, 2 * x, w)
    assert len(parts) == 2 and sum(len(a) for _, (a, _) in parts) == 2 * 210 + 1
    for f in (lambda a: a, np.square):
        assert sum(t * f(a).sum() for t, (a, _) in parts) == (f(x[:, 0]) * w).sum()
    assert all((b == 2 * a).all() for _, (a, b) in parts)
    assert grouped.parts_of(x[:0], x[:0], w[:0]) == []

"""Splits, designs, fits, diagnostics and effects."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import functions as F

from cohortlab.catalog.registry import curated, folder_state, query, rnd, rounded, table
from cohortlab.models.design import build_design, complete_cases, variables_of
from cohortlab.models.diagnostics import (
    binary_rootogram,
    count_rootogram,
    roc_auc,
    roc_curve,
    threshold_sensitivity,
)
from cohortlab.models.grouped import fit_groups, sweep_groups
from cohortlab.models.effects import (
    back_transformed,
    focal_effects,
    highlights,
    plottable,
    with_band,
    with_model_group,
)
from cohortlab.models.fits import baseline_covariances, fit_sweep, fitted_sums
from cohortlab.models.sparse import column_sums, cross_products, fit_absorbed, sparse_design
from cohortlab.models.spec import ModelSpec, right_hand_side, spec_table
from cohortlab.models.split import stratified_split
from cohortlab.plans import dag
from cohortlab.plans.regressions import (
    COVAR_GROUPS,
    FIRST_LEVELS,
    HIGHLIGHTS,
    TEST_SHARE,
    coefficients,
    grid_design,
    model_grid,
    report,
    roc_scores,
    run,
)
from cohortlab.session import staged

SEED = 2003


def _modelled(spark, d):
    """The modelled rows, stored once: every fit scans them several times."""
    return _modelled_as_of(spark, d, folder_state(spark, d))


@lru_cache(maxsize=4)
def _modelled_as_of(spark, d, state):
    names = sorted({v for s in model_grid({f: [dag.FOCAL] for f in dag.FOCAL}) for v in s.variables()})
    keep = ["id", "course_id", "ever_phil", "n_later_phil", "mean_grade", "other_major_share", "other_major_student"]
    df = curated(spark, d)["modelled"]
    return staged(df.select(*dict.fromkeys([*keep, "demographic", *names])), "modelled", packed=True)


def _spec(idx, outcome, kind, focal, form, controls=(), general=()):
    terms = right_hand_side(controls, general, [focal], form == "interaction")
    return ModelSpec(str(idx), outcome, focal, form, kind, terms, COVAR_GROUPS.get(focal))


def _fit(df, specs):
    design = grid_design(df, specs)
    fits = fit_sweep(design, specs)
    return design, fits, coefficients(df, specs, fits)


# ---- split and design ----------------------------------------------------


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _key(*parts) -> str:
    """SQL of the key text: every part with its length."""
    texts = [f"({p}::BIGINT)::VARCHAR" if str(p) == "l_quantity" else f"({p})::VARCHAR" for p in parts]
    return " || ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in texts)


@query(
    "stratified_split",
    f"""SELECT id, course_id, place <= round_even(n * {TEST_SHARE}, 0) AS is_test FROM (SELECT id, course_id,
        row_number() OVER (PARTITION BY ever_phil, demographic ORDER BY md5({_key('id', 'course_id', SEED)})) AS place,
        count(*) OVER (PARTITION BY ever_phil, demographic) AS n FROM modelled)""",
    curated=True,
)
def split_rows(spark, d):
    df = _modelled(spark, d).select("id", "course_id", "ever_phil", "demographic")
    out = stratified_split(df, ["ever_phil", "demographic"], ["id", "course_id"], TEST_SHARE, SEED)
    return out.select("id", "course_id", "is_test")


@query(
    "stratified_split_lines",
    f"""SELECT l_orderkey, l_linenumber, place <= round_even(n * 0.1, 0) AS is_test FROM (SELECT l_orderkey, l_linenumber,
        row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY md5({_key(*LINE_KEY, 7)})) AS place,
        count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem)""",
)
def split_lines(spark, d):
    df = table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long"))
    out = stratified_split(df, ["l_returnflag", "l_linestatus"], LINE_KEY, 0.1, 7)
    return out.select("l_orderkey", "l_linenumber", "is_test")


@query(
    "stratified_split_unknown",
    f"""SELECT l_orderkey, l_linenumber, place <= round_even(n * 0.25, 0) AS is_test FROM (SELECT l_orderkey, l_linenumber,
        row_number() OVER (PARTITION BY flag ORDER BY md5({_key("x", "y", *LINE_KEY[:3], "l_quantity", 7)})) AS place,
        count(*) OVER (PARTITION BY flag) AS n FROM (SELECT * REPLACE (l_quantity::BIGINT AS l_quantity), nullif(l_returnflag, 'A') AS flag,
        CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS x, CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey END AS y FROM lineitem))""",
)
def split_unknown(spark, d):
    even = F.col("l_suppkey") % 2 == 0
    df = table(spark, d, "lineitem").select(
        *LINE_KEY[:3],
        F.col("l_quantity").cast("long").alias("l_quantity"),
        F.nullif("l_returnflag", F.lit("A")).alias("flag"),
        F.when(even, F.col("l_suppkey")).alias("x"),
        F.when(~even, F.col("l_suppkey")).alias("y"),
    )
    out = stratified_split(df, ["flag"], ["x", "y", *LINE_KEY[:3], "l_quantity"], 0.25, 7)
    return out.select("l_orderkey", "l_linenumber", "is_test")


GROUPS = ["F.White", "F.Asian", "F.BHIP", "M.Asian", "M.BHIP"]


@query(
    "design_column_sums",
    "SELECT '(Intercept)' AS label, count(*)::DOUBLE AS total FROM modelled UNION ALL "
    "SELECT 'grade_diff', round(sum(grade_diff), 4) + 0.0 FROM modelled UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT 'demographic{g}', sum((demographic = '{g}')::INT)::DOUBLE FROM modelled UNION ALL
            SELECT 'grade_diff:demographic{g}', round(sum(grade_diff * (demographic = '{g}')::INT), 4) + 0.0 FROM modelled"""
        for g in GROUPS
    ),
    curated=True,
)
def design_column_sums(spark, d):
    df = curated(spark, d)["modelled"].select("grade_diff", "demographic", "ever_phil")
    spec = _spec(1, "ever_phil", "lm", "grade_diff", "interaction")
    design = build_design(df, variables_of(df, spec.variables(), FIRST_LEVELS), ["ever_phil"])
    columns = design.columns_for(spec)
    cells = [
        F.struct(F.lit(label).alias("label"), rnd(F.sum(design.term(idx)), 4).alias("total"))
        for label, idx in columns
    ]
    return design.table.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query(
    "spec_complete_cases",
    """SELECT '1' AS model_idx, 3 AS n_columns, count(*) FILTER (WHERE x IS NOT NULL) AS n_rows FROM (SELECT nullif(l_linenumber, 7) AS x, l_returnflag AS f, nullif(l_quantity, 13) AS q FROM lineitem)
       UNION ALL SELECT '2', 4, count(*) FILTER (WHERE x IS NOT NULL AND q IS NOT NULL) FROM (SELECT nullif(l_linenumber, 7) AS x, nullif(l_quantity, 13) AS q FROM lineitem)
       UNION ALL SELECT '3', 6, count(*) FILTER (WHERE x IS NOT NULL AND q IS NOT NULL) FROM (SELECT nullif(l_linenumber, 7) AS x, nullif(l_quantity, 13) AS q FROM lineitem)""",
)
def spec_complete_cases(spark, d):
    df = table(spark, d, "lineitem").select(
        F.nullif(F.col("l_linenumber"), F.lit(7)).alias("x"),
        F.col("l_returnflag").alias("demographic"),
        F.nullif(F.col("l_quantity"), F.lit(13.0)).alias("q"),
    )
    specs = [
        ModelSpec("1", "x", "demographic", "full", "lm", (("demographic",),)),
        ModelSpec("2", "x", "q", "full", "lm", (("demographic",), ("q",))),
        ModelSpec("3", "x", "q", "interaction", "lm", (("demographic",), ("q",), ("q", "demographic"))),
    ]
    return complete_cases(build_design(df, variables_of(df, ["demographic", "q"]), ["x"]), specs)


# ---- fits with closed forms ----------------------------------------------


@query(
    "linear_one_regressor",
    """WITH t AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_count(y, x) AS n, regr_sxx(y, x) AS sxx,
         regr_syy(y, x) - regr_slope(y, x) ** 2 * regr_sxx(y, x) AS rss, avg(x) AS mx
         FROM (SELECT l_discount * 100 AS y, l_quantity AS x FROM lineitem))
       SELECT '(Intercept)' AS term, round(a, 6) AS estimate, round(sqrt(rss / (n - 2) * (1 / n + mx ** 2 / sxx)), 6) AS se, n AS n_rows FROM t
       UNION ALL SELECT 'x', round(b, 6) + 0.0, round(sqrt(rss / (n - 2) / sxx), 6), n FROM t""",
)
def linear_one_regressor(spark, d):
    df = table(spark, d, "lineitem").select(
        (F.col("l_discount") * 100).alias("y"), F.col("l_quantity").alias("x")
    )
    specs = [ModelSpec("1", "y", "x", "full", "lm", (("x",),))]
    return rounded(_fit(df, specs)[2].select("term", "estimate", "se", "n_rows"), "estimate", "se")


# group-wise lines: the interaction model with one regressor splits into them
LINES = """, g AS (SELECT demographic AS term, regr_slope(ever_phil::INT, grade_diff) AS b, regr_sxx(ever_phil::INT, grade_diff) AS sxx,
      regr_syy(ever_phil::INT, grade_diff) - regr_slope(ever_phil::INT, grade_diff) ** 2 * regr_sxx(ever_phil::INT, grade_diff) AS rss,
      count(*) AS n FROM modelled GROUP BY 1),
    v AS (SELECT sum(rss) / (sum(n) - 2 * count(*)) AS s2 FROM g),
    r AS (SELECT b AS b0, sxx AS sxx0 FROM g WHERE term = 'M.White'),
    e AS (SELECT term, b, sxx, sxx0, s2, b AS estimate_comb,
      CASE WHEN term = 'M.White' THEN sqrt(2 * s2 / sxx0) ELSE sqrt(s2 / sxx + 2 * s2 / sxx0) END AS se_comb FROM g, v, r)
"""


def _interaction(spark, d):
    df = _modelled(spark, d)
    specs = [_spec(1, "ever_phil", "lm", "grade_diff", "interaction")]
    _, fits, coefs = _fit(df, specs)
    return specs, fits, coefs


@query(
    "interaction_effects",
    "WITH one AS (SELECT 1)"
    + LINES
    + """SELECT term, split_part(term, '.', 1) AS gender, split_part(term, '.', 2) AS race, 'grade_diff' AS process,
        round(estimate_comb, 6) + 0.0 AS estimate_comb, round(se_comb, 6) AS se_comb,
        round(estimate_comb - 1.959963984540054 * se_comb, 6) + 0.0 AS ci_low, round(estimate_comb + 1.959963984540054 * se_comb, 6) + 0.0 AS ci_high FROM e""",
    curated=True,
)
def interaction_effects(spark, d):
    out = focal_effects(_interaction(spark, d)[2])
    numbers = ["estimate_comb", "se_comb", "ci_low", "ci_high"]
    return rounded(out.select("term", "gender", "race", "process", *numbers), *numbers)


@query(
    "interaction_effects_exact_se",
    "WITH one AS (SELECT 1)"
    + LINES
    + "SELECT term, round(b, 6) + 0.0 AS estimate_comb, round(sqrt(s2 / sxx), 6) AS se_comb FROM e",
    curated=True,
)
def interaction_effects_exact_se(spark, d):
    specs, fits, coefs = _interaction(spark, d)
    covs = baseline_covariances(spark, specs, fits)
    out = focal_effects(coefs, baseline="per_component", covariances=covs)
    return rounded(out.select("term", "estimate_comb", "se_comb"), "estimate_comb", "se_comb")


def _one_way_sql(value: str, ref: str, var: str, where: str = "", source: str = "modelled") -> str:
    """Coefficients of a model with one factor, from its cells."""
    return f"""WITH g AS (SELECT demographic AS k, {value} AS v, {var} AS var, count(*) AS n FROM {source} {where} GROUP BY 1),
        r AS (SELECT v AS v0, var AS var0 FROM g WHERE k = '{ref}')
        SELECT CASE WHEN k = '{ref}' THEN '(Intercept)' ELSE 'demographic' || k END AS term,
          round(CASE WHEN k = '{ref}' THEN v0 ELSE v - v0 END, 5) + 0.0 AS estimate,
          round(CASE WHEN k = '{ref}' THEN sqrt(var0) ELSE sqrt(var + var0) END, 5) AS se FROM g, r"""


POS, NEG = "sum(ever_phil::INT)", "sum((NOT ever_phil)::INT)"


def _one_way(spark, d, outcome, kind):
    df = _modelled(spark, d)
    specs = [ModelSpec("1", outcome, "demographic", "full", kind, (("demographic",),))]
    design, fits, coefs = _fit(df, specs)
    return design, fits, rounded(coefs.select("term", "estimate", "se"), "estimate", "se", digits=5)


@query(
    "logistic_by_group",
    _one_way_sql(f"ln({POS} / {NEG})", "M.White", f"1 / {POS} + 1 / {NEG}"),
    curated=True,
)
def logistic_by_group(spark, d):
    return _one_way(spark, d, "ever_phil", "logistic")[2]


@query(
    "bias_reduced_by_group",
    _one_way_sql(
        f"ln(({POS} + 0.5) / ({NEG} + 0.5))",
        "M.White",
        f"(count(*) + 1) ** 2 / (count(*) * ({POS} + 0.5) * ({NEG} + 0.5))",
    ),
    curated=True,
)
def bias_reduced_by_group(spark, d):
    return _one_way(spark, d, "ever_phil", "bias-reduced logistic")[2]


@query(
    "poisson_by_group",
    _one_way_sql("ln(avg(n_later_phil))", "M.White", "1 / sum(n_later_phil)"),
    curated=True,
)
def poisson_by_group(spark, d):
    return _one_way(spark, d, "n_later_phil", "Poisson")[2]


def _returned(spark, d):
    """Returned tens of units per order: many zeros and a long tail."""
    li = table(spark, d, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.floor(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / 10).alias("y")
    )
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("demographic"), "o_totalprice"
    )
    return per.join(o, "o_orderkey").select("y", "demographic", "o_totalprice")


def _hurdle_fit(spark, d, terms):
    df = _returned(spark, d)
    specs = [ModelSpec("1", "y", "demographic", "full", "hurdle", terms)]
    names = [t[0] for t in terms]
    design = build_design(df, variables_of(df, names, logs=["o_totalprice"]), ["y"])
    return design, specs, fit_sweep(design, specs)


def _hurdle(spark, d, terms):
    design, specs, fits = _hurdle_fit(spark, d, terms)
    return coefficients(design.table, specs, fits)


@query(
    "hurdle_zero_part",
    "WITH o AS (SELECT o_orderpriority AS demographic, floor(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / 10) AS y "
    "FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority), "
    + _one_way_sql(
        "ln(sum((y > 0)::INT) / sum((y = 0)::INT))",
        "1-URGENT",
        "1 / sum((y > 0)::INT) + 1 / sum((y = 0)::INT)",
        source="o",
    )[5:],
)
def hurdle_zero_part(spark, d):
    out = _hurdle(spark, d, (("demographic",),)).filter("hurdle_component = 'zero'")
    return rounded(out.select("term", "estimate", "se"), "estimate", "se", digits=5)


@query(
    "hurdle_score_equations",
    """SELECT component, term, 0.0::DOUBLE AS score FROM (SELECT DISTINCT o_orderpriority AS g FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
       CROSS JOIN (VALUES ('count'), ('zero')) c(component) CROSS JOIN LATERAL (SELECT CASE WHEN g = '1-URGENT' THEN '(Intercept)' ELSE 'demographic' || g END AS term)
       UNION ALL SELECT 'count', 'Log(theta)', 0.0""",
)
def hurdle_score_equations(spark, d):
    """Mean derivative of the log-likelihood by every coefficient: zero at the maximum."""
    design, _, fits = _hurdle_fit(spark, d, (("demographic",),))
    fit = fits["1"]
    count, y = fit.parts["count"], F.col("y_y")
    th, mu = F.lit(float(math.exp(count.log_theta))), F.exp(fit.link(design, "count"))
    over = F.log1p(mu / th)
    odds = F.exp(-th * over) / -F.expm1(-th * over)
    by_eta = th * (y - mu) / (th + mu) - odds * th * mu / (th + mu)
    # the sum over counts below y of 1 / (theta + i)
    rising = F.aggregate(F.sequence(F.lit(0), F.greatest(y.cast("int") - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + 1 / (th + i))
    by_theta = rising - over + (mu - y) / (th + mu) + odds * (mu / (th + mu) - over)
    pi = 1 / (1 + F.exp(-fit.link(design, "zero")))
    positive = y > 0
    cells = []
    for part, by in (("count", F.when(positive, by_eta)), ("zero", positive.cast("double") - pi)):
        model = fit.parts[part]
        for j in model.keep:
            cells.append((part, model.labels[j], by * design.term(tuple(model.columns[j]))))
    cells.append(("count", "Log(theta)", F.when(positive, th * by_theta)))
    one = design.table.agg(*[F.avg(x).alias(f"s{i}") for i, (_, _, x) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(t).alias("term"), F.col(f"s{i}").alias("score")) for i, (c, t, _) in enumerate(cells)])
    return rounded(one.select(F.explode(rows).alias("r")).select("r.*"), "score", digits=5)


@query("hurdle_both_parts")
def hurdle_both_parts(spark, d):
    out = _hurdle(spark, d, (("demographic",), ("o_totalprice",)))
    out = out.select("hurdle_component", "term_idx", "term", "estimate", "se", "n_rows", "converged")
    return rounded(out, "estimate", "se", digits=4)


# ---- factors of many levels ------------------------------------------------


@query(
    "design_sparse_sums",
    """WITH t AS (SELECT l_partkey::VARCHAR AS part, l_quantity AS q, l_returnflag = 'R' AS back FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity IS NOT NULL),
        r AS (SELECT *, part <> (SELECT min(part) FROM t) AS other FROM t)
       SELECT '(Intercept)' AS label, count(*) AS n, count(*)::DOUBLE AS total FROM t
       UNION ALL SELECT 'part' || part, count(*), count(*) FROM r WHERE other GROUP BY part
       UNION ALL SELECT 'q', count(*), round(sum(q), 4) FROM t
       UNION ALL SELECT 'part' || part || ':backTRUE', count(*), sum(back::INT) FROM r WHERE other GROUP BY part""",
)
def design_sparse_sums(spark, d):
    """Column sums of a design whose factor has as many levels as there are parts."""
    df = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").alias("q"), (F.col("l_returnflag") == "R").alias("back"))
    return rounded(column_sums(sparse_design(df, [("part",), ("q",), ("part", "back")])), "total", digits=4)


@query(
    "design_cross_products",
    """WITH t AS (SELECT 's' || l_suppkey AS s, l_quantity AS q FROM lineitem WHERE l_quantity IS NOT NULL),
        cells AS (SELECT row_number() OVER () AS i, s, q FROM t),
        c AS (SELECT i, unnest([{'label': '(Intercept)', 'value': 1.0::DOUBLE}, {'label': 'q', 'value': q::DOUBLE},
          CASE WHEN s <> (SELECT min(s) FROM t) THEN {'label': 's' || s, 'value': 1.0::DOUBLE} END]) AS c FROM cells)
       SELECT a.c.label AS a, b.c.label AS b, round(sum(a.c.value * b.c.value), 4) AS total FROM c a JOIN c b ON a.i = b.i
       WHERE a.c IS NOT NULL AND b.c IS NOT NULL AND a.c.label <= b.c.label GROUP BY ALL""",
)
def design_cross_products(spark, d):
    """The cross products of lines that are not empty: a diagonal for the suppliers and a border."""
    df = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.col("l_quantity").alias("q"))
    return rounded(cross_products(sparse_design(df, [("s",), ("q",)])), "total", digits=4)


WITHIN = """WITH t AS (SELECT l_partkey AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    g AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM t GROUP BY k),
    w AS (SELECT sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy, count(*) AS n, count(DISTINCT t.k) AS levels
      FROM t JOIN g ON t.k = g.k),
    f AS (SELECT sxy / sxx AS b, sxx, n AS rows, (syy - sxy * sxy / sxx) / (n - levels - 1) AS s2 FROM w)
"""


@query("linear_within_parts", WITHIN + "SELECT 'l_quantity' AS term, round(b, 4) AS estimate, round(sqrt(s2 / sxx), 4) AS se, rows AS n_rows FROM f")
def linear_within_parts(spark, d):
    """Price by quantity with an intercept for every part."""
    return rounded(fit_absorbed(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_partkey")[0], "estimate", "se", digits=4)


@query(
    "part_intercepts",
    WITHIN + "SELECT k AS l_partkey, round(my - b * mx, 3) + 0.0 AS estimate, round(sqrt(s2 * (1 / n + mx * mx / sxx)), 3) AS se, n AS n_rows FROM g, f",
)
def part_intercepts(spark, d):
    return rounded(fit_absorbed(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_partkey")[1], "estimate", "se", digits=3)


# ---- one formula in every group --------------------------------------------


def newton_sql(link: str, cells: str, start: str, rounds: int = 25) -> str:
    """Coefficients of intercept and one regressor in every group ``k``, by Newton steps in SQL.

    ``cells`` gives (k, x, n, y): equal rows as one, with their number and sum of outcomes;
    ``link`` the mean and weight as functions of eta.
    """
    mean, weight = (("1 / (1 + exp(-eta))", "mu * (1 - mu)") if link == "logistic" else ("exp(eta)", "mu"))
    return f"""WITH RECURSIVE cells AS ({cells}),
        steps AS (
          SELECT DISTINCT k, 0 AS i, {start} AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS va, 0.0::DOUBLE AS vb FROM (SELECT k, sum(y) AS y, sum(n) AS n FROM cells GROUP BY k)
          UNION ALL
          SELECT k, i + 1, any_value(a) + (sum(w * x * x) * sum(r) - sum(w * x) * sum(r * x)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2),
            any_value(b) + (sum(w) * sum(r * x) - sum(w * x) * sum(r)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2),
            sum(w * x * x) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2), sum(w) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2)
          FROM (SELECT *, n * {weight} AS w, y - n * mu AS r FROM (SELECT *, {mean} AS mu FROM
            (SELECT s.k, i, a, b, x, n, y, a + b * x AS eta FROM steps s JOIN cells c ON s.k IS NOT DISTINCT FROM c.k WHERE i < {rounds})))
          GROUP BY k, i
        )
        SELECT s.k, a, b, sqrt(va) AS sa, sqrt(vb) AS sb, n FROM steps s
        JOIN (SELECT k, sum(n)::BIGINT AS n FROM cells GROUP BY k) t ON s.k IS NOT DISTINCT FROM t.k WHERE i = {rounds}"""


def _by_group_sql(link: str, cells: str, start: str, key: str, term: str) -> str:
    return f"""SELECT k AS {key}, unnest(['(Intercept)', '{term}']) AS term, round(unnest([a, b]), 5) + 0.0 AS estimate,
        round(unnest([sa, sb]), 5) AS se, n AS n_rows FROM ({newton_sql(link, cells, start)})"""


@query(
    "logistic_by_supplier",
    _by_group_sql(
        "logistic",
        "SELECT l_suppkey AS k, l_quantity / 10 AS x, count(*) AS n, sum((l_returnflag = 'R')::INT) AS y FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL",
        "0.0::DOUBLE",
        "l_suppkey",
        "tens",
    ),
)
def logistic_by_supplier(spark, d):
    """Whether a line is returned, by its quantity: one model per supplier."""
    df = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_quantity") / 10).alias("tens"))
    out = fit_groups(df, ["l_suppkey"], ModelSpec("1", "returned", "tens", "full", "logistic", (("tens",),)))
    return rounded(out.select("l_suppkey", "term", "estimate", "se", "n_rows"), "estimate", "se", digits=5)


@query(
    "poisson_by_customer",
    _by_group_sql(
        "Poisson",
        """SELECT nullif(c_nationkey, 3) AS k, l_discount * 10 AS x, count(*) AS n, sum(l_linenumber) AS y FROM lineitem
           JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
        "ln(y / n)",
        "nation",
        "discount",
    ),
)
def poisson_by_customer(spark, d):
    """Line numbers by discount: one model per customers' nation, one of them unknown."""
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer")}
    lines = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    df = lines.select(F.nullif("c_nationkey", F.lit(3)).alias("nation"), "l_linenumber", (F.col("l_discount") * 10).alias("discount"))
    out = fit_groups(df, ["nation"], ModelSpec("1", "l_linenumber", "discount", "full", "Poisson", (("discount",),)))
    return rounded(out.select("nation", "term", "estimate", "se", "n_rows"), "estimate", "se", digits=5)


def _sweep_sql() -> str:
    lines = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    models = [
        ("1", "quantity", "logistic", "0.0::DOUBLE", "l_quantity / 10", "(l_returnflag = 'R')::INT"),
        ("2", "discount", "logistic", "0.0::DOUBLE", "l_discount * 10", "(l_returnflag = 'R')::INT"),
        ("3", "quantity", "Poisson", "ln(y / n)", "l_quantity / 10", "l_linenumber"),
        ("4", "discount", "Poisson", "ln(y / n)", "l_discount * 10", "l_linenumber"),
    ]
    return " UNION ALL ".join(
        f"""SELECT k AS c_mktsegment, '{idx}' AS model_idx, unnest(['(Intercept)', '{term}']) AS term, round(unnest([a, b]), 5) + 0.0 AS estimate,
            round(unnest([sa, sb]), 5) AS se, n AS n_rows FROM ({newton_sql(link, f"SELECT c_mktsegment AS k, {x} AS x, count(*) AS n, sum({y}) AS y FROM {lines} GROUP BY ALL", start)})"""
        for idx, term, link, start, x, y in models
    )


@query("model_sweep_by_segment", _sweep_sql())
def model_sweep_by_segment(spark, d):
    """Two outcomes by two variables, a grid of four models in every market segment."""
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer")}
    lines = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    df = lines.select(
        "c_mktsegment", "l_linenumber", (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_quantity") / 10).alias("quantity"), (F.col("l_discount") * 10).alias("discount"),
    )
    grid = [("returned", "logistic"), ("l_linenumber", "Poisson")]
    specs = [
        ModelSpec(str(1 + 2 * i + j), outcome, x, "full", kind, ((x,),)) for i, (outcome, kind) in enumerate(grid) for j, x in enumerate(["quantity", "discount"])
    ]
    out = sweep_groups(df, ["c_mktsegment"], specs)
    return rounded(out.select("c_mktsegment", "model_idx", "term", "estimate", "se", "n_rows"), "estimate", "se", digits=5)


def _hurdle_sql(cells: str, rounds: int = 60) -> str:
    """Both parts of a hurdle model of one regressor, by Newton steps in SQL.

    ``cells`` gives (x, y, n). The count part is a zero-truncated negative binomial in
    intercept, slope and the logarithm of its dispersion; a step is no longer than 3.
    """
    zero = newton_sql("logistic", f"SELECT 1 AS k, x, sum(n) AS n, sum(n * (y > 0)::INT) AS y FROM ({cells}) GROUP BY x", "0.0::DOUBLE")
    inverse = {
        "i11": "(h22 * h33 - h23 * h23)", "i12": "(h13 * h23 - h12 * h33)", "i13": "(h12 * h23 - h13 * h22)",
        "i22": "(h11 * h33 - h13 * h13)", "i23": "(h12 * h13 - h11 * h23)", "i33": "(h11 * h22 - h12 * h12)",
    }
    det = "(h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h13 * h23) + h13 * (h12 * h23 - h13 * h22))"
    parts = ", ".join(f"{value} / {det} AS {name}" for name, value in inverse.items())
    return f"""WITH RECURSIVE every AS ({cells}), counts AS (SELECT x, y, n FROM every WHERE y > 0),
        steps AS (
          SELECT 0 AS i, ln(sum(n * y) / sum(n)) AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS l, 0.0::DOUBLE AS va, 0.0::DOUBLE AS vb, 0.0::DOUBLE AS vl FROM counts
          UNION ALL
          SELECT i + 1, a + f * da, b + f * db, l + f * dl, i11, i22, i33 FROM (
            SELECT *, least(1, 3 / greatest(abs(da), abs(db), abs(dl), 1e-300)) AS f FROM (
              SELECT *, i11 * g1 + i12 * g2 + i13 * g3 AS da, i12 * g1 + i22 * g2 + i23 * g3 AS db, i13 * g1 + i23 * g2 + i33 * g3 AS dl FROM (
                SELECT *, {parts} FROM (
                  SELECT i, any_value(a) AS a, any_value(b) AS b, any_value(l) AS l, sum(n * ge) AS g1, sum(n * ge * x) AS g2, sum(n * th * gt) AS g3,
                    -sum(n * hee) AS h11, -sum(n * hee * x) AS h12, -sum(n * th * het) AS h13, -sum(n * hee * x * x) AS h22, -sum(n * th * het * x) AS h23,
                    -sum(n * (th * th * htt + th * gt)) AS h33
                  FROM (
                    SELECT *, th * (y - mu) / s + odds * za AS ge, dg - over_ + (mu - y) / s + odds * zt AS gt,
                      -th * mu * (y + th) / (s * s) + pull * za * za - odds * th * th * mu / (s * s) AS hee,
                      (y - mu) * mu / (s * s) + pull * za * zt - odds * mu * mu / (s * s) AS het,
                      tg + mu / (th * s) - (mu - y) / (s * s) + pull * zt * zt + odds * mu * mu / (th * s * s) AS htt
                    FROM (
                      SELECT *, -th * mu / s AS za, mu / s - over_ AS zt, odds * (1 + odds) AS pull,
                        list_sum(list_transform(range(0, y::INT), lambda q: 1 / (th + q))) AS dg, -list_sum(list_transform(range(0, y::INT), lambda q: 1 / (th + q) ** 2)) AS tg
                      FROM (
                        SELECT *, exp(-th * over_) / (1 - exp(-th * over_)) AS odds FROM (
                          SELECT *, th + mu AS s, ln(1 + mu / th) AS over_ FROM (
                            SELECT i, a, b, l, x, y, n, exp(a + b * x) AS mu, exp(l) AS th FROM steps, counts WHERE i < {rounds})))))
                  GROUP BY i)))))
        SELECT 'count' AS hurdle_component, unnest(['(Intercept)', 'price', 'Log(theta)']) AS term, round(unnest([a, b, l]), 4) + 0.0 AS estimate,
          round(unnest([sqrt(va), sqrt(vb), sqrt(vl)]), 4) AS se FROM steps WHERE i = {rounds}
        UNION ALL SELECT 'zero', unnest(['(Intercept)', 'price']), round(unnest([a, b]), 4) + 0.0, round(unnest([sa, sb]), 4) FROM ({zero})"""


@query(
    "hurdle_one_regressor",
    _hurdle_sql(
        """SELECT floor(p / 50000) AS x, y, count(*) AS n FROM (
             SELECT o_totalprice AS p, floor(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / 10) AS y
             FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice) GROUP BY ALL"""
    ),
)
def hurdle_one_regressor(spark, d):
    """Returned tens of units of an order by its price, zero part and counts."""
    df = _returned(spark, d).select("y", F.floor(F.col("o_totalprice") / 50000).cast("double").alias("price"))
    specs = [ModelSpec("1", "y", "price", "full", "hurdle", (("price",),))]
    coefs = _fit(df, specs)[2]
    return rounded(coefs.select("hurdle_component", "term", "estimate", "se"), "estimate", "se", digits=4)


# ---- scores and diagnostics ----------------------------------------------


@query(
    "scored_probabilities",
    """SELECT round(avg(ever_phil::INT) OVER (PARTITION BY demographic), 5) AS response, ever_phil::INT::DOUBLE AS ever_phil FROM modelled""",
    curated=True,
)
def scored_probabilities(spark, d):
    design, fits, _ = _one_way(spark, d, "ever_phil", "logistic")
    return design.table.select(
        rnd(fits["1"].response(design), 5).alias("response"), F.col("y_ever_phil").alias("ever_phil")
    )


ROC_SQL = """WITH t AS (SELECT {by} {score} AS s, {truth} AS y FROM {source}),
    c AS (SELECT {by} s, sum(y::INT) AS pos, sum((NOT y)::INT) AS neg FROM t GROUP BY ALL),
    w AS (SELECT *, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n,
      sum(neg) OVER ({part} ORDER BY s) - neg AS tn, sum(pos) OVER ({part} ORDER BY s) - pos AS fn FROM c)
"""


@query(
    "roc_points",
    ROC_SQL.format(by="", score="l_extendedprice", truth="l_returnflag = 'R'", source="lineitem", part="")
    + """SELECT round(s, 6) AS threshold, round(tn / n, 6) AS specificity, round((p - fn) / p, 6) AS sensitivity FROM w
        UNION ALL SELECT '-inf'::DOUBLE, 0, 1 UNION ALL SELECT 'inf'::DOUBLE, 1, 0""",
)
def roc_points(spark, d):
    df = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").alias("y"))
    out = roc_curve(df, "l_extendedprice", "y")
    return rounded(out, "threshold", "specificity", "sensitivity")


@query(
    "roc_points_unknown",
    ROC_SQL.format(
        by="k,", score="l_quantity", truth="l_returnflag = 'R'", source="(SELECT *, nullif(l_linestatus, 'O') AS k FROM lineitem)", part="PARTITION BY k"
    )
    + """SELECT k, round(s, 6) AS threshold, round(tn / n, 6) AS specificity, round((p - fn) / p, 6) AS sensitivity FROM w
        UNION ALL SELECT DISTINCT k, '-inf'::DOUBLE, 0, 1 FROM w UNION ALL SELECT DISTINCT k, 'inf'::DOUBLE, 1, 0 FROM w""",
)
def roc_points_unknown(spark, d):
    df = table(spark, d, "lineitem").select(
        F.nullif("l_linestatus", F.lit("O")).alias("k"), "l_quantity", (F.col("l_returnflag") == "R").alias("y")
    )
    return rounded(roc_curve(df, "l_quantity", "y", ["k"]), "threshold", "specificity", "sensitivity")


@query(
    "roc_area_by_group",
    ROC_SQL.format(
        by="l_linestatus,", score="l_quantity", truth="l_returnflag = 'R'", source="lineitem", part="PARTITION BY l_linestatus"
    )
    + "SELECT l_linestatus, round(sum(pos * (tn + neg / 2)) / (max(p) * max(n)), 6) AS auc FROM w GROUP BY 1",
)
def roc_area_by_group(spark, d):
    df = table(spark, d, "lineitem").select("l_linestatus", "l_quantity", (F.col("l_returnflag") == "R").alias("y"))
    return rounded(roc_auc(df, "l_quantity", "y", ["l_linestatus"]), "auc")


def _two_scores(spark, d):
    """Scores of a linear and a logistic one-factor model, one row per model."""
    df = _modelled(spark, d)
    specs = [
        ModelSpec("1", "ever_phil", "demographic", "full", "lm", (("demographic",),)),
        ModelSpec("2", "ever_phil", "demographic", "full", "logistic", (("demographic",),)),
    ]
    design = grid_design(df, specs)
    fits = fit_sweep(design, specs)
    # one score per factor level: rounding joins sums that differ in the last digit
    return roc_scores(design, specs, fits).withColumn("score", F.round("score", 9))


@query(
    "threshold_sensitivity",
    """WITH g AS (SELECT demographic, sum(ever_phil::INT) AS pos, avg(ever_phil::INT) AS s FROM modelled GROUP BY 1),
       w AS (SELECT s, sum(pos) OVER () AS p, sum(pos) OVER (ORDER BY s DESC) AS tp FROM g)
       SELECT m.model_idx, round(s, 5) AS threshold, round(tp / p, 6) AS sensitivity FROM w CROSS JOIN (VALUES ('1'), ('2')) m(model_idx)""",
    curated=True,
)
def threshold_sensitivity_points(spark, d):
    curve = roc_curve(_two_scores(spark, d), "score", "y", ["model_idx"])
    out = threshold_sensitivity(curve, F.col("model_idx") == "1").drop("specificity")
    return rounded(rounded(out, "threshold", digits=5), "sensitivity")


@query(
    "count_rootogram",
    """WITH t AS (SELECT l_linestatus AS k, l_quantity::BIGINT AS y, l_extendedprice / 2000 AS f FROM lineitem),
       o AS (SELECT k, y AS bin, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT k, ceil(f - 0.5)::BIGINT AS bin, count(*) AS n FROM t GROUP BY ALL)
       SELECT k, bin, coalesce(o.n, 0) AS observed, coalesce(e.n, 0) AS fitted, round(sqrt(coalesce(o.n, 0)), 6) AS sqrt_observed,
       round(sqrt(coalesce(e.n, 0)), 6) AS sqrt_fitted FROM o FULL JOIN e USING (k, bin)""",
)
def count_rootogram_bins(spark, d):
    df = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("k"), "l_quantity", (F.col("l_extendedprice") / 2000).alias("f")
    )
    return rounded(count_rootogram(df, "l_quantity", "f", ["k"]), "sqrt_observed", "sqrt_fitted")


@query(
    "binary_rootogram",
    """WITH t AS (SELECT l_returnflag = 'R' AS y, 1 / (1 + exp(-(l_quantity - 30) / 10)) > 0.5 AS p FROM lineitem),
       o AS (SELECT y AS bin, count(*) AS n FROM t GROUP BY 1), e AS (SELECT p AS bin, count(*) AS n FROM t GROUP BY 1)
       SELECT bin, coalesce(o.n, 0) AS observed, coalesce(e.n, 0) AS fitted FROM o FULL JOIN e USING (bin)""",
)
def binary_rootogram_bins(spark, d):
    df = table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("y"), ((F.col("l_quantity") - 30) / 10).alias("f")
    )
    return binary_rootogram(df, "y", "f", 0.5, delogit=True).drop("sqrt_observed", "sqrt_fitted")


# ---- effects -------------------------------------------------------------


@query(
    "highlight_effects",
    """WITH t AS ("""
    + " UNION ALL ".join(
        f"""SELECT '{v}' AS focal_var, {sign} regr_slope(ever_phil::INT, {x}) AS b, sqrt((regr_syy(ever_phil::INT, {x})
            - regr_slope(ever_phil::INT, {x}) ** 2 * regr_sxx(ever_phil::INT, {x})) / (count(*) - 2) / regr_sxx(ever_phil::INT, {x})) AS se
            FROM modelled WHERE {x} IS NOT NULL"""
        for v, x, sign in [
            ("course_division", "(course_division = 'upper')::INT", ""),
            ("admission_type", "(admission_type = 'Transfer')::INT", "-"),
            ("current_phil_share", "current_phil_share", ""),
            ("poc_share", "poc_share", ""),
            ("women_share", "women_share", ""),
        ]
    )
    + """) SELECT focal_var, round(b, 6) + 0.0 AS estimate, round(b - 1.959963984540054 * se, 6) + 0.0 AS ci_low,
       round(b + 1.959963984540054 * se, 6) + 0.0 AS ci_high FROM t""",
    curated=True,
)
def highlight_effects(spark, d):
    specs = [_spec(i, "ever_phil", "lm", v, "full") for i, v in enumerate(HIGHLIGHTS)]
    out = highlights(_fit(_modelled(spark, d), specs)[2], HIGHLIGHTS)
    return rounded(out.select("focal_var", "estimate", "ci_low", "ci_high"), "estimate", "ci_low", "ci_high")


@query(
    "effect_bands",
    """WITH g AS (SELECT course_division = 'upper' AS up, sum(ever_phil::INT) AS pos, sum((NOT ever_phil)::INT) AS neg,
         sum(n_later_phil) AS y, count(*) AS n FROM modelled GROUP BY 1),
       a AS (SELECT * FROM g WHERE up), b AS (SELECT * FROM g WHERE NOT up),
       e AS (SELECT 'logistic' AS model_type, 'logistic' AS model_group, ln(a.pos / a.neg) - ln(b.pos / b.neg) AS est, sqrt(1 / a.pos + 1 / a.neg + 1 / b.pos + 1 / b.neg) AS se FROM a, b
         UNION ALL SELECT 'Poisson', 'count', ln(a.y / a.n) - ln(b.y / b.n), sqrt(1 / a.y + 1 / b.y) FROM a, b
         UNION ALL SELECT 'hurdle zero', 'logistic', ln(a.pos / a.neg) * 0 + NULL, NULL FROM a, b WHERE false)
       SELECT model_type, model_group, 'upper-division course' AS process, round(exp(est) - 1, 5) + 0.0 AS estimate_comb, round(exp(se) - 1, 5) AS se_comb,
         CASE WHEN exp(est) < 0.5 THEN 'strong' WHEN exp(est) < 0.8 THEN 'moderate' WHEN exp(est) < 1.25 THEN 'negligible'
           WHEN exp(est) < 2 THEN 'moderate' ELSE 'strong' END AS level FROM e""",
    curated=True,
)
def effect_bands(spark, d):
    specs = [
        _spec(1, "ever_phil", "logistic", "course_division", "full"),
        _spec(2, "n_later_phil", "Poisson", "course_division", "full"),
    ]
    out = report(_fit(_modelled(spark, d), specs)[2])
    out = out.select("model_type", "model_group", "process", "estimate_comb", "se_comb", "level")
    return rounded(out, "estimate_comb", "se_comb", digits=5)


def _grid(spark, d):
    """The whole grid fitted on the training rows, with everything read off it."""
    return _grid_as_of(spark, d, folder_state(spark, d))


@lru_cache(maxsize=2)
def _grid_as_of(spark, d, state):
    return run(_modelled(spark, d), model_grid(dag.control_sets(spark)), TEST_SHARE, SEED)


@query("model_grid_effects")
def model_grid_effects(spark, d):
    out = plottable(_grid(spark, d)["estimates"])
    numbers = ["estimate_comb", "se_comb", "ci_low", "ci_high"]
    return rounded(
        out.select("model_idx", "focal_var", "formula", "model_type", "process", "term", *numbers, "level"), *numbers, digits=4
    )


def _controls_by_hand(focal: str) -> list[str]:
    """The canonical control set of a focal variable, by walking the causal model."""
    children: dict[str, list[str]] = {}
    for node, names in dag.PARENTS.items():
        for parent in names:
            children.setdefault(parent, []).append(node)

    def walk(start, step):
        seen, todo = set(start), list(start)
        while todo:
            new = set(step.get(todo.pop(), ())) - seen
            seen |= new
            todo += new
        return seen

    up = walk([focal], dag.PARENTS) | walk([dag.OUTCOME], dag.PARENTS)
    causal = walk([focal], children) & walk([dag.OUTCOME], dag.PARENTS) - {focal}
    return sorted(up - {focal, dag.OUTCOME, *dag.LATENT} - walk(causal, children))


# What the columns of the modelled rows are.
FACTORS = ["admission_type", "course_division", "demographic", "gender_instructor", "quarter", "race_instructor", "year"]
FLAGS = ["ever_phil", "first_gen", "low_income", "other_major_student", "undeclared_student"]


#: Moves sums of short decimals off the edges of rounding.
OFF_EDGE = 0.0000371


def _observed_sums_sql() -> str:
    """Sums of the outcome times every design column, of every formula with a canonical link."""

    def part(v: str) -> tuple[str, str]:
        if v in FACTORS:
            first = f"'{FIRST_LEVELS[v]}'" if v in FIRST_LEVELS else f"(SELECT min({v}) FROM modelled)"
            return f"CASE WHEN {v} <> {first} THEN '{v}' || {v} END", "1"
        if v in FLAGS:
            return f"'{v}TRUE'", f"{v}::INT"
        return ("'log10(n_students)'", "log10(n_students)") if v == "n_students" else (f"'{v}'", v)

    seen, rows = set(), []
    for s in model_grid({v: [_controls_by_hand(v)] for v in dag.FOCAL}):
        if s.model_type == "bias-reduced logistic" or s.formula in seen:
            continue
        seen.add(s.formula)
        y = {"ever_phil": "ever_phil::INT", "n_later_phil": "n_later_phil"}[s.outcome]
        y = f"({y} > 0)::INT" if s.model_type == "hurdle" else y
        cells = [f"{{'t': '(Intercept)', 'v': ({y})::DOUBLE}}"]
        for term in s.terms:
            parts = [part(v) for v in term]
            label = " || ':' || ".join(f"({p})" for p, _ in parts)
            cells.append(f"{{'t': {label}, 'v': ({y})::DOUBLE * {' * '.join(x for _, x in parts)}}}")
        known = " AND ".join(f"{v} IS NOT NULL" for v in [s.outcome, *s.variables()])
        terms = "+".join(":".join(t) for t in s.terms)
        rows.append(
            f"SELECT '{s.outcome}' AS outcome, '{s.model_type}' AS model_type, '{terms}' AS terms, c.t AS term, sum(c.v) AS total "
            f"FROM (SELECT unnest([{', '.join(cells)}]) AS c FROM whole WHERE {known}) GROUP BY c.t"
        )
    return f"""WITH whole AS (SELECT m.*, c.other_major_student FROM modelled m LEFT JOIN crs c ON m.id = c.id AND m.course_id = c.course_id)
        SELECT outcome, model_type, terms, term, round(total + {OFF_EDGE}, 3) AS total FROM ({" UNION ALL ".join(rows)})
        WHERE term IS NOT NULL AND total <> 0"""


@query("model_grid_fitted_sums", _observed_sums_sql(), curated=True)
def model_grid_fitted_sums(spark, d):
    """The score equations of the whole grid: SQL has the sums of the outcomes, the fits those of their means."""
    rows = _modelled(spark, d)
    specs = [s for s in model_grid(dag.control_sets(spark)) if s.model_type != "bias-reduced logistic"]
    specs = list({s.formula: s for s in specs}.values())
    design = grid_design(rows, specs)
    fits = fit_sweep(design, specs)
    terms = spark.createDataFrame([(s.model_idx, "+".join(":".join(t) for t in s.terms)) for s in specs], "model_idx string, terms string")
    kinds = spec_table(spark, specs).select("model_idx", "outcome", "model_type").join(terms, "model_idx")
    sums = fitted_sums(design, specs, fits).where(F.abs("fitted") > 1e-6).join(kinds, "model_idx")
    return sums.select("outcome", "model_type", "terms", "term", F.round(F.col("fitted") + OFF_EDGE, 3).alias("total"))


@query("model_grid_areas")
def model_grid_areas(spark, d):
    return rounded(_grid(spark, d)["auc"], "auc", digits=4)


@query("model_grid_rootograms")
def model_grid_rootograms(spark, d):
    return _grid(spark, d)["rootograms"].select("model_idx", "bin", "observed", "fitted")


@query(
    "scored_models",
    """SELECT m.model_idx, round(CASE WHEN m.model_idx = '1' THEN s ELSE ln(s / (1 - s)) END, 5) + 0.0 AS score, ever_phil AS y
       FROM (SELECT ever_phil, avg(ever_phil::INT) OVER (PARTITION BY demographic) AS s FROM modelled)
       CROSS JOIN (VALUES ('1'), ('2')) m(model_idx)""",
    curated=True,
)
def scored_models(spark, d):
    return rounded(_two_scores(spark, d), "score", digits=5)


@query(
    "model_groups",
    """SELECT hurdle_component AS component, 'hurdle ' || hurdle_component AS model_type, CASE hurdle_component WHEN 'count' THEN 'count' ELSE 'logistic' END AS model_group, n
       FROM (SELECT unnest(['count', 'zero']) AS hurdle_component) CROSS JOIN (SELECT count(DISTINCT o_orderpriority) - 1 AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""",
)
def model_groups(spark, d):
    coefs = _hurdle(spark, d, (("demographic",),))
    out = with_model_group(focal_effects(coefs))
    return out.groupBy(F.col("hurdle_component").alias("component"), "model_type", "model_group").agg(
        F.count(F.lit(1)).alias("n")
    )


def _back_transformed_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{v}' AS k, {x} AS x, count(*) AS n, sum(n_later_phil) AS y FROM modelled WHERE {x} IS NOT NULL AND n_later_phil IS NOT NULL GROUP BY ALL"
        for v, x in [
            ("course_division", "(course_division = 'upper')::INT"),
            ("admission_type", "(admission_type = 'Transfer')::INT"),
            ("current_phil_share", "current_phil_share"),
            ("poc_share", "poc_share"),
            ("women_share", "women_share"),
        ]
    )
    z = 1.959963984540054
    return f"""SELECT k AS focal_var, round(exp(b) - 1, 4) + 0.0 AS estimate_comb, round(b, 4) + 0.0 AS estimate_comb_raw,
        round(exp(b - {z} * sb) - 1, 4) + 0.0 AS ci_low, round(exp(b + {z} * sb) - 1, 4) + 0.0 AS ci_high,
        CASE WHEN exp(b) < 0.5 THEN 'strong' WHEN exp(b) < 0.8 THEN 'moderate' WHEN exp(b) < 1.25 THEN 'negligible' WHEN exp(b) < 2 THEN 'moderate' ELSE 'strong' END AS level
        FROM ({newton_sql("Poisson", cells, "ln(y / n)")})"""


@query("back_transformed_effects", _back_transformed_sql(), curated=True)
def back_transformed_effects(spark, d):
    specs = [_spec(i, "n_later_phil", "Poisson", v, "full") for i, v in enumerate(HIGHLIGHTS)]
    effects = with_model_group(focal_effects(_fit(_modelled(spark, d), specs)[2]))
    out = with_band(back_transformed(effects, keep_raw=True))
    numbers = ["estimate_comb", "estimate_comb_raw", "ci_low", "ci_high"]
    return rounded(out.select("focal_var", *numbers, "level"), *numbers, digits=4)

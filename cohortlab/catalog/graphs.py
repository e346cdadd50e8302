"""Dependency-graph queries: a conversation is a graph of its turns.

A turn depends on the turn before it and on the one before that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.catalog.registry import query, table
from cohortlab.models.spec import spec_frame
from cohortlab.operators import graph, reshape
from cohortlab.plans.dag import controls_table, spec_controls
from cohortlab.session import staged

BY = ["conv_id"]


def _turns(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node"), "role", "text"
    )


def _edges(spark, d):
    before = F.filter(
        F.array(F.col("turn") - 1, F.col("turn") - 2), lambda k: k >= 0
    )
    parents = F.transform(before, lambda k: F.concat(F.lit("t"), k.cast("string")))
    return graph.edges_from_parents(_turns(spark, d).withColumn("parents", parents), "node", "parents", BY)


def _last(turns):
    return turns.groupBy("conv_id").agg(F.concat(F.lit("t"), F.max("turn").cast("string")).alias("node"))


def _latent(spark, d):
    return _turns(spark, d).filter(F.length("text") < 120).select("conv_id", F.col("node").alias("name"))


EDGE_SQL = """WITH RECURSIVE turns AS (SELECT conv_id, turn, 't' || turn AS node, length(text) < 120 AS latent FROM conversations),
    edges AS (SELECT a.conv_id, b.node AS src, a.node AS dst FROM turns a JOIN turns b
        ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)),
    ends AS (SELECT conv_id, 't' || max(turn) AS node FROM turns GROUP BY 1)
"""


@query("turn_edges", EDGE_SQL + "SELECT * FROM edges")
def turn_edges(spark, d):
    return _edges(spark, d)


@query(
    "turn_nodes",
    EDGE_SQL
    + """SELECT conv_id, node AS name, latent, CASE node WHEN 't0' THEN 'opening' ELSE node END AS label,
        CASE WHEN node = 't3' THEN 'outcome' WHEN node IN ('t1', 't2') THEN 'variable of interest' WHEN latent THEN 'unmeasured'
        WHEN node = 't0' THEN 'measured control' ELSE 'error' END AS var_type
        FROM turns WHERE conv_id IN (SELECT conv_id FROM edges)""",
)
def turn_nodes(spark, d):
    nodes = graph.node_table(_edges(spark, d), _latent(spark, d), BY)
    return graph.labelled_nodes(nodes, {"t0": "opening"}, "t3", ["t1", "t2"], ["t0"])


@query(
    "turns_above_last",
    EDGE_SQL
    + """, up AS (SELECT conv_id, node FROM ends UNION SELECT e.conv_id, e.src FROM up JOIN edges e
        ON up.conv_id = e.conv_id AND up.node = e.dst) SELECT * FROM up""",
)
def turns_above_last(spark, d):
    last = _last(_turns(spark, d))
    return graph.reachable(_edges(spark, d), last, BY, up=True)


CANDIDATES = (
    EDGE_SQL
    + """, xs AS (SELECT conv_id, node AS exposure FROM turns
            WHERE (conv_id, node) NOT IN (SELECT conv_id, node FROM ends)),
    up AS (SELECT conv_id, exposure, 'x' AS side, exposure AS node FROM xs
        UNION SELECT x.conv_id, exposure, 'y', n.node FROM xs x JOIN ends n ON x.conv_id = n.conv_id
        UNION SELECT u.conv_id, exposure, side, e.src FROM up u JOIN edges e ON u.conv_id = e.conv_id AND u.node = e.dst),
    down AS (SELECT conv_id, exposure, exposure AS node FROM xs
        UNION SELECT u.conv_id, exposure, e.dst FROM down u JOIN edges e ON u.conv_id = e.conv_id AND u.node = e.src),
    causal AS (SELECT d.* FROM down d JOIN up u ON d.conv_id = u.conv_id AND d.exposure = u.exposure AND d.node = u.node
        WHERE u.side = 'y' AND d.node <> d.exposure),
    forb AS (SELECT * FROM causal UNION SELECT u.conv_id, exposure, e.dst FROM forb u JOIN edges e ON u.conv_id = e.conv_id AND u.node = e.src),
    result AS (SELECT DISTINCT u.conv_id, u.exposure, u.node AS control FROM up u
        WHERE u.node <> u.exposure AND (u.conv_id, u.node) NOT IN (SELECT conv_id, node FROM ends)
        AND (u.conv_id, u.node) NOT IN (SELECT conv_id, node FROM turns WHERE latent)
        AND (u.conv_id, u.exposure, u.node) NOT IN (SELECT conv_id, exposure, node FROM forb))
"""
)


def _model(spark, d):
    """Edges, nodes, exposures and outcomes: the last turn is the outcome of all others."""
    edges = _edges(spark, d)
    nodes = graph.node_table(edges, _latent(spark, d), BY)
    turns = _turns(spark, d)
    last = _last(turns)
    exposures = turns.select("conv_id", "node").join(last, ["conv_id", "node"], "left_anti")
    return edges, nodes, exposures, last


def _candidates(spark, d):
    return graph.control_candidates(*_model(spark, d), BY)


SHORT = {"t1": ["t1a", "t1b"]}
KINDS = {"a": ["lm", "logistic"], "b": ["Poisson"]}


def _specs(spark, d):
    """The spec grid over the control sets of every conversation."""
    return spec_frame(_candidates(spark, d), BY, ["length"], SHORT, KINDS, {"b": ["a"]})


SPECS = CANDIDATES + """, sets AS (SELECT conv_id, exposure, list_sort(list(DISTINCT control)) AS cs FROM result GROUP BY ALL),
    wide AS (SELECT conv_id, exposure, flatten(list_transform(cs, lambda x: CASE WHEN x = 't1' THEN ['t1a', 't1b'] ELSE [x] END)) AS cs,
        CASE WHEN exposure = 't1' THEN ['t1a', 't1b'] ELSE [exposure] END AS focal FROM sets),
    grid AS (SELECT *, unnest(focal) AS one FROM wide
        CROSS JOIN (VALUES ('full', 1), ('interaction', 2)) f(formula, f_no)
        CROSS JOIN (VALUES ('a', 'lm', 1), ('a', 'logistic', 2), ('b', 'Poisson', 1)) k(outcome, model_type, k_no)),
    specs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY outcome, one, exposure, f_no, k_no)::VARCHAR AS model_idx,
        outcome, one AS focal_var, formula, model_type,
        cs || ['length'] || focal || (CASE WHEN formula = 'interaction' THEN ['demographic'] ELSE [] END)
        || (CASE WHEN outcome = 'b' THEN ['a'] ELSE [] END) AS mains,
        CASE WHEN formula = 'interaction' THEN list_transform(focal, lambda v: v || ':demographic') ELSE [] END AS crossed FROM grid)
"""


@query("spec_rows", SPECS + "SELECT conv_id, model_idx, outcome, focal_var, formula, model_type, array_to_string(mains || crossed, '+') AS terms FROM specs")
def spec_rows(spark, d):
    terms = F.array_join(F.transform("terms", lambda t: F.array_join(t, ":")), "+")
    return _specs(spark, d).select("conv_id", "model_idx", "outcome", "focal_var", "formula", "model_type", terms.alias("terms"))


@query(
    "spec_control_rows",
    SPECS + "SELECT DISTINCT conv_id, focal_var AS exposure, control FROM (SELECT conv_id, focal_var, unnest(mains) AS control FROM specs WHERE formula = 'full') WHERE control <> focal_var",
)
def spec_control_rows(spark, d):
    return spec_controls(_specs(spark, d), BY)


@query("turn_controls", CANDIDATES + "SELECT * FROM result")
def turn_controls(spark, d):
    return _candidates(spark, d)


@query(
    "turn_control_table",
    CANDIDATES
    + """SELECT conv_id, exposure, l.control, CASE WHEN bool_or(r.control = l.control) OR l.control = 'length' THEN 'X' ELSE '' END AS mark
        FROM result r CROSS JOIN (SELECT DISTINCT control FROM result UNION ALL SELECT 'length') l GROUP BY conv_id, exposure, l.control""",
)
def turn_control_table(spark, d):
    """The marks of every conversation's exposures, a column for each control found anywhere, read as rows."""
    wide = controls_table(staged(_candidates(spark, d), "candidates"), None, ["length"], BY)
    return reshape.longer(wide, [c for c in wide.columns if c not in ("conv_id", "exposure")], "control", "mark")


@query(
    "turns_adjustable",
    CANDIDATES
    + """, above AS (SELECT DISTINCT conv_id, exposure, node FROM up),
    paths AS (SELECT a.conv_id, a.exposure, e.src, e.dst FROM edges e JOIN above a ON a.conv_id = e.conv_id AND a.node = e.src
        JOIN above b ON b.conv_id = e.conv_id AND b.exposure = a.exposure AND b.node = e.dst
        WHERE NOT (e.src = a.exposure AND (e.conv_id, a.exposure, e.dst) IN (SELECT conv_id, exposure, node FROM causal))),
    moral AS (SELECT conv_id, exposure, src AS a, dst AS b FROM paths UNION SELECT conv_id, exposure, dst, src FROM paths
        UNION SELECT p.conv_id, p.exposure, p.src, q.src FROM paths p JOIN paths q ON p.conv_id = q.conv_id AND p.exposure = q.exposure AND p.dst = q.dst),
    free AS (SELECT * FROM moral WHERE (conv_id, exposure, a) NOT IN (SELECT * FROM result) AND (conv_id, exposure, b) NOT IN (SELECT * FROM result)),
    seen AS (SELECT conv_id, exposure, exposure AS node FROM xs UNION SELECT s.conv_id, s.exposure, f.b FROM seen s
        JOIN free f ON s.conv_id = f.conv_id AND s.exposure = f.exposure AND s.node = f.a)
    SELECT x.conv_id, x.exposure, s.node IS NULL AS valid, (SELECT count(*) FROM result r WHERE r.conv_id = x.conv_id AND r.exposure = x.exposure) AS n_controls
        FROM xs x JOIN ends n ON x.conv_id = n.conv_id LEFT JOIN seen s ON s.conv_id = x.conv_id AND s.exposure = x.exposure AND s.node = n.node""",
)
def turns_adjustable(spark, d):
    """Whether the controls of every exposure are enough, and how many they are."""
    controls, valid = graph.adjustable(*_model(spark, d), BY)
    return valid.join(controls, ["conv_id", "exposure"], "left").groupBy("conv_id", "exposure", "valid").agg(F.count("control").alias("n_controls"))

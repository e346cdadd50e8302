"""The causal model behind the choice of control variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.graph import (
    adjustable,
    edges_from_parents,
    labelled_nodes,
    node_table,
)
from cohortlab.operators.reshape import indicators, levels_of, ticks

OUTCOME = "outcome"

# The variables whose effects are estimated.
FOCAL = [
    "class",
    "admission_type",
    "undeclared_student",
    "grade_diff",
    "dmg",
    "peer_demographics",
    "current_phil_share",
    "n_students",
    "course_division",
    "instructor_demographics",
    "instructor_log_total",
]

# Controls of every model.
GENERAL_CONTROLS = ["year", "quarter"]

# Each node with its direct causes.
PARENTS = {
    "outcome": [
        "practical_major",
        "undeclared_student",
        "other_major_student",
        "philosophy_person",
        "mentoring",
    ],
    "admission_type": ["class"],
    "bias": ["dmg", "instructor_log_total", "instructor_demographics"],
    "classroom_culture": [
        "bias",
        "n_students",
        "mean_grade",
        "current_phil_share",
        "other_major_share",
        "peer_demographics",
        "instructor_demographics",
        "course_division",
        "instructor_log_total",
    ],
    "course_division": ["admission_type"],
    "current_phil_share": ["course_division"],
    "dmg": ["instructor_demographics", "instructor_log_total"],
    "field_spec_ability": ["classroom_culture", "grade_diff", "prior_perceptions", "mentoring"],
    "gender_race_schemas": [
        "classroom_culture",
        "prior_perceptions",
        "current_phil_share",
        "peer_demographics",
        "instructor_demographics",
    ],
    "grade_diff": ["dmg", "prev_phil_course"],
    "instructor_log_total": ["course_division"],
    "instructor_demographics": ["instructor_log_total"],
    "logic_systematic_abstract": [
        "classroom_culture",
        "prior_perceptions",
        "current_phil_share",
        "peer_demographics",
        "instructor_demographics",
    ],
    "mean_grade": [
        "bias",
        "peer_demographics",
        "instructor_demographics",
        "current_phil_share",
        "instructor_log_total",
    ],
    "mentoring": ["instructor_demographics", "bias", "instructor_log_total"],
    "n_students": ["course_division", "instructor_log_total"],
    "other_major_student": ["other_major_share"],
    "other_major_share": ["course_division", "instructor_log_total"],
    "practical_major": ["class"],
    "undeclared_student": ["admission_type", "course_division", "other_major_student"],
    "peer_demographics": ["current_phil_share", "instructor_demographics"],
    "philosophy_person": [
        "prior_perceptions",
        "classroom_culture",
        "gender_race_schemas",
        "mentoring",
        "logic_systematic_abstract",
        "grade_diff",
        "field_spec_ability",
    ],
    "prev_phil_course": ["admission_type", "class", "undeclared_student"],
    "prior_perceptions": ["class"],
}

# Nodes that nobody measured.
LATENT = [
    "prev_phil_course",
    "classroom_culture",
    "field_spec_ability",
    "logic_systematic_abstract",
    "practical_major",
    "prior_perceptions",
    "philosophy_person",
    "mentoring",
    "gender_race_schemas",
    "bias",
]

# Measured nodes that only serve as controls.
MEASURED_CONTROLS = ["mean_grade", "other_major_share", "other_major_student"]

# Labels that are not the plain column name.
LABELS = {
    "current_phil_share": "current majors",
    "dmg": "GDMGG",
    "field_spec_ability": "field spec. ability",
    "grade_diff": "grade gap",
    "instructor_log_total": "inst. tot. students",
    "logic_systematic_abstract": "L-S-A identity",
    "n_students": "class size",
    "other_major_student": "soc.-bio.-hum. dev.",
    "other_major_share": "soc.-bio.-hum. dev. share",
    "undeclared_student": "undeclared",
    "prev_phil_course": "prev. phil. course",
}


def model_edges(spark: SparkSession, parents: Mapping[str, Sequence[str]] = PARENTS) -> DataFrame:
    rows = [(node, list(names)) for node, names in parents.items()]
    return edges_from_parents(
        spark.createDataFrame(rows, "node string, parents array<string>"), "node", "parents"
    )


def model_nodes(spark: SparkSession, edges: DataFrame) -> DataFrame:
    hidden = spark.createDataFrame([(n,) for n in LATENT], "name string")
    return labelled_nodes(node_table(edges, hidden), LABELS, OUTCOME, FOCAL, MEASURED_CONTROLS)


def control_sets(spark: SparkSession, focal: Sequence[str] = tuple(FOCAL)) -> dict[str, list[list[str]]]:
    """One sorted control set per focal variable, ready for the spec grid.

    A set may be empty: nothing then needs adjusting. A variable without a set, because it
    is not in the model or a latent cause can't be adjusted for, is refused.
    """
    nodes = {*PARENTS, *(p for names in PARENTS.values() for p in names)}
    if unknown := set(focal) - nodes:
        raise ValueError(f"no control set for {sorted(unknown)}: not in the causal model")
    edges = model_edges(spark)
    found, valid = adjustable(
        edges,
        node_table(edges, spark.createDataFrame([(n,) for n in LATENT], "name string")),
        spark.createDataFrame([(v,) for v in focal], "node string"),
        spark.createDataFrame([(OUTCOME,)], "node string"),
    )
    # at most one row per pair of nodes of the hand-written model
    rows = checked_controls(found, valid).groupBy("exposure").agg(F.sort_array(F.collect_set("control")).alias("c")).collect()
    sets = {r["exposure"]: [list(r["c"])] for r in rows}
    return {v: sets[v] for v in focal}


def checked_controls(found: DataFrame, valid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, exposure, control) of every exposure; NULL the control of one that needs none.

    ``found`` and ``valid`` are those of :func:`cohortlab.operators.graph.adjustable`. An
    exposure without a valid set is refused, for a collection of graphs too, and a few are named.
    """
    keys = [*by, "exposure"]
    if bare := valid.filter("NOT valid").select(*keys).limit(5).collect():
        raise ValueError(f"no control set for {[tuple(r) for r in bare]}")
    return valid.select(*keys).join(found, keys, "left")


def spec_controls(specs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, exposure, control) rows of a spec table: the main effects beside the focal variable.

    ``specs`` is :func:`cohortlab.models.spec.spec_table`; the controls that all
    models share come with them.
    """
    mains = F.filter("terms", lambda t: F.size(t) == 1)
    rows = specs.filter("formula = 'full'").select(*by, F.col("focal_var").alias("exposure"), F.explode(mains).alias("t"))
    return rows.select(*by, "exposure", F.col("t")[0].alias("control")).filter("control <> exposure").distinct()


def controls_table(
    pairs: DataFrame, levels: Sequence[str] | None, always: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by, exposure, control) rows to a table of X marks, some controls always on.

    Without ``levels`` every control of the rows is a column.
    """
    levels = levels_of(pairs, "control") if levels is None else levels
    wide = indicators(pairs, [*by, "exposure"], "control", levels)
    wide = wide.withColumns({c: F.lit(True) for c in always})
    return ticks(wide, [c for c in wide.columns if c not in (*by, "exposure")])

"""The model grid over the analysis table: split, fit, diagnose, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.numbers import deciles
from cohortlab.models.design import Design, build_design, variables_of
from cohortlab.models.diagnostics import (
    counted,
    curve_of,
    side_by_side,
    threshold_sensitivity,
)
from cohortlab.models.effects import (
    back_transformed,
    focal_effects,
    highlights,
    with_band,
    with_model_group,
)
from cohortlab.models.fits import (
    Fit,
    fit_sweep,
    model_areas,
    model_bin_counts,
    model_score_counts,
    score_models,
    tidy,
)
from cohortlab.models.spec import ModelSpec, spec_grid, spec_table
from cohortlab.models.split import stratified_split
from cohortlab.operators.joins import keyed_join
from cohortlab.operators.verbs import across, columns_like
from cohortlab.plans.dag import GENERAL_CONTROLS
from cohortlab.plans.registrar import Stages
from cohortlab.session import staged

# Variables a shorthand of the causal model stands for.
SHORTHANDS = {
    "class": ["low_income", "first_gen"],
    "peer_demographics": ["women_share", "poc_share"],
    "instructor_demographics": ["gender_instructor", "race_instructor"],
}

# Variables that enter as their decimal logarithm.
LOGS = ["n_students"]

# Reference levels.
FIRST_LEVELS = {
    "demographic": "M.White",
    "gender_instructor": "M",
    "race_instructor": "White",
}

# Model types per outcome.
MODEL_TYPES = {
    "ever_phil": ["lm", "logistic", "bias-reduced logistic"],
    "n_later_phil": ["Poisson", "hurdle"],
}

# Extra controls of an outcome.
OUTCOME_CONTROLS = {"n_later_phil": ["ever_phil"]}

# Which rootogram an outcome gets.
OUTCOME_KINDS = {"ever_phil": "binary", "n_later_phil": "count"}

# Reporting group of each focal variable.
COVAR_GROUPS = {
    "admission_type": "student background",
    "course_division": "curriculum",
    "first_gen": "student background",
    "low_income": "student background",
    "undeclared_student": "student background",
    "dmg": "grade gap",
    "grade_diff": "grade gap",
    "instructor_log_total": "instructor effects",
    "gender_instructor": "instructor effects",
    "race_instructor": "instructor effects",
    "current_phil_share": "peer effects",
    "n_students": "peer effects",
    "poc_share": "peer effects",
    "women_share": "peer effects",
}

# Readable label of each focal coefficient.
PROCESS_LABELS = {
    "admission_typeFreshman": "freshman admission",
    "course_divisionupper": "upper-division course",
    "first_genTRUE": "first-generation student",
    "low_incomeTRUE": "low income student",
    "undeclared_studentTRUE": "undeclared",
    "dmg": "group difference from mean grade gap",
    "grade_diff": "grade gap",
    "gender_instructorF": "woman vs. man instructor",
    "instructor_log_total": "instructor total students",
    "race_instructorAsian": "Asian vs. White instructor",
    "race_instructorBlack": "Black vs. White instructor",
    "current_phil_share": "current philosophy major share",
    "log10(n_students)": "course size",
    "poc_share": "POC student share",
    "women_share": "women student share",
}

# Focal variables of the short report.
HIGHLIGHTS = [
    "course_division",
    "admission_type",
    "current_phil_share",
    "poc_share",
    "women_share",
]

TEST_SHARE = 0.25


def model_table(analysis: DataFrame, faculty: DataFrame, division: DataFrame) -> DataFrame:
    """Analysis rows with instructor and course dimensions, shares as deciles."""
    df = keyed_join(analysis, faculty, ["instructor"], "left", suffixes=("", "_instructor"))
    df = keyed_join(df, division, ["title"], "left").withColumnRenamed("division", "course_division")
    df = df.filter(F.col("race_instructor").isNotNull() & F.col("course_division").isNotNull())
    return across(df, columns_like(df, "_share"), deciles)


def model_grid(control_sets: Mapping[str, Sequence[Sequence[str]]]) -> list[ModelSpec]:
    return spec_grid(
        control_sets, GENERAL_CONTROLS, SHORTHANDS, MODEL_TYPES, OUTCOME_CONTROLS, COVAR_GROUPS
    )


def grid_design(df: DataFrame, specs: Sequence[ModelSpec], keep: Sequence[str] = ()) -> Design:
    """The numeric table behind all specs."""
    names = sorted({v for s in specs for v in s.variables()})
    variables = variables_of(df, names, FIRST_LEVELS, LOGS)
    return build_design(df, variables, sorted({s.outcome for s in specs}), keep)


def coefficients(df: DataFrame, specs: Sequence[ModelSpec], fits: Mapping[str, Fit]) -> DataFrame:
    """Coefficient table with the spec's columns beside every term."""
    spark = df.sparkSession
    meta = spec_table(spark, specs).drop("terms")
    return tidy(spark, specs, fits).join(meta, "model_idx")


def process_label(column: str = "process"):
    out = F.lit(None).cast("string")
    for name, text in PROCESS_LABELS.items():
        out = F.when(F.col(column) == name, F.lit(text)).otherwise(out)
    return out


def report(coefs: DataFrame) -> DataFrame:
    """Focal effects of all models on one comparable scale, with bands."""
    effects = with_model_group(focal_effects(coefs)).withColumn("process", process_label())
    return with_band(back_transformed(effects))


def faculty_table(faculty: DataFrame) -> DataFrame:
    """Instructor dimension with the log of the students taught."""
    return faculty.withColumn("instructor_log_total", F.log10("n")).drop("n", "notes")


def of_outcome(specs: Sequence[ModelSpec], outcome: str) -> list[ModelSpec]:
    return [s for s in specs if s.outcome == outcome]


def roc_scores(design: Design, specs: Sequence[ModelSpec], fits: Mapping[str, Fit], outcome: str = "ever_phil") -> DataFrame:
    """Link-scale scores of all models of a binary outcome."""
    scores = score_models(design, of_outcome(specs, outcome), fits, outcome)
    return scores.withColumn("y", F.col("y") > 0.5)


def rootograms(design: Design, specs: Sequence[ModelSpec], fits: Mapping[str, Fit], outcome: str = "n_later_phil") -> DataFrame:
    """Observed and fitted counts of all models of a count outcome.

    Observed counts are those of all rows with an outcome, the same for every
    model; fitted ones are of all rows with the model's variables.
    """
    mine = of_outcome(specs, outcome)
    fitted = model_bin_counts(design, mine, fits, outcome)
    y = F.col(design.outcomes[outcome])
    observed = design.table.filter(y.isNotNull()).groupBy(y.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("observed"))
    names = F.explode(F.array(*[F.lit(s.model_idx) for s in mine])).alias("model_idx")
    return side_by_side(observed.select("*", names), fitted, ["model_idx", "bin"])


def run(
    df: DataFrame, specs: Sequence[ModelSpec], test_share: float = TEST_SHARE, seed: int = 2003
) -> Stages:
    """Split and fit a grid over the modelled rows; diagnoses and reports are made when asked for."""
    rows = staged(
        stratified_split(df, ["ever_phil", "demographic"], ["id", "course_id"], test_share, seed), "split"
    )
    design = grid_design(rows, specs, keep=["is_test"])
    train = replace(design, table=design.table.filter(~F.col("is_test")))
    test = replace(design, table=design.table.filter(F.col("is_test")))
    fits = fit_sweep(train, specs)
    coefs = coefficients(df, specs, fits)
    kinds = spec_table(df.sparkSession, specs).select("model_idx", "model_type")
    makers = {
        "coefficients": lambda: coefs,
        "estimates": lambda: report(coefs),
        "score_counts": lambda: counted(
            model_score_counts(train, of_outcome(specs, "ever_phil"), fits, "ever_phil"), ["model_idx"]
        ),
        "roc": lambda: curve_of(out["score_counts"], ["model_idx"]).join(kinds, "model_idx"),
        "auc": lambda: model_areas(train, of_outcome(specs, "ever_phil"), fits, "ever_phil"),
        "sensitivity": lambda: threshold_sensitivity(out["roc"], F.col("model_type") == "lm"),
        "rootograms": lambda: rootograms(test, specs, fits),
        "highlights": lambda: highlights(coefs, HIGHLIGHTS),
    }
    out = Stages(makers)
    return out

"""Model specifications as data: lists of terms instead of formula strings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.scans import sequence_number

GROUP = "demographic"


@dataclass(frozen=True)
class ModelSpec:
    """One model. A term is a tuple of variable names; two names interact."""

    model_idx: str
    outcome: str
    focal_var: str
    form: str
    model_type: str
    terms: tuple[tuple[str, ...], ...]
    covar_group: str | None = None

    @property
    def formula(self) -> tuple:
        """What is fitted; specs with equal formulas share one fit."""
        return (self.outcome, self.model_type, self.terms)

    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for term in self.terms for v in term))


def expand(names: Sequence[str], shorthands: Mapping[str, Sequence[str]]) -> list[str]:
    """Replace shorthand names by the variables they stand for."""
    return [v for name in names for v in shorthands.get(name, [name])]


def right_hand_side(
    controls: Sequence[str],
    general: Sequence[str],
    focal: Sequence[str],
    interaction: bool,
    extra: Sequence[str] = (),
    group: str = GROUP,
) -> tuple[tuple[str, ...], ...]:
    """Main effects in order of appearance, then focal-by-group interactions."""
    mains = [*controls, *general, *focal, *([group] if interaction else []), *extra]
    terms = [(v,) for v in dict.fromkeys(mains)]
    if interaction:
        terms += [(v, group) for v in focal]
    return tuple(terms)


def spec_grid(
    control_sets: Mapping[str, Sequence[Sequence[str]]],
    general: Sequence[str],
    shorthands: Mapping[str, Sequence[str]],
    model_types: Mapping[str, Sequence[str]],
    outcome_controls: Mapping[str, Sequence[str]] | None = None,
    covar_groups: Mapping[str, str] | None = None,
    forms: Sequence[str] = ("full", "interaction"),
) -> list[ModelSpec]:
    """Focal variable x control set x form x outcome x model type.

    A shorthand focal variable yields one spec per variable it stands for, all
    with the same terms.
    """
    outcome_controls = outcome_controls or {}
    covar_groups = covar_groups or {}
    rows = []
    for outcome, types in model_types.items():
        for name, sets in control_sets.items():
            focal = expand([name], shorthands)
            for controls in sets:
                for form in forms:
                    terms = right_hand_side(
                        expand(controls, shorthands),
                        general,
                        focal,
                        form == "interaction",
                        outcome_controls.get(outcome, ()),
                    )
                    for one in focal:
                        for kind in types:
                            rows.append((outcome, one, form, kind, terms))
    rows.sort(key=lambda r: (r[0], r[1]))
    return [
        ModelSpec(str(i + 1), outcome, one, form, kind, terms, covar_groups.get(one))
        for i, (outcome, one, form, kind, terms) in enumerate(rows)
    ]


def spec_frame(
    controls: DataFrame,
    by: Sequence[str],
    general: Sequence[str],
    shorthands: Mapping[str, Sequence[str]],
    model_types: Mapping[str, Sequence[str]],
    outcome_controls: Mapping[str, Sequence[str]] | None = None,
    covar_groups: Mapping[str, str] | None = None,
    forms: Sequence[str] = ("full", "interaction"),
    group: str = GROUP,
) -> DataFrame:
    """The grid of :func:`spec_grid` for every graph of a collection, as a table.

    ``controls`` has (by, exposure, control) rows, NULL the control of an exposure that
    needs none; each exposure has one set. The mappings are settings; nothing of the graphs
    reaches the driver. Models are numbered within their graph, in order of outcome, focal
    variable, exposure, form and model type.
    """
    spark = controls.sparkSession
    by = list(by)
    names = spark.createDataFrame(
        [(name, i, v) for name, some in shorthands.items() for i, v in enumerate(some)],
        "__name string, __place int, __variable string",
    )

    def expanded(rows: DataFrame, name: str) -> DataFrame:
        """A row per variable that ``name`` stands for."""
        out = rows.join(F.broadcast(names), F.col(name) == F.col("__name"), "left")
        return out.withColumns({"__variable": F.coalesce("__variable", name), "__place": F.coalesce("__place", F.lit(0))})

    def listed(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
        found = F.array_sort(F.collect_list(F.when(F.col("__variable").isNotNull(), F.struct(*order, "__variable"))))
        return rows.groupBy(*key).agg(F.transform(found, lambda s: s["__variable"]).alias(name))

    key = [*by, "exposure"]
    # one aggregate serves the sets and the exposures: their controls, in order
    sets = listed(expanded(controls.select(*key, "control").distinct(), "control"), key, ["control", "__place"], "__controls")
    marks = sets.withColumn("__focal_name", F.col("exposure"))
    focal = listed(expanded(marks, "__focal_name"), [*key, "__controls"], ["__place"], "__focal")

    kinds = F.array(
        *(
            F.struct(F.lit(outcome).alias("outcome"), F.lit(kind).alias("model_type"), F.lit(i).alias("kind_no"), F.lit(form).alias("formula"), F.lit(f).alias("form_no"))
            for outcome, some in model_types.items()
            for i, kind in enumerate(some)
            for f, form in enumerate(forms)
        )
    )
    rows = focal.select("*", F.explode("__focal").alias("focal_var")).select("*", F.explode(kinds).alias("__kind")).select("*", "__kind.*")
    crossed = F.col("formula") == "interaction"

    def texts(values: Sequence[str]):
        return F.array(*(F.lit(v) for v in values)).cast("array<string>")

    extra = texts([])
    for outcome, some in (outcome_controls or {}).items():
        extra = F.when(F.col("outcome") == outcome, texts(some)).otherwise(extra)
    mains = F.concat("__controls", texts(general), "__focal", F.when(crossed, texts([group])).otherwise(texts([])), extra)
    terms = F.concat(
        F.transform(F.array_distinct(mains), lambda v: F.array(v)),
        F.when(crossed, F.transform("__focal", lambda v: F.array(v, F.lit(group)))).otherwise(F.array().cast("array<array<string>>")),
    )
    covar = F.lit(None).cast("string")
    for name, text in (covar_groups or {}).items():
        covar = F.when(F.col("focal_var") == name, F.lit(text)).otherwise(covar)
    rows = rows.withColumns({"terms": terms, "covar_group": covar})
    order = ["outcome", "focal_var", "exposure", "form_no", "kind_no"]
    rows = sequence_number(rows, "__no", order, by, chunk=F.struct("outcome", "focal_var"))
    return rows.select(
        *by, F.col("__no").cast("string").alias("model_idx"), "outcome", "focal_var", "formula", "model_type", "covar_group", "terms"
    )


def spec_table(spark: SparkSession, specs: Sequence[ModelSpec]) -> DataFrame:
    """The specs as a small table, terms as an array of arrays."""
    rows = [
        (
            s.model_idx,
            s.outcome,
            s.focal_var,
            s.form,
            s.model_type,
            s.covar_group,
            [list(t) for t in s.terms],
        )
        for s in specs
    ]
    return spark.createDataFrame(
        rows,
        "model_idx string, outcome string, focal_var string, formula string, "
        "model_type string, covar_group string, terms array<array<string>>",
    )

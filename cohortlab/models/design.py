"""Design columns: treatment coding against a pinned reference level.

One numeric table holds the columns of every spec. Interactions are products
of its columns and are formed where they are used, so the table stays narrow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.models.spec import ModelSpec

@dataclass(frozen=True)
class Variable:
    """How a source column becomes design columns."""

    name: str
    kind: str  # "number", "log10", "flag" or "factor"
    levels: tuple[str, ...] = ()  # reference level first

    def columns(self) -> list[tuple[str, Column]]:
        x = F.col(self.name)
        if self.kind == "log10":
            return [(f"log10({self.name})", F.when(x > 0, F.log10(x.cast("double"))))]
        if self.kind == "flag":
            return [(f"{self.name}TRUE", x.cast("int").cast("double"))]
        if self.kind == "factor":
            return [
                (f"{self.name}{v}", (x.cast("string") == v).cast("int").cast("double"))
                for v in self.levels[1:]
            ]
        return [(self.name, x.cast("double"))]


#: Levels of a dense design's factors together, at most.
MOST_LEVELS = 10_000


def level_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, level): the known levels of text columns, one row each."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in names])
    return df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("level").isNotNull()).distinct()


def factor_levels(
    df: DataFrame, names: Sequence[str], first: Mapping[str, str] | None = None
) -> dict[str, tuple[str, ...]]:
    """Sorted levels of each factor with the pinned reference in front."""
    if not names:
        return {}
    first = first or {}
    # one row per level; every level becomes a design column, so more are refused here
    found: dict[str, list[str]] = {name: [] for name in names}
    for r in level_rows(df, names).limit(MOST_LEVELS + 1).collect():
        found[r["variable"]].append(r["level"])
    if sum(map(len, found.values())) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels in {sorted(names)}: use sparse_design, or is one of them a key?")
    out = {}
    for name in names:
        levels = sorted(found[name])
        ref = first.get(name)
        if ref is not None and ref in levels:
            levels = [ref, *[v for v in levels if v != ref]]
        out[name] = tuple(levels)
    return out


def variables_of(
    df: DataFrame,
    names: Sequence[str],
    first: Mapping[str, str] | None = None,
    logs: Sequence[str] = (),
) -> dict[str, Variable]:
    """Variable per source column, its kind read from the column type."""
    kinds = {}
    for name in names:
        t = df.schema[name].dataType
        if name in logs:
            kinds[name] = "log10"
        elif isinstance(t, T.BooleanType):
            kinds[name] = "flag"
        elif isinstance(t, T.StringType):
            kinds[name] = "factor"
        else:
            kinds[name] = "number"
    levels = factor_levels(df, [n for n, k in kinds.items() if k == "factor"], first)
    return {n: Variable(n, k, levels.get(n, ())) for n, k in kinds.items()}


@dataclass(frozen=True)
class Design:
    """The numeric table and where each design column lives in it."""

    table: DataFrame
    slots: Mapping[str, tuple[tuple[str, int], ...]]  # variable -> (label, index)
    outcomes: Mapping[str, str]  # outcome -> column
    width: int

    def columns_for(self, spec: ModelSpec) -> list[tuple[str, tuple[int, ...]]]:
        """(label, base column indices to multiply); the intercept comes first."""
        out: list[tuple[str, tuple[int, ...]]] = [("(Intercept)", ())]
        for term in spec.terms:
            for combo in product(*[self.slots[v] for v in term]):
                out.append((":".join(c[0] for c in combo), tuple(c[1] for c in combo)))
        return out

    def term(self, indices: tuple[int, ...]) -> Column:
        out = F.lit(1.0)
        for i in indices:
            out = out * F.col(f"x{i}")
        return out


def build_design(
    df: DataFrame, variables: Mapping[str, Variable], outcomes: Sequence[str], keep: Sequence[str] = ()
) -> Design:
    """Base columns ``x0, x1, ...`` and one ``y_`` column per outcome."""
    slots, exprs = {}, []
    for name, var in variables.items():
        here = []
        for label, expr in var.columns():
            here.append((label, len(exprs)))
            exprs.append(expr.alias(f"x{len(exprs)}"))
        slots[name] = tuple(here)
    ys = {o: f"y_{o}" for o in outcomes}

    def number(o: str) -> Column:
        c = F.col(o)
        if isinstance(df.schema[o].dataType, T.BooleanType):
            c = c.cast("int")
        return c.cast("double").alias(ys[o])

    table = df.select(*keep, *exprs, *[number(o) for o in outcomes])
    return Design(table, slots, ys, len(exprs))


def complete_cases(design: Design, specs: Sequence[ModelSpec]) -> DataFrame:
    """Rows each spec can use and its number of design columns, in one pass."""
    cells = []
    for s in specs:
        cols = design.columns_for(s)
        used = sorted({i for _, idx in cols for i in idx})
        test = F.col(design.outcomes[s.outcome]).isNotNull()
        for i in used:
            test = test & F.col(f"x{i}").isNotNull()
        cells.append(
            F.struct(
                F.lit(s.model_idx).alias("model_idx"),
                F.lit(len(cols)).alias("n_columns"),
                F.count_if(test).alias("n_rows"),
            )
        )
    one = design.table.agg(*[c.alias(f"s{i}") for i, c in enumerate(cells)])
    return one.select(F.explode(F.array(*[f"s{i}" for i in range(len(cells))])).alias("c")).select("c.*")

"""A grid of formulas fitted in every group of a table, for any number of groups.

The sweep of `fits` keeps one model object per formula on the driver. Here the models are
rows: (group, component, state), a component being a part of one of the formulas, and
neither a group nor its coefficients reach the driver.

1. Equal rows of a group become one with a weight, so repeated rows cost nothing more.
2. The distinct rows of a group are packed into blocks of about ``BLOCK`` rows. A large
   group has many blocks and a small one has one, so no task holds a group as a whole. The
   blocks are stored once, bucketed by (group, block).
3. A round joins the states to the blocks (the blocks stay where they are, the states are
   dealt to their buckets, or broadcast by Spark where they are small), turns each block
   into a vector of sums, adds the vectors by group, and moves each group's model by its
   total. Models that are done leave the next round, which costs what the others need.

The sums and steps are the kernels of the sweep, so both fit alike.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.models.design import Variable, build_design, variables_of
from cohortlab.models.fits import FITTERS
from cohortlab.models.kernels import Block, Model
from cohortlab.models.spec import ModelSpec
from cohortlab.session import run_folder, staged

BLOCK = 2048
#: Rows that cost as much as one more call of a kernel.
CALL = 256
KEY = ["__group", "__component"]


def _key(by: Sequence[str]):
    """The group columns as one text; unknown values are left out, which tells them from all others."""
    return F.to_json(F.struct(*by))


def pack(rows: DataFrame, by: Sequence[str], x: Sequence[str], y: str | Sequence[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, groups) of the rows that have an outcome; which of them a model can use, its kernel sees.

    ``blocks`` is (__group, __block, cells), cells an array<struct<x, y, w>>; ``groups`` is
    (__group, by, __blocks), one row per group.
    """
    ys = [y] if isinstance(y, str) else list(y)
    known = rows.select(*by, *x, *ys).dropna("all", subset=ys)
    tagged = known.select(_key(by).alias("__group"), *by, F.array(*x).cast("array<double>").alias("x"), F.array(*ys).cast("array<double>").alias("y"))
    cells = staged(tagged.groupBy("__group", *by, "x", "y").agg(F.count("*").cast("double").alias("w")), "cells")
    sizes = cells.groupBy("__group", *by).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    groups = staged(sizes, "groups")
    dealt = cells.join(groups.select("__group", "__blocks"), "__group")
    dealt = dealt.withColumn("__block", F.pmod(F.xxhash64("x", "y"), F.col("__blocks")).cast("int"))
    blocks = dealt.groupBy("__group", "__block").agg(F.collect_list(F.struct("x", "y", "w")).alias("cells"))
    return blocks, groups


class _Bucketed:
    """Blocks stored once, in as many buckets as shuffles have partitions; the table's name goes when done."""

    def __init__(self, blocks: DataFrame):
        spark = blocks.sparkSession
        self.spark, self.name = spark, f"cohortlab_{uuid.uuid4().hex}"
        buckets, on = int(spark.conf.get("spark.sql.shuffle.partitions")), ["__group", "__block"]
        # dealt like the buckets, so every task writes one file
        dealt = blocks.repartition(buckets, *on)
        path = f"{run_folder(spark)}/{self.name}"
        dealt.write.bucketBy(buckets, *on).sortBy(*on).option("path", path).saveAsTable(self.name)

    def __enter__(self) -> DataFrame:
        return self.spark.table(self.name)

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _dump(model: Model) -> bytes:
    """A model's plain values; its class is known by the component."""
    return pickle.dumps(vars(model))


def _load(kind: type[Model], state: bytes) -> Model:
    model = kind.__new__(kind)
    vars(model).update(pickle.loads(state))
    return model


def parts_of(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[float, tuple[np.ndarray, np.ndarray]]]:
    """Weighted rows as (weight, rows) parts: the sums of a row repeated w times are w times its own.

    Rows of one weight are a part, but a call of a kernel costs as much as ``CALL`` rows: where
    repeating them is cheaper, they are repeated together with all others of which that holds.
    """
    values, at, n = np.unique(w, return_inverse=True, return_counts=True)
    repeated = (values * n <= n + CALL)[at]
    out = [(float(values[k]), (x[at == k], y[at == k])) for k in np.unique(at[~repeated])]
    if repeated.any():
        times = w[repeated].astype(np.int64)
        out.append((1.0, (np.repeat(x[repeated], times, axis=0), np.repeat(y[repeated], times, axis=0))))
    return out


def _sums(kinds: Sequence[type[Model]], outcomes: Sequence[str]):
    """Task function: blocks with a model's state to its vector of sums."""

    def run(batches):
        for batch in batches:
            cells = batch.column("cells")
            ends = np.concatenate([[0], np.cumsum(np.asarray(cells.value_lengths(), np.int64))])
            flat = cells.flatten()
            w = flat.field("w").to_numpy(zero_copy_only=False)
            x, y = (flat.field(c).flatten().to_numpy(zero_copy_only=False) for c in "xy")
            x, y = (a.reshape(len(w), len(a) // max(1, len(w))) for a in (x, y))
            sums = []
            for k, (component, state) in enumerate(zip(batch.column("__component").to_pylist(), batch.column("state").to_pylist())):
                model, mine = _load(kinds[component], state), slice(ends[k], ends[k + 1])
                total = np.zeros(model.size())
                for times, part in parts_of(x[mine], y[mine], w[mine]):
                    with np.errstate(all="ignore"):
                        total += times * model.local(Block(list(part[0].T), dict(zip(outcomes, part[1].T))))
                sums.append(total.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__group"), batch.column("__component"), pa.array(sums, pa.list_(pa.float64()))], names=[*KEY, "sums"]
            )

    return run


def _advance(kinds: Sequence[type[Model]]):
    """Task function: states with their total sums to the states of the next round."""

    def run(batches):
        for batch in batches:
            states, done = [], []
            for component, state, total in zip(*(batch.column(c).to_pylist() for c in ("__component", "state", "sums"))):
                model = _load(kinds[component], state)
                if total[0]:
                    with np.errstate(all="ignore"):
                        model.advance(np.asarray(total))
                else:  # not one row that it can use
                    model.n, model.done = 0.0, True
                states.append(_dump(model))
                done.append(bool(model.done))
            columns = [batch.column(c) for c in (*KEY, "__blocks")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(states, pa.binary()), pa.array(done)], names=[*KEY, "__blocks", "state", "done"])

    return run


STATE = "__group string, __component int, __blocks int, state binary, done boolean"


def fit_packed(blocks: DataFrame, groups: DataFrame, starts: Sequence[Model], outcomes: Sequence[str]) -> DataFrame:
    """(__group, __component, state) of every group once all its models are done."""
    kinds = [type(m) for m in starts]
    first = F.array(*(F.lit(bytearray(_dump(m))) for m in starts))
    live = groups.select("__group", F.posexplode(first).alias("__component", "state"), "__blocks").withColumn("done", F.lit(False))
    live = staged(live.select(*KEY, "__blocks", "state", "done"), "states")
    done = None
    with _Bucketed(blocks) as stored:
        while True:
            spread = live.select(*KEY, "state", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"))
            sums = stored.join(spread, ["__group", "__block"]).mapInArrow(_sums(kinds, outcomes), "__group string, __component int, sums array<double>")
            total = sums.groupBy(*KEY).agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
            moved = live.join(total.select(*KEY, vector_to_array("sums").alias("sums")), KEY)
            moved = staged(moved.mapInArrow(_advance(kinds), STATE), "states")
            ended = moved.where("done")
            done = ended if done is None else done.unionByName(ended)
            live = moved.where("NOT done")
            if live.isEmpty():
                return done.select(*KEY, "state")


def _terms(kinds: Sequence[type[Model]]):
    """Task function: states to one row per coefficient."""
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.string()]
    names = [*KEY, "term_idx", "term", "estimate", "se", "n_rows", "converged", "status"]

    def run(batches):
        for batch in batches:
            rows = []
            for group, component, state in zip(*(batch.column(c).to_pylist() for c in (*KEY, "state"))):
                model = _load(kinds[component], state)
                if not model.n:
                    continue
                for i, (term, estimate, se) in enumerate(model.results()):
                    rows.append((group, component, i, term, estimate, se, int(model.n), bool(model.converged), model.status))
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def sweep_groups(
    df: DataFrame, by: Sequence[str], specs: Sequence[ModelSpec], variables: Mapping[str, Variable] | None = None, block: int = BLOCK
) -> DataFrame:
    """Coefficients of all specs in every group: by, model_idx, hurdle_component, term_idx, term, estimate, se, n_rows, converged, status.

    A model leaves out rows in which a variable or outcome of its own is missing; one
    without a complete row in a group has no rows there. Specs of one formula share a fit.
    Factor levels are those of the whole table; in a group that lacks one its term is
    aliased and left out, like any spanned column. All models of a group go through its
    blocks together, so a sweep costs as many rounds as its slowest model.
    """
    if unknown := {s.model_type for s in specs} - set(FITTERS):
        raise ValueError(f"unknown model type: {sorted(unknown)}")
    variables = variables or variables_of(df, list(dict.fromkeys(v for s in specs for v in s.variables())))
    design = build_design(df, variables, sorted({s.outcome for s in specs}), keep=by)
    starts: list[Model] = []
    named: list[list[tuple[str, str | None]]] = []  # the specs and parts that each model serves
    places: dict[tuple, list[int]] = {}
    for s in specs:
        parts = FITTERS[s.model_type]
        if s.formula not in places:
            columns = design.columns_for(s)
            places[s.formula] = list(range(len(starts), len(starts) + len(parts)))
            starts += [kind([c[0] for c in columns], [c[1] for c in columns], design.outcomes[s.outcome]) for kind in parts.values()]
            named += [[] for _ in parts]
        for place, part in zip(places[s.formula], parts):
            named[place].append((s.model_idx, part))
    ys = sorted(design.outcomes.values())
    blocks, groups = pack(design.table, by, [f"x{i}" for i in range(design.width)], ys, block)
    states = fit_packed(blocks, groups, starts, ys)
    schema = "__group string, __component int, term_idx int, term string, estimate double, se double, n_rows long, converged boolean, status string"
    out = states.mapInArrow(_terms([type(m) for m in starts]), schema)
    serves = [(place, idx, part) for place, some in enumerate(named) for idx, part in some]
    names = df.sparkSession.createDataFrame(serves, "__component int, model_idx string, hurdle_component string")
    out = out.join(F.broadcast(names), "__component")  # as many rows as specs
    return groups.join(out, "__group").select(*by, "model_idx", "hurdle_component", "term_idx", "term", "estimate", "se", "n_rows", "converged", "status")


def fit_groups(
    df: DataFrame, by: Sequence[str], spec: ModelSpec, variables: Mapping[str, Variable] | None = None, block: int = BLOCK
) -> DataFrame:
    """:func:`sweep_groups` of one spec, without its number."""
    return sweep_groups(df, by, [spec], variables, block).drop("model_idx")

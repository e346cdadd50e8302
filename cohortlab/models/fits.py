"""Fit many models in lockstep: each round is one scan for all of them.

Tasks turn their rows into one short vector of sums per model; Spark adds the
vectors; the driver, which only ever sees the sums, moves the coefficients.
Models that have settled drop out of the next round. A sweep therefore costs
as many scans as its slowest model has rounds, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.models.design import Design
from cohortlab.models.kernels import (
    BiasReduced,
    Block,
    Glm,
    Linear,
    Logistic,
    Model,
    Poisson,
    Positive,
    TruncatedCount,
    predict,
)
from cohortlab.models.spec import ModelSpec
from cohortlab.session import staged

# Model type -> component -> model. A new type is one more entry.
FITTERS: dict[str, dict[str | None, type[Model]]] = {
    "lm": {None: Linear},
    "logistic": {None: Logistic},
    "bias-reduced logistic": {None: BiasReduced},
    "Poisson": {None: Poisson},
    "hurdle": {"count": TruncatedCount, "zero": Positive},
}

FAN_IN = 64
ROUND_SUMS = 20_000_000  # numbers that reach the driver at once, unless one model has more
BLOCK_ROWS = 2048  # a block of design rows stays in a core's cache
CHUNK_ROWS = 1 << 16  # rows whose scores are counted together before they are sent
PART_ROWS = 1 << 21  # rows whose scores of one fit meet in a task
CUT_ROWS = 20_000  # rows off which the cuts between such parts are read


@dataclass
class Fit:
    """A fitted formula: its component models and the design behind them."""

    spec: ModelSpec
    parts: dict[str | None, Model]

    def link(self, design: Design, component: str | None = None) -> Column:
        """Linear predictor as a column expression over the design table."""
        model = self.parts[component]
        out = F.lit(0.0)
        for j, b in zip(model.keep, model.beta):
            out = out + F.lit(float(b)) * design.term(tuple(model.columns[j]))
        return out

    def response(self, design: Design) -> Column:
        """Expected outcome as a column expression over the design table."""
        kind = self.spec.model_type
        if kind == "lm":
            return self.link(design)
        if kind == "Poisson":
            return F.exp(self.link(design))
        if kind == "hurdle":
            pi = 1.0 / (1.0 + F.exp(-self.link(design, "zero")))
            mu = F.exp(self.link(design, "count"))
            theta = float(np.exp(self.parts["count"].log_theta))
            return pi * mu / -F.expm1(-F.lit(theta) * F.log1p(mu / F.lit(theta)))
        return 1.0 / (1.0 + F.exp(-self.link(design)))

    def score(self, design: Design) -> Column:
        """What diagnostics rank on: the link scale, or the mean of a count model."""
        return self.response(design) if self.spec.model_type == "hurdle" else self.link(design)


def _local_sums(models: dict[int, Model], names: Sequence[str], width: int):
    """Task function: batches of the design table to one vector per model."""

    def run(batches):
        sums = {k: np.zeros(m.size()) for k, m in models.items()}
        # models of one design one after the other
        ordered = sorted(models.items(), key=lambda x: (x[1].terms(), x[1].y))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = [c[i : i + BLOCK_ROWS] for c in columns]
                block = Block(part[:width], dict(zip(names, part[width:])))
                with np.errstate(all="ignore"):
                    for k, m in ordered:
                        sums[k] += m.local(block)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64())),
            ],
            names=["model", "sums"],
        )

    return run


def _add_up(partial: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Add the vectors per model, in two levels."""
    salt = F.pmod(F.spark_partition_id(), F.lit(int(np.ceil(tasks / FAN_IN))))
    out = partial.withColumn("v", array_to_vector("sums")).withColumn("salt", salt)
    out = out.groupBy("model", "salt").agg(Summarizer.sum(F.col("v")).alias("v"))
    out = out.groupBy("model").agg(Summarizer.sum(F.col("v")).alias("v"))
    rows = out.select("model", vector_to_array("v").alias("v")).collect()
    return {r["model"]: np.asarray(r["v"]) for r in rows}


def run_lockstep(table: DataFrame, width: int, models: Sequence[Model]) -> None:
    """Advance all models together until each one is done.

    Models whose sums are more than a driver should hold at once take turns.
    """
    turns, held = [[]], 0
    for m in models:
        if turns[-1] and held + m.size() > ROUND_SUMS:
            turns.append([])
            held = 0
        turns[-1].append(m)
        held += m.size()
    if len(turns) > 1:
        for some in turns:
            run_lockstep(table, width, some)
        return
    names = sorted({m.y for m in models})
    source = table.select(*[f"x{i}" for i in range(width)], *names)
    tasks = source.rdd.getNumPartitions()
    while True:
        live = {k: m for k, m in enumerate(models) if not m.done}
        if not live:
            return
        partial = source.mapInArrow(_local_sums(live, names, width), "model int, sums array<double>")
        for k, total in _add_up(partial, tasks).items():
            models[k].advance(total)


def fit_sweep(design: Design, specs: Sequence[ModelSpec], stage: bool = True) -> dict[str, Fit]:
    """Fit every distinct formula once and hand the fit to all its specs.

    The design table is written once to the shared folder and scanned per
    round; ``stage=False`` is for a table that is stored already.
    """
    unknown = {s.model_type for s in specs} - set(FITTERS)
    if unknown:
        raise ValueError(f"unknown model type: {sorted(unknown)}")
    fits: dict[tuple, Fit] = {}
    for s in specs:
        if s.formula in fits:
            continue
        columns = design.columns_for(s)
        parts = {
            component: kind([c[0] for c in columns], [c[1] for c in columns], design.outcomes[s.outcome])
            for component, kind in FITTERS[s.model_type].items()
        }
        fits[s.formula] = Fit(s, parts)
    ys = sorted({design.outcomes[s.outcome] for s in specs})
    table = design.table.select(*[f"x{i}" for i in range(design.width)], *ys)
    if stage:
        table = staged(table, "design", spread=True)
    run_lockstep(table, design.width, [m for f in fits.values() for m in f.parts.values()])
    return {s.model_idx: fits[s.formula] for s in specs}


def score_models(
    design: Design, specs: Sequence[ModelSpec], fits: dict[str, Fit], outcome: str, response: bool = False
) -> DataFrame:
    """Scores of many models for every complete row: model_idx, score, y.

    One scan serves all models and specs that share a formula share the work;
    rows with a missing variable or outcome are left out per model. Scores are
    on the link scale, or expected outcomes with ``response``.
    """
    y = design.outcomes[outcome]
    names = [f"x{i}" for i in range(design.width)]
    distinct: dict[int, tuple[Fit, list[str]]] = {}
    for s in specs:
        if s.outcome != outcome:
            raise ValueError(f"model {s.model_idx} is not a model of {outcome}")
        fit = fits[s.model_idx]
        distinct.setdefault(id(fit), (fit, []))[1].append(s.model_idx)
    jobs = [(fit.spec.model_type, fit.parts, ids) for fit, ids in distinct.values()]

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            block = Block(columns[:-1], {y: columns[-1]})
            seen = np.isfinite(columns[-1])
            for kind, parts, ids in jobs:
                with np.errstate(all="ignore"):
                    score, ok = predict(kind, parts, block, response)
                ok = ok & seen
                for idx in ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([idx] * int(ok.sum())), pa.array(score[ok]), pa.array(columns[-1][ok])],
                        names=["model_idx", "score", "y"],
                    )

    return design.table.select(*names, y).mapInArrow(run, "model_idx string, score double, y double")


def _jobs(specs: Sequence[ModelSpec], fits: dict[str, Fit], outcome: str):
    """The distinct fits of an outcome's specs, and which models each serves."""
    distinct: dict[int, tuple[Fit, list[str]]] = {}
    for s in specs:
        if s.outcome != outcome:
            raise ValueError(f"model {s.model_idx} is not a model of {outcome}")
        fit = fits[s.model_idx]
        distinct.setdefault(id(fit), (fit, []))[1].append(s.model_idx)
    return [(fit.spec.model_type, fit.parts) for fit, _ in distinct.values()], [ids for _, ids in distinct.values()]


def _per_model(counts: DataFrame, ids: Sequence[Sequence[str]]) -> DataFrame:
    """Counts per fit to counts per model that the fit serves."""
    named = F.array(*[F.array(*[F.lit(i) for i in some]) for some in ids])
    out = counts.withColumn("model_idx", F.explode(F.get(named, F.col("fit"))))
    return out.select("model_idx", *[c for c in counts.columns if c != "fit"])


def model_score_counts(
    design: Design, specs: Sequence[ModelSpec], fits: dict[str, Fit], outcome: str
) -> DataFrame:
    """(model_idx, threshold, pos, neg): positives and negatives per distinct score.

    Each block of rows is reduced to its distinct scores where it is scored, so
    rows x models never exist; specs that share a fit share the counts.
    """
    y, names = design.outcomes[outcome], [f"x{i}" for i in range(design.width)]
    jobs, ids = _jobs(specs, fits, outcome)

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            block, truth = Block(columns[:-1], {y: columns[-1]}), columns[-1]
            for k, (kind, parts) in enumerate(jobs):
                with np.errstate(all="ignore"):
                    score, ok = predict(kind, parts, block, False)
                ok = ok & np.isfinite(truth)
                values, at = np.unique(score[ok], return_inverse=True)
                pos = np.bincount(at, truth[ok] > 0.5, len(values)).astype(np.int64)
                rows = np.bincount(at, minlength=len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(pos), pa.array(rows - pos)],
                    names=["fit", "threshold", "pos", "neg"],
                )

    counts = design.table.select(*names, y).mapInArrow(run, "fit int, threshold double, pos long, neg long")
    counts = counts.groupBy("fit", "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _per_model(counts, ids)


def _score_cuts(design: Design, scored, fits: int, y: str) -> list[np.ndarray]:
    """Where the scores of each fit are cut into parts of about ``PART_ROWS`` rows.

    The cuts are read off some of the rows. They say where a score is counted and not what is
    counted, so they don't change an area.
    """
    rows = design.table.count()
    parts = -(-rows // PART_ROWS)
    if parts < 2:
        return [np.zeros(0)] * fits
    some = design.table.sample(min(1.0, CUT_ROWS / rows), seed=1).select(*[f"x{i}" for i in range(design.width)], y)

    def run(batches):
        for k, score, _ in scored(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([score.tobytes()], pa.binary())], names=["fit", "scores"])

    found: list[list[np.ndarray]] = [[] for _ in range(fits)]
    for r in some.mapInArrow(run, "fit int, scores binary").collect():
        found[r["fit"]].append(np.frombuffer(r["scores"]))
    out = []
    for scores in found:
        known = np.sort(np.concatenate(scores)) if scores else np.zeros(0)
        known = known[np.isfinite(known)]
        out.append(np.unique(known[np.arange(1, parts) * len(known) // parts]) if len(known) else known)
    return out


def model_areas(design: Design, specs: Sequence[ModelSpec], fits: dict[str, Fit], outcome: str) -> DataFrame:
    """(model_idx, auc): areas under the curves of all models, from every distinct score.

    What ``area_of`` the score counts is, without a row for a score: tasks turn ``CHUNK_ROWS``
    rows into the distinct scores of each fit with their positives and negatives, packed by part
    of the scores; a part is merged where it meets, and of it only its sums go on.
    """
    y, names = design.outcomes[outcome], [f"x{i}" for i in range(design.width)]
    jobs, ids = _jobs(specs, fits, outcome)

    def scored(batches):
        """(fit, scores, positives) of the rows that each fit can use."""
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = [c[at : at + BLOCK_ROWS] for c in columns]
                block, truth = Block(part[:-1], {y: part[-1]}), part[-1]
                seen = np.isfinite(truth)
                for k, (kind, parts) in enumerate(jobs):
                    with np.errstate(all="ignore"):
                        score, ok = predict(kind, parts, block, False)
                    ok = ok & seen
                    yield k, score[ok], truth[ok] > 0.5

    cuts = _score_cuts(design, scored, len(jobs), y)

    def counts(batches):
        held: list[list] = [[] for _ in jobs]
        rows = 0

        def packed():
            sent = []
            for k, chunks in enumerate(held):
                if not chunks:
                    continue
                score, truth = (np.concatenate(x) for x in zip(*chunks))
                chunks.clear()
                values, pos, neg = _counted_scores(score, truth.astype(np.int64), (~truth).astype(np.int64))
                ends = np.concatenate([[0], np.searchsorted(values, cuts[k], side="right"), [len(values)]])
                for part, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                    if a < b:
                        sent.append((k, part, values[a:b].tobytes(), pos[a:b].astype(np.uint32).tobytes(), neg[a:b].astype(np.uint32).tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sent), kinds)], names=["fit", "part", "score", "pos", "neg"])

        for k, score, truth in scored(batches):
            if k == 0 and rows >= CHUNK_ROWS:
                yield packed()
                rows = 0
            rows += len(score) if k == 0 else 0
            if len(score):
                held[k].append((score, truth))
        if any(held):
            yield packed()

    def sums(met: pa.Table) -> pa.Table:
        kinds = {"score": np.float64, "pos": np.uint32, "neg": np.uint32}
        score, pos, neg = (np.concatenate([np.frombuffer(b, t) for b in met.column(c).to_pylist()]) for c, t in kinds.items())
        _, pos, neg = _counted_scores(score, pos, neg)
        below = np.cumsum(neg) - neg
        pairs = float((pos * (below + neg / 2)).sum())
        return pa.table({"fit": met.column("fit")[:1], "part": met.column("part")[:1], "pairs": [pairs], "pos": pa.array([int(pos.sum())]), "neg": pa.array([int(neg.sum())])})

    sent = design.table.select(*names, y).mapInArrow(counts, "fit int, part int, score binary, pos binary, neg binary")
    by_part = sent.groupBy("fit", "part").applyInArrow(sums, "fit int, part int, pairs double, pos long, neg long")
    # a few rows a fit: the sums of its parts in order
    below = F.sum("neg").over(Window.partitionBy("fit").orderBy("part")) - F.col("neg")
    whole = by_part.withColumn("pairs", F.col("pairs") + F.col("pos") * below).groupBy("fit")
    size = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return _per_model(whole.agg(F.try_divide(F.sum("pairs"), size).alias("auc")), ids)


def _counted_scores(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores in order with the sums of their counts."""
    order = np.argsort(score, kind="stable")
    score = score[order]
    first = np.flatnonzero(np.concatenate([[True], (score[1:] != score[:-1]) & ~np.isnan(score[:-1])])) if len(score) else np.zeros(0, np.int64)
    pos, neg = (np.add.reduceat(x[order], first, dtype=np.int64) if len(x) else x.astype(np.int64) for x in (pos, neg))
    return score[first], pos, neg


def model_bin_counts(
    design: Design, specs: Sequence[ModelSpec], fits: dict[str, Fit], outcome: str
) -> DataFrame:
    """(model_idx, bin, fitted): rows per expected outcome, rounded half down.

    A fitted value needs the model's variables, not the outcome.
    """
    names = [f"x{i}" for i in range(design.width)]
    jobs, ids = _jobs(specs, fits, outcome)

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            block = Block(columns, {outcome: columns[0]})
            for k, (kind, parts) in enumerate(jobs):
                with np.errstate(all="ignore"):
                    score, ok = predict(kind, parts, block, True)
                bins, n = np.unique(np.ceil(score[ok & np.isfinite(score)] - 0.5).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), k, np.int32)), pa.array(bins), pa.array(n.astype(np.int64))],
                    names=["fit", "bin", "fitted"],
                )

    counts = design.table.select(*names).mapInArrow(run, "fit int, bin long, fitted long")
    return _per_model(counts.groupBy("fit", "bin").agg(F.sum("fitted").alias("fitted")), ids)


def fitted_sums(design: Design, specs: Sequence[ModelSpec], fits: dict[str, Fit]) -> DataFrame:
    """(model_idx, hurdle_component, term, fitted): sums of fitted means times every design column.

    Over the rows a model was fitted on. Where the link is canonical (least squares,
    logistic, Poisson, the zero part of a hurdle) the maximum is where they equal the sums
    of the outcome; models of another kind are left out. One scan serves all models.
    """
    jobs: list[tuple[Model, list[str], str | None]] = []
    seen: dict[int, int] = {}
    for s in specs:
        for component, model in fits[s.model_idx].parts.items():
            if isinstance(model, BiasReduced) or not isinstance(model, (Linear, Logistic, Poisson)):
                continue
            if id(model) not in seen:
                seen[id(model)] = len(jobs)
                jobs.append((model, [], component))
            jobs[seen[id(model)]][1].append(s.model_idx)
    jobs.sort(key=lambda job: (job[0].columns, job[0].y))  # models of one design one after the other
    names, ys = [f"x{i}" for i in range(design.width)], sorted({m.y for m, _, _ in jobs})

    def run(batches):
        sums = [np.zeros(len(m.columns)) for m, _, _ in jobs]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = [c[at : at + BLOCK_ROWS] for c in columns]
                block = Block(part[: len(names)], dict(zip(ys, part[len(names) :])))
                for k, (model, _, _) in enumerate(jobs):
                    a, _, _ = block.rows(tuple(model.columns), model.y, model.outcome)
                    eta = model.beta @ (a if len(model.keep) == len(a) else a[model.keep])
                    sums[k] += a @ (model.mean(eta) if isinstance(model, Glm) else eta)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(jobs)), pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["model", "sums"]
        )

    def named(batches):
        for batch in batches:
            rows = []
            for k, sums in zip(batch.column("model").to_pylist(), batch.column("sums").to_pylist()):
                model, ids, component = jobs[k]
                rows += [(idx, component, label, value) for idx in ids for label, value in zip(model.labels, sums)]
            types = (pa.string(), pa.string(), pa.string(), pa.float64())
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["model_idx", "hurdle_component", "term", "fitted"])

    parts = design.table.select(*names, *ys).mapInArrow(run, "model int, sums array<double>")
    total = parts.groupBy("model").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).select("model", vector_to_array("sums").alias("sums"))
    return total.mapInArrow(named, "model_idx string, hurdle_component string, term string, fitted double")


def tidy(spark: SparkSession, specs: Sequence[ModelSpec], fits: dict[str, Fit]) -> DataFrame:
    """Coefficient table of a sweep, in design order within each component."""
    rows = []
    for s in specs:
        for component, model in fits[s.model_idx].parts.items():
            for i, (term, estimate, se) in enumerate(model.results()):
                rows.append(
                    (s.model_idx, component, i, term, estimate, se, int(model.n), bool(model.converged), model.status)
                )
    return spark.createDataFrame(
        rows,
        "model_idx string, hurdle_component string, term_idx int, term string, "
        "estimate double, se double, n_rows long, converged boolean, status string",
    )


def baseline_covariances(
    spark: SparkSession, specs: Sequence[ModelSpec], fits: dict[str, Fit], group: str = "demographic"
) -> DataFrame:
    """Covariance of each interaction coefficient with its focal main effect."""
    rows = []
    for s in specs:
        for component, model in fits[s.model_idx].parts.items():
            place = {model.labels[j]: i for i, j in enumerate(model.keep)}
            for label, i in place.items():
                bits = label.split(":")
                main = [b for b in bits if group not in b]
                if len(bits) > 1 and main and main[0] in place:
                    rows.append((s.model_idx, component, label, float(model.cov[i, place[main[0]]])))
    return spark.createDataFrame(
        rows, "model_idx string, hurdle_component string, term string, cov_base double"
    )

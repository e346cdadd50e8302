"""Neighbour search against all inner products."""

import numpy as np
import pytest
from conftest import TESTDATA

from cohortlab.llm import neighbours


def exact(rows, k, step):
    """(query, rank, id, score) over valid rows, summed in order of the components."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = []
    for q in np.flatnonzero(ids % step == 0):
        score = np.zeros(len(v))
        for d in range(v.shape[1]):
            score = score + v[q, d] * v[:, d]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("scale", [0.0, 3.0])
def test_wide_reach_is_exact_with_ties_and_lengths(spark, scale, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 6)) * (1 + scale * rng.random((400, 1)))
    v[50:150] = v[50]  # equal vectors
    v[200:260] = np.round(v[200:260])  # equal scores
    v = v[(v != 0).any(axis=1)]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(neighbours.nearest(df, "id % 7 = 0", 5, reach=50.0)) == exact(rows, 5, 7)
    monkeypatch.setattr(neighbours, "LIST_CHUNK", 8)
    assert found(neighbours.nearest(df, "id % 7 = 0", 5, reach=50.0)) == exact(rows, 5, 7)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (7, [0.5, 0.5]), (14, [0.0, -1.0])]
    bad = [(21, None), (28, []), (35, [0.0, 0.0]), (42, [1.0, None]), (49, [nan, 1.0]), (56, [inf, 1.0]), (None, [1.0, 1.0]), (63, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*good, *good, *bad]], "vec_id long, embedding array<float>, list int")
    assert found(neighbours.nearest(df, "id % 7 = 0", 20)) == exact(good, 20, 7)
    assert found(neighbours.nearest(df.limit(0), "id % 7 = 0", 20)) == []
    assert found(neighbours.nearest(df.where("vec_id = 0"), "id % 7 = 0", 20)) == []


def test_recall(spark):
    df = spark.read.parquet(TESTDATA.replace("0.001", "0.01") + "/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, true = found(neighbours.nearest(df, "id % 20 = 0", 20)), exact(rows, 20, 20)
    assert len(got) == len(true)
    pairs = {(q, i) for q, _, i, _ in got}
    assert sum((q, i) in pairs for q, _, i, _ in true) >= 0.9 * len(true)
    score = {(q, i): s for q, _, i, s in exact(rows, len(rows), 20)}
    assert all(score[q, i] == s for q, _, i, s in got)


def clustered(rng, clusters, each, dim, spread):
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.repeat(centres, each, axis=0) + spread * rng.normal(size=(clusters * each, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["clusters", "tight clusters", "skewed norms"])
def test_recall_and_whole_results_on_other_shapes(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "skewed norms":
        v = rng.normal(size=(2000, 16)) * np.exp(rng.normal(size=(2000, 1)))
    else:
        v = clustered(rng, 200, 10, 16, 0.1 if kind == "clusters" else 0.001)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v[rng.permutation(len(v))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, true = found(neighbours.nearest(df, "id % 20 = 0", 20)), exact(rows, 20, 20)
    assert len(got) == len(true) == 100 * 20
    pairs = {(q, i) for q, _, i, _ in got}
    assert sum((q, i) in pairs for q, _, i, _ in true) >= 0.9 * len(true)


def test_dimensions_are_tables_of_their_own_and_hot_lists_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(6)
    short = [(2 * i, [float(x) for x in rng.normal(size=3)]) for i in range(150)]
    long = [(2 * i + 1, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    df = spark.createDataFrame(short + long, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "QUERY_CHUNK", 4)
    monkeypatch.setattr(neighbours, "LIST_CHUNK", 8)
    got = found(neighbours.nearest(df, "id % 3 = 0", 4, reach=50.0))
    assert got == sorted(exact(short, 4, 3) + exact(long, 4, 3))

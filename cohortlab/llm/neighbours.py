"""Operator 6: nearest neighbours from balanced posting lists.

1. Equal vectors are one row with their smallest ids (more can't be among the nearest).
2. Centroids come from a bounded sample by balanced bisection: every half has as many
   vectors, so lists are of like size. Their number is the square root of the number of
   vectors, ``MAX_LISTS`` at most. The largest inner product becomes the least distance by
   one more coordinate that brings all vectors to the same norm.
3. A centroid graph, small enough to be broadcast, finds the nearest centroids of a vector
   best first. Vectors near a border are in several lists: the nearest ``REPLICAS`` whose
   distance is within ``BORDER`` times the least.
4. A query goes through the lists from its nearest centroid on until they are home to
   ``HOMES`` times k + 1 vectors, and reads on to ``REACH`` times that distance. So it finds k where there
   are k, and small clusters widen the search to the next ones. Long lists are cut into
   chunks, and so are many queries of one list; a chunk is one matrix product, and the best
   of each are merged. Scores are summed in double precision in order of the components.

Cases: vectors null, empty, zero or with null or non-finite components take no part;
vectors of different dimensions are tables of their own, as they have no inner product;
ties go to the smaller id; rows with one id repeated count once; an empty table gives an
empty one; other columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import staged

MAX_LISTS = 4096
SAMPLE_PER_LIST = 16
LIST_CHUNK = 8192
QUERY_CHUNK = 8192
DEGREE = 24
BORDER, REPLICAS = 1.1, 8
REACH = 1.15
#: The lists that a query goes through are home to this many times the vectors asked for.
HOMES = 4


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vec): the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & fine & F.exists("vec", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vid, vec, ids): equal vectors as one row with the ``keep`` smallest ids.

    Two levels, so that no task sees more than about the square root of a hot group.
    """
    parts = max(1, math.isqrt(rows.count() // keep))
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep)
    some = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(least(F.collect_list("id")).alias("ids"))
    every = some.groupBy("vec").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    return every.select(F.col("ids")[0].alias("vid"), "vec", "ids")


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` parts of like size, by bisection along the direction that two means differ in."""
    if lists <= 1 or len(sample) <= 1:
        return sample.mean(axis=0, keepdims=True)
    rng = np.random.default_rng(len(sample))
    a, b = sample[rng.choice(len(sample), 2, replace=False)]
    for _ in range(6):
        side = ((sample - a) ** 2).sum(1) <= ((sample - b) ** 2).sum(1)
        if side.all() or not side.any():
            break
        a, b = sample[side].mean(0), sample[~side].mean(0)
    order, left = np.argsort(sample @ (a - b), kind="stable"), lists // 2
    cut = len(sample) * left // lists
    return np.concatenate([balanced_centroids(sample[order[:cut]], left), balanced_centroids(sample[order[cut:]], lists - left)])


class CentroidGraph:
    """Nearest centroids by best-first search over a neighbour graph, many vectors at a time."""

    def __init__(self, centroids: np.ndarray, top: float, edges: np.ndarray | None = None):
        self.centroids, self.top = centroids, top
        if edges is None:
            gaps = _distances(centroids, centroids)
            near = np.argsort(gaps, axis=1, kind="stable")[:, 1 : DEGREE + 1]
            ring = (np.arange(len(centroids))[:, None] + 1) % len(centroids)  # keeps the graph connected
            edges = np.concatenate([near, ring], axis=1)
        self.edges = edges

    def plain(self) -> tuple:
        """What it is made of, to be sent to the tasks: a broadcast of this class would need the package there."""
        return self.centroids, self.top, self.edges

    def raised(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """With the coordinate that turns the inner product into a distance."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.top**2 - (vectors**2).sum(1)))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def nearest(self, x: np.ndarray, ratio: float, sizes: np.ndarray | None = None, need: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroids, distances, bounds): nearest first, infinite where the search did not go.

        It goes on from the nearest centroid not yet gone on from, while that is within
        ``ratio`` times the least distance found. With ``sizes``, the vectors at home in each
        list, it goes on until those are ``need``, and then to the bound: ``ratio`` times the
        distance within which they are.
        """
        found = np.full((len(x), len(self.centroids)), np.inf)
        done = np.zeros(found.shape, bool)
        entry = np.arange(0, len(self.centroids), max(1, math.isqrt(len(self.centroids))))
        found[:, entry] = _distances(x, self.centroids[entry])

        def search(rows: np.ndarray, goes_on) -> None:
            while len(rows):
                open_ = np.where(done[rows], np.inf, found[rows])
                node = open_.argmin(axis=1)
                gap = open_[np.arange(len(rows)), node]
                go = goes_on(rows, gap) & np.isfinite(gap)
                rows, node = rows[go], node[go]
                done[rows, node] = True
                ends = self.edges[node]
                found[rows[:, None], ends] = ((x[rows][:, None, :] - self.centroids[ends]) ** 2).sum(2)

        every = np.arange(len(x))
        search(every, lambda rows, gap: gap <= ratio**2 * found[rows].min(axis=1))
        reach = found.min(axis=1)
        if sizes is not None:
            search(every[done @ sizes < need], lambda rows, gap: done[rows] @ sizes < need)
            known = np.where(done, found, np.inf)
            order = np.argsort(known, axis=1, kind="stable")
            enough = (np.cumsum(np.where(np.isfinite(np.take_along_axis(known, order, axis=1)), sizes[order], 0), axis=1) >= need).argmax(axis=1)
            at = np.take_along_axis(known, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
            # without enough vectors in all lists, every list is within the bound
            at = np.where(done @ sizes < need, np.inf, at)
            reach = np.maximum(reach, at)
            search(every, lambda rows, gap: gap <= ratio**2 * reach[rows])
        order = np.argsort(found, axis=1, kind="stable")
        return order, np.sqrt(np.take_along_axis(found, order, axis=1)), ratio * np.sqrt(reach)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1))


def fit(distinct: DataFrame) -> CentroidGraph | None:
    """The centroids of a sample of ``SAMPLE_PER_LIST`` vectors a list, smallest hashes first."""
    size = distinct.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not size[0]:
        return None
    lists, top = min(MAX_LISTS, max(1, math.isqrt(size[0]))), math.sqrt(size[1])
    sample = distinct.select("vec").orderBy(F.xxhash64("vec")).limit(lists * SAMPLE_PER_LIST).toPandas()["vec"]
    sample = np.array(sample.tolist())
    graph = CentroidGraph(np.zeros((1, sample.shape[1] + 1)), top)
    return CentroidGraph(balanced_centroids(graph.raised(sample, False), lists), top)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(graph, ratio: float, sizes=None, need: int = 0):
    """The lists of each vector: those that hold it, or with ``sizes`` those that a query reads."""

    def run(batches):
        index, query = CentroidGraph(*graph.value), sizes is not None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = index.raised(_matrix(part.column("vec")), query)
                near, gap, bounds = index.nearest(x, ratio, sizes.value if query else None, need)
                keep = (gap <= bounds[:, None]) & np.isfinite(gap)
                if not query:
                    keep[:, REPLICAS:] = False
                lists = pa.array([row[k].tolist() for row, k in zip(near, keep)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "lists"])

    return run


def _score(k: int):
    """The best k + 1 ids of one chunk for each query that reads it."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({"vid": pa.array([], pa.int64()), "best": pa.array([], BEST)})
        if not queries.num_rows or not rows.num_rows:
            return empty
        q, v = _matrix(queries.column("vec")), _matrix(rows.column("vec"))
        ids, first = rows.column("ids").to_pylist(), rows.column("vid").to_numpy()
        out = []
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            rough = part @ v.T
            take = min(k + 5, len(v))
            near = np.argpartition(-rough, take - 1, axis=1)[:, :take]
            if take < len(v):  # rows as good as the last one taken, but for rounding, count too
                edge = np.take_along_axis(rough, near, axis=1).min(axis=1) - 1e-9 * (1 + np.abs(rough).max(axis=1))
                wide = (rough >= edge[:, None]).sum(1).max()
                near = np.argpartition(-rough, min(wide, len(v)) - 1, axis=1)[:, :wide]
            exact = np.zeros(near.shape)
            for d in range(q.shape[1]):
                exact += part[:, d : d + 1] * v[near, d]
            order = np.lexsort((first[near], -exact), axis=1)[:, : k + 1]
            for row in range(len(part)):
                pairs = [(-exact[row, j], i) for j in order[row].tolist() for i in ids[near[row, j]]]
                out.append([{"lost": s, "id": i} for s, i in sorted(pairs)[: k + 1]])
        return pa.table({"vid": queries.column("vid"), "best": pa.array(out, BEST)})

    return run


BEST = pa.list_(pa.struct([("lost", pa.float64()), ("id", pa.int64())]))


def nearest(vectors: DataFrame, is_query, k: int, vec_id: str = "vec_id", embedding: str = "embedding", reach: float = REACH, border: float = BORDER) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is a query.

    ``is_query`` is a condition on column ``id``.
    """
    rows = staged(valid(vectors, vec_id, embedding), "vectors")
    dims = sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect())
    found = [_nearest_alike(rows.where(F.size("vec") == d), is_query, k, reach, border) for d in dims]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest_alike(rows: DataFrame, is_query, k: int, reach: float, border: float) -> DataFrame:
    """The search among vectors of one dimension."""
    sc = rows.sparkSession.sparkContext
    distinct = staged(distinct_vectors(rows, k + 1), "distinct")
    index = fit(distinct)
    graph = sc.broadcast(index.plain())
    lists = "vid long, vec array<double>, ids array<bigint>, lists array<int>"
    held = staged(distinct.mapInArrow(_lists(graph, border), lists), "held")
    # every vector has one home, so the homes of some lists are different vectors
    homes = np.zeros(len(index.centroids))
    for r in held.groupBy(F.col("lists")[0].alias("list")).agg(F.sum(F.size("ids")).alias("n")).collect():
        homes[r["list"]] = r["n"]
    sizes = sc.broadcast(homes)
    postings = held.select("vid", "vec", "ids", F.explode("lists").alias("list"))
    chunks = postings.groupBy("list").agg(F.ceil(F.count("*") / LIST_CHUNK).cast("int").alias("chunks"))
    cut = postings.join(F.broadcast(chunks), "list")  # MAX_LISTS rows at most
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")).drop("chunks")

    asked = rows.where(is_query)
    queries = asked.select("vec").distinct().join(distinct.select("vec", "vid"), "vec")
    reads = queries.select("vid", "vec").mapInArrow(_lists(graph, reach, sizes, HOMES * (k + 1)), "vid long, vec array<double>, lists array<int>")
    reads = staged(reads.select("vid", "vec", F.explode("lists").alias("list")), "reads")
    # a list that many queries read is given to several groups of them
    groups = reads.groupBy("list").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("groups"))
    sides = F.broadcast(chunks.join(F.broadcast(groups), "list"))  # MAX_LISTS rows at most
    reads = reads.join(sides, "list").withColumn("group", F.pmod(F.xxhash64("vid"), F.col("groups")).cast("int"))
    reads = reads.select("vid", "vec", "list", "group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    cut = cut.join(F.broadcast(groups), "list").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    at = ["list", "chunk", "group"]
    scored = reads.groupBy(*at).cogroup(cut.groupBy(*at)).applyInArrow(_score(k), "vid long, best array<struct<lost: double, id: bigint>>")
    # a vector is in REPLICAS lists at most, so that often among the best found
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, (k + 1) * REPLICAS)
    merged = scored.groupBy("vid").agg(F.slice(F.array_distinct(best), 1, k + 1).alias("best"))
    by_id = asked.distinct().join(distinct.select("vec", "vid"), "vec").select(F.col("id").alias("query_id"), "vid")
    mine = by_id.join(merged, "vid").select("query_id", F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k).alias("best"))
    out = mine.select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.lost")).alias("score"))

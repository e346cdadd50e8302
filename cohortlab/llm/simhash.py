"""Operator 8: SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within ``radius`` bits are linked. Two fingerprints within 2t bits share a
variant at most t bits from each, so each distinct fingerprint emits all variants within
half the radius, and fingerprints meet on equal variants. An odd radius leaves one bit
over: the 64 bits are split into ``BLOCKS`` blocks, and for each block variants are
emitted of the fingerprint without that block. Of r = 2t + 1 differing bits at least one
lies in some block, and without it 2t at most remain: every pair meets.

Meeting fingerprints are verified; from each bucket goes a spanning forest of its links
and not all pairs, which leaves the components the same. A bucket holds distinct
fingerprints of one small ball without a block: at most 49 x 2**16 for the values here.
Copies share one fingerprint and so one row, however many they are.

Cases: null and empty texts have the fingerprint zero and are linked like any other; a
text shorter than a shingle is one shingle; repeated rows and equal ids are one node.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import slices, text_bytes
from cohortlab.llm.components import components
from cohortlab.llm.decontamination import _LOWER
from cohortlab.llm.hashing import word_spans
from cohortlab.session import staged

BLOCKS = 4
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view("<u8")[0])


def _texts(column, words: int):
    """The fingerprint of each text."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, owner = word_spans(~_SPACE[data], offsets)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    # the words end to end with one blank between: shingles are slices of it
    sizes = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.full(begin[-1], 32, np.uint8)
    keep = np.ones(begin[-1], bool)
    keep[begin[1:] - 1] = False
    joined[keep] = data[~_SPACE[data]]
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    for row in range(len(offsets) - 1):
        first, stop = int(bounds[row]), int(bounds[row + 1])
        n = min(words, stop - first)
        if not n:
            yield 0
            continue
        a, b = begin[first : stop - n + 1].tolist(), (begin[first + n : stop + 1] - 1).tolist()
        yield _fingerprint(np.fromiter((digest(view[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a)))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed 64-bit number, in place of ``text``."""
    docs = docs.drop("fp")
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in slices(batches):
            fp = np.fromiter(_texts(batch.column("text"), words), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fp.view(np.int64))], names=schema.names)

    return docs.select(*rest, "text").mapInArrow(run, schema)


def _masks(radius: int) -> list[tuple[np.uint64, np.uint64, np.ndarray]]:
    """For each block that is left out: the bits kept, its tag, and the flips."""
    if radius % 2 == 0:
        left_out = [(0, 0)]
    else:
        wide = 64 // BLOCKS
        left_out = [(((1 << wide) - 1) << (wide * b), (b + 1) << (wide * b)) for b in range(BLOCKS)]
    out = []
    for block, tag in left_out:
        free = [i for i in range(64) if not block >> i & 1]
        flips = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(free, k)]
        out.append((np.uint64(~block & (1 << 64) - 1), np.uint64(tag), np.array(flips, np.uint64)))
    return out


def _variants(radius: int):
    def run(batches):
        masks = _masks(radius)
        each = sum(len(m[2]) for m in masks)
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, (1 << 20) // each)):
                fp = batch.column("fp").to_numpy()[at : at + max(1, (1 << 20) // each)].view(np.uint64)
                keys = np.concatenate([((fp & keep)[:, None] ^ flips[None, :]) | tag for keep, tag, flips in masks], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, each).view(np.int64))], names=["variant", "fp"])

    return run


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``radius`` among these fingerprints."""
    left, links = fps, []
    while len(left):
        # grow one component from its first member
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            node, front = front[0], front[1:]
            near = np.bitwise_count(left ^ node) <= radius
            links.extend((int(node), int(x)) for x in left[near].tolist())
            front = np.concatenate([front, left[near]])
            left = left[~near]
    return links


def _links(radius: int):
    """Verified links between fingerprints of equal variants; batches are sorted by variant."""

    def run(batches):
        kept = None
        for batch in batches:
            variant, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("variant", "fp"))
            if kept is not None:
                variant, fp = np.concatenate([kept[0], variant]), np.concatenate([kept[1], fp])
            # the last variant may go on in the next batch
            cut = int(np.searchsorted(variant.view(np.int64), variant.view(np.int64)[-1])) if len(variant) else 0
            kept = variant[cut:], fp[cut:]
            yield found(variant[:cut], fp[:cut])
        if kept is not None:
            yield found(*kept)

    def found(variant, fp):
        same = variant[1:] == variant[:-1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2] + 1
        two = stops - starts == 2
        a, b = fp[starts[two]], fp[starts[two] + 1]
        near = np.bitwise_count(a ^ b) <= radius
        u, v = [a[near]], [b[near]]
        for i, j in zip(starts[~two].tolist(), stops[~two].tolist()):
            if links := _forest(fp[i:j], radius):
                x = np.array(links, np.uint64)
                u.append(x[:, 0])
                v.append(x[:, 1])
        u, v = np.concatenate(u), np.concatenate(v)
        pairs = np.unique(np.stack([u, v], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return run


def linked(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links whose components are those of all links; ``fps`` are distinct."""
    variants = fps.select("fp").mapInArrow(_variants(radius), "variant long, fp long")
    dealt = variants.repartition("variant").sortWithinPartitions("variant")
    return dealt.mapInArrow(_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` without text, with ``fp`` and ``component_id``, the least ``doc_id`` reachable.

    A null ``doc_id`` names no component: its rows get that of the others with linked
    fingerprints, or null where there are none.
    """
    marked = staged(fingerprints(docs, words), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    links = linked(nodes, radius)
    parts = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "fp"))
    names = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    by_fp = labelled.select("fp", "component").join(names, "component").drop("component")
    return marked.drop("component_id").join(by_fp, "fp")

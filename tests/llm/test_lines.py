"""Line dedup: the perfect hash, and the lines against plain Python."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import line_dedup


def test_perfect_hash_gives_every_key_a_slot():
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        hashed = line_dedup.PerfectHash.of(keys)
        again = line_dedup.PerfectHash.unpacked(*hashed.packed())
        assert sorted(again.slots(keys)) == list(range(n))
        other = again.slots(keys + np.uint64(1))
        assert ((other >= -1) & (other < max(n, 1))).all()


def test_hash_is_the_one_of_the_session(spark):
    for key in ("", "a line", "ß and 漢"):
        row = spark.range(1).select(F.xxhash64(F.lit(key)), F.xxhash64(F.lit(1), F.lit(key))).first()
        assert tuple(row) == line_dedup.key_hash(key)


@pytest.mark.parametrize("shard_keys, block_docs", [(8192, 4000), (3, 2)])
def test_lines_against_plain_python(spark, shard_keys, block_docs):
    rng = random.Random(4)
    pool = ["Common  line", " common  LINE\t", "", "  ", "ÄB", "äb", "rare", "x", *(f"n{i}" for i in range(30))]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(60)] + [None, "", "\n", "\n\n", "x\n" * 500]
    rows = [(i, t, "b", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_lines int")
    out = line_dedup.dedup_lines(docs, min_docs=10, shard_keys=shard_keys, block_docs=block_docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()}
    assert got == dict(enumerate(brute.lines(texts)))


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "same\nown 1")] * 10 + [(None, "same"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(docs, min_docs=10).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_text) for r in out) == sorted(brute.lines([t for _, t in rows]))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0

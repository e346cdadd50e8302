"""Operator 4: line dedup through a sharded minimal perfect hash.

1. Every distinct line key (trimmed, A-Z lowered) is a 128-bit hash with the number of
   documents that have it; partial sums absorb lines that are in most documents.
2. Keys are dealt to shards by hash. A shard is one row: a minimal perfect hash (levels
   of bit arrays), and by its slots a 32-bit fingerprint and a count array.
3. Documents are dealt to blocks. A block sends each distinct key once to the key's
   shard, which probes its arrays and answers with the slots at or over the threshold.
   A line in a third of all documents is one probe per block, so no shard is hot.
4. Each block drops the lines whose key came back.

Cases: null and empty text is one empty line; an empty key (blank line) stays unless
``min_chars`` is 0; every row counts as a document, repeated ones too; other columns pass
through.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import LOWER, SPACES, UPPER, lowered
from cohortlab.session import staged

#: Distinct keys of a shard, on average.
SHARD_KEYS = 8_192
#: Documents of a block, on average.
BLOCK_DOCS = 2_000
_TO_LOWER = str.maketrans(UPPER, LOWER)


def line_key(line: str) -> str:
    return line.strip(SPACES).translate(_TO_LOWER)


_SECOND_SEED = xxhash.xxh64_intdigest(struct.pack("<i", 1), 42)


def key_hash(key: str) -> tuple[int, int]:
    """The two signed halves that ``xxhash64(key)`` and ``xxhash64(1, key)`` give in Spark."""
    raw = key.encode()
    return tuple(h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(raw, 42), xxhash.xxh64_intdigest(raw, _SECOND_SEED)))


def _mixed(h1: np.ndarray, level: int) -> np.ndarray:
    """Another hash of each key for each level."""
    x = h1 ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys.

    Level by level, keys alone in their place of a bit array of twice as many bits are
    placed; the others go on to the next level. The slot of a key is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits, dtype=np.int64) - bits)
            total += int(bits.sum())
        self.size = total

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            n = 2 * len(left) + 1
            at = (_mixed(left, len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for a key that is surely not of the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (_mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def packed(self) -> tuple[list[int], list[bytes]]:
        return [len(b) for b in self.levels], [np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def unpacked(cls, sizes, blobs) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in zip(sizes, blobs)])


SHARD = "shard int, sizes array<int>, bits array<binary>, fingerprints binary, counts binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    # ties in the first half of the hash get their own keys by mixing in the second half
    keys = _both(pdf)
    hashed = PerfectHash.of(keys)
    slots = hashed.slots(keys)
    prints, counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
    prints[slots] = pdf["h2"].to_numpy().astype(np.uint64).astype(np.uint32)
    counts[slots] = pdf["n_docs"].to_numpy()
    sizes, bits = hashed.packed()
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "sizes": [sizes], "bits": [bits], "fingerprints": [prints.tobytes()], "counts": [counts.tobytes()]})


def _both(pdf: pd.DataFrame) -> np.ndarray:
    h1, h2 = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
    return h1 ^ (h2 * np.uint64(0xD6E8FEB86659FD93))


def _probe(min_docs: int):
    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        row = shard.iloc[0]
        slots = PerfectHash.unpacked(row["sizes"], row["bits"]).slots(_both(asked))
        prints, counts = np.frombuffer(row["fingerprints"], np.uint32), np.frombuffer(row["counts"], np.int64)
        hit = (slots >= 0) & (prints[slots] == asked["h2"].to_numpy().astype(np.uint64).astype(np.uint32))
        hit &= counts[slots] >= min_docs
        return asked.loc[hit, ["block", "h1", "h2"]]

    return run


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(block, h1, h2): one row per document and distinct line key that may be dropped."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    keys = F.transform(lines, lambda line: lowered(F.btrim(line, F.lit(SPACES))))
    hashes = F.transform(
        F.filter(keys, lambda k: F.length(k) >= min_chars),
        lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")),
    )
    return docs.select("block", F.explode(F.array_distinct(hashes)).alias("h")).select("block", "h.h1", "h.h2")


def index(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its minimal perfect hash with fingerprint and count arrays."""
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    counted = counted.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    return counted.groupBy("shard").applyInPandas(_build, SHARD)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_keys: int = SHARD_KEYS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` in place of ``text``.

    Lines whose key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents go, in every document.
    """
    docs = docs.drop("block", "kept_text", "n_lines", "n_dropped")
    blocks = max(12, -(-docs.count() // block_docs))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    lines = staged(keyed_lines(docs, min_chars), "line_hashes")
    shards = max(1, -(-lines.select(F.approx_count_distinct("h1")).first()[0] // shard_keys))
    arrays = index(lines.select("h1", "h2"), shards)
    asked = lines.distinct().withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    answered = (
        asked.groupBy("shard")
        .cogroup(arrays.groupBy("shard"))
        .applyInPandas(_probe(min_docs), "block int, h1 long, h2 long")
    )
    fields = [f for f in docs.schema.fields if f.name not in ("text", "block")]
    out = T.StructType([*fields, *T._parse_datatype_string("kept_text string, n_lines long, n_dropped long").fields])
    names = [f.name for f in fields]
    return docs.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_without(names), out)


def _without(names: list[str]):
    """Drop the lines of a block's documents whose key the shards answered."""

    def run(docs: pa.Table, answered: pa.Table) -> pa.Table:
        gone = set(zip(answered.column("h1").to_pylist(), answered.column("h2").to_pylist()))
        kept, n_lines, n_dropped, seen = [], [], [], {}
        for text in docs.column("text").to_pylist():
            lines = (text or "").split("\n")
            stay = lines
            if gone:
                stay = []
                for line in lines:
                    key = line_key(line)
                    if (drop := seen.get(key)) is None:
                        drop = seen[key] = key_hash(key) in gone
                    if not drop:
                        stay.append(line)
            kept.append("\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        made = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        return pa.Table.from_arrays([*(docs.column(n) for n in names), *made], names=[*names, "kept_text", "n_lines", "n_dropped"])

    return run

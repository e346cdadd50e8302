"""Operator 9: benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (a shorter item is one window). A
document that holds a window holds all its shingles, so also its *rarest* one: that one
is the window's prefix, the only token it needs in the join.

1. One pass counts the benchmark's shingles over all documents; windows with a shingle
   that no document has cannot occur and go.
2. A second pass lists where documents have prefix shingles, with the words around.
3. These places join the windows on the shingle. The shingle's offset in the window gives
   the only place where the window can lie (positional bound), it must end within the
   text (length bound), and its words are compared exactly.

Both passes look tokens up in a bit array of ``FILTER_BITS`` bits, whatever the size of
the benchmark; false hits only cost work. Hot shingles are dealt out by a salt.

Cases: null and empty texts have no words; items without words are never found; repeated
rows of either table are judged each by itself; other columns of documents pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import slices, text_bytes
from cohortlab.llm.hashing import mixed, span_hashes, word_spans
from cohortlab.session import staged

#: Bits of the broadcast filter: 2 MB.
FILTER_BITS = 1 << 24
#: Parts that the places of one shingle are dealt to.
SALT = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _words(column):
    """Lowered bytes, word spans, and for each text its first word and one past its last."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, owner = word_spans(_WORD[data], offsets)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    return data, starts, ends, bounds


def _shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``size`` words within one text."""
    n = max(0, len(hashes) - size + 1)
    joined = np.full(n, size, np.uint64)
    for k in range(size):
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    inside = np.ones(n, bool)
    for k in range(1, size):
        cut = bounds[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return at, joined[at]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)) & np.uint64(FILTER_BITS - 1)


def _maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


WINDOWS = "item_id {id}, words array<string>, shingles array<struct<h: bigint, at: int>>"


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row per window of each item: its words and shingles with their offsets."""

    def run(batches):
        for batch in slices(batches):
            data, starts, ends, bounds = _words(batch.column("text"))
            hashes, raw = span_hashes(data, starts, ends), data.tobytes()
            by_size = {}
            for size in range(1, shingle + 1):
                at, h = _shingles(hashes, bounds, size)
                by_size[size] = dict(zip(at.tolist(), _signed(h).tolist()))
            ids, words, shingles = [], [], []
            for row, item in enumerate(batch.column("item_id").to_pylist()):
                first, stop = int(bounds[row]), int(bounds[row + 1])
                n = min(window, stop - first)
                size = min(shingle, n)
                for w in range(first, stop - n + 1) if n else ():
                    ids.append(item)
                    words.append([raw[starts[k] : ends[k]].decode() for k in range(w, w + n)])
                    shingles.append([{"h": by_size[size][k], "at": k - w} for k in range(w, w + n - size + 1)])
            kinds = [batch.schema.field("item_id").type, pa.list_(pa.string()), pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((ids, words, shingles), kinds)], names=["item_id", "words", "shingles"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, WINDOWS.format(id=kind))


def _filter(hashes: DataFrame):
    """A broadcast bit array of the hashes in column ``h``."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_bit(batch.column("h").to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in hashes.select("h").mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits.tobytes())


def _counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """How often the documents have each shingle of the filter."""

    def run(batches):
        known = np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches):
            data, starts, ends, bounds = _words(batch.column("text"))
            hashes = span_hashes(data, starts, ends)
            found = [h[_maybe(known, h)] for h in (_shingles(hashes, bounds, s)[1] for s in sizes)]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


PLACES = "n_words long, places array<struct<h: bigint, pos: int, left: int, around: array<string>>>"


def _places(docs: DataFrame, bits, sizes: list[int], window: int) -> DataFrame:
    """Each document's word count and its prefix shingles with the words around them."""
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*docs.select(*rest).schema.fields, *T._parse_datatype_string(PLACES).fields])
    place = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("around", pa.list_(pa.string()))])

    def run(batches):
        known = np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches):
            data, starts, ends, bounds = _words(batch.column("text"))
            hashes, raw = span_hashes(data, starts, ends), data.tobytes()
            found = [[] for _ in range(batch.num_rows)]
            for size in sizes:
                at, h = _shingles(hashes, bounds, size)
                hit = _maybe(known, h)
                owner = np.searchsorted(bounds, at[hit], side="right") - 1
                for row, k, value in zip(owner.tolist(), at[hit].tolist(), _signed(h[hit]).tolist()):
                    first, stop = int(bounds[row]), int(bounds[row + 1])
                    a, b = max(first, k - window + size), min(stop, k + window)
                    around = [raw[starts[j] : ends[j]].decode() for j in range(a, b)]
                    found[row].append({"h": value, "pos": k - first, "left": k - a, "around": around})
            n_words = pa.array(np.diff(bounds).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), n_words, pa.array(found, pa.list_(place))], names=schema.names)

    return docs.select(*rest, "text").mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """``docs`` without text, with ``n_words``, ``hits`` and ``items``.

    ``hits`` are the (start, words) places of windows in word numbers, ``items`` the ids of
    the items with a window in the document; both are empty for a clean document. ``items``
    (the table) has ``item_id`` and ``text``.
    """
    docs = docs.drop("n_words", "places", "hits", "items", "row")
    wins = staged(item_windows(items, window, shingle), "windows")
    size = F.least(F.size("words"), F.lit(shingle))
    sizes = sorted(r[0] for r in wins.select(size).distinct().collect())  # at most `shingle` numbers
    exploded = wins.groupBy("words").agg(F.first("shingles").alias("shingles")).select("words", F.explode("shingles").alias("s")).select("words", "s.h", "s.at")
    counts = _counts(docs, _filter(exploded), sizes) if sizes else None
    if counts is None:
        counts = docs.sparkSession.createDataFrame([], "h long, n long")
    rarest = exploded.join(counts, "h").groupBy("words").agg(F.min(F.struct("n", "h", "at")).alias("p"), F.count("*").alias("found"))
    # a shingle without a count is in no document, so its window isn't either
    rarest = rarest.where(F.col("found") == F.greatest(F.lit(1), F.size("words") - shingle + 1))
    holders = wins.groupBy("words").agg(F.collect_set("item_id").alias("ids"))
    prefixes = staged(rarest.join(holders, "words").select("p.h", "p.at", "words", "ids"), "prefixes")
    scanned = staged(_places(docs, _filter(prefixes), sizes, window).withColumn("row", F.monotonically_increasing_id()), "places")

    places = scanned.select("row", F.explode("places").alias("p")).select("row", "p.*").withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int"))
    salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    begin, long = F.col("left") - F.col("at"), F.size("words")
    fits = (begin >= 0) & (begin + long <= F.size("around"))
    same = F.when(fits, F.slice("around", F.greatest(begin + 1, F.lit(1)), long) == F.col("words"))
    hits = places.join(salted, ["h", "salt"]).where(same)
    found = hits.groupBy("row").agg(
        F.collect_set(F.struct((F.col("pos") - F.col("at")).alias("start"), long.alias("words"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"),
    )
    empty = {c: F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType)) for c in ("hits", "items")}
    return scanned.drop("places").join(found, "row", "left").drop("row").withColumns(empty)


def words_hit(hits):
    """How many words lie in any of the places."""
    covered = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["words"] - 1))
    return F.size(F.array_distinct(F.flatten(covered)))

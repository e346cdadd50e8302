"""Operator 12: records dealt to weighted shards by rendezvous hashing.

Every record scores every shard, ``-weight / ln(u)`` with u in (0, 1) from the MD5 of the
record's key and the shard's name, and goes to the shard of the highest score (the first
in order on a tie). So the key and the shards alone decide, a shard receives in
proportion to its weight, a shard that joins only takes records into itself, and one that
leaves only gives its own away. MD5 is the same in every engine and release, so an
assignment can be computed again elsewhere.

`numbered` gives the records of a shard places without gaps. No window sees a whole shard:
records are ordered by the MD5 of their number columns, which is uniform whatever the keys
are; runs of equal records are counted map-side, in blocks of the stored table, a running
total over the counts gives each run its first place, and only within a run of one block
are rows numbered one by one.

All by built-in functions.

Cases: a null key is a key like any other; null and empty texts are of size 1; equal
records go to one shard and get places of their own; very long texts only cost their
checksum; an empty table gives an empty table; other columns pass through, and those that
clash with the new columns are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.scans import running_totals
from cohortlab.session import staged

#: Records of one block of a table, at most; equal records are numbered block by block.
BLOCK_BITS = 20
#: Counts of a chunk of the running total, about.
CHUNK_ROWS = 1_000_000
#: Hexadecimal digits of a hash that make u: 52 bits, what a double holds exactly.
DIGITS = 13


def even(count: int) -> dict[str, float]:
    """Shards 0 to count - 1 of equal weight."""
    return {str(k): 1.0 for k in range(count)}


def unit(text: Column) -> Column:
    """A number in (0, 1) from the hash of a text."""
    first = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double")
    return (first + 0.5) / float(16**DIGITS)


def key_text(key: Column) -> Column:
    """The key as text; null is told from all others by its missing mark."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def score(key: Column, shard: str, weight: float) -> Column:
    if not weight > 0:
        raise ValueError(f"shard {shard} has weight {weight}; leave it out instead")
    return F.lit(-float(weight)) / F.log(unit(F.concat(key_text(key), F.lit(f"/{shard}"))))


def owner(key: Column, shards: Mapping[str, float]) -> Column:
    """Place of the key's shard in ``shards`` (name to weight)."""
    if not shards:
        raise ValueError("no shard to deal to")
    scores = F.array(*(score(key, name, weight) for name, weight in shards.items()))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def owners(key: Column, shards: Mapping[str, float], more: Mapping[str, float]) -> Column:
    """struct<shard, grown>: the shard, and the one once ``more`` shards have joined.

    The scores of the shards at hand are computed once for both.
    """
    scores = F.array(*(score(key, name, weight) for name, weight in {**shards, **more}.items()))

    def both(s: Column) -> Column:
        now = F.slice(s, 1, len(shards))
        place = lambda part: (F.array_position(part, F.array_max(part)) - 1).cast("int")
        return F.struct(place(now).alias("shard"), place(s).alias("grown"))

    return F.transform(F.array(scores), both)[0]


def deal(docs: DataFrame, shards: Mapping[str, float], more: Mapping[str, float] | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard``, and with ``grown_shard`` when shards to join are given."""
    if not more:
        return docs.withColumn("shard", owner(F.col(key), shards))
    pair = docs.withColumn("__owners", owners(F.col(key), shards, more))
    return pair.withColumns({"shard": F.col("__owners.shard"), "grown_shard": F.col("__owners.grown")}).drop("__owners")


def numbered(dealt: DataFrame, by: list[str], name: str = "slot", block_bits: int = BLOCK_BITS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``dealt`` with the place of each record in its ``shard``, from 0, without gaps.

    Records are ordered by the MD5 of the columns ``by``; those equal in all of them get
    consecutive places in no particular order.
    """
    from pyspark.sql import Window

    dealt = dealt.drop(name)
    text = F.concat_ws(":", *(key_text(F.col(c)) for c in by))
    # the row numbers are stored with the rows, so a task run again finds the same
    rows = dealt.withColumns({"__hash": F.md5(text), "__row": F.monotonically_increasing_id()})
    rows = staged(rows.withColumn("__block", F.shiftright("__row", block_bits)), "dealt")
    runs = staged(rows.groupBy("shard", "__hash", "__block").agg(F.count("*").alias("__n")), "runs")
    # as many leading digits as cut the runs into chunks of the size wanted
    shards = runs.agg(F.count("*"), F.count_distinct("shard")).first()
    digits = 1
    while shards[0] / max(1, shards[1]) / 16**digits > chunk_rows:
        digits += 1
    upto = running_totals(runs, {"__upto": F.col("__n")}, ["__hash", "__block"], ["shard"], F.substring("__hash", 1, digits))
    first = upto.select("shard", "__hash", "__block", (F.col("__upto") - F.col("__n")).alias("__first"))
    run = ["shard", "__hash", "__block"]
    within = F.row_number().over(Window.partitionBy(*run).orderBy("__row"))
    placed = rows.withColumn("__nth", within).join(first, run)
    return placed.select(*dealt.columns, (F.col("__first") + F.col("__nth") - 1).alias(name))


def write_shards(numbered_docs: DataFrame, path: str, rows_per_file: int = 1_000_000, slot: str = "slot") -> None:
    """One folder a shard, in files of consecutive places; a file never holds more rows than given."""
    piece = F.floor(F.col(slot) / rows_per_file)
    out = numbered_docs.withColumn("__piece", piece).repartition("shard", "__piece").sortWithinPartitions("shard", "__piece", slot)
    out.drop("__piece").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)

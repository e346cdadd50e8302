"""Ordered operators that survive one key holding a large share of the rows.

A window partitioned by a key sends the whole key to one task. The operators
here cut each key's ordered rows into chunks: a small summary per (key, chunk)
is aggregated map-side, carried from chunk to chunk over the summary only, and
added as one row to each chunk, so the full rows are shuffled once, by (key,
chunk). ``chunk`` must never
decrease along the order (a day, a month, a rounded value). Without one,
the rows are dealt to ranges of key and order, as many as they need, and stored
with the number of their range, so a recomputed task finds the same chunks and
the plan is as small for many rows as for few. Rows tied on a column are cut by
the next one.

NULL order values come last everywhere, and NULL keys are a group of their own.

``bounded=True`` says that every key is known to be small and takes the plain
window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.session import staged

CHUNK = "__chunk"
SEED = "__seed"
#: Rows of a chunk, on average, when the chunks are found here.
CHUNK_ROWS = 1_000_000


def chunked(
    df: DataFrame,
    order: Sequence[str],
    chunk: Column | None = None,
    chunks: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add the chunk column that cuts the order into pieces.

    Without a chunk given, the rows are dealt to ranges of (by, order) by Spark's
    sketch of them and stored with the number of their range. A small key then lies
    in one or two chunks, a large one is many; rows tied on a column are cut by the
    next one, and rows tied on all of the order by their other columns.
    """
    if chunk is not None:
        return df.withColumn(CHUNK, chunk)
    if isinstance(df.schema[order[0]].dataType, T.StringType):
        raise ValueError(f"no chunks for the text {order[0]}: pass chunk= or order by a number first")
    pieces = max(2, chunks or -(-df.count() // CHUNK_ROWS))
    keys = [*by, *order]
    others = [f.name for f in df.schema if f.name not in keys and "map" not in f.dataType.simpleString()]
    # a hash of values and not a row number: a task run again deals its rows alike
    tie = [F.xxhash64(*others)] if others else []
    ranged = df.repartitionByRange(pieces, *_asc(keys), *tie)
    return staged(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunked")


def _window(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _place(order: Sequence[str]) -> Column:
    """The order columns as one value that sorts NULL last, like the windows."""
    return F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_unknown"), F.col(c))])


def _same(left: DataFrame, by: Sequence[str]) -> list[Column]:
    """Keys equal to their copies named ``__key``; NULL is a key like any other."""
    return [left[c].eqNullSafe(F.col(f"__{c}")) for c in by]


def _asc(names: Sequence[str]) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def _so_far(by: Sequence[str]) -> Window:
    """The chunks of a key before the current one."""
    w = _window(by).orderBy(F.col(CHUNK).asc_nulls_last())
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _with_seeds(rows: DataFrame, seeds: DataFrame, place: int) -> DataFrame:
    """Add one carried row per (key, chunk), before (0) or after (2) its rows.

    The carried value then takes part in the window itself, so the rows are
    shuffled once and never joined.
    """
    return rows.withColumn(SEED, F.lit(1)).unionByName(
        seeds.withColumn(SEED, F.lit(place)), allowMissingColumns=True
    )


def running_totals(
    df: DataFrame,
    totals: Mapping[str, Column],
    order: Sequence[str],
    by: Sequence[str] = (),
    chunk: Column | None = None,
    chunks: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Inclusive running sums along an order, within groups or over all rows."""
    if bounded:
        w = _window(by).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(x).over(w) for n, x in totals.items()})
    parts = {n: f"__part_{n}" for n in totals}
    rows = chunked(df, order, chunk, chunks, by).withColumns({parts[n]: x for n, x in totals.items()})
    per_chunk = rows.groupBy(*by, CHUNK).agg(*[F.sum(p).alias(p) for p in parts.values()])
    seeds = per_chunk.select(*by, CHUNK, *[F.sum(p).over(_so_far(by)).alias(p) for p in parts.values()])
    both = _with_seeds(rows, seeds, 0)
    w = Window.partitionBy(*by, CHUNK).orderBy(*_asc([SEED, *order]))
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({n: F.coalesce(F.sum(p).over(w), F.lit(0)) for n, p in parts.items()})
    names = [*[c for c in df.columns if c not in totals], *totals]
    return out.filter(F.col(SEED) == 1).select(*names)


def sequence_number(
    df: DataFrame, name: str, order: Sequence[str], by: Sequence[str] = (), **how
) -> DataFrame:
    """1-based position of each row, within groups or over all rows."""
    return running_totals(df, {name: F.lit(1).cast("long")}, order, by, **how)


def carry_forward(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    by: Sequence[str],
    chunk: Column | None = None,
    chunks: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Last observation carried forward; leading gaps stay NULL."""
    if bounded:
        w = _window(by).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    rows = chunked(df, order, chunk, chunks, by)
    at = _place(order)
    per_chunk = rows.groupBy(*by, CHUNK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    )
    seeds = per_chunk.select(
        *by, CHUNK, *[F.last(c, ignorenulls=True).over(_so_far(by)).alias(c) for c in columns]
    )
    both = _with_seeds(rows, seeds, 0)
    w = Window.partitionBy(*by, CHUNK).orderBy(*_asc([SEED, *order]))
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return out.filter(F.col(SEED) == 1).select(*df.columns)


def next_value(
    df: DataFrame,
    column: str,
    name: str,
    order: Sequence[str],
    by: Sequence[str] = (),
    chunk: Column | None = None,
    chunks: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Value of the following row; turns cut points into intervals."""
    if bounded:
        return df.withColumn(name, F.lead(column).over(_window(by).orderBy(*_asc(order))))
    rows = chunked(df, order, chunk, chunks, by).withColumn("__value", F.col(column))
    per_chunk = rows.groupBy(*by, CHUNK).agg(
        F.min_by(F.struct("__value"), _place(order)).alias("__first")
    )
    following = F.lead("__first").over(_window(by).orderBy(F.col(CHUNK).asc_nulls_last()))
    seeds = per_chunk.select(*by, CHUNK, following.alias("__next")).filter("__next is not null")
    seeds = seeds.select(*by, CHUNK, "__next.__value")
    both = _with_seeds(rows, seeds, 2)
    w = Window.partitionBy(*by, CHUNK).orderBy(*_asc([SEED, *order]))
    out = both.withColumn(name, F.lead("__value").over(w))
    return out.filter(F.col(SEED) == 1).select(*df.columns, name)


def from_anchor(
    df: DataFrame, is_anchor: Column, order: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Rows of each group from its (last) anchor row on; groups without one go."""
    at = _place(order)
    start = (
        df.groupBy(*[F.col(c).alias(f"__{c}") for c in by])
        .agg(F.max(F.when(is_anchor, at)).alias("__start"))
        .filter(F.col("__start").isNotNull())
    )
    return df.join(start, _same(df, by)).filter(at >= F.col("__start")).select(*df.columns)


def first_period(df: DataFrame, by: Sequence[str], period: Sequence[str]) -> DataFrame:
    """All rows of each group's first period, ties included."""
    known = [F.col(p).isNotNull() for p in period]
    at = F.struct(*period)
    for k in known:
        at = F.when(k, at)
    keys = [F.col(c).alias(f"__{c}") for c in by]
    first = df.groupBy(*keys).agg(F.min(at).alias("__first"))
    first = first.select(*[f"__{c}" for c in by], *[F.col(f"__first.{p}").alias(f"__{p}") for p in period])
    same = [df[p] == F.col(f"__{p}") for p in period]
    return df.join(first, [*_same(df, by), *same]).select(*df.columns)


def with_group_size(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Group size on every row, by a pre-aggregated join instead of a window."""
    sizes = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(
        F.count(F.lit(1)).alias(name)
    )
    return df.join(sizes, _same(df, by), "left").drop(*[f"__{c}" for c in by])

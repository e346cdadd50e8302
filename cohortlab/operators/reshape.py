"""Wide and long, nested and flat."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longer(
    df: DataFrame, values: Sequence[str], key: str = "key", value: str = "value"
) -> DataFrame:
    """Columns to rows; NULL cells stay."""
    ids = [c for c in df.columns if c not in set(values)]
    return df.unpivot(ids, list(values), key, value)


#: Columns that a table is spread over at most, where its levels are looked up.
MOST_LEVELS = 10_000


def levels_of(df: DataFrame, key: str, most: int = MOST_LEVELS) -> list[str]:
    """The levels of ``key`` in order, to be columns; more than a table can be wide are refused."""
    found = df.select(F.col(key).cast("string")).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{key} has more than {most} levels: keep it in rows")
    return sorted(r[0] for r in found)


def wider(
    df: DataFrame, by: Sequence[str], key: str, value: str, levels: Sequence[str]
) -> DataFrame:
    """Rows to columns for a known list of levels (no job to discover them)."""
    return df.groupBy(*by).pivot(key, list(levels)).agg(F.first(value, ignorenulls=True))


def indicators(df: DataFrame, by: Sequence[str], key: str, levels: Sequence[str]) -> DataFrame:
    """One boolean column per level: does the group have it?"""
    return df.groupBy(*by).agg(
        *[F.coalesce(F.bool_or(F.col(key) == v), F.lit(False)).alias(v) for v in levels]
    )


def ticks(df: DataFrame, names: Sequence[str], yes: str = "X", no: str = "") -> DataFrame:
    return df.withColumns({c: F.when(F.col(c), yes).otherwise(no) for c in names})


def nest(
    df: DataFrame,
    columns: Sequence[str],
    name: str,
    part: Column | None = None,
) -> DataFrame:
    """Fold columns into an array per distinct value of all the others.

    One row per group: an array is what the caller asks for, so it must fit a
    row. Groups that don't are nested in pieces: ``part`` is then an expression
    over the rows, and there is one row per group and part. Counts and joins
    are better taken from the flat rows; ``unnest`` restores them either way.
    """
    by = [c for c in df.columns if c not in set(columns)]
    keys = [*by, *([] if part is None else [part.alias("part")])]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def unnest(df: DataFrame, name: str, keep_empty: bool = False) -> DataFrame:
    """Array of structs (or values) back to rows."""
    explode = F.explode_outer if keep_empty else F.explode
    rest = [c for c in df.columns if c not in (name, "part")]
    out = df.select(*rest, explode(name).alias("__item"))
    item = out.schema["__item"].dataType
    if item.typeName() == "struct":
        return out.select(*rest, "__item.*")
    return out.withColumnRenamed("__item", name)


def split_at(
    df: DataFrame, column: str, at: int, into: Sequence[str], convert: bool = False
) -> DataFrame:
    """Split a text column by position; ``convert`` reads both parts as int."""
    parts = [F.substring(F.col(column), 1, at), F.expr(f"substring(`{column}`, {at + 1})")]
    if convert:
        parts = [p.try_cast("int") for p in parts]
    return df.withColumns(dict(zip(into, parts)))


def split_on(df: DataFrame, column: str, pattern: str, into: Sequence[str]) -> DataFrame:
    """Split a text column by a regular expression; missing parts are NULL."""
    bits = F.split(F.col(column), pattern)
    return df.withColumns({name: F.get(bits, F.lit(i)) for i, name in enumerate(into)})


def split_rows(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row per part of a multi-valued text."""
    return df.withColumn(column, F.explode(F.split(F.col(column), pattern)))


def grid(df: DataFrame, factors: Mapping[str, Sequence]) -> DataFrame:
    """Every row combined with every combination of short literal lists."""
    for name, values in factors.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def complete(
    df: DataFrame, by: Sequence[str], period: str, periods: Column
) -> DataFrame:
    """Add the missing (group, period) rows; observed rows all stay.

    ``periods`` is an array expression (a sequence or literal list). The periods that a
    group has are or-ed together as bits where its rows are read, 64 to a word, so the
    shuffle carries a few words per group whatever its number of rows; what the bits lack
    is exploded and put beside the rows, which are neither joined nor moved.
    """
    at = F.coalesce(F.array_position(periods, F.col(period)), F.lit(0)) - 1
    # a row of no slot still names its group
    word = F.floor(at / 64).cast("int").alias("__word")
    bit = F.when(at >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    words = df.select(*by, word, bit.alias("__bit")).groupBy(*by, "__word").agg(F.bit_or("__bit").alias("__bits"))
    seen = words.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__word", "__bits"))).alias("__seen"))

    def lacks(i: Column) -> Column:
        bits = F.coalesce(F.try_element_at("__seen", F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return F.getbit(bits, F.pmod(i, F.lit(64)).cast("int")) == 0

    missing = F.filter(F.transform(periods, lambda p, i: F.when(lacks(i), F.struct(p.alias("p")))), lambda s: s.isNotNull())
    kind = df.schema[period].dataType
    added = seen.select(*by, F.explode(missing).alias("__slot")).select(*by, F.col("__slot.p").cast(kind).alias(period))
    return df.unionByName(added, allowMissingColumns=True)

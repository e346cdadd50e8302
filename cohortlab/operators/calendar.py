"""Relative-term rows to an absolute calendar, one student row at a time.

The wide input has one row per student, and the calendar has a fixed number of
slots. Filling, trimming and dating therefore happen inside the row, on an
array of slots: no grid, no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.terms import (
    REL_QUARTERS,
    first_slot,
    repair_june,
    term_at,
    term_index,
)

YEARS = 10


def relative_terms(years: int = YEARS) -> list[str]:
    """All relative terms in calendar order: YR1FALL, YR1WINTER, ..."""
    return [f"YR{y}{q}" for y in range(1, years + 1) for q in REL_QUARTERS]


def term_sequence(start: str | Column, n: int) -> Column:
    """Array of ``n`` consecutive terms; NULL for a malformed start."""
    index = term_index(start)
    return F.when(
        index.isNotNull(),
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: term_at(index + k)),
    )


def filled_slots(available: list[str], years: int = YEARS) -> Column:
    """Array with the last known value up to each slot of the calendar."""
    have = set(available)
    seen: list[str] = []
    slots = []
    for name in relative_terms(years):
        if name in have:
            seen.append(name)
        known = [F.col(c) for c in reversed(seen)]
        slots.append(F.coalesce(*known) if known else F.lit(None).cast("string"))
    return F.array(*slots)


def student_calendar(
    wide: DataFrame, id_column: str = "E_PIDM", admit_column: str = "ADMIT_TERM", years: int = YEARS
) -> DataFrame:
    """One row per student: the series of values from the admission term on.

    ``start`` is the slot and ``first_index`` the term index of ``series[0]``.
    A student whose admission term is malformed has a NULL series.
    """
    slots = [c for c in wide.columns if c.startswith("YR")]
    total = years * len(REL_QUARTERS)
    return (
        wide.select(
            F.col(id_column).alias("id"),
            repair_june(admit_column).alias("admit_term"),
            filled_slots(slots, years).alias("__all"),
        )
        .withColumn("start", first_slot("admit_term"))
        .withColumn("first_index", term_index("admit_term"))
        .withColumn(
            "series",
            F.when(
                F.col("first_index").isNotNull(),
                F.slice("__all", F.col("start") + 1, F.lit(total)),
            ),
        )
        .drop("__all")
    )


def calendar_rows(calendar: DataFrame, years: int = YEARS) -> DataFrame:
    """One row per student and term: id, admit_term, rel_term, term, major."""
    names = F.array(*[F.lit(t) for t in relative_terms(years)])
    # the outer form keeps Spark from computing the series twice to pre-filter it
    rows = calendar.select(
        "id", "admit_term", "start", "first_index", F.posexplode_outer("series").alias("k", "major")
    )
    return rows.filter(F.col("k").isNotNull()).select(
        "id",
        "admit_term",
        F.get(names, F.col("start") + F.col("k")).alias("rel_term"),
        term_at(F.col("first_index") + F.col("k")).alias("term"),
        "major",
    )


def value_at_term(series: str | Column, first_index: str | Column, term: str | Column) -> Column:
    """Series value at an absolute term; NULL outside the series."""
    s = F.col(series) if isinstance(series, str) else series
    f = F.col(first_index) if isinstance(first_index, str) else first_index
    offset = term_index(term) - f
    return F.when((offset >= 0) & (offset < F.size(s)), F.get(s, offset))


def changes(series: str | Column) -> Column:
    """The places of a series where the value is another than before, as array<struct<at, value>>.

    A value that is carried forward fills many places and changes at few: this is what is
    worth moving.
    """
    s = F.col(series) if isinstance(series, str) else series
    cells = F.transform(s, lambda v, k: F.struct(k.alias("at"), v.alias("value")))
    return F.filter(cells, lambda c, k: (k == 0) | ~c["value"].eqNullSafe(F.get(s, k - 1)))


def changed_value_at_term(found: str | Column, length: str | Column, first_index: str | Column, term: str | Column) -> Column:
    """:func:`value_at_term` of a series given by its :func:`changes` and its length."""
    found, length, first = (F.col(x) if isinstance(x, str) else x for x in (found, length, first_index))
    offset = term_index(term) - first
    held = F.filter(found, lambda c: c["at"] <= offset)
    return F.when((offset >= 0) & (offset < length), F.get(held, F.size(held) - 1)["value"])


def bad_terms(df: DataFrame, term: str) -> DataFrame:
    """Rows whose term the calendar cannot place, for a quarantine report."""
    return df.filter(term_index(term).isNull())

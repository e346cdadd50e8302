"""Academic terms written ``YYYYQQ``, as arithmetic on one integer index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.missing import _col

# Quarter codes in calendar order and the quarter that each
# code opens, in the order of a relative (fall-first) academic year.
QUARTER_CODES = ["01", "03", "05", "07", "10"]
REL_QUARTERS = ["FALL", "WINTER", "SPRING", "SUMMER_I", "SUMMER_II"]
CODE_OF_REL_QUARTER = ["10", "01", "03", "05", "07"]

PER_YEAR = len(QUARTER_CODES)


def _position(codes: list[str], code: Column) -> Column:
    """0-based position, NULL for a code that is not listed."""
    pos = F.array_position(F.array(*[F.lit(c) for c in codes]), code)
    return F.when(pos > 0, pos - 1).cast("int")


def repair_june(term: str | Column) -> Column:
    """A June admission counts as the July term."""
    return F.regexp_replace(_col(term), "06$", "07")


def term_index(term: str | Column) -> Column:
    """Terms since year 0; NULL for a malformed term."""
    term = _col(term)
    year = F.substring(term, 1, 4).try_cast("int")
    return year * PER_YEAR + _position(QUARTER_CODES, F.substring(term, -2, 2))


def term_at(index: str | Column) -> Column:
    """Inverse of :func:`term_index`."""
    index = _col(index)
    code = F.get(F.array(*[F.lit(c) for c in QUARTER_CODES]), index % PER_YEAR)
    return F.concat(F.floor(index / PER_YEAR).cast("string"), code)


def later_term(term: str | Column, k: int | Column = 1) -> Column:
    return term_at(term_index(term) + k)


def first_slot(term: str | Column) -> Column:
    """Position of an admission term in its first relative year."""
    return _position(CODE_OF_REL_QUARTER, F.substring(_col(term), -2, 2))


def term_date(term: str | Column) -> Column:
    return F.to_date(_col(term), "yyyyMM")


def term_year(term: str | Column) -> Column:
    return F.substring(_col(term), 1, 4).try_cast("int")


def term_quarter(term: str | Column) -> Column:
    return F.substring(_col(term), 5, 2).try_cast("int")

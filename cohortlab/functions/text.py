"""String helpers that return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.missing import _col


def join_text(*parts: str | Column) -> Column:
    """Concatenate; NULL in any part makes the result NULL."""
    return F.concat(*[_col(p) for p in parts])


def squash_spaces(x: str | Column) -> Column:
    return F.regexp_replace(_col(x), " ", "_")


def first_chars(x: str | Column, k: int) -> Column:
    return F.substring(_col(x), 1, k)


def last_chars(x: str | Column, k: int) -> Column:
    return F.substring(_col(x), -k, k)


def mentions(x: str | Column, word: str) -> Column:
    """Keyword flag, NULL for a missing text."""
    return _col(x).contains(word)


def number_in(x: str | Column) -> Column:
    """First number inside a text, thousands separators allowed; 0 if none."""
    digits = F.regexp_extract(_col(x), r"-?[0-9][0-9,]*(\.[0-9]+)?", 0)
    value = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(value, F.lit(0.0))


def label(x: str | Column) -> Column:
    """Column name to readable label."""
    return F.replace(_col(x), F.lit("_"), F.lit(" "))


def title_case(x: str | Column) -> Column:
    return F.initcap(_col(x))


def capital(x: str | Column) -> Column:
    """First capital letter of a text, NULL if it has none."""
    found = F.regexp_extract(_col(x), "[A-Z]", 0)
    return F.when(found != "", found)


def parts(x: str | Column, pattern: str) -> Column:
    """Split on a (Java) regular expression."""
    return F.split(_col(x), pattern)


def parts_without(x: str | Column, pattern: str, word: str) -> Column:
    """The parts of a split text that do not mention ``word``."""
    return F.filter(parts(x, pattern), lambda p: ~p.contains(word))

"""Recoding of categorical values. Unlisted values pass through."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.missing import _col

MISSING = "(Missing)"


def recode(x: str | Column, mapping: Mapping[str, str | None]) -> Column:
    """Old value to new value; a value mapped to ``None`` becomes NULL."""
    x = _col(x)
    out = x
    for old, new in mapping.items():
        out = F.when(x == old, F.lit(new)).otherwise(out)
    return out


def collapse(x: str | Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Group several values under one name."""
    return recode(x, {old: new for new, olds in groups.items() for old in olds})


def lookup(x: str | Column, mapping: Mapping) -> Column:
    """Value from a small fixed table; NULL when the key is not listed."""
    x = _col(x)
    items = list(mapping.items())
    out = F.when(x == items[0][0], F.lit(items[0][1]))
    for key, value in items[1:]:
        out = out.when(x == key, F.lit(value))
    return out


def explicit_missing(x: str | Column) -> Column:
    return F.coalesce(_col(x), F.lit(MISSING))


def cross_label(*parts: str | Column) -> Column:
    """Interaction label such as ``M.White``; NULL if any part is."""
    out = _col(parts[0])
    for part in parts[1:]:
        out = F.concat(out, F.lit("."), _col(part))
    return out


def yes(x: str | Column) -> Column:
    return _col(x) == "Y"


def level_index(x: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of a value in an ordered level list, NULL if absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(x))
    return F.when(pos > 0, pos)

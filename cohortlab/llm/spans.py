"""Pattern matches with their places, by built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it in a lambda."""
    return F.transform(F.array(value), use)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _before(sizes: Column) -> Column:
    """For each element the sum of those before it, in blocks of about the square root."""

    def within(b: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / b).cast("int"))
        blocks = F.transform(at, lambda k: _total(F.slice(sizes, k * b + 1, b)))
        starts = let(blocks, lambda s: F.transform(s, lambda _, k: _total(F.slice(s, F.lit(1), k))))

        def place(starts: Column) -> Column:
            return F.transform(sizes, lambda _, i: F.element_at(starts, F.floor(i / b).cast("int") + 1) + _total(F.slice(sizes, F.floor(i / b).cast("int") * b + 1, i % b)))

        return let(starts, place)

    return let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes)))).cast("int"), within)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: the leftmost non-overlapping matches, in code points."""
    kind = "array<struct<start:int,end:int,value:string>>"

    def placed(s: Column) -> Column:
        found, gaps = s["found"], s["gaps"]
        sizes = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.length(v) + F.length(g))
        before = let(sizes, _before)

        def spans(b: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                start = F.element_at(b, i + 1) + F.length(F.element_at(gaps, i + 1))
                return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))

            return F.transform(found, one)

        return let(before, spans)

    def split(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.when(F.size(found) > 0, let(F.struct(found.alias("found"), gaps.alias("gaps")), placed)).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)

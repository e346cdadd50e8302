"""Chunked operators equal the plain windows, hot key or not."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import scans
from conftest import rows


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        data.append((None if key == "k3" else key, i * 7 % 3001, rng.choice([None, None, rng.randrange(9)])))
    return spark.createDataFrame(data, "k string, t int, v int").repartition(8).cache()


CHUNKS = [dict, lambda: {"chunks": 3}, lambda: {"chunk": F.floor(F.col("t") / 100)}, lambda: {"chunk": F.lit(0)}]


@pytest.mark.parametrize("how", CHUNKS)
def test_carry_forward(series, how):
    plain = scans.carry_forward(series, ["v"], ["t"], ["k"], bounded=True)
    assert rows(scans.carry_forward(series, ["v"], ["t"], ["k"], **how())) == rows(plain)


@pytest.mark.parametrize("how", CHUNKS)
def test_sequence_number(series, how):
    plain = scans.sequence_number(series, "n", ["t"], ["k"], bounded=True)
    assert rows(scans.sequence_number(series, "n", ["t"], ["k"], **how())) == rows(plain)


@pytest.mark.parametrize("how", CHUNKS)
def test_next_value(series, how):
    plain = scans.next_value(series, "v", "nx", ["t"], ["k"], bounded=True)
    assert rows(scans.next_value(series, "v", "nx", ["t"], ["k"], **how())) == rows(plain)


def test_global_running_total(series):
    out = scans.running_totals(series, {"s": F.coalesce("v", F.lit(0))}, ["t"])
    total, expected = 0, []
    for r in sorted(series.collect(), key=lambda r: r["t"]):
        total += r["v"] or 0
        expected.append((r["t"], total))
    assert rows(out, "t", "s") == sorted(expected, key=repr)


def test_order_column_with_one_value(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3)], "k string, t int, u int")
    out = scans.sequence_number(df, "n", ["t", "u"], ["k"])
    assert rows(out, "u", "n") == [(1, 1), (2, 2), (3, 1)]


def unknown_orders(spark):
    rows = [("a", 1, 1, 10), ("a", 1, None, 20), ("a", 2, 1, None), ("a", None, 5, 7), ("a", None, None, None), (None, 3, 1, 4), (None, None, 2, None), (None, 4, 4, None)]
    return spark.createDataFrame(rows, "k string, t int, u int, v int")


@pytest.mark.parametrize("how", [lambda: {"chunks": 2}, lambda: {"chunks": 6}, lambda: {"chunk": F.lit(1)}, lambda: {"chunk": F.col("t")}])
def test_unknown_order_values_come_last(spark, how):
    df, how = unknown_orders(spark), how()
    for scan in (
        lambda **h: scans.carry_forward(df, ["v"], ["t", "u"], ["k"], **h),
        lambda **h: scans.next_value(df, "v", "nx", ["t", "u"], ["k"], **h),
        lambda **h: scans.sequence_number(df, "n", ["t", "u"], ["k"], **h),
    ):
        assert rows(scan(**how)) == rows(scan(bounded=True))
    carried = rows(scans.carry_forward(df, ["v"], ["t", "u"], ["k"], **how), "k", "t", "u", "v")
    assert ("a", 2, 1, 20) in carried and ("a", None, None, 7) in carried


def test_unknown_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, "go"), (None, None, "y"), (7, 1, "go"), (7, None, "z")], "id int, t int, s string")
    assert rows(scans.from_anchor(df, F.col("s") == "go", ["t"], ["id"]), "id", "s") == [(7, "go"), (7, "z"), (None, "go"), (None, "y")]
    assert rows(scans.first_period(df, ["id"], ["t"]), "id", "s") == [(7, "go"), (None, "x")]


def test_ties_of_one_order_value_are_cut_by_the_next(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 10 < 8, 5).otherwise(F.col("id") % 7).alias("t"), "id")
    cut = scans.chunked(df, ["t", "id"], chunks=20).groupBy(scans.CHUNK).count()
    assert max(r["count"] for r in cut.collect()) < 300
    plain = scans.sequence_number(df, "n", ["t", "id"], ["k"], bounded=True)
    assert rows(scans.sequence_number(df, "n", ["t", "id"], ["k"], chunks=20)) == rows(plain)


def test_first_period_keeps_ties_and_skips_unknown(spark):
    df = spark.createDataFrame(
        [(1, 2006, 3, "a"), (1, 2006, 3, "b"), (1, 2007, 1, "c"), (2, None, 1, "d"), (2, 2008, 10, "e"), (3, None, None, "f")],
        "id int, y int, q int, c string",
    )
    assert rows(scans.first_period(df, ["id"], ["y", "q"]), "c") == [("a",), ("b",), ("e",)]


def test_from_anchor_drops_groups_without_one(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "go"), (1, 3, "y"), (2, 1, "x")], "id int, t int, s string")
    assert rows(scans.from_anchor(df, F.col("s") == "go", ["t"], ["id"]), "id", "t") == [(1, 2), (1, 3)]


def test_group_size_matches_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert rows(scans.with_group_size(df, ["k"]), "v", "n") == [(1, 2), (2, 2), (3, 1)]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_time_orders_are_cut(spark, kind):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("k"),
        F.expr(f"cast(timestamp_ntz'2024-03-30 20:00:00' + make_interval(0, 0, 0, 0, 0, id) as {kind})").alias("t"),
        "id",
    )
    plain = scans.sequence_number(df, "n", ["t", "id"], ["k"], bounded=True)
    assert rows(scans.sequence_number(df, "n", ["t", "id"], ["k"], chunks=7)) == rows(plain)


def test_text_order_needs_a_chunk(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, t string")
    with pytest.raises(ValueError):
        scans.sequence_number(df, "n", ["t"], ["k"])
    out = scans.sequence_number(df, "n", ["t"], ["k"], chunk=F.substring("t", 1, 1))
    assert rows(out, "t", "n") == [("x", 1), ("y", 2)]


def test_plan_does_not_grow_with_the_chunks(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    sizes = []
    for chunks in (2, 60):
        out = scans.sequence_number(df, "n", ["t"], ["k"], chunks=chunks)
        sizes.append(len(out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "extended")))
        assert out.agg(F.max("n")).first()[0] == 1334
    assert sizes[1] < sizes[0] * 1.05
    # small keys lie in few chunks
    some = spark.range(4000).select((F.col("id") % 200).alias("k"), F.col("id").alias("t"))
    cut = scans.chunked(some, ["t"], chunks=20, by=["k"])
    assert cut.groupBy("k").agg(F.count_distinct(scans.CHUNK).alias("c")).agg(F.sum("c")).first()[0] <= 220

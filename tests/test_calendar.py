"""Term arithmetic and the relative-to-absolute calendar."""

from pyspark.sql import functions as F

from cohortlab.functions import terms
from cohortlab.operators import calendar, scans
from cohortlab.operators.reshape import longer
from conftest import rows


def test_terms_step_through_the_year(spark):
    df = spark.createDataFrame([("200601",), ("200603",), ("201010",), ("200902",), (None,)], "t string")
    out = [r[0] for r in df.select(terms.later_term("t")).collect()]
    assert out == ["200603", "200605", "201101", None, None]


def test_term_index_round_trip(spark):
    df = spark.range(9950, 10150).select(F.col("id").cast("int").alias("i"))
    back = df.select("i", terms.term_index(terms.term_at("i")).alias("j"))
    assert back.filter("i <> j OR j is null").isEmpty()


def test_sequence_crosses_years(spark):
    df = spark.createDataFrame([("200705",)], "t string")
    assert df.select(calendar.term_sequence("t", 4)).head()[0] == ["200705", "200707", "200710", "200801"]


def test_june_becomes_july(spark):
    df = spark.createDataFrame([("200606",), ("200610",), ("200601",)], "t string")
    assert [r[0] for r in df.select(terms.repair_june("t")).collect()] == ["200607", "200610", "200601"]


def wide(spark):
    return spark.createDataFrame(
        [
            (1, "200610", "Art", None, "Math", None, None, "Philosophy"),
            (2, "200606", "Art", "Law", None, "Bio", None, None),
            (3, "200601", None, None, None, "Law", None, None),
            (4, "200611", "Art", None, None, None, None, None),
        ],
        "E_PIDM int, ADMIT_TERM string, YR1FALL string, YR1WINTER string, YR1SPRING string, "
        "YR2FALL string, YR2WINTER string, YR3FALL string",
    )


def test_alignment_by_hand(spark):
    out = calendar.calendar_rows(calendar.student_calendar(wide(spark)))
    by = {(r["id"], r["rel_term"]): (r["term"], r["major"]) for r in out.collect()}
    # fall admission keeps all fifty terms, the later ones start inside year one
    assert sum(1 for k in by if k[0] == 1) == 50
    assert sum(1 for k in by if k[0] == 2) == 46
    assert sum(1 for k in by if k[0] == 3) == 49
    assert not any(k[0] == 4 for k in by)  # malformed admission term
    assert by[(1, "YR1FALL")] == ("200610", "Art")
    assert by[(1, "YR1WINTER")] == ("200701", "Art")
    assert by[(1, "YR2SPRING")] == ("200803", "Math")
    assert by[(1, "YR3FALL")] == ("200810", "Philosophy")
    # a value from before admission flows in
    assert by[(2, "YR1SUMMER_II")] == ("200607", "Law")
    assert by[(2, "YR2FALL")] == ("200610", "Bio")
    # nothing known yet
    assert by[(3, "YR1WINTER")] == ("200601", None)
    assert by[(3, "YR2FALL")] == ("200610", "Law")


def test_alignment_equals_the_long_way(spark):
    """Unpivot, densify, carry, trim and number give the same rows."""
    w = wide(spark).filter("E_PIDM <> 4")
    names = calendar.relative_terms()
    base = w.select("E_PIDM", terms.repair_june("ADMIT_TERM").alias("admit"))
    grid = base.withColumn("rel_term", F.explode(F.array(*[F.lit(n) for n in names])))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("rel_term"))
    long = longer(w.drop("ADMIT_TERM"), [c for c in w.columns if c.startswith("YR")], "rel_term", "major")
    full = grid.join(long, ["E_PIDM", "rel_term"], "left").withColumn("idx", place)
    filled = scans.carry_forward(full, ["major"], ["idx"], ["E_PIDM"], bounded=True)
    start = F.col("idx") == terms.first_slot("admit") + 1
    cut = scans.from_anchor(filled, start, ["idx"], ["E_PIDM"])
    numbered = scans.sequence_number(cut, "k", ["idx"], ["E_PIDM"], bounded=True)
    expected = numbered.select(
        "E_PIDM", "admit", "rel_term", terms.later_term("admit", (F.col("k") - 1).cast("int")).alias("t"), "major"
    )
    got = calendar.calendar_rows(calendar.student_calendar(w))
    assert rows(got, "id", "admit_term", "rel_term", "term", "major") == rows(expected)


def test_value_at_term_is_null_outside(spark):
    cal = calendar.student_calendar(wide(spark))
    facts = spark.createDataFrame(
        [(1, "200601"), (1, "200610"), (1, "200810"), (1, "203010"), (1, "2006xx"), (9, "200610")], "id int, t string"
    )
    out = facts.join(cal, "id", "left").select(calendar.value_at_term("series", "first_index", "t"))
    assert sorted(str(r[0]) for r in out.collect()) == ["Art", "None", "None", "None", "None", "Philosophy"]


def test_bad_terms_are_reported(spark):
    df = spark.createDataFrame([("200602",), ("200610",), ("abc",)], "t string")
    assert rows(calendar.bad_terms(df, "t")) == [("200602",), ("abc",)]


def test_alignment_needs_no_shuffle(spark):
    plan = calendar.calendar_rows(calendar.student_calendar(wide(spark)))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "Exchange" not in text and "Window" not in text and "Join" not in text


def test_changes_hold_the_series(spark):
    """Every place of a series can be read off its changes; a carried value is kept once."""
    cal = calendar.student_calendar(wide(spark)).withColumn("found", calendar.changes("series")).withColumn("n", F.size("series"))
    terms = [f"{y}{q}" for y in range(1990, 2030) for q in ("01", "03", "05", "07", "10", "06")] + [None, "x"]
    cells = cal.withColumn("t", F.explode(F.array(*[F.lit(t) for t in terms])))
    plain = calendar.value_at_term("series", "first_index", "t")
    short = calendar.changed_value_at_term("found", "n", "first_index", "t")
    assert cells.filter(plain.isNotNull()).count() > 0
    assert cells.filter(~plain.eqNullSafe(short)).isEmpty()
    values = F.size(F.array_distinct("series"))
    assert cal.filter(F.size("found") > values + 2).isEmpty() and cal.filter("n = 50 AND size(found) > 10").isEmpty()

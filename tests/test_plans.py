"""The plans from raw tables to reports, end to end."""

import pytest
from pyspark.sql import functions as F

from cohortlab.catalog import standin
from cohortlab.catalog.registry import curated
from cohortlab.catalog.verbs import trend_pages
from cohortlab.functions import text
from cohortlab.operators import checks
from cohortlab.plans import descriptives, registrar, regressions, trends
from cohortlab.sources.html import table_cells
from conftest import TESTDATA, rows


@pytest.fixture(scope="module")
def stages(spark):
    return curated(spark, TESTDATA)


def registrar_input(spark):
    profile = spark.createDataFrame(
        [
            (1, "M", "White", "Irish", "W", "Y", "N", "Freshman", "N", 1, "N"),
            (1, "M", "White", "Irish", "W", "Y", "N", "Freshman", "Y", 2, "N"),
            (2, "F", "Other", "Alaska Native", "N", "N", None, "Transfer", "N", 1, "N"),
            (3, None, None, "Pacific Islander, other", None, "N", "Y", "Transfer", "N", 1, "N"),
            (4, "F", None, None, None, "N", "Y", "Transfer", "N", 1, "N"),
        ],
        "ID int, GENDER string, RACE string, ETHNICITY string, ETHNICITY_CODE string, IsFIRSTGENERATION string, "
        "IsLOWINCOME string, ADMISSION_TYPE string, IsPHI_MAJOR string, PHI_CNT int, IsPHI_MINOR string",
    )
    courses = spark.createDataFrame(
        [
            (1, "200610", "1", "Logic", "Kim", "A", 3.0),
            (1, "200610", "2", "Ethics", "Lee", "P", 3.0),
            (1, "200701", "3", "Mind", "Kim", "F", 2.5),
            (2, "200601", "4", "Logic", "Kim", "B+", 3.5),
            (2, "200610", "1", "Logic", "Kim", "C", 3.5),
            (3, "200610", "1", "Logic", "Kim", None, None),
        ],
        "E_PIDM int, TERM string, CRN string, COURSE_TITLE string, INSTRUCTOR string, COURSE_LETTER_GRADE string, TERM_CUM_GPA double",
    )
    majors = spark.createDataFrame(
        [(1, "200610", "Undeclared", "Philosophy"), (2, "200610", "Sociology", None), (3, "200606", None, None), (4, "200610", None, "Art")],
        "E_PIDM int, ADMIT_TERM string, YR1FALL string, YR1WINTER string",
    )
    return profile, courses, majors


def test_registrar_by_hand(spark):
    out = registrar.build(*registrar_input(spark))
    students = {r["id"]: r for r in out["profile_clean"].collect()}
    assert len(students) == 4
    assert students[1]["ever_phil"] and not students[2]["ever_phil"]
    assert (students[2]["race"], students[2]["race4"], students[2]["demographic"]) == ("Indigenous", "BHIP", "F.BHIP")
    assert (students[3]["race"], students[3]["poc"], students[3]["demographic"]) == ("Pacific Islander", True, None)
    # an unknown race is not a known majority, and has no group
    assert (students[4]["race"], students[4]["poc"], students[4]["race4"]) == (None, True, None)
    assert students[2]["low_income"] is None

    facts = {(r["id"], r["course_id"]): r for r in out["crs_1"].collect()}
    assert len(facts) == 6
    assert facts[(1, "200610_1")]["major"] == "Undeclared" and facts[(1, "200701_3")]["current_phil"]
    assert facts[(1, "200610_1")]["id_title"] == "200610_1_Logic"
    assert facts[(1, "200610_2")]["grade"] is None
    assert facts[(2, "200601_4")]["major"] is None  # before admission
    assert facts[(2, "200610_1")]["other_major"]

    totals = {r["course_id"]: r for r in out["crs_2"].collect()}
    assert totals["200610_1"]["n_students"] == 3
    assert totals["200610_1"]["women"] is None  # one gender is unknown
    assert totals["200610_1"]["poc"] == 2
    assert totals["200610_1"]["soc"] == 1

    # the only reference student has an ungraded course: no reference at all
    assert out["dmg"].isEmpty()

    nested = {r["id"]: r for r in out["crs_4"].collect()}
    assert [c["course_id"] for c in nested[1]["first_phil_course"]] == ["200610_1", "200610_2"]
    assert nested[1]["n_phil"] == 3 and nested[2]["n_phil"] == 2

    people = {r["id"]: r for r in out["profile"].collect()}
    assert people[1]["n_later_phil"] == 1 and people[1]["multiple_phil"]
    assert people[4]["n_phil"] is None
    analysis = out["analysis"].collect()
    assert [(r["id"], r["course_id"]) for r in analysis] == [(1, "200610_1")]
    assert analysis[0]["year"] == "2006" and analysis[0]["year_number"] == 2006


def test_stages_are_made_when_asked_for(spark):
    kept = []
    out = registrar.build(*registrar_input(spark), keep=lambda df, name: kept.append(name) or df)
    assert kept == [] and "crs" in out
    out["profile_clean"].count()
    assert kept == ["calendar"]
    out["analysis"], out["crs_4"], out["crs_2"]
    assert kept == ["calendar", "student_facts"]


def test_people_carry_changes_of_the_major(spark):
    """A long series is one short cell in the join with the facts."""
    profile, courses, majors = registrar_input(spark)
    calendar = registrar.student_calendar(majors)
    people = registrar.people_table(calendar, registrar.clean_profile(profile, registrar.ever_majored(calendar)))
    assert "series" not in people.columns
    assert {r["id"]: [tuple(c) for c in r["series_changes"]] for r in people.collect()} == {
        1: [(0, "Undeclared"), (1, "Philosophy")], 2: [(0, "Sociology")], 3: [(0, None)], 4: [(0, None), (1, "Art")]
    }
    both = [registrar.course_facts(courses, p).select("id", "course_id", "major", "current_phil", "grade_diff") for p in (people, calendar)]
    assert rows(both[0]) == rows(both[1])


def test_majors_of_slots_by_hand(spark):
    """The last order with a line in a slot counts, though its major is unknown; lines are packed by order first."""
    orders = spark.createDataFrame(
        [
            (1, 7, "O", 1.0, "1996-01-05", "2-HIGH"), (2, 7, "O", 1.0, "1996-10-05", "4-NOT SPECIFIED"), (3, 7, "O", 1.0, "1996-11-05", "else"),
            (4, 8, "P", 300000.0, "1997-05-01", "5-LOW"), (5, None, "O", 1.0, "1997-05-01", "5-LOW"),
        ],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string",
    ).withColumn("o_orderdate", F.to_timestamp("o_orderdate"))
    lines = spark.createDataFrame(
        [(1, 1, "1996-10-01"), (1, 2, "1996-01-01"), (2, 1, "1996-11-01"), (2, 1, "1996-12-01"), (3, 2, "1996-02-01"), (3, None, "1996-02-01"), (3, 3, "1996-08-01"), (5, 1, "1996-10-01")],
        "l_orderkey long, l_linenumber int, l_shipdate string",
    ).withColumn("l_shipdate", F.to_timestamp("l_shipdate"))
    wide = standin.major_term({"orders": orders, "lineitem": lines})
    found = {r["E_PIDM"]: r for r in wide.collect()}
    assert set(found) == {706, 807, None} and wide.columns == ["E_PIDM", "ADMIT_TERM", *standin.SLOTS]
    assert {k: v for k, v in found[706].asDict().items() if v is not None} == {"E_PIDM": 706, "ADMIT_TERM": "199601", "YR1FALL": "History"}
    assert [v for k, v in found[807].asDict().items() if k.startswith("YR") and v] == []
    assert [v for k, v in found[None].asDict().items() if k.startswith("YR") and v] == []
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan.split("Aggregate")[1] and "bit_or" in plan


def test_facts_keep_their_rows(stages):
    assert stages["crs"].count() == stages["raw_courses"].count()
    checks.require(checks.key_report(stages["crs_1"], ["id", "course_id"]), "is_unique", "fact key repeats")


def test_descriptives_have_rows(stages):
    tables = {
        **descriptives.raw_counts(stages["raw_profile"], stages["raw_courses"]),
        **descriptives.cohort_tables(stages),
    }
    analysis = stages["analysis"].withColumn("year_number", F.col("year_number") + 10)
    tables |= descriptives.analysis_tables(analysis)
    empty = {name for name, df in tables.items() if df.isEmpty()}
    assert empty <= {"large_courses", "course_correlations", "strong_correlations"}


def test_campus_lines(spark):
    pages = trend_pages(spark, TESTDATA)
    cells = table_cells(pages, "page", "html").withColumn("q", text.first_chars("page", 2))
    t = trends.trend_rows(cells, "page", "q").withColumn("year", F.col("year") + 10)
    out = descriptives.campus_lines(trends.gender_trend(t), trends.race_trend(t))
    assert all(not df.isEmpty() for df in out.values())


def test_faculty_dimension(spark):
    raw = spark.createDataFrame([("Kim", "F", "Asian", 100, "x")], "instructor string, gender string, race string, n long, notes string")
    assert rows(regressions.faculty_table(raw)) == [("Kim", "F", "Asian", 2.0)]


def test_small_grid_runs_through(spark, stages):
    specs = regressions.model_grid({"grade_diff": [["admission_type"]], "course_division": [["grade_diff"]]})
    out = regressions.run(stages["modelled"], specs)
    assert out["auc"].count() == 2 * 2 * 3
    assert out["auc"].filter("auc < 0.5 OR auc > 1").isEmpty()
    kinds = {r[0] for r in out["estimates"].select("model_type").distinct().collect()}
    assert kinds == {"lm", "logistic", "bias-reduced logistic", "Poisson", "hurdle count", "hurdle zero"}
    roots = out["rootograms"].groupBy("model_idx").agg(F.sum("observed").alias("o"), F.sum("fitted").alias("f"))
    assert roots.filter("o <> f").isEmpty()
    assert out["sensitivity"].filter("abs(threshold) = double('infinity')").isEmpty()
    # the course division enters as a control-free full model as well
    assert out["highlights"].count() == 1


def test_courses_of_lines_by_hand(spark):
    """The least priority of a term's lines gives the grade, an unknown one has none; no text is grouped or moved."""
    orders = spark.createDataFrame(
        [
            (1, 7, "1996-01-05", "5-LOW"), (2, 7, "1996-02-05", "2-HIGH"), (3, 7, "1996-10-05", "3-z"), (4, 7, "1996-10-06", "4-NOT SPECIFIED"),
            (5, 8, "1996-10-05", "0"), (6, 8, "1996-10-05", "1-URGENT"), (7, 8, "1996-05-05", "9"), (8, 8, "1996-05-05", None), (9, None, "1996-05-05", None),
        ],
        "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string",
    ).withColumn("o_orderdate", F.to_timestamp("o_orderdate"))
    lines = spark.createDataFrame(
        [(k, 5, 1 + k % 2, 13.0 if k == 9 else float(k)) for k in range(1, 10)] + [(1, 5, 2, None), (2, 6, 1, 50.0), (2, 6, 3, 50.0)],
        "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double",
    )
    part = spark.createDataFrame([(1, "B1", "BIG"), (2, "B2", "SMALL")], "p_partkey long, p_brand string, p_type string")
    out = standin.phi_crs({"orders": orders, "lineitem": lines, "part": part})
    found = {(r[0], r[1], r[2]): tuple(r[3:6]) + (r[6] and round(r[6], 6),) for r in out.collect()}
    assert found == {
        (706, "199601", "5"): ("B1 BIG", "S5", "B+", 0.16),
        (706, "199601", "6"): ("B1 BIG", "S6", "B+", 4.0),
        (706, "199610", "5"): ("B1 BIG", "S5", None, 0.32),
        (806, "199610", "5"): ("B1 BIG", "S5", None, 0.48),
        (806, "199605", "5"): ("B1 BIG", "S5", None, 0.64),
        (None, "199605", "5"): ("B2 SMALL", "S5", None, None),
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min(o_orderpriority" not in plan


def test_stored_facts_hold_what_others_follow_from(spark):
    """What is stored has no derived text; the facts read from it are those of one call."""
    kept = {}

    def keep(df, name):
        return kept.setdefault(name, df)

    given = registrar_input(spark)
    out = registrar.build(*given, keep)
    facts = out["student_facts"]
    assert not {"id_title", "course_id", "grade_diff"} & set(kept["student_facts"].columns)
    whole = registrar.course_facts(given[1], registrar.people_table(out["calendar"], out["profile_clean"]))
    assert facts.columns == whole.columns and rows(facts) == rows(whole)


def test_gaps_travel_with_totals(spark):
    """Gaps are found as by a join on course and group, and the first rows are moved to their course once."""
    profile, courses, majors = registrar_input(spark)
    more = spark.createDataFrame([(1, "200610", "5", "Mind", "Kim", "B", 3.0), (4, "200610", "5", "Mind", "Kim", "B", 3.0)], courses.schema)
    out = registrar.build(profile, courses.union(more), majors)
    facts, totals = out["student_facts"], out["crs_2"]
    gaps = spark.createDataFrame(
        [("200610_1", "M.White", 0.5), ("200610_1", "F.BHIP", -1.0), ("200610_1", None, 9.0), ("200601_4", "M.White", 7.0), ("200610_2", "M.White", None)],
        "course_id string, demographic string, dmg double",
    )
    found = registrar.analysis_table(facts, totals, gaps)
    plain = registrar.analysis_table(facts, totals, gaps.limit(0)).drop("dmg")
    again = plain.join(gaps, ["course_id", "demographic"], "left")
    assert found.count() > 1 and rows(found, *sorted(found.columns)) == rows(again, *sorted(found.columns))
    assert {r["dmg"] for r in found.collect()} == {0.5, None}
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("demographic" in x for x in joins)


def test_stages_are_stored_with_zstd(stages):
    """Wide tables are packed; what the corpus operators store stays as it was."""
    files = stages["calendar"].inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)

"""From the three registrar tables to the curated analysis table.

Inputs: ``profile`` (one row per student, some twice), ``phi_crs`` (student x
course) and ``major_term`` (one wide row per student).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.missing import flag, if_else, not_in, strict_sum, sum_or_zero
from cohortlab.functions.recode import collapse, cross_label, explicit_missing, lookup, yes
from cohortlab.functions.terms import term_date, term_quarter, term_year
from cohortlab.functions.text import join_text, mentions, squash_spaces
from cohortlab.operators.calendar import calendar_rows, changed_value_at_term, changes, student_calendar
from cohortlab.operators.joins import keyed_join, natural_join
from cohortlab.operators.reshape import nest
from cohortlab.operators.summaries import group_gap, shares_of
from cohortlab.operators.verbs import across, columns_between, distinct_rows, lower_names, renamed

# Grade points per letter grade; other codes carry no points.
GRADE_POINTS = {
    "A+": 4.0,
    "A": 4.0,
    "A-": 3.7,
    "B+": 3.3,
    "B": 3.0,
    "B-": 2.7,
    "C+": 2.3,
    "C": 2.0,
    "C-": 1.7,
    "D+": 1.3,
    "D": 1.0,
    "D-": 0.7,
    "F": 0.0,
}

# Keyword behind each major flag.
MAJOR_FLAGS = {
    "current_phil": "Philosophy",
    "human_dev": "Human Development",
    "bio_sci": "Biological Sciences",
    "soc": "Sociology",
    "undeclared": "Undeclared",
}

# The four analytical race groups.
RACE_GROUPS = {
    "White": ["White"],
    "Asian": ["Asian"],
    "BHIP": ["Black", "Hispanic", "Indigenous", "Pacific Islander"],
    "Other": ["Other"],
}

REFERENCE = "M.White"
UNCLEAR_COLUMNS = ["IsPHI_MAJOR", "PHI_CNT", "IsPHI_MINOR"]


def major_flags(major: str | Column = "major") -> dict[str, Column]:
    return {name: mentions(major, word) for name, word in MAJOR_FLAGS.items()}


def major_long(major_term: DataFrame) -> DataFrame:
    """Student x term with the major carried forward and its flags."""
    return calendar_rows(student_calendar(major_term)).withColumns(major_flags())


def raw_profile(profile: DataFrame) -> DataFrame:
    return distinct_rows(profile.drop(*UNCLEAR_COLUMNS))


def ever_majored(calendar: DataFrame) -> DataFrame:
    """Did the student ever have the major? Read off the series in the row."""
    word = MAJOR_FLAGS["current_phil"]
    hit = F.exists("series", lambda m: m.contains(word))
    return calendar.select("id", F.coalesce(hit, F.lit(False)).alias("ever_phil"))


def clean_profile(profile: DataFrame, ever: DataFrame) -> DataFrame:
    """Cleaned student table with the demographic groups."""
    df = keyed_join(renamed(raw_profile(profile), {"ID": "id"}), ever, ["id"], "left")
    df = renamed(lower_names(df), {"isfirstgeneration": "first_gen", "islowincome": "low_income"})
    df = across(df, ["first_gen", "low_income"], yes)
    df = df.withColumn(
        "race",
        F.when(mentions("ethnicity", "Native"), "Indigenous")
        .when(mentions("ethnicity", "Islander"), "Pacific Islander")
        .otherwise(F.col("race")),
    )
    df = df.withColumn("ethnicity", if_else(F.col("race") == "Other", F.lit("Other"), F.col("ethnicity")))
    df = df.withColumn("poc", not_in("race", ["White", "Other"]))
    df = df.withColumn("race4", collapse("race", RACE_GROUPS))
    return df.withColumn("demographic", cross_label("gender", "race4"))


def compact(calendar: DataFrame) -> DataFrame:
    """The calendar with each series as its changes: what a join should carry."""
    keys = ["id", "first_index", F.size("series").alias("series_length"), changes("series").alias("series_changes")]
    return calendar.select(*keys, *[c for c in calendar.columns if c not in ("id", "first_index", "series")])


def people_table(calendar: DataFrame, students: DataFrame) -> DataFrame:
    """One row per student: cleaned profile and the changes of the major."""
    return keyed_join(compact(calendar.select("id", "first_index", "series")), students, ["id"], "full")


def held_courses(phi_crs: DataFrame, people: DataFrame) -> DataFrame:
    """Student x course with the major held in that term and the columns of the student: what is worth storing.

    The major is picked from the changes of the student's series by term arithmetic, so the
    join brings one short row per student instead of one row per student and term.
    ``people`` is the student calendar, or :func:`people_table` to get the
    profile columns along with it: one join per fact table leaves Spark free to
    split the rows of a student who holds many of them.
    """
    people = compact(people) if "series" in people.columns else people
    df = phi_crs.select(
        F.col("E_PIDM").alias("id"),
        F.col("TERM").alias("__term"),
        F.col("CRN").alias("__crn"),
        F.col("COURSE_TITLE").alias("__title"),
        F.col("INSTRUCTOR").alias("__instructor"),
        lookup("COURSE_LETTER_GRADE", GRADE_POINTS).alias("__grade"),
        F.col("TERM_CUM_GPA").alias("__term_cum_gpa"),
    )
    names = df.columns[1:]
    df = keyed_join(df, people.drop("admit_term", "start"), ["id"], "left")
    major = changed_value_at_term("series_changes", "series_length", "first_index", "__term").alias("__major")
    extra = [c for c in people.columns if c not in ("id", "admit_term", "start", "first_index", "series_length", "series_changes")]
    return df.select("id", *names, major, *extra)


def fact_columns(held: DataFrame) -> DataFrame:
    """The facts of :func:`held_courses`: texts, flags and numbers that follow from its columns are neither moved nor stored."""
    course = join_text("__term", F.lit("_"), "__crn")
    given = {
        "term": F.col("__term"),
        "year": term_year("__term"),
        "quarter": term_quarter("__term"),
        "course_id": course,
        "id_title": squash_spaces(join_text("__term", F.lit("_"), "__crn", F.lit(" "), "__title")),
        "title": F.col("__title"),
        "instructor": F.col("__instructor"),
        "grade": F.col("__grade"),
        "term_cum_gpa": F.col("__term_cum_gpa"),
        "major": F.col("__major"),
    }
    extra = [c for c in held.columns if c != "id" and not c.startswith("__")]
    df = held.select("id", *[x.alias(name) for name, x in given.items()], *extra)
    names = ["id", *given]
    df = df.withColumns(major_flags()).withColumns(
        {
            "grade_diff": F.col("term_cum_gpa") - F.col("grade"),
            "other_major": F.col("human_dev") | F.col("bio_sci") | F.col("soc"),
        }
    )
    return df.select(*names, *MAJOR_FLAGS, "grade_diff", "other_major", *extra)


def course_facts(phi_crs: DataFrame, people: DataFrame) -> DataFrame:
    """Student x course with grade gap and the major held in that term."""
    return fact_columns(held_courses(phi_crs, people))


def course_totals(facts: DataFrame) -> DataFrame:
    """Size, means, counts and shares per course, from the student facts."""
    out = facts.groupBy("course_id").agg(
        F.count(F.lit(1)).alias("n_students"),
        F.avg("grade").alias("mean_grade"),
        F.avg("term_cum_gpa").alias("mean_cum_gpa"),
        F.avg("grade_diff").alias("mean_grade_diff"),
        strict_sum(flag(F.col("gender") == "F")).alias("women"),
        strict_sum(flag("poc")).alias("poc"),
        strict_sum(flag("first_gen")).alias("first_gen"),
        strict_sum(flag("low_income")).alias("low_income"),
        *[
            sum_or_zero(flag(c)).alias(c)
            for c in ["current_phil", "human_dev", "bio_sci", "soc", "other_major", "undeclared"]
        ],
    )
    return shares_of(out, columns_between(out, "women", "undeclared"), "n_students")


def course_gaps(facts: DataFrame) -> DataFrame:
    """Gap of each demographic group in each course against the reference."""
    return group_gap(facts, "grade_diff", ["course_id"], "demographic", ["id"], REFERENCE)


FIRST_FLAGS = ["human_dev", "bio_sci", "soc", "undeclared"]


def first_rows(facts: DataFrame) -> DataFrame:
    """Facts of each student's first term, ties included, with course counts.

    Terms are counted per student before anything is joined, so the first
    term, its size and the student's total come out of one small aggregate.
    """
    known = F.col("year").isNotNull() & F.col("quarter").isNotNull()
    at = F.when(known, F.struct("year", "quarter", "term", "n"))
    per = (
        facts.groupBy("id", "term", "year", "quarter")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("id")
        .agg(F.sum("n").alias("n_phil"), F.min(at).alias("__first"))
        .select("id", "n_phil", F.col("__first.term").alias("term"), F.col("__first.n").alias("n_first_phil"))
    )
    return keyed_join(facts, per, ["id", "term"], "inner")


def first_courses(facts: DataFrame) -> DataFrame:
    """One row per student and course of the student's first term, flat."""
    return first_rows(facts).select(
        "id",
        "course_id",
        F.col("major").alias("major_at_first_phil"),
        F.col("current_phil").alias("phil_at_first_phil"),
        *FIRST_FLAGS,
        "n_phil",
        "n_first_phil",
    )


def first_course_nested(facts: DataFrame) -> DataFrame:
    """One row per student with the first courses as an array."""
    return nest(first_courses(facts), ["course_id"], "first_phil_course")


def clean_courses(facts: DataFrame, totals: DataFrame) -> DataFrame:
    """Facts with the totals of their course.

    The totals come from these facts, so every course is on both sides and a
    left join gives the rows of a full one; it can be split at a hot course.
    """
    return keyed_join(facts, totals, ["course_id"], "left", suffixes=("_student", "_course"))


def student_output(students: DataFrame, nested: DataFrame) -> DataFrame:
    return natural_join(students, nested, "full")


def student_table(students: DataFrame, nested: DataFrame) -> DataFrame:
    """Students with first- and later-course counts, ready for description."""
    df = student_output(students, nested)
    df = df.withColumn("n_later_phil", F.col("n_phil") - F.col("n_first_phil"))
    df = across(df, ["ethnicity", "ethnicity_code"], explicit_missing)
    return df.withColumn("multiple_phil", F.col("n_later_phil") >= 1)


def course_table(courses: DataFrame) -> DataFrame:
    return courses.withColumns({"major": explicit_missing("major"), "term_posix": term_date("term")})


def analysis_table(facts: DataFrame, totals: DataFrame, gaps: DataFrame) -> DataFrame:
    """First courses of students with a binary gender in a named group.

    ``facts`` are the student facts. Their first-term rows are used directly:
    nesting them per student and joining them back to the facts would give the
    same rows after two more shuffles of the facts. ``totals`` and ``gaps`` are
    those of the facts: a course with gaps has totals.
    """
    names = columns_between(totals, "current_phil", "undeclared")
    first = first_rows(facts).filter(
        (F.col("gender") != "N")
        & (F.col("race4") != "Other")
        & F.col("major").isNotNull()
        & F.col("grade").isNotNull()
        & F.col("term_cum_gpa").isNotNull()
    )
    first = first.withColumns(
        {
            "major_at_first_phil": F.col("major"),
            "phil_at_first_phil": F.col("current_phil"),
            **{f"{c}_student": F.col(c) for c in names},
            "n_later_phil": F.col("n_phil") - F.col("n_first_phil"),
        }
    ).drop("current_phil", "other_major")
    first = across(first, ["ethnicity", "ethnicity_code"], explicit_missing)
    clash = set(first.columns) - {"course_id"}
    courses = totals.withColumnsRenamed(
        {c: f"{c}_course" for c in names}
        | {c: f"{c}_class" for c in totals.columns if c in clash and c not in names}
    )
    # a course's gaps travel with its totals, so the rows are moved once; rows without a group are gone
    cells = [c for c in gaps.columns if c != "course_id"]
    per = gaps.filter(F.col("demographic").isNotNull()).groupBy("course_id").agg(F.collect_list(F.struct(*cells)).alias("__gaps"))
    df = keyed_join(first, keyed_join(courses, per, ["course_id"], "left"), ["course_id"], "left")
    mine = F.filter("__gaps", lambda g: g["demographic"] == F.col("demographic"))
    df = df.select(*[c for c in df.columns if c != "__gaps"], F.explode_outer(mine).alias("__gap"))
    df = df.select("*", *[F.col("__gap")[c].alias(c) for c in cells if c != "demographic"]).drop("__gap")
    return df.withColumns(
        {
            "multiple_phil": F.col("n_later_phil") >= 1,
            "major": explicit_missing("major"),
            "term_posix": term_date("term"),
            "year_number": F.col("year"),
            "year": F.col("year").cast("string"),
            "quarter": F.col("quarter").cast("string"),
        }
    )


class Stages(Mapping):
    """Tables by name, each made when it is first asked for and then kept.

    A report that reads one stage does not pay for the others.
    """

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def build(
    profile: DataFrame,
    phi_crs: DataFrame,
    major_term: DataFrame,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> Stages:
    """All stages of the plan by name.

    ``keep`` may store the calendar and what the student facts follow from, which all other
    stages read, when the first of them is asked for; without it everything stays lazy.
    """
    makers = {
        "calendar": lambda: keep(student_calendar(major_term), "calendar"),
        "profile_clean": lambda: clean_profile(profile, ever_majored(out["calendar"])),
        "student_facts": lambda: fact_columns(
            keep(held_courses(phi_crs, people_table(out["calendar"], out["profile_clean"])), "student_facts")
        ),
        "crs_1": lambda: out["student_facts"].select(*columns_between(out["student_facts"], "id", "other_major")),
        "crs_2": lambda: course_totals(out["student_facts"]),
        "dmg": lambda: course_gaps(out["student_facts"]),
        "crs_4": lambda: first_course_nested(out["crs_1"]),
        "crs": lambda: clean_courses(out["crs_1"], out["crs_2"]),
        "profile": lambda: student_table(out["profile_clean"], out["crs_4"]),
        "analysis": lambda: analysis_table(out["student_facts"], out["crs_2"], out["dmg"]),
    }
    out = Stages(makers)
    return out

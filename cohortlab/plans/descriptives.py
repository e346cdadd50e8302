"""The descriptive tables over the curated stages, each one a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import terms, text
from cohortlab.operators import checks, profiles, reshape, scans, summaries, verbs

DEMOGRAPHICS = ["admission_type", "gender", "race", "first_gen", "low_income"]
COURSE_NUMBERS = ["n_students", "mean_grade", "mean_cum_gpa", "mean_grade_diff"]
COVARIATES = [
    "n_students",
    "mean_grade",
    "mean_cum_gpa",
    "women_share",
    "poc_share",
    "first_gen_share",
    "low_income_share",
    "ever_phil",
    "multiple_phil",
    "n_later_phil",
]
# a comma that does not belong to a program name
MAJOR_BREAK = r",(?![ F(Ph)])"


def raw_counts(profile: DataFrame, phi_crs: DataFrame) -> dict[str, DataFrame]:
    """Counts over the tables as delivered."""
    courses = summaries.count_by(phi_crs, "TERM", "CRN", "COURSE_TITLE")
    by_term = summaries.count_by(phi_crs, "TERM", "CRN")
    repeated = scans.with_group_size(courses, ["CRN"], "n_terms").filter("n_terms > 1")
    return {
        "missing": checks.missing_profile(profile),
        "gender": summaries.share_within(summaries.count_by(profile, "GENDER"), "n", name="frac"),
        "race": summaries.count_by(profile, "RACE"),
        "race_ethnicity": summaries.count_by(profile, "RACE", "ETHNICITY_CODE", "ETHNICITY"),
        "first_generation": summaries.count_by(profile, "IsFIRSTGENERATION"),
        "low_income": summaries.count_by(profile, "IsLOWINCOME"),
        "admission": summaries.count_by(profile, "ADMISSION_TYPE"),
        "terms": verbs.ordered(
            reshape.split_at(summaries.count_by(phi_crs, "TERM"), "TERM", 4, ["year", "quarter"], convert=True),
            "year",
            "quarter",
        ),
        "course_numbers_by_terms": summaries.count_of_counts(by_term, "CRN"),
        "repeated_course_numbers": verbs.ordered(repeated, "CRN", "TERM"),
        "course_sizes": summaries.count_of_counts(phi_crs, "TERM", "CRN"),
        "large_courses": verbs.ordered(courses.filter("n > 50"), "-n"),
        "letters": summaries.count_by(phi_crs, "COURSE_LETTER_GRADE"),
    }


def cohort_tables(stages: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Students, first courses and courses; ``stages`` is the registrar plan."""
    students, facts, crs_2, crs = (
        stages["profile"],
        stages["crs_1"],
        stages["crs_2"],
        stages["crs"],
    )
    flat = reshape.unnest(stages["crs_4"], "first_phil_course")
    everyone = summaries.marginal_profile(students, DEMOGRAPHICS)
    majors = summaries.marginal_profile(students.filter("ever_phil"), DEMOGRAPHICS)
    cors = profiles.correlations(crs_2, COURSE_NUMBERS + verbs.columns_like(crs_2, "_share$"))
    lines = verbs.distinct_rows(crs.select("term", "course_id", "women_share", "poc_share"))
    lines = lines.withColumn("term_posix", terms.term_date("term"))
    return {
        "first_term_courses": summaries.share_within(
            summaries.count_of_counts(flat, "id"), "nn", name="frac"
        ),
        "declared_first": summaries.share_within(
            summaries.count_by(stages["crs_4"], "phil_at_first_phil"), "n", name="frac"
        ),
        "majors_first": verbs.most_frequent(stages["crs_4"], "major_at_first_phil"),
        "gaps": summaries.mean_interval(stages["dmg"], "dmg", ["demographic"]),
        "demographics": verbs.stacked({"all": everyone, "majors": majors}, "students"),
        "intersections": summaries.count_by(
            students, "gender", "race", "first_gen", "low_income", "admission_type"
        ),
        "gender_race": verbs.most_frequent(students, "gender", "race"),
        "missing_grades": verbs.most_frequent(facts.filter(F.col("grade").isNull()), "instructor"),
        "years": summaries.count_by(facts, "year"),
        "admit_years": summaries.count_by(
            stages["calendar"].select(terms.term_year("admit_term").alias("year")), "year"
        ),
        "women_line": summaries.mean_se(lines, "women_share", ["term", "term_posix"]),
        "poc_line": summaries.mean_se(lines, "poc_share", ["term", "term_posix"]),
        "course_correlations": cors.filter(F.col("cor") > 0.8).orderBy(F.desc("cor")),
    }


def analysis_tables(analysis: DataFrame) -> dict[str, DataFrame]:
    """Tables over the analysis rows (first courses)."""
    shares = verbs.columns_like(analysis, "_share$")
    numbers = analysis.select(
        "year", "year_number", *[F.col(c).cast("int").cast("double").alias(c) if c in ("ever_phil", "multiple_phil") else F.col(c).cast("double").alias(c) for c in COVARIATES]
    )
    long = reshape.longer(numbers, COVARIATES, "covariate", "value")
    middle = long.filter("year_number >= 2007 AND year_number < 2015")
    once = verbs.distinct_rows(analysis.select("id", "ever_phil", "term", "term_posix", "quarter"))
    by_instructor = reshape.longer(analysis.select("instructor", *shares), shares, "var", "value")
    majors = reshape.split_rows(summaries.count_by(analysis, "major"), "major", MAJOR_BREAK)
    majors = majors.groupBy("major").agg(F.sum("n").alias("n"))
    cors = profiles.correlations(analysis, [c for c in COVARIATES if c not in ("ever_phil", "multiple_phil")])
    return {
        "title_rates": summaries.flag_mean(analysis, "ever_phil", ["title"], "ever_phil"),
        "term_rates": summaries.flag_mean(
            once, "ever_phil", ["term", "term_posix", "quarter"], "ever_phil_share"
        ),
        "first_course_counts": summaries.count_by(analysis, "n_first_phil"),
        "years": summaries.count_by(analysis, "year"),
        "covariate_lines": summaries.mean_se(long, "value", ["covariate", "year"]),
        "covariate_trends": summaries.linear_trend(middle, "value", "year_number", ["covariate"]),
        "instructors": verbs.most_frequent(analysis, "instructor"),
        "instructor_shares": summaries.mean_se(by_instructor, "value", ["instructor", "var"]),
        "grade_gap": summaries.mean_interval(analysis, "grade_diff", ["demographic"]),
        "student_gap": summaries.entity_mean_interval(analysis, "dmg", ["id"], ["demographic"]),
        "strong_correlations": profiles.strong_pairs(cors),
        "courses": summaries.count_by(analysis, "title"),
        "majors": majors.select(text.capital("major").alias("college"), "major", "n"),
    }


def campus_lines(gender: DataFrame, race: DataFrame) -> dict[str, DataFrame]:
    """Campus-wide shares of women and of students of colour per term."""
    period = F.col("year").between(2005, 2015)
    coloured = ~F.coalesce(F.col("race").isin("White", "Other"), F.lit(False))
    return {
        "women": gender.filter((F.col("gender") == "F") & period).select("term", "term_posix", "frac"),
        "poc": race.filter(coloured & period).groupBy("term", "term_posix").agg(F.sum("frac").alias("frac")),
    }

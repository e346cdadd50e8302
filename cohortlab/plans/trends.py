"""Campus-wide trend pages to long count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.recode import recode
from cohortlab.functions.terms import term_date
from cohortlab.functions.text import number_in
from cohortlab.operators.summaries import share_within

# Table names by position on a page.
TABLES = ["gender", "race"]

# Published labels to the labels of the student table.
GENDER_LABELS = {"Female": "F", "Male": "M", "Unknown": None}
RACE_LABELS = {
    "Asian-PI": "Asian",
    "African American": "Black",
    "Chicano-Latino": "Hispanic",
    "Other/Unknown": "Other",
    "Native American": "Indigenous",
    "White": "White",
}


def trend_rows(cells: DataFrame, page: str, quarter: str) -> DataFrame:
    """Table cells to counts with shares per page, table and year.

    ``cells`` is the output of the HTML reader plus the quarter code of the page.
    """
    names = F.array(*[F.lit(t) for t in TABLES])
    rows = cells.filter((F.col("label") != "Total") & (F.col("col_idx") > 0)).select(
        page,
        F.get(names, "table_idx").alias("table"),
        F.col("label").alias("category"),
        F.col("header").try_cast("int").alias("year"),
        number_in("value").alias("n"),
        F.col(quarter).alias("qtr"),
    )
    rows = share_within(rows, "n", [page, "table", "year"], "frac")
    return rows.withColumn("term", F.concat(F.col("year").cast("string"), "qtr"))


def gender_trend(trends: DataFrame) -> DataFrame:
    return trends.filter(F.col("table") == "gender").withColumns(
        {"gender": recode("category", GENDER_LABELS), "term_posix": term_date("term")}
    )


def race_trend(trends: DataFrame) -> DataFrame:
    return trends.filter(F.col("table") == "race").withColumns(
        {"race": recode("category", RACE_LABELS), "term_posix": term_date("term")}
    )

"""Calendar, ordered operators, curated stages and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.catalog.registry import curated, query, rounded, table
from cohortlab.catalog.standin import QUARTER_OF_MONTH
from cohortlab.functions import recode, terms
from cohortlab.operators import calendar, profiles, reshape, scans, summaries, verbs
from cohortlab.plans import registrar

# ---- calendar ------------------------------------------------------------

ORDER_TERM = """CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN month(o_orderdate) <= 2 THEN '01' WHEN month(o_orderdate) <= 4 THEN '03'
    WHEN month(o_orderdate) <= 6 THEN '05' WHEN month(o_orderdate) <= 9 THEN '07' ELSE '10' END"""


def _order_terms(spark, d):
    qtr = recode.lookup(F.month("o_orderdate"), QUARTER_OF_MONTH)
    return table(spark, d, "orders").withColumn(
        "term", F.concat(F.year("o_orderdate").cast("string"), qtr)
    )


@query(
    "next_term",
    f"""WITH t AS (SELECT o_orderkey, {ORDER_TERM} AS term FROM orders)
        SELECT o_orderkey, term, CASE right(term, 2) WHEN '01' THEN left(term, 4) || '03' WHEN '03' THEN left(term, 4) || '05'
        WHEN '05' THEN left(term, 4) || '07' WHEN '07' THEN left(term, 4) || '10'
        ELSE (left(term, 4)::INT + 1) || '01' END AS following,
        CAST(make_date(left(term, 4)::INT, right(term, 2)::INT, 1) AS VARCHAR) AS opens FROM t""",
)
def next_term(spark, d):
    return _order_terms(spark, d).select(
        "o_orderkey",
        "term",
        terms.later_term("term").alias("following"),
        terms.term_date("term").cast("string").alias("opens"),
    )


@query(
    "term_sequences",
    f"""WITH t AS (SELECT o_custkey, min({ORDER_TERM}) AS first FROM orders GROUP BY 1),
        k AS (SELECT *, unnest(generate_series(0, 49)) AS k FROM t),
        p AS (SELECT *, list_position(['01','03','05','07','10'], right(first, 2)) - 1 + k AS i FROM k)
        SELECT o_custkey, CAST(k + 1 AS INT) AS term_idx,
          (left(first, 4)::INT + i // 5) || ['01','03','05','07','10'][CAST(i % 5 + 1 AS INT)] AS term FROM p""",
)
def term_sequences(spark, d):
    first = _order_terms(spark, d).groupBy("o_custkey").agg(F.min("term").alias("first"))
    rows = first.select("o_custkey", F.posexplode(calendar.term_sequence("first", 50)).alias("k", "term"))
    return rows.select("o_custkey", (F.col("k") + 1).alias("term_idx"), "term")


@query(
    "june_and_bad_terms",
    """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS raw FROM orders)
       SELECT o_orderkey, regexp_replace(raw, '06$', '07') AS repaired,
         right(regexp_replace(raw, '06$', '07'), 2) NOT IN ('01', '03', '05', '07', '10') AS bad FROM t""",
)
def june_and_bad_terms(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", terms.repair_june(F.date_format("o_orderdate", "yyyyMM")).alias("repaired")
    )
    return df.withColumn("bad", terms.term_index("repaired").isNull())


@query(
    "quarantined_terms",
    """SELECT strftime(o_orderdate, '%Y%m') AS raw, count(*) AS n FROM orders
       WHERE strftime(o_orderdate, '%m') NOT IN ('01', '03', '05', '07', '10') GROUP BY 1""",
)
def quarantined_terms(spark, d):
    df = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("raw"))
    return summaries.count_by(calendar.bad_terms(df, "raw"), "raw")


MAJOR_COLUMNS = "id, admit_term, rel_term, term, major, current_phil, human_dev, bio_sci, soc, undeclared"


@query("majors_by_term", f"SELECT {MAJOR_COLUMNS} FROM major_long", curated=True)
def majors_by_term(spark, d):
    rows = calendar.calendar_rows(curated(spark, d)["calendar"])
    return rows.withColumns(registrar.major_flags()).select(*MAJOR_COLUMNS.split(", "))


@query(
    "courses_before_admission",
    """SELECT c.id, c.course_id, c.term < a.admit_term AS before_admit FROM crs_1 c JOIN admit a ON c.id = a.id
       WHERE c.major IS NULL""",
    curated=True,
)
def courses_before_admission(spark, d):
    c = curated(spark, d)
    df = c["crs_1"].filter(F.col("major").isNull()).join(c["calendar"].select("id", "admit_term"), "id")
    return df.select("id", "course_id", (F.col("term") < F.col("admit_term")).alias("before_admit"))


# ---- ordered operators ---------------------------------------------------


@query(
    "event_sequence_numbers",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events",
)
def event_sequence_numbers(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = scans.sequence_number(df, "k", ["ts", "event_id"], ["user_id"], chunk=F.to_date("ts"))
    return out.select("event_id", "user_id", "k")


@query(
    "global_row_ids",
    "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS row_idx FROM orders",
)
def global_row_ids(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return scans.sequence_number(df, "row_idx", ["o_orderkey"])


@query(
    "last_price_carried",
    """SELECT event_id, user_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS price FROM events""",
)
def last_price_carried(spark, d):
    df = table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("price")
    )
    out = scans.carry_forward(df, ["price"], ["ts", "event_id"], ["user_id"], chunk=F.to_date("ts"))
    return rounded(out.select("event_id", "user_id", "price"), "price")


@query(
    "user_day_state",
    """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL),
       g AS (SELECT DISTINCT user_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM c)
       SELECT user_id, CAST(day AS VARCHAR) AS day, last_value(state IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM g LEFT JOIN c USING (user_id, day)""",
)
def user_day_state(spark, d):
    cells = (
        table(spark, d, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    )
    days = F.expr("sequence(date'2024-01-01', date'2024-01-30')")
    full = reshape.complete(cells, ["user_id"], "day", days)
    # a user has one row per day of the month
    out = scans.carry_forward(full, ["state"], ["day"], ["user_id"], bounded=True)
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "from_first_purchase",
    """SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' AND k = 1 THEN ts END) OVER (PARTITION BY user_id) AS start
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)) WHERE ts >= start""",
)
def from_first_purchase(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    bought = df.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first"))
    marked = df.join(bought, "user_id", "left")
    is_anchor = (F.col("event_type") == "purchase") & (F.col("ts") == F.col("first"))
    return scans.from_anchor(marked, is_anchor, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id")


@query(
    "first_month_orders",
    """SELECT o_custkey, o_orderkey FROM (SELECT *, min(date_trunc('month', o_orderdate)) OVER (PARTITION BY o_custkey) AS first FROM orders)
       WHERE date_trunc('month', o_orderdate) = first""",
)
def first_month_orders(spark, d):
    df = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    )
    return scans.first_period(df, ["o_custkey"], ["year", "month"]).select("o_custkey", "o_orderkey")


# ---- the same operators with unknown keys and unknown order values --------

UNKNOWN_SQL = """WITH e AS (SELECT event_id, nullif(user_id, 3) AS u, CASE WHEN event_id % 11 <> 0 THEN event_id // 7 END AS t,
    event_type, CASE WHEN event_type = 'purchase' THEN value END AS price FROM events)
"""


def _unknown(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.nullif("user_id", F.lit(3)).alias("u"),
        F.when(F.col("event_id") % 11 != 0, F.expr("event_id div 7")).alias("t"),
        "event_type",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("price"),
    )


@query(
    "price_carried_unknown",
    UNKNOWN_SQL
    + """SELECT event_id, u, round(last_value(price IGNORE NULLS) OVER (PARTITION BY u ORDER BY t NULLS LAST, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS price FROM e""",
)
def price_carried_unknown(spark, d):
    out = scans.carry_forward(_unknown(spark, d), ["price"], ["t", "event_id"], ["u"], chunks=5)
    return rounded(out.select("event_id", "u", "price"), "price")


@query(
    "next_event_unknown",
    UNKNOWN_SQL + "SELECT event_id, u, lead(event_id) OVER (PARTITION BY u ORDER BY t NULLS LAST, event_id) AS following FROM e",
)
def next_event_unknown(spark, d):
    out = scans.next_value(_unknown(spark, d), "event_id", "following", ["t", "event_id"], ["u"], chunks=5)
    return out.select("event_id", "u", "following")


@query(
    "from_last_purchase_unknown",
    UNKNOWN_SQL
    + """SELECT event_id, u FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN k END) OVER (PARTITION BY u) AS start
        FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t NULLS LAST, event_id) AS k FROM e)) WHERE k >= start""",
)
def from_last_purchase_unknown(spark, d):
    out = scans.from_anchor(_unknown(spark, d), F.col("event_type") == "purchase", ["t", "event_id"], ["u"])
    return out.select("event_id", "u")


@query(
    "first_period_unknown",
    UNKNOWN_SQL + "SELECT event_id, u FROM (SELECT *, min(t) OVER (PARTITION BY u) AS first FROM e) WHERE t = first",
)
def first_period_unknown(spark, d):
    return scans.first_period(_unknown(spark, d), ["u"], ["t"]).select("event_id", "u")


@query(
    "later_course_counts",
    """SELECT DISTINCT id, n_phil, n_first_phil, n_later_phil, multiple_phil FROM students WHERE n_phil IS NOT NULL""",
    curated=True,
)
def later_course_counts(spark, d):
    df = curated(spark, d)["profile"].filter("n_phil is not null")
    return df.select("id", "n_phil", "n_first_phil", "n_later_phil", "multiple_phil")


@query(
    "cut_points_to_intervals",
    """SELECT l_suppkey, l_quantity AS low, lead(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS high
       FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem)""",
)
def cut_points_to_intervals(spark, d):
    cuts = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("low")).distinct()
    return scans.next_value(cuts, "low", "high", ["low"], ["l_suppkey"], chunk=F.floor(F.col("low") / 10))


# ---- curated stages ------------------------------------------------------

FACTS = "id, term, year, quarter, course_id, id_title, title, instructor, grade, term_cum_gpa, major, current_phil, human_dev, bio_sci, soc, undeclared, grade_diff, other_major"


@query(
    "course_facts",
    "SELECT "
    + FACTS.replace("term_cum_gpa", "round(term_cum_gpa, 6) AS term_cum_gpa").replace(
        "grade_diff", "round(grade_diff, 6) + 0.0 AS grade_diff"
    )
    + " FROM crs_1",
    curated=True,
)
def course_facts(spark, d):
    return rounded(curated(spark, d)["crs_1"].select(*FACTS.split(", ")), "term_cum_gpa", "grade_diff")


MEANS = ["mean_grade", "mean_cum_gpa", "mean_grade_diff"]
COUNTS = ["women", "poc", "first_gen", "low_income", "current_phil", "human_dev", "bio_sci", "soc", "other_major", "undeclared"]


@query(
    "course_totals",
    "SELECT course_id, n_students, "
    + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in MEANS)
    + ", "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}, round({c}_share, 6) + 0.0 AS {c}_share" for c in COUNTS)
    + " FROM crs_2",
    curated=True,
)
def course_totals(spark, d):
    df = rounded(curated(spark, d)["crs_2"], *MEANS, *[f"{c}_share" for c in COUNTS])
    return verbs.across(df, COUNTS, lambda c: c.cast("double"))


@query(
    "group_gaps",
    "SELECT course_id, demographic, round(dmg, 6) + 0.0 AS dmg FROM dmg",
    curated=True,
)
def group_gaps(spark, d):
    return rounded(curated(spark, d)["dmg"], "dmg")


@query("reference_gap", "SELECT round(ref, 6) + 0.0 AS ref FROM ref_gap", curated=True)
def reference_gap(spark, d):
    df = curated(spark, d)["student_facts"]
    ref = summaries.mean_of_means(df.filter(F.col("demographic") == "M.White"), "grade_diff", ["id"], "ref")
    return rounded(ref, "ref")


ANALYSIS = "id, course_id, demographic, ever_phil, n_later_phil, multiple_phil, major_at_first_phil, grade, dmg, grade_diff, n_students, year, quarter, current_phil_share, undeclared_student"


@query(
    "analysis_rows",
    "SELECT "
    + ANALYSIS.replace(" dmg,", " round(dmg, 6) + 0.0 AS dmg,")
    .replace(" grade_diff,", " round(grade_diff, 6) + 0.0 AS grade_diff,")
    .replace(" current_phil_share,", " round(current_phil_share, 6) + 0.0 AS current_phil_share,")
    + " FROM analysis",
    curated=True,
)
def analysis_rows(spark, d):
    df = curated(spark, d)["analysis"].select(*ANALYSIS.split(", "))
    return rounded(df, "dmg", "grade_diff", "current_phil_share")


@query(
    "student_output",
    "SELECT id, demographic, ever_phil, major_at_first_phil, ethnicity, n_first_phil::DOUBLE AS n_first_phil FROM (SELECT DISTINCT * EXCLUDE (course_id) FROM students)",
    curated=True,
)
def student_output(spark, d):
    return curated(spark, d)["profile"].select(
        "id", "demographic", "ever_phil", "major_at_first_phil", "ethnicity", F.col("n_first_phil").cast("double").alias("n_first_phil")
    )


# ---- counts and shares ---------------------------------------------------


@query(
    "demographic_crosstab",
    "SELECT gender, race, first_gen, low_income, admission_type, count(*) AS n FROM profile_clean GROUP BY ALL",
    curated=True,
)
def demographic_crosstab(spark, d):
    df = curated(spark, d)["profile_clean"]
    return summaries.count_by(df, "gender", "race", "first_gen", "low_income", "admission_type")


@query(
    "courses_per_first_term",
    "SELECT n, nn, round(nn / sum(nn) OVER (), 6) AS frac FROM (SELECT n, count(*) AS nn FROM (SELECT id, count(*) AS n FROM crs_4 GROUP BY id) GROUP BY n)",
    curated=True,
)
def courses_per_first_term(spark, d):
    flat = reshape.unnest(curated(spark, d)["crs_4"], "first_phil_course")
    return rounded(summaries.share_within(summaries.count_of_counts(flat, "id"), "nn", name="frac"), "frac")


@query(
    "course_size_beside_rows",
    "SELECT l_orderkey, l_linenumber, l_suppkey, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem",
)
def course_size_beside_rows(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return scans.with_group_size(df, ["l_suppkey", "l_returnflag"]).drop("l_returnflag")


@query(
    "declared_at_first_course",
    """SELECT phil_at_first_phil, n, round(n / sum(n) OVER (), 6) AS frac FROM
       (SELECT phil_at_first_phil, count(*) AS n FROM (SELECT DISTINCT id, phil_at_first_phil FROM crs_4) GROUP BY 1)""",
    curated=True,
)
def declared_at_first_course(spark, d):
    counts = summaries.count_by(curated(spark, d)["crs_4"], "phil_at_first_phil")
    return rounded(summaries.share_within(counts, "n", name="frac"), "frac")


@query(
    "language_shares",
    """SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share
       FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)""",
)
def language_shares(spark, d):
    counts = summaries.count_by(table(spark, d, "documents").select("source", "lang"), "source", "lang")
    return rounded(summaries.share_within(counts, "n", ["source"]), "share")


@query(
    "ever_majored",
    "SELECT id, ever_phil FROM ever",
    curated=True,
)
def ever_majored(spark, d):
    return registrar.ever_majored(curated(spark, d)["calendar"])


@query(
    "ever_returned",
    "SELECT o_custkey, coalesce(bool_or(nullif(l_linenumber, 7) > 0 AND l_returnflag = 'R'), false) AS ever FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def ever_returned(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    df = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    test = (F.nullif(F.col("l_linenumber"), F.lit(7)) > 0) & (F.col("l_returnflag") == "R")
    return summaries.ever(df, ["o_custkey"], test, "ever")


INTERVAL = """round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, n, round(sd / sqrt(n), 6) AS se,
    round(mean - 1.959963984540054 * sd / sqrt(n), 6) + 0.0 AS ci_lo, round(mean + 1.959963984540054 * sd / sqrt(n), 6) + 0.0 AS ci_hi"""
INTERVAL_COLUMNS = ["mean", "sd", "se", "ci_lo", "ci_hi"]


@query(
    "gap_intervals_by_group",
    f"""SELECT demographic, {INTERVAL} FROM (SELECT demographic, CASE WHEN count(dmg) = count(*) THEN avg(dmg) END AS mean,
        CASE WHEN count(dmg) = count(*) THEN stddev_samp(dmg) END AS sd, count(*) AS n FROM dmg GROUP BY 1)""",
    curated=True,
)
def gap_intervals_by_group(spark, d):
    return rounded(summaries.mean_interval(curated(spark, d)["dmg"], "dmg", ["demographic"]), *INTERVAL_COLUMNS)


@query(
    "gap_intervals_by_student",
    f"""WITH s AS (SELECT demographic, id, CASE WHEN count(grade_diff) = count(*) THEN avg(grade_diff) END AS m FROM analysis GROUP BY ALL)
        SELECT demographic, {INTERVAL} FROM (SELECT demographic, CASE WHEN count(m) = count(*) THEN avg(m) END AS mean,
        CASE WHEN count(m) = count(*) THEN stddev_samp(m) END AS sd, count(*) AS n FROM s GROUP BY 1)""",
    curated=True,
)
def gap_intervals_by_student(spark, d):
    df = curated(spark, d)["analysis"]
    out = summaries.entity_mean_interval(df, "grade_diff", ["id"], ["demographic"])
    return rounded(out, *INTERVAL_COLUMNS)


@query(
    "major_rate_by_title",
    "SELECT title, count(*) AS n, round(avg(ever_phil::INT), 6) AS ever_phil FROM analysis GROUP BY 1",
    curated=True,
)
def major_rate_by_title(spark, d):
    return rounded(summaries.flag_mean(curated(spark, d)["analysis"], "ever_phil", ["title"], "ever_phil"), "ever_phil")


@query(
    "major_rate_by_term",
    """SELECT term, quarter, round(avg(ever_phil::INT), 6) AS ever_phil_share, count(*) AS n
       FROM (SELECT DISTINCT id, ever_phil, term, quarter FROM analysis) GROUP BY ALL""",
    curated=True,
)
def major_rate_by_term(spark, d):
    df = curated(spark, d)["analysis"].select("id", "ever_phil", "term", "quarter")
    out = summaries.flag_mean(verbs.distinct_rows(df), "ever_phil", ["term", "quarter"], "ever_phil_share")
    return rounded(out, "ever_phil_share")


@query(
    "women_share_lines",
    """WITH c AS (SELECT DISTINCT left(course_id, 6) AS term, course_id, women_share FROM crs_2),
       a AS (SELECT 'courses' AS series, term, avg(women_share) AS mean, stddev_samp(women_share) / sqrt(count(women_share)) AS se FROM c GROUP BY 2),
       f AS (SELECT DISTINCT p.id, p.term, gender FROM phi_crs p LEFT JOIN profile_clean s ON p.id = s.id),
       b AS (SELECT 'campus' AS series, term, sum((gender = 'F')::INT) / count(gender) AS mean FROM f WHERE left(term, 4)::INT BETWEEN 1996 AND 2000 GROUP BY 2)
       SELECT series, term, round(mean, 6) + 0.0 AS mean, round(mean - se, 6) + 0.0 AS low, round(mean + se, 6) + 0.0 AS high FROM a
       UNION ALL SELECT series, term, round(mean, 6) + 0.0, NULL, NULL FROM b""",
    curated=True,
)
def women_share_lines(spark, d):
    c = curated(spark, d)
    courses = verbs.distinct_rows(c["crs"].select("term", "course_id", "women_share"))
    line = summaries.mean_se(courses, "women_share", ["term"]).drop("se")
    people = verbs.distinct_rows(c["student_facts"].select("id", "term", "gender"))
    campus = people.filter(terms.term_year("term").between(1996, 2000)).groupBy("term").agg(
        F.avg((F.col("gender") == "F").cast("int")).alias("mean")
    )
    out = verbs.stacked({"courses": line, "campus": campus}, "series")
    return rounded(out, "mean", "low", "high")


@query(
    "numeric_profile",
    """SELECT variable, count(*) - count(x) AS missing, count(x) AS complete, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd,
       min(x) AS p0, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS p100
       FROM (SELECT 'quantity' AS variable, l_quantity AS x FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem
         UNION ALL SELECT 'line', nullif(l_linenumber, 7)::DOUBLE FROM lineitem) GROUP BY 1""",
)
def numeric_profile(spark, d):
    df = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.nullif(F.col("l_linenumber"), F.lit(7)).cast("double").alias("line"),
    )
    return rounded(profiles.numeric_profile(df, ["quantity", "price", "line"]), "mean", "sd")


@query(
    "price_histogram",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1""",
)
def price_histogram(spark, d):
    return profiles.histogram(table(spark, d, "orders"), "o_totalprice")


@query(
    "top_levels",
    """WITH l AS (SELECT 'race' AS variable, race AS value FROM profile_clean UNION ALL SELECT 'gender', gender FROM profile_clean
         UNION ALL SELECT 'ethnicity', ethnicity FROM profile_clean),
       c AS (SELECT variable, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)
       SELECT *, count(*) OVER (PARTITION BY variable) AS n_unique,
         CAST(row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS INT) AS rank FROM c
       QUALIFY rank <= 4""",
    curated=True,
)
def top_levels(spark, d):
    return profiles.top_values(curated(spark, d)["profile_clean"], ["race", "gender", "ethnicity"])


@query(
    "column_profile",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
       h AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7) AS bin, count(*) AS n FROM orders, e GROUP BY 1),
       c AS (SELECT nullif(o_orderpriority, '5-LOW') AS v, count(*) AS n FROM orders GROUP BY 1),
       t AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS r FROM c WHERE v IS NOT NULL)
       SELECT 'price' AS variable, 'numeric' AS kind, 0::BIGINT AS missing, count(*) AS complete, round(avg(o_totalprice), 4) AS mean,
         round(quantile_cont(o_totalprice, 0.25), 4) AS p25, (SELECT string_agg(n, ',' ORDER BY bin) FROM h) AS hist,
         NULL::DOUBLE AS n_unique, NULL AS top_counts FROM orders
       UNION ALL SELECT 'priority', 'categorical', count(*) - count(nullif(o_orderpriority, '5-LOW')), count(nullif(o_orderpriority, '5-LOW')),
         NULL, NULL, NULL, count(DISTINCT nullif(o_orderpriority, '5-LOW')), (SELECT string_agg(v || ': ' || n, ', ' ORDER BY r) FROM t WHERE r <= 4) FROM orders""",
)
def column_profile(spark, d):
    df = table(spark, d, "orders").select(
        F.col("o_totalprice").alias("price"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority")
    )
    out = profiles.column_profile(df, ["price"], ["priority"])
    return rounded(
        out.select(
            "variable",
            "kind",
            "missing",
            "complete",
            "mean",
            "p25",
            F.array_join("hist", ",").alias("hist"),
            F.col("n_unique").cast("double").alias("n_unique"),
            "top_counts",
        ),
        "mean",
        "p25",
        digits=4,
    )


DEMOGRAPHICS = ["admission_type", "gender", "race", "first_gen", "low_income"]


@query(
    "marginal_profiles",
    "WITH l AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, ever_phil FROM profile_clean" for c in DEMOGRAPHICS
    )
    + """), b AS (SELECT 'all' AS students, variable, value, count(*) AS n FROM l GROUP BY ALL
         UNION ALL SELECT 'majors', variable, value, count(*) FROM l WHERE ever_phil GROUP BY ALL)
       SELECT *, round(n / sum(n) OVER (PARTITION BY students, variable), 6) AS share FROM b""",
    curated=True,
)
def marginal_profiles(spark, d):
    df = curated(spark, d)["profile_clean"]
    both = {
        "all": summaries.marginal_profile(df, DEMOGRAPHICS),
        "majors": summaries.marginal_profile(df.filter("ever_phil"), DEMOGRAPHICS),
    }
    return rounded(verbs.stacked(both, "students"), "share")


COR = ["n_students", "mean_grade", "mean_cum_gpa", "women_share", "poc_share", "first_gen_share"]


@query(
    "course_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"Var1\", '{b}' AS \"Var2\", round(corr({a}, {b}), 6) + 0.0 AS cor FROM crs_2"
        for a in sorted(COR)
        for b in sorted(COR)
        if a > b
    ),
    curated=True,
)
def course_correlations(spark, d):
    return rounded(profiles.correlations(curated(spark, d)["crs_2"], COR), "cor")


@query(
    "strong_correlations",
    """WITH t AS (SELECT l_quantity AS q, l_extendedprice AS p, l_quantity * (1 + l_discount / 10) AS w,
          CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS flag FROM lineitem),
       c AS (SELECT 'q' AS "Var1", 'p' AS "Var2", corr(q, p) AS cor FROM t UNION ALL SELECT 'w', 'p', corr(w, p) FROM t
         UNION ALL SELECT 'w', 'q', corr(w, q) FROM t UNION ALL SELECT 'q', 'flag', corr(q, flag) FROM t)
       SELECT "Var1", "Var2", round(cor, 6) AS cor FROM c WHERE abs(cor) > 0.8""",
)
def strong_correlations(spark, d):
    df = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("p"),
        (F.col("l_quantity") * (1 + F.col("l_discount") / 10)).alias("w"),
        F.col("l_returnflag").alias("flag"),
    )
    cors = profiles.correlations(df, ["q", "p", "w", "flag"], {"flag": ["R", "A", "N"]})
    return rounded(profiles.strong_pairs(cors), "cor")


COVARIATES = ["n_students", "mean_grade", "women_share", "poc_share", "n_later_phil"]


@query(
    "covariate_trends",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS covariate, regr_count({c}, year_number) AS n, round(regr_slope({c}, year_number), 6) + 0.0 AS slope,
            round(regr_r2({c}, year_number), 6) AS r2 FROM analysis WHERE year_number >= 1996 AND year_number < 2001"""
        for c in COVARIATES
    ),
    curated=True,
)
def covariate_trends(spark, d):
    df = curated(spark, d)["analysis"].filter("year_number >= 1996 AND year_number < 2001")
    df = df.select("year_number", *[F.col(c).cast("double").alias(c) for c in COVARIATES])
    long = reshape.longer(df, COVARIATES, "covariate", "value")
    out = summaries.linear_trend(long, "value", "year_number", ["covariate"]).drop("intercept")
    return rounded(out, "slope", "r2")


@query(
    "covariate_lines",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS covariate, year, round(avg({c}), 6) + 0.0 AS mean,
            round(stddev_samp({c}) / sqrt(count({c})), 6) AS se FROM analysis GROUP BY year"""
        for c in COVARIATES
    ),
    curated=True,
)
def covariate_lines(spark, d):
    df = curated(spark, d)["analysis"]
    df = df.select("year", *[F.col(c).cast("double").alias(c) for c in COVARIATES])
    long = reshape.longer(df, COVARIATES, "covariate", "value")
    out = summaries.mean_se(long, "value", ["covariate", "year"]).select("covariate", "year", "mean", "se")
    return rounded(out, "mean", "se")


@query(
    "distinct_counts",
    "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1",
)
def distinct_counts(spark, d):
    df = table(spark, d, "lineitem")
    return summaries.distinct_by(df, ["l_returnflag"], {"n_suppliers": "l_suppkey", "n_parts": "l_partkey"})


@query(
    "instructor_composition",
    """SELECT r.gender, n_rows, n_entities FROM (SELECT gender_instructor AS gender, count(*) AS n_rows FROM modelled GROUP BY 1) r
       FULL JOIN (SELECT gender, count(DISTINCT instructor) AS n_entities FROM faculty GROUP BY 1) e ON r.gender = e.gender""",
    curated=True,
)
def instructor_composition(spark, d):
    c = curated(spark, d)
    rows = c["modelled"].select(F.col("gender_instructor").alias("gender"))
    return summaries.composition(rows, c["faculty"], "gender", "instructor")


@query(
    "instructor_race_composition",
    """SELECT r.race, n_rows, n_entities FROM (SELECT race_instructor AS race, count(*) AS n_rows FROM modelled GROUP BY 1) r
       JOIN (SELECT race, count(DISTINCT instructor) AS n_entities FROM faculty GROUP BY 1) e ON r.race = e.race""",
    curated=True,
)
def instructor_race_composition(spark, d):
    c = curated(spark, d)
    rows = c["modelled"].select(F.col("race_instructor").alias("race"))
    known = c["faculty"].filter(F.col("race").isNotNull())
    return summaries.composition(rows, known, "race", "instructor")


@query(
    "demographic_components",
    """WITH t AS (SELECT CASE gender WHEN 'M' THEN 1 WHEN 'F' THEN 2 ELSE 3 END::DOUBLE AS a, poc::INT::DOUBLE AS b FROM profile_clean WHERE gender IS NOT NULL),
       c AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab FROM t),
       e AS (SELECT va + vb AS total, (va + vb) / 2 AS mid, sqrt(((va - vb) / 2) ** 2 + ab ** 2) AS r FROM c)
       SELECT 1::INT AS component, round(sqrt(mid + r), 6) AS sdev, round((mid + r) / total, 6) AS share FROM e
       UNION ALL SELECT 2, round(sqrt(mid - r), 6), round((mid - r) / total, 6) FROM e""",
    curated=True,
)
def demographic_components(spark, d):
    df = curated(spark, d)["profile_clean"].select(
        recode.level_index("gender", ["M", "F", "N"]).alias("gender"), F.col("poc").cast("int").alias("poc")
    )
    out = profiles.principal_components(df, ["gender", "poc"])
    return rounded(out.select("component", "sdev", "share").distinct(), "sdev", "share")


LOADED = ["gender", "poc", "first_gen", "low_income", "admission_type"]


def _loadings_sql(rows: str, names: list[str]) -> str:
    """Components of the covariance matrix one after the other.

    Powers of a matrix, squared and scaled again and again, become the projection on its
    first component; that is taken out and the next one found. The projection's largest
    diagonal cell gives the column whose largest loading is positive.
    """
    k = len(names)
    matrix = "[" + ", ".join("[" + ", ".join(f"covar_samp({a}, {b})" for b in names) + "]" for a in names) + "]"
    cell = f"list_sum(list_transform(range({k}), lambda z: {{a}}[i + 1][z + 1] * {{b}}[z + 1][j + 1]))"

    def each(value: str) -> str:
        return f"list_transform(range({k}), lambda i: list_transform(range({k}), lambda j: {value}))"

    trace = f"list_sum(list_transform(range({k}), lambda t: {{}}[t + 1][t + 1]))"
    parts = [f"t AS ({rows})", f"c1 AS (SELECT {matrix} AS m FROM t)", f"whole AS (SELECT {trace.format('m')} AS total FROM c1)"]
    for n in range(1, k + 1):
        parts.append(
            f"""s{n} AS (SELECT 0 AS i, m FROM c{n} UNION ALL SELECT it, {each(f"m2[i + 1][j + 1] / {trace.format('m2')}")}
              FROM (SELECT i + 1 AS it, {each(cell.format(a="m", b="m"))} AS m2 FROM s{n} WHERE i < 14))"""
        )
        parts.append(
            f"""p{n} AS (SELECT s.m AS p, {trace.format(f"({each(cell.format(a='s.m', b='c.m'))})")} AS power FROM s{n} s, c{n} c WHERE s.i = 14)"""
        )
        parts.append(f"c{n + 1} AS (SELECT {each('c.m[i + 1][j + 1] - p.power * p.p[i + 1][j + 1]')} AS m FROM c{n} c, p{n} p)")
    rows_of = " UNION ALL ".join(
        f"""SELECT {n}::INT AS component, power, {[*names]} AS names, list_transform(range({k}), lambda i: p[i + 1][b] / sqrt(p[b][b])) AS axis
            FROM (SELECT *, list_position(list_transform(range({k}), lambda i: p[i + 1][i + 1]), list_max(list_transform(range({k}), lambda i: p[i + 1][i + 1]))) AS b FROM p{n})"""
        for n in range(1, k + 1)
    )
    return f"""SELECT * FROM (WITH RECURSIVE {", ".join(parts)}
        SELECT component, round(sqrt(power), 6) AS sdev, round(power / total, 6) AS share, unnest(names) AS variable, round(unnest(axis), 6) + 0.0 AS loading
        FROM ({rows_of}), whole)"""


@query(
    "demographic_loadings",
    _loadings_sql(
        """SELECT CASE gender WHEN 'M' THEN 1 WHEN 'F' THEN 2 ELSE 3 END::DOUBLE AS gender, poc::INT::DOUBLE AS poc, first_gen::INT::DOUBLE AS first_gen,
           low_income::INT::DOUBLE AS low_income, CASE admission_type WHEN 'Freshman' THEN 1 WHEN 'Transfer' THEN 2 END::DOUBLE AS admission_type FROM profile_clean
           WHERE gender IS NOT NULL AND poc IS NOT NULL AND first_gen IS NOT NULL AND low_income IS NOT NULL AND admission_type IN ('Freshman', 'Transfer')""",
        LOADED,
    ),
    curated=True,
)
def demographic_loadings(spark, d):
    df = curated(spark, d)["profile_clean"].select(
        recode.level_index("gender", ["M", "F", "N"]).alias("gender"),
        F.col("poc").cast("int").alias("poc"),
        F.col("first_gen").cast("int").alias("first_gen"),
        F.col("low_income").cast("int").alias("low_income"),
        recode.level_index("admission_type", ["Freshman", "Transfer"]).alias("admission_type"),
    )
    return rounded(profiles.principal_components(df, df.columns), "sdev", "share", "loading")

"""Sources, projection, reshaping, joins, ordering and scalar functions."""

from __future__ import annotations


from pyspark.sql import functions as F

from cohortlab.catalog.registry import curated, query, rnd, rounded, table
from cohortlab.functions import missing, numbers, recode, text
from cohortlab.operators import checks, joins, reshape, summaries, verbs
from cohortlab.operators.calendar import calendar_rows
from cohortlab.plans import registrar, trends
from cohortlab.plans.descriptives import MAJOR_BREAK
from cohortlab.sources.html import list_links, table_cells
from cohortlab.sources.tables import load, lookup_table, read_files


# ---- sources -------------------------------------------------------------


@query(
    "typed_load",
    "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 6) + 0.0 AS s_acctbal FROM supplier",
)
def typed_load(spark, d):
    schema = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
    return rounded(load(spark, d, ["supplier"], {"supplier": schema})["supplier"], "s_acctbal")


@query(
    "file_constant",
    "SELECT 'spring' AS season, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL",
)
def file_constant(spark, d):
    df = read_files(spark, {f"{d}/lineitem.parquet": "spring"}, "season")
    return summaries.count_by(df, "season", "l_returnflag")


@query(
    "files_with_constants",
    """SELECT 'country' AS kind, n_name AS name, count(*) AS n FROM nation GROUP BY ALL
       UNION ALL SELECT 'continent', NULL, count(*) FROM region""",
)
def files_with_constants(spark, d):
    paths = {f"{d}/nation.parquet": "country", f"{d}/region.parquet": "continent"}
    return summaries.count_by(read_files(spark, paths, "kind", schema="n_name string"), "kind", F.col("n_name").alias("name"))


@query(
    "page_list_links",
    r"""SELECT page_id, CAST(i - 1 AS INT) AS item_idx, hrefs[i] AS href FROM (
        SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS hrefs,
        unnest(generate_series(1, len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)))) AS i FROM pages)""",
)
def page_list_links(spark, d):
    return list_links(table(spark, d, "pages"), "page_id", "html").drop("text")


STATUS_LABELS = {"F": "Female", "O": "Male", "P": "Unknown"}
PRIORITY_LABELS = {
    "1-URGENT": "Asian-PI",
    "2-HIGH": "African American",
    "3-MEDIUM": "Chicano-Latino",
    "4-NOT SPECIFIED": "Other/Unknown",
    "5-LOW": "White",
}
def trend_pages(spark, d):
    """One HTML page per quarter and nation with two nested count tables."""
    from cohortlab.catalog.standin import QUARTER_OF_MONTH

    o = table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    qtr = recode.lookup(F.month("o_orderdate"), QUARTER_OF_MONTH)
    marks = F.array(
        F.struct(F.lit(0).alias("tab"), recode.lookup("o_orderstatus", STATUS_LABELS).alias("label")),
        F.struct(F.lit(1).alias("tab"), recode.lookup("o_orderpriority", PRIORITY_LABELS).alias("label")),
    )
    long = o.select(
        F.concat(qtr, F.lit("_"), F.col("c_nationkey").cast("string")).alias("page"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.explode(marks).alias("m"),
    ).select("page", "year", "m.*")
    span = long.agg(F.min("year"), F.max("year")).first()
    years = [str(y) for y in range(int(span[0]), int(span[1]) + 1)] if span[0] else []
    counts = long.groupBy("page", "tab", "label").pivot("year", years).agg(F.count(F.lit(1)))
    body = F.concat(
        F.lit("<tr><td>"),
        "label",
        F.lit("</td>"),
        *[
            F.concat(F.lit("<td>"), F.coalesce(F.format_number(y, 0), F.lit("")), F.lit("</td>"))
            for y in years
        ],
        F.lit("</tr>"),
    )
    head = "<tr><th>Label</th>" + "".join(f"<th>{y}</th>" for y in years) + "</tr>"
    total = "<tr><td>Total</td>" + "<td>1</td>" * len(years) + "</tr>"
    # at most eight label rows per page
    tables = counts.groupBy("page", "tab").agg(
        F.concat(
            F.lit('<table id="main"><tr><td><table>' + head),
            F.array_join(F.array_sort(F.collect_list(body)), ""),
            F.lit(total + "</table></td></tr></table>"),
        ).alias("t")
    )
    return tables.groupBy("page").agg(
        F.concat(
            F.lit("<html><body><table><tr><td>"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tab", "t"))), lambda x: x["t"]), ""),
            F.lit("</td></tr></table></body></html>"),
        ).alias("html")
    )


def _trend_table(spark, d):
    pages = trend_pages(spark, d)
    cells = table_cells(pages, "page", "html").withColumn("q", text.first_chars("page", 2))
    return trends.trend_rows(cells, "page", "q")


TREND_SQL = """
    WITH base AS (SELECT CASE WHEN month(o_orderdate) <= 2 THEN '01' WHEN month(o_orderdate) <= 4 THEN '03'
            WHEN month(o_orderdate) <= 6 THEN '05' WHEN month(o_orderdate) <= 9 THEN '07' ELSE '10' END AS qtr,
          c_nationkey, year(o_orderdate) AS year, o_orderstatus, o_orderpriority
        FROM orders JOIN customer ON o_custkey = c_custkey),
    long AS (SELECT qtr || '_' || c_nationkey AS page, qtr, year, 'gender' AS "table",
            CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' ELSE 'Unknown' END AS category FROM base
        UNION ALL SELECT qtr || '_' || c_nationkey, qtr, year, 'race', CASE o_orderpriority WHEN '1-URGENT' THEN 'Asian-PI'
            WHEN '2-HIGH' THEN 'African American' WHEN '3-MEDIUM' THEN 'Chicano-Latino'
            WHEN '4-NOT SPECIFIED' THEN 'Other/Unknown' ELSE 'White' END FROM base),
    counts AS (SELECT *, count(*) AS n FROM long GROUP BY ALL),
    grid AS (SELECT DISTINCT page, qtr, "table", category, unnest(generate_series((SELECT min(year) FROM base), (SELECT max(year) FROM base))) AS year FROM counts),
    trends AS (SELECT g.page, g."table", g.category, CAST(g.year AS INT) AS year, coalesce(c.n, 0)::DOUBLE AS n, g.qtr,
        coalesce(c.n, 0) / nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.page, g."table", g.year), 0) AS frac,
        g.year || g.qtr AS term
        FROM grid g LEFT JOIN counts c ON g.page = c.page AND g."table" = c."table" AND g.category = c.category AND g.year = c.year)
"""


@query("trend_tables", TREND_SQL + "SELECT * REPLACE (round(frac, 6) AS frac) FROM trends")
def trend_tables(spark, d):
    return rounded(_trend_table(spark, d), "frac")


@query(
    "trend_gender",
    TREND_SQL
    + """SELECT page, term, CAST(make_date(year, qtr::INT, 1) AS VARCHAR) AS term_posix,
        CASE category WHEN 'Female' THEN 'F' WHEN 'Male' THEN 'M' END AS gender, n FROM trends WHERE "table" = 'gender'""",
)
def trend_gender(spark, d):
    df = trends.gender_trend(_trend_table(spark, d))
    return df.select("page", "term", F.col("term_posix").cast("string").alias("term_posix"), "gender", "n")


@query(
    "trend_poc_share",
    TREND_SQL
    + """, raced AS (SELECT *, CASE category WHEN 'Asian-PI' THEN 'Asian' WHEN 'African American' THEN 'Black'
        WHEN 'Chicano-Latino' THEN 'Hispanic' WHEN 'Other/Unknown' THEN 'Other' ELSE category END AS race
        FROM trends WHERE "table" = 'race')
    SELECT page, term, round(sum(frac), 6) + 0.0 AS poc_share FROM raced
    WHERE race NOT IN ('White', 'Other') AND year >= 1996 AND year <= 2000 GROUP BY page, term""",
)
def trend_poc_share(spark, d):
    df = trends.race_trend(_trend_table(spark, d))
    df = df.filter(missing.not_in("race", ["White", "Other"]) & F.col("year").between(1996, 2000))
    return df.groupBy("page", "term").agg(rnd(F.sum("frac")).alias("poc_share"))


@query(
    "letter_counts_with_points",
    """SELECT p.letter, p.n, g.points FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B+'
        WHEN '3-MEDIUM' THEN 'B-' WHEN '4-NOT SPECIFIED' THEN 'NG' ELSE 'D' END AS letter, count(*) AS n FROM orders GROUP BY 1) p
       LEFT JOIN (VALUES ('A', 4.0::DOUBLE), ('B+', 3.3::DOUBLE), ('B-', 2.7::DOUBLE), ('D', 1.0::DOUBLE)) g(letter, points)
       ON p.letter = g.letter""",
)
def letter_counts_with_points(spark, d):
    from cohortlab.catalog.standin import LETTER_OF_PRIORITY

    letters = table(spark, d, "orders").select(
        recode.lookup("o_orderpriority", LETTER_OF_PRIORITY).alias("letter")
    )
    points = lookup_table(spark, list(registrar.GRADE_POINTS.items()), "letter string, points double")
    return summaries.count_by(letters, "letter").join(points, "letter", "left")


# ---- projection and filters ----------------------------------------------


@query(
    "distinct_profiles",
    """SELECT id, gender, race0 AS race, ethnicity0 AS ethnicity, ethnicity_code,
        CASE WHEN first_gen THEN 'Y' WHEN NOT first_gen THEN 'N' END AS isfirstgeneration,
        CASE WHEN low_income THEN 'Y' ELSE 'N' END AS islowincome, admission_type FROM profile""",
    curated=True,
)
def distinct_profiles(spark, d):
    return verbs.lower_names(registrar.raw_profile(curated(spark, d)["raw_profile"]))


@query(
    "duplicate_profiles",
    """SELECT id, count(*) AS n FROM (SELECT id FROM profile UNION ALL SELECT id FROM profile WHERE id % 29 = 0)
       GROUP BY id HAVING count(*) > 1""",
    curated=True,
)
def duplicate_profiles(spark, d):
    raw = verbs.renamed(curated(spark, d)["raw_profile"], {"ID": "id"})
    return summaries.count_by(raw, "id").filter("n > 1")


CLEAN = "id, gender, race, ethnicity, ethnicity_code, first_gen, low_income, admission_type, ever_phil, poc, race4, demographic"


@query("clean_profiles", f"SELECT {CLEAN} FROM profile_clean", curated=True)
def clean_profiles(spark, d):
    return curated(spark, d)["profile_clean"].select(*CLEAN.split(", "))


@query(
    "known_binary_gender",
    "SELECT id, gender, race4 FROM profile_clean WHERE gender <> 'N' AND race4 <> 'Other'",
    curated=True,
)
def known_binary_gender(spark, d):
    df = curated(spark, d)["profile_clean"]
    return verbs.keep(df, [F.col("gender") != "N", F.col("race4") != "Other"]).select("id", "gender", "race4")


@query(
    "share_columns_first",
    """SELECT round(women_share, 6) + 0.0 AS women_share, round(poc_share, 6) + 0.0 AS poc_share,
       round(soc_share, 6) + 0.0 AS soc_share, course_id FROM crs_2""",
    curated=True,
)
def share_columns_first(spark, d):
    df = curated(spark, d)["crs_2"]
    names = verbs.columns_like(df, "^(women|poc|soc)_share$")
    df = verbs.to_front(df.select("course_id", *names), *names)
    return verbs.across(df, names, rnd)


@query(
    "deciles_across",
    """SELECT course_id, round(women_share * 10, 6) + 0.0 AS women_share_decile,
       round(first_gen_share * 10, 6) + 0.0 AS first_gen_share_decile FROM crs_2""",
    curated=True,
)
def deciles_across(spark, d):
    df = curated(spark, d)["crs_2"]
    names = ["women_share", "first_gen_share"]
    out = verbs.across(df, names, lambda c: rnd(numbers.deciles(c)), "{}_decile")
    return out.select("course_id", *[f"{n}_decile" for n in names])


@query(
    "predicate_list",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE l_quantity < 40 AND l_discount > 0.02 AND l_returnflag <> 'R' AND nullif(l_linenumber, 7) >= 1""",
)
def predicate_list(spark, d):
    conditions = [
        F.col("l_quantity") < 40,
        F.col("l_discount") > 0.02,
        F.col("l_returnflag") != "R",
        F.nullif(F.col("l_linenumber"), F.lit(7)) >= 1,
    ]
    return verbs.keep(table(spark, d, "lineitem"), conditions).select("l_orderkey", "l_linenumber")


@query(
    "membership",
    """SELECT p_partkey, p_type, NOT coalesce(nullif(p_brand, 'Brand#3') IN ('Brand#1', 'Brand#2'), false) AS elsewhere
       FROM part WHERE p_type IN ('SMALL', 'LARGE') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""",
)
def membership(spark, d):
    part = verbs.members(table(spark, d, "part"), "p_type", ["SMALL", "LARGE"])
    bulk = table(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey")
    part = verbs.members(part, "p_partkey", bulk)
    brand = F.nullif(F.col("p_brand"), F.lit("Brand#3"))
    return part.select("p_partkey", "p_type", missing.not_in(brand, ["Brand#1", "Brand#2"]).alias("elsewhere"))


@query(
    "pattern_column_filter",
    """SELECT page_id, url FROM pages WHERE contains(url, '/' || regexp_extract(html, 'lang="([a-z]+)"', 1) || '/')""",
)
def pattern_column_filter(spark, d):
    lang = F.concat(F.lit("/"), F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("/"))
    pages = table(spark, d, "pages").withColumn("lang", lang)
    return verbs.matches(pages, "url", "lang", regex=True).select("page_id", "url")


# ---- reshaping -----------------------------------------------------------


@query(
    "majors_unpivoted",
    """SELECT r.rel_term, count(*) AS n, count(*) - count(c.major) AS missing
       FROM admit a CROSS JOIN rel_terms r LEFT JOIN cells c ON c.id = a.id AND c.slot = r.rel_term
       WHERE r.rel_term NOT LIKE '%SUMMER%' AND r.rel_term <> 'YR2SPRING' GROUP BY 1""",
    curated=True,
)
def majors_unpivoted(spark, d):
    wide = curated(spark, d)["raw_majors"]
    long = reshape.longer(wide, verbs.columns_like(wide, "^YR"), "rel_term", "major")
    return long.groupBy("rel_term").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("major").isNull()).alias("missing")
    )


# The columns that SQL names; the queries look the levels up.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "events_pivoted",
    "SELECT user_id, "
    + ", ".join(f"round(max(value) FILTER (WHERE event_type = '{e}'), 6) AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY user_id",
)
def events_pivoted(spark, d):
    events = table(spark, d, "events")
    types = reshape.levels_of(events, "event_type")
    best = events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return rounded(reshape.wider(best, ["user_id"], "event_type", "value", types), *types)


@query(
    "event_ticks",
    "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, "
    + ", ".join(f"CASE WHEN bool_or(event_type = '{e}') THEN 'X' ELSE '' END AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY ALL",
)
def event_ticks(spark, d):
    df = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    types = reshape.levels_of(df, "event_type")
    return reshape.ticks(reshape.indicators(df, ["user_id", "day"], "event_type", types), types)


@query(
    "nested_first_courses",
    """SELECT id, string_agg(course_id, ',' ORDER BY course_id) AS courses,
       count(*) AS n_first FROM crs_4 GROUP BY id""",
    curated=True,
)
def nested_first_courses(spark, d):
    df = curated(spark, d)["crs_4"]
    ids = F.transform("first_phil_course", lambda c: c["course_id"])
    return df.select("id", F.array_join(ids, ",").alias("courses"), F.size(ids).cast("long").alias("n_first"))


@query(
    "nested_round_trip",
    "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders",
)
def nested_round_trip(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return reshape.unnest(reshape.nest(df, ["o_orderkey", "o_orderpriority"], "orders", part=F.pmod("o_orderkey", F.lit(4))), "orders")


@query(
    "term_split",
    "SELECT DISTINCT term, CAST(left(term, 4) AS INT) AS year, CAST(substr(term, 5) AS INT) AS qtr FROM phi_crs",
    curated=True,
)
def term_split(spark, d):
    df = curated(spark, d)["raw_courses"].select(F.col("TERM").alias("term")).distinct()
    return reshape.split_at(df, "term", 4, ["year", "qtr"], convert=True)


@query(
    "majors_by_college",
    r"""SELECT regexp_extract(part, '[A-Z]') AS college, part AS major, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT unnest(string_split(regexp_replace(major, ',([ FPh()])', '@@\1', 'g'), ',')) AS raw, n,
        replace(raw, '@@', ',') AS part FROM (SELECT replace(coalesce(major, '(Missing)'), ', ', ',') AS major, count(*) AS n FROM crs_1 GROUP BY 1))
        GROUP BY ALL""",
    curated=True,
)
def majors_by_college(spark, d):
    # the majors of the stand-in are listed with ", "; those of the source with "," alone
    listed = F.replace(recode.explicit_missing("major"), F.lit(", "), F.lit(",")).alias("major")
    df = curated(spark, d)["crs_1"].select(listed)
    rows = reshape.split_rows(summaries.count_by(df, "major"), "major", MAJOR_BREAK)
    rows = rows.groupBy("major").agg(F.sum("n").alias("n"))
    return rows.select(text.capital("major").alias("college"), "major", "n")


@query(
    "literal_grid",
    """SELECT s_suppkey, q.qtr, CAST(y.year AS INT) AS year FROM supplier
       CROSS JOIN (VALUES ('01'), ('03')) q(qtr) CROSS JOIN (VALUES (1995), (1996), (1997)) y(year)""",
)
def literal_grid(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey")
    return reshape.grid(df, {"qtr": ["01", "03"], "year": [1995, 1996, 1997]})


@query(
    "user_days_completed",
    """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
       g AS (SELECT DISTINCT user_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM c)
       SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(n AS DOUBLE) AS n FROM g FULL JOIN c USING (user_id, day)""",
)
def user_days_completed(spark, d):
    cells = (
        table(spark, d, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    days = F.expr("sequence(date'2024-01-01', date'2024-01-30')")
    out = reshape.complete(cells, ["user_id"], "day", days)
    return out.withColumn("day", F.col("day").cast("string"))


# ---- joins ---------------------------------------------------------------


@query(
    "missing_keys_match",
    """WITH l AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS k FROM orders),
       r AS (SELECT k, count(*) AS n FROM l GROUP BY k)
       SELECT o_orderkey, l.k, n FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k""",
)
def missing_keys_match(spark, d):
    k = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    left = table(spark, d, "orders").select("o_orderkey", k.alias("k"))
    return joins.natural_join(left, summaries.count_by(left, "k"))


@query(
    "missing_keys_apart",
    """WITH l AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS k FROM orders),
       r AS (SELECT k, count(*) AS n FROM l GROUP BY k)
       SELECT o_orderkey, l.k, CAST(n AS DOUBLE) AS n FROM l LEFT JOIN r ON l.k = r.k""",
)
def missing_keys_apart(spark, d):
    k = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    left = table(spark, d, "orders").select("o_orderkey", k.alias("k"))
    right = summaries.count_by(left, "k").withColumn("n", F.col("n").cast("double"))
    return joins.natural_join(left, right, na_matches="never")


@query(
    "courses_with_totals",
    """SELECT id, course_id, title, n_students, round(mean_grade, 6) + 0.0 AS mean_grade, current_phil_student,
       CAST(current_phil_course AS BIGINT) AS current_phil_course FROM crs""",
    curated=True,
)
def courses_with_totals(spark, d):
    df = curated(spark, d)["crs"]
    return rounded(
        df.select(
            "id", "course_id", "title", "n_students", "mean_grade", "current_phil_student", "current_phil_course"
        ),
        "mean_grade",
    )


@query(
    "suffixed_dimensions",
    """SELECT a.id, a.course_id, a.gender, f.gender AS gender_instructor, f.race AS race_instructor, d.division AS course_division
       FROM analysis a LEFT JOIN faculty f ON a.instructor = f.instructor LEFT JOIN division d ON a.title = d.title
       WHERE f.race IS NOT NULL AND d.division IS NOT NULL""",
    curated=True,
)
def suffixed_dimensions(spark, d):
    return curated(spark, d)["modelled"].select(
        "id", "course_id", "gender", "gender_instructor", "race_instructor", "course_division"
    )


@query(
    "unique_right_key",
    "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
)
def unique_right_key(spark, d):
    left = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    right = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return joins.unique_join(left, right, ["k"]).withColumnRenamed("k", "l_orderkey")


@query(
    "above_average_price",
    """SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) + 0.0 AS above FROM orders""",
)
def above_average_price(spark, d):
    df = table(spark, d, "orders")
    mean = df.agg(F.avg("o_totalprice").alias("m"))
    out = joins.with_scalar(df, mean, "m", "m")
    return out.select("o_orderkey", rnd(F.col("o_totalprice") - F.col("m"), 4).alias("above"))


@query(
    "orders_without_lines",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def orders_without_lines(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.keyed_join(o, lines, ["o_orderkey"], "left_anti")


@query(
    "returning_customers",
    """SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 8) r
       JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""",
)
def returning_customers(spark, d):
    repeats = summaries.count_by(table(spark, d, "orders"), "o_custkey").filter("n > 8")
    solvent = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.natural_join(repeats, solvent, "inner")


@query(
    "two_sources_agree",
    """WITH a AS (SELECT id, ever_phil FROM profile_clean),
       b AS (SELECT id, bool_or(contains(major, 'Philosophy')) AS seen FROM cells WHERE slot <> 'YR2SPRING' GROUP BY id)
       SELECT (ever_phil = seen) AS agree, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""",
    curated=True,
)
def two_sources_agree(spark, d):
    c = curated(spark, d)
    wide = c["raw_majors"].withColumnRenamed("E_PIDM", "id")
    long = reshape.longer(
        wide.drop("ADMIT_TERM"), verbs.columns_like(wide, "^YR"), "term", "major"
    ).filter(F.col("major").isNotNull())
    seen = summaries.ever(long, ["id"], text.mentions("major", "Philosophy"), "seen")
    return joins.agreement(c["profile_clean"], seen, ["id"], "ever_phil", "seen")


@query(
    "fixed_bands",
    """SELECT l_suppkey, round(s, 6) + 0.0 AS slope, CASE WHEN s < -0.06 THEN 'strong' WHEN s < -0.015 THEN 'moderate'
       WHEN s < 0.015 THEN 'negligible' WHEN s < 0.06 THEN 'moderate' ELSE 'strong' END AS level
       FROM (SELECT l_suppkey, regr_slope(l_discount * 10, l_quantity / 10) AS s FROM lineitem GROUP BY 1)""",
)
def fixed_bands(spark, d):
    from cohortlab.models.effects import BAND_CUTS, BAND_LEVELS

    df = table(spark, d, "lineitem").select(
        "l_suppkey", (F.col("l_discount") * 10).alias("y"), (F.col("l_quantity") / 10).alias("x")
    )
    slopes = summaries.linear_trend(df, "y", "x", ["l_suppkey"])
    cuts = BAND_CUTS["linear"]
    bands = list(zip(cuts[:-1], cuts[1:], BAND_LEVELS))
    return slopes.select("l_suppkey", rnd("slope").alias("slope"), joins.in_band("slope", bands).alias("level"))


@query(
    "table_bands",
    """WITH b AS (SELECT p_type, q.level, CASE q.level WHEN 'low' THEN lo ELSE (lo + hi) / 2 END AS low,
          CASE q.level WHEN 'low' THEN (lo + hi) / 2 ELSE hi + 1 END AS high
          FROM (SELECT p_type, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1)
          CROSS JOIN (VALUES ('low'), ('high')) q(level))
       SELECT p_partkey, level FROM part p JOIN b ON p.p_type = b.p_type AND p_retailprice >= low AND p_retailprice < high""",
)
def table_bands(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    ends = part.groupBy("p_type").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    middle = (F.col("lo") + F.col("hi")) / 2
    bands = reshape.grid(ends, {"level": ["low", "high"]}).select(
        "p_type",
        F.when(F.col("level") == "low", F.col("lo")).otherwise(middle).alias("low"),
        F.when(F.col("level") == "low", middle).otherwise(F.col("hi") + 1).alias("high"),
        "level",
    )
    return joins.band_join(part, bands, "p_type", "p_retailprice").select("p_partkey", "level")


# ---- order and union -----------------------------------------------------


@query(
    "sorted_missing_last",
    """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, round(c_acctbal, 6) + 0.0 AS c_acctbal FROM customer
       ORDER BY seg ASC NULLS LAST, c_acctbal DESC NULLS LAST""",
)
def sorted_missing_last(spark, d):
    df = table(spark, d, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"), "c_acctbal"
    )
    return verbs.ordered(rounded(df, "c_acctbal"), "seg", "-c_acctbal")


@query(
    "most_frequent_first_major",
    """SELECT major_at_first_phil, count(*) AS n FROM (SELECT DISTINCT id, major_at_first_phil FROM crs_4) GROUP BY 1""",
    curated=True,
)
def most_frequent_first_major(spark, d):
    return verbs.most_frequent(curated(spark, d)["crs_4"], "major_at_first_phil")


@query(
    "top_part_pairs",
    "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_suppkey, l_returnflag LIMIT 10",
)
def top_part_pairs(spark, d):
    return verbs.most_frequent(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", k=10)


@query(
    "category_order",
    """SELECT c_custkey, c_mktsegment, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS INT) AS place
       FROM customer""",
)
def category_order(spark, d):
    df = table(spark, d, "customer")
    return df.select("c_custkey", "c_mktsegment", verbs.sort_key("c_mktsegment", ["MACHINERY", "BUILDING"]).alias("place"))


@query(
    "stacked_accounts",
    """SELECT 'customer' AS source, c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL FROM supplier""",
)
def stacked_accounts(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return verbs.stacked({"customer": c, "supplier": s})


# ---- scalar functions ----------------------------------------------------


@query(
    "text_functions",
    r"""SELECT o_orderkey, o_orderstatus || '_' || replace(nullif(o_orderpriority, '5-LOW'), ' ', '_') AS joined,
       left(o_orderpriority, 1) AS head, right(o_orderpriority, 3) AS tail,
       contains(o_orderpriority, 'SPEC') AS spec, regexp_extract(o_orderpriority, '[A-Z]') AS capital,
       CAST(floor(o_totalprice) AS DOUBLE) AS number, CAST(len(string_split(o_orderpriority, '-')) AS INT) AS pieces
       FROM orders""",
)
def text_functions(spark, d):
    p = F.col("o_orderpriority")
    df = table(spark, d, "orders")
    return df.select(
        "o_orderkey",
        text.squash_spaces(text.join_text("o_orderstatus", F.lit("_"), F.nullif(p, F.lit("5-LOW")))).alias("joined"),
        text.first_chars(p, 1).alias("head"),
        text.last_chars(p, 3).alias("tail"),
        text.mentions(p, "SPEC").alias("spec"),
        text.capital(p).alias("capital"),
        text.number_in(F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0))).alias("number"),
        F.size(text.parts(p, "-")).alias("pieces"),
    )


@query(
    "label_functions",
    """SELECT p_partkey, upper(left(a, 1)) || substr(a, 2) || ' ' || upper(left(b, 1)) || substr(b, 2) AS title,
       a AS kept FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)""",
)
def label_functions(spark, d):
    df = table(spark, d, "part").withColumn("u", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    words = F.split("p_name", " ")
    marked = F.concat(F.get(words, F.lit(0)), F.lit(":demographic"), F.get(words, F.lit(1)))
    return df.select(
        "p_partkey",
        text.title_case(text.label("u")).alias("title"),
        F.get(text.parts_without(marked, ":", "demographic"), F.lit(0)).alias("kept"),
    )


@query(
    "recode_functions",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'early' ELSE o_orderpriority END AS grouped,
       coalesce(nullif(o_orderpriority, '5-LOW'), '(Missing)') AS explicit,
       nullif(o_orderstatus, 'P') || '.' || left(o_orderpriority, 1) AS crossed,
       CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS DOUBLE) AS place
       FROM orders""",
)
def recode_functions(spark, d):
    s = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        recode.recode("o_orderstatus", {"P": None, "F": "final"}).alias("status"),
        recode.collapse("o_orderpriority", {"early": ["1-URGENT", "2-HIGH"]}).alias("grouped"),
        recode.explicit_missing(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).alias("explicit"),
        recode.cross_label(s, text.first_chars("o_orderpriority", 1)).alias("crossed"),
        recode.level_index("o_orderstatus", ["O", "F"]).cast("double").alias("place"),
    )


@query(
    "number_functions",
    """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-l_discount)), 6) AS inv, round(exp(l_tax) - 1, 6) AS rel,
       round(l_quantity - 1.959963984540054 * l_tax, 6) + 0.0 AS low, round(log10(l_extendedprice), 6) AS lg,
       round(sqrt(l_quantity), 6) AS root, isfinite(l_tax) AS finite, greatest(l_tax, 0.03) AS at_least
       FROM lineitem""",
)
def number_functions(spark, d):
    low, _ = numbers.interval("l_quantity", "l_tax")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        rnd(numbers.inverse_logit("l_discount")).alias("inv"),
        rnd(numbers.relative_effect("l_tax")).alias("rel"),
        rnd(low).alias("low"),
        rnd(F.log10("l_extendedprice")).alias("lg"),
        rnd(F.sqrt("l_quantity")).alias("root"),
        numbers.is_finite("l_tax").alias("finite"),
        F.greatest("l_tax", F.lit(0.03)).alias("at_least"),
    )


@query(
    "missing_value_aggregates",
    """WITH t AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS x,
          CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus = 'P' END AS b,
          nullif(o_orderpriority, '5-LOW') AS s FROM orders)
       SELECT k, round(CASE WHEN count(x) = count(*) THEN sum(x) END, 2) AS strict_total,
         round(coalesce(sum(x), 0), 2) AS total, round(CASE WHEN count(x) = count(*) THEN avg(x) END, 6) AS strict_mean,
         coalesce(bool_or(b), false) AS ever, count(DISTINCT s) + max((s IS NULL)::INT) AS n_values,
         count(*) FILTER (WHERE CASE WHEN b IS NULL THEN NULL WHEN b THEN true ELSE false END) AS n_true FROM t GROUP BY k""",
)
def missing_value_aggregates(spark, d):
    t = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("x"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus") == "P").alias("b"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("s"),
    )
    return t.groupBy("k").agg(
        rnd(missing.strict_sum("x"), 2).alias("strict_total"),
        rnd(missing.sum_or_zero("x"), 2).alias("total"),
        rnd(missing.strict_avg("x"), 6).alias("strict_mean"),
        missing.any_true("b").alias("ever"),
        missing.count_values("s").alias("n_values"),
        F.count_if(missing.if_else(F.col("b"), F.lit(True), F.lit(False))).alias("n_true"),
    )


@query(
    "key_checks",
    """SELECT 'orders' AS source, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders
       UNION ALL SELECT 'lineitem', count(*), count(DISTINCT nullif(l_orderkey, 7)) + 1, false FROM lineitem""",
)
def key_checks(spark, d):
    lines = table(spark, d, "lineitem").select(F.nullif(F.col("l_orderkey"), F.lit(7)).alias("k"))
    return verbs.stacked(
        {
            "orders": checks.key_report(table(spark, d, "orders"), ["o_orderkey"]),
            "lineitem": checks.key_report(lines, ["k"]),
        }
    )


@query(
    "series_length_check",
    """SELECT count(*) AS n_groups, min(n) AS smallest, max(n) AS largest FROM
       (SELECT id, count(*) AS n FROM major_long GROUP BY id)""",
    curated=True,
)
def series_length_check(spark, d):
    return checks.size_report(calendar_rows(curated(spark, d)["calendar"]), ["id"])


@query(
    "all_rows_check",
    """SELECT coalesce(bool_and(first_phil_term < admit_term), true) AS holds,
       count(*) FILTER (WHERE NOT coalesce(first_phil_term < admit_term, false)) AS n_not_true FROM (
       SELECT left(f.course_id, 6) AS first_phil_term, admit_term FROM (SELECT DISTINCT id, course_id, phil_at_first_phil FROM crs_4) f
       LEFT JOIN admit a ON f.id = a.id WHERE f.phil_at_first_phil IS NULL)""",
    curated=True,
)
def all_rows_check(spark, d):
    c = curated(spark, d)
    flat = reshape.unnest(c["crs_4"].filter(F.col("phil_at_first_phil").isNull()), "first_phil_course")
    dated = flat.join(c["calendar"].select("id", "admit_term"), "id", "left")
    return checks.holds(dated, text.first_chars("course_id", 6) < F.col("admit_term"))


@query(
    "missing_profile",
    """SELECT variable, empty, round(empty / n, 6) AS frac FROM (SELECT count(*) AS n FROM profile_clean) CROSS JOIN (
         SELECT 'gender' AS variable, count(*) - count(gender) AS empty FROM profile_clean
         UNION ALL SELECT 'race', count(*) - count(race) FROM profile_clean
         UNION ALL SELECT 'ethnicity', count(*) - count(ethnicity) FROM profile_clean
         UNION ALL SELECT 'first_gen', count(*) - count(first_gen) FROM profile_clean
         UNION ALL SELECT 'demographic', count(*) - count(demographic) FROM profile_clean)""",
    curated=True,
)
def missing_profile(spark, d):
    df = curated(spark, d)["profile_clean"].select("gender", "race", "ethnicity", "first_gen", "demographic")
    return rounded(checks.missing_profile(df), "frac")

"""The given tables in the shape of the registrar's.

A customer's year of ordering is a student, a supplier's lines in a term are a
course. The same derivation is written once in the DataFrame API and once as
SQL for the oracle.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.recode import lookup
from cohortlab.functions.terms import QUARTER_CODES
from cohortlab.sources.tables import load

QUARTER_OF_MONTH = dict(zip(range(1, 13), ["01"] * 2 + ["03"] * 2 + ["05"] * 2 + ["07"] * 3 + ["10"] * 3))
RACE_OF_SEGMENT = {
    "HOUSEHOLD": "White",
    "MACHINERY": "Asian",
    "FURNITURE": "Black",
    "AUTOMOBILE": "Hispanic",
    "BUILDING": "Other",
}
LETTER_OF_PRIORITY = {
    "1-URGENT": "A",
    "2-HIGH": "B+",
    "3-MEDIUM": "B-",
    "4-NOT SPECIFIED": "NG",
    "5-LOW": "D",
}
MAJOR_OF_PRIORITY = {
    "1-URGENT": "Undeclared, Fine Arts",
    "2-HIGH": "Human Development",
    "3-MEDIUM": "Biological Sciences, Chemistry",
    "4-NOT SPECIFIED": "History",
    "5-LOW": "Sociology, Psychology",
}
REL_QUARTER_OF_CODE = {"10": "FALL", "01": "WINTER", "03": "SPRING"}
SLOTS = [
    f"YR{y}{q}"
    for y in range(1, 11)
    for q in ("FALL", "WINTER", "SPRING")
    if not (y == 2 and q == "SPRING")
]


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = ["customer", "orders", "lineitem", "part", "supplier", "nation", "region"]
    return load(spark, folder, names)


def _student_id() -> Column:
    return F.col("o_custkey") * 100 + F.year("o_orderdate") - 1990


def _student(t: dict[str, DataFrame]) -> DataFrame:
    return t["orders"].select(
        "*",
        _student_id().alias("student"),
        F.concat(
            F.year("o_orderdate").cast("string"), lookup(F.month("o_orderdate"), QUARTER_OF_MONTH)
        ).alias("term"),
    )


def profile(t: dict[str, DataFrame]) -> DataFrame:
    s = F.col("student")
    people = _student(t).select("student", "o_custkey").distinct()
    df = people.join(t["customer"], people["o_custkey"] == F.col("c_custkey"))
    df = df.join(t["nation"], df["c_nationkey"] == F.col("n_nationkey"))
    nk = F.col("c_nationkey")
    return df.select(
        s.alias("ID"),
        F.when(s % 37 == 0, None).when(s % 41 == 0, "N").when(s % 2 == 0, "F").otherwise("M").alias("GENDER"),
        F.when(s % 43 == 0, None).otherwise(lookup("c_mktsegment", RACE_OF_SEGMENT)).alias("RACE"),
        F.when(nk == 4, "American Indian/Alaska Native")
        .when(nk == 11, "Pacific Islander, other")
        .when(nk == 13, None)
        .otherwise(F.col("n_name"))
        .alias("ETHNICITY"),
        F.concat(F.lit("E"), nk.cast("string")).alias("ETHNICITY_CODE"),
        F.when(s % 53 == 0, None).when(F.col("c_acctbal") < 3000, "Y").otherwise("N").alias("IsFIRSTGENERATION"),
        F.when(F.col("c_acctbal") < 5000, "Y").otherwise("N").alias("IsLOWINCOME"),
        F.when(nk % 3 == 0, "Transfer").otherwise("Freshman").alias("ADMISSION_TYPE"),
        F.explode(
            F.when(s % 29 == 0, F.array(F.lit("N"), F.lit("Y"))).otherwise(F.array(F.lit("N")))
        ).alias("IsPHI_MAJOR"),
        F.lit(1).alias("PHI_CNT"),
        F.lit("N").alias("IsPHI_MINOR"),
    )


def _rank(x: str, known: list[str]) -> Column:
    """A number in the order of the texts: 2, 4, ... for the known ones, an odd one for any other."""
    x = F.col(x)
    return sum((x >= k).cast("int") for k in known) * 2 + (~x.isin(known)).cast("int")


def phi_crs(t: dict[str, DataFrame]) -> DataFrame:
    """A student's lines with a supplier in a term are one course.

    Terms and priorities travel as numbers until all is joined: what is grouped and moved
    has a fixed width, so groups are hashed and not sorted.
    """
    letters = sorted(LETTER_OF_PRIORITY)
    date = F.col("o_orderdate")
    o = t["orders"].select(
        "o_orderkey",
        _student_id().alias("student"),
        (F.year(date) * 100 + lookup(F.month(date), QUARTER_OF_MONTH).cast("int")).alias("term"),
        _rank("o_orderpriority", letters).alias("rank"),
    )
    lines = t["lineitem"].join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.groupBy("student", "term", "l_suppkey").agg(
        F.min("rank").alias("rank"),
        F.max("l_quantity").alias("q"),
        F.min("l_partkey").alias("pk"),
    )
    rows = rows.join(t["part"], rows["pk"] == F.col("p_partkey"))
    year = F.floor(F.col("term") / 100)
    return rows.select(
        F.col("student").alias("E_PIDM"),
        F.concat(year.cast("string"), F.lpad((F.col("term") - year * 100).cast("string"), 2, "0")).alias("TERM"),
        F.col("l_suppkey").cast("string").alias("CRN"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("COURSE_TITLE"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("INSTRUCTOR"),
        lookup("rank", {2 * i: LETTER_OF_PRIORITY[x] for i, x in enumerate(letters, 1)}).alias("COURSE_LETTER_GRADE"),
        (F.nullif(F.col("q"), F.lit(13.0)) * 0.08).alias("TERM_CUM_GPA"),
    )


def major_term(t: dict[str, DataFrame]) -> DataFrame:
    """Admission term and the major held in each slot of a student's lines.

    A slot's major is that of the student's last order with a line in it. An order's slots
    travel as the bits of one number, so lines are neither joined nor moved.
    """
    o = _student(t).withColumn(
        "major",
        F.when(
            (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000) & (F.month("o_orderdate") > 3),
            "Philosophy",
        ).otherwise(lookup("o_orderpriority", MAJOR_OF_PRIORITY)),
    )
    quarter = lookup(lookup(F.month("l_shipdate"), QUARTER_OF_MONTH), REL_QUARTER_OF_CODE)
    slot = F.concat(F.lit("YR"), F.col("l_linenumber").cast("string"), quarter)
    place = F.array_position(F.array(*[F.lit(x) for x in SLOTS]), slot)
    lines = t["lineitem"].select("l_orderkey", place.cast("int").alias("place")).filter("place > 0")
    slots = lines.groupBy("l_orderkey").agg(F.bit_or(F.expr("shiftleft(1L, place - 1)")).alias("slots"))
    # majors as numbers: all that is moved and added up has a fixed width
    majors = sorted({"Philosophy", *MAJOR_OF_PRIORITY.values()})
    o = o.select("o_orderkey", "student", "term", lookup("major", {m: i for i, m in enumerate(majors)}).alias("code"))
    o = o.join(slots, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # most students are admitted with their first order, some only with the last
    admitted = F.when(F.col("student") % 17 == 0, F.max("term")).otherwise(F.min("term")).alias("a")
    cells = [
        F.max_by("code", F.when(F.col("student").isNotNull() & (F.col("slots").bitwiseAND(F.lit(1 << i)) != 0), F.col("o_orderkey"))).alias(x)
        for i, x in enumerate(SLOTS)
    ]
    named = F.array(*[F.lit(m) for m in majors])
    wide = o.groupBy("student").agg(admitted, *cells)
    return wide.select(
        F.col("student").alias("E_PIDM"),
        F.when(
            F.col("a").endswith("07") & (F.col("student") % 2 == 0), F.concat(F.substring("a", 1, 4), F.lit("06"))
        )
        .otherwise(F.col("a"))
        .alias("ADMIT_TERM"),
        *[F.get(named, F.col(x)).alias(x) for x in SLOTS],
    )


def faculty(t: dict[str, DataFrame]) -> DataFrame:
    k = F.col("s_suppkey")
    return t["supplier"].select(
        F.concat(F.lit("S"), k.cast("string")).alias("instructor"),
        F.when(k % 3 == 0, "F").otherwise("M").alias("gender"),
        F.when(k % 23 == 0, None)
        .when(F.col("s_nationkey") % 4 == 0, "Asian")
        .when(F.col("s_nationkey") % 4 == 1, "Black")
        .otherwise("White")
        .alias("race"),
        F.log10(F.abs("s_acctbal") + 10).alias("instructor_log_total"),
    )


def course_division(t: dict[str, DataFrame]) -> DataFrame:
    upper = F.col("p_type").isin("LARGE", "PROMO", "STANDARD")
    return t["part"].select(
        F.concat("p_brand", F.lit(" "), "p_type").alias("title"),
        F.when(upper, "upper").otherwise("lower").alias("division"),
    ).distinct()


def _case(x: str, mapping: dict, quote: bool = True) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


@cache
def oracle_ctes() -> list[tuple[str, str]]:
    """The stand-ins and the curated tables as named SQL queries, in order."""
    from cohortlab.plans.registrar import GRADE_POINTS

    month = _case("month(o_orderdate)", QUARTER_OF_MONTH)
    ship = _case(_case("month(l_shipdate)", QUARTER_OF_MONTH), REL_QUARTER_OF_CODE)
    slots = ",\n".join(
        f"max(major) FILTER (WHERE slot = '{s}') AS {s}" for s in SLOTS
    )
    codes = "[" + ", ".join(f"'{c}'" for c in QUARTER_CODES) + "]"
    rel = [f"YR{y}{q}" for y in range(1, 11) for q in ("FALL", "WINTER", "SPRING", "SUMMER_I", "SUMMER_II")]
    rel_values = ", ".join(f"('{r}', {i})" for i, r in enumerate(rel))
    flags = """contains({m}, 'Philosophy') AS current_phil,
        contains({m}, 'Human Development') AS human_dev,
        contains({m}, 'Biological Sciences') AS bio_sci,
        contains({m}, 'Sociology') AS soc,
        contains({m}, 'Undeclared') AS undeclared"""
    return [
        ("student_orders", f"""SELECT *, o_custkey * 100 + year(o_orderdate) - 1990 AS student,
            CAST(year(o_orderdate) AS VARCHAR) || {month} AS term,
            CASE WHEN o_orderstatus = 'P' AND o_totalprice > 250000 AND month(o_orderdate) > 3 THEN 'Philosophy'
                 ELSE {_case("o_orderpriority", MAJOR_OF_PRIORITY)} END AS major FROM orders"""),
        ("profile", f"""SELECT student AS id,
            CASE WHEN student % 37 = 0 THEN NULL WHEN student % 41 = 0 THEN 'N'
                 WHEN student % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
            CASE WHEN student % 43 = 0 THEN NULL ELSE {_case("c_mktsegment", RACE_OF_SEGMENT)} END AS race0,
            CASE WHEN c_nationkey = 4 THEN 'American Indian/Alaska Native'
                 WHEN c_nationkey = 11 THEN 'Pacific Islander, other'
                 WHEN c_nationkey = 13 THEN NULL ELSE n_name END AS ethnicity0,
            'E' || c_nationkey AS ethnicity_code,
            CASE WHEN student % 53 = 0 THEN NULL ELSE c_acctbal < 3000 END AS first_gen,
            c_acctbal < 5000 AS low_income,
            CASE WHEN c_nationkey % 3 = 0 THEN 'Transfer' ELSE 'Freshman' END AS admission_type
            FROM (SELECT DISTINCT student, o_custkey FROM student_orders)
            JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
        ("phi_crs", f"""SELECT student AS id, term, term || '_' || l_suppkey AS course_id,
            replace(term || '_' || l_suppkey || ' ' || p_brand || ' ' || p_type, ' ', '_') AS id_title,
            p_brand || ' ' || p_type AS title, 'S' || l_suppkey AS instructor,
            CAST({_case(_case("p", LETTER_OF_PRIORITY), GRADE_POINTS)} AS DOUBLE) AS grade,
            nullif(q, 13.0) * CAST(0.08 AS DOUBLE) AS term_cum_gpa
            FROM (SELECT student, term, l_suppkey, min(o_orderpriority) AS p, max(l_quantity) AS q,
                  min(l_partkey) AS pk FROM lineitem JOIN student_orders ON l_orderkey = o_orderkey
                  GROUP BY ALL) JOIN part ON pk = p_partkey"""),
        ("admit", """SELECT student AS id, CASE WHEN student % 17 = 0 THEN max(term) ELSE min(term) END
            AS admit_term FROM student_orders GROUP BY student"""),
        ("cells", f"""SELECT student AS id, 'YR' || l_linenumber || {ship} AS slot,
            arg_max(major, (o_orderkey, l_partkey, l_suppkey)) AS major
            FROM lineitem JOIN student_orders ON l_orderkey = o_orderkey
            WHERE {ship} IS NOT NULL GROUP BY ALL"""),
        ("rel_terms", f"SELECT * FROM (VALUES {rel_values}) AS v(rel_term, idx)"),
        ("grid", """SELECT a.id, admit_term, r.rel_term, r.idx,
            last_value(CASE WHEN r.rel_term <> 'YR2SPRING' THEN c.major END IGNORE NULLS) OVER (PARTITION BY a.id ORDER BY r.idx
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS major
            FROM admit a CROSS JOIN rel_terms r LEFT JOIN cells c ON c.id = a.id AND c.slot = r.rel_term"""),
        ("trimmed", """SELECT *, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS k FROM grid
            WHERE idx >= CASE right(admit_term, 2) WHEN '10' THEN 0 WHEN '01' THEN 1 WHEN '03' THEN 2
                WHEN '05' THEN 3 ELSE 4 END"""),
        ("major_long", f"""SELECT id, admit_term, rel_term, major,
            (CAST(left(admit_term, 4) AS INT) + (list_position({codes}, right(admit_term, 2)) - 1 + k) // 5)::VARCHAR
              || {codes}[CAST((list_position({codes}, right(admit_term, 2)) - 1 + k) % 5 + 1 AS INT)] AS term,
            {flags.format(m="major")} FROM trimmed"""),
        ("ever", """SELECT id, coalesce(bool_or(current_phil), false) AS ever_phil FROM major_long GROUP BY id"""),
        ("profile1", """SELECT p.*, ever_phil, CASE WHEN contains(ethnicity0, 'Native') THEN 'Indigenous'
            WHEN contains(ethnicity0, 'Islander') THEN 'Pacific Islander' ELSE race0 END AS race
            FROM profile p LEFT JOIN ever e ON p.id = e.id"""),
        ("profile_clean", """SELECT * EXCLUDE (race0, ethnicity0, race4), race4, gender || '.' || race4 AS demographic FROM (
            SELECT *, CASE WHEN race IS NULL THEN NULL WHEN race = 'Other' THEN 'Other' ELSE ethnicity0 END AS ethnicity,
            NOT coalesce(race IN ('White', 'Other'), false) AS poc,
            CASE WHEN race IN ('Black', 'Hispanic', 'Indigenous', 'Pacific Islander') THEN 'BHIP' ELSE race END AS race4
            FROM profile1)"""),
        ("crs_1", """SELECT p.id, p.term, CAST(left(p.term, 4) AS INT) AS year, CAST(substr(p.term, 5, 2) AS INT) AS quarter,
            course_id, id_title, title, instructor, grade, term_cum_gpa, major, current_phil, human_dev, bio_sci, soc, undeclared,
            term_cum_gpa - grade AS grade_diff, (human_dev OR bio_sci OR soc) AS other_major
            FROM phi_crs p LEFT JOIN major_long m ON p.id = m.id AND p.term = m.term"""),
        ("crs_p", """SELECT c.*, gender, race, race4, demographic, poc, first_gen, low_income, ever_phil
            FROM crs_1 c LEFT JOIN profile_clean p ON c.id = p.id"""),
        ("crs_2a", """SELECT course_id, count(*) AS n_students, avg(grade) AS mean_grade, avg(term_cum_gpa) AS mean_cum_gpa,
            avg(grade_diff) AS mean_grade_diff,
            CASE WHEN count(gender) = count(*) THEN sum((gender = 'F')::INT) END AS women,
            CASE WHEN count(poc) = count(*) THEN sum(poc::INT) END AS poc,
            CASE WHEN count(first_gen) = count(*) THEN sum(first_gen::INT) END AS first_gen,
            CASE WHEN count(low_income) = count(*) THEN sum(low_income::INT) END AS low_income,
            coalesce(sum(current_phil::INT), 0) AS current_phil, coalesce(sum(human_dev::INT), 0) AS human_dev,
            coalesce(sum(bio_sci::INT), 0) AS bio_sci, coalesce(sum(soc::INT), 0) AS soc,
            coalesce(sum(other_major::INT), 0) AS other_major, coalesce(sum(undeclared::INT), 0) AS undeclared
            FROM crs_p GROUP BY course_id"""),
        ("crs_2", "SELECT *, " + ", ".join(
            f"{c} / n_students AS {c}_share" for c in
            ["women", "poc", "first_gen", "low_income", "current_phil", "human_dev", "bio_sci", "soc", "other_major", "undeclared"]
        ) + " FROM crs_2a"),
        ("ref_gap", """SELECT avg(m) AS ref FROM (SELECT id, CASE WHEN count(grade_diff) = count(*) THEN avg(grade_diff) END AS m
            FROM crs_p WHERE demographic = 'M.White' GROUP BY id)"""),
        ("dmg", """SELECT course_id, demographic, avg(grade_diff) - (SELECT ref FROM ref_gap) AS dmg
            FROM crs_p GROUP BY ALL HAVING avg(grade_diff) IS NOT NULL"""),
        ("crs_4", """SELECT id, course_id, major AS major_at_first_phil, current_phil AS phil_at_first_phil,
            human_dev, bio_sci, soc, undeclared, n_phil, count(*) OVER (PARTITION BY id) AS n_first_phil
            FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n_phil, min(term) OVER (PARTITION BY id) AS first_term FROM crs_1)
            WHERE term = first_term"""),
        ("crs", """SELECT c.id, c.term, c.year, c.quarter, c.course_id, id_title, title, instructor, grade, term_cum_gpa, major, grade_diff,
            """ + ", ".join(f"c.{f} AS {f}_student, t.{f} AS {f}_course" for f in
                            ["current_phil", "human_dev", "bio_sci", "soc", "undeclared", "other_major"]) + """,
            t.* EXCLUDE (course_id, current_phil, human_dev, bio_sci, soc, undeclared, other_major)
            FROM crs_1 c FULL JOIN crs_2 t ON c.course_id = t.course_id"""),
        ("students", """SELECT p.* EXCLUDE (ethnicity, ethnicity_code), coalesce(ethnicity, '(Missing)') AS ethnicity,
            coalesce(ethnicity_code, '(Missing)') AS ethnicity_code,
            f.course_id, f.major_at_first_phil, f.phil_at_first_phil, f.human_dev, f.bio_sci, f.soc, f.undeclared, f.n_phil,
            f.n_first_phil, f.n_phil - f.n_first_phil AS n_later_phil, f.n_phil - f.n_first_phil >= 1 AS multiple_phil
            FROM profile_clean p FULL JOIN crs_4 f ON p.id = f.id"""),
        ("analysis", """SELECT s.*, c.term, c.title, c.instructor, c.grade, c.term_cum_gpa, c.grade_diff,
            coalesce(c.major, '(Missing)') AS major, CAST(c.year AS VARCHAR) AS year, CAST(c.quarter AS VARCHAR) AS quarter,
            c.year AS year_number, c.undeclared_student, c.n_students, c.mean_grade, c.mean_cum_gpa, c.women_share, c.poc_share,
            c.first_gen_share, c.low_income_share, c.current_phil_share, c.other_major_share, d.dmg
            FROM students s LEFT JOIN crs c ON s.id = c.id AND s.course_id = c.course_id
            LEFT JOIN dmg d ON s.course_id = d.course_id AND s.demographic = d.demographic
            WHERE s.gender <> 'N' AND s.race4 <> 'Other' AND s.major_at_first_phil IS NOT NULL
              AND c.grade IS NOT NULL AND c.term_cum_gpa IS NOT NULL"""),
        ("faculty", """SELECT 'S' || s_suppkey AS instructor, CASE WHEN s_suppkey % 3 = 0 THEN 'F' ELSE 'M' END AS gender,
            CASE WHEN s_suppkey % 23 = 0 THEN NULL WHEN s_nationkey % 4 = 0 THEN 'Asian' WHEN s_nationkey % 4 = 1 THEN 'Black'
                 ELSE 'White' END AS race, log10(abs(s_acctbal) + 10) AS instructor_log_total FROM supplier"""),
        ("division", """SELECT DISTINCT p_brand || ' ' || p_type AS title,
            CASE WHEN p_type IN ('LARGE', 'PROMO', 'STANDARD') THEN 'upper' ELSE 'lower' END AS division FROM part"""),
        ("modelled", """SELECT a.* EXCLUDE (women_share, poc_share, first_gen_share, low_income_share, current_phil_share, other_major_share),
            women_share * 10 AS women_share, poc_share * 10 AS poc_share, first_gen_share * 10 AS first_gen_share,
            low_income_share * 10 AS low_income_share, current_phil_share * 10 AS current_phil_share,
            other_major_share * 10 AS other_major_share,
            f.gender AS gender_instructor, f.race AS race_instructor, f.instructor_log_total, d.division AS course_division
            FROM analysis a LEFT JOIN faculty f ON a.instructor = f.instructor LEFT JOIN division d ON a.title = d.title
            WHERE f.race IS NOT NULL AND d.division IS NOT NULL"""),
    ]


def with_ctes(sql: str) -> str:
    """A query over the curated tables as one statement for the oracle."""
    parts = ",\n".join(f"{name} AS ({body})" for name, body in oracle_ctes())
    sql = sql.strip()
    more = sql.upper().startswith("WITH ")
    return f"WITH {parts}" + (f",\n{sql[5:]}" if more else f"\n{sql}")

"""Named queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.catalog import standin
from cohortlab.plans import registrar
from cohortlab.plans.regressions import model_table
from cohortlab.session import staged, times_cleared
from cohortlab.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, curated: bool = False):
    """Register a query; ``curated`` SQL may use the curated tables by name."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = standin.with_ctes(sql) if curated else sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load(spark, folder, [name])[name]


def curated(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """The registrar plan over the stand-in tables, its shared stages stored once a query reads them.

    Kept while the folder's files stay as they are.
    """
    return _curated(spark, folder, folder_state(spark, folder))


def folder_state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of a folder's files, and whether what was staged from them still stands."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    return times_cleared(), *files


@lru_cache(maxsize=4)
def _curated(spark: SparkSession, folder: str, state: tuple) -> Mapping[str, DataFrame]:
    t = standin.tables(spark, folder)
    raw = {
        "raw_profile": standin.profile(t),
        "raw_courses": standin.phi_crs(t),
        "raw_majors": standin.major_term(t),
        "faculty": standin.faculty(t),
        "division": standin.course_division(t),
    }
    plan = registrar.build(raw["raw_profile"], raw["raw_courses"], raw["raw_majors"], partial(staged, packed=True))
    makers = {name: partial(dict.__getitem__, tables, name) for tables in (t, raw) for name in tables}
    makers |= {name: partial(plan.__getitem__, name) for name in plan}
    makers["modelled"] = lambda: model_table(plan["analysis"], raw["faculty"], raw["division"])
    return registrar.Stages(makers)


def rnd(x: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rnd(n, digits) for n in names})

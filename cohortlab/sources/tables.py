"""Typed table sources and report sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(
    spark: SparkSession,
    folder: str,
    names: Sequence[str],
    schemas: Mapping[str, T.StructType | str] | None = None,
) -> dict[str, DataFrame]:
    """Parquet tables of a folder; a declared schema is checked by the reader."""
    schemas = schemas or {}
    out = {}
    for name in names:
        reader = spark.read
        if name in schemas:
            reader = reader.schema(schemas[name])
        out[name] = reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return out


def read_files(
    spark: SparkSession,
    paths: Mapping[str, str],
    constant: str,
    format: str = "parquet",
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """Several files as one scan, each row tagged with its file's constant.

    ``paths`` maps a file or folder to the constant; of nested folders the
    inner one counts. All files must have one schema, or are read with the one
    given. A row whose file is under
    none of the paths (a pattern, a link) fails the read.
    """
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(list(paths))
    name = _without_slashes(F.col("_metadata.file_path"))
    tag = F.raise_error(F.concat(F.lit("no constant for "), name)).cast("string")
    # longer paths are tested first
    for full, value in sorted((_full_path(spark, p), v) for p, v in paths.items()):
        hit = (name == full) | F.startswith(name, F.lit(full + "/"))
        tag = F.when(hit, F.lit(value)).otherwise(tag)
    return df.withColumn(constant, tag)


def _without_slashes(path: Column) -> Column:
    """file:///a and file:/a are the same file."""
    return F.regexp_replace(path, "^([a-z0-9]+:)/+(?=/)", "$1")


def _full_path(spark: SparkSession, path: str) -> str:
    """The path, as encoded by the file source."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = fs.makeQualified(p).toUri().toString().rstrip("/")
    return re.sub("^([a-z0-9]+:)/+(?=/)", r"\1", full)


def lookup_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small literal table."""
    return spark.createDataFrame(list(rows), schema)


def write_report(df: DataFrame, path: str) -> None:
    """CSV report with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)

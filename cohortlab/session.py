"""Session settings and durable materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleared = 0


def session(app: str = "cohortlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # whole pages travel to the HTML reader: keep a batch of them small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``; only a local session
    without that setting falls back to a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="cohortlab-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession) -> str:
    """What this application keeps in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cohortlab/{spark.sparkContext.applicationId}"


def times_cleared() -> int:
    """How often this process has deleted its staged tables."""
    return _cleared


def clear_run(spark: SparkSession) -> None:
    """Delete all tables that this application staged; call it when their readers are done.

    What is kept over staged tables between calls is keyed by :func:`times_cleared`.
    """
    global _cleared
    _cleared += 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, spread: bool = False, packed: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where a result is scanned many times: the columns stay prunable and
    nothing depends on an executor's memory; :func:`clear_run` deletes them.
    ``spread`` is for tables that feed heavy per-row work: they are dealt to as
    many pieces as there are cores at least. ``packed`` is for wide tables: zstd
    makes them a quarter smaller.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}/{name}"
    out = df
    if spread:
        # in turn and not by contents: equal rows may be many
        out = df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    write = out.write.option("compression", "zstd") if packed else out.write
    write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

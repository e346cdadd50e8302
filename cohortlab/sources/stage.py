"""Build-once stages kept as Parquet."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a finished stage? A write that broke off leaves no marker."""
    fs, p = _fs(spark, path.rstrip("/") + "/_SUCCESS")
    return fs.exists(p)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def inputs_of(df: DataFrame) -> list[str]:
    """The folders that a plan reads, partitioned tables by their root."""
    roots = set()
    for file in df.inputFiles():
        folder = file.rsplit("/", 1)[0]
        while "=" in folder.rsplit("/", 1)[1]:
            folder = folder.rsplit("/", 1)[0]
        roots.add(folder)
    return sorted(roots)


def state_of(spark: SparkSession, roots: list[str]) -> dict[str, str]:
    """Names, sizes and times of all files below each root, as one number; Spark does the listing."""
    out = {}
    for root in roots:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
            row = files.select("path", "length", "modificationTime").agg(F.count("*"), mark).first()
            out[root] = f"{row[0]}:{row[1]}"
        except AnalysisException:  # the folder is gone
            out[root] = "none"
    return out


def _plan_mark(df: DataFrame) -> str:
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return hashlib.sha256(re.sub(r"#\d+L?", "#", plan).encode()).hexdigest()


class _Manifests:
    """Numbered records of a stage's builds. The highest one that is complete counts.

    A record is put in place by creating its file, which succeeds for one builder only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path}/_manifests"

    def numbers(self) -> list[int]:
        fs, p = _fs(self.spark, self.folder)
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit())

    def get(self, number: int, wait: float = 0.0) -> dict | None:
        """The record, or None: its builder may have died between creating and writing it."""
        fs, p = _fs(self.spark, f"{self.folder}/{number:08d}")
        until = time.monotonic() + wait
        while True:
            stream = fs.open(p)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:
                if time.monotonic() >= until:
                    return None
                time.sleep(0.1)

    def last(self, wait: float) -> dict | None:
        for number in reversed(self.numbers()):
            if record := self.get(number, wait):
                return record
        return None

    def put(self, number: int, record: dict) -> bool:
        """False where another builder has this number."""
        fs, p = _fs(self.spark, f"{self.folder}/{number:08d}")
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as error:
            if fs.exists(p):
                return False
            raise error
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        return True


def stage(
    spark: SparkSession,
    folder: str,
    name: str,
    build: Callable[[], DataFrame],
    inputs: list[str] | None = None,
    same_plan: bool = False,
    wait: float = 5.0,
) -> DataFrame:
    """Read the stage if it is there and up to date, else build it, record it and read it.

    Every build is written to a folder of its own, and a record beside the stage tells
    which one counts, with the state of the files it was made from (``inputs``, or the
    folders that the built plan reads) and of its plan. When files have changed since, the
    stage is built again; with ``same_plan`` also when ``build`` gives another plan, for
    which it is called each time, though nothing runs. Builders may race: a record is
    created by one of them only, and who comes second uses the first one's build if it was
    made from the same state. ``wait`` is how long a record that is being written is waited for.
    """
    path = f"{folder.rstrip('/')}/{name}"
    records = _Manifests(spark, path)
    found, df, roots = records.last(wait), None, inputs
    if same_plan:
        df = build()
    plan = _plan_mark(df) if df is not None else None
    if found and _current(spark, found, plan):
        return read(spark, f"{path}/{found['data']}")
    df = build() if df is None else df
    roots = sorted(inputs_of(df)) if inputs is None else sorted(inputs)
    # what is read is at least as new as this; files that change meanwhile make the stage stale
    made = {"data": f"data-{uuid.uuid4().hex}", "inputs": state_of(spark, roots), "plan": _plan_mark(df)}
    df.write.parquet(f"{path}/{made['data']}")
    while True:
        # looked at and taken under one number: a record that comes between takes it first
        number = max(records.numbers(), default=0) + 1
        other = records.last(wait)
        if other and other["inputs"] == made["inputs"] and other["plan"] == made["plan"]:
            fs, own = _fs(spark, f"{path}/{made['data']}")
            fs.delete(own, True)
            return read(spark, f"{path}/{other['data']}")
        if records.put(number, made):
            return read(spark, f"{path}/{made['data']}")


def _current(spark: SparkSession, record: dict, plan: str | None) -> bool:
    if plan is not None and record["plan"] != plan:
        return False
    return state_of(spark, list(record["inputs"])) == record["inputs"]


def prune(spark: SparkSession, folder: str, name: str, wait: float = 5.0) -> int:
    """Delete the builds of a stage that no longer count, once nobody reads them; how many."""
    path = f"{folder.rstrip('/')}/{name}"
    records, gone = _Manifests(spark, path), 0
    last = records.last(wait)
    if last is None:
        return 0
    fs, p = _fs(spark, path)
    for f in fs.listStatus(p):
        if f.getPath().getName().startswith("data-") and f.getPath().getName() != last["data"]:
            gone += bool(fs.delete(f.getPath(), True))
    return gone

"""Folders that the driver and every executor can reach, for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out inside each settled() that is running, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset on one machine (tests) a temporary folder is set. On a
    cluster that would be a folder of the driver alone: RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-quill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, as a table of its own; all other tables in the shared folder that make() or the plan it returned
    wrote on the way are deleted then, after a failure too. For results that are small beside what they are made from."""
    _SCOPES.append([])
    try:
        df = make()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for used in _SCOPES.pop():
            _delete(spark, used)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: its lineage ends there, and
    a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that stash() wrote for df; only for tables that no later plan reads."""
    _delete(df.sparkSession, df.stashed_at)


#: Spark's setting for the bytes of a batch that goes to Python, and what it is unless someone sets it.
BATCH, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


#: What small_batches() sets: usually, and where many arrays are made from each batch.
SMALL, SMALLEST = "8m", "2m"


def small_batches(spark: SparkSession, size: str = SMALL) -> None:
    """Hand texts to Python in batches of size, so that the buffers on both sides stay small beside an executor's memory. A
    session whose setting is neither Spark's own nor from here keeps it."""
    if spark.conf.get(BATCH, SPARKS_OWN) in (SPARKS_OWN, SMALL, SMALLEST):
        spark.conf.set(BATCH, size)


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores after it as no column of the frames has (Spark ignores case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name

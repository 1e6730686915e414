"""One named text file for each target path, in any store that Spark writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand.sources.writers import CSV


def hadoop_path(spark: SparkSession, path: str):
    """A path of Hadoop's. Paths with a scheme are read as URLs, as file_path in _metadata is one."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)) if "%" in path and ":" in path else jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def paths_below(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a glob pattern, in order."""
    where = hadoop_path(spark, pattern)
    return sorted(s.getPath().toString() for s in _file_system(spark, where).globStatus(where) or [])


def write_beside(lines: DataFrame, target: str, order: list[str], value: str, staging: str) -> list[str]:
    """Write value of all rows to the file that target names, a line each, in order; returns the targets. Files that are
    there are replaced, folders that are missing made; targets without rows are left alone.

    lines must give the same rows when read again, as a stored table does. The rows of a target go to one task, which
    streams them to one file, since one file is asked for. Spark commits the files to a folder below staging (in the
    targets' store), so tasks that fail or run twice leave nothing there; then the driver moves each to its name, in one
    step that replaces an older file. The folder goes in any case. The driver holds the targets' names, no rows.
    """
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    folder = f"{staging.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    targets = sorted(r[0] for r in lines.select(target).distinct().collect())
    rows = lines.select(F.sha2(F.col(target), 256).alias("file"), *[F.col(c).alias(f"order{k}") for k, c in enumerate(order)], F.col(value).alias("value"))
    sorted_rows = rows.repartition("file").sortWithinPartitions("file", *[f"order{k}" for k in range(len(order))])
    names = {r[1]: r[0] for r in spark.createDataFrame([(t,) for t in targets], "t string").select("t", F.sha2("t", 256)).collect()} if targets else {}
    made = hadoop_path(spark, folder)
    try:
        sorted_rows.select("file", "value").write.partitionBy("file").text(folder)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else _file_system(spark, made).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        for name, where in names.items():
            (part,) = paths_below(spark, f"{folder}/file={name}/part-*")
            placed = hadoop_path(spark, where)
            _file_system(spark, placed).mkdirs(placed.getParent())
            context.rename(hadoop_path(spark, part), placed, over)
            local = _file_system(spark, placed)
            if local.getScheme() == "file":  # the checksum's own file, which edits by others would make wrong
                local.getRawFileSystem().delete(local.getChecksumFile(placed), False)
    finally:
        _file_system(spark, made).delete(made, True)
    return targets


def write_named(df: DataFrame, names: list[str], folder: str, kind: str) -> None:
    """Write the other columns of df as kind (csv with a header, json, text, parquet) to a folder of part files for each path
    that the columns names spell: folder/<first>/<second>... Names are letters, digits and .-_ only.

    Spark writes and commits all of them in one pass, however many tasks a path takes, below a staging folder; then the
    driver moves each to its place, which must be free. The driver holds the paths, no rows.
    """
    spark = df.sparkSession
    top = folder.rstrip("/")
    staging = hadoop_path(spark, f"{top}/_staging-{uuid.uuid4().hex}")
    files = _file_system(spark, staging)
    try:
        df.write.partitionBy(*names).options(**(CSV if kind == "csv" else {})).format(kind).save(staging.toString())
        for found in paths_below(spark, staging.toString() + f"/{names[0]}=*" + "/*=*" * (len(names) - 1)):
            placed = hadoop_path(spark, "/".join([top, *[step.partition("=")[2] for step in found.split("/")[-len(names) :]]]))
            files.mkdirs(placed.getParent())
            if files.exists(placed) or not files.rename(hadoop_path(spark, found), placed):
                raise FileExistsError(placed.toString())
    finally:
        files.delete(staging, True)

"""Running statistics over result files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillstrand.functions.scores import is_finite


def result_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def running_stats(stream: DataFrame, value: str, by: str) -> DataFrame:
    """count, valid_count, mean, std, min, max per group, kept up to date; running_medians() keeps medians."""
    x = F.when(is_finite(F.col(value)), F.col(value).cast("double"))
    return stream.groupBy(by).agg(F.count("*").alias("count"), F.count(x).alias("valid_count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def running_medians(stream: DataFrame, value: str, by: str, state: str, k: int = 800) -> DataStreamWriter:
    """A writer, to be started with a checkpoint location, that keeps a mergeable quantile sketch of the finite values of each
    group below state; medians() reads it.

    Each batch is sketched in its tasks, merged with the version before, and written as a version of its own, which a batch
    that runs again replaces; the last two stay. A version has a row a group, whatever has arrived. Ranks are off by
    about 1.3 / k of all values at most, in 99 of 100 cases (0.2 % for 800); groups of few values are exact.
    """
    spark, root = stream.sparkSession, state.rstrip("/")

    def merge(batch: DataFrame, number: int) -> None:
        x = F.when(is_finite(F.col(value)), F.col(value).cast("double"))
        fresh = batch.groupBy(by).agg(F.count(x).alias("valid_count"), F.kll_sketch_agg_double(x, k).alias("sketch"))
        older = [n for n in _versions(spark, root) if n < number]
        both = fresh.union(spark.read.schema(fresh.schema).parquet(f"{root}/version={older[-1]}")) if older else fresh
        merged = both.groupBy(by).agg(F.sum("valid_count").alias("valid_count"), F.kll_merge_agg_double("sketch").alias("sketch"))
        merged.write.mode("overwrite").parquet(f"{root}/version={number}")
        for n in older[:-1]:
            _store(spark, f"{root}/version={n}", lambda fs, p: fs.delete(p, True))

    return stream.writeStream.foreachBatch(merge)


def _store(spark: SparkSession, path: str, use: Callable):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return use(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of whole versions, in order."""
    found = _store(spark, f"{root}/version=*/_SUCCESS", lambda fs, p: fs.globStatus(p)) or []
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in found)


def medians(spark: SparkSession, state: str, by: str, share: float = 0.5) -> DataFrame:
    """(by, valid_count, median) of what has arrived; share asks for another quantile. NaN for groups without finite values.
    ValueError before the first batch."""
    root = state.rstrip("/")
    if not (versions := _versions(spark, root)):
        raise ValueError(f"no version below {root}")
    rows = spark.read.parquet(f"{root}/version={versions[-1]}")
    median = F.when(F.col("valid_count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share))).otherwise(F.lit(float("nan")))
    return rows.select(by, "valid_count", median.alias("median"))

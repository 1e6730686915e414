"""Writing per-sample rows, summaries, reports, caches and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fields keep white space at their ends and backslashes; quotes are doubled. Null is an empty field, an empty text is "".
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_rows(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_summary(one_row: DataFrame, path: str) -> None:
    """A JSON object of a one-row aggregate."""
    one_row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV).csv(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows of a run log; readers number them with append_reindexed."""
    df.write.mode("append").option("header", True).csv(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """One JSON object of label to id, in the order of ids; a vocabulary has a row a class."""
    pairs = F.sort_array(F.collect_list(F.struct("label_id", "label")))
    by_label = F.map_from_arrays(F.col("p.label"), F.col("p.label_id"))
    vocabulary.agg(pairs.alias("p")).select(F.to_json(by_label).alias("value")).coalesce(1).write.text(path)

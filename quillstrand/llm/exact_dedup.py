"""Exact deduplication by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrand.shared import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True) -> DataFrame:
    """Group rows by the 128-bit hash of their text, then by the bytes themselves inside each hash.

    Texts are equal when identical, after lower-casing A-Z only if fold_case. Of equal texts the row with the
    smallest (keep="min") or largest ("max") id stays. Returns a row per input row: id, keep_id, group_size,
    kept, text_sha256.

    Null text counts as empty. Rows with a null id belong to their group and count in its size, but stay only
    in a group where no row has an id (keep_id is null there). Repeated rows with one id all carry kept = true
    if that id stays. Empty tables give empty results; other columns are ignored.

    Copies collapse to one row per text in the map tasks, so a group of any size costs a row per task; the
    grouping compares whole texts, so rows that collide in the hash end in different groups. Both digests then
    name the group, and the join back moves ids and digests only; a hot group is an ordinary skew join.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.translate(text, UPPER, LOWER) if fold_case else text
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"))
    keyed = rows.select("doc_id", "body", F.unhex(F.md5("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("sha"))
    best = (F.min if keep == "min" else F.max)("doc_id")
    groups = keyed.groupBy("h", "sha", "body").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    out = keyed.select("doc_id", "h", "sha").join(groups.select("h", "sha", "keep_id", "group_size"), ["h", "sha"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True) -> DataFrame:
    """The rows of docs that stay, one for each different text, with all their columns.

    A row that is repeated with its id and text stays once; which of them is arbitrary. Where no row of a
    group has an id, one of its rows stays.
    """
    own, number, kept_id, kept_sha = (free_name(n, docs) for n in ("own_sha", "number", "kept_id", "kept_sha"))
    kept = exact_groups(docs, id_col, text_col, keep, fold_case).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.translate(text, UPPER, LOWER) if fold_case else text
    marked = docs.withColumn(own, F.sha2(text.cast("binary"), 256))
    there = marked.join(kept, marked[id_col].eqNullSafe(kept[kept_id]) & (marked[own] == kept[kept_sha]), "left_semi")
    once = Window.partitionBy(id_col, own).orderBy(F.lit(0))
    return there.withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).select(*docs.columns)

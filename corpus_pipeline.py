"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents, whatever further columns there are and whatever their names. Null texts count as empty, null
ids are kept where the operator can't place them, repeated rows are rows of their own up to the exact dedup, and an
empty table gives an empty table.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand.llm import exact_dedup, jaccard_join, packing, pii, quality
from quillstrand.llm.queries import train_quality
from quillstrand.shared import SMALLEST, discard, free_name, settled, small_batches

#: Documents that score lower are rejected: those likelier bad than good. op5's predicted asks for 0.7; between the two
#: the pipeline keeps the document.
LEAST_QUALITY = 0.5

ORACLE_SQL = None  # learning, links and merges are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of LEAST_QUALITY or more; empty texts have the score of a text without features. Where all
    labels that may be learnt from are one class, every document has that class's share: all are kept or none."""
    small_batches(spark, SMALLEST)
    score = free_name("score", docs)
    return quality.scored(docs, train_quality(spark, sf_dir), out=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z lower-cased, the row with the smallest id; a null id only where no other row has one."""
    return exact_dedup.drop_copies(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; rows with a null id stay."""
    return jaccard_join.drop_similar(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text replaced by <kind>; no row goes."""
    small_batches(spark, SMALLEST)
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence; null and empty texts are the end id alone."""
    small_batches(spark, SMALLEST)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. Only what a stage kept stays on disk, until the next one has read it; the last table that
    is left is the last stage's input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

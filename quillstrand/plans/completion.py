"""Comparing generated continuations, given as a column, with the true ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrand.functions import scores, spectra, waves
from quillstrand.functions.sequence import is_coding_region
from quillstrand.operators import metrics
from quillstrand.shared import free_name

#: The metrics of a row, in order.
METRICS = ("edit_distance", "exact_match_acc", "kmer_jsd", "kmer_ks", "is_cds")


def _scored(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """All that is found out about two texts letter by letter, so that they go to Python once; nulls where one is null."""
    for a, b in pairs:
        both = zip(a, b, waves.compare(waves.Edits, a, b))
        rows = [(None,) * 4 if d is None else (d, scores.same_places(x, y), *spectra.distances(x, y, spectra.pair_k(x, y))[:2]) for x, y, d in both]
        found = pd.DataFrame(rows, columns=["edits", "same", "kmer_ks", "kmer_jsd"])
        yield found.astype({"edits": "Int64", "same": "Int64", "kmer_ks": "float64", "kmer_jsd": "float64"})


def with_metrics(df: DataFrame, truth: str = "ground_truth", made: str = "generated") -> DataFrame:
    """df with METRICS in place of such columns it holds, worked out inside each row. The continuation is cut to the truth's
    length, except for is_cds. Missing texts give NaN; two empty ones match; one empty one gives NaN and 0."""
    t, whole, cut = F.col(truth), F.col(made), free_name("cut", df)
    df = df.withColumn(cut, F.substring(whole, F.lit(1), F.length(t)))
    m = F.col(cut)
    full = (F.coalesce(F.length(t), F.lit(0)) > 0) & (F.coalesce(F.length(m), F.lit(0)) > 0)
    # Rows without both texts give the functions nulls, which they pass by.
    a, b = F.when(full, t), F.when(full, m)
    own = free_name("own", df)
    df = df.withColumn(own, F.pandas_udf(_scored, "edits long, same long, kmer_ks double, kmer_jsd double")(a, b))
    same = F.when(F.length(t) == F.length(m), F.col(own)["same"] / F.length(t)).otherwise(F.lit(0.0))
    missing = t.isNull() | whole.isNull()
    exact = F.when(missing, scores.nan()).when(full, same).when((t == "") & (whole == ""), F.lit(1.0)).otherwise(F.lit(0.0))
    found = {
        "edit_distance": F.when(full, F.col(own)["edits"] / F.length(t)).otherwise(scores.nan()),
        "exact_match_acc": exact,
        "kmer_jsd": F.coalesce(F.col(own)["kmer_jsd"], scores.nan()),
        "kmer_ks": F.coalesce(F.col(own)["kmer_ks"], scores.nan()),
        "is_cds": F.when(missing, F.lit(False)).otherwise(is_coding_region(whole)),
    }
    return df.withColumns(found).drop(cut, own)


def row_metrics(df: DataFrame, key: str, truth: str = "ground_truth", made: str = "generated") -> DataFrame:
    """(key, METRICS) of each row."""
    return with_metrics(df.select(key, truth, made), truth, made).select(key, *METRICS)


def summary(df: DataFrame) -> DataFrame:
    """One row: five numbers of each metric, and how many rows hold coding regions (share of all rows, 0 if none)."""
    stats = [c for m in ("edit_distance", "exact_match_acc", "kmer_jsd", "kmer_ks") for c in metrics.five_numbers(F.col(m), prefix=f"{m}_")[:5]]
    hits = F.count_if("is_cds")
    return df.agg(F.count("*").alias("count"), *stats, hits.alias("is_cds_count"), F.coalesce(hits / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("is_cds_ratio"))

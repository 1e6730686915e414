"""From sequences to bits-per-base: a scorer contract, a Markov scorer as the built-in provider, windows and reports.

A scorer is anything that makes a table (sequence_index, avg_nll_token, token_count[, char_count]).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrand.functions import scores
from quillstrand.operators import metrics
from quillstrand.shared import small_batches

#: Letters below this number are counted in a table of that length, others by sorting.
DENSE = 1 << 14


def _counts(text: str, order: int) -> tuple[list[str], list[int]]:
    if order:
        grams = Counter(map("".join, zip(*[text[k:] for k in range(order + 1)])))
        return list(grams), list(grams.values())
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) and codes.max() < DENSE:
        times = np.bincount(codes)
        seen = np.flatnonzero(times)
        return [chr(c) for c in seen.tolist()], times[seen].tolist()
    seen, times = np.unique(codes, return_counts=True)
    return [chr(c) for c in seen.tolist()], times.tolist()


def _grams(text: Column, order: int) -> Column:
    """array of struct(gram, c): the runs of order + 1 letters of a text, and how often each comes in it."""

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            grams: list[str] = []
            times: list[int] = []
            ends = [0]
            for t in texts:
                for into, found in zip((grams, times), _counts(t.as_py() or "", order)):
                    into += found
                ends.append(len(grams))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(grams, pa.string()), pa.array(times, pa.int64())], ["gram", "c"]))

    return F.arrow_udf(counted, "array<struct<gram: string, c: bigint>>")(text)


def _parts(order: int) -> list[Column]:
    return [F.substring("gram", 1, order).alias("context"), F.substring("gram", order + 1, 1).alias("letter")]


def markov_counts(train: DataFrame, text: str, order: int = 0) -> DataFrame:
    """(context, letter, n, total): counts of each letter after each context of order letters."""
    small_batches(train.sparkSession)
    grams = train.select(F.inline(_grams(F.col(text), order))).groupBy("gram").agg(F.sum("c").alias("n"))
    return grams.select(*_parts(order), "n").withColumn("total", F.sum("n").over(Window.partitionBy("context")))


def markov_scores(df: DataFrame, counts: DataFrame, key: str, text: str, order: int = 0, after: int = scores.SCORED_AFTER, letters: int = 256) -> DataFrame:
    """(key, avg_nll_token, token_count): mean of -ln p with one added to each count, over letters past `after`."""
    first = max(after, order)
    scored = F.substring(F.col(text), F.lit(first - order + 1), F.length(text))
    small_batches(df.sparkSession)
    rows = df.where(F.length(text) > first).select(key, F.inline(_grams(scored, order))).select(key, *_parts(order), "c")
    p = (F.coalesce("n", F.lit(0)) + 1.0) / (F.coalesce("total", F.lit(0)) + float(letters))
    totals = rows.join(counts, ["context", "letter"], "left").groupBy(key).agg(F.sum(F.col("c") * -F.log(p)).alias("nll"), F.sum("c").alias("token_count"))
    return totals.select(key, (F.col("nll") / F.col("token_count")).alias("avg_nll_token"), "token_count")


def per_sample(details: DataFrame, sequences: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bpb, bits_per_scored_base, avg_nll_token, token_count, char_count, sequence_chars). Sequences without a
    score have NaN. The first divides by characters past the offset, never more than tokens; the second by tokens."""
    joined = sequences.select(key, F.length(text).alias("sequence_chars")).join(details, key, "left")
    bpb = scores.bits_per_base(F.col("avg_nll_token"), F.col("token_count"), chars=F.col("sequence_chars"))
    return joined.select(key, bpb.alias("bpb"), (F.col("avg_nll_token") / F.log(F.lit(2.0))).alias("bits_per_scored_base"), "avg_nll_token", "token_count", F.greatest(F.lit(0), F.col("sequence_chars") - scores.SCORED_AFTER).alias("char_count"), "sequence_chars")


def recomputed(bpb: Column, avg_nll: Column, tokens: Column, char_count: Column, chars: Column) -> Column:
    """struct(value, changed): bits per base to four places. A stored char_count tells the length, or else chars does. The
    stored value stays where char_count and enough tokens cover the length past the offset, and where there is nothing
    to compute from; any other row is recomputed."""
    whole = F.coalesce(char_count + scores.SCORED_AFTER, chars)
    expected = whole - scores.SCORED_AFTER
    covered = F.coalesce((char_count == expected) & (tokens >= expected), F.lit(False))
    again = F.coalesce((expected > 0) & ~covered & scores.is_finite(avg_nll) & (tokens > 0), F.lit(False))
    old = F.when(scores.is_finite(bpb), F.round(bpb, 4))
    return F.struct(F.when(again, F.round(scores.bits_per_base(avg_nll, tokens, chars=whole), 4)).otherwise(old).alias("value"), again.alias("changed"))


def sliding_plan(lengths: DataFrame, key: str, n: str, window: int, stride: int) -> DataFrame:
    """(key, begin, end, scored): windows that advance by stride until the end; scored counts tokens not scored before."""
    last = F.greatest(F.lit(0), F.ceil((F.col(n) - window) / F.lit(float(stride))).cast("int"))
    rows = lengths.where(F.col(n) > 0).select(key, n, F.explode(F.sequence(F.lit(0), last)).alias("__k"))
    begin = F.col("__k") * stride
    end = F.least(begin + window, F.col(n))
    before = F.when(F.col("__k") == 0, F.lit(0)).otherwise(F.least(begin - stride + window, F.col(n)))
    return rows.select(key, begin.cast("long").alias("begin"), end.cast("long").alias("end"), (end - before).cast("long").alias("scored"))


def last_stride_plan(lengths: DataFrame, key: str, n: str, window: int, stride: int) -> DataFrame:
    """The same windows; of each, only the last stride tokens are scored, so the first window - stride never are."""
    return sliding_plan(lengths, key, n, window, stride).withColumn("scored", F.least(F.lit(stride).cast("long"), F.col("end") - F.col("begin")))


def end_aligned_plan(lengths: DataFrame, key: str, n: str, window: int, stride: int, start: int = 0) -> DataFrame:
    """(key, begin, end, scored): ends at window, window + stride, ... and n; a window reaches back from its end as far as
    it can, so the last one is full. scored counts its tokens at start or later that no earlier window reached."""
    last = F.greatest(F.lit(0), F.ceil((F.col(n) - window) / F.lit(float(stride))).cast("int"))
    rows = lengths.where(F.col(n) > 0).select(key, n, F.explode(F.sequence(F.lit(0), last)).alias("__k"))
    end = F.least(F.col("__k") * stride + window, F.col(n))
    begin = F.greatest(F.lit(0), end - window)
    before = F.when(F.col("__k") == 0, F.lit(0)).otherwise(F.least((F.col("__k") - 1) * stride + window, F.col(n)))
    first = F.greatest(before, begin, F.lit(start))
    return rows.select(key, begin.cast("long").alias("begin"), end.cast("long").alias("end"), F.greatest(end - first, F.lit(0)).cast("long").alias("scored"))


def range_plan(lengths: DataFrame, key: str, n: str, window: int, stride: int, start: int = 1) -> DataFrame:
    """(key, begin, end, first, last): tokens from start (1 at least) are scored stride at a time, each time in a window
    that ends with them and reaches back up to window tokens; sequences of at most window tokens are one window. The
    tokens are those of the window's predictions [first, last), the prediction at place j being of token begin + 1 + j. A
    stride of window or more leaves tokens out that no window predicts."""
    start = max(start, 1)
    rows = lengths.where(F.col(n) > start).select(key, n, F.explode(F.sequence(F.lit(start), F.col(n) - 1, F.lit(stride))).alias("__cut"))
    short = F.col(n) <= window
    rows = rows.where(~short | (F.col("__cut") == start))
    end = F.when(short, F.col(n)).otherwise(F.least(F.col("__cut") + stride, F.col(n)))
    rows = rows.select(key, "__cut", end.cast("long").alias("end"), F.greatest(F.lit(0), end - window).cast("long").alias("begin"))
    first = F.greatest(F.col("__cut") - F.col("begin") - 1, F.lit(0)).cast("long")
    return rows.select(key, "begin", "end", first.alias("first"), (F.col("end") - F.col("begin") - 1).alias("last")).where("first < last")


def recompute_summary(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Five numbers per group of values to four places, themselves to four places; only finite values are counted."""
    x = F.round(F.col(value), 4)
    return rows.where(scores.is_finite(F.col(value))).groupBy(by).agg(*metrics.five_numbers(x, 4))


def rewritten_count(changed: Column, chars: Column, char_count: Column) -> Column:
    """char_count, or where the row was recomputed its length past the offset (unknown lengths are 0)."""
    past = F.greatest(F.lit(0), F.coalesce(chars, F.lit(0)) - scores.SCORED_AFTER)
    return F.when(changed, past).otherwise(char_count)


def model_report(df: DataFrame, model: str, bucket: str, value: str, buckets: list[str]) -> DataFrame:
    """A row a model; per bucket min, max, median, mean to four places, missing ones empty."""
    own = lambda b: F.when(scores.is_finite(F.col(value)) & (F.col(bucket) == b), F.col(value))
    stats = {"min": F.min, "max": F.max, "median": lambda x: F.percentile(x, F.lit(0.5)), "mean": F.avg}
    return df.groupBy(model).agg(*[F.coalesce(scores.four_places(f(own(b))), F.lit("")).alias(f"{b}_{n}") for b in buckets for n, f in stats.items()])


def report_table(stats: DataFrame, buckets: list[str]) -> DataFrame:
    """The same report from (bucket, model, min, max, median, mean), a row for each model in a bucket."""
    own = lambda b, n: F.max(F.when(F.col("bucket") == b, F.col(n)))
    return stats.groupBy("model").agg(*[F.coalesce(scores.four_places(own(b, n)), F.lit("")).alias(f"{b}_{n}") for b in buckets for n in ("min", "max", "median", "mean")])

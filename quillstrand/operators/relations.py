"""Relational operators on split tables: labels, joins, windows, prompts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrand.functions import scores
from quillstrand.functions.sequence import WHITE
from quillstrand.shared import free_name, stash


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df cut to names; KeyError if one is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*names)


def explode_sequences(df: DataFrame, list_col: str = "sequences", id_col: str = "taxid", max_length: int = 0) -> DataFrame:
    """A row per non-empty sequence of a list, with its ordinal; cut to max_length if that is over 0."""
    if max_length < 0:
        raise ValueError("max_length must not be negative")
    rows = df.where(F.col(id_col).isNotNull()).select(id_col, F.posexplode(list_col).alias("contig_index", "sequence")).where("sequence <> ''")
    return rows.withColumn("sequence", F.substring("sequence", 1, max_length)) if max_length else rows


def materialise_sequence(sequence: Column, sequences: Column) -> Column:
    return F.coalesce(sequence, F.array_join(sequences, ""), F.lit(""))


def clean_label(c: Column | str) -> Column:
    return F.btrim((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(WHITE))


def label_vocabulary(train: DataFrame, column: str) -> DataFrame:
    """(label, label_id): the different non-blank labels in order, ids dense from 0. One row a class."""
    labels = train.select(clean_label(column).alias("label")).where("label <> ''").distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("label_id"))


def encode_labels(df: DataFrame, vocabulary: DataFrame, column: str, out: str = "label_id") -> DataFrame:
    """Unknown and missing labels get -1. Adaptive execution broadcasts the vocabulary if it is small."""
    v = vocabulary.select(F.col("label").alias("__label"), F.col("label_id").alias("__id"))
    return df.join(v, clean_label(df[column]) == v["__label"], "left").withColumn(out, F.coalesce("__id", F.lit(-1))).drop("__label", "__id")


def decode_labels(df: DataFrame, vocabulary: DataFrame, column: str, out: str = "label") -> DataFrame:
    v = vocabulary.select(F.col("label").alias("__label"), F.col("label_id").alias("__id"))
    name = F.coalesce("__label", F.concat(F.lit("class_"), F.col(column).cast("string")))
    return df.join(v, df[column] == v["__id"], "left").withColumn(out, name).drop("__label", "__id")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df; ValueError if a key (nulls included) comes twice."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} isn't unique")
    return df


def attach_many_to_one(left: DataFrame, right: DataFrame, key: str, checked: bool = True) -> DataFrame:
    """Left join on a key that is unique on the right; null keys meet each other."""
    right = (assert_unique(right, key) if checked else right).withColumnRenamed(key, "__key")
    return left.join(right, left[key].eqNullSafe(right["__key"]), "left").drop("__key")


def attach_positional(left: DataFrame, right: DataFrame, order: str, key: str) -> DataFrame:
    """Rows side by side by an explicit ordinal; aligned says whether the keys of a position agree (nulls do)."""
    r = right.withColumnRenamed(key, "__key")
    agree = F.col(key).eqNullSafe(F.col("__key"))
    return left.join(r, order, "full").withColumn("aligned", agree).drop("__key")


def class_weights(df: DataFrame, label: str = "label_id") -> DataFrame:
    """(label_id, weight): n / (k * n_c) over valid labels; k classes that occur."""
    counts = df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n_c"))
    whole = Window.partitionBy()
    return counts.select(label, (F.sum("n_c").over(whole) / (F.count("*").over(whole) * F.col("n_c"))).alias("weight"))


def expand_windows(df: DataFrame, width: int, text: str = "sequence") -> DataFrame:
    """A row per window: window_index, num_windows, window_start, window; sequences without letters give none."""
    starts = df.withColumn("__starts", scores.window_starts(F.length(text), width))
    rows = starts.select("*", F.size("__starts").alias("num_windows"), F.posexplode("__starts").alias("window_index", "window_start"))
    return rows.withColumn("window", scores.window_at(F.col(text), F.col("window_start"), width)).drop("__starts")


def sample_windows(windows: DataFrame, k: int, train: bool, seed: int = 42, epoch: int = 0, key: str = "seq_index") -> DataFrame:
    """k windows a sequence without replacement, by the rank of a hash. Training takes all if k <= 0, else all if k < 0."""
    if (train and k <= 0) or (not train and k < 0):
        return windows
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key), F.col("window_index")), "window_index"))
    return windows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def group_mean(df: DataFrame, group: str, vector: str, order: str, label: str) -> DataFrame:
    """Element-wise mean of vectors per group, and the label of its first row."""
    cells = df.select(group, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean_vector"))
    first = df.groupBy(group).agg(F.min_by(label, order).alias("label"))
    return vectors.join(first, group)


POOLS = ("mean", "max", "min", "cls", "final")


def pool(df: DataFrame, group: str, vector: str, order: str) -> DataFrame:
    """(group, mean, max, min, cls, final): element-wise pools of the vectors of a group, which have one length, as
    arrays of double; cls is the first vector by order, final the last."""
    cells = df.select(group, F.col(order).alias("__order"), F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    x = F.col("x")
    made = {"mean": F.avg(x), "max": F.max(x), "min": F.min(x), "cls": F.min_by(x, "__order"), "final": F.max_by(x, "__order")}
    pooled = cells.groupBy(group, "i").agg(*[made[n].alias(n) for n in POOLS])
    vectors = pooled.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", *POOLS))).alias("v"))
    return vectors.select(group, *[F.col(f"v.{n}").alias(n) for n in POOLS])


def split_overlap(df: DataFrame, split: str, group: str) -> DataFrame:
    """(split_a, split_b, shared): groups that two splits have in common."""
    g = df.select(split, group).distinct()
    a, b = g.select(F.col(split).alias("split_a"), group), g.select(F.col(split).alias("split_b"), group)
    return a.join(b, group).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def length_buckets(n: Column, cuts: list[Column]) -> Column:
    """Names by quantile cuts at 5, 33 and 66 percent; below the first cut null."""
    return F.when(n < cuts[0], F.lit(None).cast("string")).when(n < cuts[1], F.lit("short")).when(n < cuts[2], F.lit("medium")).otherwise(F.lit("long"))


def prompt_split(df: DataFrame, text: str, wanted: int | None = None) -> DataFrame:
    """prompt and ground_truth; sequences of at most one letter, and empty sides, go."""
    cut = scores.prompt_length(F.length(text), wanted)
    rows = df.where(F.length(text) > 1).withColumn("prompt_len", cut)
    rows = rows.withColumn("prompt", F.substring(F.col(text), F.lit(1), F.col("prompt_len"))).withColumn("ground_truth", F.substring(F.col(text), F.col("prompt_len") + 1, F.length(text)))
    return rows.where("prompt_len > 0 and ground_truth <> ''")


def continuation(generated: list[Column], prompt: Column) -> Column:
    """The first of generated sequence, continuation, tail and full text that is there; the prompt is taken off the
    first and the last."""
    sequence, cont, tail, full = generated
    return F.coalesce(scores.strip_prefix(sequence, prompt), cont, tail, scores.strip_prefix(full, prompt))


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def append_reindexed(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Both tables, idx numbered anew from 1. The log is a row per run, so one window over it is small."""
    both = old.drop("idx").unionByName(new.drop("idx"), allowMissingColumns=True)
    return both.withColumn("idx", F.row_number().over(Window.orderBy(*order)).cast("long"))


def predictions(rows: DataFrame, vocabulary: DataFrame, metadata: DataFrame, key: str, logits: str, label: str = "label", predicted: str = "pred") -> DataFrame:
    """(key, true_label_id, true_label, predicted_label_id, predicted_label, confidence, metadata's columns): rows with the
    names of their classes (class_<id> for unknown ones) and what metadata, a row per key, tells of them (null if nothing)."""
    confidence = F.array_max(scores.softmax(F.col(logits)))
    out = rows.select(key, F.col(label).alias("true_label_id"), F.col(predicted).alias("predicted_label_id"), confidence.alias("confidence"))
    out = decode_labels(out, vocabulary, "true_label_id", "true_label")
    out = decode_labels(out, vocabulary, "predicted_label_id", "predicted_label")
    more = [c for c in metadata.columns if c != key]
    return out.join(metadata, key, "left").select(key, "true_label_id", "true_label", "predicted_label_id", "predicted_label", "confidence", *more)


def numbered(df: DataFrame, order: list[str], out: str = "i") -> DataFrame:
    """df with out, its row numbers from 1 by the order columns, without the whole table in one task: rows are dealt to
    ranges, which are counted and numbered each for itself. Rows equal in all order columns share a range."""
    part, before = free_name("part", df), free_name("before", df)
    ranged = stash(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(part).agg(F.count("*").alias(before))  # a row a range
    up_to = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(before).over(up_to), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(offsets), part).withColumn(out, (own + F.col(before)).cast("long")).drop(part, before)


def split_shares(df: DataFrame, split: str, wanted: dict[str, float], slack: float = 0.02) -> DataFrame:
    """(split, n, share, as_wanted): rows of each wanted split, 0 where there are none, and whether its share of all rows
    departs from the wanted one by no more than slack."""
    spark = df.sparkSession
    plan = spark.createDataFrame(list(wanted.items()), f"{split} string, wanted double")
    rows = plan.join(df.groupBy(split).agg(F.count("*").alias("n")), split, "full")  # a row a split
    n = F.coalesce("n", F.lit(0).cast("long"))
    share = n / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0))
    return rows.select(split, n.alias("n"), share.alias("share"), (F.abs(share - F.col("wanted")) <= slack).alias("as_wanted"), "wanted").where("wanted is not null").drop("wanted")


def time_order(df: DataFrame, split: str, date: str, order: list[str]) -> DataFrame:
    """(earlier, later, last, first, in_order): for each two splits of order that follow one another, the last date of
    one, the first of the other, and whether the first isn't before the last."""
    at = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(split))
    ends = df.groupBy(split).agg(F.min(date).alias("first"), F.max(date).alias("last")).withColumn("at", at).where("at > 0")
    a = ends.select(F.col(split).alias("earlier"), "last", (F.col("at") + 1).alias("at"))
    b = ends.select(F.col(split).alias("later"), "first", "at")
    return a.join(b, "at").select("earlier", "later", "last", "first", (F.col("last") <= F.col("first")).alias("in_order"))


def full_weights(vocabulary: DataFrame, weights: DataFrame, label: str = "label_id") -> DataFrame:
    """(label_id, weight) for each class of the vocabulary; 1 for a class that the weights don't hold."""
    return vocabulary.select(label).join(weights, label, "left").select(label, F.coalesce("weight", F.lit(1.0)).alias("weight"))


def kept_and_dropped(df: DataFrame, keep: Column, by: str) -> DataFrame:
    """(by, kept, dropped): how many rows a filter keeps; an unknown answer drops."""
    good = F.coalesce(keep, F.lit(False))
    return df.groupBy(by).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def with_errors(df: DataFrame, checks: dict[str, Column], measures: list[str]) -> DataFrame:
    """df with error: the name, 200 letters at most, of the first check that holds. Such rows have NaN in measures."""
    error = F.coalesce(*[F.when(c, F.lit(n[:200])) for n, c in checks.items()])
    marked = df.withColumn("error", error)
    return marked.withColumns({m: F.when(F.col("error").isNotNull(), scores.nan()).otherwise(F.col(m)) for m in measures})


def reduce_chunks(df: DataFrame, key: str, vector: str, order: str, how: str = "mean") -> DataFrame:
    """(key, vector): logits of the chunks of a long sequence, element-wise by mean or max."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown reduction: {how}")
    return pool(df, key, vector, order).select(key, F.col(how).alias(vector))


def epoch_order(df: DataFrame, row: str, seed: int, epoch: int, chunk: str | None = None) -> DataFrame:
    """Rows in the order of a hash of seed, epoch and row, inside each chunk if there are chunks; another epoch gives
    another order. Not the numbers of any generator."""
    rank = F.xxhash64(F.lit(seed), F.lit(epoch), F.col(row))
    return df.orderBy(*([chunk] if chunk else []), rank, row)


def indexed(df: DataFrame, order: list[str], out: str = "sequence_index") -> DataFrame:
    """df with out, its row numbers from 0 by the order columns; filters that follow leave gaps in it."""
    return numbered(df, order, out).withColumn(out, F.col(out) - 1)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by the order columns: each task hands on n rows at most. None for n below 1."""
    return df.orderBy(*order).limit(max(n, 0))


def label_frequency(df: DataFrame, label: str, n: int = 5) -> DataFrame:
    """(label, n): the n most frequent labels; of equally frequent ones the least come first."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(n)

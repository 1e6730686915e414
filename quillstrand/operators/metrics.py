"""Aggregations: summary statistics, classification metrics, k-mer spectra."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstrand.functions import scores, spectra
from quillstrand.functions.sequence import auto_k, effective_length
from quillstrand.operators.ranges import before_row
from quillstrand.shared import settled


def five_numbers(x: Column, places: int | None = None, prefix: str = "") -> list[Column]:
    """mean, median, std (population), min, max over finite values, count and valid_count; NaN if none is finite."""
    value = F.when(scores.is_finite(x), x.cast("double"))
    shown = {"mean": F.avg(value), "median": F.percentile(value, F.lit(0.5)), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value)}
    cut = (lambda c: F.round(c, places)) if places is not None else (lambda c: c)
    out = [cut(F.coalesce(c, scores.nan())).alias(prefix + n) for n, c in shown.items()]
    return [*out, F.count("*").alias(prefix + "count"), F.count(value).alias(prefix + "valid_count")]


def valid_labels(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    return df.where(F.col(label).between(0, classes - 1))


def confusion(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """(label, pred, n) in long form, pairs that occur."""
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """(class, tp, support, predicted) over the union of labels and predictions."""
    c = confusion(df, label, predicted)
    zero = F.lit(0).cast("long")
    side = lambda k, x, y: F.struct(F.col(k).alias("class"), x.alias("support"), y.alias("predicted"))
    sides = c.select(F.explode(F.array(side(label, F.col("n"), zero), side(predicted, zero, F.col("n")))).alias("s"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(zero).alias("hit"))
    return sides.groupBy(F.col("s.class").alias("class")).agg((F.sum("hit") / 2).cast("long").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_report(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """(class, precision, recall, f1, support); division by zero gives 0."""
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return class_counts(df, label, predicted).select("class", p.alias("precision"), r.alias("recall"), _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "support")


def overall(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """One row: accuracy, f1_macro, f1_micro, f1_weighted, precision_macro, recall_macro."""
    c = class_report(df, label, predicted).withColumn("hit", F.col("recall") * F.col("support"))
    accuracy = F.sum("hit") / F.sum("support")
    return c.agg(accuracy.alias("accuracy"), F.avg("f1").alias("f1_macro"), accuracy.alias("f1_micro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"))


def full_report(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """(name, precision, recall, f1, support): the classes, then accuracy (the same number in all three places), macro avg
    and weighted avg. Tables without rows give the averages alone, as nulls."""
    c = class_report(df, label, predicted)
    total = F.sum("support").alias("support")
    accuracy = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    parts = ("precision", "recall", "f1")
    rows = [c.select(F.col("class").cast("string").alias("name"), *parts, "support")]
    rows.append(c.agg(*[accuracy.alias(p) for p in parts], total).select(F.lit("accuracy").alias("name"), *parts, "support"))
    rows.append(c.agg(*[F.avg(p).alias(p) for p in parts], total).select(F.lit("macro avg").alias("name"), *parts, "support"))
    rows.append(c.agg(*[(F.sum(F.col(p) * F.col("support")) / F.sum("support")).alias(p) for p in parts], total).select(F.lit("weighted avg").alias("name"), *parts, "support"))
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def confusion_filled(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """(label, pred, n) for all pairs of classes that occur, 0 where a pair doesn't: a row per pair of classes."""
    pairs = confusion(df, label, predicted)
    classes = pairs.select(F.explode(F.array(label, predicted)).alias("class")).distinct().agg(F.sort_array(F.collect_list("class")).alias("all"))
    grid = classes.select(F.explode("all").alias(label), "all").select(label, F.explode("all").alias(predicted))
    return grid.join(pairs, [label, predicted], "left").select(label, predicted, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def binary(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """One row of two boolean columns' accuracy, f1, precision, recall and mcc; a division by zero gives 0."""
    y, p = F.col(label), F.col(predicted)
    c = df.agg(*[F.count_if(a & b).cast("double").alias(n) for n, a, b in (("tp", y, p), ("fp", ~y, p), ("fn", y, ~p), ("tn", ~y, ~p))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    down = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    out = {"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "mcc": _ratio(tp * tn - fp * fn, down)}
    return c.select(*[v.alias(k) for k, v in out.items()])


def mcc(df: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """One row: multiclass Matthews correlation; 0 where labels or predictions have one class only."""
    c = class_counts(df, label, predicted).select(*[F.col(x).cast("double").alias(x) for x in ("tp", "support", "predicted")])
    s, tp = F.sum("support"), F.sum("tp")
    tt, pp, tp2 = F.sum(F.col("support") ** 2), F.sum(F.col("predicted") ** 2), F.sum(F.col("support") * F.col("predicted"))
    down = F.sqrt((s * s - pp) * (s * s - tt))
    return c.agg(F.when(down == 0, F.lit(0.0)).otherwise((tp * s - tp2) / down).alias("mcc"))


def one_vs_rest(df: DataFrame, logits: str, label: str = "label") -> DataFrame:
    """(class, score, positive): softmax probabilities of every class."""
    return df.select(F.col(label), F.posexplode(scores.softmax(F.transform(logits, lambda x: x.cast("double")))).alias("class", "score")).select("class", "score", (F.col(label) == F.col("class")).cast("int").alias("positive"))


def _steps(ovr: DataFrame) -> DataFrame:
    """Per class and different score: positives and rows with it, and how many stand at or above it. Running sums go over
    ranges of (class, score), so a class of any size is spread over tasks; a score's rows are summed up first."""
    ties = ovr.groupBy("class", "score").agg(F.sum("positive").alias("p"), F.count("*").alias("n"))
    above = before_row(ties, "class", [F.col("score").desc()], {"tp": ("sum", F.col("p")), "at": ("sum", F.col("n"))})
    return above.select("class", "p", "n", (F.col("tp") + F.col("p")).alias("tp"), (F.col("at") + F.col("n")).alias("at"))


def _areas(steps: DataFrame) -> DataFrame:
    """(class, auroc, auprc) in one aggregation over the steps."""
    s = steps.withColumn("fp", F.col("at") - F.col("tp")).withColumn("neg", F.col("n") - F.col("p"))
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("p") + F.col("p") / 2))
    roc = F.when((F.sum("p") > 0) & (F.sum("neg") > 0), won / (F.sum("p") * F.sum("neg")))
    precision = F.sum(F.col("p") * F.col("tp") / F.col("at")) / F.nullif(F.sum("p"), F.lit(0))
    return s.groupBy("class").agg(roc.alias("auroc"), F.coalesce(precision, F.lit(0.0)).alias("auprc"))


def _ranked(ovr: DataFrame) -> DataFrame:
    """_areas(), worked out: a row a class is kept, the ranges' tables are deleted."""
    return settled(ovr.sparkSession, lambda: _areas(_steps(ovr)), "areas")


def auroc(ovr: DataFrame) -> DataFrame:
    """(class, auroc): the share of positive and negative pairs in order, ties counting half."""
    return _ranked(ovr).select("class", "auroc")


def auprc(ovr: DataFrame) -> DataFrame:
    """(class, auprc): average precision; 0 for a class without positives."""
    return _ranked(ovr).select("class", "auprc")


def ranking(ovr: DataFrame) -> DataFrame:
    """One row: auc_macro_ovr, null if a class has only positives or only negatives (it is left out then), and
    auprc_macro, where a class without positives counts 0."""
    whole = F.when(F.count("*") == F.count("auroc"), F.avg("auroc"))
    return _ranked(ovr).agg(whole.alias("auc_macro_ovr"), F.avg("auprc").alias("auprc_macro"))


def binary_ranking(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row of auroc and auprc (average precision) of a boolean label by a score. Rows without label or score don't count.
    auroc is null where one of the two labels is missing; auprc is 0 without positives, null without rows."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.lit(0).alias("class"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("positive"))
    return _ranked(rows).agg(F.first("auroc").alias("auroc"), F.first("auprc").alias("auprc"))


def kmer_spectrum(df: DataFrame, key: str, text: str, k: Column) -> DataFrame:
    """(key, k, i, p): share of the 4 ** k k-mer types seen i times; i = 0 included. Without k-mers p is 1 at 0."""
    rows = df.select(key, k.cast("int").alias("k"), F.col(text).alias("t"))
    return rows.select(key, "k", F.inline(spectra.spectrum_bins(F.col("t"), F.col("k"))))


def pair_k(a: Column, b: Column) -> Column:
    """The k that suits the shorter text. As a lambda's variable the length is worked out once, and not for each threshold."""
    return F.transform(F.array(F.least(effective_length(a), effective_length(b))), auto_k)[0]


def spectrum_distances(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """(key, kmer_ks, kmer_jsd, kmer_emd) of two spectra, bins aligned and absent ones 0."""
    both = p.select(key, "i", F.col("p").alias("p")).join(q.select(key, "i", F.col("p").alias("q")), [key, "i"], "full")
    both = both.select(key, "i", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    run = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("i")
    gap = F.abs(F.sum("p").over(run) - F.sum("q").over(run))
    # Bins between two that occur hold the same gap: the earth mover's sum weighs each by its width.
    width = F.coalesce(F.lead("i").over(after) - F.col("i"), F.lit(1))
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(1e-12))
    a, b, m = clip(F.col("p")), clip(F.col("q")), clip((F.col("p") + F.col("q")) / 2)
    part = 0.5 * (a * F.log2(a / m) + b * F.log2(b / m))
    cells = both.select(key, gap.alias("gap"), width.alias("width"), part.alias("part"))
    return cells.groupBy(key).agg(F.max("gap").alias("kmer_ks"), F.sum("part").alias("kmer_jsd"), F.sum(F.col("gap") * F.col("width")).alias("kmer_emd"))


def _stop_fold(min_delta: float, patience: int, kind: pa.DataType):
    schema = pa.schema([("run", kind), ("best", pa.float64()), ("best_epoch", pa.int64()), ("last", pa.int64()), ("stop", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by run and place; what a run hands on is its best metric, that one's epoch and place, and where it stopped."""
        run, best, epoch, last, stop, begun = None, -1.0, -1, -1, None, False
        for batch in batches:
            done = []
            for r, i, e, m in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun or r != run:
                    if begun:
                        done.append((run, best, epoch, last, stop))
                    run, best, epoch, last, stop, begun = r, -1.0, -1, -1, None, True
                if stop is None and i - last > patience:
                    stop = last + patience
                if stop is None and m > best + min_delta:
                    best, epoch, last = m, e, i
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((run, best, epoch, last, stop), schema)], schema=schema)

    return fold


def early_stop(epochs: DataFrame, run: str, order: str, metric: str, min_delta: float = 0.0, patience: int = 30) -> DataFrame:
    """(run, best, best_epoch, stopped) of each run's epochs in order: best begins at -1 and rises to a metric over best +
    min_delta; after patience epochs without such a rise the run stops. NaN and null never raise it, but do count as
    epochs. Without a rise best_epoch is -1; stopped is null for runs that go on to their end. Epochs that come twice
    are taken by metric. A patience below 1 is 1; min_delta must not be negative.

    Only a metric over all before it in its run can raise the best. These are found by running maxima over ranges of
    (run, epoch), so no task holds a run; the fold then goes over them alone, in order, and keeps a state of five
    values, however long the run is. The result has a row a run.
    """
    if min_delta < 0:
        raise ValueError("min_delta must not be negative")
    return settled(epochs.sparkSession, lambda: _stops(epochs, run, order, metric, min_delta, max(1, patience)), "early-stops")


def _stops(epochs: DataFrame, run: str, order: str, metric: str, min_delta: float, patience: int) -> DataFrame:
    m = F.col(metric).cast("double")
    rows = epochs.select(F.col(run).alias("run"), F.col(order).alias("e"), F.when(~F.isnan(m), m).alias("m"))
    placed = before_row(rows, "run", [F.col("e"), F.col("m")], {"i": ("sum", F.lit(1).cast("long")), "top": ("max", F.col("m"))})
    rises = placed.where((F.col("m") > min_delta - 1) & (F.col("top").isNull() | (F.col("m") > F.col("top"))))
    kind = rises.schema["run"].dataType
    ordered = rises.select("run", "i", F.col("e").cast("long").alias("e"), "m").repartition("run").sortWithinPartitions("run", "i")
    folded = ordered.mapInArrow(_stop_fold(min_delta, patience, to_arrow_type(kind)), f"run {kind.simpleString()}, best double, best_epoch long, last long, stop long")
    sizes = rows.groupBy(F.col("run").alias("r")).agg(F.count("*").alias("size"))
    met = sizes.join(folded, F.col("r").eqNullSafe(F.col("run")), "left")
    last = F.coalesce("last", F.lit(-1))
    stop = F.coalesce("stop", F.when(F.col("size") - 1 - last >= patience, last + patience))
    ends = met.select("r", F.coalesce("best", F.lit(-1.0)).alias("best"), F.coalesce("best_epoch", F.lit(-1)).cast("long").alias("best_epoch"), stop.alias("stop"))
    at = placed.select(F.col("run").alias("own"), "i", F.col("e").cast("long").alias("stopped"))
    out = ends.join(at, F.col("r").eqNullSafe(F.col("own")) & (F.col("stop") == F.col("i")), "left")
    return out.select(F.col("r").alias(run), "best", "best_epoch", "stopped")


#: Short names of metrics.
ALIASES = {"acc": "accuracy", "f1": "f1_macro"}
#: Metrics that early stopping may watch.
WATCHED = ("mcc", "accuracy", "f1_macro", "auprc")


def watched_metric(name: str) -> str:
    """The full name of a metric that early stopping may watch; ValueError for another."""
    full = ALIASES.get(name, name)
    if full not in WATCHED:
        raise ValueError(f"unknown metric: {name}")
    return full


def masked_loss(nll: Column, scored: Column) -> dict[str, Column]:
    """Aggregates of token losses over scored places: their sum (0 if there are none), their count and mean (NaN)."""
    x = F.when(scored, nll.cast("double"))
    return {"nll_sum": F.coalesce(F.sum(x), F.lit(0.0)), "tokens": F.count(x), "avg_nll": F.coalesce(F.avg(x), scores.nan())}


def average_loss(loss: Column, n: Column) -> Column:
    """Mean of batch losses, weighted by the batches' rows."""
    return F.sum(loss * n) / F.nullif(F.sum(n), F.lit(0))

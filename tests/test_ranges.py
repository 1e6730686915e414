import math
import random

import pytest
from pyspark.sql import functions as F

from quillstrand.operators import metrics
from quillstrand.operators.ranges import before_row


@pytest.fixture()
def many_ranges(spark):
    """Seven ranges, however few rows there are."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_and_maxima_before_a_row(many_ranges):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "a", "a", "b"]), k, r.choice([None, 1, 2, 5]), "x") for k in range(400)]
    df = many_ranges.createDataFrame(rows, "g string, k long, v long, part string").repartition(3)
    got = before_row(df, "g", [F.col("k")], {"sofar": ("sum", F.col("v")), "top": ("max", F.col("v"))})
    want = []
    for g, k, v, x in rows:
        earlier = [w for h, j, w, _ in rows if h == g and j < k and w is not None]
        want.append((g, k, v, x, sum(earlier), max(earlier, default=None)))
    assert sorted(map(tuple, got.collect()), key=lambda t: t[1]) == want


def test_a_group_spreads_over_ranges(many_ranges):
    df = many_ranges.range(1000).select(F.lit(1).alias("g"), F.lit(0).alias("k"))
    got = before_row(df, "g", [F.col("k")], {"n": ("sum", F.lit(1))})
    assert sorted(r.n for r in got.collect()) == list(range(1000))
    from quillstrand.operators import ranges

    tables = []
    plain = ranges.stash
    ranges.stash = lambda d, name: tables.append(plain(d, name)) or tables[-1]
    try:
        before_row(df, "g", [F.col("k")], {"n": ("sum", F.lit(1))})
    finally:
        ranges.stash = plain
    sizes = [r["count"] for r in tables[0].groupBy("part").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 600


def areas(rows):
    """AUROC by all pairs, average precision by every different score."""
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    roc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap = 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        above = [y for s, y in rows if s >= t]
        ap += sum(1 for s, y in rows if s == t and y) / len(pos) * sum(above) / len(above) if pos else 0
    return roc, ap


def test_ranking_equals_all_pairs(many_ranges):
    r = random.Random(2)
    rows = [(c, round(r.random(), 2), int(r.random() < 0.1 * c)) for c in range(5) for _ in range(150)]
    df = many_ranges.createDataFrame(rows, "class int, score double, positive int")
    roc, ap = ({x[0]: x[1] for x in f(df).collect()} for f in (metrics.auroc, metrics.auprc))
    for c in range(5):
        a, b = areas([(s, y) for k, s, y in rows if k == c])
        assert (roc[c] is None and a is None) or math.isclose(roc[c], a)
        assert math.isclose(ap[c], b)
    (both,) = metrics.ranking(df).collect()
    assert both.auc_macro_ovr is None and math.isclose(both.auprc_macro, sum(ap.values()) / 5)


def test_binary_ranking(many_ranges):
    r = random.Random(3)
    rows = [(r.random() < 0.3, round(r.random(), 1)) for _ in range(300)]
    df = many_ranges.createDataFrame([*rows, (None, 0.5), (True, None)], "label boolean, score double")
    (got,) = metrics.binary_ranking(df).collect()
    a, b = areas(list(map(lambda x: (x[1], x[0]), rows)))
    assert math.isclose(got.auroc, a) and math.isclose(got.auprc, b)
    assert tuple(metrics.binary_ranking(df.where("label")).first()) == (None, 1.0)
    assert tuple(metrics.binary_ranking(df.where("not label")).first()) == (None, 0.0)
    assert tuple(metrics.binary_ranking(df.limit(0)).first()) == (None, None)


def stops(log, delta, patience):
    """The reference loop over one run's (epoch, metric)."""
    best, at, bad = -1.0, -1, 0
    for e, m in log:
        if m is not None and not math.isnan(m) and m > best + delta:
            best, at, bad = m, e, 0
        else:
            bad += 1
        if bad >= patience:
            return best, at, e
    return best, at, None


@pytest.mark.parametrize(("delta", "patience"), [(0.0, 3), (0.05, 3), (0.2, 10), (0.0, 1), (0.01, 1000)])
def test_early_stop_equals_the_loop(many_ranges, delta, patience):
    r = random.Random(patience)
    value = lambda k: r.choice([None, math.nan, r.random(), r.random() + k / 100, -5.0, math.inf if k > 290 else 0.3])
    runs = {None: 20, "one": 1, "long": 300, "short": 7, "rising": 100}
    rows = [(g, k * 2, k / 100 if g == "rising" else value(k), 0) for g, n in runs.items() for k in range(n)]
    rows += [("nothing", k, r.choice([None, math.nan, -3.0]), 0) for k in range(8)]
    want = {g: stops([(e, m) for h, e, m, _ in rows if h == g], delta, patience) for g in [*runs, "nothing"]}
    r.shuffle(rows)
    df = many_ranges.createDataFrame(rows, "run string, epoch int, m double, top int").repartition(3)
    got = {x[0]: tuple(x)[1:] for x in metrics.early_stop(df, "run", "epoch", "m", delta, patience).collect()}
    assert got == want


def test_early_stop_cases_of_the_review(spark):
    df = spark.createDataFrame([(0, 0.1), (1, math.nan), (2, 0.9)], "e int, m double").withColumn("run", F.lit(7))
    assert tuple(metrics.early_stop(df, "run", "e", "m").first()) == (7, 0.9, 2, None)
    df = spark.createDataFrame([(0, 0.5), *[(k, None) for k in range(1, 6)]], "e int, m double").withColumn("run", F.lit(7))
    assert tuple(metrics.early_stop(df, "run", "e", "m", patience=3).first()) == (7, 0.5, 0, 3)
    assert metrics.early_stop(df.limit(0), "run", "e", "m").collect() == []
    with pytest.raises(ValueError):
        metrics.early_stop(df, "run", "e", "m", min_delta=-1)

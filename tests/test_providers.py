import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstrand.operators import providers
from quillstrand.plans import likelihood


@pytest.fixture()
def rows(spark):
    data = [(1, "ACGT"), (2, "AAAA"), (3, None), (4, "ACNT"), (5, "CC"), (6, "TTTA"), (7, "")]
    return spark.createDataFrame(data, "id long, seq string").coalesce(1)


def test_one_batch_of_three_fails(rows):
    got = [tuple(r)[2:] for r in providers.run(rows.limit(6), "strict_length", "seq", batch=2).collect()]
    assert got[:2] == [(4, 0.25, None), (4, 1.0, None)]
    assert got[2][0] is None and math.isnan(got[2][1]) and got[2][2] == got[3][2] == "not in ACGT: N"
    assert got[4:] == [(2, 0.0, None), (4, 0.25, None)]


def test_columns_pass_and_nulls_count_as_empty(rows):
    wide = rows.select(F.array("id").alias("list"), "seq", F.lit(None).cast("timestamp").alias("at"), F.when(F.col("id") > 4, F.col("id")).alias("some"))
    got = providers.run(wide, "gc_share", "seq").collect()
    assert [(r["list"], r["some"]) for r in got] == [([k], k if k > 4 else None) for k in range(1, 8)]
    assert math.isnan(got[2]["score"]) and got[2]["error"] is None and got[4]["score"] == 1.0
    assert providers.run(wide.limit(0), "gc_share", "seq").collect() == []


def test_wrong_providers(rows):
    with pytest.raises(ValueError, match="unknown provider"):
        providers.run(rows, "nothing", "seq")
    with pytest.raises(ValueError, match="already"):
        providers.run(rows.withColumn("Score", F.lit(1)), "gc_share", "seq")
    with pytest.raises(Exception, match="letters is broken"):
        providers.run(rows, "broken_setup", "seq").collect()
    with pytest.raises(Exception, match="in place of"):
        providers.run(rows, "other_columns", "seq").collect()
    told = providers.run(rows, "short", "seq", batch=3).collect()
    assert [r["error"] for r in told] == ["2 rows for 3 texts"] * 6 + [None]
    assert {len(r["error"]) for r in providers.run(rows, "long_error", "seq").collect()} == {200}


@providers.provider("broken_setup", "x double")
def broken_setup():
    raise RuntimeError("letters is broken")


@providers.provider("other_columns", "x double")
def other_columns():
    return lambda texts: pd.DataFrame({"y": [0.0] * len(texts)})


@providers.provider("short", "x double")
def short():
    return lambda texts: pd.DataFrame({"x": [0.0] * (len(texts) - (len(texts) > 1))})


@providers.provider("long_error", "x double, v array<float>")
def long_error():
    def score(texts):
        if texts:
            raise ValueError("e" * 999)
        return pd.DataFrame({"x": [], "v": []})

    return score


@pytest.mark.parametrize("order", [0, 2])
def test_markov_provider_equals_the_plan(spark, order):
    rows = spark.createDataFrame([(k, ("ACGT" * 60)[k : 120 + 7 * k]) for k in range(20)], "id long, seq string")
    counts = likelihood.markov_counts(rows, "seq", order)
    want = {r["id"]: (round(r["avg_nll_token"], 9), r["token_count"]) for r in likelihood.markov_scores(rows, counts, "id", "seq", order, after=50).collect()}
    out = providers.run(rows, "markov", "seq", options=providers.fitted_markov(counts, order, after=50))
    assert {r["id"]: (round(r["avg_nll_token"], 9), r["token_count"]) for r in out.where("token_count > 0").collect()} == want
    with pytest.raises(ValueError, match="over 3 rows"):
        providers.fitted_markov(counts, order, most=3)


def test_setup_runs_once_for_each_worker(spark, tmp_path):
    @providers.provider("counted", "x long")
    def counted(path):
        with open(path, "a") as f:
            f.write("x")
        return lambda texts: pd.DataFrame({"x": [len(t) for t in texts]})

    rows = spark.range(1000).select(F.lit("abc").alias("seq")).coalesce(1)
    for _ in range(2):
        assert providers.run(rows, "counted", "seq", batch=10, options={"path": str(tmp_path / "n")}).agg(F.sum("x")).first()[0] == 3000
    assert len((tmp_path / "n").read_text()) <= 4  # workers that Spark holds ready, whatever the number of batches


def test_a_worker_does_not_grow_with_its_task(spark):
    """64 MB of texts in one task take little more memory of the worker than 1 MB; whole batches of Spark's own size don't."""

    @providers.provider("resident", "x long")
    def resident():
        def score(texts):
            with open("/proc/self/statm") as f:
                return pd.DataFrame({"x": [int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20] * len(texts)}, dtype="int64")

        return score

    def most(n):
        rows = spark.range(0, n, 1, 1).select("id", F.repeat(F.lit("ACGT"), 25_000).alias("seq"))
        return providers.run(rows, "resident", "seq").agg(F.max("x")).first()[0]

    few = most(10)
    assert most(640) - few < 50

"""Spectra, letter counts and decoding that stay inside the row, against the plain functions."""

import random
from collections import Counter

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrand import catalogue
from quillstrand.functions import letters, spectra
from quillstrand.functions import sequence as sq
from quillstrand.operators import metrics, providers
from quillstrand.plans import completion, likelihood
from quillstrand.shared import BATCH

R = random.Random(5)
TEXTS = ["", "A", "ACGTACGT", "ACGNNACG" * 9, "aé漢🙂" * 40 + "acg", None, "".join(R.choice("ACGT \n") for _ in range(3000)), "漢" * 20]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recoded_equals_encoding_and_decoding(spark, texts):
    vocabulary = {"A": 7, "C": 8, "G": 9, "T": 10}
    ids = sq.encode_tokens(sq.char_tokens("t"), vocabulary, 6, end=1)
    want = texts.where("t is not null").select("id", ids.alias("ids")).select("id", F.size("ids"), sq.decode_tokens(F.col("ids"), {v: k for k, v in vocabulary.items()}, [1, 6]))
    got = texts.select("id", letters.recoded("t", vocabulary, 6, 1).alias("r")).select("id", "r.n_ids", "r.decoded").collect()
    assert {tuple(r) for r in got if r[0] != 5} == {tuple(r) for r in want.collect()}
    assert tuple(got[5]) == (5, None, None)
    part = pa.array(["xx", "AC", None, "é漢G"]).slice(1)
    ids, at = letters.letter_ids(part, vocabulary, 6, 1)
    assert ids.tolist() == [7, 8, 1, 1, 6, 6, 9, 1] and at.tolist() == [0, 3, 4, 8]


@pytest.mark.parametrize("k", [0, 1, 3, 16])
def test_spectra_stay_in_the_row(texts, k):
    found = metrics.kmer_spectrum(texts, "id", "t", F.lit(k))
    assert "Exchange" not in plan_of(found)
    want = set()
    for i, t in enumerate(TEXTS):
        words = Counter(w for w in ((t or "")[j : j + k] for j in range(len(t or "") - k + 1)) if k and set(w) <= set("ACGT"))
        want |= {(i, k, n, f / 4.0**k) for n, f in Counter(words.values()).items()} | {(i, k, 0, 1 - len(words) / 4.0**k)}
    assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("order", [0, 2])
def test_letters_are_counted_in_the_row(texts, order):
    found = likelihood.markov_counts(texts, "t", order)
    want = Counter(t[j : j + order + 1] for t in TEXTS if t for j in range(len(t) - order))
    assert {r["context"] + r["letter"]: r["n"] for r in found.collect()} == want
    spread = likelihood.markov_scores(texts, found, "id", "t", order, after=3)
    assert "count(1)" not in plan_of(spread)  # no letter is a row of its own


def test_providers_get_small_batches(spark):
    own = spark.conf.get(BATCH)
    try:
        spark.conf.unset(BATCH)
        providers.run(spark.range(1).select(F.lit("A").alias("seq")), "gc_share", "seq")
        assert spark.conf.get(BATCH) == "8m"
    finally:
        spark.conf.set(BATCH, own)


def test_masked_equals_the_plain_functions(texts):
    table = {"a": "A", "C": "G", " ": "_"}
    plain = F.regexp_replace(F.translate("t", "".join(table), "".join(table.values())), "[^ -~]", "#")
    got = texts.select("id", letters.masked("t", table).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and {r["id"] for r in got if r["got"] is None} == {5}
    assert not texts.limit(0).select(letters.masked("t", table)).collect()


def test_pairs_go_to_python_once(spark, texts):
    both = texts.crossJoin(texts.select(F.col("t").alias("m")))
    found = completion.with_metrics(both, "t", "m")
    assert plan_of(found).count("ArrowEvalPython") == 1
    for r in found.collect():
        same = [x == y for x, y in zip(r["t"] or "", r["m"] or "")]
        if r["t"] and r["m"] and len(r["t"]) <= len(r["m"]):
            assert r["exact_match_acc"] == sum(same) / len(r["t"])


@pytest.mark.parametrize("t, m", [("", "A"), ("ACGNACGTACGTACGTACGTACGT", "AC" * 90), ("AC" * 600, "GT" * 90), ("漢a", "Aé")])
def test_pair_k_equals_the_column(spark, t, m):
    column = spark.createDataFrame([(t, m)], "t string, m string").select(metrics.pair_k(F.col("t"), F.col("m"))).first()[0]
    assert spectra.pair_k(t, m) == column


def test_tasks_of_pairs_are_not_merged(spark, tmp_path):
    """Pairs of few bytes stay in as many tasks as their time asks for."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.queries()["edit_distance"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("k, sorts", [(3, 0), (13, 1)])
def test_few_types_are_counted_without_a_sort(monkeypatch, k, sorts):
    calls, plain = [], np.sort
    monkeypatch.setattr(np, "sort", lambda *a, **b: calls.append(1) or plain(*a, **b))
    text = "ACGTTGCAACNGGTAC" * 30 + "ACGTAGG"
    times, shares = spectra.spectrum(text, k)
    seen = Counter(w for w in (text[j : j + k] for j in range(len(text) - k + 1)) if "N" not in w)
    want = Counter(seen.values()) + Counter({0: 4**k - len(seen)})
    assert dict(zip(times.tolist(), shares.tolist())) == pytest.approx({n: c / 4**k for n, c in want.items()})
    assert len(calls) == sorts

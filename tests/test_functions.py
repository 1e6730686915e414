"""Literal values worked out by hand from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from quillstrand.functions import scores as sc
from quillstrand.functions import sequence as sq
from quillstrand.operators import metrics, relations


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_prompt_length(spark):
    cases = [(0, -1, 0), (1, -1, 0), (2, -1, 1), (5, -1, 2), (100, 129, 99), (200, 129, 129), (10, 0, 1)]
    got = values(spark, [c[:2] for c in cases], "n int, w int", sc.prompt_length(F.col("n"), F.col("w")))
    assert [g[0] for g in got] == [c[2] for c in cases]


def test_window_starts(spark):
    cases = {0: [], 3: [0], 4: [0], 5: [0, 1], 8: [0, 4], 10: [0, 4, 6]}
    got = values(spark, [(n,) for n in cases], "n int", sc.window_starts(F.col("n"), 4))
    assert [g[0] for g in got] == list(cases.values())


def test_coding_region(spark):
    cases = {"ATGTAA": True, "TAA": True, "TAATAA": False, "ATGTA": False, "NNNTGA": True, "atgtag": True, "": False}
    got = values(spark, [(s,) for s in cases], "s string", sq.is_coding_region("s"))
    assert [g[0] for g in got] == list(cases.values())


def test_bits_per_base(spark):
    rows = [(1.2, 900, 1024), (1.2, 200, 1024), (1.2, 1023, 1024), (1.2, 100, 129), (1.2, 10, 128), (float("nan"), 10, 999)]
    got = [g[0] for g in values(spark, rows, "a double, t long, c int", sc.bits_per_base(F.col("a"), F.col("t"), chars=F.col("c")))]
    assert got[:4] == pytest.approx([1.73896277, 1.73123405, 1.97662102, 173.123405], abs=1e-6)
    assert math.isnan(got[4]) and math.isnan(got[5])
    got = values(spark, [(1.1522243023, 512, 512)], "a double, t long, c long", sc.bits_per_base(F.col("a"), F.col("t"), char_count=F.col("c")))
    assert got[0][0] == pytest.approx(1.662308286919956)


def test_similarity(spark):
    a = "ACGT" * 6
    b = a[:11] + "A" + a[12:]
    got = values(spark, [(a, b)], "a string, b string", sc.exact_match(F.col("a"), F.col("b")), sc.edit_distance(F.col("a"), F.col("b")), sc.alignment_score("a", "b"))
    assert got[0] == pytest.approx((23 / 24, 1 / 24, 22 / 24))


@pytest.mark.parametrize("a, b, k, ks, jsd, emd", [("ACGT" * 6, "ACGTACGTACGAACGTACGTACGT", 2, 0.125, 0.10239319919, 0.25), ("AAAA", "acgt", 1, 0.25, 0.13792538, 1.0)])
def test_spectrum(spark, a, b, k, ks, jsd, emd):
    df = spark.createDataFrame([(1, a, b)], "id int, t string, m string").withColumn("k", metrics.pair_k(F.col("t"), F.col("m")))
    p, q = (metrics.kmer_spectrum(df, "id", c, F.col("k")) for c in "tm")
    got = metrics.spectrum_distances(p, q, "id").first()
    assert df.first()["k"] == k
    assert (got["kmer_ks"], got["kmer_jsd"], got["kmer_emd"]) == pytest.approx((ks, jsd, emd), abs=1e-7)


def test_reverse_complement_twice(spark):
    got = values(spark, [("ACGTNacgtn",), ("",), (None,)], "s string", sq.reverse_complement(sq.reverse_complement("s")))
    assert got == [("ACGTNacgtn",), ("",), (None,)]


def test_auto_k_thresholds():
    assert sq.K_THRESHOLDS[:5] == [20, 142, 1024, 7420, 53762]


def test_windows_cover(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 7, 8, 9, 23)], "id int, sequence string")
    got = {}
    for r in relations.expand_windows(df, 8).collect():
        got.setdefault(r["id"], set()).update(range(r["window_start"], r["window_start"] + len(r["window"])))
    assert got == {n: set(range(n)) for n in (1, 7, 8, 9, 23)}


def test_lenient_and_strict_readers(spark, tmp_path):
    from quillstrand.sources import readers

    p = tmp_path / "short_sequences.jsonl"
    p.write_text('{"taxid": 1, "sequences": ["AC", "", "G"]}\n\nnot json\n{"taxid": 2, "sequences": []}\n{"sequences": ["A"]}\n')
    got = sorted(tuple(r) for r in readers.read_bucket(spark, str(p)).collect())
    assert got == [(1, 0, "AC"), (1, 2, "G")]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(p), readers.SEQUENCE_LIST).collect()
    with pytest.raises(ValueError):
        readers.dataset_dir("/d", "DNA-host-other")


def test_unique_right_side(spark):
    left, right = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(None, "n"), (1, "a")], "k int, v string")
    assert sorted(r["v"] for r in relations.attach_many_to_one(left, right, "k").collect()) == ["a", "n"]
    with pytest.raises(ValueError):
        relations.attach_many_to_one(left, right.union(right), "k")


@pytest.mark.parametrize("order", [0, 2])
def test_markov(spark, order):
    from quillstrand.plans import likelihood

    texts = {1: "ACGTACGTTTGACA", 2: "GG\nAC🙂AC🙂A", 3: "", 4: "AC", 5: "TTTTTTTTT"}
    df = spark.createDataFrame(list(texts.items()), "id long, s string")
    counts = likelihood.markov_counts(df, "s", order)
    seen = {}
    for t in texts.values():
        for i in range(order, len(t)):
            seen[t[i - order : i], t[i]] = seen.get((t[i - order : i], t[i]), 0) + 1
    assert {(r["context"], r["letter"]): r["n"] for r in counts.collect()} == seen
    total = {c: sum(n for (d, _), n in seen.items() if d == c) for c, _ in seen}
    got = {r["id"]: (r["avg_nll_token"], r["token_count"]) for r in likelihood.markov_scores(df, counts, "id", "s", order, after=3).collect()}
    for k, t in texts.items():
        nll = [-math.log((seen[t[i - order : i], t[i]] + 1) / (total[t[i - order : i]] + 256)) for i in range(3, len(t))]
        assert (k in got) == bool(nll) and (not nll or got[k] == (pytest.approx(sum(nll) / len(nll)), len(nll)))


def test_binary_metrics_without_positives(spark):
    got = metrics.binary(spark.createDataFrame([(False, False), (False, False)], "label boolean, pred boolean")).first()
    assert tuple(got) == (1.0, 0.0, 0.0, 0.0, 0.0)
    assert metrics.confusion_filled(spark.createDataFrame([], "label int, pred int")).count() == 0

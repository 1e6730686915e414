"""The queries that SQL can't express, against plain versions of what they promise; their models and fields by themselves."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstrand.llm import bpe, pii, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, texts):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op2_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {k: (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for k, t in texts.items() for ids in [enc.encode_ordinary(t)]}
    assert got == want


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_op7(spark, texts):
    encode, start, want = library("word_bpe_49k.json"), 0, {}
    for k in sorted(texts):
        ids = [*encode(texts[k]), 1]
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:4] for r in queries.op7_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_op10(spark, texts):
    encode = library("byte_bpe_50k.json")
    ids = {k: [*encode(t), 1] for k, t in texts.items()}
    pieces, full = {}, {}
    for r in queries.op10_packing(spark, SF).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == crc(part) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["length"]))
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for k, own in pieces.items():
        assert [a for a, _ in sorted(own)] == [0, *[b for _, b in sorted(own)][:-1]] and max(own)[1] == len(ids[k])
    assert pieces.keys() == ids.keys()
    for own in full.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(own)) and own[-1][1] <= 2048


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(text):
    """The contract's patterns, one after another."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_op9(spark, texts):
    for r in queries.op9_pii(spark, SF).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(pii._written(want).encode())
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == kind for _, k, _ in want) for kind in range(4))
        assert set(pii._written(want).split(",")) - {""} <= set(r["spans"].split(","))


@pytest.mark.parametrize("signs", ["0123456789 .-", "01.", "+1 ()-.5", "a1@.-%_+ ", "4 -", "é9+@. 0"])
def test_patterns_on_random_texts(signs):
    r = random.Random(signs)
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text)


def test_messages_equal_exact_inference():
    """On trees, where messages are exact, and on small graphs with a loop: the likeliest label of each node."""
    r = np.random.default_rng(8)
    for trial in range(150):
        n = int(r.integers(2, 6))
        edges = [(int(r.integers(0, k)), k) for k in range(1, n)] + ([(0, n - 1)] if trial % 3 == 0 and n > 3 else [])
        edges = list(dict.fromkeys(edges))
        gains = r.choice([0.0, pii.CHAIN, pii.NEAR, pii.SKIP], len(edges))
        local = r.choice([0.0, pii.BIAS, -pii.SHAPE], (n, 5)) + r.normal(size=(n, 5))
        marginal = np.zeros((n, 5))
        for labels in itertools.product(range(5), repeat=n):
            weight = np.exp(sum(local[k, x] for k, x in enumerate(labels)) + sum(g for (a, b), g in zip(edges, gains) if labels[a] == labels[b]))
            for k, x in enumerate(labels):
                marginal[k, x] += weight
        got = pii._propagate(local, np.array(edges), np.array(gains))
        marginal /= marginal.sum(1, keepdims=True)
        clear = np.sort(marginal, 1)[:, -1] - np.sort(marginal, 1)[:, -2] > 0.1
        assert (got[clear] == marginal.argmax(1)[clear]).all()


def test_field_adds_repeated_and_similar_numbers(spark):
    found = lambda t: [t[s:e] for s, _, e in sorted(set(pii.all_spans(t)[1]) - set(pii.all_spans(t)[0]))]
    assert found("call +49 170 1234567 or 49-170-1234567 now") == ["49-170-1234567"]
    assert found("call +49 170 1234567 or 0170 1234567 now") == ["0170 1234567"]
    assert found("call +49 170 1234567, later 0170 7654321") == []
    assert found("0170 1234567 alone, and 4111 1111 1111 1111") == []
    many = "+49 170 1234567 " + "x 0170 1234567, y 12345 z " * 400
    assert found(many) == ["0170 1234567"] * 400
    assert found("+49 170 1234567 " + "x 49-170-1234567 y " * 50) == ["49-170-1234567"] * 50
    rows = [(None, None, 1), (1, "", 1), (2, "a@b.cd", 1), (2, "a@b.cd", 1), (None, "a@b.cd", 1), (3, "x " * 50_000 + "a@b.cd", 1)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, base int"))
    assert sorted((str(r["doc_id"]), r["n_email"], r["base"]) for r in got.collect()) == sorted([("None", 0, ""), ("1", 0, ""), *[("2", 1, "email:0:6")] * 2, ("None", 1, "email:0:6"), ("3", 1, "email:100000:100006")])


def test_op5_learns_from_its_own_rows_and_tells_held_out_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, SF).collect()}
    assert len(got) == docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and labels.get(k) in (0, 1):
            right.append(r["predicted"] == labels[k])
    assert len(right) > 10 and np.mean(right) > 0.8
    # Labels of held-out rows don't reach the model.
    model = queries.train_quality(spark, SF)
    again = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert all(again[k] == r["score"] for k, r in got.items())


def test_dual_descent_meets_the_conditions_of_the_optimum(monkeypatch):
    """Each dual variable is at a bound or its gradient is zero; the primal and dual values meet."""
    monkeypatch.setattr(quality, "EPOCHS", 3000)
    monkeypatch.setattr(quality, "TOLERANCE", 1e-9)
    r = np.random.default_rng(9)
    rows = [np.unique(r.integers(0, 30, r.integers(1, 12))) for _ in range(60)]
    y = np.where([x.mean() + r.normal() > 14 for x in rows], 1.0, -1.0)
    scale = r.normal(size=30)
    w = quality.dual_descent(rows, y, scale)
    values = [scale[x] / np.sqrt((scale[x] ** 2).sum()) for x in rows]
    bound = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    margins = np.array([y[k] * (w[x] @ v + w[-1]) for k, (x, v) in enumerate(zip(rows, values))])
    primal = 0.5 * w @ w + (bound * np.maximum(0, 1 - margins)).sum()
    for _ in range(300):  # no small change of the weights is better
        other = w + r.normal(size=len(w)) * 10 ** r.uniform(-4, 0)
        m = np.array([y[k] * (other[x] @ v + other[-1]) for k, (x, v) in enumerate(zip(rows, values))])
        assert 0.5 * other @ other + (bound * np.maximum(0, 1 - m)).sum() >= primal - 1e-6


def test_quality_edge_cases(spark):
    rows = [(k, "good words here" if k % 2 else "bad !!! zzz", k % 2, "x", 0.0) for k in range(40)] + [(None, "good words here", 1, "x", 0.0)] * 3 + [(99, "long " * 60_000, 1, "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, score string, share double")
    model = quality.fit(df)
    got = quality.scored(df.withColumnRenamed("score", "kept"), model).collect()
    assert len(got) == len(rows) and {r["kept"] for r in got} == {"x"}
    assert len({r["score"] for r in got if r["text"] == "good words here"}) == 1
    assert quality.fit(df.where("label = 0")) == {"share": 0.0} and quality.fit(df.where("label = 1")) == {"share": 1.0}
    assert quality.scored(df.limit(0), model).collect() == []
    assert [r["score"] for r in quality.scored(df.where("doc_id = 1"), {"share": 0.25}).collect()] == [0.25]
    assert quality.fit(df.withColumn("label", F.lit(7))) == {"share": 0.5}

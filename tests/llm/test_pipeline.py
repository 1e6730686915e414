"""The pipeline on a small corpus against brute force: nulls, copies, clashing columns, an empty table."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from quillstrand.llm import packing
from quillstrand.shared import stash

GOOD = "the cat sat on a mat and looked at all of us while we were not there again".split()


def text(k):
    rnd = random.Random(k)
    return " ".join(rnd.choice(GOOD) for _ in range(60))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(k, text(k), "en", "s", k, k) for k in range(80)]
    rows += [(k, " ".join(w + "%%% !!" for w in text(k).split()), "en", "s", 0, 0) for k in range(100, 150)]
    near = text(3).split()
    near[40] = "dog"
    rows += [(200, text(5).upper(), "en", "s", 0, 0), (201, text(5), None, None, None, None), (202, " ".join(near), "en", "s", 0, 0), (203, text(7) + " mail a.b@c.de", "en", "s", 0, 0), (204, None, "en", "s", 0, 0), (None, text(81), "en", "s", 0, 0)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, shard long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k in [*range(80), *range(100, 150)]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, corpus), "test-stage")
        seen.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    quality, exact, similar, redacted, pieces = seen
    ids = {r["doc_id"] for r in quality}
    assert not ids & set(range(100, 150)) and set(range(80)) <= ids
    lows = {}
    for r in sorted(quality, key=lambda r: (r["doc_id"] is None, r["doc_id"])):
        lows.setdefault((r["text"] or "").lower(), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(lows.values()) and len(exact) == len(lows)
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in exact}
    root = {k: k for k in sets if k is not None}
    for _ in root:
        for a in root:
            for b in root:
                if (both := len(sets[a] & sets[b])) and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in similar} == {k for k, r in root.items() if k == r} | ({None} & set(sets))
    assert 202 not in {r["doc_id"] for r in similar}
    assert len(redacted) == len(similar) and not any("@" in (r["text"] or "") for r in redacted)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert sum(r["length"] for r in pieces) == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in redacted)


def test_empty(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def least_cost(cuts, penalties):
    """The least cost of cutting at some of cuts, by trying all predecessors; windows cost as the module says."""
    cost = [0.0] + [None] * (len(cuts) - 1)
    for j in range(1, len(cuts)):
        sizes = [(i, cuts[j] - cuts[i]) for i in range(j) if cuts[j] - cuts[i] <= packing.LENGTH]
        cost[j] = min(cost[i] + (0 if n in packing.POWERS else packing.LENGTH - n) for i, n in sizes) + penalties[j] + 1e-3
    return cost[-1]


def test_windows_are_cheapest():
    rnd = random.Random(2)
    for _ in range(60):
        steps = [rnd.choice((1, 64, 128, 256, 500, 700, rnd.randint(1, 2000))) for _ in range(rnd.randint(1, 60))]
        cuts = [0]
        for s in steps:
            cuts.append(cuts[-1] + s)
        penalties = [0] + [rnd.choice((0, 1, 12)) for _ in steps]
        back, j, got = packing.plan_windows(cuts, penalties), len(cuts) - 1, 0.0
        while j:
            n = cuts[j] - cuts[back[j]]
            assert 0 < n <= packing.LENGTH
            got += (0 if n in packing.POWERS else packing.LENGTH - n) + penalties[j] + 1e-3
            j = back[j]
        assert got == pytest.approx(least_cost(cuts, penalties))

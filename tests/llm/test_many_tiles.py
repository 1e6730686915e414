"""Vectors and documents over several tiles, and components, against brute force."""

import collections
import random

import numpy as np
import pytest

from quillstrand.llm import components, embedding_dedup, jaccard_join


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("tile, broadcast", [(40, True), (7, False)])
def test_vectors_in_many_tiles(spark, monkeypatch, tile, broadcast):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "MOST_CELLS", 10000 if broadcast else 0)
    rng = np.random.default_rng(tile)
    base = rng.normal(size=(12, 12))
    x = np.concatenate([base[rng.integers(0, 12, 500)] + 0.22 * rng.normal(size=(500, 12)), base[:2], base[:2]]).astype(np.float32)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, tile int")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert link.sum() > 2000
    root = roots(len(u), zip(*np.nonzero(link)))
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in range(len(u))] == [(int(link[k].sum()), root[k]) for k in range(len(u))]


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 700 + k) for k in range(150)]
    want = roots(1000, pairs)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    rows = pairs + [(None, 3), (4, None), (7, 7), pairs[0]]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: want[x] for x in nodes}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_in_many_tiles(spark, monkeypatch):
    """Edited copies on both sides of the threshold, several parts a band, few links found by central sets alone."""
    monkeypatch.setattr(jaccard_join, "TILE", 5)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(6):
        own = [rnd.choice(words) for _ in range(rnd.choice((60, 80, 107, 150)))]
        for _ in range(25):
            t = list(own)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(" ".join(t[rnd.randint(0, 6) : len(t) - rnd.randint(0, 6)]))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    near = sum(60 * len(a | b) <= 100 * len(a & b) < 75 * len(a | b) for a in sets for b in sets)
    assert len(pairs) > 100 and near > 100
    want = roots(len(texts), pairs)
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], "doc_id long, text string, rep int, comp int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(docs).collect()}
    assert got == {k: (len(s), want[k]) for k, s in enumerate(sets)}
    assert collections.Counter(r["doc_id"] for r in jaccard_join.drop_similar(docs).collect()) == collections.Counter(set(want))

"""Brute force, exact round trips and edge cases: nulls, empty and long texts, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstrand.llm import bpe, embedding_dedup, exact_dedup, jaccard_join, line_dedup, packing, pii, quality, sharding, token_store

WORDS = "the cat sat on a mat and looked at all of us while we were not there again".split()
BASE = " ".join(WORDS * 3)
TEXTS = [BASE, BASE.upper(), BASE.replace("mat", "hat", 1), None, "", "   \n", "one two", "ONE two", "x" * 3000, "it's  é\tü. 漢字🙂 <|endoftext|>", " ".join(WORDS * 400)]
ROWS = [(k, t, "s" if k % 2 else None, "extra") for k, t in enumerate(TEXTS)] + [(0, BASE, "s", "extra"), (None, BASE, "s", "extra")]
SCHEMA = "doc_id long, text string, source string, n string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, empty):
    groups = collections.defaultdict(list)
    for k, t, *_ in ROWS:
        groups[(t or "").translate(LOW)].append(k)
    want = sorted(((k, max(x for x in g if x is not None), len(g)) for t, g in groups.items() for k in g), key=str)
    got = exact_dedup.exact_groups(docs, keep="max").collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want
    assert all(r["text_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in groups} for r in got)
    assert exact_dedup.drop_copies(docs).count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_similar_documents(docs, empty):
    sets = {k: shingles(t) for k, t, *_ in ROWS if k is not None}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard_join.similar_documents(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(k, len(s), root[k]) for k, s in sets.items()}
    assert jaccard_join.similar_documents(empty).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.normal(size=(20, 16)), base[:3]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] * 16), (104, [None] * 16), (None, x[0].tolist())]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    for _ in range(len(u)):
        root = np.minimum(root, np.where(link, root[None, :], len(u)).min(1))
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in range(len(u))] == [(int(link[k].sum()), int(root[k])) for k in range(len(u))]
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(100, 105))
    assert len(got) == len(rows)


def test_bpe_round_trip(spark, docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    more = ["ab" * 1000 + " x", "the cat's  \n\n 12 345 <|endoftext|>\x00\u2028é" * 900, "漢字" * 300, " ", "a\r\nb", "'S's", "\U0001f600\u200d" * 40]
    rows = ROWS + [(100 + k, t, "s", "extra") for k, t in enumerate(more)]
    out, coder = bpe.encoded(spark.createDataFrame(rows, SCHEMA), path, public_tokenizers.PATTERN)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"]), bytes(r["back"])) for r in out.withColumn("back", coder.decode(F.col("ids"))).collect())
    want = sorted((k is not None, k or 0, ref.encode_ordinary(t or ""), (t or "").encode()) for k, t, *_ in rows)
    assert got == want
    assert bpe.encoded(empty, path, public_tokenizers.PATTERN)[0].count() == 0


def test_bpe_without_frequent_words(spark, docs, monkeypatch):
    """Every word is folded in its text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = {r["doc_id"]: list(r["ids"]) for r in bpe.encoded(docs, path, public_tokenizers.PATTERN)[0].collect()}
    monkeypatch.setattr(bpe, "FREQUENT", 0)
    assert {r["doc_id"]: list(r["ids"]) for r in bpe.encoded(docs, path, public_tokenizers.PATTERN)[0].collect()} == want


def test_rank_map():
    rnd = np.random.default_rng(5)
    pairs = {int(a): int(b) for a, b in zip(rnd.integers(0, 2**31, 3000), rnd.integers(0, 50000, 3000))}
    table, seeds = bpe.place_pairs(pairs)
    at = lambda p: table[(p + seeds[p % bpe.BUCKETS] * (p % bpe.STRIDE + 1)) % len(table)]
    assert all(at(p) == p * bpe.ID + r for p, r in pairs.items()) and sum(x >= 0 for x in table) == len(pairs)


def encoded(text, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((k for k, *_ in ROWS), key=lambda k: (k is not None, k))
    place = 0
    texts = {k: t for k, t, *_ in ROWS}
    for r in got:
        ids = encoded(texts[r["doc_id"]], "word_bpe_49k.json")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (place, len(ids), crc(ids))
        place += len(ids)
    found = {r["doc_id"]: list(r["ids"]) for r in token_store.lookup(spark, path, [6, 9, 77]).collect()}
    assert found == {k: encoded(TEXTS[k], "word_bpe_49k.json") for k in (6, 9)}
    token_store.write_store(empty, f"{path}-empty", public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read_digests(spark, f"{path}-empty").count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 3000))
    seeds, order = token_store.build_index(keys)
    assert sorted(order.tolist()) == list(range(len(keys)))
    slots = np.empty((len(keys), 2), "<u4")
    slots[:, 0] = (token_store._mix(keys[order], token_store.PRINT) >> np.uint64(32)).astype(np.uint32)
    slots[:, 1] = order
    assert (token_store.find(keys, seeds, slots) == np.arange(len(keys))).all()
    assert (token_store.find(keys + 1, seeds, slots) == -1).mean() > 0.99


def test_packing(docs, empty):
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r["length"] for r in got) == sum(len(encoded(t, "byte_bpe_50k.json")) for _, t, *_ in ROWS)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    long = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 10)
    ids = encoded(TEXTS[10], "byte_bpe_50k.json")
    assert all(c == crc(ids[s : s + n]) for s, n, c in long) and sum(n for _, n, _ in long) == len(ids)
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_quality(spark):
    good = [(k, f"{WORDS[k % 9]} " + BASE, 1) for k in range(120)]
    bad = [(k, " ".join(w + "%%%" for w in WORDS[k % 5 :]), 0) for k in range(120, 200)]
    model = quality.fit(spark.createDataFrame(good + bad, "doc_id long, text string, label int"))
    tests = spark.createDataFrame([(1, BASE + " indeed"), (2, "dog%%% ran%%% off%%% today%%%"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scored(tests, model).collect()}
    assert got[1] > 0.7 > got[2] and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert quality.fit(spark.createDataFrame([], "doc_id long, text string, label int")) == {"share": 0.5}


def test_line_dedup(spark, empty):
    rows = [(k, f"menu\nown {k}\n  menu\n", "h", "x") for k in range(5)] + [(9, None, None, "x")]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), 0.5, 2).collect()}
    assert got[3]["clean_text"] == "own 3\n" and got[3]["n_dropped"] == 2 and got[9]["clean_text"] == ""
    assert line_dedup.drop_boilerplate(empty).count() == 0
    rows = [(1, "menu\r\none\n \r", "h", "x"), (2, "\tmenu\ntwo", "h", "x"), (3, "menu", "other", "x")]
    clean = lambda **o: {r["doc_id"]: r["clean_text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), 0.5, **o).collect()}
    assert clean() == {1: "one\n \r", 2: "two", 3: ""}  # the ratio alone: a host of one page loses its lines
    assert clean(least_pages=2) == {1: "one\n \r", 2: "two", 3: "menu"}


def test_tokens_take_little_memory(spark, docs):
    """Arrays of words are made for a part of a batch at a time, and batches are small."""
    texts = [(BASE * 40).encode()] * 400
    tracemalloc.start()
    sets = jaccard_join.token_sets(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sets) == 400 and sum(map(len, texts)) > 2 << 20 and peak < 24 << 20
    jaccard_join.similar_documents(docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup_either_join(spark, monkeypatch, limit):
    """Boilerplate lines by brute force, broadcast and in salted parts; repeated rows, null hosts and ids, clashing columns."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    rows = [(k % 23 if k % 7 else None, "\n".join(f"line {(k * j) % 19}" for j in range(k % 6)) or None, ("a", "b", None)[k % 3], k) for k in range(150)]
    rows += rows[:5] + [(999, "long line " * 3000 + "\nline 1", "a", 0)]
    pages = collections.defaultdict(list)
    for _, t, h, _ in rows:
        pages[h].append((t or "").split("\n"))
    want = []
    for k, t, h, _ in rows:
        drop = {x for page in pages[h] for x in page if x and sum(x in p for p in pages[h]) >= 3 and sum(x in p for p in pages[h]) > 0.1 * len(pages[h])}
        lines = (t or "").split("\n")
        want.append((str(k), "\n".join(x for x in lines if x not in drop), len(lines), sum(x in drop for x in lines)))
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, boiler long"), 0.1, 3).collect()
    assert sorted((str(r["doc_id"]), r["clean_text"], r["n_lines"], r["n_dropped"]) for r in got) == sorted(want)


def test_line_dedup_shuffles_hashes(spark, monkeypatch):
    """Rare lines aren't shuffled as texts, only frequent ones are; lines that share a hash are told apart."""
    grouped = []
    counted = line_dedup.boilerplate

    def watched(*given):
        out = counted(*given)
        grouped.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(line_dedup, "boilerplate", watched)
    rows = [(k, "\n".join(["menu", *(f"line {k} {j}" for j in range(20))]), "h") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.drop_boilerplate(docs)
    assert "Join LeftSemi" in grouped[0][grouped[0].rindex("Aggregate [host") :]  # below the grouping of texts
    assert sorted(r["n_dropped"] for r in got.collect()) == [1] * 100
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # all lines share one hash
    assert sorted(map(tuple, line_dedup.drop_boilerplate(docs).collect())) == sorted(map(tuple, got.collect()))


def test_clashing_columns(spark, tmp_path):
    rows = [(1, "A b", 5, "x", 7, 8), (2, "a B", 6, "y", 7, 8), (3, "c", None, None, 7, 8), (3, "c", None, None, 7, 8), (None, "d", 1, "z", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_sha long, shard string, number long, kept_id long")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[2], rows[4]]))
    sharding.write_shards(docs, 2, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert "shard_" in back.columns and collections.Counter(map(str, map(tuple, back.select(*docs.columns).collect()))) == collections.Counter(map(str, rows))


def test_sharding(docs, empty):
    got = sharding.shard(docs, 500).collect()
    assert len(got) == len(ROWS)
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["n_bytes"]
    assert all((sizes[r["shard"]] == r["shard_bytes"]) and (r["fits"] == (r["shard_bytes"] <= 500)) for r in got)
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert {r["shard"] for r in sharding.shard(docs, 1 << 30).collect()} == {""}
    assert sharding.shard(empty, 10).count() == 0


def test_personal_data(spark, empty):
    text = "mail a.b@c.de, ip 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111; call +49 151 2345678 or 49 151 2345678."
    assert pii._written(pii.base_spans(text)) == "email:5:13,ip:18:26,card:46:65,phone:72:87"
    base, every = pii.all_spans(text)
    assert set(base) < set(every) and pii._written(every).endswith("phone:91:105")
    assert pii.redact(text) == "mail <email>, ip <ip> or 300.1.1.1; card <card>; call <phone> or <phone>."
    assert pii.all_spans("1" * 20000) == ([], []) and pii.redact(None) is None
    assert pii.find(empty).count() == 0

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from quillstrand.llm import conversation_repair as repair

KINDS = "conv_id long, turn long, role string, text string, conv string, g long"
SPACE = "\t\n\x0b\x0c\r "
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def faults(rows):
    """Each row's first fault, of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits, repaired rows) by best-first search over all edits: none of the operator's layers or ranks."""
    marks = faults(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(made)
        if (i, state) in done:
            continue
        done.add((i, state))
        nxt = {0: "user", 1: "user", 3: "user", 2: "assistant"}[state]
        to = STEPS[nxt[0], state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*made, (nxt, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
            if marks[i] in ("none", "truncated"):
                extra = marks[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, to, (*made, (nxt, text))))
                if (role[:1], state) in STEPS:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, STEPS[role[:1], state], (*made, (role, text))))
    raise AssertionError


def verdict(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of (turn, role, text) rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    pairs = [r[1:] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    marks = faults(pairs)
    cost, audit, made = cheapest(pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, digest


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (fate != 0) * (1 + (fate == 3))
    return out


def got_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], KINDS).repartition(3)
    verdicts, repaired = repair.repair(df)
    texts = {r.conv: r.body for r in repair.repaired_texts(repaired).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha(texts.get(r.conv, ""))) for r in verdicts.collect()}


def by_conversation(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return groups


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "unknown", "", None, "User"], ["Yes.", "No!", "and so", " ", "", None, "what?\n", "one. two", "é…", "ok.\x0b\t"]
    out = []
    for conv in [None, *range(120)]:
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            out.append((conv, r.choice([None, *range(15)]), r.choice(roles), r.choice(texts)))
    out += [(500, k, "user" if k % 2 == 0 else "assistant", f"word {k}.") for k in range(300)]
    out += [(501, 4, "user", "the same.")] * 70
    r.shuffle(out)
    return out


def test_repairs_equal_best_first_search(spark, rows):
    assert got_rows(spark, rows) == {c: verdict(g) for c, g in by_conversation(rows).items()}


def test_conversations_over_several_blocks_and_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 3)
    assert got_rows(spark, rows) == {c: verdict(g) for c, g in by_conversation(rows).items()}


def test_layers_are_shared_along_the_trie(spark):
    """Each different prefix of the sorted signatures gets one layer."""
    import pyarrow as pa

    words = sorted({"".join(random.Random(k).choices("ABCEFGIM", k=k % 9)) for k in range(200)})
    made, plain = [], repair._next_layer
    repair._next_layer = lambda layer, letter: made.append(letter) or plain(layer, letter)
    try:
        list(repair._solve(iter([pa.RecordBatch.from_pydict({"signature": words[:90]}), pa.RecordBatch.from_pydict({"signature": words[90:]})])))
    finally:
        repair._next_layer = plain
    assert len(made) == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_empty_table(spark):
    verdicts, repaired = repair.repair(spark.createDataFrame([], KINDS))
    assert verdicts.collect() == [] and repaired.collect() == []


def test_query_equals_contract(spark, tmp_path, rows):
    from quillstrand.llm.queries import op11_conversation_repair

    spark.createDataFrame([(*r, "x", 0) for r in rows], KINDS).write.parquet(f"{tmp_path}/conversations.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        table = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
        left = by_conversation(damage(table))
        none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        want = {c: verdict(left[c]) if c in left else none for c in by_conversation(table)}
        assert {r[0]: tuple(r)[1:] for r in op11_conversation_repair(spark, sf).collect()} == want


def test_query_leaves_one_table(spark, tmp_path):
    import os

    from quillstrand.llm.queries import op11_conversation_repair

    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    op11_conversation_repair(spark, "/root/testdata/sf0.001")
    (left,) = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))) - before
    assert left.startswith("conversation-repair")

"""Repair of conversations: the cheapest edits that make roles alternate, worked out once per shared prefix of signatures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrand.operators.relations import numbered
from quillstrand.shared import stash

WHITE = "\t\n\x0b\x0c\r "
ROLES, FAULTS = ("s", "u", "a", "other"), ("none", "truncated", "blank", "duplicate")
#: A row's letter: four for the roles of each fault.
LETTERS = "ABCDEFGHIJKLMNOP"
#: Rows of a conversation whose letters are joined in one step.
BLOCK = 1 << 16
#: Costs of edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Where the roles so far stand in (s?(ua)+)?: at the start, after s, after u, after a. ADDED: after one more user or assistant.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ADDED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}
SOLVED = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("at", pa.list_(pa.int32())), ("role", pa.list_(pa.string()))])


def _next_layer(layer: list[tuple | None], letter: str) -> list[tuple | None]:
    """Best way to each place after one more row: (cost, rank, place before, inserts before the row, edit).

    The rank orders the edits of a layer's ways as texts. As all of them hold the same number of rows and end with a row's
    edit, none begins another, so rank, inserts and edit tell the order of longer ones.
    """
    role, fault = ROLES[LETTERS.index(letter) % 4], FAULTS[LETTERS.index(letter) // 4]
    extra = TRUNCATED if fault == "truncated" else 0
    best: list[tuple | None] = [None] * 4
    for place, way in enumerate(layer):
        if way is None:
            continue
        cost, rank = way[0], way[1]
        there = place
        for inserts in range(3):
            ways = [("D", DELETE, there)]
            if fault in ("none", "truncated"):
                ways.append(("R", REROLE + extra, ADDED[there]))
                if (role, there) in KEPT:
                    ways.append(("K", extra, KEPT[role, there]))
            for edit, more, to in ways:
                order = (cost + INSERT * inserts + more, rank, "I" * inserts + edit)
                if best[to] is None or order < best[to][0]:
                    best[to] = (order, place, inserts, edit)
            there = ADDED[there]
    ranks = {b: k for k, b in enumerate(sorted(b[0][1:] for b in best if b))}
    return [b and (b[0][0], ranks[b[0][1:]], b[1], b[2], b[3]) for b in best]


def _answer(layers: list[list[tuple | None]]) -> tuple[int, str]:
    """Cost and edits of the cheapest way through all layers to an end of (s?(ua)+)?."""
    ends = []
    for place, way in enumerate(layers[-1]):
        there = place
        for inserts in range(3) if way else ():
            if there == AFTER_A or there == START:
                ends.append((way[0] + INSERT * inserts, way[1], inserts, place))
            there = ADDED[there]
    cost, _, inserts, place = min(ends)
    edits = ["I" * inserts]
    for layer in reversed(layers[1:]):
        _, _, before, added, edit = layer[place]
        edits.append("I" * added + edit)
        place = before
    return cost, "".join(reversed(edits))


def _rows_after(signature: str, audit: str) -> tuple[list[int], list[str]]:
    """For each row that is left: its number among the old ones (-1: inserted) and its new role ("" where it keeps its own)."""
    at, role, row, place = [], [], 0, START
    for edit in audit:
        if edit == "K":
            place = KEPT[ROLES[LETTERS.index(signature[row]) % 4], place]
        elif edit in "RI":
            place = ADDED[place]
        if edit != "D":
            at.append(-1 if edit == "I" else row)
            role.append("" if edit == "K" else "user" if place == AFTER_U else "assistant")
        row += edit != "I"
    return at, role


def _legal(a: str, b: str) -> bool:
    return ROLES[LETTERS.index(a) % 4] + ROLES[LETTERS.index(b) % 4] in ("su", "ua", "au")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the trie of the sorted signatures: layers holds those of the path from the root, so that a signature adds only the
    layers below the prefix that it shares with the one before. illegal counts along the path, too."""
    start: list[tuple | None] = [(0, 0, -1, 0, ""), None, None, None]
    path, layers, illegal = "", [start], [0]
    for batch in batches:
        out = []
        for signature in batch.column(0).to_pylist():
            shared = 0
            for a, b in zip(path, signature):
                if a != b:
                    break
                shared += 1
            del layers[shared + 1 :], illegal[shared + 1 :]
            for k in range(shared, len(signature)):
                layers.append(_next_layer(layers[-1], signature[k]))
                illegal.append(illegal[-1] + (k > 0 and not _legal(signature[k - 1], signature[k])))
            path = signature
            cost, audit = _answer(layers)
            n = [sum(map(signature.count, LETTERS[4 * f : 4 * f + 4])) for f in range(4)]
            out.append((signature, cost, audit, illegal[-1], n[2], n[3], n[1], *_rows_after(signature, audit)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SOLVED)], schema=SOLVED)


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit, illegal, blank, duplicate, truncated, at, role) of each different signature.

    signatures: one column of texts of LETTERS, repeated rows welcome. They are dealt in order to ranges, and each range is
    walked as a prefix trie. A task holds the layers of one signature.
    """
    name = signatures.columns[0]
    kinds = "signature string, cost long, audit string, illegal long, blank long, duplicate long, truncated long, at array<int>, role array<string>"
    ordered = signatures.select(F.col(name).alias("signature")).distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return ordered.mapInArrow(_solve, kinds)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults planted by crc32 of "conv:turn" modulo 20: 0 drops the row, 1 empties its text, 2
    takes its .!? away, 3 repeats it, 4 makes its role user. Null roles and texts, and nulls in that key, are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    cut = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return cut.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(verdicts, repaired rows) of conversations.

    A conversation's rows are taken by turn, nulls first, then role and text. A row's first fault counts: blank (nothing but
    white space), duplicate (role and text were there before in the conversation), truncated (its last character other than
    white space is none of .!?). Edits: keep a row (K, free), give it the role user or assistant (R), delete it (D; blank and
    duplicate rows must go), insert an empty user or assistant row (I). The cheapest edits lead to roles that begin with
    s, u, a as in (s?(ua)+)?; of equally cheap ones the least in ASCII order is taken.

    verdicts: conv, gaps (turns missing between the first and the last, nulls aside), blank, duplicate, truncated,
    illegal (neighbours whose roles don't follow one another), cost, audit (the edits' letters). Repaired rows: conv,
    position (from 0), role, text.

    Null ids are one conversation. Null roles and texts are one space, so such a row is blank. Repeated rows are duplicates.
    Unknown roles can't be kept. Conversations without rows have no verdict; empty tables give empty results. Other columns
    are ignored.

    Rows are numbered by ranges of (conversation, turn, role, text), so one conversation may spread over many tasks; first
    rows of copies are smallest numbers, summed up in the map tasks and joined back by number, which is unique. Only a
    letter for each row comes together in one value, a conversation's signature, joined first in blocks of BLOCK rows. Hot
    signatures are an ordinary skew join.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    # The last key spreads rows that are equal in all others.
    t = stash(numbered(plain.withColumn("spread", F.rand()), ["conv", "turn", "role", "text", "spread"], "g").drop("spread"), "conversation-rows")

    firsts = t.groupBy("conv", "role", F.md5("text").alias("h")).agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", 2).when(F.col("first").isNull(), 3).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES[:3]]), F.left("role", F.lit(1)))
    letter = F.substring(F.lit(LETTERS), 4 * fault + F.when(role > 0, role.cast("int")).otherwise(4), F.lit(1))
    lettered = t.join(firsts, "g", "left").select("conv", "g", letter.alias("letter"))

    def joined(key: str, part: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, part))), lambda x: x[part]), "")

    blocks = lettered.groupBy("conv", F.floor(F.col("g") / BLOCK).alias("block")).agg(joined("g", "letter").alias("part"), F.min("g").alias("base"))
    signed = stash(blocks.groupBy("conv").agg(joined("block", "part").alias("signature"), F.min("base").alias("base")), "signatures")
    answers = stash(solved(signed.select("signature")), "answers")
    own = signed.join(answers, "signature")

    width = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = t.groupBy("conv").agg(F.coalesce(width, F.lit(0)).cast("long").alias("gaps"))
    verdicts = own.join(gaps.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    left = own.select("conv", "base", F.posexplode(F.arrays_zip("at", F.col("role").alias("new"))).alias("position", "x"))
    left = left.select("conv", "position", (F.col("base") + F.col("x.at")).alias("g"), (F.col("x.at") < 0).alias("added"), F.col("x.new").alias("new"))
    kept = left.where("not added").select("position", "g", "new").join(t, "g").select("conv", "position", F.coalesce(F.nullif("new", F.lit("")), "role").alias("role"), "text")
    added = left.where("added").select("conv", "position", F.col("new").alias("role"), F.lit("").alias("text"))
    return verdicts, kept.union(added)


def repaired_texts(repaired: DataFrame) -> DataFrame:
    """(conv, body): "role:text" of the repaired rows in order, one a line; a conversation's texts make one value."""
    line = F.struct("position", F.concat("role", F.lit(":"), "text").alias("line"))
    return repaired.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("body"))

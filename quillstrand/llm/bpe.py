"""Byte-level BPE: words are folded by Spark's higher-order functions, texts are put together from their words.

Texts are cut into words by the vocabulary's pattern. A word is an array of its bytes' ids, and a fold merges, step
by step, the leftmost adjacent pair whose joined bytes have the lowest rank, until none has one; the state holds the
ids and the ranks of their neighbours, so that a merge looks up two pairs only. The rank map is a literal of the
plan: a flat array with a place for each pair of ids that makes another (seeds that displace the buckets of pairs
let no two share one), so that a look-up is two array accesses.

The most frequent words, a bounded number, are folded once and broadcast; of the others each text folds its
different words. Two Arrow functions stand around that fold: one writes a text as numbers of frequent words and
numbers of its own list of other words, one puts the ids in their places. Nothing of a text is shuffled, and rows
are independent. Decoding joins the ids' bytes.
"""

from __future__ import annotations

import base64
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrand.shared import stash

#: The pattern's white space is Unicode's, as in the library that the vocabulary is from.
UNICODE = "(?U)"
#: Places of the rank map for each pair, buckets that share a seed, and primes that spread pairs over both.
SPREAD, BUCKETS, STRIDE = 1.4, 40009, 10007
#: Frequent words that are folded once and broadcast (20 MB, whatever the input), counted over about so many
#: bytes of text, the rows with the smallest hashes. They save folds and change no result.
FREQUENT, SAMPLE_BYTES = 1 << 19, 256 << 20
#: Longer words are folded where they stand, so that the table of frequent words is bounded in bytes, too.
LONGEST_KEPT = 32
#: Words that an Arrow function works on at a time.
CHUNK = 1 << 20
#: Ids are below this; no rank.
ID, NONE = 1 << 16, 2147483647


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal(value: object, kind: str) -> Column:
    """A nested array as a constant of the plan; it is folded once, by the optimizer."""
    return F.from_json(F.lit(json.dumps({"x": value}, separators=(",", ":"))), f"x {kind}")["x"]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def place_pairs(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """(table, seeds): pair p with rank r is table[(p + seeds[p % BUCKETS] * (p % STRIDE + 1)) % len(table)] == p * ID + r;
    free places hold -1. Large buckets choose their seed first."""
    size = next(n for n in itertools.count(max(int(SPREAD * len(pairs)), 2 * STRIDE)) if all(n % k for k in range(2, math.isqrt(n) + 1)))
    buckets: dict[int, list[int]] = {}
    for p in pairs:
        buckets.setdefault(p % BUCKETS, []).append(p)
    table, seeds = [-1] * size, [0] * BUCKETS
    for k, own in sorted(buckets.items(), key=lambda x: -len(x[1])):
        for seed in itertools.count():
            at = {(p + seed * (p % STRIDE + 1)) % size for p in own}
            if len(at) == len(own) and all(table[x] < 0 for x in at):
                break
            if seed > size:
                raise ValueError("no seed separates the pairs of a bucket")
        seeds[k] = seed
        for p in own:
            table[(p + seed * (p % STRIDE + 1)) % size] = p * ID + pairs[p]
    return table, seeds


class Coder:
    """Columns that encode and decode with one vocabulary."""

    def __init__(self, path: str, pattern: str, context: SparkContext):
        ranks = read_ranks(path)
        self.pattern = UNICODE + pattern
        self.bytes = _literal([ranks[bytes([b])] for b in range(256)], "array<int>")
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * ID + b] = rank
        table, seeds = place_pairs(pairs)
        self.places = len(table)
        self.table, self.seeds = _literal(table, "array<bigint>"), _literal(seeds, "array<int>")
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.pieces = context.broadcast(pieces)

    def split(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def fold(self, word: Column) -> Column:
        """The ids of one word."""

        def rank(a: Column, b: Column) -> Column:
            def found(pair: Column) -> Column:
                seed = F.get(self.seeds, (pair % BUCKETS).cast("int"))
                entry = F.get(self.table, ((pair + seed * (pair % STRIDE + 1)) % self.places).cast("int"))
                return _let(entry, lambda e: F.when(F.call_function("shiftright", e, F.lit(16)) == pair, e.bitwiseAND(F.lit(ID - 1)).cast("int")).otherwise(F.lit(NONE)))

            return _let(a.cast("bigint") * ID + b, found)

        def merged(state: Column, least: Column, q: Column) -> Column:
            """The pair at place q becomes one id; the ranks beside it are looked up anew."""
            ids, ranks, gone = state["ids"], state["ranks"], F.lit(-1)
            new_ids = F.transform(ids, lambda x, i: F.when((i < q) | (i > q + 1), x).when(i == q, least).otherwise(gone))
            left, right = rank(F.get(ids, q - 1), least), rank(least, F.get(ids, q + 2))
            new_ranks = F.transform(ranks, lambda x, i: F.when((i < q - 1) | (i > q + 1), x).when(i == q, gone).when(i < q, left).otherwise(right))
            return F.struct(F.array_remove(new_ids, gone).alias("ids"), F.array_remove(new_ranks, gone).alias("ranks"))

        def step(state: Column, _: Column) -> Column:
            def put(least: Column) -> Column:
                place = (F.array_position(state["ranks"], least) - 1).cast("int")
                return F.when(F.coalesce(least, F.lit(NONE)) == NONE, state).otherwise(_let(place, lambda q: merged(state, least, q)))

            return _let(F.array_min(state["ranks"]), put)

        codes = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(self.bytes, F.ascii(c)))
        start = _let(codes, lambda c: F.struct(c.alias("ids"), F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), rank).alias("ranks")))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2))), start, step)["ids"]

    def frequent(self, texts: DataFrame) -> pa.Table:
        """(word, ids) of the most frequent words of a bounded sample of the texts; FREQUENT rows at most."""
        volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        share = int(min(1.0, SAMPLE_BYTES / max(volume, 1)) * (1 << 30))
        sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= share)
        counts = sample.select(self.split(F.col("text")).alias("words")).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        top = counts.where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST_KEPT)).orderBy(F.desc("n"), "word").limit(FREQUENT)
        top = stash(top.repartition(32, "word"), "frequent-words")
        return top.select("word", self.fold(F.col("word")).alias("ids")).toArrow()

    def decode(self, ids: Column) -> Column:
        """binary: the ids' bytes, joined."""
        shared = self.pieces

        @F.pandas_udf("binary")
        def join(lists: pd.Series) -> pd.Series:
            piece = shared.value.__getitem__
            return pd.Series([b"".join(map(piece, x.tolist())) for x in lists], index=lists.index, dtype=object)

        return join(ids)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word of a batch comes."""
    for b in _slices(batches, "words"):
        counts = b["words"].flatten().value_counts()
        yield pa.record_batch({"word": counts.field("values"), "n": counts.field("counts")})


def _table(known: pa.Table) -> dict:
    """(word, ids) as arrays: word k has the ids from starts[k] on, sizes[k] of them."""
    ids = known["ids"].combine_chunks()
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int32)
    return {"words": known["word"].combine_chunks(), "sizes": sizes, "starts": np.cumsum(sizes) - sizes, "ids": ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)}


def _slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Batches cut at rows so that their lists have about CHUNK items; the memory of a task is bounded by that."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b[name]).to_numpy(zero_copy_only=False))
        edges = np.unique([0, *np.searchsorted(ends, np.arange(CHUNK, ends[-1] if len(ends) else 0, CHUNK)).tolist(), len(b)])
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield b.slice(i, j - i)


def _numbered(shared):
    """(id, words) to (id, codes, rest): the number of each word among the frequent ones, or -1 less its number in rest,
    the text's different other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value["words"]
        for b in _slices(batches, "words"):
            words, lengths = b["words"].flatten(), pc.list_value_length(b["words"]).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            codes = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).copy()
            other = np.flatnonzero(codes < 0)
            rest: list[list[str]] = [[] for _ in range(len(b))]
            row, own = -1, {}
            for i, r, w in zip(other.tolist(), np.searchsorted(ends, other, "right").tolist(), words.take(pa.array(other)).to_pylist()):
                if r != row:
                    row, own = r, {}
                if w not in own:
                    own[w] = len(own)
                    rest[r].append(w)
                codes[i] = -1 - own[w]
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.record_batch({"id": b["id"], "codes": pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32())), "rest": pa.array(rest, pa.list_(pa.string()))})

    return run


def _placed(shared):
    """(id, codes, folded) to (id, ids); folded: the ids of each word of rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes, pool = shared.value["starts"], shared.value["sizes"], shared.value["ids"]
        for b in _slices(batches, "codes"):
            codes, counts = b["codes"].flatten().to_numpy(), pc.list_value_length(b["codes"]).to_numpy(zero_copy_only=False)
            own = b["folded"].flatten()
            own_sizes, own_ids = pc.list_value_length(own).to_numpy(zero_copy_only=False), own.flatten().to_numpy()
            own_starts = len(pool) + np.cumsum(own_sizes) - own_sizes
            per_row = pc.list_value_length(b["folded"]).to_numpy(zero_copy_only=False)
            first = np.repeat(np.cumsum(per_row) - per_row, counts)  # of the row's other words
            # A word's place among frequent words, or after them among the batch's other words.
            at = np.where(codes >= 0, codes, len(starts) + first - 1 - codes)
            begin, size = np.concatenate([starts, own_starts])[at], np.concatenate([sizes, own_sizes])[at]
            ends = np.cumsum(size)
            values = np.concatenate([pool, own_ids])[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            yield pa.record_batch({"id": b["id"], "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))})

    return run


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Coder]:
    """A row (id_col, ids) per row of docs, and the coder; ids: array<int> of the whole text.

    Null and empty texts have no ids. Every row is encoded on its own, so null ids, repeated rows and extra columns
    change nothing; empty tables give no rows. Special tokens are ordinary text. A word of n bytes is folded in n - 1
    steps over its arrays: words of many thousand bytes take long, but little memory.
    """
    context = docs.sparkSession.sparkContext
    coder = Coder(path, pattern, context)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = context.broadcast(_table(coder.frequent(rows)))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    cut = rows.select("id", coder.split(F.col("text")).alias("words"))
    numbered = cut.mapInArrow(_numbered(shared), f"id {kind}, codes array<int>, rest array<string>")
    # Written between the two Arrow functions, so that their Python workers don't hold memory at the same time.
    folded = stash(numbered.select("id", "codes", F.transform("rest", coder.fold).alias("folded")), "folded-words")
    return folded.mapInArrow(_placed(shared), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col), coder

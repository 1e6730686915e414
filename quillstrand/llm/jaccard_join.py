"""Near-duplicate documents: exact Jaccard similarity of word n-gram sets.

A pair of sets with similarity t or more shares a token among the first of both, in any order of all tokens that
is the same for both: of a set of n tokens the first n - ceil(t * n) + 1 are enough, and k - 1 more make it k
shared ones. The order puts rare tokens first, by a table of counts of bounded size that all documents fill; it
steers the work only, as any order gives the same result. Sets that share such tokens meet in two ways:

1. in a few rounds, each with one set that is central among those it shares tokens with (of all sets with the
   token, the one with most of its own tokens shared, as the original of many edited copies has); those links
   make most components;
2. sets of different components that share a token, in tiles of neighbouring size bands, compared by bitmap
   signatures: a bit that only one of them has is a token that only one of them has, so bit counts bound the
   overlap from above. Tokens whose smallest component is the same are one group, so two copies of one original
   meet once and not at each token that they share; signatures have a few bits a token, so that only pairs near
   the threshold leave the tile.

Every surviving pair is decided by the intersection of the sorted token arrays. Pairs inside a component aren't
compared again, so a large group of near copies costs about a row per copy and not its square.

Tokens are 64-bit hashes of n-grams; equal sets are collapsed first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrand.llm.components import connected_components
from quillstrand.llm.hashing import scramble, word_hashes
from quillstrand.shared import SMALLEST, discard, small_batches, stash

WORDS = 5
#: Text turned into tokens at a time; its arrays take 40 bytes a byte, and a worker keeps what they took.
CHUNK = 1 << 18
#: The table of counts has a slot for about so many tokens, within these bounds (powers of two; 64 MB at most).
PER_SLOT, LEAST_SLOTS, MOST_SLOTS = 64, 1 << 16, 1 << 24
#: Tokens counted this often may be in large groups, and are joined; groups of the others are at most this large.
HOT = 4096
#: A size band ends at GROWTH times its begin. Linked sizes differ by a third at most: one band or the next.
GROWTH = 1.34
#: A signature has a power of two of bits, TOKEN_BITS a token at least. A tile's part has TILE rows at most, and fewer
#: where their signatures would take more than TILE_BYTES.
TOKEN_BITS, LEAST_BITS, TILE, TILE_BYTES = 4, 256, 1024, 8 << 20
#: A set of n tokens takes n // SPARE tokens more than one shared one asks for, so that linked pairs share 1 + n // SPARE.
SPARE = 32
ROUNDS = 2
SALT = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 2 * WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def token_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted different hashes of its n-grams of words: runs of bytes other than ASCII white space,
    A-Z lower-cased. With fewer words the whole sequence is one n-gram; without words the set is empty."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1]) + 1
        if size >= CHUNK:
            out += _chunk_sets(held, words)
            held, size = [], 0
    return out + (_chunk_sets(held, words) if held else [])


def _chunk_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    h, starts = word_hashes(b" ".join([b"", *texts, b""]))
    firsts = np.cumsum([1] + [len(t) + 1 for t in texts])
    edge = np.searchsorted(starts, firsts)  # where each text's words begin in h
    with np.errstate(over="ignore"):
        n = len(h) - words + 1
        grams = sum((h[k : n + k] * SALT[k] for k in range(1, words)), h[:n] * SALT[0]) if n > 0 else h[:0]
        grams = scramble(grams)
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                out.append(scramble((h[a:b] * SALT[: b - a]).sum(keepdims=True) + SALT[words + b - a - 1]))
            else:
                out.append(h[:0])
    return out


def least_overlap(n: np.ndarray | int, share: int):
    """The least overlap of a set of n tokens with any set that has share percent similarity with it."""
    return -(-n * share // 100)


def _count_table(rows: DataFrame, slots: int, values) -> np.ndarray:
    """Counts of values(batch) by their lowest bits: a table per task, cut in strips, added up per strip.

    rows: what values takes from an Arrow batch. The result has slots numbers, whatever the number of rows.
    """
    strip = min(slots, 1 << 14)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for b in batches:
            for v in values(b):
                if len(v) > slots >> 4:
                    total += np.bincount((v & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
                else:
                    np.add.at(total, (v & np.uint64(slots - 1)).astype(np.int64), 1)
        parts = total.reshape(-1, strip)
        used = np.flatnonzero(parts.any(1))
        yield pa.record_batch({"strip": pa.array(used, pa.int32()), "counts": pa.array([parts[k].astype("<i4").tobytes() for k in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["strip"].to_pylist(), b["counts"].to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, "<i4").astype(np.int64)
        yield pa.record_batch({"strip": pa.array(list(sums), pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    schema = "strip int, counts binary"
    strips = rows.mapInArrow(count, schema).repartition(max(1, min(64, slots // strip)), "strip").mapInArrow(add, schema).collect()
    out = np.zeros((slots // strip, strip), np.int64)
    for k, c in strips:
        out[k] = np.frombuffer(c, np.int64)
    return out.ravel()


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _power_of_two(x: int) -> int:
    return 1 << max(0, int(x) - 1).bit_length()


def _prefix_rows(ranks, share: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, mask = ranks.value, np.uint64(len(ranks.value) - 1)
        hot_rank = _rank(np.array([HOT]))[0]
        for b in batches:
            sizes, keys, cool, hot = [], [], [], []
            for s in token_sets(_texts(b, "text"), words):
                n = len(s)
                own = rank[(s & mask).astype(np.int64)]
                first = n - least_overlap(n, share) + 1 + n // SPARE
                order = np.argsort(own.astype(np.uint64) << np.uint64(56) | s >> np.uint64(8), kind="stable")[:first] if n else []
                sizes.append(n)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                chosen, warm = s[order], own[order] >= hot_rank
                cool.append(chosen[~warm].view(np.int64))
                hot.append(chosen[warm].view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.record_batch({"doc_id": b["doc_id"], "n": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()), "cool": pa.array(cool, lists), "hot": pa.array(hot, lists)})

    return run


def _rank(counts: np.ndarray) -> np.ndarray:
    """Counts as eighths of powers of two, for an order in one byte."""
    return np.minimum(8 * np.log2(counts + 1), 255).astype(np.uint8)


def _set_rows(wanted, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            near = np.flatnonzero(table[(scramble(ids.astype(np.uint64)) & np.uint64(len(table) - 1)).astype(np.int64)])
            if not len(near):
                continue
            sets = token_sets(_texts(b.take(pa.array(near)), "text"), words)
            bits = [_signature(s) for s in sets]
            yield pa.record_batch({"rep": pa.array(ids[near]), "n": pa.array([len(s) for s in sets], pa.int64()), "signature": pa.array(bits, pa.binary()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _signature(s: np.ndarray) -> bytes:
    """Wide enough for the largest sets of the next band."""
    width = max(LEAST_BITS, _power_of_two(math.ceil(TOKEN_BITS * GROWTH**2 * len(s))))
    bits = np.zeros(width, np.uint8)
    bits[(s >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits).tobytes()


def _folded(signature: bytes, size: int) -> np.ndarray:
    """A signature of size bytes: its halves united until it has that size."""
    out = np.frombuffer(signature, np.uint64)
    while out.nbytes > size:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def _decide(share: int):
    """Keep the pairs whose sets have share percent similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for a, c, x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), b["tokens_a"].to_pylist(), b["tokens_b"].to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                if both and 100 * both >= share * (len(p) + len(q) - both):
                    u.append(a)
                    v.append(c)
            yield pa.record_batch({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    return run


TILE_KEY = ["route", "band", "low", "high"]


def _tile_candidates(share: int):
    """Pairs of different components in a tile whose sizes and signatures allow the similarity.

    Rows come sorted by tile. home: the row's size is of this band (else of the one below). Of the two parts that
    the tile compares, low is the first.
    """

    def pairs(n, comp, home, part, low, high, signatures, rep) -> np.ndarray:
        found = []
        size = min(len(x) for x in signatures)
        bits = np.stack([_folded(x, size) for x in signatures])
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        step = max(1, (4 << 20) // size)
        for k in range(0, len(n), 64):
            rows = slice(k, k + 64)
            need = -(-share * (n[rows, None] + n[None, :]) // (100 + share))
            fit = (comp[rows, None] != comp[None, :]) & (home[rows, None] | home[None, :]) & (np.minimum(n[rows, None], n[None, :]) >= need)
            fit &= (rep[rows, None] < rep[None, :]) & (np.minimum(part[rows, None], part[None, :]) == low) & (np.maximum(part[rows, None], part[None, :]) == high)
            i, j = np.nonzero(fit)
            i += k
            for c in range(0, len(i), step):
                p, q = i[c : c + step], j[c : c + step]
                both = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64)
                bound = np.minimum(n[p] - ones[p], n[q] - ones[q]) + both
                good = (100 + share) * bound >= share * (n[p] + n[q])
                found.append(np.stack([rep[p[good]], rep[q[good]]], 1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def work(table: pa.Table, last: bool):
            """Finished tiles of the table, and what may go on in the next batch."""
            if not len(table):
                return None, table
            keys = [table[c].to_numpy() for c in TILE_KEY]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cut = len(table) if last else int(new[-1]) if len(new) else 0
            done, seen = table[:cut], [np.zeros((0, 2), np.int64)]
            col = {c: done[c].to_numpy() for c in ("n", "comp", "home", "part", "rep")}
            edges = [0, *[int(x) for x in new if x < cut], cut]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    seen.append(pairs(*[col[c][a:b] for c in ("n", "comp", "home", "part")], keys[2][a], keys[3][a], done["signature"].slice(a, b - a).to_pylist(), col["rep"][a:b]))
            both = np.unique(np.concatenate(seen), axis=0)
            return pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])}), table[cut:]

        for b in batches:
            table = pa.Table.from_batches([b])
            out, rest = work(pa.concat_tables([rest, table]) if rest is not None and len(rest) else table, False)
            if out is not None:
                yield out
        if rest is not None and len(rest):
            out, _ = work(rest, True)
            yield out

    return run


def similar_documents(docs: DataFrame, share: int = 75, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_shingles (size of its set), component_id.

    Two documents link when 100 * intersection >= share * union of their sets of n-grams of words (token_sets);
    component_id is the smallest id reachable by links, the own one included. Null, empty and blank texts have
    empty sets and link with nothing. Rows with a null id keep their own set size and link with nothing. Where
    one id has several texts, it links if any of them does. Repeated rows stay rows of their own. Other columns
    are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark, SMALLEST)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, _power_of_two(volume // (6 * PER_SLOT))))
    counts = _count_table(rows.select("text"), slots, lambda b: token_sets(_texts(b, "text"), words))
    ranks = spark.sparkContext.broadcast(_rank(counts))
    prefixes = rows.mapInArrow(_prefix_rows(ranks, share, words), "doc_id long, n long, set_key binary, cool array<long>, hot array<long>")
    prefixes = stash(prefixes, "prefixes")
    # Equal sets become one; its smallest id stands for it.
    some = prefixes.where("doc_id is not null and set_key is not null")
    classes = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "cool", "hot")).alias("x")).select("set_key", F.col("x.doc_id").alias("rep"), "x.n", "x.cool", "x.hot")
    classes = stash(classes, "classes")
    keys = stash(prefixes.select("doc_id", "n", "set_key"), "keys")
    discard(prefixes)
    every = stash(_shared_tokens(classes), "shared")
    names = stash(classes.select("set_key", "rep"), "names")
    discard(classes)
    # A set needs so many shared tokens to have a partner; smaller partners have fewer extra tokens.
    need = 1 + F.floor(F.ceil(F.col("n") * share / 100) / SPARE)
    able = every.groupBy("rep", "n").agg(F.count("*").alias("c")).where(F.col("c") >= need).select("rep", (F.col("c") / F.col("n")).alias("fill"))
    shared = stash(every.join(able, "rep"), "able")
    discard(every)
    table = _count_table(shared.select("rep").distinct(), min(1 << 23, max(1 << 14, _power_of_two(volume // 512))), lambda b: [scramble(b["rep"].to_numpy(zero_copy_only=False).astype(np.uint64))])
    wanted = spark.sparkContext.broadcast(table > 0)
    sets = rows.where("doc_id is not null").mapInArrow(_set_rows(wanted, words), "rep long, n long, signature binary, tokens binary")
    sets = stash(sets.join(shared.select("rep").distinct(), "rep", "left_semi"), "sets")

    def decided(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a"))
        b = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_decide(share), "a long, b long")

    links = None
    mixed = _mixed_tokens(shared.withColumn("comp", F.col("rep")))
    for _ in range(ROUNDS):
        new = stash(decided(_central(mixed)), "links")
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        known = connected_components(links).withColumnsRenamed({"node": "rep", "component": "comp"})
        placed = shared.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        mixed = stash(_mixed_tokens(placed), "mixed")
    tiles = _tiles(mixed, sets).repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    pairs = tiles.mapInArrow(_tile_candidates(share), "a long, b long").distinct()
    more = stash(decided(stash(pairs, "pairs")), "more-links")
    components = connected_components(more if links is None else more.union(links)).withColumnsRenamed({"node": "rep", "component": "component_id"})
    placed = names.join(components, "rep", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    linked = keys.where("doc_id is not null and set_key is not null").select("doc_id", "n", "set_key").join(placed, "set_key")
    alone = keys.where("doc_id is null or set_key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """(token, rep, n) for the prefix tokens of at least two sets.

    Groups of cool tokens have HOT rows at most, as the table of counts never counts too low, so a window over
    each is bounded; hot tokens are counted first and joined, and a join splits its hot keys.
    """
    cool = classes.select(F.explode("cool").alias("token"), "rep", "n")
    cool = cool.withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1").drop("c")
    hot = classes.select(F.explode("hot").alias("token"), "rep", "n")
    known = hot.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return cool.union(hot.join(known, "token").select("token", "rep", "n"))


def _central(mixed: DataFrame) -> DataFrame:
    """(a, b): per set the one of another component that is most often the fullest, or else the emptiest, of those
    that share a token with it. One row a set."""
    ends = mixed.groupBy("token").agg(F.max(F.struct("fill", "rep", "comp", "n")).alias("x"), F.min(F.struct("fill", "rep", "comp", "n")).alias("y"))
    near = mixed.join(ends, "token").withColumn("z", F.when(F.col("comp") != F.col("x.comp"), F.col("x")).otherwise(F.col("y")))
    met = near.where(F.col("comp") != F.col("z.comp")).groupBy("rep", F.col("z.rep").alias("b")).agg(F.count("*").alias("c"))
    return met.groupBy("rep").agg(F.max_by("b", F.struct("c", "b")).alias("b")).select(F.col("rep").alias("a"), "b")


def _mixed_tokens(placed: DataFrame) -> DataFrame:
    """placed: (token, rep, n, fill, comp). Its rows whose token is shared by sets of different components, and
    route: the smallest of these components."""
    ends = placed.groupBy("token").agg(F.min("comp").alias("route"), F.max("comp").alias("last")).where("route <> last").drop("last")
    return placed.join(ends, "token").select("token", "rep", "n", "fill", "comp", "route")


def _tiles(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of tiles: a route's sets of one size band and the band below, in parts of bounded size; a tile compares
    part low with part high. Sets that share a token share its route."""
    # floor of a logarithm; a pair at the very edge is a band apart still, as bands are a little wider.
    own = F.floor(F.log(F.col("n")) / math.log(GROWTH)).cast("int")
    rows = mixed.select("route", "rep", "n", "comp", own.alias("own")).distinct()
    bands = F.explode(F.array(F.struct(F.col("own").alias("band"), F.lit(True).alias("home")), F.struct((F.col("own") + 1).alias("band"), F.lit(False).alias("home"))))
    rows = rows.select("route", "rep", "n", "comp", bands.alias("x")).select("route", "rep", "n", "comp", "x.band", "x.home")
    fit = F.greatest(F.lit(8), F.least(F.lit(TILE), F.floor(F.lit(8.0 * TILE_BYTES) / (2 * TOKEN_BITS * F.pow(F.lit(GROWTH), F.col("band") + 2)))))
    sizes = rows.groupBy("route", "band").agg(F.count("*").alias("c"), F.count_if("home").alias("h"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    sizes = sizes.where("h > 0 and x <> y").select("route", "band", F.ceil(F.col("c") / fit).cast("int").alias("parts"))
    rows = rows.join(sizes, ["route", "band"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("route", "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "home", "part", "rep", "n", "comp")
    return rows.join(sets.select("rep", "signature"), "rep").select(*TILE_KEY, "home", "part", "rep", "n", "comp", "signature")


def drop_similar(docs: DataFrame, share: int = 75, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns; null ids stay."""
    found = similar_documents(docs, share, words, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")

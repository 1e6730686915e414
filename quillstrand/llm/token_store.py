"""Token ids as raw payloads with a minimal perfect hash index for keyed access.

File format: a Parquet table with one row per shard, shards in ascending order of document id:

    shard int, n_docs long, n_ids long, min_id, max_id long (of the ids that are not null)
    payload  binary: ids of all documents one after another, little-endian unsigned 16-bit
    keys     binary: the document ids in that order, little-endian signed 64-bit (null: see null_keys)
    null_keys long:  how many of the first documents have a null id
    bounds   binary: n_docs + 1 offsets into the payload, little-endian unsigned 32-bit
    seeds    binary: the index's salt, then per bucket a displacement, little-endian signed 32-bit
    slots    binary: per slot (fingerprint, document number in the shard), little-endian unsigned 32-bit pairs

The index is hash and displace: a key's bucket gives a displacement, bucket and displacement give its slot; n
different keys fill exactly n slots. A stored 32-bit fingerprint refuses keys that are not in the shard. Where
an id is repeated, its slot names the first of its rows, and the others follow it in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstrand.llm.encoders import encoder

#: Text of about this size goes into one shard.
SHARD_BYTES = 8 << 20
#: A low mean leaves many buckets of one key, so that pairs are placed while slots are still free.
KEYS_PER_BUCKET = 1.5
STORE = "shard int, n_docs long, n_ids long, min_id long, max_id long, payload binary, keys binary, null_keys long, bounds binary, seeds binary, slots binary"


def _mix(x: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finalizer over keys and a seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed).astype(np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Seeds of the hashes of a key: its bucket, its place, its fingerprint.
BUCKET, PLACE, PRINT = 1, 2, 3
MOST_TRIES = 1 << 16
SPREAD_D, SPREAD, ALL = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    return ((((h ^ (d * SPREAD_D & ALL)) * SPREAD & ALL) >> 32) * n) >> 32


def _hashes(keys: np.ndarray, salt: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (_mix(keys, BUCKET + 8 * salt) % np.uint64(buckets)).astype(np.int64), _mix(keys, PLACE + 8 * salt)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: different int64 values. Returns (salt and displacement of each bucket, key number in each slot).

    A key's hash and its bucket's displacement d give its slot. Buckets are placed largest first, each with
    the least d that fits; a bucket of one key takes any free slot directly (stored as -slot - 1), so the last
    placements don't search. If a bucket fits nowhere, another salt is tried.
    """
    n = len(keys)
    seeds = np.zeros(1 + max(1, int(n / KEYS_PER_BUCKET)), "<i4")
    if not n:
        return seeds, np.zeros(0, np.int64)
    for salt in range(64):
        slots = _place(keys, salt, seeds)
        if slots is not None:
            return seeds, slots
    raise RuntimeError("no salt gives an index")


def _place(keys: np.ndarray, salt: int, seeds: np.ndarray) -> np.ndarray | None:
    n, buckets = len(keys), len(seeds) - 1
    bucket, place = _hashes(keys, salt, buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    slots, place, numbers = [-1] * n, place[order].tolist(), order.tolist()
    seeds[0] = salt
    for b in np.argsort(-sizes, kind="stable").tolist():
        size, s = int(sizes[b]), int(starts[b])
        if size < 2:
            break
        for d in range(1, MOST_TRIES):
            at = [_slot(place[k], d, n) for k in range(s, s + size)]
            if len(set(at)) == size and all(slots[x] < 0 for x in at):
                break
        else:
            return None
        seeds[1 + b] = d
        for x, k in zip(at, range(s, s + size)):
            slots[x] = numbers[k]
    slots = np.array(slots, np.int64)
    free, alone = np.flatnonzero(slots < 0), np.flatnonzero(sizes == 1)
    seeds[1 + alone] = -free - 1
    slots[free] = order[starts[alone]]
    return slots


def find(keys: np.ndarray, seeds: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The document number of each key in its shard, -1 where the fingerprint differs. slots: (n, 2)."""
    n = len(slots)
    if not n:
        return np.full(len(keys), -1, np.int64)
    bucket, place = _hashes(keys, int(seeds[0]), len(seeds) - 1)
    d = seeds[1 + bucket].astype(np.int64)
    with np.errstate(over="ignore"):
        spread = (place ^ (np.maximum(d, 0).astype(np.uint64) * np.uint64(SPREAD_D))) * np.uint64(SPREAD)
    at = np.where(d < 0, -d - 1, ((spread >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64))
    same = slots[at, 0] == (_mix(keys, PRINT) >> np.uint64(32)).astype(np.uint32)
    return np.where(same, slots[at, 1].astype(np.int64), -1)


def _shard_writer(path: str, end_id: int):
    def shard(number: int, ids: list, payloads: list[bytes]) -> pd.DataFrame:
        nulls = sum(1 for x in ids if x is None)
        keys = np.array([0 if x is None else x for x in ids], "<i8")
        bounds = np.concatenate([[0], np.cumsum([len(p) // 2 for p in payloads])]).astype("<u4")
        own, first = np.unique(keys[nulls:], return_index=True)
        seeds, order = build_index(own)
        slots = np.empty((len(own), 2), "<u4")
        slots[:, 0] = (_mix(own[order], PRINT) >> np.uint64(32)).astype(np.uint32)
        slots[:, 1] = first[order] + nulls
        low, high = (int(own[0]), int(own[-1])) if len(own) else (None, None)
        row = (number, len(ids), int(bounds[-1]), low, high, b"".join(payloads), keys.tobytes(), nulls, bounds.tobytes(), seeds.tobytes(), slots.tobytes())
        return pd.DataFrame([row], columns=[c.split()[0] for c in STORE.split(", ")]).astype({"min_id": "Int64", "max_id": "Int64"})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, end = encoder(path), np.array([end_id], "<u2").tobytes()
        task, k, ids, payloads, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            # pandas makes floats of nullable longs; the missing flag carries the nulls instead
            for doc_id, missing, text in zip(batch["id"], batch["missing"], batch["text"]):
                payloads.append(enc.encode(text) + end)
                ids.append(None if missing else int(doc_id))
                held += len(payloads[-1])
                if held >= SHARD_BYTES:
                    yield shard(task << 12 | k, ids, payloads)
                    k, ids, payloads, held = k + 1, [], [], 0
        if ids:
            yield shard(task << 12 | k, ids, payloads)

    return write


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", text_bytes: int | None = None) -> None:
    """Encode whole texts and write the store at path (any path that Spark can write).

    Null text counts as empty: such a document has the end id alone. Null ids come first. Rows with one id
    are ordered by text. Rows are dealt to tasks by ranges of (id, hash of text), so one id with very many rows
    is spread; a task holds one shard at a time. An empty table writes an empty store.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("missing"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if text_bytes is None:
        text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, min(1 << 18, -(-text_bytes // (2 * SHARD_BYTES))))
    keys = [F.col("missing").desc(), F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    dealt.mapInPandas(_shard_writer(tokenizer, end_id), STORE).write.option("compression", "zstd").parquet(path)


def _views(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row.payload, "<u2"), np.frombuffer(row.keys, "<i8"), np.frombuffer(row.bounds, "<u4").astype(np.int64), np.frombuffer(row.seeds, "<i4"), np.frombuffer(row.slots, "<u4").reshape(-1, 2))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            ids, keys, bounds, seeds, slots = _views(row)
            number = np.arange(row.n_docs)
            # Through the index: the first row of each key, then its further rows.
            first = find(keys, seeds, slots)
            first[: row.null_keys] = 0
            head = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
            head[: row.null_keys + 1] = True
            group = np.maximum.accumulate(np.where(head, number, 0))
            number = np.where(number < row.null_keys, number, first + number - group)
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[bounds[k] : bounds[k + 1]]) for k in number]
            yield pd.DataFrame({"shard": row.shard, "key": keys, "missing": np.arange(row.n_docs) < row.null_keys, "at": bounds[number], "n_tokens": bounds[number + 1] - bounds[number], "ids_crc32": np.array(crc, np.int64)})


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the store: doc_id, start, n_tokens, ids_crc32, each found through its shard's index.

    start is the number of ids of all documents before it: its place in the shard plus a running sum over the
    shards, which takes one small row per shard.
    """
    store = spark.read.schema(STORE).parquet(path)
    bases = store.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("base"))
    rows = store.mapInPandas(_read, "shard int, key long, missing boolean, at long, n_tokens long, ids_crc32 long")
    placed = rows.join(bases, "shard")
    return placed.select(F.when(~F.col("missing"), F.col("key")).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents, a few keys given by the caller; absent keys have no row.

    Only shards whose range holds a wanted key are read, and in them only the slots of those keys.
    """
    asked = np.array(sorted(set(wanted)), np.int64)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, keys, bounds, seeds, slots = _views(row)
                number = find(asked, seeds, slots)
                hits = [(int(k), int(n)) for k, n in zip(asked, number) if n >= 0 and keys[n] == k]
                yield pd.DataFrame({"doc_id": [k for k, _ in hits], "ids": [ids[bounds[n] : bounds[n + 1]].astype(np.int32) for _, n in hits]})

    store = spark.read.schema(STORE).parquet(path)
    near = F.lit(False)
    for k in asked.tolist():
        near = near | F.lit(k).between(F.col("min_id"), F.col("max_id"))
    return store.where(near).mapInPandas(fetch, "doc_id long, ids array<int>")

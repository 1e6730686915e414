"""Sharding by extendible hashing, with DataFrame operations only.

A document's hash is a string of bits; a shard is a prefix of it. The directory begins with one shard, and any
shard whose bytes exceed the limit is split on the next bit, so only crowded regions become deep. A document's
shard is therefore the shortest prefix of its hash whose bytes fit, which sums per prefix tell at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrand.shared import free_name, stash

#: Bits of the hash, from the first 15 hexadecimal digits of an MD5.
BITS = 60
#: Bits below the expected depth that one round of sums covers.
MARGIN = 4


def hash_bits(key: Column) -> Column:
    """60 bits of a key's MD5 as a long; null is hashed as the word null."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """rows: bits, n_bytes. Returns the shards: depth, prefix, shard_bytes, shard_rows, fits.

    Sums are taken at a depth a little below the expected one and added up for every shorter prefix; shards that
    still don't fit there are summed again from their rows, deeper, until none is left. A shard of one hash
    only can't be split: it stays whole at the full depth, and fits says no if it exceeds the limit.
    """
    total, = rows.agg(F.sum("n_bytes")).first()
    depth = min(BITS, max(0, math.ceil(math.log2(max((total or 0) / limit, 1)))) + MARGIN)
    open_rows, above, found = rows, -1, None
    while True:
        sums = stash(open_rows.groupBy(_prefix(F.col("bits"), depth).alias("deep")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "shard-sums")
        # Every ancestor between the last round's depth and this one.
        levels = sums.select(F.explode(F.sequence(F.lit(above + 1), F.lit(depth))).alias("depth"), "deep", "b", "n")
        levels = levels.select("depth", F.call_function("shiftright", F.col("deep"), (F.lit(depth) - F.col("depth")).cast("int")).alias("prefix"), "b", "n")
        levels = stash(levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")), "shard-levels")
        # A prefix is a shard if it fits (or can't be split) and its parent doesn't; the first level's parents were too large.
        fit = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        parents = levels.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        heirs = levels.withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        shards = heirs.where(fit).join(parents, ["depth", "parent"], "left_semi").union(heirs.where(fit & (F.col("depth") == above + 1)).select("depth", "parent", "prefix", "shard_bytes", "shard_rows"))
        shards = shards.select("depth", "prefix", "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))
        found = shards if found is None else found.union(shards)
        large = levels.where((F.col("shard_bytes") > limit) & (F.col("depth") == depth)).select("prefix")
        if depth == BITS or large.isEmpty():
            return found
        open_rows = open_rows.withColumn("prefix", _prefix(F.col("bits"), depth)).join(large, "prefix", "left_semi").drop("prefix")
        above, depth = depth, min(BITS, depth + 2 * MARGIN)


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, shard (the prefix as a string of bits; "" is the only shard), depth, shard_bytes, fits.

    limit: most UTF-8 bytes of text in a shard. The hash is taken over id and text, so rows that share an id
    spread over shards; only rows equal in both, or one text above the limit, can leave a shard that doesn't
    fit. Null text has 0 bytes, null ids are hashed as the word null. Empty tables give no rows.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text))
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), hash_bits(key).alias("bits")), "shard-keys")
    shards = stash(directory(rows.select("bits", "n_bytes"), limit), "shard-directory")
    # A row joins at each depth that has shards; just one of its prefixes is one.
    depths = [r[0] for r in shards.select("depth").distinct().orderBy("depth").collect()]
    levels = F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array(F.lit(0))).alias("depth")
    tried = rows.select("doc_id", "n_bytes", "bits", levels).withColumn("prefix", _prefix(F.col("bits"), F.col("depth")))
    out = tried.join(shards, ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "fits")


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet with a folder for each shard, rows of a shard together. Folders are named by a column
    shard, or shard_ where docs has that one already (shard__ where it has both, ...)."""
    bits, own_id, name = (free_name(n, docs) for n in ("own_bits", "own_id", "shard"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text))
    where = shard(docs, limit, id_col, text_col).select(F.col("doc_id").alias(own_id), F.col("shard").alias(name)).distinct()
    marked = docs.withColumn(bits, hash_bits(key))
    own = marked.join(where, marked[id_col].eqNullSafe(where[own_id]) & F.lpad(F.bin(bits), BITS, "0").startswith(where[name]))
    own.drop(own_id, bits).repartition(name).write.partitionBy(name).parquet(path)

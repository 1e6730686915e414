"""What the writer of shards leaves on disk: every row once, whatever ids repeat."""

import collections

import pytest

from quillstrand.llm import sharding

SCHEMA = "doc_id long, text string, mark long"
ROWS = [(1, "a" * 3, 0), (1, "b" * 5, 1), (1, "b" * 5, 1), (1, None, 2), (None, "c" * 4, 3), (None, "d" * 9, 4), (None, None, 5)] + [(2, "e" * k, k) for k in range(40)] + [(k, "f" * k, k) for k in range(3, 30)]


@pytest.mark.parametrize("limit", [100, 1 << 30])
def test_written_rows(spark, tmp_path, limit):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    sharding.write_shards(docs, limit, f"{tmp_path}/out")
    back = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    assert collections.Counter(tuple(r) for r in back.select("doc_id", "text", "mark").collect()) == collections.Counter(ROWS)
    # Each row lies in the folder of its own shard.
    given = collections.Counter((r["doc_id"], r["n_bytes"], r["shard"]) for r in sharding.shard(docs, limit).collect())
    folders = back.selectExpr("doc_id", "octet_length(coalesce(text, '')) as n", "regexp_extract(_metadata.file_path, 'shard=([01]*)/', 1) as shard")
    assert collections.Counter(tuple(r) for r in folders.collect()) == given

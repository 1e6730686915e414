"""The numbered operators over their whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand.llm import bpe, conversation_repair, embedding_dedup, exact_dedup, fill_in_middle, jaccard_join, line_dedup, packing, pii, quality, sharding, token_store, warc
from quillstrand.shared import new_path, settled

#: Bytes of text in a shard. Production tables use 128 MB; the limit is low here so that small tables split, too.
SHARD_LIMIT = 4 << 20
#: Bytes of a WARC record's block. Production archives split at 64 MB; here most pages split, too.
SEGMENT_BYTES = 4 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component, by cosine."""
    return settled(spark, lambda: embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), 0.95), "near-vectors")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids and what they decode to, as digests."""
    out, coder = bpe.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    written = [str(k) for k in range(1 << 16)]

    @F.pandas_udf("string")
    def ids_digest(lists: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(" ".join(map(written.__getitem__, x.tolist())).encode()).hexdigest() for x in lists], index=lists.index, dtype=object)

    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("ids_sha256"), F.sha2(coder.decode(F.col("ids")), 256).alias("decoded_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles and component, by shared shingles."""
    return settled(spark, lambda: jaccard_join.similar_documents(_table(spark, sf_dir, "documents")), "similar-documents")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard."""
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARD_LIMIT)


def train_quality(spark: SparkSession, sf_dir: str) -> dict:
    """The model for these tables; only labelled rows whose crc32(doc_id as text) mod 4 isn't 2 are seen."""
    labels = _table(spark, sf_dir, "labels").where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("doc_id", F.col("quality").alias("label"))
    return quality.fit(_table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels of a quarter of the ids are held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.scored(docs, train_quality(spark, sf_dir))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its host's boilerplate lines."""
    out = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("clean_sha256"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, as read back from the store."""
    path = new_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_digests(spark, path)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the patterns' spans, and all spans."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of a document in a sequence."""
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair, after damage by rule."""
    table = _table(spark, sf_dir, "conversations")

    def make() -> DataFrame:
        verdicts, repaired = conversation_repair.repair(conversation_repair.damaged(table), "conv", "turn", "role", "text")
        ids = table.select("conv_id").distinct()
        texts = conversation_repair.repaired_texts(repaired).withColumnRenamed("conv", "c")
        found = verdicts.join(texts, F.col("conv").eqNullSafe(F.col("c")), "left")
        all_ids = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        digest = F.sha2(F.coalesce("body", F.lit("")), 256).alias("repaired_sha256")
        return all_ids.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)

    return settled(spark, make, "conversation-repair")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives that it was written to."""
    table = _table(spark, sf_dir, "pages")

    def make() -> DataFrame:
        path = new_path(spark, "archive")
        warc.write_archive(warc.records(table, "page_id", "url", "html", segment_bytes=SEGMENT_BYTES), path)
        return warc.payloads(warc.read_records(spark, path), keep_payload=False)

    out = settled(spark, make, "pages")
    key = lambda c: F.col(c).cast("long")
    return out.select(key("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"), "problem")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sample, cut at code points, and what it is restored to."""
    out = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d"""

ORACLE_SQL["op6_line_dedup"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines, ' ' || chr(9) || chr(13) || chr(11) || chr(12) AS white FROM documents),
l AS (SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, white)), lambda x: x <> ''))) AS line FROM d),
c AS (SELECT host, line, count(*) AS n_with FROM l GROUP BY host, line),
t AS (SELECT host, count(*) AS n_pages FROM d GROUP BY host),
b AS (SELECT host, list(line) AS boiler FROM c JOIN t USING (host)
  WHERE n_with > CAST({line_dedup.RATIO} AS DOUBLE) * n_pages GROUP BY host),
k AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boiler, []), trim(x, white))) AS stays FROM d LEFT JOIN b USING (host))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stays) AS BIGINT) AS n_dropped,
  sha256(array_to_string(stays, chr(10))) AS clean_sha256
FROM k"""

ORACLE_SQL["op4_sharding"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS bits FROM documents),
open(depth, doc_id, n_bytes, bits, total) AS (
  SELECT 0, doc_id, n_bytes, bits, sum(n_bytes) OVER () FROM d
  UNION ALL
  SELECT depth + 1, doc_id, n_bytes, bits, sum(n_bytes) OVER (PARTITION BY bits >> (60 - depth - 1)) FROM open WHERE total > {SHARD_LIMIT} AND depth < 60)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bits >> (60 - depth)), depth, '0') END AS shard,
  CAST(depth AS INTEGER) AS depth, CAST(total AS BIGINT) AS shard_bytes, total <= {SHARD_LIMIT} AS fits
FROM open WHERE total <= {SHARD_LIMIT} OR depth = 60"""

ORACLE_SQL["op13_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""

ORACLE_SQL["op12_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
d AS (SELECT *, list_transform(range(0, 32), lambda i: CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER)) AS digits FROM s)
SELECT page_id, payload_bytes, array_to_string(list_transform(digits, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM d"""


def _repair_sql() -> str:
    """op11 in SQL: crc32 by table, one state a place ({cost, edits} or null) for each conversation, a row a step."""
    add = lambda e, cost, edit, when="true": f"CASE WHEN {e} IS NOT NULL AND {when} THEN {{'c': {e}.c + {cost}, 'a': {e}.a || '{edit}'}} END"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    gone = [add(f"e{k}", 3, "D") for k in range(4)]
    keep = lambda e, role: add(e, "more", "K", f"stays AND initial = '{role}'")
    change = lambda e: add(e, "2 + more", "R", "stays")
    insert = f"""SELECT * EXCLUDE (s0, s1, s2, s3, e2), s0 AS e0, s1 AS e1, e2, {least("s3", add("e2", 2, "I"))} AS e3
  FROM (SELECT *, {least("s2", *[add(s, 2, "I") for s in ("s0", "s1", "s3")])} AS e2 FROM"""
    white = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS key FROM conversations),
f AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, key), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS fate FROM r, tab),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS time FROM f WHERE fate <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, {white}) AS bare, row_number() OVER w - 1 AS k, lag(left(role, 1)) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS copy FROM o),
m AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM g),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM m GROUP BY conv_id),
p(conv_id, k, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': ''}}, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)), CAST(NULL AS STRUCT(c BIGINT, a VARCHAR)) FROM n
  UNION ALL
  SELECT conv_id, k + 1, {gone[0]}, {least(gone[1], keep("e0", "s"))},
    {least(gone[2], *[keep(e, "u") for e in ("e0", "e1", "e3")], *[change(e) for e in ("e0", "e1", "e3")])}, {least(gone[3], keep("e2", "a"), change("e2"))}
  FROM ({insert} (SELECT p.*, m.initial, m.fault IN ('none', 'truncated') AS stays, CASE WHEN m.fault = 'truncated' THEN 1 ELSE 0 END AS more FROM p JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.k = m.k)))),
e AS ({insert} (SELECT p.*, n.gaps, n.blank, n.duplicate, n.truncated, n.illegal FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.k = n.size))),
a AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, {least("e0", "e3")} AS x FROM e),
u AS (SELECT conv_id, x.a AS audit, unnest(range(1, len(x.a) + 1)) AS i FROM a),
v AS (SELECT conv_id, i, audit[i] AS edit, count(*) FILTER (audit[i] <> 'I') OVER w - 1 AS k, count(*) FILTER (audit[i] <> 'D') OVER w AS place FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
z AS (SELECT v.conv_id, v.place, v.edit, m.role, m.text, m.initial FROM v LEFT JOIN m ON v.conv_id IS NOT DISTINCT FROM m.conv_id AND v.k = m.k AND v.edit <> 'I' WHERE v.edit <> 'D'),
y AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM z),
b AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS body FROM y GROUP BY conv_id),
i AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM i LEFT JOIN a ON i.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON i.conv_id IS NOT DISTINCT FROM b.conv_id"""


ORACLE_SQL["op11_conversation_repair"] = _repair_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

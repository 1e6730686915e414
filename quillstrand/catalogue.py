"""All queries by name over the star schema's tables, each with SQL that a second engine can check it with.

documents stand for sequence rows: letters are folded onto A, C, G, T, everything else acts as a masked base.
Queries and SQL work on whole texts; where DuckDB is too slow on them there is no SQL, and the tests hold the query
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand import file_queries  # noqa: F401  (enters its queries)
from quillstrand.functions import letters, records, scores, spectra
from quillstrand.functions import sequence as sq
from quillstrand.operators import metrics, providers, relations
from quillstrand.plans import completion, heads, likelihood, tasks
from quillstrand.registry import ABC, FOLD, ORACLE, QUERIES, SEQ, Query, query
from quillstrand.registry import table as _table
from quillstrand.shared import small_batches, stash


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _spread(df: DataFrame, key: str) -> DataFrame:
    """A small file is one task; rows that cost much are dealt to all cores first."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.translate(F.lower("text"), ABC, FOLD).alias("seq"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("label"), z.alias("z"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).withColumn("pred", scores.argmax(F.col("z")))


D_Z = "z AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings)"
D_PRED = D_Z + ", p AS (SELECT vec_id, label, z, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred FROM z)"
D_SEQ = f"s AS (SELECT doc_id, {SEQ} AS seq FROM documents)"

# --- likelihood ---------------------------------------------------------------------------------------------------

D_BPB = f"""{D_SEQ}, ch AS (SELECT doc_id, i, substr(seq, i, 1) AS c FROM (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s)),
m AS (SELECT c, count(*) AS n, sum(count(*)) OVER () AS total FROM ch GROUP BY c),
d AS (SELECT doc_id, sum(-ln((n + 1.0::DOUBLE) / (total + 256.0::DOUBLE))) / count(*) AS a, count(*) AS tok FROM ch JOIN m USING (c) WHERE i > 128 GROUP BY doc_id),
b AS (SELECT s.doc_id, CAST(length(seq) AS INTEGER) AS sequence_chars, a AS avg_nll_token, tok AS token_count,
  CASE WHEN coalesce(tok, 0) <= 0 OR length(seq) <= 128 THEN 'NaN'::DOUBLE ELSE a * tok / least(length(seq) - 128, tok) / ln(2.0::DOUBLE) END AS bpb
  FROM s LEFT JOIN d USING (doc_id))"""


def _bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = _sequences(spark, sf_dir)
    counts = likelihood.markov_counts(seqs, "seq")
    return likelihood.per_sample(likelihood.markov_scores(seqs, counts, "doc_id", "seq"), seqs, "doc_id", "seq")


@query(f"""WITH {D_BPB} SELECT doc_id, round(bpb, 6) AS bpb, round(avg_nll_token, 6) AS avg_nll_token, token_count, sequence_chars,
CAST(greatest(0, sequence_chars - 128) AS INTEGER) AS char_count FROM b""")
def bpb_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bpb(spark, sf_dir)
    return b.select("doc_id", F.round("bpb", 6).alias("bpb"), F.round("avg_nll_token", 6).alias("avg_nll_token"), "token_count", "sequence_chars", "char_count")


@query(f"""WITH {D_BPB}, q AS (SELECT quantile_cont(sequence_chars, 0.05) AS a, quantile_cont(sequence_chars, 0.33) AS b, quantile_cont(sequence_chars, 0.66) AS c FROM b),
k AS (SELECT bpb, CASE WHEN sequence_chars < a THEN NULL WHEN sequence_chars < q.b THEN 'short' WHEN sequence_chars < c THEN 'medium' ELSE 'long' END AS bucket FROM b, q),
f AS (SELECT bucket, bpb, CASE WHEN isfinite(bpb) THEN bpb END AS x FROM k WHERE bucket IS NOT NULL)
SELECT bucket, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max,
count(*) AS count, count(x) AS valid_count FROM f GROUP BY bucket""")
def bpb_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stash(_bpb(spark, sf_dir), "bpb")  # read twice: for the cuts and for the summary
    a, m, z = b.agg(F.percentile("sequence_chars", F.array(F.lit(0.05), F.lit(0.33), F.lit(0.66)))).first()[0]
    named = b.withColumn("bucket", relations.length_buckets(F.col("sequence_chars"), [F.lit(a), F.lit(m), F.lit(z)])).where("bucket is not null")
    return named.groupBy("bucket").agg(*metrics.five_numbers(F.col("bpb"), 6))


@query("""WITH e AS (SELECT event_id, value AS bpb, value / 100 AS a, CAST(event_id % 700 AS BIGINT) AS tok, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 600 AS BIGINT) END AS ch, CAST(event_id % 900 AS BIGINT) AS chars FROM events),
w AS (SELECT *, coalesce(ch + 128, chars) AS whole FROM e), x AS (SELECT *, whole - 128 AS ex FROM w),
y AS (SELECT *, ex > 0 AND tok > 0 AND NOT coalesce(ch = ex AND tok >= ex, false) AS changed FROM x)
SELECT event_id, changed, round(CASE WHEN changed THEN a * tok / least(whole - 128, tok) / ln(2.0::DOUBLE) ELSE bpb END, 4) AS bpb FROM y""")
def bpb_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = _table(spark, sf_dir, "events").select("event_id", F.col("value").alias("bpb"), (F.col("value") / 100).alias("a"), (k % 700).alias("tok"), F.when(k % 5 != 0, k % 600).alias("ch"), (k % 900).alias("chars"))
    r = likelihood.recomputed(*[F.col(c) for c in ("bpb", "a", "tok", "ch", "chars")])
    return e.select("event_id", r.alias("r")).select("event_id", F.col("r.changed").alias("changed"), F.col("r.value").alias("bpb"))


D_BUCKET = "CASE WHEN value < 100 THEN 'short' WHEN value < 200 THEN 'medium' ELSE 'long' END"


@query("WITH e AS (SELECT event_type AS model, value, " + D_BUCKET + " AS b FROM events) SELECT model, " + ", ".join(
    f"coalesce(printf('%.4f', {f}(CASE WHEN b = '{b}' THEN value END)), '') AS {b}_{f if f != 'avg' else 'mean'}" for b in ("short", "medium", "long") for f in ("min", "max", "median", "avg")) + " FROM e GROUP BY model")
def bpb_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("value") < 100, "short").when(F.col("value") < 200, "medium").otherwise("long")
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "value", b.alias("b"))
    return likelihood.model_report(e, "model", "b", "value", ["short", "medium", "long"])


@query("""WITH l AS (SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 512) / 256.0::DOUBLE)) AS BIGINT) + 1)) AS k FROM l)
SELECT doc_id, k * 256 AS "begin", least(k * 256 + 512, n) AS "end", least(k * 256 + 512, n) - CASE WHEN k = 0 THEN 0 ELSE least(k * 256 + 256, n) END AS scored FROM k""")
def sliding_window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.sliding_plan(_table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id", "n", 512, 256)


@query("""SELECT event_type, sum(CASE WHEN event_id % 3 <> 0 THEN value END) AS nll_sum, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS tokens,
round(coalesce(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 0), 6) AS avg_nll, round(exp(avg(CASE WHEN event_id % 3 <> 0 THEN value END) / 100), 6) AS ppl FROM events GROUP BY event_type""".replace("sum(CASE", "round(sum(CASE").replace("END) AS nll_sum", "END), 4) AS nll_sum"))
def masked_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(x), 4).alias("nll_sum"), F.count(x).alias("tokens"), F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias("avg_nll"), F.round(scores.safe_exp(F.avg(x) / 100), 6).alias("ppl"))


@query("""SELECT event_type, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, count(*) AS count, count(x) AS valid_count
FROM (SELECT event_type, CASE WHEN value <= 300 THEN value END AS x FROM events) GROUP BY event_type""")
def summary_stats_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("value") > 300, scores.nan()).otherwise(F.col("value"))
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(*metrics.five_numbers(v, 6))


# --- labels, joins, windows, splits -------------------------------------------------------------------------------

D_CONTIG = "c AS (SELECT conv_id, list(text ORDER BY turn) AS sequences FROM conversations GROUP BY conv_id)"


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda x: x["text"]).alias("sequences"))


@query(f"WITH {D_CONTIG}, e AS (SELECT conv_id, unnest(sequences) AS sequence, generate_subscripts(sequences, 1) - 1 AS i FROM c) SELECT conv_id, CAST(i AS INTEGER) AS contig_index, sequence FROM e WHERE sequence <> ''")
def explode_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.explode_sequences(_contigs(spark, sf_dir), id_col="conv_id")


@query(f"WITH {D_CONTIG}, e AS (SELECT conv_id, unnest(sequences) AS sequence, generate_subscripts(sequences, 1) - 1 AS i FROM c) SELECT conv_id, CAST(i AS INTEGER) AS contig_index, substr(sequence, 1, 64) AS sequence FROM e WHERE sequence <> ''")
def contig_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.explode_sequences(_contigs(spark, sf_dir), id_col="conv_id", max_length=64)


@query(f"WITH {D_CONTIG} SELECT conv_id, md5(array_to_string(sequences, '')) AS digest, CAST(length(array_to_string(sequences, '')) AS INTEGER) AS n FROM c")
def concat_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = relations.materialise_sequence(F.lit(None).cast("string"), F.col("sequences"))
    return _contigs(spark, sf_dir).select("conv_id", F.md5(s).alias("digest"), F.length(s).alias("n"))


D_VOCAB = "v AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT trim(source) AS label FROM documents WHERE doc_id % 10 < 8 AND trim(source) <> '' AND source <> 'src3'))"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.label_vocabulary(_table(spark, sf_dir, "documents").where("doc_id % 10 < 8 and source <> 'src3'"), "source")


@query(f"WITH {D_VOCAB} SELECT label, label_id FROM v")
def label_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


@query(f"WITH {D_VOCAB} SELECT doc_id, coalesce(label_id, -1) AS label_id FROM documents LEFT JOIN v ON trim(source) = label")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.encode_labels(_table(spark, sf_dir, "documents").select("doc_id", "source"), _vocabulary(spark, sf_dir), "source").select("doc_id", "label_id")


@query(f"WITH {D_VOCAB} SELECT vec_id, coalesce(v.label, 'class_' || e.k) AS label FROM (SELECT vec_id, CAST(vec_id % 25 AS INTEGER) AS k FROM embeddings) e LEFT JOIN v ON e.k = label_id")
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 25).cast("int").alias("k"))
    return relations.decode_labels(e, _vocabulary(spark, sf_dir), "k").select("vec_id", "label")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def attach_many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return relations.attach_many_to_one(docs, labels, "doc_id").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_custkey % 3 AS k FROM orders), b AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey % 3 AS k, c_acctbal FROM customer)
SELECT i, a.k AS k, c_acctbal, a.k IS NOT DISTINCT FROM b.k AS aligned FROM a FULL JOIN b USING (i)""")
def attach_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = relations.numbered(_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("k")), ["o_orderkey"])
    b = relations.numbered(_table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("k"), "c_acctbal"), ["c_custkey"])
    return relations.attach_positional(a, b, "i", "k").select("i", "k", "c_acctbal", "aligned")


@query("WITH c AS (SELECT l_linenumber AS label_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT label_id, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = relations.class_weights(_table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("label_id")))
    return w.select("label_id", F.round("weight", 9).alias("weight"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.label_frequency(_table(spark, sf_dir, "documents"), "source")


D_WIN = """n AS (SELECT doc_id, text, length(text) AS n FROM documents), w AS (SELECT doc_id, text, n, CASE WHEN n <= 0 THEN [] WHEN n <= 512 THEN [0] ELSE list_concat(range(0, n - 512 + 1, 512), CASE WHEN n % 512 <> 0 THEN [n - 512] ELSE [] END) END AS st FROM n),
x AS (SELECT doc_id, text, len(st) AS num, unnest(st) AS b, generate_subscripts(st, 1) - 1 AS i FROM w)"""


@query(f"WITH {D_WIN} SELECT doc_id, CAST(num AS INTEGER) AS num_windows, CAST(i AS INTEGER) AS window_index, CAST(b AS INTEGER) AS window_start, md5(substr(text, CAST(b AS BIGINT) + 1, 512)) AS digest FROM x")
def windows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.expand_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"), 512, "text")
    return rows.select("doc_id", "num_windows", "window_index", "window_start", F.md5("window").alias("digest"))


@query()
def windows_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.expand_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"), 512, "text")
    return relations.sample_windows(rows.select("doc_id", "window_index", "window_start"), 8, True, key="doc_id")


@query(f"WITH {D_WIN} SELECT doc_id, least(count(*), 8) AS taken, least(count(*), 8) AS different FROM x GROUP BY doc_id")
def windows_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows of each text are sampled: eight different ones, or all where there are fewer."""
    return windows_sampled(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("taken"), F.count_distinct("window_index").alias("different"))


@query("""WITH e AS (SELECT vec_id // 4 AS g, vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT g, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY g, i)
SELECT g, round(sqrt(sum(m * m)), 6) AS norm, round(max(m), 6) AS top, (SELECT min_by(label, vec_id) FROM embeddings WHERE vec_id // 4 = g) AS label FROM m GROUP BY g""")
def window_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").withColumn("g", F.expr("vec_id div 4"))
    g = relations.group_mean(e, "g", "embedding", "vec_id", "label")
    norm = F.sqrt(F.aggregate("mean_vector", F.lit(0.0), lambda a, x: a + x * x))
    return g.select("g", F.round(norm, 6).alias("norm"), F.round(F.array_max("mean_vector"), 6).alias("top"), "label")


@query("""WITH e AS (SELECT vec_id // 4 AS g, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings) SELECT g, dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY g, dim""")
def window_group_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the mean vectors that window_group_mean shows by norm and maximum."""
    e = _table(spark, sf_dir, "embeddings").withColumn("g", F.expr("vec_id div 4"))
    means = relations.group_mean(e, "g", "embedding", "vec_id", "label")
    return means.select("g", F.posexplode("mean_vector").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


D_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"


@query(f"WITH g AS (SELECT DISTINCT {D_SPLIT} AS split, lang FROM documents) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM g a JOIN g b ON a.lang = b.lang AND a.split < b.split GROUP BY 1, 2")
def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    split = F.when(k < 8, "train").when(k == 8, "val").otherwise("test")
    return relations.split_overlap(_table(spark, sf_dir, "documents").select(split.alias("split"), "lang"), "split", "lang")


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, max(o_orderdate) AS last FROM orders GROUP BY 1".replace("count(*) / sum(count(*)) OVER ()", "round(count(*) / sum(count(*)) OVER (), 6)").replace("max(o_orderdate) AS last", "CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last"))
def temporal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    split = F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"), "train").otherwise("test")
    g = _table(spark, sf_dir, "orders").groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).cast("string").alias("last"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""WITH q AS (SELECT quantile_cont(length(text), 0.05) AS a, quantile_cont(length(text), 0.33) AS b, quantile_cont(length(text), 0.66) AS c FROM documents),
k AS (SELECT CASE WHEN length(text) < a THEN NULL WHEN length(text) < b THEN 'short' WHEN length(text) < c THEN 'medium' ELSE 'long' END AS bucket FROM documents, q)
SELECT bucket, count(*) AS n FROM k WHERE bucket IS NOT NULL GROUP BY bucket""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "documents").select(F.length("text").alias("n"))
    cuts = [F.lit(x) for x in n.agg(F.percentile("n", F.array(F.lit(0.05), F.lit(0.33), F.lit(0.66)))).first()[0]]
    return n.select(relations.length_buckets(F.col("n"), cuts).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


D_PROMPT = "p AS (SELECT doc_id, text, CAST(greatest(1, least(length(text) - 1, 129)) AS INTEGER) AS k FROM documents WHERE length(text) > 1)"


@query(f"WITH {D_PROMPT} SELECT doc_id, k AS prompt_len, md5(substr(text, 1, k)) AS prompt, md5(substr(text, k + 1)) AS ground_truth FROM p")
def prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.prompt_split(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 129)
    return rows.select("doc_id", "prompt_len", F.md5("prompt").alias("prompt"), F.md5("ground_truth").alias("ground_truth"))


@query("""WITH t AS (SELECT doc_id, substr(text, 1, 20) AS p, CASE WHEN doc_id % 4 = 0 THEN text END AS a, CASE WHEN doc_id % 4 = 1 THEN lang || text END AS b, CASE WHEN doc_id % 4 = 2 THEN source END AS c, text AS d FROM documents)
SELECT doc_id, md5(coalesce(CASE WHEN p <> '' AND starts_with(a, p) THEN substr(a, length(p) + 1) ELSE a END, b, c, CASE WHEN p <> '' AND starts_with(d, p) THEN substr(d, length(p) + 1) ELSE d END)) AS digest FROM t""")
def continuation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    made = [F.when(k == 0, F.col("text")), F.when(k == 1, F.concat("lang", "text")), F.when(k == 2, F.col("source")), F.col("text")]
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(relations.continuation(made, F.substring("text", 1, 20))).alias("digest"))


@query("SELECT d.doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.unfinished(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


@query("WITH b AS (SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT r_name, CAST(r_regionkey AS BIGINT) FROM region) SELECT name, k, row_number() OVER (ORDER BY name, k) AS idx FROM b")
def append_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"))
    b = _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("k"))
    return relations.append_reindexed(a, b, ["name", "k"])


# --- sequence functions -------------------------------------------------------------------------------------------

REVCOMP = "reverse(translate(text, '{0}', '{1}'))"


def _column(name: str, build, oracle: str | None) -> None:
    """A query that shows a text column function by digest."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "documents").select("doc_id", F.md5(build(F.col("text"))).alias("digest"))

    run.__name__ = name
    query(f"SELECT doc_id, md5({oracle}) AS digest FROM documents" if oracle else None)(run)


def _both(pair: tuple[str, str]) -> tuple[str, str]:
    return pair[0] + pair[0].lower(), pair[1] + pair[1].lower()


D_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
D_UP = f"upper(replace(trim(text, {D_WS}), 'ß', 'SS'))"
D_DNA = f"replace({D_UP}, 'U', 'T')"
_column("revcomp_iupac", lambda c: sq.reverse_complement(c), REVCOMP.format(*_both(sq.COMPLEMENT_IUPAC)))
_column("revcomp", lambda c: sq.reverse_complement(c, iupac=False), REVCOMP.format(*_both(sq.COMPLEMENT_PLAIN)))
_column("clean_drop", sq.clean_drop, f"regexp_replace({D_DNA}, '[^ACGTN]', '', 'g')")
_column("clean_mask", sq.clean_mask, f"regexp_replace({D_DNA}, '[^ACGTN]', 'N', 'g')")
_column("to_rna", sq.to_rna, f"replace({D_UP}, 'T', 'U')")
_column("unspaced_upper", sq.unspaced_upper, "upper(replace(regexp_replace(text, '\\s', '', 'g'), 'ß', 'SS'))")
_column("keep_alphabet", sq.keep_alphabet, "CASE WHEN regexp_replace(text, '[^ACGTNacgtn]', '', 'g') <> '' THEN regexp_replace(text, '[^ACGTNacgtn]', '', 'g') ELSE upper(text) END")
_column("seq_type", sq.sequence_type, "CASE WHEN regexp_full_match(upper(text), '[ACGTUN-]*') THEN 'gene' ELSE 'prot' END")
_column("six_cut", sq.six_cut, "substr(text, 1, CAST(length(text) // 6 * 6 AS BIGINT))")
_column("kmer_text", lambda c: sq.kmer_text(F.translate(c, " ", "_"), 6), None)
_column("char_tokens", lambda c: F.array_join(sq.char_tokens(c), "|"), "array_to_string(string_split(upper(replace(text, 'ß', 'SS')), ''), '|')")
D_TOK = "upper(replace(regexp_replace(text, '\\s', '', 'g'), 'ß', 'SS'))"
D_PAD = f"{D_TOK} || repeat('N', CAST((6 - length({D_TOK}) % 6) % 6 AS BIGINT))"
_column("kmer_tokens", lambda c: F.array_join(sq.fixed_tokens(c, 6), "|"), f"array_to_string(regexp_extract_all({D_PAD}, '.{{6}}'), '|')")
_column("align6", lambda c: sq.six_align(c)["aligned"], "repeat('A', CAST((6 - length(text) % 6) % 6 AS BIGINT)) || text")
D_256 = "substr(upper(replace(substr(text, 1, 300), 'ß', 'SS')), 1, 256)"
_column("token_encode", lambda c: F.array_join(F.transform(sq.encode_tokens(sq.char_tokens(F.substring(c, 1, 300)), sq.BASE_IDS, 5, 256), lambda i: i.cast("string")), " "), f"array_to_string(list_transform(list_concat(list_transform(string_split({D_256}, ''), lambda c: coalesce(list_position(['A','C','G','T','N'], c), 5)), list_transform(range(0, 256 - length({D_256})), lambda i: 0)), lambda v: CAST(v AS VARCHAR)), ' ')")

CODON_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sq.CODONS.items()) + "}"


def _translate_oracle(start: str) -> str:
    return f"""WITH {D_SEQ}, c AS (SELECT doc_id, regexp_replace(seq, '[^ACGTN]', '', 'g') AS c FROM s), o AS (SELECT doc_id, c, substr(c, {start}) AS r FROM c),
a AS (SELECT doc_id, c, string_split(array_to_string(list_transform(range(0, length(r) // 3), lambda i: coalesce({CODON_MAP}[substr(r, CAST(i * 3 + 1 AS BIGINT), 3)], 'X')), ''), '*')[1] AS aa FROM o)
SELECT doc_id, CASE WHEN length(c) < 3 OR aa = '' THEN 'X' ELSE aa END AS protein FROM a"""


@query(_translate_oracle("greatest(1, strpos(c, 'ATG'))"))
def translate_first_orf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("doc_id", sq.translate_codons("seq").alias("protein"))


@query(_translate_oracle("2"))
def translate_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("doc_id", sq.translate_codons("seq", "fixed_frame", 1).alias("protein"))


@query("SELECT page_id, nullif(regexp_extract(u, '^(?:chr)?([0-9XYM]+):[0-9]+-[0-9]+:[+-]$', 1), '') AS chrom, CASE WHEN page_id % 4 <> 0 THEN page_id END AS start, CASE WHEN page_id % 4 <> 0 THEN page_id + 100 END AS stop, CASE WHEN page_id % 4 <> 0 THEN CASE WHEN page_id % 2 = 0 THEN '+' ELSE '-' END END AS strand FROM (SELECT page_id, 'chr' || (page_id % 22 + 1) || ':' || page_id || '-' || (page_id + 100) || CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 2 = 0 THEN ':+' ELSE ':-' END AS u FROM pages)")
def locus_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    u = F.concat(F.lit("chr"), (k % 22 + 1).cast("string"), F.lit(":"), k.cast("string"), F.lit("-"), (k + 100).cast("string"), F.when(k % 4 == 0, "").when(k % 2 == 0, ":+").otherwise(":-"))
    return _table(spark, sf_dir, "pages").select("page_id", sq.locus(u).alias("l")).select("page_id", "l.*")


# --- similarity and spectra ---------------------------------------------------------------------------------------

D_PAIR = "t AS (SELECT a.doc_id, regexp_replace(a.seq, '[^ -~]', '#', 'g') AS t, regexp_replace(b.seq, '[^ -~]', '#', 'g') AS m FROM s a JOIN s b ON b.doc_id = a.doc_id + 1), pr AS (SELECT doc_id, t, substr(m, 1, length(t)) AS m, m AS whole FROM t)"


#: Tasks of pairs of texts for each core and for each partition of the input.
TASKS = 3


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t, whole (the text after it) and m, which is whole cut to the length of t."""
    # Other characters are masked: the oracle's edit distance counts bytes.
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    s = docs.select("doc_id", letters.masked(F.lower("text"), dict(zip(ABC, FOLD))).alias("t"))
    # Pairs take long for their bytes: partitions are not merged by size, so that no core gets all of the longest texts.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism, TASKS * docs.rdd.getNumPartitions())
    after = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("whole"))
    both = s.repartition(n, "doc_id").join(after.repartition(n, "doc_id"), "doc_id")
    return both.select("doc_id", "t", "whole", F.substring(F.col("whole"), F.lit(1), F.length("t")).alias("m"))


@query(f"WITH {D_SEQ}, {D_PAIR} SELECT doc_id, round(CASE WHEN length(t) > 0 AND length(t) = length(m) THEN CAST(len(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) = substr(m, i, 1))) AS DOUBLE) / length(t) ELSE 0 END, 9) AS exact_match FROM pr")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", F.round(scores.exact_match(F.col("t"), F.col("m")), 9).alias("exact_match"))


@query(f"WITH {D_SEQ}, {D_PAIR} SELECT doc_id, round(CASE WHEN length(t) > 0 THEN levenshtein(t, m) / CAST(length(t) AS DOUBLE) ELSE 0 END, 9) AS edit_distance FROM pr")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", F.round(scores.edit_distance(F.col("t"), F.col("m")), 9).alias("edit_distance"))


@query()
def alignment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", scores.alignment_score("t", "m").alias("alignment_identity"))


@query(f"WITH {D_SEQ}, k AS (SELECT doc_id, unnest(list_transform(range(1, length(seq) - 2), lambda i: substr(seq, i, 4))) AS kmer FROM s WHERE length(seq) >= 4) SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM k WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _sequences(spark, sf_dir).select("doc_id", F.explode(sq.kmers("seq", 4)).alias("kmer")).groupBy("kmer", "doc_id").agg(F.count("*").alias("c"))
    return k.groupBy("kmer").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


def _spectrum_oracle(name: str, column: str, source: str, k: str) -> str:
    return f"""{name}_w AS (SELECT doc_id, CAST({k} AS BIGINT) AS k, {column} AS x FROM {source}), {name}_k AS (SELECT doc_id, k, unnest(list_transform(range(1, length(x) - k + 2), lambda i: substr(x, i, k))) AS w FROM {name}_w),
{name}_c AS (SELECT doc_id, k, w, count(*) AS i FROM {name}_k WHERE regexp_full_match(w, '[ACGT]+') GROUP BY ALL), {name}_f AS (SELECT doc_id, k, i, count(*) AS f FROM {name}_c GROUP BY ALL),
{name} AS (SELECT doc_id, k, i, f / pow(4.0::DOUBLE, k) AS p FROM {name}_f UNION ALL SELECT doc_id, k, 0, 1 - coalesce(t, 0) / pow(4.0::DOUBLE, k) FROM {name}_w LEFT JOIN (SELECT doc_id, sum(f) AS t FROM {name}_f GROUP BY 1) USING (doc_id))"""


@query(f"WITH {D_SEQ}, {_spectrum_oracle('q', 'seq', 's', '3')} SELECT doc_id, CAST(k AS INTEGER) AS k, i, round(p, 9) AS p FROM q")
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return metrics.kmer_spectrum(_sequences(spark, sf_dir), "doc_id", "seq", F.lit(3)).withColumn("p", F.round("p", 9))


D_AUTO_K = "CASE " + " ".join(f"WHEN e >= {n} THEN {k}" for k, n in reversed(list(enumerate(sq.K_THRESHOLDS, 2)))) + " ELSE 1 END"
D_DIST = f"""{D_SEQ}, {D_PAIR}, e AS (SELECT *, least(length(regexp_replace(t, '[^ACGT]', '', 'g')), length(regexp_replace(m, '[^ACGT]', '', 'g'))) AS e FROM pr WHERE length(t) > 0 AND length(m) > 0), ek AS (SELECT *, {D_AUTO_K} AS kk FROM e),
{_spectrum_oracle('sp', 't', 'ek', 'kk')}, {_spectrum_oracle('sq', 'm', 'ek', 'kk')},
j AS (SELECT doc_id, i, coalesce(sp.p, 0) AS p, coalesce(sq.p, 0) AS q FROM sp FULL JOIN sq USING (doc_id, i)),
g AS (SELECT doc_id, abs(sum(p) OVER w - sum(q) OVER w) AS gap, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 1) AS width, greatest(least(p, 1), 1e-12) AS a, greatest(least(q, 1), 1e-12) AS b, greatest(least((p + q) / 2, 1), 1e-12) AS m FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
dist AS (SELECT doc_id, max(gap) AS kmer_ks, sum(0.5 * (a * log2(a / m) + b * log2(b / m))) AS kmer_jsd, sum(gap * width) AS kmer_emd FROM g GROUP BY doc_id)"""


@query(f"WITH {D_DIST} SELECT doc_id, CAST(kk AS INTEGER) AS kmer_k, round(kmer_ks, 6) AS kmer_ks, round(kmer_jsd, 6) AS kmer_jsd, round(kmer_emd, 6) AS kmer_emd FROM ek JOIN dist USING (doc_id)")
def kmer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).where("t <> '' and m <> ''").withColumn("k", metrics.pair_k(F.col("t"), F.col("m")))
    d = spectra.spectrum_distances(F.col("t"), F.col("m"), F.col("k"))
    return p.select("doc_id", F.col("k").alias("kmer_k"), d.alias("d")).select("doc_id", "kmer_k", *[F.round(F.col("d")[c], 6).alias(c) for c in ("kmer_ks", "kmer_jsd", "kmer_emd")])


def _cds_oracle(x: str) -> str:
    return f"(length({x}) >= 3 AND length({x}) % 3 = 0 AND right({x}, 3) IN ('TAA', 'TAG', 'TGA') AND len(list_filter(range(0, length({x}) // 3 - 1), lambda i: substr({x}, CAST(i * 3 + 1 AS BIGINT), 3) IN ('TAA', 'TAG', 'TGA'))) = 0)"


@query(f"""WITH {D_SEQ}, c AS (SELECT doc_id, unnest(regexp_extract_all(seq, '[ACGT]{{3,}}')) AS x FROM s), n AS (SELECT doc_id, count(*) AS n_runs, count(*) FILTER (WHERE {_cds_oracle('x')}) AS n_cds FROM c GROUP BY doc_id)
SELECT doc_id, {_cds_oracle('seq')} AS is_cds, coalesce(n_runs, 0) AS n_runs, coalesce(n_cds, 0) AS n_cds FROM s LEFT JOIN n USING (doc_id)""")
def cds_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a whole text is a coding region, and how many of its runs of three and more bases are."""
    s = _sequences(spark, sf_dir).select("doc_id", "seq", F.regexp_extract_all("seq", F.lit("[ACGT]{3,}"), F.lit(0)).alias("runs"))
    coding = F.size(F.filter("runs", sq.is_coding_region)).cast("long")
    return s.select("doc_id", sq.is_coding_region("seq").alias("is_cds"), F.size("runs").cast("long").alias("n_runs"), coding.alias("n_cds"))


D_ROWS = f"""{D_DIST}, r AS (SELECT pr.doc_id, CASE WHEN length(t) > 0 AND length(m) > 0 THEN levenshtein(t, m) / CAST(length(t) AS DOUBLE) ELSE 'NaN'::DOUBLE END AS edit_distance,
CASE WHEN length(t) > 0 AND length(t) = length(m) THEN CAST(len(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) = substr(m, i, 1))) AS DOUBLE) / length(t) WHEN t = '' AND m = '' THEN 1 ELSE 0 END AS exact_match_acc,
coalesce(kmer_jsd, 'NaN'::DOUBLE) AS kmer_jsd, coalesce(kmer_ks, 'NaN'::DOUBLE) AS kmer_ks, {_cds_oracle('whole')} AS is_cds FROM pr LEFT JOIN dist USING (doc_id))"""


@query(f"WITH {D_ROWS} SELECT doc_id, round(edit_distance, 6) AS edit_distance, round(exact_match_acc, 6) AS exact_match_acc, round(kmer_jsd, 6) AS kmer_jsd, round(kmer_ks, 6) AS kmer_ks, is_cds FROM r")
def completion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = completion.row_metrics(_pairs(spark, sf_dir), "doc_id", "t", "whole")
    return r.select("doc_id", *[F.round(c, 6).alias(c) for c in ("edit_distance", "exact_match_acc", "kmer_jsd", "kmer_ks")], "is_cds")


@query(f"WITH {D_ROWS} SELECT count(*) AS count, " + ", ".join(f"round({f}(CASE WHEN isfinite({m}) THEN {m} END), 5) AS {m}_{n}" for m in ("edit_distance", "exact_match_acc", "kmer_jsd", "kmer_ks") for f, n in (("avg", "mean"), ("median", "median"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))) + ", count(CASE WHEN is_cds THEN 1 END) AS is_cds_count, round(avg(CASE WHEN is_cds THEN 1.0::DOUBLE ELSE 0 END), 5) AS is_cds_ratio FROM r")
def completion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = completion.summary(completion.row_metrics(_pairs(spark, sf_dir), "doc_id", "t", "whole"))
    return s.select(*[F.round(c, 5).alias(c) if t == "double" else c for c, t in s.dtypes])


# --- classification -----------------------------------------------------------------------------------------------

D_SOFT = "list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z)))))"


@query(f"WITH {D_PRED} SELECT vec_id, label AS true_label_id, pred AS predicted_label_id, round(list_max({D_SOFT}), 6) AS confidence FROM p")
def argmax_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    return p.select("vec_id", F.col("label").alias("true_label_id"), F.col("pred").alias("predicted_label_id"), F.round(F.array_max(scores.softmax(F.col("z"))), 6).alias("confidence"))


@query(f"WITH {D_PRED} SELECT label, pred, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir))


D_REPORT = f"""{D_PRED}, u AS (SELECT DISTINCT unnest([label, pred]) AS class FROM p), t AS (SELECT class, (SELECT count(*) FROM p WHERE label = class AND pred = class) AS tp, (SELECT count(*) FROM p WHERE label = class) AS support, (SELECT count(*) FROM p WHERE pred = class) AS predicted FROM u),
r AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1, support, tp, predicted FROM t)"""


@query(f"WITH {D_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.class_report(_predictions(spark, sf_dir))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {D_REPORT} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(tp) / sum(support), 6) AS f1_micro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro FROM r")
def accuracy_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = metrics.overall(_predictions(spark, sf_dir))
    return o.select(*[F.round(c, 6).alias(c) for c in o.columns])


@query(f"WITH {D_REPORT} SELECT round(CASE WHEN (sum(support)^2 - sum(predicted^2)) * (sum(support)^2 - sum(support^2)) = 0 THEN 0 ELSE (sum(tp) * sum(support) - sum(support * predicted)) / sqrt((sum(support)^2 - sum(predicted^2)) * (sum(support)^2 - sum(support^2))) END, 6) AS mcc FROM r")
def mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mcc(_predictions(spark, sf_dir)).select(F.round("mcc", 6).alias("mcc"))


D_OVR = f"{D_Z}, o AS (SELECT label, generate_subscripts(z, 1) - 1 AS class, unnest({D_SOFT}) AS score FROM z), b AS (SELECT class, score, CASE WHEN label = class THEN 1 ELSE 0 END AS y FROM o)"


@query(f"""WITH {D_OVR}, k AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS r FROM b),
a AS (SELECT class, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) AS auroc FROM k GROUP BY class) SELECT CAST(class AS INTEGER) AS class, round(auroc, 6) AS auroc FROM a""")
def auroc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(metrics.one_vs_rest(_logits(spark, sf_dir), "z")).select("class", F.round("auroc", 6).alias("auroc"))


@query(f"""WITH {D_OVR}, t AS (SELECT class, score, sum(y) AS p, count(*) AS n FROM b GROUP BY class, score), c AS (SELECT class, p, sum(p) OVER w AS tp, sum(n) OVER w AS a FROM t WINDOW w AS (PARTITION BY class ORDER BY score DESC))
SELECT CAST(class AS INTEGER) AS class, round(coalesce(sum(p * tp / a) / nullif(sum(p), 0), 0), 6) AS auprc FROM c GROUP BY class""")
def auprc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auprc(metrics.one_vs_rest(_logits(spark, sf_dir), "z")).select("class", F.round("auprc", 6).alias("auprc"))


@query("""WITH b AS (SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, CASE WHEN 1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) >= 0.5 THEN 1 ELSE 0 END AS p FROM embeddings),
c AS (SELECT CAST(count(*) FILTER (y = 1 AND p = 1) AS DOUBLE) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, CAST(count(*) FILTER (y = 0 AND p = 0) AS DOUBLE) AS tn FROM b)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("label") >= 5
    p = scores.sigmoid(F.col("embedding")[0].cast("double")) >= 0.5
    out = metrics.binary(_table(spark, sf_dir, "embeddings").select(y.alias("label"), p.alias("pred")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


D_MACRO = f"""{D_OVR}, k AS (SELECT class, y, score, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS r FROM b),
a AS (SELECT class, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auroc FROM k GROUP BY class),
t AS (SELECT class, score, sum(y) AS p, count(*) AS n FROM b GROUP BY class, score), c AS (SELECT class, p, sum(p) OVER w AS tp, sum(n) OVER w AS a FROM t WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
v AS (SELECT class, sum(p * tp / a) / nullif(sum(p), 0) AS ap FROM c GROUP BY class)"""


@query(f"WITH {D_MACRO} SELECT (SELECT CASE WHEN count(*) = count(auroc) THEN round(avg(auroc), 6) END FROM a) AS auc_macro_ovr, (SELECT round(avg(coalesce(ap, 0)), 6) FROM v) AS auprc_macro")
def ranking_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking(metrics.one_vs_rest(_logits(spark, sf_dir), "z")).select(F.round("auc_macro_ovr", 6).alias("auc_macro_ovr"), F.round("auprc_macro", 6).alias("auprc_macro"))


@query(f"""WITH {D_REPORT}, w AS (SELECT CAST(sum(support) AS BIGINT) AS total, sum(tp) / sum(support) AS accuracy FROM r)
SELECT CAST(class AS VARCHAR) AS name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
UNION ALL SELECT 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), total FROM w
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""")
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.full_report(_predictions(spark, sf_dir))
    return r.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {D_PRED}, c AS (SELECT label, pred, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT DISTINCT unnest([label, pred]) AS class FROM p) SELECT a.class AS label, b.class AS pred, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.label = a.class AND c.pred = b.class")
def confusion_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_filled(_predictions(spark, sf_dir))


@query(f"""WITH {D_PRED}, m AS (SELECT doc_id, lang, n_chars FROM documents) SELECT vec_id, label AS true_label_id, 'class_' || label AS true_label, pred AS predicted_label_id, 'class_' || pred AS predicted_label,
round(list_max({D_SOFT}), 6) AS confidence, m.lang, m.n_chars FROM p LEFT JOIN m ON m.doc_id = vec_id""")
def predictions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("label_id")).distinct().select("label_id", F.concat(F.lit("class_"), "label_id").alias("label"))
    meta = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars")
    out = relations.predictions(_predictions(spark, sf_dir), names, meta, "vec_id", "z")
    return out.withColumn("confidence", F.round("confidence", 6))


@query("SELECT event_type AS split, round(avg(v), 6) AS mean_metric FROM (SELECT event_type, user_id % 7 AS task, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type")
def task_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("split"), (F.col("user_id") % 7).alias("task")).agg(F.avg("value").alias("v"))
    return tasks.groupBy("split").agg(F.round(F.avg("v"), 6).alias("mean_metric"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12 AS n FROM e)
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(unnest(v) / n, 6) AS x FROM n""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = scores.l2_normalised(F.col("embedding"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(u).alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean_0, round(max(CAST(embedding[1] AS DOUBLE)), 6) AS max_0, round(min(CAST(embedding[1] AS DOUBLE)), 6) AS min_0, round(CAST(min_by(embedding[1], vec_id) AS DOUBLE), 6) AS cls_0, round(CAST(max_by(embedding[1], vec_id) AS DOUBLE), 6) AS final_0 FROM embeddings GROUP BY label")
def pool_mean_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place 0 of each pool, as its SQL has it; pool_vectors shows all places."""
    pools = relations.pool(_table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")
    return pools.select("label", *[F.round(F.col(n)[0], 6).alias(f"{n}_0") for n in relations.POOLS])


@query("""WITH e AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings)
SELECT label, dim, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(min(x), 6) AS min, round(min_by(x, vec_id), 6) AS cls, round(max_by(x, vec_id), 6) AS final FROM e GROUP BY label, dim""")
def pool_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = relations.pool(_table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")
    cells = pools.select("label", F.posexplode(F.arrays_zip(*relations.POOLS)).alias("dim", "x"))
    return cells.select("label", "dim", *[F.round(F.col("x")[n], 6).alias(n) for n in relations.POOLS])


@query("""WITH RECURSIVE e AS (SELECT user_id % 20 AS run, event_id AS e, value AS m, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events),
f AS (SELECT run, 0::BIGINT AS k, -1.0::DOUBLE AS best, -1::BIGINT AS seen_at, 0 AS bad, -1::BIGINT AS stop FROM (SELECT DISTINCT run FROM e) UNION ALL
SELECT f.run, e.k, CASE WHEN e.m > best + 0.5 THEN e.m ELSE best END, CASE WHEN e.m > best + 0.5 THEN e.e ELSE seen_at END, CASE WHEN e.m > best + 0.5 THEN 0 ELSE bad + 1 END, CASE WHEN NOT e.m > best + 0.5 AND bad + 1 >= 5 THEN e.e ELSE -1 END
FROM f JOIN e ON e.run = f.run AND e.k = f.k + 1 WHERE f.stop < 0),
l AS (SELECT run, max(k) AS k FROM f GROUP BY run) SELECT run, best, seen_at AS best_epoch, nullif(stop, -1) AS stopped FROM f JOIN l USING (run, k)""")
def early_stop_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), "event_id", "value")
    return metrics.early_stop(e, "run", "event_id", "value", 0.5, 5)


@query("""WITH RECURSIVE e AS (SELECT user_id % 3 AS run, event_id AS e, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 <> 0 THEN value END AS m FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY e) AS k FROM e),
f AS (SELECT run, 0::BIGINT AS k, -1.0::DOUBLE AS best, -1::BIGINT AS seen_at, 0 AS bad, -1::BIGINT AS stop FROM (SELECT DISTINCT run FROM e) UNION ALL
SELECT run, k, CASE WHEN up THEN m ELSE best END, CASE WHEN up THEN e ELSE seen_at END, CASE WHEN up THEN 0 ELSE bad + 1 END, CASE WHEN NOT up AND bad + 1 >= 1000 THEN e ELSE -1 END
FROM (SELECT f.run, k.k, k.e, k.m, best, seen_at, bad, coalesce(NOT isnan(k.m) AND k.m > best + 0.5, false) AS up FROM f JOIN k ON k.run = f.run AND k.k = f.k + 1 WHERE f.stop < 0)),
l AS (SELECT run, max(k) AS k FROM f GROUP BY run) SELECT run, best, seen_at AS best_epoch, nullif(stop, -1) AS stopped FROM f JOIN l USING (run, k)""")
def early_stop_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three long runs, a seventh of whose metrics are NaN and an eleventh null."""
    m = F.when(F.col("event_id") % 7 == 0, scores.nan()).when(F.col("event_id") % 11 != 0, F.col("value"))
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("run"), "event_id", m.alias("m"))
    return metrics.early_stop(e, "run", "event_id", "m", 0.5, 1000)


@query("""WITH b AS (SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 2) AS score FROM embeddings),
k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM b),
t AS (SELECT score, sum(y) AS p, count(*) AS n FROM b GROUP BY score), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS a FROM t WINDOW w AS (ORDER BY score DESC))
SELECT (SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) FROM k) AS auroc, (SELECT round(sum(p * tp / a) / sum(p), 6) FROM c) AS auprc""")
def binary_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of a binary task with many ties: scores rounded to two places."""
    score = F.round(scores.sigmoid(F.col("embedding")[0].cast("double")), 2)
    out = metrics.binary_ranking(_table(spark, sf_dir, "embeddings").select((F.col("label") >= 5).alias("label"), score.alias("score")))
    return out.select(*[F.round(c, 6).alias(c) for c in ("auroc", "auprc")])


@query()
def lr_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return heads.logistic_head(e.where("vec_id % 10 < 8"), e.where("vec_id % 10 = 9"), "embedding", "label").select("vec_id", "label", "pred")


@query()
def perceptron_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of three hidden layers on the same rows as lr_head."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return heads.perceptron_head(e.where("vec_id % 10 < 8"), e.where("vec_id % 10 = 9"), "embedding", "label", 10).select("vec_id", "label", "pred")


# --- plans over tokens, provider outputs, audits ------------------------------------------------------------------

D_LEN = "l AS (SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents)"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))


@query(f"""WITH {D_LEN}, k AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 512) / 200.0::DOUBLE)) AS BIGINT) + 1)) AS k FROM l WHERE n > 0),
e AS (SELECT doc_id, k, least(k * 200 + 512, n) AS e, CASE WHEN k = 0 THEN 0 ELSE least((k - 1) * 200 + 512, n) END AS p FROM k)
SELECT doc_id, greatest(0, e - 512) AS "begin", e AS "end", greatest(0, e - greatest(p, greatest(0, e - 512), 128)) AS scored FROM e""")
def end_aligned_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.end_aligned_plan(_lengths(spark, sf_dir), "doc_id", "n", 512, 200, 128)


@query(f"""WITH {D_LEN}, k AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 512) / 200.0::DOUBLE)) AS BIGINT) + 1)) AS k FROM l WHERE n > 0)
SELECT doc_id, k * 200 AS "begin", least(k * 200 + 512, n) AS "end", least(200, least(k * 200 + 512, n) - k * 200) AS scored FROM k""")
def last_stride_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.last_stride_plan(_lengths(spark, sf_dir), "doc_id", "n", 512, 200)


@query(f"""WITH {D_LEN}, k AS (SELECT doc_id, n, unnest(range(128, n, 200)) AS a FROM l WHERE n > 512), e AS (SELECT doc_id, a, least(a + 200, n) AS e FROM k UNION ALL SELECT doc_id, 128, n FROM l WHERE n > 128 AND n <= 512)
SELECT doc_id, greatest(0, e - 512) AS "begin", CAST(e AS BIGINT) AS "end", a - greatest(0, e - 512) - 1 AS "first", e - greatest(0, e - 512) - 1 AS "last" FROM e""")
def token_range_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.range_plan(_lengths(spark, sf_dir), "doc_id", "n", 512, 200, 128)


@query("""SELECT event_type AS source, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max, count(*) AS count, count(*) AS valid_count
FROM (SELECT event_type, round(value, 4) AS x FROM events WHERE event_id % 7 <> 0) GROUP BY event_type""")
def recompute_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 7 == 0, scores.nan()).otherwise(F.col("value"))
    return likelihood.recompute_summary(_table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), v.alias("v")), "v", "source")


@query("""WITH e AS (SELECT event_id, value / ln(3.0::DOUBLE) AS value, event_id % 50 AS tok, event_id % 90 AS chars FROM events)
SELECT event_id, CASE WHEN tok > 0 THEN round(value / tok, 6) ELSE 'NaN'::DOUBLE END AS avg_nll_token, CASE WHEN chars > 0 THEN round(value / chars, 6) ELSE 'NaN'::DOUBLE END AS avg_nll_char,
CASE WHEN tok > 0 THEN round(ln(exp(value / tok)), 6) ELSE 'NaN'::DOUBLE END AS log_ppl_token, CASE WHEN chars > 0 THEN round(ln(exp(value / chars)), 6) ELSE 'NaN'::DOUBLE END AS log_ppl FROM e""")
def perplexity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexities by their logarithms: those of single tokens are too large to round. The divisor keeps ties away."""
    k = F.col("event_id")
    p = scores.perplexity_fields(F.col("value") / F.log(F.lit(3.0)), k % 50, k % 90, "char")
    e = _table(spark, sf_dir, "events").select("event_id", p.alias("p"))
    shown = {"avg_nll_token": F.col("p.avg_nll_token"), "avg_nll_char": F.col("p.avg_nll_char"), "log_ppl_token": F.log("p.ppl_token"), "log_ppl": F.log("p.ppl")}
    return e.select("event_id", *[F.round(c, 6).alias(n) for n, c in shown.items()])


D_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(vec_id % 70 AS BIGINT) AS n FROM embeddings)"


@query(f"""WITH {D_VEC} SELECT vec_id, round(coalesce(list_avg(v[1:greatest(0, least(n - 1, 64))]), 0), 6) AS log_prob,
round(coalesce(list_avg(list_filter(v, lambda x: x > 0.1)), 0), 6) AS masked, coalesce(round(list_avg(list_filter(v, lambda x: x > 0.3)), 6), 'NaN'::DOUBLE) AS pseudo FROM v""")
def token_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the tokens of a row: the first ones, those of a mask (0 for none), those of another (NaN for none)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    mask = lambda t: F.transform(v, lambda x: (x > t).cast("int"))
    made = {"log_prob": scores.mean_log_prob(v, (F.col("vec_id") % 70).cast("int")), "masked": scores.masked_mean(v, mask(0.1)), "pseudo": scores.masked_mean(v, mask(0.3), float("nan"))}
    return _table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query("""WITH e AS (SELECT vec_id // 4 AS g, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings)
SELECT g, dim, round(avg(0.5 * (x + y)), 6) AS mean, round(max(0.5 * (x + y)), 6) AS max FROM e GROUP BY g, dim""")
def chunk_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of chunks averaged with those of another pass (here the same ones reversed), then reduced per sequence."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = _table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("g"), "vec_id", scores.averaged(v, F.reverse(v)).alias("z"))
    mean, top = relations.reduce_chunks(e, "g", "z", "vec_id"), relations.reduce_chunks(e, "g", "z", "vec_id", "max").withColumnRenamed("z", "top")
    cells = mean.join(top, "g").select("g", F.posexplode(F.arrays_zip("z", "top")).alias("dim", "x"))
    return cells.select("g", "dim", F.round("x.z", 6).alias("mean"), F.round("x.top", 6).alias("max"))


@query("""WITH e AS (SELECT vec_id // 8 AS g, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, vec_id % 3 <> 0 AND vec_id // 8 % 5 <> 0 AS ok FROM embeddings),
m AS (SELECT g, dim, coalesce(avg(x) FILTER (ok), 0) AS mean, coalesce(max(x) FILTER (ok), max(x)) AS max, coalesce(min(x) FILTER (ok), min(x)) AS min, min_by(x, vec_id) AS cls, coalesce(max_by(x, vec_id) FILTER (ok), max_by(x, vec_id)) AS final FROM e GROUP BY g, dim)
SELECT g, dim, round(mean, 6) AS mean, round(max, 6) AS max, round(min, 6) AS min, round(cls, 6) AS cls, round(final, 6) AS final FROM m""")
def pool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors as the tokens of a row, some or all of them masked."""
    ok = ((F.col("vec_id") % 3 != 0) & (F.expr("vec_id div 8") % 5 != 0)).cast("int")
    rows = F.sort_array(F.collect_list(F.struct("vec_id", "embedding", ok.alias("ok"))))
    g = _table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 8").alias("g")).agg(rows.alias("t"))
    pools = g.select("g", *[scores.pooled(F.col("t.embedding"), n, F.col("t.ok")).alias(n) for n in relations.POOLS])
    cells = pools.select("g", F.posexplode(F.arrays_zip(*relations.POOLS)).alias("dim", "x"))
    return cells.select("g", "dim", *[F.round(F.col("x")[n], 6).alias(n) for n in relations.POOLS])


@query(f"WITH {D_VOCAB}, c AS (SELECT label_id, count(*) AS n FROM documents JOIN v ON trim(source) = label WHERE doc_id % 3 = 0 AND label_id < 12 GROUP BY label_id), w AS (SELECT label_id, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c) SELECT label_id, round(coalesce(weight, 1), 9) AS weight FROM v LEFT JOIN w USING (label_id)")
def full_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocabulary(spark, sf_dir)
    seen = relations.encode_labels(_table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("source"), v, "source").where("label_id < 12")
    return relations.full_weights(v, relations.class_weights(seen)).select("label_id", F.round("weight", 9).alias("weight"))


@query(f"WITH s AS (SELECT {D_SPLIT} AS split, count(*) AS n FROM documents GROUP BY 1) SELECT split, n, round(n / sum(n) OVER (), 6) AS share, abs(n / sum(n) OVER () - CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END) <= 0.02 AS as_wanted FROM s")
def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 10
    rows = _table(spark, sf_dir, "documents").select(F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split"))
    return relations.split_shares(rows, "split", {"train": 0.8, "val": 0.1, "test": 0.1}).withColumn("share", F.round("share", 6))


@query("""WITH s AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders), e AS (SELECT k, min(d) AS first, max(d) AS last FROM s GROUP BY k)
SELECT ['train', 'val', 'test'][a.k] AS earlier, ['train', 'val', 'test'][b.k] AS later, a.last AS last, b.first AS first, a.last <= b.first AS in_order FROM e a JOIN e b ON b.k = a.k + 1""")
def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), "train").when(F.col("o_orderkey") % 2 == 0, "val").otherwise("test")
    rows = _table(spark, sf_dir, "orders").select(split.alias("split"), F.to_date("o_orderdate").cast("string").alias("d"))
    return relations.time_order(rows, "split", "d", ["train", "val", "test"])


@query("SELECT lang, count(*) FILTER (quality >= 0) AS kept, count(*) FILTER (quality IS NULL) AS dropped FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def kept_and_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.attach_many_to_one(_table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return relations.kept_and_dropped(rows, F.col("quality") >= 0, "lang")


@query("SELECT event_id, CASE WHEN value > 400 THEN 'too large' WHEN event_id % 11 = 0 THEN 'no tokens' END AS error, CASE WHEN value > 400 OR event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value END AS bpb FROM events")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", F.col("value").alias("bpb"))
    return relations.with_errors(e, {"too large": F.col("bpb") > 400, "no tokens": F.col("event_id") % 11 == 0}, ["bpb"])


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"user":' || user_id || ',"note":"n' || event_id % 5 || '"}' WHEN event_id % 3 = 1 THEN '{"user":"u' || user_id || '","last":null}' ELSE '{"ok":true}' END AS kept FROM events""")
def scalar_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown scalar keys of records whose keys differ in kind and number from row to row."""
    k, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    note = F.concat(F.lit('{"bpb": 1.5, "user": '), user, F.lit(', "inner": {"a": [1]}, "note": "n'), (F.col("event_id") % 5).cast("string"), F.lit('"}'))
    named = F.concat(F.lit('{"user": "u'), user, F.lit('", "bpb": NaN, "last": null, "list": [1, 2]}'))
    text = F.when(k == 0, note).when(k == 1, named).otherwise(F.lit('{"ok": true, "bpb": null}'))
    kept = F.to_json(records.scalars(records.record(F.col("text")), ["bpb"]))
    return _table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", kept.alias("kept"))


@query(f"WITH {D_SEQ} SELECT doc_id, md5(seq) AS digest FROM s WHERE regexp_full_match(seq, '[ACGTN]+') UNION ALL SELECT doc_id, md5(regexp_replace(seq, '[^ACGTN]', '', 'g')) FROM s WHERE NOT regexp_full_match(seq, '[ACGTN]+') AND regexp_matches(seq, '[ACGTN]')")
def strict_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that pass the strict alphabet as they are, and others once their other letters are taken out."""
    rows = _sequences(spark, sf_dir)
    own = F.when(sq.is_strict_dna("seq"), F.col("seq")).otherwise(F.regexp_replace("seq", "[^ACGTN]", ""))
    return rows.select("doc_id", own.alias("seq")).where("seq <> ''").select("doc_id", F.md5(sq.strict_dna("seq")).alias("digest"))


@query("SELECT event_type, round(sum(value * (event_id % 64)) / sum(event_id % 64), 6) AS loss FROM events GROUP BY event_type")
def average_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = metrics.average_loss(F.col("value"), F.col("event_id") % 64)
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(loss, 6).alias("loss"))


# --- providers ----------------------------------------------------------------------------------------------------


@query(f"WITH {D_BPB} SELECT doc_id, round(avg_nll_token, 6) AS avg_nll_token, token_count, CAST(NULL AS VARCHAR) AS error FROM b WHERE token_count > 0")
def provider_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markov scorer as a provider that each worker sets up once."""
    seqs = _sequences(spark, sf_dir)
    out = providers.run(seqs.select("doc_id", "seq"), "markov", "seq", options=providers.fitted_markov(likelihood.markov_counts(seqs, "seq")))
    return out.where("token_count > 0").select("doc_id", F.round("avg_nll_token", 6).alias("avg_nll_token"), "token_count", "error")


@query(f"WITH {D_SEQ}, c AS (SELECT doc_id, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS n FROM s) SELECT doc_id, CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE round(gc / n, 9) END AS score FROM c")
def provider_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.run(_sequences(spark, sf_dir).select("doc_id", "seq"), "gc_share", "seq").select("doc_id", F.round("score", 9).alias("score"))


@query(f"""WITH {D_SEQ}, g AS (SELECT doc_id, unnest(list_transform(range(1, length(seq)), lambda i: substr(seq, i, 2))) AS w FROM s), c AS (SELECT doc_id, w, count(*) AS n FROM g WHERE regexp_full_match(w, '[ACGT]{{2}}') GROUP BY ALL),
l AS (SELECT a || b AS w, CAST(4 * i + j AS INTEGER) AS dim FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS a, unnest([0, 1, 2, 3]) AS i), (SELECT unnest(['A', 'C', 'G', 'T']) AS b, unnest([0, 1, 2, 3]) AS j)),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1) SELECT s.doc_id, l.dim, round(coalesce(n / total, 0), 9) AS x FROM s CROSS JOIN l LEFT JOIN c ON c.doc_id = s.doc_id AND c.w = l.w LEFT JOIN t ON t.doc_id = s.doc_id""")
def provider_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = providers.run(_sequences(spark, sf_dir).select("doc_id", "seq"), "kmer_profile", "seq")
    return out.select("doc_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 9))


@query(f"""WITH {D_SEQ} SELECT doc_id, CASE WHEN w = '' THEN length(seq) END AS length, CASE WHEN w <> '' OR seq = '' THEN 'NaN'::DOUBLE ELSE round(length(regexp_replace(seq, '[^A]', '', 'g')) / length(seq), 9) END AS share,
CASE WHEN w <> '' THEN 'not in ACGT: ' || w END AS error FROM (SELECT doc_id, seq, coalesce(list_min(list_filter(string_split(seq, ''), lambda x: x NOT IN ('A', 'C', 'G', 'T', ''))), '') AS w FROM (SELECT doc_id, substr(seq, 1, doc_id % 12) AS seq FROM s))""")
def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one, so that each row that the provider refuses fails alone."""
    starts = _sequences(spark, sf_dir).select("doc_id", F.expr("substring(seq, 1, cast(doc_id % 12 as int))").alias("seq"))
    out = providers.run(starts, "strict_length", "seq", batch=1)
    return out.select("doc_id", "length", F.round("share", 9).alias("share"), "error")


# --- several tasks ------------------------------------------------------------------------------------------------


@query()
def multitask_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heads on the same vectors; a third of the rows have no label of the second task."""
    label = F.col("label")
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("kind "), label).alias("kind"), F.when(F.col("vec_id") % 3 > 0, F.when(label >= 5, "high").otherwise("low")).alias("half"))
    train = e.where("vec_id % 10 < 8")
    ids = tasks.label_ids(tasks.vocabularies(train, ["kind", "half"]))
    heads_ = tasks.fit_heads(tasks.encoded(train, ids), "embedding", ["kind", "half"], weighted=True)
    return tasks.predictions(tasks.with_logits(tasks.encoded(e, ids), heads_, "embedding"), ids, "vec_id", [])


@query("""WITH m AS (SELECT event_type, user_id % 9 AS epoch, user_id % 7 AS task, avg(value) FILTER (event_type <> 'view' AND user_id % 4 = 0) AS auprc, avg(value) FILTER (event_id % 5 > 0) AS other FROM events GROUP BY ALL)
SELECT event_type, epoch, round(CASE WHEN coalesce(avg(auprc), -1) < 0 THEN coalesce(avg(other), -1) ELSE avg(auprc) END, 6) AS metric FROM m GROUP BY ALL""")
def watched_task_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over tasks, of the second metric where no task has the first."""
    value, user = F.col("value"), F.col("user_id")
    found = _table(spark, sf_dir, "events").groupBy("event_type", (user % 9).alias("epoch"), (user % 7).alias("task")).agg(
        F.avg(F.when((F.col("event_type") != "view") & (user % 4 == 0), value)).alias("auprc"), F.avg(F.when(F.col("event_id") % 5 > 0, value)).alias("auprc_macro_ovr"))
    return tasks.watched_mean(found, ["event_type", "epoch"], "auprc").withColumn("metric", F.round("metric", 6))


@query("""SELECT o_orderpriority AS model, round(coalesce(sum(o_totalprice), 0), 2) AS head_sec, round(coalesce(sum(CASE WHEN o_custkey % 3 > 0 THEN o_orderkey % 10 + 0.5 END), 0), 2) AS embed_sec,
round(coalesce(sum(o_totalprice), 0) + coalesce(sum(CASE WHEN o_custkey % 3 > 0 THEN o_orderkey % 10 + 0.5 END), 0), 2) AS total_sec FROM orders GROUP BY 1""")
def elapsed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderkey") % 10 + F.lit(0.5))
    runs = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_totalprice").cast("double").alias("head_sec"), embed.alias("embed_sec"))
    out = tasks.elapsed(runs, ["model"], ["head_sec", "embed_sec"])
    return out.select("model", *[F.round(c, 2).alias(c) for c in out.columns[1:]])


# --- tokens, cuts and marks of whole texts ------------------------------------------------------------------------

LETTER_IDS = {"A": 7, "C": 8, "G": 9, "T": 10}
RNA = {"A": 2, "U": 3, "G": 4, "C": 5}
# Letters outside ASCII become one sign each: the engines differ in their upper case.
D_ASCII = "s AS (SELECT doc_id, regexp_replace(seq, '[^ -~]', '#', 'g') AS seq FROM (SELECT doc_id, {SEQ} AS seq FROM documents))".replace("{SEQ}", SEQ)


def _ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("doc_id", F.regexp_replace("seq", "[^ -~]", "#").alias("seq"))


@query(f"WITH {D_ASCII} SELECT doc_id, CAST(length(seq) + 1 AS INTEGER) AS n_ids, md5(regexp_replace(upper(seq), '[^ACGT]', '', 'g')) AS decoded FROM s")
def token_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded letter by letter with an end mark, and decoded without the special ids."""
    small_batches(spark)
    rows = _ascii(spark, sf_dir).select("doc_id", letters.recoded("seq", LETTER_IDS, 6, end=1).alias("r"))
    return rows.select("doc_id", "r.n_ids", F.md5("r.decoded").alias("decoded"))


D_3MERS = """u AS (SELECT doc_id, upper(regexp_replace(seq, '\\s', '', 'g')) AS x FROM s), k AS (SELECT doc_id, rpad(substr(x, i, 3), 3, 'N') AS w FROM (SELECT doc_id, x, unnest(range(1, length(x) + 1, 3)) AS i FROM u)),
v AS (SELECT doc_id, CASE WHEN regexp_full_match(w, '[ACGTN]{3}') THEN 7 + 25 * (strpos('ACGTN', w[1]) - 1) + 5 * (strpos('ACGTN', w[2]) - 1) + strpos('ACGTN', w[3]) - 1 END AS id FROM k)"""


@query(f"WITH {D_ASCII}, {D_3MERS} SELECT doc_id, id, count(*) AS n FROM v GROUP BY ALL")
def kmer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each id of a 3-mer comes in each text; null for those with other letters."""
    words = _ascii(spark, sf_dir).select("doc_id", F.explode(sq.tokenizer({"tokenizer_name": "kmer", "k": 3, "stride": 3})("seq")).alias("w"))
    return words.groupBy("doc_id", sq.kmer_id(F.col("w")).alias("id")).agg(F.count("*").alias("n"))


@query(f"WITH {D_ASCII} SELECT doc_id, md5(translate(regexp_replace(upper(seq), '[^ACGT]', 'N', 'g'), 'ACGTN', '12345')) AS digest FROM s")
def base_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.array_join(F.transform(sq.base_ids("seq"), lambda i: i.cast("string")), "")
    return _ascii(spark, sf_dir).select("doc_id", F.md5(digits).alias("digest"))


@query(f"WITH {D_ASCII}, r AS (SELECT doc_id, replace(upper(trim(seq, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))), 'T', 'U') AS x FROM s) SELECT doc_id, rpad(translate(regexp_replace(substr(x, 1, 440), '[^AUGC]', '0', 'g'), 'AUGC', '2345'), 440, '0') AS ids, CAST(least(length(x), 440) AS INTEGER) AS masked FROM r")
def rna_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the first 440 letters, which is the length of the window asked for; unknown letters are the padding's id."""
    out = _ascii(spark, sf_dir).select("doc_id", sq.rna_ids("seq", RNA, 440).alias("r"))
    return out.select("doc_id", F.array_join(F.transform("r.ids", lambda i: i.cast("string")), "").alias("ids"), F.aggregate("r.mask", F.lit(0), lambda a, x: a + x).alias("masked"))


@query(f"""WITH {D_SEQ}, a AS (SELECT doc_id, seq, length(seq) AS n, length(seq) % 6 AS over, (6 - length(seq) % 6) % 6 AS added FROM s)
SELECT doc_id, md5(substr(seq, over + 1)) AS cut, CAST(over AS INTEGER) AS truncated, CAST(greatest(0, least(129 + added, n + added)) // 6 * 6 AS INTEGER) AS prompt_padded,
CAST(greatest(0, least(129 - over, n - over)) // 6 * 6 AS INTEGER) AS prompt_cut, CAST(ceil(n / 128.0::DOUBLE) * 128 AS BIGINT) AS padded FROM a""")
def align_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut on the left to a multiple of six, prompts of 129 letters moved along, and lengths padded to 128."""
    pad, cut, n = sq.six_align("seq"), sq.six_align("seq", "truncate"), F.length("seq")
    rows = _sequences(spark, sf_dir).select("doc_id", n.alias("n"), pad.alias("p"), cut.alias("c"))
    prompt = lambda x, total: sq.six_prompt(F.lit(129), x["added"], x["truncated"], total)
    return rows.select("doc_id", F.md5("c.aligned").alias("cut"), "c.truncated", prompt(F.col("p"), F.length("p.aligned")).alias("prompt_padded"), prompt(F.col("c"), F.length("c.aligned")).alias("prompt_cut"), sq.padded_length(F.col("n"), 128).alias("padded"))


@query(f"""WITH {D_SEQ}, b AS (SELECT doc_id, regexp_replace(seq, '\\s', '', 'g') AS x FROM s)
SELECT doc_id, md5('<s>' || array_to_string(list_transform(range(0, CAST(ceil(length(x) / 60.0::DOUBLE) AS BIGINT)), lambda i: substr(x, i * 60 + 1, 60)), chr(10)) || '</s>') AS wrapped, md5(array_to_string(string_split(x, ''), ' ')) AS spaced FROM b""")
def residue_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in lines of 60 letters between marks, and with a space between letters."""
    return _sequences(spark, sf_dir).select("doc_id", F.md5(sq.fasta_wrapped("seq", "<s>", "</s>")).alias("wrapped"), F.md5(sq.spaced("seq")).alias("spaced"))


@query("""WITH n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS sequence_index FROM documents), p AS (SELECT *, CASE WHEN length(text) <= 1 THEN 0 ELSE greatest(1, least(length(text) - 1, 129)) END AS cut FROM n)
SELECT sequence_index, doc_id, md5(substr(text, 1, cut)) AS prompt, md5(substr(text, cut + 1)) AS truth FROM p WHERE cut > 0""")
def prompts_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the number that their row has among all rows, the skipped ones included."""
    rows = relations.indexed(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return relations.prompt_split(rows, "text", 129).select("sequence_index", "doc_id", F.md5("prompt").alias("prompt"), F.md5("ground_truth").alias("truth"))


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 1000")
def first_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the thousand rows that come first, which is the feature."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "value", (-F.col("value")).alias("down"))
    return relations.first_rows(rows, ["down", "event_id"], 1000).drop("down")


@query("""SELECT event_type, user_id % 50 AS part, coalesce(round(avg(x), 6), 'NaN'::DOUBLE) AS mean, coalesce(round(median(x), 6), 'NaN'::DOUBLE) AS median, coalesce(round(stddev_pop(x), 6), 'NaN'::DOUBLE) AS std, coalesce(min(x), 'NaN'::DOUBLE) AS min, coalesce(max(x), 'NaN'::DOUBLE) AS max,
count(*) AS count, count(x) AS valid_count FROM (SELECT event_type, user_id, CASE WHEN user_id % 50 > 3 THEN value END AS x FROM events) GROUP BY ALL""")
def stats_of_empty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without a finite value have NaN in all five places."""
    part = F.col("user_id") % 50
    v = F.when(part > 3, F.col("value")).when(part > 1, scores.nan())
    return _table(spark, sf_dir, "events").groupBy("event_type", part.alias("part")).agg(*metrics.five_numbers(v, 6))


@query("""SELECT event_type, user_id % 20 AS part, round(coalesce(sum(x), 0), 4) AS nll_sum, count(x) AS tokens, round(coalesce(avg(x), 'NaN'::DOUBLE), 6) AS avg_nll FROM (SELECT event_type, user_id, CASE WHEN event_id % 3 <> 0 AND user_id % 20 > 0 THEN value END AS x FROM events) GROUP BY ALL""")
def masked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses over scored places; a part of the users has none."""
    part = F.col("user_id") % 20
    found = metrics.masked_loss(F.col("value"), (F.col("event_id") % 3 != 0) & (part > 0))
    places = {"nll_sum": 4, "avg_nll": 6}
    return _table(spark, sf_dir, "events").groupBy("event_type", part.alias("part")).agg(*[(F.round(c, places[n]) if n in places else c).alias(n) for n, c in found.items()])


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT vec_id, 0 AS part, v, CASE WHEN vec_id % 4 = 3 THEN 2.0::DOUBLE ELSE 1 END AS f FROM e UNION ALL SELECT vec_id, 1, v, CASE WHEN vec_id % 4 = 3 THEN 1.0::DOUBLE ELSE 2 END FROM e WHERE vec_id % 4 > 1)
SELECT vec_id, CAST(part AS INTEGER) AS part, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(unnest(v) * f, 6) AS x FROM p""")
def embedding_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs as lists, matrices of one and two rows, and tensors of two sequences, brought to vectors."""
    times = lambda k: F.transform("v", lambda x: x * k)
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    kind, one = F.col("vec_id") % 4, F.to_json("v")
    tensor = F.to_json(F.array(F.array(F.col("v"), times(3)), F.array(F.col("v"), F.col("v"))))
    text = F.when(kind == 0, one).when(kind == 1, F.to_json(F.array("v"))).when(kind == 2, F.to_json(F.array(F.col("v"), times(2)))).otherwise(tensor)
    rows = e.select("vec_id", F.posexplode(records.vectors(F.parse_json(text))).alias("part", "v"))
    return rows.select("vec_id", "part", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))

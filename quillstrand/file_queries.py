"""Queries that write the given tables as split, bucket, result, log and cache files below the shared folder and read them
back with the library's readers and commands. What a query read is a table of its own; the files are deleted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand import commands
from quillstrand.functions import scores
from quillstrand.operators import metrics, relations
from quillstrand.plans import tasks
from quillstrand.registry import ABC, FOLD, SEQ, query, table
from quillstrand.shared import new_path, settled, stash
from quillstrand.sources import beside, readers, writers
from quillstrand.streaming import running


def _through(spark: SparkSession, name: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """What make(folder) reads from the files that it writes below a folder of its own."""
    return settled(spark, lambda: make(new_path(spark, name)), name)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _bases(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ABC, FOLD), "[^ACGT]", "")


D_BASES = f"regexp_replace({SEQ.replace('text', "coalesce(text, '')")}, '[^ACGT]', '', 'g')"
SPLITS = ["train", "val", "test"]
D_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"


def _split(key: str = "doc_id") -> Column:
    k = F.col(key) % 10
    return F.when(k < 8, "train").when(k == 8, "val").otherwise("test")


# --- split tables and sequence files ------------------------------------------------------------------------------


@query(f"SELECT doc_id AS taxid, {D_SPLIT} AS split, lang, CASE WHEN {D_SPLIT} <> 'test' THEN md5({D_BASES}) END AS digest FROM documents")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three splits of metadata; train has its sequences as JSON lines in two pieces, val as CSV, test none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("taxid"), "lang", _split().alias("split"), _bases(F.col("text")).alias("sequence"))
    half = F.length("sequence").cast("long") / 2
    pieces = F.array(F.substring("sequence", F.lit(1), half.cast("int")), F.substring("sequence", half.cast("int") + 1, F.length("sequence")))

    def make(folder: str) -> DataFrame:
        beside.write_named(docs.select("taxid", "lang", F.concat("split", F.lit(".csv")).alias("file")), ["file"], folder, "csv")
        writers.write_rows(docs.where("split = 'train'").select("taxid", pieces.alias("sequences")), f"{folder}/train_sequences.jsonl")
        writers.write_csv(docs.where("split = 'val'").select("taxid", "sequence"), f"{folder}/val_sequences.csv")
        read = [readers.attach_sequences(spark, readers.read_metadata(spark, folder, s, "taxid long, lang string"), folder, s) for s in SPLITS]
        return _union(read).select("taxid", "split", "lang", F.md5("sequence").alias("digest"))

    return _through(spark, "split-files", make)


@query(f"SELECT CASE WHEN doc_id % 7 > 0 THEN doc_id END AS taxid, md5({D_BASES}) AS digest FROM documents")
def sequence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of sequences in which every seventh id is no number."""
    bad = F.concat(F.lit("no "), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 > 0, F.col("doc_id").cast("string")).otherwise(bad).alias("taxid"), _bases(F.col("text")).alias("sequence"))

    def make(folder: str) -> DataFrame:
        writers.write_csv(rows.withColumn("note", F.lit("a, b")), f"{folder}/all_sequences.csv")
        return readers.read_sequences(spark, f"{folder}/all_sequences.csv").select("taxid", F.md5("sequence").alias("digest"))

    return _through(spark, "sequence-table", make)


D_LINES = "SELECT {place}, doc_id AS taxid, CAST(i AS INTEGER) AS contig_index, md5(sequence) AS digest FROM (SELECT doc_id, unnest(q) AS sequence, generate_subscripts(q, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS q FROM documents WHERE doc_id % 13 > 2)) WHERE sequence <> ''"


def _bucket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, value): a text's lines as a bucket's line; some lines are cut off, lack the id, or list nothing."""
    k, own = F.col("doc_id") % 13, F.split("text", "\n", -1)
    whole = F.to_json(F.struct(F.col("doc_id").alias("taxid"), own.alias("sequences")))
    without = F.to_json(F.struct(own.alias("sequences")))
    empty = F.to_json(F.struct(F.col("doc_id").alias("taxid"), F.array().cast("array<string>").alias("sequences")))
    value = F.when(k == 0, F.expr("left(whole, length(whole) - 2)")).when(k == 1, without).when(k == 2, empty).otherwise(F.col("whole"))
    return table(spark, sf_dir, "documents").withColumn("whole", whole).select("doc_id", value.alias("value"))


@query(D_LINES.format(place="['cds-long', 'cds-medium', 'cds-short', 'genome-long', 'genome-medium', 'genome-short'][doc_id % 6 + 1] AS bucket"))
def bucket_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all six buckets, found by the buckets' names."""
    names = sorted(readers.BUCKETS)
    name = F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 6).cast("int"))
    parts = F.split(name, "-")
    lines = _bucket_lines(spark, sf_dir).select("value", parts[0].alias("kind"), F.concat(parts[1], F.lit("_sequences.jsonl")).alias("file"))

    def make(folder: str) -> DataFrame:
        beside.write_named(lines, ["kind", "file"], folder, "text")
        rows = _union([readers.read_bucket(spark, readers.bucket_path(folder, n)).withColumn("bucket", F.lit(n)) for n in names])
        return rows.select("bucket", "taxid", "contig_index", F.md5("sequence").alias("digest"))

    return _through(spark, "bucket-files", make)


@query(D_LINES.format(place="doc_id % 10 + 1 AS shard"))
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines in ten numbered shards, read as one."""
    number = (F.col("doc_id") % 10 + 1).cast("string")
    lines = _bucket_lines(spark, sf_dir).select("value", F.concat(F.lit("short_sequences-"), number, F.lit(".jsonl")).alias("file"))

    def make(folder: str) -> DataFrame:
        beside.write_named(lines, ["file"], folder, "text")
        rows = readers.read_shards(spark, folder)
        return rows.select((F.col("taxid") % 10 + 1).alias("shard"), "taxid", "contig_index", F.md5("sequence").alias("digest"))

    return _through(spark, "shard-files", make)


@query("SELECT doc_id AS taxid, ['ALL', 'DNA', 'RNA'][doc_id % 12 // 4 + 1] || '-' || ['host', 'taxon'][doc_id // 2 % 2 + 1] || '-' || ['genus', 'times'][doc_id % 2 + 1] AS dataset, lang FROM documents")
def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training tables of all twelve datasets, found by the datasets' names."""
    k = F.col("doc_id")
    one = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    steps = {"top": F.lit("cls_data"), "acid": one(["ALL", "DNA", "RNA"], F.floor(k % 12 / 4)), "label": one(["host", "taxon"], F.floor(k / 2) % 2), "rule": one(["genus", "times"], k % 2), "file": F.lit("train.csv")}
    rows = table(spark, sf_dir, "documents").select(k.alias("taxid"), "lang", *[c.alias(n) for n, c in steps.items()])

    def make(folder: str) -> DataFrame:
        beside.write_named(rows, list(steps), folder, "csv")
        found = [(n, readers.dataset_dir(folder, n)) for n in sorted(readers.DATASETS)]
        return _union([readers.read_metadata(spark, d, "train", "taxid long, lang string").select("taxid", F.lit(n).alias("dataset"), "lang") for n, d in found if readers.exists(spark, d)])

    return _through(spark, "dataset-files", make)


# --- result files and commands ------------------------------------------------------------------------------------


@query("SELECT 'm' || user_id % 20 || '/' || CASE WHEN event_id % 4 = 0 THEN 'part_gen_per_sample.jsonl' ELSE 'all_gen.jsonl' END AS file, event_id, value FROM events WHERE event_id % 4 < 2")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample rows below twenty folders; notes and the outputs of an earlier run lie beside them."""
    k = F.col("event_id") % 4
    name = F.when(k == 0, "part_gen_per_sample.jsonl").when(k == 1, "all_gen.jsonl").when(k == 2, "notes.jsonl").otherwise("x_gen_per_sample_metrics.jsonl")
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "value")).alias("text"), F.concat(F.lit("/m"), (F.col("user_id") % 20).cast("string"), F.lit("/"), name).alias("file"))

    def make(folder: str) -> DataFrame:
        beside.write_beside(stash(rows.withColumn("target", F.concat(F.lit(folder), "file")), "result-lines"), "target", ["event_id"], "text", folder)
        found = readers.read_results(spark, folder, "event_id long, value double")
        return found.select(F.regexp_extract("source_file", "([^/]+/[^/]+)$", 1).alias("file"), "event_id", "value")

    return _through(spark, "result-files", make)


#: Models by bucket; a bucket whose name starts with a dot isn't found.
D_BITS = """WITH e AS (SELECT event_id, user_id % 5 AS m, event_id % 3 AS b, event_id % 17 = 0 AS broken, value AS bpb, value / 100 AS a, CAST(event_id % 700 AS BIGINT) AS tok, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 600 AS BIGINT) END AS ch, CAST(event_id % 900 AS BIGINT) AS chars FROM events WHERE event_id % 11 > 0),
w AS (SELECT *, coalesce(ch + 128, chars) - 128 AS ex FROM e), c AS (SELECT *, NOT broken AND ex > 0 AND tok > 0 AND NOT coalesce(ch = ex AND tok >= ex, false) AS changed FROM w),
r AS (SELECT event_id, m, b, broken, CASE WHEN broken THEN NULL WHEN changed THEN round(a * tok / least(ex, tok) / ln(2.0::DOUBLE), 4) ELSE round(bpb, 4) END AS bpb, CASE WHEN broken THEN NULL WHEN changed THEN greatest(0, chars - 128) ELSE ch END AS char_count FROM c)"""
BITS_BUCKETS = [f"genome-{s}" for s in ("short", "medium", "long")]


def _bits_folder(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Write the models' rows below folder and recompute them; returns the report."""
    k = F.col("event_id")
    bucket = F.when(k % 11 == 0, ".older").otherwise(F.get(F.array(*[F.lit(b) for b in BITS_BUCKETS]), (k % 3).cast("int")))
    own = {"event_id": k, "bpb": F.col("value"), "avg_nll_token": F.col("value") / 100, "token_count": k % 700, "char_count": F.when(k % 5 > 0, k % 600), "sequence_chars": k % 900}
    text = F.when(k % 17 == 0, F.concat(F.lit("broken "), k.cast("string"))).otherwise(F.to_json(F.struct(*[c.alias(n) for n, c in own.items()])))
    target = F.concat(F.lit(f"{folder}/"), bucket, F.lit("/m"), (F.col("user_id") % 5).cast("string"), F.lit("/all_bpb_per_sample.jsonl"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"), target.alias("target"))
    beside.write_beside(stash(rows, "bits-lines"), "target", ["event_id"], "text", folder)
    return commands.bits_files(spark, folder)


@query(D_BITS + " SELECT 'm' || m AS model_name, " + ", ".join(f"""coalesce(CAST(round(CAST({f}(bpb) FILTER (b = {i}) AS DECIMAL(18, 8)), 4) AS VARCHAR), '') AS "{n}_{'mean' if f == 'avg' else f}\"""" for i, n in enumerate(BITS_BUCKETS) for f in ("min", "max", "median", "avg")) + " FROM r GROUP BY m")
def bits_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the bits command."""
    return _through(spark, "bits-report", lambda folder: _bits_folder(spark, sf_dir, folder))


@query(D_BITS + " SELECT event_id, broken, bpb, char_count FROM r")
def bits_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the bits command writes; broken ones pass as they are."""

    def make(folder: str) -> DataFrame:
        _bits_folder(spark, sf_dir, folder)
        lines = readers.read_lines(spark, beside.paths_below(spark, f"{folder}/*/*/all_bpb_per_sample_new.jsonl"))
        d = F.from_json("value", "event_id long, bpb double, char_count long")
        broken = F.regexp_extract("value", r"^broken (\d+)$", 1)
        rows = lines.select(d.alias("d"), broken.alias("broken"))
        known = F.coalesce(F.expr("try_cast(broken as long)"), F.col("d.event_id"))
        return rows.select(known.alias("event_id"), (F.col("broken") != "").alias("broken"), "d.bpb", "d.char_count")

    return _through(spark, "bits-rewritten", make)


D_LOGITS = """z AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), p AS (SELECT *, list_position(z, list_max(z)) - 1 AS k, round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS c FROM z),
o AS (SELECT vec_id, k, c, label AS a, label // 4 AS b FROM p)"""
_NAMED = {"kind": ("a", 8), "group": ("b", 2)}


@query(f"WITH {D_LOGITS} SELECT vec_id, " + ", ".join(
    f"CASE WHEN {c} < {n} THEN {c} ELSE -1 END AS {t}_true_label_id, CASE WHEN {c} < {n} THEN '{t} ' || {c} ELSE 'class_-1' END AS {t}_true_label, k AS {t}_predicted_label_id, CASE WHEN k < {n} THEN '{t} ' || k ELSE 'class_' || k END AS {t}_predicted_label, c AS {t}_confidence" for t, (c, n) in _NAMED.items()) + " FROM o")
def predictions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two tasks from the same logits as one CSV table; some labels and classes aren't in a vocabulary."""
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    ids = {t: {f"{t} {k}": k for k in range(n)} for t, (_, n) in _NAMED.items()}
    labels = {"kind": F.concat(F.lit("kind "), F.col("label")), "group": F.concat(F.lit("group "), F.floor(F.col("label") / 4))}
    rows = tasks.encoded(table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"), *[c.alias(t) for t, c in labels.items()]), ids)
    made = tasks.predictions(rows.withColumns({f"{t}_logits": F.col("z") for t in ids}), ids, "vec_id", [])

    def make(folder: str) -> DataFrame:
        writers.write_csv(made, f"{folder}/test_predictions.csv")
        kinds = {"id": "long", "true_label_id": "long", "predicted_label_id": "long", "confidence": "double"}
        schema = ", ".join(f"{c} {kinds.get(c.partition('_')[2], 'string')}" for c in made.columns)
        read = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(f"{folder}/test_predictions.csv")
        return read.withColumns({f"{t}_confidence": F.round(f"{t}_confidence", 6) for t in ids})

    return _through(spark, "predictions-file", make)


# --- caches, logs, vocabularies, summaries, streams ---------------------------------------------------------------


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS places, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks, of which one lacks the groups, one after another."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 4).alias("groups"))

    def make(folder: str) -> DataFrame:
        paths = [f"{folder}/chunk_{k}" for k in range(3)]
        for k, path in enumerate(paths):
            own = e.where(F.col("vec_id") % 3 == k)
            writers.write_embeddings(own.drop("groups") if k == 1 else own, path)
        total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
        return readers.read_embeddings(spark, *paths).select("*", F.size("embedding").alias("places"), F.round(total, 6).alias("total")).drop("embedding")

    return _through(spark, "embedding-cache", make)


@query("SELECT event_type AS run, user_id % 30 AS epoch, count(*) AS n, CASE WHEN user_id % 30 = 7 THEN 'NaN'::DOUBLE ELSE round(avg(value) FILTER (event_id % 3 > 0 AND user_id % 30 <> 9), 6) END AS metric FROM events GROUP BY event_type, user_id % 30")
def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by epoch as JSON lines, NaN and null among them, read strictly."""
    epoch = F.col("user_id") % 30
    mean = F.round(F.avg(F.when((F.col("event_id") % 3 > 0) & (epoch != 9), F.col("value"))), 6)
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), epoch.alias("epoch")).agg(F.count("*").alias("n"), mean.alias("metric"))

    def make(folder: str) -> DataFrame:
        writers.write_rows(rows.withColumn("metric", F.when(F.col("epoch") == 7, scores.nan()).otherwise(F.col("metric"))), f"{folder}/metrics.jsonl")
        return readers.read_jsonl(spark, f"{folder}/metrics.jsonl", "run string, epoch long, n long, metric double")

    return _through(spark, "epoch-log", make)


@query("WITH o AS (SELECT o_orderpriority AS model, o_custkey % 10 AS part, count(*) AS n FROM orders GROUP BY ALL) SELECT model, part, n, row_number() OVER (ORDER BY part, model) AS idx FROM o")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of runs, appended to ten times, with its numbers made anew."""
    part = (F.col("o_custkey") % 10).alias("part")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), part).agg(F.count("*").alias("n"))

    def make(folder: str) -> DataFrame:
        counted = stash(rows, "runs")
        for k in range(10):
            writers.append_log(counted.where(F.col("part") == k), f"{folder}/log.csv")
        log = spark.read.schema("model string, part long, n long").option("header", True).csv(f"{folder}/log.csv")
        return relations.append_reindexed(log.limit(0), log, ["part", "model"])

    return _through(spark, "run-log", make)


@query("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT trim(source) AS label FROM documents WHERE trim(source) <> '')")
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary as one JSON object."""

    def make(folder: str) -> DataFrame:
        writers.write_vocabulary(relations.label_vocabulary(table(spark, sf_dir, "documents"), "source"), f"{folder}/label2id.json")
        return spark.read.text(f"{folder}/label2id.json").select(F.explode(F.from_json("value", "map<string,int>")).alias("label", "label_id"))

    return _through(spark, "vocabulary-file", make)


@query("SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(*) AS count, count(value) AS valid_count FROM events")
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of all rows as one indented JSON object."""

    def make(folder: str) -> DataFrame:
        row = table(spark, sf_dir, "events").agg(*metrics.five_numbers(F.col("value"), 6))
        writers.write_summary(row, f"{folder}/summary.json")
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in row.schema)
        return spark.read.text(f"{folder}/summary.json", wholetext=True).select(F.from_json("value", kind).alias("d")).select("d.*")

    return _through(spark, "summary-file", make)


@query("SELECT event_type, count(*) AS count, count(value) FILTER (event_id % 9 > 0) AS valid_count, round(avg(value) FILTER (event_id % 9 > 0), 6) AS mean, round(stddev_pop(value) FILTER (event_id % 9 > 0), 6) AS std, min(value) FILTER (event_id % 9 > 0) AS min, max(value) FILTER (event_id % 9 > 0) AS max FROM events GROUP BY event_type")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a stream of result files, as they stand after the last batch."""
    value = F.when(F.col("event_id") % 9 > 0, F.col("value")).otherwise(scores.nan())
    rows = table(spark, sf_dir, "events").select("event_type", value.alias("value"))

    def make(folder: str) -> DataFrame:
        writers.write_rows(rows, f"{folder}/arriving")
        stats = running.running_stats(running.result_stream(spark, f"{folder}/arriving", "event_type string, value double"), "value", "event_type")
        keep = stats.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
        keep.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/totals")).start().awaitTermination()
        found = spark.read.schema(stats.schema).parquet(f"{folder}/totals")
        return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})

    return _through(spark, "running-totals", make)

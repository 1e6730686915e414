"""Offline metrics from files to files: python -m quillstrand.commands completion|bits PATH ...

Each input file gets its outputs beside it, one named file each; all inputs are worked on in one job.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand.functions import records, scores
from quillstrand.operators import metrics, relations
from quillstrand.plans import completion, likelihood
from quillstrand.shared import settled, stash
from quillstrand.sources import beside, readers

GENERATED = ("generated_sequence", "generated_continuation", "generated_tail", "generated_full")
NAMES = {"kmer_jsd": "kmer_JSD", "kmer_ks": "kmer_KS", "is_cds": "is_CDS"}
SHOWN = [NAMES.get(n, n) for n in completion.METRICS]
BUCKETS = ["genome-short", "genome-medium", "genome-long"]
STATISTICS = ("mean", "median", "std", "min", "max")
BITS = {"bpb": "double", "avg_nll_token": "double", "token_count": "long", "char_count": "long", "sequence_chars": "long"}


def completion_rows(lines: DataFrame) -> DataFrame:
    """Result lines (value, and others) with SHOWN, and value with these fields in it. Fields that a line lacks count as
    null; all its other keys stay as they are. A line that is no JSON object fails the job, blank ones are left out."""
    d = records.record(F.col("value"))
    rows = lines.where(F.trim("value") != "").withColumn("d", d)
    wrong = F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("value", F.lit(200))))
    rows = rows.withColumn("d", F.when(F.col("d").isNull(), wrong).otherwise(F.col("d")))
    text = lambda n: records.field(F.col("d"), n)
    made = relations.continuation([text(n) for n in GENERATED], F.coalesce(text("prompt"), F.lit("")))
    rows = completion.with_metrics(rows.withColumns({"truth": text("ground_truth"), "made": made}), "truth", "made").withColumnsRenamed(NAMES)
    return rows.withColumn("value", records.line(F.col("d"), {n: F.col(n) for n in SHOWN})).drop("d", "truth", "made")


def completion_summary(rows: DataFrame, source: str = "source_file") -> DataFrame:
    """A row per source: counts, a struct of STATISTICS for each metric, the source's name and its number of samples."""
    stats = [F.struct(*metrics.five_numbers(F.col(m))[:5]).alias(m) for m in ("edit_distance", "exact_match_acc", "kmer_JSD", "kmer_KS")]
    cds = F.struct(F.count_if("is_CDS").alias("count"), (F.count_if("is_CDS") / F.count("*")).alias("ratio")).alias("is_CDS")
    return rows.groupBy(source).agg(F.count("*").alias("count"), *stats, cds, F.count("*").alias("num_samples"))


def _folder(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0] or "."


def completion_files(spark: SparkSession, path: str, out: str | None = None, summary: str | None = None, per_sample: bool = True) -> DataFrame:
    """Score the result file at path, or all below it; returns the summaries, a row per file.

    Beside <base>.jsonl come <base>_metrics.jsonl, its lines with the metrics in them in the same order, and
    <base>_metrics_summary.json. out and summary name other places for the first file alone. Files without lines get
    none. Older outputs are replaced.
    """

    def write() -> DataFrame:
        scored = stash(completion_rows(readers.read_lines(spark, path, readers.is_result)), "scored")
        base = F.regexp_replace("source_file", r"\.[^./]*$", "")
        first = F.col("source_file") == (scored.agg(F.min("source_file")).first()[0] or "")
        place = lambda given, ending: F.when(first & F.lit(given is not None), F.lit(given)).otherwise(F.concat(base, F.lit(ending)))
        staging = path if not path.endswith(".jsonl") else _folder(path)
        if per_sample:
            beside.write_beside(scored.withColumn("target", place(out, "_metrics.jsonl")), "target", ["start", "row"], "value", staging)
        found = stash(completion_summary(scored), "summaries")
        shown = F.to_json(F.struct(*[c for c in found.columns if c not in ("source_file", "num_samples")], "source_file", "num_samples"), {"pretty": "true"})
        beside.write_beside(found.withColumns({"target": place(summary, "_metrics_summary.json"), "text": shown}), "target", [], "text", staging)
        return found

    return settled(spark, write, "summaries")


def bits_rows(lines: DataFrame) -> DataFrame:
    """Lines (value, and others) with value rewritten where it is a JSON object: bpb recomputed by rule and to four places,
    char_count where bpb changed, all other keys as they are. Further columns: bpb, changed, and skipped (no JSON object).
    Blank lines and those that are skipped pass."""
    blank = F.trim("value") == ""
    rows = lines.withColumn("d", records.record(F.col("value"))).withColumn("skipped", ~blank & F.col("d").isNull())
    f = {n: records.field(F.col("d"), n, kind) for n, kind in BITS.items()}
    rows = rows.withColumns({f"own_{n}": c for n, c in f.items()})
    own = {n: F.col(f"own_{n}") for n in BITS}
    rows = rows.withColumn("r", likelihood.recomputed(*own.values()))
    good = ~F.col("skipped") & ~blank
    value = F.coalesce(F.col("r.value"), own["bpb"])
    count = likelihood.rewritten_count(F.lit(True), own["sequence_chars"], own["char_count"])
    rounded = F.when(scores.is_finite(F.col("r.value")), records.line(F.col("d"), {"bpb": value})).otherwise(F.col("value"))
    new = F.when(F.col("r.changed"), records.line(F.col("d"), {"bpb": value, "char_count": count})).otherwise(rounded)
    shown = rows.withColumns({"bpb": F.when(good, value), "changed": good & F.coalesce(F.col("r.changed"), F.lit(False)), "value": F.when(good, new).otherwise(F.col("value"))})
    return shown.drop("d", "r", *[f"own_{n}" for n in BITS])


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, text) of small files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _place(path: Column) -> list[Column]:
    """Bucket and model of a path <bucket>/<model>/<file>."""
    return [F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]+$", k).alias(n) for k, n in ((1, "bucket"), (2, "model"))]


def bits_files(spark: SparkSession, root: str) -> DataFrame:
    """For each root/<bucket>/<model>/all_bpb_per_sample.jsonl write all_bpb_per_sample_new.jsonl and bpb_summary_new.json
    beside it (the keys of bpb_summary.json, if there is one, with all_statistics and all_size), and
    root/bpb_summary_table_new.csv; returns that report of models by bucket.

    Models that have bpb_summary_new.json already aren't worked on again: the report takes their statistics from it, or
    blanks if it can't be read. The driver holds the names of the folders.
    """
    root = root.rstrip("/")
    kept = lambda p: not p.rsplit("/", 3)[-3].startswith(".")
    folders = {_folder(p) for p in beside.paths_below(spark, f"{root}/*/*/all_bpb_per_sample.jsonl") if kept(p)}
    done = {_folder(p) for p in beside.paths_below(spark, f"{root}/*/*/bpb_summary_new.json") if _folder(p) in folders}
    kinds = "bucket string, model string, " + ", ".join(f"{n} double" for n in STATISTICS)

    def write() -> DataFrame:
        tables = [spark.createDataFrame([], kinds)]
        if todo := sorted(folders - done):
            rows = stash(bits_rows(readers.read_lines(spark, [f"{x}/all_bpb_per_sample.jsonl" for x in todo])), "bits")
            near = lambda name: F.regexp_replace("source_file", "[^/]+$", name)
            beside.write_beside(rows.withColumn("target", near("all_bpb_per_sample_new.jsonl")), "target", ["start", "row"], "value", root)
            stats = stash(likelihood.recompute_summary(rows, "bpb", "source_file"), "bits-statistics")
            none = F.struct(*[scores.nan().alias(n) for n in STATISTICS], F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("valid_count"))
            files = rows.select("source_file").distinct().join(stats, "source_file", "left")
            files = files.withColumn("all", F.when(F.col("count").isNull(), none).otherwise(F.struct(*STATISTICS, "count", "valid_count")))
            older = [p for p in beside.paths_below(spark, f"{root}/*/*/bpb_summary.json") if _folder(p) in todo]
            before = _whole(spark, older).select(F.regexp_replace("file", "[^/]+$", "").alias("folder"), records.record(F.col("text")).alias("d")) if older else spark.createDataFrame([], "folder string, d map<string,variant>")
            at = F.regexp_replace("source_file", "[^/]+$", "")
            summed = files.withColumn("folder", at).join(before, "folder", "left")
            own = F.coalesce("d", records.record(F.to_json(F.struct(F.regexp_replace("folder", "/$", "").alias("output_dir")))))
            text = F.to_json(F.map_filter(own, lambda k, v: ~k.isin("all_statistics", "all_size")))
            more = F.to_json(F.struct(F.col("all").alias("all_statistics"), F.col("all.count").alias("all_size")))
            joined = F.when(text == "{}", more).otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more))))
            beside.write_beside(stash(summed.select(F.concat("folder", F.lit("bpb_summary_new.json")).alias("target"), joined.alias("text")), "bits-summaries"), "target", [], "text", root)
            tables.append(files.select(*_place(F.col("source_file")), *[F.col("all")[n].alias(n) for n in STATISTICS]))
        if done:
            text = _whole(spark, [f"{x}/bpb_summary_new.json" for x in sorted(done)])
            found = text.select(*_place(F.col("file")), F.from_json("text", "all_statistics struct<" + ", ".join(f"{n}: double" for n in STATISTICS) + ">").alias("s"))
            tables.append(found.select("bucket", "model", *[F.col("s.all_statistics")[n].alias(n) for n in STATISTICS]))
        stats = stash(reduce(DataFrame.unionByName, tables), "report-statistics")
        names = sorted({_folder(x).rpartition("/")[2] for x in folders})
        report = likelihood.report_table(stats, [b for b in BUCKETS if b in names] or names).withColumnRenamed("model", "model_name")
        head = spark.createDataFrame([(0, ",".join(report.columns))], "part int, text string")
        lines = head.union(report.select(F.lit(1), F.to_csv(F.struct("*"), {"emptyValue": ""}))).withColumn("target", F.lit(f"{root}/bpb_summary_table_new.csv"))
        if folders:
            beside.write_beside(stash(lines, "report"), "target", ["part", "text"], "text", root)
        return report

    return settled(spark, write, "report")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillstrand.commands")
    kinds = parser.add_subparsers(dest="kind", required=True)
    c = kinds.add_parser("completion", help="metrics of generated continuations")
    c.add_argument("input")
    c.add_argument("-o", "--output", help="place of the first file's rows")
    c.add_argument("--summary", help="place of the first file's summary")
    c.add_argument("--no-per-sample", action="store_true")
    b = kinds.add_parser("bits", help="recompute bits per base and report models by bucket")
    b.add_argument("root")
    args = parser.parse_args(arguments)
    from quillstrand.session import session, ship

    spark = session()
    ship(spark)
    if args.kind == "completion":
        completion_files(spark, args.input, args.output, args.summary, not args.no_per_sample)
    else:
        bits_files(spark, args.root)


if __name__ == "__main__":
    main()

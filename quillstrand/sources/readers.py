"""Reading split tables, sequence files and result files. Paths may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand.operators import relations

SEQUENCE_LIST = "taxid long, sequences array<string>"
SEQUENCE = "taxid long, sequence string"
DATASETS = {f"{na}-{label}-{check}" for na in ("ALL", "DNA", "RNA") for label in ("host", "taxon") for check in ("genus", "times")}
BUCKETS = {f"{kind}-{size}" for kind in ("genome", "cds") for size in ("short", "medium", "long")}

#: What writers.CSV writes. Spark takes "" for null unless its sign of null is another text than the empty one.
CSV = {"header": True, "escape": '"', "nullValue": "\0null\0", "emptyValue": ""}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dataset_dir(root: str, name: str, small: bool = False) -> str:
    """The folder of a dataset name; ValueError for another name."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset: {name}")
    na, label, check = name.split("-")
    return f"{root}/{'cls_data_min_consistent' if small else 'cls_data'}/{na}/{label}/{check}"


def bucket_path(root: str, name: str) -> str:
    if name not in BUCKETS:
        raise ValueError(f"unknown bucket: {name}")
    kind, size = name.split("-")
    return f"{root}/{kind}/{size}_sequences.jsonl"


def read_metadata(spark: SparkSession, split_dir: str, split: str, schema: str) -> DataFrame:
    path = f"{split_dir}/{split}.csv"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    # Fields may hold line breaks, so a file isn't split; written by many tasks, it is a folder of many.
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path).withColumn("split", F.lit(split))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict: blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, sequence or sequences) by the file's ending; ValueError for another one, KeyError for missing columns."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, SEQUENCE_LIST)
    if path.endswith(".csv"):
        head = spark.read.options(**CSV).csv(path)
        if missing := {"taxid", "sequence"} - set(head.columns):
            raise KeyError(f"missing columns: {sorted(missing)}")
        return head.select(F.expr("try_cast(taxid as long)").alias("taxid"), "sequence")
    raise ValueError(f"not a sequence file: {path}")


def sequence_file(spark: SparkSession, split_dir: str, split: str) -> str | None:
    """The split's sequence file, JSON lines before CSV; None if it has none."""
    return next((p for p in (f"{split_dir}/{split}_sequences.jsonl", f"{split_dir}/{split}_sequences.csv") if exists(spark, p)), None)


def read_bucket(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lenient: malformed lines, rows without taxid or sequences and empty sequences are left out; a row per sequence."""
    raw = spark.read.schema(f"{SEQUENCE_LIST}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = raw.where(F.col("_bad").isNull() & F.col("taxid").isNotNull() & (F.size("sequences") > 0))
    return good.select("taxid", F.posexplode("sequences").alias("contig_index", "sequence")).where("sequence <> ''")


def read_shards(spark: SparkSession, folder: str, numbers: range = range(1, 11)) -> DataFrame:
    """short_sequences-{i}.jsonl for each number."""
    return read_bucket(spark, [f"{folder}/short_sequences-{i}.jsonl" for i in numbers])


def is_result(name: Column) -> Column:
    """Names of files of per-sample rows; outputs of an earlier run are none."""
    wanted = (name.contains("gen") & name.contains("per_sample")) | name.contains("all_gen")
    return wanted & ~name.endswith("_metrics.jsonl")


def read_lines(spark: SparkSession, path: str | list[str], wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(value, source_file, start, row): the lines of files, or of all JSON lines below a folder whose name is wanted. start
    and row put a file's lines in order."""
    lines = spark.read
    single = isinstance(path, list) or path.endswith(".jsonl")
    if not single:
        lines = lines.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    m = F.col("_metadata")
    found = lines.text(path).select("value", m["file_path"].alias("source_file"), m["file_block_start"].alias("start"), m["file_name"].alias("name"), F.monotonically_increasing_id().alias("row"))
    return (found if single or wanted is None else found.where(wanted(F.col("name")))).drop("name")


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All result files below root that hold per-sample rows, with source_file."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(root)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file")).where(is_result(F.col("_metadata.file_name")))


def attach_sequences(spark: SparkSession, metadata: DataFrame, split_dir: str, split: str) -> DataFrame:
    """metadata with sequence by taxid, the sequences of a list put together; null where the split has no file or no row."""
    path = sequence_file(spark, split_dir, split)
    if path is None:
        return metadata.withColumn("sequence", F.lit(None).cast("string"))
    rows = read_sequences(spark, path)
    whole = F.array_join("sequences", "") if "sequences" in rows.columns else F.col("sequence")
    return relations.attach_many_to_one(metadata, rows.select("taxid", whole.alias("sequence")), "taxid")


def read_embeddings(spark: SparkSession, *paths: str) -> DataFrame:
    """The chunks one after another; groups stays only if every chunk has it."""
    chunks = [spark.read.parquet(p) for p in paths]
    shared = all("groups" in c.columns for c in chunks)
    chunks = chunks if shared else [c.drop("groups") for c in chunks]
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out

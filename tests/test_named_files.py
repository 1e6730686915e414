"""Files named by columns, whole JSON files, and heads of several layers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstrand import catalogue, commands
from quillstrand.plans import heads
from quillstrand.registry import ABC, FOLD
from quillstrand.sources import beside


def test_files_named_by_columns(spark, tmp_path):
    rows = spark.range(20).select("id", (F.col("id") % 2).cast("string").alias("a"), F.concat(F.lit("b-"), (F.col("id") % 3).cast("string"), F.lit(".csv")).alias("b"))
    beside.write_named(rows, ["a", "b"], str(tmp_path), "csv")
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("*/*")) == [f"{a}/b-{b}.csv" for a in (0, 1) for b in (0, 1, 2)]
    got = sorted(r["id"] for r in spark.read.schema("id long").option("header", True).csv(f"{tmp_path}/1/b-0.csv").collect())
    assert got == [3, 9, 15]
    with pytest.raises(FileExistsError):
        beside.write_named(rows, ["a", "b"], str(tmp_path), "csv")
    assert not list(tmp_path.glob("_staging*"))
    beside.write_named(rows.where("id < 0"), ["a", "b"], str(tmp_path / "none"), "csv")
    assert not list((tmp_path / "none").glob("*"))


def test_places_without_a_folder_are_made(spark, tmp_path):
    lines = spark.createDataFrame([(f"{tmp_path}/x/y/one.txt", "a", 2), (f"{tmp_path}/x/y/one.txt", "b", 1)], "target string, value string, n int")
    beside.write_beside(lines, "target", ["n"], "value", str(tmp_path))
    assert (tmp_path / "x" / "y" / "one.txt").read_text() == "b\na\n"


def test_summaries_over_several_lines(spark, tmp_path):
    for model in ("m", "n"):
        folder = tmp_path / "genome-long" / model
        folder.mkdir(parents=True)
        (folder / "all_bpb_per_sample.jsonl").write_text(json.dumps({"bpb": 1.5}) + "\n")
        (folder / "bpb_summary.json").write_text(json.dumps({"model": model, "seen": [1, 2]}, indent=2))
    folder = tmp_path / "genome-long" / "m"
    (folder / "bpb_summary_new.json").write_text(json.dumps({"all_statistics": {"min": 0.25, "max": 4, "median": 1, "mean": 2}, "all_size": 3}, indent=2))
    report = {r["model_name"]: r for r in commands.bits_files(spark, str(tmp_path)).collect()}
    assert (report["m"]["genome-long_min"], report["m"]["genome-long_mean"], report["n"]["genome-long_max"]) == ("0.2500", "2.0000", "1.5000")
    made = json.loads((tmp_path / "genome-long" / "n" / "bpb_summary_new.json").read_text())
    assert made["model"] == "n" and made["seen"] == [1, 2] and made["all_size"] == 1


def test_hidden_sizes():
    assert [heads.hidden_sizes(n) for n in (2, 99, 100, 999, 1000)] == [(512, 128, 64)] * 2 + [(512, 256, 128)] * 2 + [(512, 128, 32)]


def test_perceptron_learns_what_no_line_parts(spark):
    rows = [(i, [float(i % 2) * 9, float(i // 2 % 2), 5.0], (i % 2) ^ (i // 2 % 2), "kept") for i in range(80)]
    rows += [(100, None, 1, "kept"), (101, [1.0, 1.0, 5.0], None, "kept"), (102, [9.0, 0.0, 5.0], -1, "kept")]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, prediction string")
    out = {r["vec_id"]: r for r in heads.perceptron_head(e, e, "embedding", "label", 2, hidden=(6,), rounds=100).collect()}
    assert len(out) == 83 and all(out[i]["pred"] == rows[i][2] and len(out[i]["logits"]) == 2 for i in range(80))
    assert out[100]["pred"] is None and out[100]["logits"] is None and out[102]["pred"] == 1 and out[102]["prediction"] == "kept"


def test_split_files_of_texts_without_bases_and_odd_languages(spark, tmp_path):
    langs = ["en", " en ", 'a"b', "a\\b", "a\\", '\\"', "a,b", "a\nb", "", None, "\t", '"q"']
    rows = [(20 * k + j, t, lang) for k, lang in enumerate(langs) for j, t in ((1, "acgt"), (8, "123"), (9, None), (18, ""))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    bases = "acgt".translate(str.maketrans(ABC, FOLD))
    want = {1: ("train", md5(bases)), 8: ("val", md5("")), 9: ("test", None), 18: ("val", md5(""))}
    got = {r["taxid"]: tuple(r)[1:] for r in catalogue.queries()["split_files"](spark, str(tmp_path)).collect()}
    assert got == {i: (want[i % 20][0], lang, want[i % 20][1]) for i, _, lang in rows}
    found = catalogue.queries()["sequence_table"](spark, str(tmp_path)).collect()
    assert sorted(r["digest"] for r in found) == sorted(md5(bases if t == "acgt" else "") for _, t, _ in rows)

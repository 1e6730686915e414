"""Readers, writers, commands, streams and heads from files to files, on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quillstrand import commands
from quillstrand.functions import scores
from quillstrand.functions import sequence as sq
from quillstrand.operators import metrics, relations
from quillstrand.plans import heads, likelihood
from quillstrand.sources import readers, writers
from quillstrand.streaming import running


def lines(folder):
    return [x for p in sorted(folder.rglob("part-*")) for x in p.read_text().splitlines()]


def test_split_tables(spark, tmp_path):
    (tmp_path / "train.csv").write_text("taxid,label\n1,a\n2,b\n3,c\n")
    (tmp_path / "train_sequences.jsonl").write_text('{"taxid": 1, "sequences": ["AC", "GT"]}\n{"taxid": 2, "sequences": []}\n')
    (tmp_path / "val_sequences.csv").write_text("taxid,sequence\n3,TT\nx,GG\n")
    d = str(tmp_path)
    meta = readers.read_metadata(spark, d, "train", "taxid long, label string")
    assert [tuple(r) for r in meta.orderBy("taxid").collect()] == [(1, "a", "train"), (2, "b", "train"), (3, "c", "train")]
    with pytest.raises(FileNotFoundError):
        readers.read_metadata(spark, d, "test", "taxid long")
    got = {r["taxid"]: r["sequence"] for r in readers.attach_sequences(spark, meta, d, "train").collect()}
    assert got == {1: "ACGT", 2: "", 3: None}
    assert {r["sequence"] for r in readers.attach_sequences(spark, meta, d, "val").collect()} == {None, "TT"}
    assert {r["sequence"] for r in readers.attach_sequences(spark, meta, d, "test").collect()} == {None}
    (tmp_path / "bad.csv").write_text("taxid,letters\n1,A\n")
    with pytest.raises(KeyError):
        readers.read_sequences(spark, f"{d}/bad.csv")
    with pytest.raises(ValueError):
        readers.read_sequences(spark, f"{d}/bad.txt")


def test_shards_and_names(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"short_sequences-{i}.jsonl").write_text(json.dumps({"taxid": i, "sequences": ["A" * i, ""]}) + "\nbroken\n")
    got = sorted(tuple(r) for r in readers.read_shards(spark, str(tmp_path), range(1, 3)).collect())
    assert got == [(1, 0, "A"), (2, 0, "AA")]
    assert readers.bucket_path("/r", "cds-long") == "/r/cds/long_sequences.jsonl"
    assert readers.dataset_dir("/r", "RNA-host-times", True) == "/r/cls_data_min_consistent/RNA/host/times"
    with pytest.raises(ValueError):
        readers.bucket_path("/r", "cds-huge")


def test_embedding_chunks(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    writers.write_embeddings(spark.createDataFrame([(1, [0.5], 7)], "id long, embedding array<double>, groups long"), a)
    writers.write_embeddings(spark.createDataFrame([(2, [1.5])], "id long, embedding array<double>"), b)
    assert "groups" in readers.read_embeddings(spark, a, a).columns
    both = readers.read_embeddings(spark, a, b)
    assert both.columns == ["id", "embedding"] and both.count() == 2


def test_vocabulary_and_logs(spark, tmp_path):
    v = spark.createDataFrame([("b", 1), ("a", 0)], "label string, label_id int")
    writers.write_vocabulary(v, str(tmp_path / "v"))
    assert json.loads(lines(tmp_path / "v")[0]) == {"a": 0, "b": 1}
    log = spark.createDataFrame([("m", 1.0)], "model string, seconds double")
    for _ in range(2):
        writers.append_log(log, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    writers.write_summary(log, str(tmp_path / "s"))
    assert json.loads("\n".join(lines(tmp_path / "s"))) == {"model": "m", "seconds": 1.0}


def completions():
    return [
        {"id": 1, "prompt": "AC", "ground_truth": "GTAA", "generated_sequence": "ACGTAACC", "inner": {"a": [1, None]}, "edit_distance": "old"},
        {"id": "two", "prompt": "AC", "ground_truth": "GTAA", "generated_full": "ACGTTT", "x": None},
        {"id": 3, "prompt": None, "ground_truth": None, "generated_tail": "TAA"},
        {"id": 4.5, "prompt": "A", "ground_truth": "", "generated_continuation": ""},
        {"id": 5, "prompt": "A", "ground_truth": "ACG", "score": math.nan},
    ]


def test_completion_command(spark, tmp_path):
    folder = tmp_path / "in" / "of a model"
    folder.mkdir(parents=True)
    source = folder / "x_gen_per_sample.jsonl"
    source.write_text("\n".join(map(json.dumps, completions())) + "\n\n")
    other = tmp_path / "in" / "all_gen 2.jsonl"
    other.write_text("".join(json.dumps({"n": k, "ground_truth": "ACGT" * (k % 5), "generated_sequence": "ACGA" * (k % 5)}) + "\n" for k in range(5000)))
    (folder / "x_gen_per_sample_metrics.jsonl").write_text('{"id": 99}\n')
    (folder / "empty_gen_per_sample.jsonl").write_text("\n")
    (folder / "notes.jsonl").write_text("{}\n")
    before = {p.name for p in (tmp_path / "in").rglob("*")}
    found = {r["source_file"].rpartition("/")[2]: r for r in commands.completion_files(spark, str(tmp_path / "in")).collect()}
    assert len(found) == 2 and found["x_gen_per_sample.jsonl"]["count"] == 5 and found["x_gen_per_sample.jsonl"]["exact_match_acc"]["max"] == 1.0
    made = {p.name for p in (tmp_path / "in").rglob("*")} - before
    assert made == {"all_gen 2_metrics.jsonl", "all_gen 2_metrics_summary.json", "x_gen_per_sample_metrics_summary.json"}
    got = [json.loads(x) for x in (folder / "x_gen_per_sample_metrics.jsonl").read_text().splitlines()]
    assert [r["id"] for r in got] == [1, "two", 3, 4.5, 5]
    assert got[0]["inner"] == {"a": [1, None]} and "x" in got[1] and got[1]["x"] is None and "x" not in got[0]
    assert (got[0]["edit_distance"], got[0]["exact_match_acc"], got[0]["is_CDS"]) == (0.0, 1.0, False)
    assert (got[1]["edit_distance"], got[1]["exact_match_acc"]) == (0.5, 0.5)
    assert math.isnan(got[2]["exact_match_acc"]) and got[3]["exact_match_acc"] == 1.0 and math.isnan(got[4]["edit_distance"])
    summary = json.loads((folder / "x_gen_per_sample_metrics_summary.json").read_text())
    assert summary["is_CDS"] == {"count": 0, "ratio": 0.0} and summary["num_samples"] == 5 and summary["source_file"].endswith("x_gen_per_sample.jsonl")
    assert [json.loads(x)["n"] for x in (tmp_path / "in" / "all_gen 2_metrics.jsonl").read_text().splitlines()] == list(range(5000))
    # A second run replaces them; explicit places are those of the first file.
    commands.completion_files(spark, str(tmp_path / "in"), str(tmp_path / "rows.jsonl"), str(tmp_path / "sum.json"))
    assert len((tmp_path / "rows.jsonl").read_text().splitlines()) == 5000 and json.loads((tmp_path / "sum.json").read_text())["count"] == 5000
    assert {p.name for p in (tmp_path / "in").rglob("*")} == before | made


def test_completion_of_one_file_without_rows_and_bad_lines(spark, tmp_path):
    source = tmp_path / "any.jsonl"
    source.write_text("\n".join(map(json.dumps, completions())))
    single = commands.completion_files(spark, str(source), per_sample=False).collect()
    assert single[0]["num_samples"] == 5 and {p.name for p in tmp_path.iterdir()} == {"any.jsonl", "any_metrics_summary.json"}
    source.write_text('{"id": 1}\nbroken {\n')
    with pytest.raises(Exception, match="not a JSON object: broken"):
        commands.completion_files(spark, str(source))
    assert {p.name for p in tmp_path.iterdir()} == {"any.jsonl", "any_metrics_summary.json"}


def test_writing_beside_leaves_nothing_after_a_failure(spark, tmp_path):
    from quillstrand.sources.beside import write_beside

    (tmp_path / "a").write_text("old\n")
    rows = spark.range(10).select(F.lit(str(tmp_path / "a")).alias("t"), "id", F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="stop"):
        write_beside(rows, "t", ["id"], "v", str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["a"] and (tmp_path / "a").read_text() == "old\n"


def test_bits_command(spark, tmp_path):
    kept = {"taxid": 1, "bpb": 1.23456, "avg_nll_token": 1.0, "token_count": 900, "char_count": 872, "sequence_chars": 1000, "note": "x", "inner": [1]}
    cut = kept | {"taxid": 2, "token_count": 436}
    unknown = {"taxid": "three", "bpb": 9.0, "avg_nll_token": 1.2, "token_count": 200, "sequence_chars": 1024, "gone": None}
    nothing = {"taxid": 4, "bpb": math.nan}
    root = tmp_path / "root"
    first, second = root / "genome-short" / "m", root / "genome-long" / "m"
    for folder in (first, second, root / ".hidden" / "m"):
        folder.mkdir(parents=True)
        (folder / "all_bpb_per_sample.jsonl").write_text("\n".join(map(json.dumps, (kept, cut, unknown))) + "\n\nbroken {\n" + json.dumps(nothing) + "\n")
    (first / "bpb_summary.json").write_text(json.dumps({"model": "m", "all_size": 99, "deep": {"x": [None]}}))
    report = commands.bits_files(spark, str(root)).collect()
    text = (first / "all_bpb_per_sample_new.jsonl").read_text().splitlines()
    assert text[3:5] == ["", "broken {"] and not (root / ".hidden" / "m" / "all_bpb_per_sample_new.jsonl").exists()
    got = [json.loads(x) for x in text if x.startswith("{")]
    assert [d["taxid"] for d in got] == [1, 2, "three", 4]
    assert got[0] == kept | {"bpb": 1.2346} and math.isnan(got[3]["bpb"]) and got[3].keys() == {"taxid", "bpb"}
    assert got[1]["bpb"] == round(1 / math.log(2), 4)
    assert got[2] == unknown | {"bpb": 1.7312, "char_count": 896}
    summary = json.loads((first / "bpb_summary_new.json").read_text())
    assert summary["model"] == "m" and summary["deep"] == {"x": [None]} and summary["all_size"] == 3 and summary["all_statistics"]["max"] == 1.7312
    assert json.loads((second / "bpb_summary_new.json").read_text()).keys() == {"output_dir", "all_statistics", "all_size"}
    assert report[0]["genome-short_max"] == report[0]["genome-long_max"] == "1.7312"
    table = (root / "bpb_summary_table_new.csv").read_text().splitlines()
    assert table[0].startswith("model_name,genome-short_min,") and table[1].startswith("m,1.2346,1.7312,")
    # A second run takes what is there: the changed statistics of one model, none of a broken file.
    (first / "bpb_summary_new.json").write_text(json.dumps({"all_statistics": {"min": 0.5, "max": 7, "median": None}}))
    (second / "bpb_summary_new.json").write_text("broken")
    (first / "all_bpb_per_sample_new.jsonl").unlink()
    (again,) = commands.bits_files(spark, str(root)).collect()
    assert (again["genome-short_min"], again["genome-short_max"], again["genome-short_median"], again["genome-long_max"]) == ("0.5000", "7.0000", "", "")
    assert not (first / "all_bpb_per_sample_new.jsonl").exists()


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"m": "x", "v": 1.0}\n{"m": "x", "v": "NaN"}\n{"m": "x", "v": 3.0}\n')
    stats = running.running_stats(running.result_stream(spark, str(folder), "m string, v double"), "v", "m")
    run = stats.writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    r = spark.table("stats").first()
    assert (r["count"], r["valid_count"], r["mean"], r["std"]) == (3, 2, 2.0, 1.0)


def test_medians_of_arriving_files(spark, tmp_path):
    import random

    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    with pytest.raises(ValueError):
        running.medians(spark, state, "m")
    r = random.Random(6)
    seen = {"x": [], "y": [], "few": []}
    for k in range(3):
        rows = [("x", r.random()) for _ in range(4000)] + [("y", r.expovariate(1)) for _ in range(2000 * k)] + [("few", float(k)), ("few", math.nan), ("none", math.nan)]
        for m, v in rows:
            if not math.isnan(v):
                seen[m].append(v)
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"m": m, "v": "NaN" if math.isnan(v) else v}) for m, v in rows))
        writer = running.running_medians(running.result_stream(spark, str(folder), "m string, v double"), "v", "m", state)
        run = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert run.awaitTermination(90)
        got = {g: (n, x) for g, n, x in running.medians(spark, state, "m").collect()}
        assert math.isnan(got["none"][1]) and got["few"] == (k + 1, [0.0, 0.0, 1.0][k])
        for g in ("x", "y")[: 1 + (k > 0)]:
            n, x = got[g]
            assert n == len(seen[g]) and abs(sum(v <= x for v in seen[g]) / n - 0.5) < 0.005
    assert len(list((tmp_path / "state").iterdir())) == 2
    assert abs(running.medians(spark, state, "m", 0.9).where("m = 'x'").first()["median"] - 0.9) < 0.01


def test_vectors_of_other_shapes_are_refused(spark):
    from quillstrand.functions import records

    shaped = lambda text, how="mean": [r.v for r in spark.createDataFrame([(text,)], "t string").select(records.vectors(F.parse_json("t"), how).alias("v")).collect()][0]
    assert shaped("[1, 2.5]") == [[1.0, 2.5]] and shaped("[[1], [2]]") == [[1.0], [2.0]] and shaped(None) is None
    assert shaped("[[[1, 2], [3, 4]], [[5, 6], [5, 8]]]") == [[2.0, 3.0], [5.0, 7.0]]
    assert shaped("[[[1, 2], [3, 4]]]", "final") == [[3.0, 4.0]]
    for text, told in (("1", "not a vector"), ("[]", "not a vector"), ("[[[[1]]]]", "not a vector"), ('["a"]', "not a vector"), ("[1, [2]]", "not a vector"), ("[[1], [2, 3]]", "different lengths")):
        with pytest.raises(Exception, match=told):
            shaped(text)
    with pytest.raises(ValueError):
        shaped("[1]", "max")


def test_tokenizers_by_configuration(spark):
    df = spark.createDataFrame([("acgtac g",)], "s string")
    cut = lambda c: df.select(sq.tokenizer(c)("s")).first()[0]
    assert cut({"tokenizer_class": "KmerTokenizer", "k": 3, "stride": 3}) == ["ACG", "TAC", "GNN"]
    assert cut({"tokenizer_name": "kmer-x"}) == ["ACGTAC", "GNNNNN"]
    assert cut({}) == list("ACGTAC G")
    with pytest.raises(NotImplementedError):
        sq.tokenizer({"tokenizer_class": "PreTrainedTokenizerFast"})


def test_head_and_samples(spark):
    rows = [(i, [float(i % 2), 1.0], i % 2) for i in range(40)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = heads.logistic_head(e.where("vec_id < 30"), e.where("vec_id >= 30"), "embedding", "label")
    assert out.where("label <> pred").count() == 0
    windows = relations.expand_windows(spark.createDataFrame([(1, "x" * 100), (2, "y" * 9)], "seq_index long, sequence string"), 8)
    one, again = ({(r["seq_index"], r["window_index"]) for r in relations.sample_windows(windows, 4, True).collect()} for _ in range(2))
    assert one == again and len([k for k in one if k[0] == 1]) == 4 and len([k for k in one if k[0] == 2]) == 2


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("part"))
    got = relations.numbered(df, ["k"]).collect()
    assert {(r["k"], r["i"]) for r in got} == {(k, k + 1) for k in range(1000)} and {r["part"] for r in got} == {"x"}
    assert relations.numbered(df.where("k < 0"), ["k"]).count() == 0


@pytest.mark.parametrize("n, window, stride, start", [(1, 4, 2, 0), (4, 4, 2, 0), (9, 4, 2, 3), (10, 4, 3, 0), (23, 5, 4, 1)])
def test_each_token_once(spark, n, window, stride, start):
    lengths = spark.createDataFrame([(0, n)], "k int, n int")
    seen = [t for r in likelihood.end_aligned_plan(lengths, "k", "n", window, stride, start).collect() for t in range(r["end"] - r["scored"], r["end"])]
    assert sorted(seen) == list(range(start, n))
    plan = likelihood.range_plan(lengths, "k", "n", window, stride, start).collect()
    seen = [r["begin"] + 1 + j for r in plan for j in range(r["first"], r["last"])]
    assert all(r["end"] - r["begin"] <= window for r in plan)
    assert sorted(seen) == list(range(max(start, 1), n))


def test_strict_letters_and_loci(spark):
    made = lambda s: spark.createDataFrame([(s,)], "s string").select(sq.strict_dna("s")).first()[0]
    assert made("ACGTN") == "ACGTN"
    with pytest.raises(Exception, match="letters other"):
        made("ACGU")
    loci = [("chrx:5-9:+",), ("6:1-2:-",), ("6:1-2",), ("chr6",)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(loci, "s string").select(sq.locus("s")).collect()]
    assert got == [("x", 5, 9, "+"), ("6", 1, 2, "-"), None, None]


def test_order_and_names(spark):
    df = spark.range(50).withColumn("c", F.floor(F.col("id") / 10))
    rows = [(r["c"], r["id"]) for r in relations.epoch_order(df, "id", 1, 0, "c").collect()]
    assert [c for c, _ in rows] == sorted(c for c, _ in rows) and rows != sorted(rows)
    other = [r["id"] for r in relations.epoch_order(df, "id", 1, 1).collect()]
    assert sorted(other) == list(range(50)) and other != [i for _, i in rows]
    assert metrics.watched_metric("f1") == "f1_macro" and metrics.watched_metric("mcc") == "mcc"
    with pytest.raises(ValueError):
        metrics.watched_metric("loss")
    with pytest.raises(ValueError):
        scores.pooled(F.col("x"), "sum")

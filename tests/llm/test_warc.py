import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from quillstrand.llm import warc
from quillstrand.shared import new_path

KINDS = "page_id long, url string, html string, key string, part int"


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def back(spark, rows, **options):
    path = new_path(spark, "archive")
    warc.write_archive(warc.records(rows, "page_id", "url", "html", **options), path)
    return warc.payloads(warc.read_records(spark, path)), path


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(3)
    texts = ["", None, "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "WARC/1.", "0\r\n\r\n", "é日𝒳" * 500, "x" * 70_000]
    texts += ["".join(r.choice("ab<>\r\n é") for _ in range(r.randrange(1, 9000))) for _ in range(30)]
    texts += [r.choice(texts) for _ in range(30)]
    rows = [(k, None if k % 7 == 0 else f"http://h/{k}\r\nX: y", t, "k", 0) for k, t in enumerate(texts)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, KINDS).repartition(4)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 1000, "chunk_bytes": 333}, {"least_bytes": 5000, "segment_bytes": 1}, {"segment_bytes": 4096}])
def test_round_trip(spark, pages, options):
    if options.get("segment_bytes") == 1:
        pages = pages.where("length(html) < 100 or html is null")
    found, _ = back(spark, pages, **options)
    rows = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    got = {int(r.key): r for r in found.collect()}
    assert got.keys() == rows.keys()
    for k, payload in rows.items():
        same = [i for i, p in rows.items() if p == payload]
        first = min(same) if len(payload) >= options.get("least_bytes", 0) else k
        r = got[k]
        assert (r.record_type, r.refers_to) == (("response", None) if first == k else ("revisit", str(first)))
        assert (r.payload_bytes, r.payload_digest, r.problem) == (len(payload), b32(payload), None)
        assert r.payload is None if first != k else bytes(r.payload) == payload


def test_shuffled_payloads_beyond_the_broadcast_limit(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 0)
    found, _ = back(spark, pages, segment_bytes=4096)
    assert found.where("problem is not null").isEmpty() and found.count() == pages.count()
    assert found.where("record_type = 'revisit'").count() == pages.count() - pages.select(F.coalesce("html", F.lit(""))).distinct().count()


def test_null_keys_repeated_rows_and_empty_tables(spark):
    rows = [(None, "u", "same", "k", 0), (None, "u", "same", "k", 0), (5, "u", "same", "k", 0), (5, "u", "same", "k", 0), (None, None, "only null", "k", 0)]
    found, _ = back(spark, spark.createDataFrame(rows, KINDS))
    got = sorted((r.key or "", r.record_type, r.refers_to or "", r.payload_bytes, r.problem) for r in found.collect())
    assert got == [("", "response", "", 9, None), ("", "revisit", "5", 4, None), ("", "revisit", "5", 4, None), ("5", "response", "", 4, None), ("5", "response", "", 4, None)]
    none, _ = back(spark, spark.createDataFrame([], KINDS))
    assert none.collect() == []


def test_archives_hold_standard_records(spark):
    _, path = back(spark, spark.createDataFrame([(1, "http://h/", "hello world", "k", 0)], KINDS).coalesce(1), chunk_bytes=6)
    folder = path.removeprefix("file://")
    (name,) = [f for f in os.listdir(folder) if f.endswith(".gz")]
    raw = gzip.open(f"{folder}/{name}").read()
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert fields["WARC-Type"] == "response" and int(fields["Content-Length"]) == len(block) - 4
    assert block[:-4].endswith(b"\r\n\r\n6\r\nhello \r\n5\r\nworld\r\n0\r\n\r\n")


def record(kind, block, **fields):
    lines = [f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()], f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HEAD = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n"


def read_raw(spark, raw):
    folder = new_path(spark, "raw").removeprefix("file://")
    os.makedirs(folder)
    for k, x in enumerate(raw):
        with gzip.open(f"{folder}/{k}.warc.gz", "wb") as f:
            f.write(x)
    return {r.key: r for r in warc.payloads(warc.read_records(spark, f"file://{folder}")).collect()}


def test_faults_of_foreign_archives(spark):
    whole = HEAD + b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n"
    segment = lambda n, b, **f: record("response" if n == 1 else "continuation", b, **({"WARC_Record_ID": f"<{f.pop('of')}>"} if n == 1 else {"WARC_Segment_Origin_ID": f"<{f.pop('of')}>"}), WARC_Segment_Number=n, **f)
    first = record("warcinfo", b"software: x") + record("response", whole, X_Key="a", WARC_Record_ID="<a>", WARC_Payload_Digest=f"sha1:{b32(b'hello')}")
    first += segment(2, whole[20:40], of="b") + record("response", HEAD + b"zz\r\n", X_Key="c") + record("response", b"no header", X_Key="d")
    second = segment(3, whole[40:], of="b", WARC_Segment_Total_Length=len(whole)) + segment(1, whole[:20], of="b", X_Key="b") + segment(3, whole[40:], of="b", WARC_Segment_Total_Length=len(whole))
    second += segment(1, whole[:20], of="e", X_Key="e") + segment(3, whole[40:], of="e", WARC_Segment_Total_Length=len(whole))
    second += record("response", b"HTTP/1.0 200 OK\r\n\r\nplain", X_Key="f", WARC_Payload_Digest="sha1:WRONG") + record("revisit", b"", X_Key="g", X_Refers_To_Key="nobody", WARC_Payload_Digest="sha1:X")
    third = record("response", whole, X_Key="h")[:-20]
    got = read_raw(spark, [first, second, third, b"", b"no record at all"])
    told = {k: (r.payload and bytes(r.payload), r.problem) for k, r in got.items()}
    assert told == {"a": (b"hello", None), "b": (b"hello", None), "c": (None, "framing"), "d": (None, "no header"), "e": (None, "segments"), "f": (b"plain", "digest"), "g": (None, "no original"), "h": (None, "cut off")}


def test_query(spark):
    from quillstrand.llm.queries import op12_warc

    sf = "/root/testdata/sf0.001"
    rows = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op12_warc(spark, sf).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == {(k, len(p), b32(p)) for k, p in rows.items()}

"""WARC archives: records written with Spark's text writer, and read back by record, with segments put together again.

Archives are gzip files of WARC/1.1 records. A payload is stored once: records with the same payload revisit the one
with the smallest key. Large blocks are cut into segments (a response and its continuations, in any order and file).
Payloads stand in HTTP responses with chunked transfer framing. Two fields of our own carry keys: X-Key and
X-Refers-To-Key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrand.shared import stash

#: What every record begins with, but for the minor version.
MARK = b"WARC/1."
#: Bytes of records that a reading task hands on at a time.
BATCH_BYTES = 16 << 20
#: Rows of hash, key and URL, some 200 bytes each, that are broadcast at most.
BROADCAST = 100_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIELDS = "kind string, record_id string, key string, url string, digest string, refers_to string, number int, origin string, total long, block binary, problem string"


def payload_digest(payload: Column) -> Column:
    """SHA-1 of a binary in upper-case base 32: five hexadecimal digits make four letters."""

    def letters(digits: Column) -> Column:
        def four(i: Column) -> Column:
            v = F.conv(F.substring(digits, 5 * i + 1, F.lit(5)), 16, 10).cast("int")
            letter = lambda shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
            return F.concat(*[letter(s) for s in (15, 10, 5, 0)])

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")

    # As a lambda's variable the hash is worked out once, and not for each letter.
    return F.when(payload.isNotNull(), F.transform(F.array(F.sha1(payload)), letters)[0])


def _slices(data: Column, width: int) -> Column:
    """Binary data in pieces of width bytes, as raw strings; none of empty data."""
    n = F.octet_length(data)
    piece = lambda i: F.substring(data, i * width + 1, F.lit(width)).cast("string")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), piece)).otherwise(F.array().cast("array<string>"))


def chunked(payload: Column, width: int) -> Column:
    """A binary in chunked transfer framing, as a raw string."""
    chunk = lambda p: F.concat(F.lower(F.hex(F.octet_length(p).cast("long"))), F.lit("\r\n"), p, F.lit("\r\n"))
    return F.concat(F.array_join(F.transform(_slices(payload, width), chunk), ""), F.lit("0\r\n\r\n"))


def _urn(name: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), name, F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A field's line, nothing where the value is null. Line ends inside a value are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, key_col: str, url_col: str, payload_col: str, least_bytes: int = 0, segment_bytes: int = 64 << 20, chunk_bytes: int = 16 << 10, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record): the text of each record, without the blank line that ends it.

    Of equal payloads of least_bytes or more, the rows with the smallest key are responses and all others revisits; a
    payload for which no row has a key, and smaller ones, are responses each. Null payloads are empty ones. Rows that
    share key and payload are records of their own. Extra columns are ignored; an empty table has no records.

    Payloads are equal when their SHA-256 is; the smallest keys are summed up in the map tasks. Payloads that occur twice or
    more are broadcast if they are BROADCAST rows at most, so that no payload is shuffled; else payloads are shuffled to
    them and the small side is hashed, where a payload of a third of all rows is an ordinary skew join.
    """
    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    large = F.octet_length("payload") >= least_bytes
    first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("first")
    firsts = stash(rows.where(large).groupBy("sha").agg(F.count("*").alias("copies"), first).where("copies > 1 and first is not null").drop("copies"), "first-keys")
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST else firsts.hint("shuffle_hash"), "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key"))
    head = F.lit(HTTP)
    block = F.when(F.col("again"), head).otherwise(F.concat(head, chunked(F.col("payload"), chunk_bytes))).cast("binary")
    rows = rows.withColumn("again", again).select("key", "url", "first", "again", payload_digest(F.col("payload")).alias("digest"), block.alias("block"), F.uuid().alias("id"))
    total = F.octet_length("block")
    parts = rows.select("key", "url", "first", "again", "digest", "id", total.alias("total"), F.posexplode(_slices(F.col("block"), segment_bytes)).alias("part", "body"))
    opening, split, last = F.col("part") == 0, F.col("total") > segment_bytes, (F.col("part") + 1) * segment_bytes >= F.col("total")
    m = F.md5(F.concat("id", F.lit("/"), F.col("part").cast("string")))
    own = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    fields = [
        _line("WARC-Type", F.when(~opening, "continuation").when(F.col("again"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.when(opening, F.col("id")).otherwise(own))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("Content-Type", F.when(opening, "application/http; msgtype=response")),
        _line("WARC-Payload-Digest", F.when(opening, F.concat(F.lit("sha1:"), "digest"))),
        _line("X-Key", F.when(opening, F.col("key"))),
        _line("WARC-Profile", F.when(F.col("again"), PROFILE)),
        _line("WARC-Refers-To-Target-URI", F.when(F.col("again"), F.col("first.url"))),
        _line("X-Refers-To-Key", F.when(F.col("again"), F.col("first.key"))),
        _line("WARC-Segment-Number", F.when(split, F.col("part") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(~opening, _urn(F.col("id")))),
        _line("WARC-Segment-Total-Length", F.when(split & last, F.col("total"))),
        _line("Content-Length", F.octet_length("body")),
    ]
    return parts.select(F.concat(F.lit("WARC/1.1\r\n"), *fields, F.lit("\r\n"), F.col("body")).alias("record"))


def write_archive(found: DataFrame, path: str) -> None:
    """Write records() as gzip files below path; a task that is run again leaves nothing double."""
    found.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, what follows them, wanted length of the block) of a record that may not be complete; None if its fields aren't."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        return None
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    length = fields.get("content-length", "")
    return fields, rest, int(length) if length.isdecimal() else -1


class _Splitter:
    """Puts the pieces between marks together to records: a mark inside a block belongs to it, as its length tells."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.bytes = 0
        self.fields: dict[str, str] | None = None
        self.wanted = 0

    def _row(self, block: bytes, problem: str | None) -> tuple:
        f = self.fields or {}
        number = lambda name: int(f[name]) if f.get(name, "").isdecimal() else None
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        row = (f.get("warc-type"), f.get("warc-record-id"), f.get("x-key"), f.get("warc-target-uri"), digest, f.get("x-refers-to-key"), number("warc-segment-number"), f.get("warc-segment-origin-id"), number("warc-segment-total-length"), block, problem)
        self.held, self.bytes, self.fields = [], 0, None
        return row

    def add(self, piece: bytes) -> Iterator[tuple]:
        if self.held:
            piece = MARK + piece
        self.held.append(piece)
        self.bytes += len(piece)
        if self.fields is None:
            if (found := _parsed(raw := b"".join(self.held))) is None:
                return
            self.fields, rest, self.wanted = found
            self.held, self.bytes = [rest], len(rest)
            if self.wanted < 0:
                yield self._row(rest, "no length")
                return
        if self.bytes >= self.wanted:
            block = b"".join(self.held)
            yield self._row(block[: self.wanted], None)

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield self._row(b"".join(self.held), "cut off")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in FIELDS.split(", "))])
    ready: list[tuple] = []
    size, file, state = 0, None, _Splitter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)

    for got in batches:
        files, starts = got.column("file").to_pylist(), got.column("start").to_pylist()
        for value, here, start in zip(got.column("value"), files, starts):
            if start:
                raise ValueError(f"{here} is read in parts: archives must be gzip files")
            if here != file:
                ready += state.end()
                file, state = here, _Splitter()
                continue  # what stands before a file's first mark
            for row in state.add(value.as_py()):
                ready.append(row)
                size += len(row[9])
            if size >= BATCH_BYTES:
                yield batch()
                ready, size = [], 0
    ready += state.end()
    if ready:
        yield batch()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the gzip archives at path, in any folder: FIELDS.

    Fields that a record lacks are null. problem: "no length" or "cut off" (the block is what was there). Files are read
    whole and in order by Spark's text source, a record at a time, so a task needs memory for its largest record.
    """
    lines = spark.read.option("lineSep", MARK.decode()).option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.mapInArrow(_split, FIELDS)


def reassembled(found: DataFrame) -> DataFrame:
    """Responses and revisits with whole blocks: segments are grouped by their origin's id, put in order by number, and
    checked to be 1, 2, ... up to the total length, which the last one states.

    A segment that was stored twice counts once. Else the problem is "segments" and the block null; the fields are
    those of the first segment, null if it is absent. Records without segments pass as they are. A group holds one block.
    """
    kept = ["kind", "record_id", "key", "url", "digest", "refers_to", "block", "problem"]
    whole = found.where("number is null and kind in ('response', 'revisit')").select(kept)
    parts = found.where("number is not null").withColumn("id", F.coalesce("origin", "record_id"))
    first = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in kept[:6]]
    groups = parts.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("problem").alias("problem"), *first)
    order = F.transform("parts", lambda p: p["number"])
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    good = (order == F.sequence(F.lit(1), F.size("parts"))) & (F.octet_length(block) == F.col("total"))
    groups = groups.withColumn("block", F.when(good, block)).withColumn("problem", F.coalesce("problem", F.when(~F.coalesce(good, F.lit(False)), "segments")))
    return whole.union(groups.select(kept))


def body(block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, problem) of an HTTP message: what follows its header, with chunked framing taken off."""
    head, found, rest = block.partition(b"\r\n\r\n")
    if not found:
        return None, "no header"
    lines = [x.partition(b":") for x in head.lower().split(b"\r\n")[1:]]
    if not any(n.strip() == b"transfer-encoding" and b"chunked" in v for n, _, v in lines):
        return rest, None
    out, at = [], 0
    while (end := rest.find(b"\r\n", at)) >= 0:
        try:
            n = int(rest[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if n == 0:
            return b"".join(out), None
        at = end + 2 + n
        if n < 0 or rest[at : at + 2] != b"\r\n":
            break
        out.append(rest[end + 2 : at])
        at += 2
    return None, "framing"


def _bodies(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if b is None else body(b) for b in blocks], columns=["payload", "fault"], dtype=object)


def payloads(found: DataFrame, keep_payload: bool = True) -> DataFrame:
    """(key, url, record_type, payload, payload_bytes, payload_digest, refers_to, problem) of the records' pages, without
    payload if it isn't kept.

    Keys are text. A revisit's payload is null; its length comes from the response of the key and digest that it names,
    for which the pages are written as a table once. problem is null for sound pages, else what was found first: a record's or segment's fault, "no header", "framing",
    "digest" (not that of the payload) or "no original".
    """
    whole = reassembled(found)
    own = whole.where("kind = 'response'").select("key", "url", "digest", "problem", F.pandas_udf(_bodies, "payload binary, fault string")("block").alias("b"))
    own = own.select("key", "url", "digest", F.col("b.payload").alias("payload"), F.coalesce("problem", "b.fault").alias("problem"))
    own = own.withColumn("made", payload_digest(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    wrong = F.when(F.col("digest") != F.col("made"), "digest")
    own = stash(own if keep_payload else own.drop("payload"), "payloads")
    payload, none = (["payload"], [F.lit(None).cast("binary").alias("payload")]) if keep_payload else ([], [])
    responses = own.select("key", "url", F.lit("response").alias("record_type"), *payload, "payload_bytes", F.col("made").alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"), F.coalesce("problem", wrong).alias("problem"))
    stored = own.where("made is not null and key is not null").groupBy(F.col("key").alias("refers_to"), F.col("made").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = whole.where("kind = 'revisit'").join(stored, ["refers_to", "digest"], "left")
    lost = F.when(F.col("payload_bytes").isNull(), "no original")
    return responses.union(again.select("key", "url", "kind", *none, "payload_bytes", "digest", "refers_to", F.coalesce("problem", lost)))

"""Line deduplication by how frequent a line is within its site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrand.shared import settled, stash

#: A line on more than this share of its host's pages is boilerplate.
RATIO = 0.02
#: Lines are compared without these around them.
WHITE = " \t\r\x0b\x0c"
#: Frequent lines, their hashes and the hosts are broadcast up to so many bytes each; more are joined, frequent lines with the
#: pages of a host dealt over SALTS parts.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def _bare(lines: str) -> Column:
    return F.transform(lines, lambda x: F.trim(x, F.lit(WHITE)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = 1) -> DataFrame:
    """pages: host, lines. Returns (host, boiler): per host the sorted trimmed lines that exceed the ratio.

    A line counts once per page. A host has at most (mean lines per page / ratio) such lines, so the array is
    bounded by the pages' length, not by their number.

    Lines are counted by their 64-bit hashes first. Lines that share a hash count together there, so that count is never too
    low; where few hashes exceed the ratio, only lines with these are shuffled as texts, and counted by themselves.
    """
    totals = stash(pages.groupBy("host").agg(F.count("*").alias("n_pages")), "hosts")
    totals = F.broadcast(totals) if _fits(totals, F.octet_length("host")) else totals
    bare = F.array_distinct(F.filter(_bare("lines"), lambda x: x != ""))
    lines = pages.select("host", F.explode(bare).alias("line"))

    def frequent(rows: DataFrame, by: str) -> DataFrame:
        counts = rows.groupBy("host", by).agg(F.count("*").alias("n_with")).where(F.col("n_with") >= least_pages)
        return counts.join(totals, "host").where(F.col("n_with") > F.lit(ratio) * F.col("n_pages")).select("host", by)

    hashed = F.xxhash64("line").alias("h")
    maybe = stash(frequent(lines.select("host", hashed), "h"), "frequent-hashes")
    if _fits(maybe, F.octet_length("host") + 8):
        lines = lines.select("host", "line", hashed).join(F.broadcast(maybe), ["host", "h"], "left_semi")
    return frequent(lines, "line").groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("boiler"))


def _fits(table: DataFrame, size: Column) -> bool:
    """Whether a table whose rows have this size, and 16 bytes besides, is small enough to be broadcast."""
    return (table.agg(F.sum(size + 16)).first()[0] or 0) <= BROADCAST_BYTES


def _with_boiler(rows: DataFrame, boiler: DataFrame) -> DataFrame:
    if _fits(boiler, F.octet_length("host") + F.aggregate("boiler", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)):
        return rows.join(F.broadcast(boiler), "host", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("own_id", "lines"), F.lit(SALTS)))
    copies = boiler.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["host", "salt"], "left")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = 1, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: the id, clean_text, n_lines, n_dropped.

    A line is what stands between newlines; lines are compared without the white space around them, and blank lines
    always stay. n_with pages of n_pages of the host hold the line: it goes from all of them if n_with / n_pages > ratio.
    So a host with fewer than 1 / ratio pages loses every line; least_pages asks for so many pages with the line besides,
    2 keeping those of one page. Null text counts as empty (one blank line); null hosts form one
    site. Repeated rows count as pages of their own. Other columns are ignored; empty tables give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.split(text, "\n", -1).alias("lines"))
    known = _with_boiler(rows, settled(pages.sparkSession, lambda: boilerplate(rows, ratio, least_pages), "boilerplate"))
    # The page's own boilerplate by hashing, so that only these are compared with each line.
    known = known.withColumn("gone", F.array_intersect(_bare("lines"), F.coalesce("boiler", F.array().cast("array<string>"))))
    stays = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("gone"), F.trim(x, F.lit(WHITE)))))
    out = known.select("own_id", F.size("lines").cast("long").alias("n_lines"), stays.alias("stays"))
    return out.select(F.col("own_id").alias(id_col), F.array_join("stays", "\n").alias("clean_text"), "n_lines", (F.col("n_lines") - F.size("stays")).alias("n_dropped"))

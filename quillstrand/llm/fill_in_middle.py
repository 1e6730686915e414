"""Fill-in-the-middle samples: whole texts cut in three at units, and put together in another order around sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A unit of one code point.
CODE_POINT = "(?s)."
#: Units of one code point are exploded in runs of so many, which keeps a row a document for most texts.
RUN = 4096
#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits: the first groups of the hexadecimal SHA-256 of seed:key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _any(sentinels: tuple[str, str, str]) -> str:
    return "|".join(rf"\Q{s}\E" for s in sentinels)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a sample was made of, from the sample and its form alone."""
    part = F.split(output, _any(sentinels))
    at = lambda k: F.get(part, k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = "1", rate: int = 90, suffix_first: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of every row.

    A text has n units, the matches of unit from left to right; what stands before a match belongs to its unit, what
    follows the last match to the suffix. The draws of an id tell how many units the prefix has, where the middle ends,
    and the form: plain (the text as it is) for empty texts, texts that hold a sentinel and those beyond rate per cent;
    else spm (suffix, prefix, middle) for suffix_first per cent and psm for the others. Lengths are in code points, null
    in plain rows.

    Null text counts as empty, a null id as the text "null". Rows that share id and text get the same sample, each its
    own row; rows of one id with different texts are cut each by its own n. Other columns are ignored; an empty table
    gives none.

    The offsets come from a join of requested unit numbers with running sums of unit lengths. Their rows are small: a row
    for each match, or for RUN code points. Rows that share id and text are summed up before any shuffle, so a key
    never has more rows than its text has units. The text itself moves once, to meet its offsets.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    h = draws(named, seed)
    single = unit == CODE_POINT
    n = F.length("text") if single else F.size(F.regexp_extract_all("text", F.lit(unit), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.array(*h).alias("h"), F.unhex(F.md5(F.concat(F.sha2(named, 256), text))).alias("key"))
    rows = rows.withColumn("n", n.cast("long"))
    plain = (F.col("text") == "") | F.col("text").rlike(_any(sentinels)) | (F.get("h", 2) % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.get("h", 3) % 100 < suffix_first, "spm").otherwise("psm"))
    cut = rows.where("form <> 'plain'")

    first, second = F.get("h", 0) % (F.col("n") + 1), F.get("h", 1) % (F.col("n") + 1)
    asked = F.array(F.struct(F.lit("a").alias("end"), F.least(first, second).alias("units")), F.struct(F.lit("b").alias("end"), F.greatest(first, second).alias("units")))
    requests = cut.select("key", F.explode(asked).alias("r")).select("key", "r.end", "r.units").where("units > 0").distinct()

    width = RUN if single else 1
    # \G: only where the match before ended, so what follows the last unit is searched once and not from each of its places.
    pattern = f"(?s).{{1,{RUN}}}" if single else rf"\G(?s:.*?)(?:{unit})"
    runs = cut.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run", "match"))
    runs = runs.groupBy("key", "run").agg(F.max(F.length("match")).alias("chars"))
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0)))

    placed = requests.withColumn("run", F.floor((F.col("units") - 1) / width).cast("int")).join(starts, ["key", "run"])
    # Inside a run of code points, units are characters; elsewhere a run is one unit.
    offset = F.col("before") + (F.col("units") - F.col("run") * width if single else F.col("chars"))
    ends = placed.groupBy("key").agg(*[F.max(F.when(F.col("end") == e, offset)).cast("int").alias(e) for e in ("a", "b")])

    out = rows.join(ends.hint("shuffle_hash"), "key", "left")
    a, b = (F.coalesce(e, F.lit(0)) for e in ("a", "b"))
    p, m, s = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    before_p, before_s, before_m = (F.lit(x) for x in sentinels)
    sample = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(before_p, p, before_s, s, before_m, m)).otherwise(F.concat(before_s, s, before_p, p, before_m, m))
    lengths = [F.when(F.col("form") != "plain", x.cast("long")).alias(c) for c, x in (("prefix_chars", a), ("middle_chars", b - a))]
    return out.select("doc_id", "text", "n", "form", *lengths, sample.alias("output"))

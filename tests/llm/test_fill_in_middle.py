import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillstrand.llm.fill_in_middle import RUN, fill_in_middle, restored


def brute(key, text, unit="(?s)."):
    """The sample of one document, from the contract's words."""
    text = text or ""
    ends = [m.end() for m in re.finditer(unit, text)]
    n = len(ends)
    h = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (a, b))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "\n", "one two\nthree", "𝒳é́ 日本 <", "<P", "has <S> inside", "x" * (RUN * 2), "ab𝒳" * (RUN + 7), "w " * 3000] + [f"text number {k} \n of <some> kind" for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (None, None, "x", 1)]
    rows += [(7, "other text of one id", "x", 1)] * 2 + [(8, "again and again", "x", 1)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, key string, run int").repartition(5)


@pytest.mark.parametrize("unit", ["(?s).", "[a-z]+", r"[^\n]{0,99}\n"])
def test_samples_equal_brute_force(docs, unit):
    got = fill_in_middle(docs, unit=unit).select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "n", "form", "prefix_chars", "middle_chars", "output").collect()
    want = sorted([(r.doc_id, r.text or "", *brute(r.doc_id, r.text, unit)) for r in docs.collect()], key=repr)
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_are_restored_from_output_and_form(docs):
    out = fill_in_middle(docs)
    assert out.where(~restored(F.col("output"), F.col("form")).eqNullSafe(F.col("text"))).isEmpty()


def test_empty_table_and_rates(spark, docs):
    assert fill_in_middle(docs.limit(0)).collect() == []
    assert {r.form for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(docs, rate=100, suffix_first=100).collect()} == {"plain", "spm"}


def test_query_gives_digests_of_every_row(spark):
    from quillstrand.llm.queries import op13_fill_in_middle

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_fill_in_middle(spark, sf).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        n, form, a, m, output = brute(r.doc_id, rows[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, a, m, sha(output), sha(rows[r.doc_id] or ""))

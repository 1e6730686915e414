"""Queries over long texts against brute force."""

import hashlib
import random

import pytest

from quillstrand import catalogue
from quillstrand.functions import scores
from quillstrand.functions import sequence as sq

TINY = random.Random(7)
#: Over 1,024 and 7,420 letters, so that k reaches 4 and 5; differences only after letter 600; one empty text; other characters.
LONG = "".join(TINY.choice("acgt") for _ in range(9000))
TEXTS = [LONG, LONG[:8000] + "".join(TINY.choice("acgt") for _ in range(1500)), LONG[:1500], LONG[:700] + "g" * 800, "", "acgt" * 300, "aé漢🙂 " * 250 + "acg", "atg" * 400 + "taa", "atg" * 300, "a"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def masked(text):
    """The letters of a sequence row as _pairs makes them."""
    folded = text.lower().translate(str.maketrans(catalogue.ABC, catalogue.FOLD))
    return "".join(c if " " <= c <= "~" else "#" for c in folded)


def pairs():
    """doc_id -> text, continuation cut to its length, whole continuation."""
    s = [masked(t) for t in TEXTS]
    return {i: (s[i], s[i + 1][: len(s[i])], s[i + 1]) for i in range(len(s) - 1)}


def table(a, b, match, other, gap, best):
    row = [j * gap for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i * gap]
        for j, y in enumerate(b, 1):
            new.append(best(row[j - 1] + (match if x == y else other), row[j] + gap, new[-1] + gap))
        row = new
    return row[-1]


def rows(spark, name, folder):
    return {r["doc_id"]: r for r in catalogue.queries()[name](spark, folder).collect()}


def coding(s):
    codons = [s[i : i + 3] for i in range(0, len(s) - 2, 3)]
    return len(s) >= 3 and len(s) % 3 == 0 and codons[-1] in sq.STOPS and not any(c in sq.STOPS for c in codons[:-1])


def test_edit_and_alignment_by_brute_force():
    for _ in range(60):
        a, b = ("".join(TINY.choice("ACG") for _ in range(TINY.randint(0, 90))) for _ in "ab")
        assert scores._edits(a, b) == table(a, b, 0, 1, 1, min)
        assert scores._global_score(a, b) == table(a, b, 1, -1, -1, max)


def test_pairs_are_scored_whole(spark, folder):
    exact, edit, align, kmer, made = (rows(spark, n, folder) for n in ("exact_match", "edit_distance", "alignment_score", "kmer_metrics", "completion_metrics"))
    for i, (t, m, whole) in pairs().items():
        same = sum(x == y for x, y in zip(t, m)) / len(t) if t and len(t) == len(m) else 0
        assert exact[i]["exact_match"] == pytest.approx(same, abs=1e-8)
        if max(len(t), len(m)) < 1600:
            d = table(t, m, 0, 1, 1, min) / len(t) if t else 0
            assert edit[i]["edit_distance"] == pytest.approx(d, abs=1e-8)
            assert align[i]["alignment_identity"] == pytest.approx(table(t, m, 1, -1, -1, max) / len(t) if t else 0)
        if t and m:
            least = min(sum(c in "ACGT" for c in x) for x in (t, m))
            assert kmer[i]["kmer_k"] == 1 + sum(least >= n for n in sq.K_THRESHOLDS)
        assert made[i]["is_cds"] == coding(whole)
    assert {kmer[i]["kmer_k"] for i in kmer} >= {1, 4, 5}
    # Alike up to letter 8,000 of 9,000.
    assert 8000 / 9000 <= exact[0]["exact_match"] < 1 and 0 < edit[0]["edit_distance"] < 0.12


def test_tokens_are_whole(spark, folder):
    made = [rows(spark, n, folder) for n in ("kmer_text", "char_tokens", "kmer_tokens")]
    for i, text in enumerate(TEXTS):
        s, bare = text.replace(" ", "_"), "".join(text.split()).upper()
        mers = " ".join(s[k : k + 6] for k in range(len(s) - 5)) if len(s) >= 6 else s
        chunks = [bare[k : k + 6].ljust(6, "N") for k in range(0, len(bare), 6)]
        want = [mers, "|".join(text.upper()), "|".join(chunks)]
        assert [m[i]["digest"] for m in made] == [hashlib.md5(w.encode()).hexdigest() for w in want]


def test_overlapping_chunks(spark):
    got = spark.createDataFrame([("acgtacg",), ("",)], "s string").select(sq.fixed_tokens("s", 4, 2).alias("t")).collect()
    assert [r["t"] for r in got] == [["ACGT", "GTAC", "ACGN", "GNNN"], []]

"""Column functions over sequence strings: cleaning, complements, codons, k-mers, tokens. No UDFs."""

from __future__ import annotations

import itertools
import math

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"

# Letters and their complements, and the letter each codon stands for in the order TCAG.
COMPLEMENT_IUPAC = ("ACGTRYMKBDHVN", "TGCAYRKMVHDBN")
COMPLEMENT_PLAIN = ("ACGTN", "TGCAN")
CODON_LETTERS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("TAA", "TAG", "TGA")
BASE_IDS = {"A": 1, "C": 2, "G": 3, "T": 4, "N": 5}

CODONS = {"".join(c): a for c, a in zip(itertools.product("TCAG", repeat=3), CODON_LETTERS)}


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(s: Column | str, iupac: bool = True) -> Column:
    """Both cases; letters outside the table stay as they are."""
    a, b = COMPLEMENT_IUPAC if iupac else COMPLEMENT_PLAIN
    return F.reverse(F.translate(_text(s), a + a.lower(), b + b.lower()))


def strip_upper(s: Column | str) -> Column:
    return F.upper(F.btrim(_text(s), F.lit(WHITE)))


def unspaced_upper(s: Column | str) -> Column:
    return F.upper(F.regexp_replace(_text(s), r"\s", ""))


def as_dna(s: Column | str) -> Column:
    return F.replace(strip_upper(s), F.lit("U"), F.lit("T"))


def clean_drop(s: Column | str) -> Column:
    """Only A, C, G, T, N remain."""
    return F.regexp_replace(as_dna(s), "[^ACGTN]", "")


def clean_mask(s: Column | str) -> Column:
    """Every other character becomes N."""
    return F.regexp_replace(as_dna(s), "[^ACGTN]", "N")


def keep_alphabet(s: Column | str) -> Column:
    """A, C, G, T, N of both cases; if nothing is left, the upper-cased input."""
    kept = F.regexp_replace(_text(s), "[^ACGTNacgtn]", "")
    return F.when(kept != "", kept).otherwise(F.upper(_text(s)))


def to_rna(s: Column | str) -> Column:
    return F.replace(strip_upper(s), F.lit("T"), F.lit("U"))


def is_strict_dna(s: Column | str) -> Column:
    return _text(s).rlike("^[ACGTN]+\\z")


def strict_dna(s: Column | str) -> Column:
    """The text, if it is letters of A, C, G, T, N alone; any other fails the query."""
    return F.when(is_strict_dna(s), _text(s)).otherwise(F.raise_error(F.lit("sequence has letters other than A, C, G, T, N")))


def codons(s: Column) -> Column:
    """Whole codons from the first letter on."""
    return F.coalesce(F.regexp_extract_all(s, F.lit("(?s)..."), F.lit(0)), F.array().cast("array<string>"))


def codon_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])


def translate_codons(s: Column | str, mode: str = "first_orf", frame: int = 0, stop_at_stop: bool = True) -> Column:
    """Amino acids of the cleaned sequence. first_orf starts at the first ATG, or at 0 if there is none;
    fixed_frame at frame. Unknown codons give X; a stop ends the chain, or gives X; nothing gives X."""
    clean = clean_drop(s)
    start = F.greatest(F.locate("ATG", clean), F.lit(1)) if mode == "first_orf" else F.lit(frame + 1)
    table = codon_map()
    letters = F.transform(codons(F.substring(clean, start, F.length(clean))), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X")))
    chain = F.array_join(letters, "")
    chain = F.split_part(chain, F.lit("*"), F.lit(1)) if stop_at_stop else F.translate(chain, "*", "X")
    return F.when((F.length(clean) < 3) | (chain == ""), F.lit("X")).otherwise(chain)


def is_coding_region(s: Column | str) -> Column:
    """Length a multiple of three, a stop codon at the end and none before it. No start codon is asked for."""
    up = F.upper(F.coalesce(_text(s), F.lit("")))
    inner = F.slice(codons(up), F.lit(1), F.greatest(F.floor(F.length(up) / 3).cast("int") - 1, F.lit(0)))
    return (F.length(up) >= 3) & (F.length(up) % 3 == 0) & F.right(up, F.lit(3)).isin(*STOPS) & ~F.exists(inner, lambda c: c.isin(*STOPS))


def effective_length(s: Column | str) -> Column:
    """Upper-case A, C, G, T; lower case is masked."""
    return F.length(F.regexp_replace(_text(s), "[^ACGT]", ""))


def auto_k(n: Column) -> Column:
    """0.7 * log4(n) rounded half to even, from 1 to 13, as thresholds of n."""
    out = F.lit(1)
    for k, least in enumerate(K_THRESHOLDS, 2):
        out = F.when(n >= least, F.lit(k)).otherwise(out)
    return out


def _least_for(k: int) -> int:
    """The least n with 0.7 * log4(n) > k - 0.5; a tie goes to the even k."""
    x = 4 ** ((k - 0.5) / 0.7)
    near = round(x)
    tie = abs(x - near) < 1e-9 * x and abs((k - 0.5) / 0.7 - round((k - 0.5) / 0.7)) < 1e-9
    return near + k % 2 if tie else math.ceil(x)


K_THRESHOLDS = [_least_for(k) for k in range(2, 14)]


def kmers(s: Column | str, k: Column | int) -> Column:
    """All substrings of k letters that are upper-case A, C, G, T throughout."""
    c, k = _text(s), F.lit(k) if isinstance(k, int) else k
    # One pass with a look ahead: a substring at a place is sought from the start of the text each time.
    found = F.regexp_extract_all(c, F.concat(F.lit("(?=([ACGT]{"), k.cast("string"), F.lit("}))")), F.lit(1))
    return F.when((k > 0) & (F.length(c) >= k), found).otherwise(F.array().cast("array<string>"))


def kmer_text(s: Column | str, k: int) -> Column:
    """Overlapping k-mers joined by spaces; texts with a space or shorter than k pass through."""
    c = _text(s)
    words = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return F.when(F.contains(c, F.lit(" ")) | (F.length(c) < k), c).otherwise(F.array_join(words, " "))


def fixed_tokens(s: Column | str, k: int, stride: int | None = None) -> Column:
    """Chunks of k letters every stride letters, the last padded with N."""
    c, step = unspaced_upper(s), stride or k
    cut = F.transform(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{1,{k}}})).{{1,{step}}}"), F.lit(1)), lambda x: F.rpad(x, k, "N"))
    return F.when(F.length(c) > 0, cut).otherwise(F.array().cast("array<string>"))


def char_tokens(s: Column | str) -> Column:
    return F.when(F.length(_text(s)) > 0, F.split(F.upper(_text(s)), "")).otherwise(F.array().cast("array<string>"))


def encode_tokens(tokens: Column, vocabulary: dict[str, int], unknown: int, length: int | None = None, pad: int = 0, pad_left: bool = False, end: int | None = None) -> Column:
    """Ids of tokens; misses get unknown; cut or padded to length."""
    table = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    ids = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unknown)))
    if end is not None:
        ids = F.concat(ids, F.array(F.lit(end)))
    if length is None:
        return ids
    ids = F.slice(ids, 1, length)
    fill = F.array_repeat(F.lit(pad), F.lit(length) - F.size(ids))
    return F.concat(fill, ids) if pad_left else F.concat(ids, fill)


def decode_tokens(ids: Column, letters: dict[int, str], special: list[int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    kept = F.filter(ids, lambda i: ~i.isin(*special)) if special else ids
    return F.array_join(F.transform(kept, lambda i: F.coalesce(F.try_element_at(table, i), F.lit(""))), "")


def kmer_id(token: Column, alphabet: str = "ACGTN", first: int = 7) -> Column:
    """The place of a k-mer in the lexicographic product of alphabet, counted from first; null for other letters."""
    digits = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * len(alphabet) + d)
    return F.when(~F.exists(digits, lambda d: d < 0), value + first)


def base_ids(s: Column | str) -> Column:
    return encode_tokens(char_tokens(s), BASE_IDS, 5)


def rna_ids(s: Column | str, vocabulary: dict[str, int], length: int, pad: int = 0) -> Column:
    """struct(ids, mask) of the RNA's letters, cut or padded to length. Unknown letters are pad, but stay in the mask."""
    letters = char_tokens(to_rna(s))
    n = F.least(F.size(letters), F.lit(length))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return F.struct(encode_tokens(letters, vocabulary, pad, length, pad).alias("ids"), mask.alias("mask"))


def tokenizer(config: dict) -> Callable[[Column | str], Column]:
    """The tokenizer that a configuration names, as a function of a column: tokens of k letters every stride letters for a
    class "kmertokenizer" or a name that begins with kmer, else letters. A class "pretrainedtokenizerfast" has a
    vocabulary of merges, which no column function stands for: NotImplementedError."""
    kind, name = str(config.get("tokenizer_class", "")).lower(), str(config.get("tokenizer_name", "")).lower()
    if kind == "kmertokenizer" or name.startswith("kmer"):
        k, stride = int(config.get("k", 6)), int(config.get("stride", 6))
        return lambda s: fixed_tokens(s, k, stride)
    if kind == "pretrainedtokenizerfast":
        raise NotImplementedError("merges are not a column function")
    return char_tokens


def six_cut(s: Column | str) -> Column:
    c = _text(s)
    return F.substring(c, F.lit(1), (F.floor(F.length(c) / 6) * 6).cast("int"))


def six_align(s: Column | str, mode: str = "pad_left") -> Column:
    """struct(aligned, added, truncated): padded with A or cut on the left to a multiple of 6."""
    c = _text(s)
    over = F.length(c) % 6
    zero = F.lit(0)
    if mode == "pad_left":
        add = (6 - over) % 6
        return F.struct(F.concat(F.repeat(F.lit("A"), add), c).alias("aligned"), add.alias("added"), zero.alias("truncated"))
    return F.struct(F.substring(c, over + 1, F.length(c)).alias("aligned"), zero.alias("added"), over.alias("truncated"))


def six_prompt(n: Column, added: Column, truncated: Column, total: Column) -> Column:
    """A prompt length moved along with the alignment, clamped, and lowered to a multiple of 6."""
    return (F.floor(F.greatest(F.lit(0), F.least(n + added - truncated, total)) / 6) * 6).cast("int")


def wrap60(s: Column | str) -> Column:
    return F.regexp_replace(_text(s), r"(.{60})(?=.)", "$1\n")


def fasta_wrapped(s: Column | str, begin: str, end: str) -> Column:
    """The text without white space in lines of 60 letters, between the two marks."""
    return F.concat(F.lit(begin), wrap60(F.regexp_replace(_text(s), r"\s", "")), F.lit(end))


def spaced(s: Column | str) -> Column:
    return F.array_join(F.split(F.regexp_replace(_text(s), r"\s", ""), ""), " ")


def sequence_type(s: Column | str) -> Column:
    return F.when(F.upper(_text(s)).rlike("^[ACGTUN-]*\\z"), F.lit("gene")).otherwise(F.lit("prot"))


LOCUS = r"(?i)^(?:chr)?([0-9XYM]+):([0-9]+)-([0-9]+):([+-])\z"


def locus(s: Column | str) -> Column:
    """struct(chrom, start, stop, strand), the chromosome as it stands; null where the text is no locus or has no strand."""
    c = _text(s)
    part = lambda k: F.regexp_extract(c, LOCUS, k)
    fields = F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("stop"), part(4).alias("strand"))
    return F.when(c.rlike(LOCUS), fields)


def padded_length(n: Column, factor: int) -> Column:
    return (F.ceil(n / F.lit(float(factor))) * factor).cast("long")

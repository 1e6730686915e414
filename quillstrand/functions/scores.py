"""Column functions over numbers and arrays: prompts, windows, similarity, likelihood, logits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstrand.functions import waves

#: Characters before the scored part of a sequence.
SCORED_AFTER = 128


def nan() -> Column:
    return F.lit(float("nan"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def prompt_length(n: Column, wanted: Column | int | None = None) -> Column:
    w = F.lit(-1) if wanted is None else F.lit(wanted) if isinstance(wanted, int) else F.coalesce(wanted, F.lit(-1))
    pick = F.when(w < 0, F.floor(n / 2).cast("int")).otherwise(w)
    return F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(n - 1, pick)))


def window_starts(n: Column, width: int) -> Column:
    """0, width, 2 width, ..., and one more at the end if the last window doesn't reach it."""
    if width <= 0:
        raise ValueError("width must be positive")
    full = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), F.lit(width))
    tail = F.when(n % width != 0, F.array(n - width)).otherwise(F.array().cast("array<int>"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= width, F.array(F.lit(0))).otherwise(F.concat(full, tail))


def window_at(s: Column, start: Column, width: int) -> Column:
    n = F.length(s)
    return F.when(n <= width, s).when(start + width > n, F.right(s, F.lit(width))).otherwise(F.substring(s, start + 1, F.lit(width)))


def strip_prefix(text: Column, prefix: Column) -> Column:
    return F.when((prefix != "") & F.startswith(text, prefix), F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)


def same_places(a: str | None, b: str | None) -> int:
    """How many letters of two texts of one length are the same; 0 for other lengths and nulls."""
    if not a or not b or len(a) != len(b):
        return 0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    return int(np.count_nonzero(x == y))


def _same_places(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([same_places(x, y) for x, y in zip(a, b)], dtype="int64")


def exact_match(a: Column, b: Column) -> Column:
    n = F.length(a)
    return F.when((n > 0) & (n == F.length(b)), F.pandas_udf(_same_places, "long")(a, b) / n).otherwise(F.lit(0.0))


def _edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    return waves.compare(waves.Edits, [a], [b])[0]


def _distances(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series(waves.compare(waves.Edits, a, b), dtype="Int64")


def edit_distance(truth: Column, made: Column) -> Column:
    return F.when(F.length(truth) > 0, F.pandas_udf(_distances, "long")(truth, made) / F.length(truth)).otherwise(F.lit(0.0))


def _global_score(a: str, b: str) -> int:
    """Global alignment score with match 1, mismatch -1, gap -1."""
    return waves.compare(waves.Alignment, [a], [b])[0]


def _alignments(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        found = waves.compare(waves.Alignment, a, b)
        yield pd.Series([None if s is None else s / len(x) if x else 0.0 for x, s in zip(a, found)], dtype="float64")


def alignment_score(a: Column | str, b: Column | str) -> Column:
    """Alignment score over the length of the first text; 0 for an empty first text, null for nulls."""
    return F.pandas_udf(_alignments, "double")(a, b)


def bits_per_base(avg_nll: Column, tokens: Column, chars: Column | None = None, char_count: Column | None = None) -> Column:
    """Bits per scored character; NaN where it can't be told. chars: whole length, of which the part after
    SCORED_AFTER is scored; or else char_count as it is. Never more characters than tokens."""
    n = chars - SCORED_AFTER if chars is not None else char_count
    bad = (F.coalesce(tokens, F.lit(0)) <= 0) | ~is_finite(avg_nll) | F.coalesce(n <= 0, F.lit(True))
    return F.when(bad, nan()).otherwise(avg_nll * tokens / F.least(n, tokens) / math.log(2))


def safe_exp(x: Column) -> Column:
    return F.when(F.isnan(x), nan()).when(x > 700, F.lit(float("inf"))).when(x == F.lit(float("-inf")), F.lit(0.0)).otherwise(F.exp(F.least(x, F.lit(700.0))))


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(z: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def l2_normalised(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / (norm + 1e-12))


def four_places(x: Column) -> Column:
    return F.when(is_finite(x), F.format_string("%.4f", x)).otherwise(F.lit(""))


def mean_log_prob(log_probs: Column, n: Column) -> Column:
    """Mean over the first n - 1 places of an array (a sequence of n tokens predicts n - 1); 0 if there are none."""
    return array_mean(F.slice(log_probs, F.lit(1), F.greatest(F.least(n - 1, F.size(log_probs)), F.lit(0))), 0.0)


def array_mean(x: Column, empty: float) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double"))
    return F.when(F.size(x) > 0, total / F.size(x)).otherwise(F.lit(empty))


def _where(x: Column, mask: Column | None) -> Column:
    return x if mask is None else F.transform(F.filter(F.arrays_zip(x.alias("x"), mask.alias("m")), lambda e: e["m"] > 0), lambda e: e["x"])


def masked_mean(x: Column, mask: Column, empty: float = 0.0) -> Column:
    """Mean of the places with a mask over 0; empty if there are none (some providers ask for NaN)."""
    return array_mean(_where(x, mask), empty)


def averaged(a: Column, b: Column) -> Column:
    """Half the sum of two arrays, place by place: a prediction and that of the reverse complement."""
    return F.zip_with(a, b, lambda x, y: 0.5 * (x + y))


def pooled(tokens: Column, how: str = "mean", mask: Column | None = None) -> Column:
    """One vector of an array of token vectors by mean, max, min, cls (the first token) or final (the last). Tokens with a
    mask of 0 don't count, except for cls; if none counts, the mean is zero and the others take all tokens."""
    full = F.transform(tokens, lambda v: F.transform(v, lambda x: x.cast("double")))
    kept = _where(full, mask)
    used = F.when(F.size(kept) > 0, kept).otherwise(full)
    fold = lambda vs, f: F.aggregate(F.slice(vs, F.lit(2), F.size(vs)), vs[0], lambda a, v: F.zip_with(a, v, f))
    if how == "mean":
        none = F.size(kept) == 0
        return F.transform(fold(used, lambda a, b: a + b), lambda x: F.when(none, F.lit(0.0)).otherwise(x / F.size(used)))
    if how in ("max", "min"):
        return fold(used, (lambda a, b: F.greatest(a, b)) if how == "max" else (lambda a, b: F.least(a, b)))
    if how not in ("cls", "final"):
        raise ValueError(f"unknown pooling: {how}")
    return full[0] if how == "cls" else F.element_at(used, -1)


def perplexity_fields(nll: Column, tokens: Column, chars: Column, mode: str = "token") -> Column:
    """struct(avg_nll_token, avg_nll_char, ppl_token, ppl_char, ppl) of a summed negative log-likelihood; NaN where the
    count is not over 0. ppl is that of mode."""
    if mode not in ("token", "char"):
        raise ValueError(f"unknown mode: {mode}")
    mean = lambda n: F.when(n > 0, nll / n).otherwise(nan())
    t, c = mean(tokens), mean(chars)
    return F.struct(t.alias("avg_nll_token"), c.alias("avg_nll_char"), safe_exp(t).alias("ppl_token"), safe_exp(c).alias("ppl_char"), safe_exp(c if mode == "char" else t).alias("ppl"))

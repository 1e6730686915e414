"""k-mer spectra of texts and their distances, inside the row: nothing is exploded or shuffled."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstrand.functions.sequence import K_THRESHOLDS

#: Two bits for A, C, G, T; other bytes break a k-mer.
BROKEN = 4
CODES = np.full(256, BROKEN, np.uint8)
CODES[list(b"ACGT")] = range(4)
#: k-mers are counted in an array of all types up to so many types a letter; beyond that they are sorted.
TYPES_BY_LETTERS = 4


def spectrum(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(times, share): how large a share of the 4 ** k k-mer types is seen so often, in ascending order of times, 0 first."""
    codes = CODES[np.frombuffer(text.encode(), np.uint8)]
    n = len(codes) - k + 1
    if n < 1 or k < 1:
        return np.zeros(1), np.ones(1)
    bad = np.concatenate([[0], np.cumsum(codes == BROKEN)])
    words = np.zeros(n, np.int32 if k < 16 else np.int64)
    for j in range(k):
        words *= 4
        words += codes[j : j + n] & 3
    words = words[bad[k:] == bad[:-k]]
    if 4**k <= TYPES_BY_LETTERS * n:
        seen = np.bincount(words, minlength=1)
        seen = seen[seen > 0]
    else:
        words = np.sort(words)
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])[: len(words)])
        seen = np.diff(np.append(starts, len(words)))
    types = np.bincount(seen, minlength=1)
    times = np.flatnonzero(types)
    total = 4.0**k
    return np.concatenate([[0.0], times]), np.concatenate([[1 - len(seen) / total], types[times] / total])


def distances(a: str, b: str, k: int) -> tuple[float, float, float]:
    """Kolmogorov-Smirnov, Jensen-Shannon and earth mover's distance of two texts' spectra."""
    (times_a, share_a), (times_b, share_b) = spectrum(a, k), spectrum(b, k)
    times = np.union1d(times_a, times_b)
    p, q = np.zeros(len(times)), np.zeros(len(times))
    p[np.searchsorted(times, times_a)], q[np.searchsorted(times, times_b)] = share_a, share_b
    gap = np.abs(np.cumsum(p) - np.cumsum(q))
    width = np.append(np.diff(times), 1)
    x, y, m = (np.clip(v, 1e-12, 1) for v in (p, q, (p + q) / 2))
    return float(gap.max()), float(0.5 * np.sum(x * np.log2(x / m) + y * np.log2(y / m))), float(np.sum(gap * width))


def pair_k(a: str, b: str) -> int:
    """The k that suits the shorter text, as metrics.pair_k."""
    bases = min(int(np.count_nonzero(CODES[np.frombuffer(t.encode(), np.uint8)] != BROKEN)) for t in (a, b))
    return 1 + bisect_right(K_THRESHOLDS, bases)


def _distances(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b, k in columns:
        rows = [(None,) * 3 if x is None or y is None or n != n else distances(x, y, int(n)) for x, y, n in zip(a, b, k)]
        yield pd.DataFrame(rows, columns=["kmer_ks", "kmer_jsd", "kmer_emd"], dtype="float64")


def spectrum_distances(a: Column, b: Column, k: Column) -> Column:
    """struct(kmer_ks, kmer_jsd, kmer_emd) of two texts; nulls where one is null or k is."""
    return F.pandas_udf(_distances, "kmer_ks double, kmer_jsd double, kmer_emd double")(a, b, k)


def _bins(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ks in columns:
        found = [(np.zeros(1), None) if k is None else spectrum(t or "", k) for t, k in zip(texts.to_pylist(), ks.to_pylist())]
        offsets = np.concatenate([[0], np.cumsum([len(times) for times, _ in found])])
        times = pa.array(np.concatenate([np.empty(0), *(t for t, _ in found)]).astype(np.int64))
        shares = pa.concat_arrays([pa.array([], pa.float64()), *(pa.nulls(1, pa.float64()) if p is None else pa.array(p) for _, p in found)])
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([times, shares], ["i", "p"]))


def spectrum_bins(text: Column, k: Column) -> Column:
    """array of struct(i, p): the bins of a text's spectrum, 0 first; a null text is an empty one."""
    return F.arrow_udf(_bins, "array<struct<i: bigint, p: double>>")(text, k)

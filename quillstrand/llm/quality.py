"""Quality classifier: naive Bayes features in a linear support vector machine.

Texts become sets of hashed n-grams (binary indicators): words, pairs of words, the shapes of words' beginnings and
ends, and how much repeats. Each indicator is scaled by its log-count ratio between the two classes (naive Bayes), and a
linear model with hinge loss is fitted to the scaled indicators by dual coordinate descent. A logistic curve
fitted to the margins of held-back labelled rows makes them probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrand.llm.hashing import SPACE, scramble, word_hashes

#: Hashed features.
BITS = 18
#: The model is fitted on at most about so many labelled rows, chosen by a hash of their id.
FIT_ROWS = 6000
#: Of those, one in so many is held back from the fit to place the probability curve.
CURVE_PART = 4
SMOOTHING, COST, EPOCHS, TOLERANCE = 1.0, 1.0, 30, 1e-3


def features(text: str | None) -> np.ndarray:
    """Sorted different feature numbers of a whole text; empty for null, empty and blank texts.

    Words are runs of bytes between ASCII white space, A-Z lower-cased; the shape of a word (its bytes mapped to
    letter, capital, digit or the byte itself, the last three of them) makes features of its own, so junk marks
    at word ends and shouting are seen in any vocabulary. Further indicators tell how often words and pairs repeat.
    """
    encoded = (text or "").encode("utf-8", "replace")
    words, starts = word_hashes(encoded)
    if not len(starts):
        return np.zeros(0, np.int64)
    raw = np.frombuffer(encoded, np.uint8)
    ends = np.flatnonzero(np.diff(np.concatenate([SPACE[raw], [True]]).astype(np.int8)) > 0) + 1
    with np.errstate(over="ignore"):
        shape = _SHAPE[raw].astype(np.uint64)
        tail = shape[ends - 1] | shape[np.maximum(ends - 2, starts)] << np.uint64(8) | shape[np.maximum(ends - 3, starts)] << np.uint64(16)
        head = shape[starts] | shape[np.minimum(starts + 1, ends - 1)] << np.uint64(8)
        parts = [words, scramble(tail + np.uint64(1 << 40)), scramble(head + np.uint64(1 << 41)), scramble((tail << np.uint64(20)) + head + np.uint64(1 << 42))]
        pairs = scramble(words[:-1] * np.uint64(3) + words[1:])
        parts.append(pairs)
        # How often words and pairs come back, in tenths, together with the length by powers of two.
        n = len(words)
        tenths = [10 * len(np.unique(x)) // max(len(x), 1) for x in (words, pairs)] + [10 * int((words[1:] == words[:-1]).sum()) // n]
        parts.append(scramble(np.array([k << 32 | t << 8 | n.bit_length() for k, t in enumerate(tenths)] + [k << 36 | t for k, t in enumerate(tenths, 1)], np.uint64)))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64))


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of the hinge-loss machine over indicators scaled by scale, each row scaled to length 1.

    Dual coordinate descent: per row one variable in [0, COST], moved to its best value while the others rest.
    Positive and negative classes share COST by their frequency, so the rarer class isn't given up.
    """
    w, a = np.zeros(len(scale) + 1), np.zeros(len(rows))  # the last weight is the bias
    # Views of one array, which is given back as a whole.
    values = np.split(scale[np.concatenate([np.zeros(0, np.int64), *rows])], np.cumsum([len(r) for r in rows])[:-1])
    for v in values:
        v /= max(np.sqrt((v**2).sum()), 1e-12)
    norm = np.array([(v**2).sum() + 1.0 for v in values])
    bound = np.where(y > 0, COST * len(y) / max(2 * (y > 0).sum(), 1), COST * len(y) / max(2 * (y < 0).sum(), 1))
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(EPOCHS):
        moved = 0.0
        for k in order.permutation(len(rows)):
            r, v = rows[k], values[k]
            gradient = y[k] * (w[r] @ v + w[-1]) - 1
            new = min(max(a[k] - gradient / norm[k], 0.0), bound[k])
            if (step := new - a[k]) != 0:
                a[k] = new
                w[r] += step * y[k] * v
                w[-1] += step * y[k]
                moved = max(moved, abs(step))
        if moved < TOLERANCE:
            break
    return w


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    positive, negative = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        g = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        m = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> dict:
    """examples: id, text, label (1, 0; other labels are left out). At most about FIT_ROWS rows, those with the
    smallest hashes of their ids, are turned into features on the executors and gathered for the fit.

    With one class only, or no rows, the model gives that class's share (or 0.5) to every text. Null ids count as one
    id, so all or none of their rows are taken; rows that are repeated are fitted as often as they come.
    """
    rows = examples.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"))
    total = rows.count()
    share = min(1.0, FIT_ROWS / max(total, 1))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit(2024)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "name": b["name"], "label": b["label"], "f": [features(t).astype(np.int32) for t in b["text"]]})

    got = chosen.mapInPandas(turn, "id long, name string, label int, f array<int>").toArrow()
    ids = got["id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    labels = got["label"].to_numpy()[order]
    if len(set(labels.tolist())) < 2:
        return {"share": float(labels.mean()) if len(labels) else 0.5}
    # Views of Arrow's buffer, in place of an array for each row.
    sets, y = [f for part in got["f"].chunks for f in np.split(part.flatten().to_numpy(), np.cumsum(part.value_lengths().to_numpy())[:-1])], np.where(labels == 1, 1.0, -1.0)
    sets, names = [sets[k] for k in order], got["name"].to_pylist()
    held = np.array([zlib.crc32(names[k].encode()) % (4 * CURVE_PART) >= 4 * (CURVE_PART - 1) for k in order])
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    n = 1 << BITS
    counts = {c: np.bincount(np.concatenate([s for s, k, h in zip(sets, y, held) if k == c and not h] or [np.zeros(0, np.int64)]), minlength=n) + SMOOTHING for c in (1.0, -1.0)}
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    w = dual_descent([s for s, h in zip(sets, held) if not h], y[~held], ratio)
    model = {"ratio": ratio.astype(np.float32), "weights": (w[:-1] * ratio).astype(np.float32), "bias": float(w[-1])}
    use = held if held.any() else ~held
    margins = np.array([_margin(s, model) for s, h in zip(sets, use) if h])
    model["curve"] = _curve(margins, y[use])
    return model


def _margin(found: np.ndarray, model: dict) -> float:
    length = np.sqrt((model["ratio"][found].astype(np.float64) ** 2).sum())
    return float(model["weights"][found].astype(np.float64).sum() / max(length, 1e-12) + model["bias"])


def scored(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score column, 0 to 1, higher where label 1 is likelier. Null, empty and blank texts get the
    score of a text without features. Only the text is an input. Other columns stay, but one named out is
    replaced. The model (3 MB) is broadcast. Rows are independent: equal texts, however many, have equal scores, and null
    ids change nothing; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in texts:
            if "share" in m:
                yield pd.Series(m["share"], index=batch.index, dtype="float64")
                continue
            a, b = m["curve"]
            yield pd.Series([1 / (1 + np.exp(-min(max(a * _margin(features(t), m) + b, -30.0), 30.0))) for t in batch], dtype="float64")

    return docs.withColumn(out, score(F.col(text_col)))

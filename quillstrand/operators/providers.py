"""Providers: functions by name that give each text of a table its scores, likelihoods or vectors, in batches.

A provider is set up once in each Python worker, by options that every worker gets, and then called with lists of texts. It
returns a table with the columns that it declares, a row for each text in their order. Models that need much memory
load it in setup and not for each batch.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType

from quillstrand.functions.scores import SCORED_AFTER
from quillstrand.shared import small_batches

Score = Callable[[list[str]], pd.DataFrame]
#: Letters of an error that rows keep.
ERROR_LETTERS = 200


@dataclass(frozen=True)
class Provider:
    """output: the columns as DDL; setup: options to the function that is called with texts."""

    output: str
    setup: Callable[..., Score]


PROVIDERS: dict[str, Provider] = {}
#: What this Python worker has set up so far, by name and options.
_READY: dict[tuple[str, str], Score] = {}


def provider(name: str, output: str) -> Callable[[Callable[..., Score]], Callable[..., Score]]:
    """Register the decorated setup function by name."""

    def add(setup: Callable[..., Score]) -> Callable[..., Score]:
        PROVIDERS[name] = Provider(output, setup)
        return setup

    return add


def named(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


def _arrays(frame: pd.DataFrame, fields: list[tuple[str, pa.DataType]], n: int) -> list[pa.Array]:
    """The declared columns of what a provider returned for n texts; TypeError or ValueError if it isn't that."""
    if list(frame.columns) != [f for f, _ in fields]:
        raise TypeError(f"columns {list(frame.columns)} in place of {[f for f, _ in fields]}")
    if len(frame) != n:
        raise ValueError(f"{len(frame)} rows for {n} texts")
    return [pa.array(frame[f].tolist(), kind) for f, kind in fields]


def run(df: DataFrame, name: str, text: str, batch: int = 64, options: dict[str, Any] | None = None, error: str = "error") -> DataFrame:
    """df with the columns of a provider, and error.

    A null text is given as an empty one. If the provider raises for a batch, or returns another number of rows or other
    columns, each row of that batch has error, the first ERROR_LETTERS letters of what was raised, NaN in columns of
    floating point and null in others; all other rows have a null error and are as they would be without it. What setup
    raises, and a provider that doesn't return its declared columns for no texts, fail the job before the first row.
    ValueError if a column is there already. No shuffle; a task holds one Arrow batch, of 8 MB (see small_batches), and
    the strings of batch of its rows.
    """
    small_batches(df.sparkSession)
    own = StructType.fromDDL(named(name).output)
    if taken := {c.lower() for c in df.columns} & {c.lower() for c in [*own.names, error]}:
        raise ValueError(f"columns are there already: {sorted(taken)}")
    fields = [(f.name, to_arrow_type(f.dataType)) for f in own]
    said = json.dumps(options or {}, sort_keys=True)
    place, setup, names = df.columns.index(text), PROVIDERS[name].setup, [*df.columns, *own.names, error]

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillstrand.operators.providers import _READY  # the worker's own, not a copy that came with this function

        score = _READY.get((name, said))
        if score is None:
            score = setup(**json.loads(said))
            _arrays(score([]), fields, 0)
            _READY[name, said] = score
        for rows in batches:
            made: list[list[pa.Array]] = [[] for _ in fields]
            errors: list[str | None] = []
            for k in range(0, rows.num_rows, batch):
                part = [t or "" for t in rows.column(place).slice(k, batch).to_pylist()]
                try:
                    columns, failed = _arrays(score(part), fields, len(part)), None
                except Exception as e:  # whatever a provider raises is told in its rows
                    failed = (str(e) or type(e).__name__)[:ERROR_LETTERS]
                    columns = [pa.array([math.nan if pa.types.is_floating(kind) else None] * len(part), kind) for _, kind in fields]
                for into, column in zip(made, columns):
                    into.append(column)
                errors += [failed] * len(part)
            whole = [pa.concat_arrays(m) if m else pa.array([], kind) for m, (_, kind) in zip(made, fields)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *whole, pa.array(errors, pa.string())], names)

    schema = StructType([*df.schema.fields, *own.fields]).add(error, StringType())
    return df.mapInArrow(score_batches, schema)


@provider("markov", "avg_nll_token double, token_count long")
def markov(counts: list, order: int = 0, after: int = SCORED_AFTER, letters: int = 256) -> Score:
    """Mean of -ln p of the letters past after, one added to each count; NaN and 0 tokens for texts that end before. counts:
    [context, letter, count] of a Markov model of that order, as likelihood.markov_counts finds them."""
    totals: Counter[str] = Counter()
    seen: Counter[str] = Counter()
    for context, letter, n in counts:
        totals[context] += n
        seen[context + letter] += n
    first = max(after, order)

    def score(texts: list[str]) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t[first - order :] if len(t) > first else ""
            grams = Counter(map("".join, zip(*[t[k:] for k in range(order + 1)])))
            nll = sum(-c * math.log((seen[g] + 1.0) / (totals[g[:-1]] + letters)) for g, c in grams.items())
            n = grams.total()
            rows.append((nll / n if n else math.nan, n))
        return pd.DataFrame(rows, columns=["avg_nll_token", "token_count"])

    return score


@provider("gc_share", "score double")
def gc_share() -> Score:
    """Share of G and C among A, C, G, T; NaN for texts without them."""

    def score(texts: list[str]) -> pd.DataFrame:
        counts = [[t.count(c) for c in "GCAT"] for t in texts]
        return pd.DataFrame({"score": [(c[0] + c[1]) / sum(c) if sum(c) else math.nan for c in counts]})

    return score


@provider("kmer_profile", "embedding array<double>")
def kmer_profile(k: int = 2) -> Score:
    """A vector: the shares of all 4 ** k k-mers in the order of their letters; zeros for texts without any."""
    places = {"".join("ACGT"[(i >> 2 * j) & 3] for j in reversed(range(k))): i for i in range(4**k)}

    def score(texts: list[str]) -> pd.DataFrame:
        vectors = []
        for t in texts:
            own = [0.0] * 4**k
            for gram, n in Counter(map("".join, zip(*[t[j:] for j in range(k)]))).items():
                if gram in places:
                    own[places[gram]] = float(n)
            total = sum(own) or 1.0
            vectors.append([x / total for x in own])
        return pd.DataFrame({"embedding": vectors})

    return score


@provider("strict_length", "length long, share double")
def strict_length(letters: str = "ACGT") -> Score:
    """Length and the share of the first of letters; ValueError for a text with other letters."""

    def score(texts: list[str]) -> pd.DataFrame:
        for t in texts:
            if wrong := sorted(set(t) - set(letters)):
                raise ValueError(f"not in {letters}: {wrong[0]}")
        return pd.DataFrame({"length": [len(t) for t in texts], "share": [t.count(letters[0]) / len(t) if t else math.nan for t in texts]})

    return score


def fitted_markov(counts: DataFrame, order: int = 0, most: int = 100_000, **options: Any) -> dict[str, Any]:
    """Options of the provider markov from likelihood.markov_counts; ValueError for a model of over most rows, which is more
    than every worker should get. Alphabets of a few letters stay far below."""
    rows = counts.select("context", "letter", F.col("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: score by likelihood.markov_scores")
    return {"counts": [list(r) for r in rows], "order": order, **options}

"""Letter by letter encoding and decoding of whole batches of texts, with no array of letters for each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts whose bytes masked() spreads out at a time.
AT_ONCE = 256


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text begins and the last ends)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    whole = pa.concat_arrays([texts])
    _, at, data = whole.buffers()
    ends = np.frombuffer(at, np.int64, len(whole) + 1, 8 * whole.offset) if len(whole) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]) if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each text begins and the last ends)."""
    raw, ends = _raw(texts)
    if not len(raw) or raw.max() < 128:
        return raw, ends
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # bytes that begin a letter
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), begun[ends]


def _by_number(table: dict[int, int], numbers: np.ndarray, other: int) -> np.ndarray:
    """The table's values of numbers that aren't negative."""
    values = np.full(max(table, default=0) + 2, other, np.int32)
    values[list(table)] = list(table.values())
    return values[np.minimum(numbers, len(values) - 1)]


def letter_ids(texts: pa.Array, vocabulary: dict[str, int], unknown: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What encode_tokens makes of char_tokens and an end mark, for a batch: (ids of all texts, where each text's begin)."""
    letters, at = _letters(texts)
    marks = at[1:] + np.arange(len(texts))
    own = np.ones(len(letters) + len(texts), bool)
    own[marks] = False
    ids = np.full(len(own), end, np.int32)
    ids[own] = _by_number({ord(c): i for c, i in vocabulary.items()}, letters, unknown)
    return ids, np.concatenate([[0], marks + 1])


def letters_of(ids: np.ndarray, at: np.ndarray, letters: dict[int, str], special: list[int]) -> pa.Array:
    """What decode_tokens makes of a batch of ids, for ASCII letters: a text for each row."""
    made = _by_number({i: ord(c) for i, c in letters.items() if i not in special}, ids, 0).astype(np.uint8)
    kept = made > 0
    ends = np.concatenate([[0], np.cumsum(kept)])[at]
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(made[kept])]).cast(pa.string())


def recoded(text: Column | str, vocabulary: dict[str, int], unknown: int, end: int) -> Column:
    """struct(n_ids, decoded): a text in upper case encoded letter by letter with an end mark, and decoded without end and
    unknown; null for a null text. Ids are numbers from 0, letters ASCII."""

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids, at = letter_ids(texts, vocabulary, unknown, end)
            made = letters_of(ids, at, {i: c for c, i in vocabulary.items()}, [end, unknown])
            yield pa.StructArray.from_arrays([pa.array(np.diff(at), pa.int32()), made], ["n_ids", "decoded"], mask=texts.is_null())

    return F.arrow_udf(both, "n_ids int, decoded string")(F.upper(text))


def masked(text: Column | str, table: dict[str, str], other: str = "#") -> Column:
    """A text with the letters of table replaced, and each letter outside printable ASCII by other; all of them ASCII."""
    by_byte = np.zeros(256, np.uint8)
    by_byte[[*range(128), *range(0xC0, 256)]] = ord(other)  # bytes that don't begin a letter stay 0 and are left out
    by_byte[32:127] = range(32, 127)
    by_byte[[ord(c) for c in table]] = [ord(c) for c in table.values()]

    def replaced(texts: pa.Array) -> pa.Array:
        letters, at = _raw(texts)
        made = by_byte[letters]
        kept = made > 0
        if not kept.all():
            at, made = np.concatenate([[0], np.cumsum(kept)])[at], made[kept]
        valid = pa.array(texts.is_valid()).buffers()[1] if texts.null_count else None
        return pa.Array.from_buffers(pa.large_string(), len(texts), [valid, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(made)]).cast(pa.string())

    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([pa.array([], pa.string()), *(replaced(texts.slice(k, AT_ONCE)) for k in range(0, len(texts), AT_ONCE))])

    return F.arrow_udf(replace, "string")(text)

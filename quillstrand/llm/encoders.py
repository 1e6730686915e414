"""Exact encoding with a tokenizers file, a word at a time: each different word is encoded once and kept.

Both vocabularies' patterns start a new match wherever a space or newline follows a character that is neither,
where an ASCII mark follows a letter, and between one newline and a letter (no alternative reaches across such a
place, and none looks behind), so a text may be cut there and the ids of its pieces joined. Words of Latin
letters go straight to a merge routine with the file's ranks; every other piece goes through the file's whole
pipeline in the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PIECE = re.compile(rf" ?[{LETTERS}]+(?=[!-/:-@\[-`{{-~ \n]|$)|\n(?=[{LETTERS}])|[ \n]*[^ \n]+|[ \n]+")
WORD = re.compile(rf" ?[{LETTERS}]+")
#: Words kept by a worker (about 150 bytes each); all are dropped when there are more.
MOST_KEPT = 600_000
WORD_END = b"\xff"  # a byte that UTF-8 never has


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabulary files use, by their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Kept(dict):
    """Ids of words that follow a space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_KEPT:
            self.clear()
        self[word] = ids = self.encode(" " + word)
        return ids


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 16-bit arrays (ids must be below 65,536)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        model = json.loads(self.tokenizer.to_str())["model"]
        end, symbols, ranks = model.get("end_of_word_suffix") or "", _byte_symbols(), {}
        for token, rank in model["vocab"].items():
            last = bool(end) and token.endswith(end)
            body = token[: len(token) - len(end)] if last else token
            if all(c in symbols for c in body):
                ranks[bytes(symbols[c] for c in body) + WORD_END * last] = rank
        ranks.setdefault(WORD_END, 65535)
        self.merge = tiktoken.Encoding("words", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.folds = bool(end)  # this file's pipeline lower-cases and drops white space
        self.kept, self.marks = _Kept(self._pieces), {}

    def _new(self, piece: str) -> bytes:
        if WORD.fullmatch(piece):
            ids = self.merge(piece.lstrip(" ").lower().encode() + WORD_END if self.folds else piece.encode())
            return np.array(ids, dtype="<u2").tobytes()
        if (ids := self.marks.get(piece)) is None:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u2").tobytes()
            if len(self.marks) < MOST_KEPT // 8:
                self.marks[piece] = ids
        return ids

    def _pieces(self, text: str) -> bytes:
        return b"".join([self._new(p) for p in PIECE.findall(text)])

    def encode(self, text: str | None) -> bytes:
        """A single space begins a new piece wherever it stands; with runs of spaces, PIECE finds the places."""
        if not text:
            return b""
        if "  " in text:
            return self._pieces(text)
        first, *words = text.split(" ")
        return self._pieces(first) + b"".join(map(self.kept.__getitem__, words))


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One for each worker and file."""
    return PieceEncoder(path)

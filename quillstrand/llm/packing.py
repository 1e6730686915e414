"""Order-preserving packing of documents into sequences of at most 2,048 ids.

The documents' ids, one after another in the order of their ids, are a stream. A sequence is a window of it.
Windows are cut at the ends of documents or sentences; where neither comes for a long time, also inside a
sentence. Cutting a document costs a truncation penalty (more inside a sentence), and a window costs its
padding. A dynamic program over the possible cuts finds the cheapest windows: with c[j] the least cost up to
cut j at position p[j],

    c[j] = penalty[j] + min over i with p[j] - p[i] <= 2048 of  c[i] + 2048 - (p[j] - p[i])
         = penalty[j] + 2048 - p[j] + min (c[i] + p[i])

so the best i is the front of a monotone queue. A window of 256, 512 or 1,024 ids, a power of two, needs no padding;
those few predecessors are looked up by position. Shorter windows of a power of two cost as if they were padded to
2,048: the program would else cut documents into slivers that need no padding but serve no training.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrand.llm.encoders import encoder

LENGTH = 2048
SENTENCE_PENALTY, INSIDE_PENALTY = 1, 12
#: Without an end of a sentence for so many ids, a cut is allowed after each of them.
INSIDE_STEP = 32
#: A stream is one task's documents; text of about this size.
STREAM_BYTES = 16 << 20
#: The program runs over about so many ids at a time and carries the last windows over.
SEGMENT_IDS = 1 << 18
#: Windows of these lengths need no padding; shorter ones are not looked for.
POWERS = (256, 512, 1024)
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan_windows(cuts: list[int], penalties: list[int]) -> list[int]:
    """cuts: ascending positions, the first where the stream begins. Neighbours are at most LENGTH apart.

    Returns for each cut the number of its best predecessor.
    """
    n = len(cuts)
    cost, back, even = [0.0] * n, [0] * n, {}
    at = np.array(cuts)
    for size in POWERS:  # predecessors at the very distance, if there are any
        before = np.searchsorted(at, at - size)
        for j in np.flatnonzero(at[before] == at - size).tolist():
            even.setdefault(j, []).append(int(before[j]))
    queue: deque[tuple[float, int, int]] = deque()
    value = 0.0
    for j in range(1, n):
        p = cuts[j]
        value = cost[j - 1] + cuts[j - 1]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, cuts[j - 1], j - 1))
        while p - queue[0][1] > LENGTH:
            queue.popleft()
        best, _, k = queue[0]
        best += LENGTH - p
        for i in even.get(j, ()):
            if cost[i] < best:
                best, k = cost[i], i
        cost[j], back[j] = best + penalties[j] + 1e-3, k  # of equal plans, the one with fewer windows
    return back


def _inside(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts inside one document of n ids and their penalties; ends: where its sentences end."""
    stops = np.concatenate([[0], ends, [n]])
    wide = np.flatnonzero(np.diff(stops) > 2 * INSIDE_STEP)
    more = [np.arange(stops[k] + INSIDE_STEP, stops[k + 1], INSIDE_STEP) for k in wide]
    cuts = np.concatenate([ends, *more])
    penalties = np.full(len(cuts), INSIDE_PENALTY)
    penalties[: len(ends)] = SENTENCE_PENALTY
    order = np.argsort(cuts, kind="stable")
    return cuts[order], penalties[order]


def _sentence_tables(path: str, marks: str) -> tuple[np.ndarray, np.ndarray]:
    """For each id of a byte-level vocabulary: does it end with one of marks; does it begin with white space."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab()
    closes, opens = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for token, k in vocab.items():
        token = token.replace("Ġ", " ").replace("Ċ", "\n")
        closes[k], opens[k] = token.endswith(tuple(marks)), token[0] in " \n"
    return closes, opens


def _packer(path: str, end_id: int, sentence_ends: str):
    def emit(segment: list, windows: list[tuple[int, int]], first_sequence: int) -> list[tuple]:
        """Pieces of documents in windows. segment: (id, missing, ids, place of the first id in its document, whole length)."""
        rows, d, at = [], 0, 0  # at: stream position where document d begins
        for s, (a, b) in enumerate(windows):
            while a < b:
                doc_id, missing, ids, before, whole = segment[d]
                stop = min(b, at + len(ids))
                part = ids[a - at : stop - at]
                rows.append((doc_id, missing, before + a - at, len(part), zlib.crc32(part.astype("<u4")), whole, first_sequence + s, a - windows[s][0]))
                a = stop
                if stop == at + len(ids):
                    d, at = d + 1, stop
        return rows

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, end = encoder(path), np.array([end_id], "<u2").tobytes()
        closes, opens = _sentence_tables(path, sentence_ends)
        sequence = TaskContext.get().partitionId() << 36
        segment, cuts, penalties, held = [], [0], [0], 0

        def flush(last: bool) -> list[tuple]:
            nonlocal segment, cuts, penalties, held, sequence
            back = plan_windows(cuts, penalties)
            j = len(cuts) - 1
            path_back = [j]
            while j:
                j = back[j]
                path_back.append(j)
            chosen = [cuts[k] for k in reversed(path_back)]
            if not last:  # the last windows are planned again with what follows
                keep_from = max([c for c in chosen if held - c >= 4 * LENGTH], default=0)
                chosen = [c for c in chosen if c <= keep_from]
            windows = list(zip(chosen, chosen[1:]))
            rows = emit(segment, windows, sequence)
            sequence += len(windows)
            done, rest, at = chosen[-1], [], 0
            for doc_id, missing, ids, before, whole in segment:
                if at + len(ids) > done:
                    skip = max(0, done - at)
                    rest.append((doc_id, missing, ids[skip:], before + skip, whole))
                at += len(ids)
            later = [(c - done, p) for c, p in zip(cuts, penalties) if c >= done]
            segment, cuts, penalties, held = rest, [c for c, _ in later], [0, *[p for _, p in later[1:]]], held - done
            return rows

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["id", "missing", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, missing, text in zip(batch["id"], batch["missing"], batch["text"]):
                ids = np.frombuffer(enc.encode(text) + end, "<u2")
                ends = np.flatnonzero(closes[ids[:-2]] & opens[ids[1:-1]]) + 1
                inside, prices = _inside(ends, len(ids))
                cuts += (inside + held).tolist()
                penalties += prices.tolist()
                held += len(ids)
                cuts.append(held)
                penalties.append(0)
                segment.append((doc_id, missing, ids, 0, len(ids)))
                if held >= SEGMENT_IDS:
                    yield frame(flush(False))
        if held:
            yield frame(flush(True))

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", sentence_ends: str = ".!?\n") -> DataFrame:
    """A row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id lies in exactly one piece, pieces of a sequence follow each other from offset 0 without a gap, and
    sequences hold documents in ascending order of id (null ids first; equal ids by hash of text, so that one id
    with very many rows is spread over streams). Null text counts as empty: the end id alone. Repeated rows are
    packed each on its own. Empty tables give no rows. The task number is the upper part of sequence_id. Memory
    is bounded by SEGMENT_IDS plus the longest document.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("missing"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = [F.col("missing").desc(), F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(1, -(-text_bytes // STREAM_BYTES)), *keys).sortWithinPartitions(*keys)
    packed = dealt.mapInPandas(_packer(tokenizer, end_id, sentence_ends), "id long, missing boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.select(F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

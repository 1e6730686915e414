"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns give the base spans, which always stay. The field labels a document's tokens O, email, ip, card or
phone. Its nodes are the tokens that carry a digit or an at sign; neighbours in the text share a chain potential,
and tokens that repeat, or are alike once punctuation and case are taken off, share a skip potential however far
apart they stand, and so do, by a weaker one, numbers that end in the same TAIL digits. Loopy belief propagation makes
such tokens agree, so a number that one place shows to be a phone number ("+49 170 ...") is found again where it stands
without its plus sign, or as "0170 ...". Tokens under a base span are observed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches: where the first digit of a run begins none, its other digits don't either.
IP_FAST = re.compile(r"(?<![0-9])" + IP.pattern)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A run that could be a node: characters that numbers and addresses are made of, with a digit or at sign inside.
NODE = re.compile(r"[A-Za-z0-9._%+@()-]+")
MARKED = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[0-9]+")
#: Log potentials. An unobserved node leans to O by BIAS; neighbours of one kind gain CHAIN; tokens that are
#: alike gain SKIP, similar ones NEAR; a shape that the kind can't have costs SHAPE. One observed mate is enough, a
#: neighbour isn't. What is observed is SURE, however many copies are not.
BIAS, CHAIN, SKIP, NEAR, SHAPE, SURE = 2.0, 0.3, 4.0, 3.0, 12.0, 1000.0
#: Numbers are similar when so many last digits are equal: a subscriber's number without its country's and area's.
TAIL = 8
ROUNDS, DAMPING = 12, 0.3


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; per kind leftmost matches that don't overlap, failing ones dropped."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = "".join(DIGITS.findall(m[0]))
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP_FAST.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len("".join(DIGITS.findall(m[0]))) <= 15]
    out.sort()
    return out


LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[re.Match]:
    """EMAIL.finditer, started near each at sign instead of at every word: a match holds exactly one at sign,
    and begins at the first character of the run before it, or where the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _key(token: str) -> tuple[str, str]:
    """What tokens that are alike have in common."""
    digits = "".join(DIGITS.findall(token))
    if "@" in token:
        return "address", token.strip("._%+-()").lower()
    return "number", digits


def _nodes(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, observed kind or -1): one node per base span, and the runs outside of them. A run of number
    tokens one space or hyphen apart is one node, as numbers are often written in groups."""
    nodes = [(s, e, k) for s, k, e in spans]
    loose: list[list[int]] = []
    k, ordered = 0, sorted((s, e) for s, _, e in spans)
    for m in NODE.finditer(text):
        if not MARKED.search(m[0]):
            continue
        s, e = m.span()
        while k < len(ordered) and ordered[k][1] <= s:
            k += 1
        if k < len(ordered) and ordered[k][0] < e:
            continue
        number = not re.search(r"[A-Za-z@%_]", m[0])
        if loose and number and loose[-1][2] and s - loose[-1][1] == 1 and text[s - 1] == " ":
            loose[-1][1] = e
        else:
            loose.append([s, e, number])
    for s, e, _ in loose:
        body = text[s:e]
        left = len(body) - len(body.lstrip(".,%_-)"))
        right = len(body.rstrip(".,%_-("))
        if right > left:
            nodes.append((s + left, s + right, -1))
    nodes.sort()
    return nodes


def _shapes(token: str, key: tuple[str, str]) -> np.ndarray:
    """Per label (O, then KINDS) the log potential of a token's shape."""
    digits = len(key[1]) if key[0] == "number" else 0
    out = np.full(5, -SHAPE)
    out[0] = BIAS
    if key[0] == "address" and 0 < token.find("@") < len(token) - 1:
        out[1] = 0
    if key[0] == "number" and not re.search(r"[A-Za-z_%@]", token):
        if token.count(".") == 3 and 4 <= digits <= 12:
            out[2] = 0
        if 14 <= digits <= 19:
            out[3] = 0
        if 10 <= digits <= 15:
            out[4] = 0
    return out


def field_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that the field adds to the base spans of a text."""
    if not spans:
        return []  # nothing is observed, and every free node leans to O
    nodes = _nodes(text, spans)
    if len(nodes) == len(spans):
        return []
    keys = [_key(text[s:e]) for s, e, _ in nodes]
    mates, similar = defaultdict(list), defaultdict(list)
    for n, key in enumerate(keys):
        if len(key[1]) > 3:
            mates[key].append(n)
            if key[0] == "number" and len(key[1]) > TAIL and len(mates[key]) == 1:
                similar[key[1][-TAIL:]].append(key)
    local = np.array([[-SURE if label != kind + 1 else 0.0 for label in range(5)] if kind >= 0 else _shapes(text[s:e], key) for (s, e, kind), key in zip(nodes, keys)])
    edges, gains = [], []
    for n in range(len(nodes) - 1):
        edges.append((n, n + 1))
        gains.append(CHAIN if nodes[n + 1][0] - nodes[n][1] <= 3 else 0.0)
    # A group's mates share edges with one of them, an observed one if there is one: each hears of all others in two rounds,
    # with edges in proportion to the tokens. Tokens that are similar to an observed one share an edge with it.
    hub = {key: next((n for n in group if nodes[n][2] >= 0), group[0]) for key, group in mates.items()}
    told = set()
    for group in similar.values():
        seen = next((hub[key] for key in group if nodes[hub[key]][2] >= 0), None)
        if seen is not None:  # each token by itself, so that copies that aren't observed don't outvote the one that is
            near = [key for key in group if nodes[hub[key]][2] < 0]
            edges += [(seen, n) for key in near for n in mates[key]]
            gains += [NEAR] * sum(len(mates[key]) for key in near)
            told.update(near)
    for key, group in mates.items():
        if key not in told:
            edges += [(hub[key], n) for n in group if n != hub[key]]
            gains += [SKIP] * (len(group) - 1)
    label = _propagate(local, np.array(edges).reshape(-1, 2), np.array(gains))
    taken = {(s, k) for s, k, _ in spans}
    return [(s, int(label[n]) - 1, e) for n, (s, e, kind) in enumerate(nodes) if kind < 0 and label[n] and (s, int(label[n]) - 1) not in taken]


def _propagate(local: np.ndarray, edges: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sum-product messages over all edges at once, damped; the likeliest label of each node."""
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    gain = np.exp(np.concatenate([gains, gains]))[:, None]
    turn, half = np.zeros((len(a), 5)), len(edges)
    back = np.concatenate([np.arange(half) + half, np.arange(half)])
    for _ in range(ROUNDS):
        belief = local.copy()
        np.add.at(belief, b, turn)
        out = belief[a] - turn[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(out.sum(1, keepdims=True) + (gain - 1) * out)
        new -= new.max(1, keepdims=True)
        new = DAMPING * turn + (1 - DAMPING) * new
        if np.abs(new - turn).max(initial=0.0) < 1e-4:
            break
        turn = new
    belief = local.copy()
    np.add.at(belief, b, turn)
    return belief.argmax(1)


def all_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and added spans together, of a whole text; (start, kind, end), sorted."""
    base = base_spans(text) if text else []
    return base, sorted(base + field_spans(text, base)) if base else []


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans as kind:start:end lists.

    Offsets are code points, end exclusive. Null and empty texts have none. Rows are independent, so repeated
    rows, null ids and extra columns change nothing; empty tables give no rows.
    """

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [all_spans(t) for t in batch["text"]]
            counts = [[sum(k == kind for _, k, _ in base) for kind in range(4)] for base, _ in rows]
            out = pd.DataFrame(counts, columns=[f"n_{k}" for k in KINDS], dtype="int64")
            out["id"], out["missing"] = batch["id"].to_numpy(), batch["missing"].to_numpy()
            out["base"], out["spans"] = [_written(b) for b, _ in rows], [_written(s) for _, s in rows]
            yield out

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("missing"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInPandas(seek, "id long, missing boolean, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    return found.select(F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base", "spans")


def redact(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by <kind> of the first."""
    if not text:
        return text
    spans = all_spans(text)[1]
    if not spans:
        return text
    parts, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = end
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced; null stays null, other columns stay as they are."""

    @F.pandas_udf("string")
    def change(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) for t in texts], index=texts.index, dtype=object)

    return docs.withColumn(text_col, change(F.col(text_col)))

"""Personal data in whole texts: patterns, and a skip-chain model over their repeats.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers (the base
spans). A conditional random field then labels the other tokens of a document that hold
a digit or an @: each has weights for its shape, neighbours in the text share a chain
potential, and distant tokens that repeat or resemble each other (the same digits, the
same letters and digits, or digits that end alike) share a skip potential, so that a
number written again in another form takes the label of the one that the pattern found.
Base spans are nodes whose label is given. Labels come from loopy message passing over
the document's graph; base spans always stay.

Each token is linked to the one before it and, by each of its keys, to the last token of
that key and to a base span of each kind that has it, so that the evidence doesn't fade
with the number of repeats, and the graph grows with the text and not with the square of
the repeats. Digits written with blanks are one token where they are the end of a base
span's digits. Messages are passed until they settle. The weights are set by hand below:
no labelled spans exist to learn them from.

Defined results: a null text is empty; texts without a digit or an @ have no spans;
places are code points; equal texts get equal spans; any length of text is read whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]

# The patterns of the base spans. Digits before which digits stand are
# skipped where a match from the first of them would have been found before.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^\s,;|<>\"']+")
_NUMBER = re.compile(r"[0-9().+/-]+")
_BLANKS = re.compile(r"\)?[ \t\xa0]+([-./][ \t\xa0]+)?")
_NOT_DIGIT = re.compile("[^0-9]")
_NOT_ALNUM = re.compile("[^a-z0-9]")

# Weights of the model, as logarithms. A lone token is none of the kinds; one that
# repeats a known span is of its kind.
LONE = 2.0  # for "none"
SHAPE = 1.0  # for a kind whose shape the token has
MISFIT = -4.0  # for a kind whose shape it can't have
SKIP = 2.5  # for equal labels of repeated or similar tokens
CHAIN = 0.3  # for equal labels of neighbours
DAMPING, SURE = 0.3, 0.5
SETTLED = 1e-6  # the greatest change of a message in the last round
PATIENCE = 200  # rounds after which steps shrink, so that messages that swing settle too
TAIL = 7  # digits at the end by which numbers resemble each other
LONGEST = 19  # digits of the longest base span


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        x = int(digit) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @, so that long runs are read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of what the patterns find, in order."""
    if not text or not _MAYBE.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _shape(token: str) -> list[float]:
    """A weight for each label, from the token's form."""
    digits = sum(c.isdigit() for c in token)
    letters = any(c.isalpha() for c in token)
    fits = [
        "@" in token or (letters and "." in token),
        token.count(".") == 3 and 4 <= digits <= 12 and not letters,
        12 <= digits <= 19 and not letters,
        7 <= digits <= 15 and not letters,
    ]
    return [LONE, *(SHAPE if fit else MISFIT for fit in fits)]


def _keys(token: str) -> Iterator[str]:
    """Tokens that share one of these repeat or resemble each other."""
    low = token.lower()
    digits = _NOT_DIGIT.sub("", low)
    if len(digits) >= TAIL:
        yield "digits " + digits
        yield "tail " + digits[-TAIL:]
    plain = _NOT_ALNUM.sub("", low)
    if len(plain) >= 6 and "@" in low:
        yield "plain " + plain


def beliefs(unary: np.ndarray, edges: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Label probabilities of each node, by loopy sum-product message passing till it settles.

    An edge gives exp(weight) where its ends agree, and 1 elsewhere.
    """
    count, kinds = unary.shape
    ends = np.concatenate([edges, edges[:, ::-1]])  # messages run both ways
    both = np.concatenate([weights, weights])
    back = np.roll(np.arange(len(ends)), len(edges))
    node = np.exp(unary - unary.max(axis=1, keepdims=True))
    message = np.full((len(ends), kinds), 1 / kinds)
    agree = np.expm1(both)[:, None]
    step, change = 1 - DAMPING, np.inf
    for done in itertools.count():
        if not len(ends) or change <= SETTLED:
            break
        logs = np.log(message)
        total = np.log(node)
        np.add.at(total, ends[:, 1], logs)
        out = np.exp(_levelled(total[ends[:, 0]] - logs[back]))
        fresh = out.sum(axis=1, keepdims=True) + agree * out
        fresh /= fresh.sum(axis=1, keepdims=True)
        if done >= PATIENCE:
            step *= 0.98
        moved = step * (fresh - message)
        change = np.abs(moved).max()
        message += moved
    total = np.log(node)
    np.add.at(total, ends[:, 1], np.log(message))
    out = np.exp(_levelled(total))
    return out / out.sum(axis=1, keepdims=True)


def _levelled(logs: np.ndarray) -> np.ndarray:
    return logs - logs.max(axis=1, keepdims=True)


def _joined(
    text: str, tokens: list[tuple[int, int]], base: list[tuple[int, int, int]]
) -> list[tuple[int, int]]:
    """Tokens, numbers in a row joined where together they end a base span's digits."""
    ends = set()
    for a, kind, b in base:
        if KINDS[kind] in ("card", "phone"):
            digits = _NOT_DIGIT.sub("", text[a:b])
            ends.update(digits[i:] for i in range(len(digits) - TAIL + 1))
    if not ends:
        return tokens
    out = []  # (start, end, digits, whether it may follow the one before over blanks)
    for a, b in tokens:
        number = bool(_NUMBER.fullmatch(text, a, b))
        digits = _NOT_DIGIT.sub("", text[a:b]) if number else ""
        follows = bool(
            number and out and out[-1][2] and _BLANKS.fullmatch(text, out[-1][1], a)
        )
        out.append((a, b, digits, follows))
        first, whole, best = len(out) - 1, digits, None
        while out[first][3] and len(whole) < LONGEST:
            first -= 1
            whole = out[first][2] + whole
            if whole in ends:
                best = first
        if best is not None:
            # Nothing is joined to it on its left any more; it ends the row.
            start = out[best][0]
            del out[best:]
            out.append((start, b, "", False))
    return [(a, b) for a, b, _, _ in out]


def added_spans(
    text: str, base: list[tuple[int, int, int]]
) -> list[tuple[int, int, int]]:
    """Spans that the model adds to the base spans of a text."""
    if not base:
        return []  # no label is given, so nothing could be repeated
    nodes = [(a, b, kind) for a, kind, b in base]
    covered = np.zeros(len(text) + 1, np.int8)
    for a, b, _ in nodes:
        covered[a:b] = 1
    tokens = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".:!?)":
            b -= 1
        if _MAYBE.search(text, a, b) and not covered[a:b].any():
            tokens.append((a, b))
    nodes += [(a, b, None) for a, b in _joined(text, tokens, base)]
    nodes.sort(key=lambda n: (n[0], n[1], n[2] is None, n[2] or 0))
    given: dict[str, dict[int, int]] = {}  # key: kind: its first base span
    for i, (a, b, kind) in enumerate(nodes):
        if kind is not None:
            for key in _keys(text[a:b]):
                given.setdefault(key, {}).setdefault(kind, i)
    unary, edges, weights, last = [], [], [], {}
    for i, (a, b, kind) in enumerate(nodes):
        weight = _shape(text[a:b])
        if kind is not None:
            weight = [0.0] * len(LABELS)
        unary.append(weight)
        if i:
            edges.append((i - 1, i))
            weights.append(CHAIN)
        for key in _keys(text[a:b]):
            linked = set(given.get(key, {}).values()) if kind is None else set()
            if key in last:
                linked.add(last[key])
            for other in sorted(linked):
                edges.append((other, i))
                weights.append(SKIP)
            last[key] = i
    if len(nodes) == len(base):
        return []
    # What a base span tells a neighbour is known, and nothing moves its own label.
    free = []
    for (x, y), weight in zip(edges, weights):
        if nodes[x][2] is None and nodes[y][2] is None:
            free.append((x, y, weight))
        elif nodes[x][2] is None:
            unary[x][nodes[y][2] + 1] += weight
        elif nodes[y][2] is None:
            unary[y][nodes[x][2] + 1] += weight
    chances = beliefs(
        np.array(unary),
        np.array([(x, y) for x, y, _ in free], np.int64).reshape(-1, 2),
        np.array([weight for _, _, weight in free]),
    )
    found = []
    for (a, b, kind), chance in zip(nodes, chances):
        best = int(chance.argmax())
        if kind is None and best and chance[best] > SURE:
            found.append((a, best - 1, b))
    return found


SPANS = "array<struct<kind: string, begin: int, end: int, base: boolean>>"
_ARROW = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]
        + [("base", pa.bool_())]
    )
)


def _find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for value in batch:
            text = value.as_py() or ""
            base = base_spans(text)
            every = [(*s, True) for s in base]
            every += [(*s, False) for s in added_spans(text, base)]
            rows.append(
                [
                    {"kind": KINDS[kind], "begin": a, "end": b, "base": given}
                    for a, kind, b, given in sorted(every)
                ]
            )
        yield pa.array(rows, _ARROW)


_find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def with_personal_data(
    docs: DataFrame, text_col: str = "text", into: str = "personal"
) -> DataFrame:
    """``docs`` with a column ``into`` of ``SPANS``, by start; one of that name goes."""
    return docs.withColumn(into, F.arrow_udf(_find, returnType=SPANS)(docs[text_col]))

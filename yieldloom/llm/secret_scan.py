"""Secrets: assignments, access keys and hex strings by pattern, random strings by tokens.

A vocabulary built on ordinary text needs many tokens for a random string. Runs of
key characters with few characters per token are reported, unless they are digests of
a known length, identifiers or numbers. Where a run as a whole is ordinary, the stretches
of its parts that are not are tested, so a key is found behind a path or a name too.
"""

from __future__ import annotations

import base64
import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.packing import SPLIT
from yieldloom.llm.spans import SPANS_TYPE, Span, Taken

KINDS = ("assign", "access", "hex", "random")
#: Characters per token; ordinary words have more, random letters and digits fewer.
MAX_RATIO = 2.0
MIN_RUN = 20

# Fixed patterns of the scan.
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGESTS = (32, 40, 48, 56, 64, 96, 128)
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words, in one or several parts, with at most a short number behind each.
IDENTIFIER = re.compile(
    r"(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4}(?:[+/_=-](?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4})*"
)
CAMEL = re.compile(r"([A-Z]?[a-z]{2,}|[A-Z]{2,})([A-Z][a-z]{2,})*[0-9]{0,4}")
NUMBER = re.compile(r"[0-9+/_=-]+")
PART = re.compile(r"[A-Za-z0-9]+")


@functools.lru_cache(maxsize=2)
def vocabulary(ranks: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})


def known(run: str) -> bool:
    """Digests, identifiers and numbers: long and odd, but no secrets."""
    if HEX_ONLY.fullmatch(run) and len(run) in DIGESTS:
        return True
    return any(p.fullmatch(run) for p in (UUID, NUMBER, CAMEL, IDENTIFIER))


def ratio(run: str, ranks: str) -> float:
    return len(run) / len(vocabulary(ranks).encode_ordinary(run))


def stretches(run: str, ranks: str, max_ratio: float) -> list[tuple[int, int]]:
    """Disjoint stretches of the parts of a run, the odd ones together (Ruzzo and Tompa).

    A part weighs what its tokens are more than its characters allow; a stretch has
    the greatest sum that its ends can give it. Linear in the number of parts.
    """
    total, found = 0.0, []
    for m in PART.finditer(run):
        weight = max_ratio * len(vocabulary(ranks).encode_ordinary(m[0])) - len(m[0])
        before, total = total, total + weight
        if weight <= 0:
            continue
        start, left, right = m.start(), before, total
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= left:
                at = found[at][4]
            if at < 0 or found[at][3] >= right:
                found.append((start, m.end(), left, right, at))
                break
            start, left = found[at][0], found[at][2]
            del found[at:]
    return [(a, b) for a, b, *_ in found]


def odd_parts(run: str, ranks: str, max_ratio: float) -> list[tuple[int, int, float]]:
    """(start, end, ratio) of what is random in a run: all of it, or stretches, or parts."""

    def tested(start: int, end: int) -> list[tuple[int, int, float]]:
        piece = run[start:end]
        if len(piece) < MIN_RUN or known(piece):
            return []
        found = ratio(piece, ranks)
        return [(start, end, found)] if found <= max_ratio else []

    if len(run) < MIN_RUN or known(run):
        return []
    found = tested(0, len(run))
    if not found:
        for a, b in stretches(run, ranks, max_ratio):
            found += tested(a, b) or [
                x for m in PART.finditer(run, a, b) for x in tested(m.start(), m.end())
            ]
    return found


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: leftmost matches of each kind that don't overlap, and pass its test."""
    spans = []
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    if any(word in low for word in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append(Span("assign", m.start(), m.end(), 1.0, True))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 20:
                spans.append(Span("access", m.start(), m.end(), 1.0, True))
    spans += [Span("hex", m.start(), m.end(), 1.0, True) for m in HEX.finditer(text)]
    return spans


def secrets(text: str | None, ranks: str, max_ratio: float = MAX_RATIO) -> list[Span]:
    """All spans of a text, by start and then kind; null counts as empty."""
    text = text or ""
    spans = base_spans(text)
    taken = Taken(spans)
    for m in RUN.finditer(text):
        for start, end in taken.gaps(m.start(), m.end()):
            for a, b, found in odd_parts(text[start:end], ranks, max_ratio):
                score = round(min(1.0, 1 - found / (2 * max_ratio)), 6)
                spans.append(Span("random", start + a, start + b, score, False))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find_secrets(text: Column, ranks: str, max_ratio: float = MAX_RATIO) -> Column:
    """Spans of each whole text: kind, start, end, score, base.

    Null and empty texts have none. Rows are scanned one by one, so repeated rows have
    equal spans. The vocabulary is loaded once per worker from the path ``ranks``.
    """

    @F.pandas_udf(SPANS_TYPE)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[s._asdict() for s in secrets(t, ranks, max_ratio)] for t in texts])

    return scan(text)


def scan_secrets(
    docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, spans) of every document; other columns are not read."""
    return docs.select(F.col(id_col), find_secrets(F.col(text_col), ranks).alias("spans"))

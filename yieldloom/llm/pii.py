"""Personal data: patterns propose, checksums confirm, words nearby decide.

The base kinds (email, ip, card, phone) are reported as their patterns and tests say.
Further candidates start from a score of their own, gain from a passed checksum and
from words nearby that name the kind, lose from words that name something else, and
are reported from ``THRESHOLD`` on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.spans import SPANS_TYPE, Span, Taken

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "card_short", "phone_local", "ssn")
THRESHOLD = 0.7
NEAR = 48
UNLIKELY = re.compile(r"(?i)\b(?:order|invoice|version|isbn|serial|build|part|item|page)\b")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Checksum of card numbers: doubled every second digit from the right."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Checksum of account numbers (ISO 7064): letters as 10 to 35, remainder 1."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, from each ``@`` outwards: linear also in runs without an ``@``."""
    free_from, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free_from and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free_from = domain.end()
            at = text.find("@", free_from)
        else:
            free_from = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The fixed kinds: leftmost matches that don't overlap; those failing their test are dropped."""
    spans = [Span("email", a, b, 1.0, True) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(_byte(part) for part in m[0].split(".")):
            spans.append(Span("ip", m.start(), m.end(), 0.9, True))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(Span("card", m.start(), m.end(), 0.95, True))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append(Span("phone", m.start(), m.end(), 0.9, True))
    return spans


#: Characters of an account number by country (ISO 13616).
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        part.split(":")
        for part in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
            "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
            "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV "
            "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in countries.split(",")
}


def whole_match(m: re.Match) -> list[int]:
    return [m.end()]


def iban_ends(m: re.Match) -> list[int]:
    """Where the code may end: its country's length first, then the whole match.

    The pattern also takes upper-case words and numbers behind the code. Other shorter ends
    count only for countries whose length is not known.
    """
    ends = [m.end(), *(m.end() - len(m[0]) + x.start() for x in reversed([*re.finditer(" ", m[0])]))]
    size = IBAN_LENGTHS.get(m[0][:2])
    right = [e for e in ends if e - m.start() - m.string.count(" ", m.start(), e) == size]
    return [*right, *ends] if size is None else [*right, m.end()]


class Kind(NamedTuple):
    """A proposed kind: pattern, checksum, score without any context, words that speak for it."""

    name: str
    pattern: re.Pattern
    confirmed: Callable[[str], bool]
    score: float
    context: re.Pattern
    ends: Callable[[re.Match], list[int]] = whole_match
    #: Whether the checksum says enough on its own: mod-97 passes one wrong code in 97, Luhn one in ten.
    certain: bool = False


def _iban(match: str) -> bool:
    code = match.replace(" ", "")
    return 15 <= len(code) <= 34 and mod97(code)


def _short_card(match: str) -> bool:
    digits = NOT_DIGIT.sub("", match)
    return 13 <= len(digits) <= 15 and luhn(digits)


def _local_phone(match: str) -> bool:
    return 7 <= len(NOT_DIGIT.sub("", match)) <= 11


def _ssn(match: str) -> bool:
    area, group, serial = match.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


PROPOSED = (
    Kind(
        "iban",
        re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
        _iban,
        0.8,
        re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
        iban_ends,
        True,
    ),
    Kind(
        "card_short",
        re.compile(r"(?<![0-9.+-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9])"),
        _short_card,
        0.45,
        re.compile(r"(?i)\b(?:card|visa|amex|mastercard|credit|karte|tarjeta|carte)\b"),
    ),
    Kind(
        "phone_local",
        re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[\x20-][0-9]{3}[\x20-]?[0-9]{4}(?![0-9-])"),
        _local_phone,
        0.45,
        re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|teléfono)\b"),
    ),
    Kind(
        "ssn",
        re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        _ssn,
        0.5,
        re.compile(r"(?i)\b(?:ssn|social security)\b"),
    ),
)


def matches(kind: Kind, text: str, taken: Taken) -> Iterator[tuple[int, int]]:
    """(start, end) of what a kind's checksum confirms, in the order of the text.

    What follows a shorter end, or a match without any, is searched again.
    """
    at = 0
    while m := kind.pattern.search(text, at):
        start, at = m.start(), m.end() if kind.ends is whole_match else m.start() + 1
        for end in kind.ends(m):
            if taken.free(start, end) and kind.confirmed(text[start:end]):
                yield start, end
                at = end
                break


def personal_data(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text, by kind as listed and then start; null counts as empty."""
    text = text or ""
    spans = base_spans(text)
    for kind in PROPOSED:
        taken = Taken(spans)
        for start, end in matches(kind, text, taken):
            near = text[max(0, start - NEAR) : end + NEAR]
            score = kind.score + 0.3 * bool(kind.context.search(near))
            score -= 0.2 * bool(UNLIKELY.search(near))
            # Context may raise what such a checksum confirms, and never drops it.
            score = max(score, threshold) if kind.certain else score
            if score >= threshold:
                spans.append(Span(kind.name, start, end, round(min(score, 1.0), 6), False))
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def find_personal_data(text: Column, threshold: float = THRESHOLD) -> Column:
    """Spans of each whole text: kind, start, end, score, base.

    Null and empty texts have none. Rows are scanned one by one, so repeated rows have
    equal spans.
    """

    @F.pandas_udf(SPANS_TYPE)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[s._asdict() for s in personal_data(t, threshold)] for t in texts])

    return scan(text)


def scan_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, spans) of every document; other columns are not read."""
    return docs.select(
        F.col(id_col), find_personal_data(F.col(text_col), threshold).alias("spans")
    )

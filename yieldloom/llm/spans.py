"""Spans found in texts: shared by the secret and the personal-data scans."""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS_TYPE = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


class Span(NamedTuple):
    """``start`` and ``end`` (exclusive) in code points; ``base`` marks the fixed patterns."""

    kind: str
    start: int
    end: int
    score: float
    base: bool


class Taken:
    """Spans already reported, to leave out others that overlap them."""

    def __init__(self, spans: list[Span]):
        self.borders: list[tuple[int, int]] = []
        reach = 0
        for start, end in sorted((s.start, s.end) for s in spans):
            reach = max(reach, end)
            self.borders.append((start, reach))

    def free(self, start: int, end: int) -> bool:
        at = bisect_right(self.borders, (end - 1, float("inf")))
        return not at or self.borders[at - 1][1] <= start

    def gaps(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """The pieces of a stretch that no span covers."""
        at = bisect_right(self.borders, (start, float("inf")))
        if at:
            start = max(start, self.borders[at - 1][1])
        for a, b in itertools.islice(self.borders, at, None):
            if a >= end:
                break
            if a > start:
                yield start, a
            start = max(start, b)
        if start < end:
            yield start, end


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the given order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def counted(spans: Column, kind: str) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def base_digest(spans: Column) -> Column:
    return F.sha2(listed(F.filter(spans, lambda s: s["base"])).cast("binary"), 256)

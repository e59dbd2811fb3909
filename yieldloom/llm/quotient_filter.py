"""Counting quotient filters over integer keys, without loss.

A key of ``bits`` bits is permuted by steps that can be undone, which spreads any keys
evenly. The high bits of the result are its quotient and the rest its remainder; both are
kept whole, so two keys never share a counter and every key can be read back. Keys lie
sorted by quotient, then remainder: the quotient is not stored, only how many keys each
one has, and the remainders in as few bytes as they need. Sorted filters merge by one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Odd, so that multiplying by them can be undone.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Counts from here on are kept apart from the counters of one byte.
LARGE = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(keys: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the numbers of ``bits`` bits, 1 to 64."""
    mask, shift = _mask(bits), np.uint64((bits + 1) // 2)
    keys = (keys.astype(np.uint64) * np.uint64(MULTIPLIERS[0])) & mask
    keys ^= keys >> shift
    return (keys * np.uint64(MULTIPLIERS[1])) & mask


def restore(codes: np.ndarray, bits: int) -> np.ndarray:
    """The keys behind ``permute``'s results."""
    mask, shift = _mask(bits), np.uint64((bits + 1) // 2)
    first, second = (np.uint64(pow(m, -1, 1 << 64)) for m in MULTIPLIERS)
    keys = (codes.astype(np.uint64) * second) & mask
    keys ^= keys >> shift
    return (keys * first) & mask


def narrow(bits: int) -> np.dtype:
    """The smallest unsigned type of so many bits."""
    return np.dtype(f"u{next(b for b in (1, 2, 4, 8) if 8 * b >= bits)}")


def added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in their order with the sum of their counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(counts[order], starts)


@dataclass(frozen=True)
class Filter:
    """``ends`` of the quotients' runs, and remainders and counts by place."""

    bits: int
    rest_bits: int
    ends: np.ndarray
    rests: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, bits: int) -> Filter:
        """From sorted, different codes of ``bits`` bits; about one quotient a code."""
        quotient_bits = min(bits, max(0, len(codes).bit_length() - 1))
        rest_bits = bits - quotient_bits
        codes = codes.astype(np.uint64)
        # A shift by all 64 bits is not defined.
        quotients = (codes >> np.uint64(rest_bits)) if quotient_bits else np.zeros(len(codes), np.uint64)
        runs = np.bincount(quotients.astype(np.int64), minlength=1 << quotient_bits)
        rests = (codes & _mask(rest_bits)).astype(narrow(rest_bits))
        return cls(bits, rest_bits, np.cumsum(runs), rests, counts.astype(np.int64))

    def codes(self) -> np.ndarray:
        runs = np.diff(self.ends, prepend=0)
        quotients = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
        if len(runs) == 1:
            return self.rests.astype(np.uint64)
        return (quotients << np.uint64(self.rest_bits)) | self.rests.astype(np.uint64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The codes at some places."""
        rests = self.rests[places].astype(np.uint64)
        if len(self.ends) == 1:
            return rests
        quotients = np.searchsorted(self.ends, places, side="right").astype(np.uint64)
        return (quotients << np.uint64(self.rest_bits)) | rests

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code, -1 where it is not in the filter."""
        out = np.full(len(codes), -1, np.int64)
        if len(self.ends) == 1:
            quotients = np.zeros(len(codes), np.int64)
        else:
            quotients = (codes >> np.uint64(self.rest_bits)).astype(np.int64)
        rests = codes & _mask(self.rest_bits)
        place = np.where(quotients > 0, self.ends[np.maximum(quotients - 1, 0)], 0).astype(np.int64)
        end = self.ends[quotients].astype(np.int64)
        todo = np.flatnonzero(place < end)
        # Runs are short: the permutation evens them out.
        while len(todo):
            here = self.rests[place[todo]]
            hit = here == rests[todo]
            out[todo[hit]] = place[todo[hit]]
            todo = todo[here < rests[todo]]
            place[todo] += 1
            todo = todo[place[todo] < end[todo]]
        return out

    def pack(self) -> bytes:
        """All of it as bytes: run lengths, remainders, and counters of one byte, large counts apart."""
        runs = np.diff(self.ends, prepend=0)
        runs = runs.astype(np.min_scalar_type(int(runs.max())))
        large = np.flatnonzero(self.counts >= LARGE)
        parts = [
            np.array([self.bits, self.rest_bits, runs.itemsize, len(runs), len(self.rests), len(large)], "<i8"),
            runs,
            self.rests,
            np.minimum(self.counts, LARGE).astype(np.uint8),
            large.astype("<i8"),
            self.counts[large].astype("<i8"),
        ]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> Filter:
        bits, rest_bits, run_size, n_runs, size, n_large = np.frombuffer(data, "<i8", 6).tolist()
        at = 48

        def read(kind: np.dtype, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += n * out.itemsize
            return out

        ends = np.cumsum(read(np.dtype(f"u{run_size}"), n_runs), dtype=np.int64)
        rests = read(narrow(rest_bits), size)
        counts = read(np.dtype(np.uint8), size).astype(np.int64)
        large = read(np.dtype("<i8"), n_large)
        counts[large] = read(np.dtype("<i8"), n_large)
        return cls(bits, rest_bits, ends, rests, counts)


def merge(filters: list[Filter]) -> Filter:
    """One filter with the sums of all counters; the filters' keys have equal bits."""
    codes, counts = added(
        np.concatenate([f.codes() for f in filters]), np.concatenate([f.counts for f in filters])
    )
    return Filter.of(codes, counts, filters[0].bits)

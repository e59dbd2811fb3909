"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizers cut the bytes of a text, so a token is known by the byte offset where it
ends. The two sorted lists of ends are intersected by galloping: each end of the shorter
list searches the longer one from where its share of the list lies, in steps that double,
then by halving. Ends found in both cut the tokens into groups; differences of ranks give
the tokens of the longer list that a token of the shorter one overlaps. All ends of a
batch of texts gallop side by side.

Two tokens that end together cover the same last bytes, so the bytes of one are the end
of the other's. The pairs that can ever be linked therefore follow from the two
vocabularies alone, and counts over the corpus are one array of that length.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import groups_of, raw_texts

#: Text that a task aligns at once; its tokens take about ten times as much.
TEXT_BYTES = 2 << 20
#: How the byte-level vocabulary splits a text before merging. Fixed value of the public file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space, and a byte, in the pieces of the other vocabulary. Fixed values of its format.
BLANK, BYTE = "▁", re.compile("<0x([0-9A-F]{2})>")


class Tokenizers:
    """Both tokenizers, the bytes of their entries, and the pairs of entries that can be linked."""

    def __init__(self, tokenizer: str, ranks: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokenizer = tokenizer
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(merges.values()) + 1)
        for entry, number in merges.items():
            self.a_bytes[number] = entry
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Codes of the pairs that can be linked, in the order of the second entry.
        self.linkable = np.array(sorted(self._linkable()), np.int64)
        #: Entries as decimal numbers with what stands behind them: inside a group, and at its end.
        self.written = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.written += [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]

    def _piece(self, number: int) -> bytes:
        piece = self.pieces.id_to_piece(number)
        byte = BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(BLANK, " ").encode()

    def _linkable(self) -> Iterator[int]:
        first = {entry: i for i, entry in enumerate(self.a_bytes) if entry}
        second: dict[bytes, list[int]] = {}
        for i, entry in enumerate(self.b_bytes):
            second.setdefault(entry, []).append(i)
        for entry, numbers in second.items():
            ends = [first[entry[k:]] for k in range(len(entry)) if entry[k:] in first]
            yield from (self.code(a, b) for a in ends for b in numbers)
        for entry, a in first.items():
            for k in range(1, len(entry)):
                yield from (self.code(a, b) for b in second.get(entry[k:], ()))

    def code(self, a, b):
        return b * len(self.a_bytes) + a

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.tokenizer)
        slow.encode_special_tokens = True
        return slow

    def first_ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as failed:  # a panic of the native library is no Exception
            if isinstance(failed, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.exact.encode(text, add_special_tokens=False).ids

    def encode(self, raw: bytes) -> tuple[list[int], list[int]]:
        """Ids of both; none if the text is empty or either one's bytes are not the text's."""
        if not raw:
            return [], []
        want, text = b" " + raw, raw.decode("utf-8", "replace")
        a, b = self.first_ids(" " + text), self.pieces.encode(text, num_threads=1)
        whole = b"".join(map(self.a_bytes.__getitem__, a)) == want
        if whole and b"".join(map(self.b_bytes.__getitem__, b)) == want:
            return a, b
        return [], []


@functools.lru_cache(maxsize=2)
def tokenizers(tokenizer: str, ranks: str, pieces: str) -> Tokenizers:
    return Tokenizers(tokenizer, ranks, pieces)


def gallop(
    ends: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray
) -> np.ndarray:
    """Place of the first value of the sorted ``other[low:high]`` that is not below each of ``ends``.

    Each search starts at its ``start``, doubles its steps away from there until it has
    passed the value, and halves what lies between; ``high`` where all are below.
    """
    below, above = low - 1, high.copy()
    if not len(ends):
        return above
    at = np.clip(start, low, np.maximum(high - 1, low))
    some = low < high
    right = np.zeros(len(ends), bool)
    right[some] = other[at[some]] < ends[some]
    for way in (1, -1):
        todo = np.flatnonzero(some & (right if way > 0 else ~right))
        place, step = at[todo], 1
        while len(todo):
            less = other[place] < ends[todo]
            below[todo[less]] = place[less]
            above[todo[~less]] = place[~less]
            going = less if way > 0 else ~less
            todo, place = todo[going], place[going] + way * step
            inside = (place < high[todo]) & (place >= low[todo])
            todo, place, step = todo[inside], place[inside], 2 * step
    todo = np.flatnonzero(above - below > 1)
    while len(todo):
        middle = (above[todo] + below[todo]) >> 1
        less = other[middle] < ends[todo]
        below[todo[less]] = middle[less]
        above[todo[~less]] = middle[~less]
        todo = todo[above[todo] - below[todo] > 1]
    return above


class Aligned:
    """Tokens of a batch of texts: ids, ends, groups and overlaps.

    ``a_at`` and ``b_at`` hold where each text's tokens start, and the total. ``a_last``
    and ``b_last`` are the places of the tokens that end together.
    """

    def __init__(self, both: Tokenizers, ids: list[tuple[list[int], list[int]]]):
        self.both = both
        self.a, self.a_at = _flat([a for a, _ in ids])
        self.b, self.b_at = _flat([b for _, b in ids])
        a_ends, b_ends = np.cumsum(both.a_sizes[self.a]), np.cumsum(both.b_sizes[self.b])
        n_a, n_b = np.diff(self.a_at), np.diff(self.b_at)
        self.a_shorter = n_a <= n_b
        self.rank = np.zeros(0, np.int64)
        sides = ((a_ends, self.a_at, b_ends, self.b_at), (b_ends, self.b_at, a_ends, self.a_at))
        found, overlaps, self.ranges = [], np.zeros(len(ids), np.int64), {}
        for is_a, (ends, at, other, other_at) in zip((True, False), sides):
            texts = np.flatnonzero(self.a_shorter == is_a)
            sizes = np.diff(at)[texts]
            mine = np.repeat(texts, sizes)
            inside = np.arange(len(mine)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = at[mine] + inside
            low, high = other_at[mine], other_at[mine + 1]
            start = low + inside * (high - low) // np.maximum(1, at[mine + 1] - at[mine])
            rank = gallop(ends[place], other, low, high, start)
            hit = (rank < high) & (other[np.minimum(rank, len(other) - 1)] == ends[place])
            # What a token overlaps begins behind the ends up to the one before it.
            first = low.copy()
            inner = inside > 0
            first[inner] = (rank + hit)[:-1][inner[1:]]
            overlaps += np.bincount(mine, rank - first + 1, len(ids)).astype(np.int64)
            self.ranges[is_a] = (mine, first - low, rank - low)
            pair = (place[hit], rank[hit])
            found.append(pair if is_a else pair[::-1])
        a_last, b_last = (np.concatenate(side) for side in zip(*found))
        order = np.argsort(a_last, kind="stable")
        self.a_last, self.b_last, self.n_overlaps = a_last[order], b_last[order], overlaps
        self.text_of = np.searchsorted(self.a_at, self.a_last, side="right") - 1
        self.n_groups = np.bincount(self.text_of, minlength=len(ids))

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        ends_a, ends_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        ends_a[self.a_last], ends_b[self.b_last] = True, True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        # In the list a group's first tokens stand before its second ones.
        row = np.empty(len(self.a) + len(self.b), np.int64)
        row[np.arange(len(self.a)) + np.concatenate([[0], self.b_last + 1])[group_a]] = 2 * self.a + ends_a
        offset = 2 * len(self.both.a_bytes)
        row[np.arange(len(self.b)) + (self.a_last + 1)[group_b]] = offset + 2 * self.b + ends_b
        strings, bounds = [self.both.written[i] for i in row.tolist()], self.a_at + self.b_at
        return ["".join(strings[i:j])[:-1] for i, j in zip(bounds, bounds[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place among the linkable pairs, links) of the different pairs of each text."""
        codes = self.both.code(self.a[self.a_last], self.b[self.b_last])
        span = len(self.both.a_bytes) * len(self.both.b_bytes)
        found, times = np.unique(self.text_of * span + codes, return_counts=True)
        return found // span, np.searchsorted(self.both.linkable, found % span), times

    def overlaps(self, n_texts: int) -> list[list[tuple[int, int]]]:
        """For each token of a text's shorter list the first and last token it overlaps in the longer."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
        for mine, first, last in self.ranges.values():
            for text, i, j in zip(mine.tolist(), first.tolist(), last.tolist()):
                out[text].append((i, j))
        return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum([0, *map(len, lists)])
    return np.fromiter((x for ids in lists for x in ids), np.int64, at[-1]), at


def align(
    docs: DataFrame,
    tokenizer: str,
    ranks: str,
    pieces: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: bool = False,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_overlaps, groups, pairs, times.

    The first tokenizer reads a space and the text, the second the text, before which it
    sets a space itself; special tokens are plain text to both. ``groups`` lists the
    entry numbers of the groups (``a1,a2|b1;a3|b2,b3``), ``pairs`` the different linked
    pairs as places among all that can be linked, ``times`` how often each is, and
    ``n_overlaps`` counts the pairs of tokens that share a byte. With ``ranges`` the
    column ``overlaps`` holds, for each token of the shorter list (the first on a tie),
    the first and last token of the longer list that it shares bytes with.

    Null and empty texts, texts that are not valid UTF-8, and texts whose bytes a
    tokenizer doesn't give back have no tokens: zeros, '' and empty lists. Every row is a
    document of its own, repeated ones and null ids too. Texts are read whole, a few
    megabytes at a time, a longer one on its own; nothing is shuffled. An empty table
    gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_a long, n_b long, n_groups long, n_overlaps long, groups string, "
        "pairs array<int>, times array<int>"
    )
    if ranges:
        schema += ", overlaps array<struct<first:int,last:int>>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(tokenizer, ranks, pieces)
        for batch in groups_of(batches, TEXT_BYTES):
            if not batch.num_rows:
                continue
            rows = Aligned(both, [both.encode(raw) for raw in raw_texts(batch.column(1))])
            text, pairs, times = rows.links()
            at = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            columns = [
                batch.column(0),
                *map(pa.array, (np.diff(rows.a_at), np.diff(rows.b_at), rows.n_groups, rows.n_overlaps)),
                pa.array(rows.groups(), pa.string()),
                pa.ListArray.from_arrays(at, pa.array(pairs, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(times, pa.int32())),
            ]
            if ranges:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                found = rows.overlaps(batch.num_rows)
                columns.append(
                    pa.array([[{"first": i, "last": j} for i, j in x] for x in found], kind)
                )
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def link_counts(aligned: DataFrame, tokenizer: str, ranks: str, pieces: str) -> np.ndarray:
    """How many links of all documents hold each linkable pair.

    Tasks add up their pairs before the shuffle. What comes to the driver is at most one
    number for each linkable pair, a bound that the two vocabularies set and that does
    not grow with the documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(tokenizers(tokenizer, ranks, pieces).linkable), np.int64)
        for batch in batches:
            pairs, times = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(sums, pairs, times)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(sums[found])], ["pair", "n"])

    table = (
        aligned.select("pairs", "times")
        .mapInArrow(count, "pair int, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros(len(tokenizers(tokenizer, ranks, pieces).linkable), np.int64)
    counts[table["pair"].to_numpy()] = table["n"].to_numpy()
    return counts


def with_counts(
    aligned: DataFrame, counts: np.ndarray, tokenizer: str, ranks: str, pieces: str
) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum in the place of pairs and times.

    ``n_best`` are the links whose count is the highest that their second entry has with
    any first one, ties included; ``count_sum`` adds the counts of all links.
    """
    both = tokenizers(tokenizer, ranks, pieces)
    starts = np.flatnonzero(np.diff(both.linkable // len(both.a_bytes), prepend=-1))
    sizes = np.diff(np.append(starts, len(counts)))
    best = counts == np.repeat(np.maximum.reduceat(counts, starts), sizes)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, best))
    kept = [f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += ", n_links long, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            pairs, times = (
                batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (len(kept), len(kept) + 1)
            )
            times = times.astype(np.int64)
            ends = np.cumsum(batch.column(len(kept)).value_lengths().to_numpy(zero_copy_only=False))
            sums = [np.append(0, np.cumsum(x)) for x in (times, times * best[pairs], times * counts[pairs])]
            sums = [pa.array(np.diff(x[np.append(0, ends)])) for x in sums]
            names = [*[f.name for f in kept], "n_links", "n_best", "count_sum"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *sums], names)

    return aligned.select(*[f.name for f in kept], "pairs", "times").mapInArrow(run, schema)

"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class j holds pieces longer than
capacity / (j + 1) and up to capacity / j, and a bin of class j takes exactly j of
them. No piece ever needs to look at another class or at another worker, so each
partition fills its own bins in one pass.

Documents may be cut, which removes most of the padding harmonic classes are known
for: a piece that would leave more than ``slack`` of its bins empty is cut to the next
reciprocal of the capacity, where it fits, and what is left goes to its own class. The
pieces of bins still open at the end of a partition are strung together and cut at the
capacity; the last sequence of a partition is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import functools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import groups_of, raw_texts

CAPACITY, END_ID = 2048, 1
#: Share of a bin that may stay empty before a piece is cut.
SLACK = 1 / 64
#: Pieces up to this length are never cut: their classes waste next to nothing.
TAIL = 24
TEXT_BYTES = 4 << 20
IDS_AT_ONCE = 1 << 20

#: How the vocabulary splits a text before merging. Fixed value of the public file.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Read as one id by the vocabulary's own library, also inside a text.
SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=2)
def token_ids(tokenizer: str, ranks: str | None) -> Callable[[str], list[int]]:
    """Text to ids of the vocabulary file ``tokenizer``.

    ``ranks`` names the same vocabulary as merge ranks, whose library gives the same
    ids several times faster. It is used for every text without the special token;
    without it, and where it fails (endless white space), the first library does all.
    Either is loaded only where a text needs it.
    """

    @functools.lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer)

    def slow(text: str) -> list[int]:
        return exact().encode(text, add_special_tokens=False).ids

    if ranks is None:
        return slow
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as failed:  # a panic of the native library is no Exception
            if isinstance(failed, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode


@functools.lru_cache(maxsize=1 << 14)
def cuts(length: int, capacity: int, slack: float, tail: int) -> tuple[int, ...]:
    """Lengths of the pieces of a rest shorter than the capacity."""
    pieces = []
    while length:
        fit = capacity // length
        if length <= tail or fit * length >= (1 - slack) * capacity:
            pieces.append(length)
            break
        piece = capacity // (fit + 1)
        pieces.append(piece)
        length -= piece
    return tuple(pieces)


class Bins:
    """Open bins of one partition, one per class, and the finished pieces."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list] = defaultdict(list)
        self.rows: list[tuple] = []
        self.held = 0

    def place(self, doc: object, tokens: int, start: int, ids: np.ndarray) -> None:
        fit = self.capacity // len(ids)
        members = self.open[fit]
        members.append((doc, tokens, start, ids))
        if len(members) == fit:
            self.close(members)
            del self.open[fit]

    def close(self, members: list) -> None:
        offset = 0
        for doc, tokens, start, ids in members:
            self.rows.append((doc, start, len(ids), tokens, self.sequence, offset, ids))
            offset += len(ids)
            self.held += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Close what is open: string the pieces together and cut them at the capacity.

        A class has fewer than its fixed count left, so at most one bin per class gets here.
        """
        rest = [m for fit in sorted(self.open) for m in self.open[fit]]
        self.open.clear()
        total = sum(len(m[3]) for m in rest)
        sizes = [self.capacity] * (total // self.capacity)
        short = total % self.capacity
        # Full powers of two, and one padded sequence for the few ids below ``TAIL``.
        while short > TAIL:
            sizes.append(1 << (short.bit_length() - 1))
            short -= sizes[-1]
        sizes += [short] if short else []
        at = 0
        for size in sizes:
            members, room = [], size
            while room:
                doc, tokens, start, ids = rest[at]
                members.append((doc, tokens, start, ids[:room]))
                if len(ids) > room:
                    rest[at] = (doc, tokens, start + room, ids[room:])
                    room = 0
                else:
                    room -= len(ids)
                    at += 1
            self.close(members)


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slack: float = SLACK,
    tail: int = TAIL,
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    A document is its text's ids and then ``end_id``. A null or empty text is the end
    id alone. Every row is a document, repeated ones and null ids too. Sequences stay
    within a partition: nothing is shuffled, and what a task holds is one batch and one
    bin per class. Sequence ids are the partition number in the high bits and a count
    below, the same when a task is run again. An empty table gives no rows; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, start long, length long, doc_tokens long, sequence_id long, "
        "offset long, ids binary"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def flush(bins: Bins, id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*bins.rows)) or [()] * len(names)
        bins.rows, bins.held = [], 0
        arrays = [pa.array(columns[0], id_type)]
        arrays += [pa.array(c, pa.int64()) for c in columns[1:6]]
        arrays.append(pa.array([x.tobytes() for x in columns[6]], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer, ranks)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        id_type = None
        for batch in groups_of(batches, TEXT_BYTES):
            id_type = batch.column(0).type
            texts = raw_texts(batch.column(1))
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = np.array([*encode(text.decode("utf-8")), end_id], dtype="<u4")
                n, start = len(ids), 0
                lengths = [capacity] * (n // capacity)
                for length in (*lengths, *cuts(n % capacity, capacity, slack, tail)):
                    bins.place(doc, n, start, ids[start : start + length])
                    start += length
                if bins.held >= IDS_AT_ONCE:
                    yield flush(bins, id_type)
        if id_type is not None:
            bins.finish()
            yield flush(bins, id_type)

    packed = docs.select(id_col, text_col).mapInArrow(run, schema)
    return packed.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids",
        "doc_tokens",
        "sequence_id",
        "offset",
    )

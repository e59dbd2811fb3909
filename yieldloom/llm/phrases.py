"""Phrase collocations, counted in quotient filters.

Phrases grow word by word. Only words found often enough get a number, and a phrase of n
words can be frequent only if its first and its last n - 1 words are; so each round counts
what extends the frequent phrases of the round before, and nothing that could be returned
is left out. A phrase is packed as the number of its first n - 1 words and the number of
its last word, in as many bits as these need.

Each task adds its phrases up in sorted quotient filters, one for each range of the
permuted keys, and hands on whole filters; filters of one range are merged where they
meet. The frequent phrases of a range are stored in the shared folder as a filter that
workers map into memory. A phrase's number is its place there, so phrases can be read
back from their numbers, and every count that a score needs is looked up.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.llm import quotient_filter
from yieldloom.llm.common import groups_of, raw_texts, written
from yieldloom.llm.quotient_filter import Filter
from yieldloom.llm.shared_arrays import mapped, save
from yieldloom.operators.joins import joined_side
from yieldloom.sources.scratch import scratch_path

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Stands for the end of a piece; no word holds it.
STOP = b"."
#: Characters that end a piece, all as ``STOP``; A-Z lower-cased by ``bytes.lower``.
STOPS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", STOP * 10)


@dataclass(frozen=True)
class Limits:
    """What is held at once; results are the same for all values."""

    #: Text in one row of numbered words.
    text_bytes: int = 4 << 20
    #: Different phrases that a task adds up before it hands on their filters.
    phrases: int = 1 << 21
    #: Filters that are merged at once, in bytes.
    merged_bytes: int = 32 << 20
    #: Words of the corpus for which there is one more range, and ranges for one more task.
    range_words: int = 4_000_000
    ranges_a_task: int = 8


STREAM = "lang string, n long, words array<binary>, counts array<long>, tokens binary"
BLOCK = "range long, block binary"
SIZES = "range long, size long"


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(different words, their places in running text). Place 0 is ``STOP``, the end of a piece."""
    places = {STOP: 0}
    place = places.setdefault
    tokens: list[int] = []
    for text in texts:
        words = text.lower().translate(STOPS).replace(STOP, b" . ").split()
        tokens += [place(w, len(places)) for w in words]
        tokens.append(0)
    return list(places), np.array(tokens, np.int32)


def _streams(limits: Limits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in STREAM.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
    for batch in groups_of(batches, limits.text_bytes):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            words, tokens = numbered(texts)
            counts = np.bincount(tokens, minlength=len(words))[1:]
            row = (lang, int(counts.sum()), words[1:], counts, tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each key, as a 63-bit number that Spark sorts alike and the other half."""
    both = [xxhash.xxh3_128_intdigest(k) for k in keys]
    high = np.array([x >> 65 for x in both], np.int64)
    return high, np.array([x & ((1 << 63) - 1) for x in both], np.int64)


@dataclass(frozen=True)
class Words:
    """Frequent words of all languages, numbered from 1 in the order of their hashes."""

    folder: str
    #: Words before each bucket, and all.
    starts: np.ndarray

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def array(self, bucket: int, name: str) -> np.ndarray:
        return mapped(f"{self.folder}/words/{bucket}-{name}.npy")

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Numbers of a language's words; 0 for words that are not frequent."""
        out = np.zeros(len(words), np.int64)
        prefix = lang.encode() + b" "
        high, low = _hashes([prefix + w for w in words])
        bucket = _bucket(high, len(self.starts) - 1)
        for b in np.unique(bucket):
            if self.starts[b] < self.starts[b + 1]:
                here = np.flatnonzero(bucket == b)
                known = self.array(b, "high")
                at = np.minimum(np.searchsorted(known, high[here]), len(known) - 1)
                hit = (known[at] == high[here]) & (self.array(b, "low")[at] == low[here])
                out[here[hit]] = 1 + self.starts[b] + at[hit]
        return out

    def _by_bucket(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        bucket = np.searchsorted(self.starts, numbers - 1, side="right") - 1
        for b in np.unique(bucket):
            here = np.flatnonzero(bucket == b)
            yield b, here, numbers[here] - 1 - self.starts[b]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for b, here, place in self._by_bucket(numbers):
            out[here] = self.array(b, "count")[place]
        return out

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """(language, blank, word) of each number, as bytes."""
        out = np.empty(len(numbers), object)
        for b, here, place in self._by_bucket(numbers):
            ends, text = self.array(b, "ends"), self.array(b, "text")
            starts = np.where(place > 0, ends[np.maximum(place - 1, 0)], 0)
            out[here] = [text[i:j].tobytes() for i, j in zip(starts, ends[place])]
        return out


def _bucket(high: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash: its high 31 bits, scaled."""
    return ((high >> 32) * buckets) >> 31


@dataclass(frozen=True)
class Level:
    """Frequent phrases of ``n`` words, numbered from 1 in the order of their permuted keys."""

    folder: str
    n: int
    word_bits: int
    bits: int
    range_bits: int
    #: Phrases before each range, and all; missing until they are counted.
    starts: np.ndarray | None = None

    @classmethod
    def after(cls, folder: str, n: int, firsts: int, words: int, ranges: int) -> Level:
        word_bits = words.bit_length()
        bits = firsts.bit_length() + word_bits
        if bits > 64:
            raise ValueError(f"{firsts} phrases and {words} words: {n} words don't fit in 64 bits")
        return cls(folder, n, word_bits, bits, min(bits - 1, (ranges - 1).bit_length()))

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    @property
    def low_bits(self) -> int:
        return self.bits - self.range_bits

    def codes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        keys = (first.astype(np.uint64) << np.uint64(self.word_bits)) | last.astype(np.uint64)
        return quotient_filter.permute(keys, self.bits)

    def parts(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(range, start, end) of sorted codes."""
        ranges = (codes >> np.uint64(self.low_bits)).astype(np.int64)
        starts = np.flatnonzero(np.diff(ranges, prepend=-1))
        return zip(ranges[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(codes)])

    def low(self, codes: np.ndarray) -> np.ndarray:
        return codes & np.uint64((1 << self.low_bits) - 1)

    def stored(self, number: int) -> Filter:
        ends, rests, counts = (
            mapped(f"{self.folder}/{self.n}/{number}-{name}.npy") for name in ("ends", "rests", "counts")
        )
        return Filter(self.low_bits, self.low_bits - (len(ends).bit_length() - 1), ends, rests, counts)

    def store(self, number: int, found: Filter) -> None:
        for name in ("ends", "rests", "counts"):
            array = getattr(found, name)
            if name != "rests":
                array = array.astype(np.min_scalar_type(int(array.max())))
            save(f"{self.folder}/{self.n}/{number}-{name}.npy", array)

    def numbers(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Numbers of phrases by their first words' number and last word; 0 if not frequent."""
        different, place = np.unique(self.codes(first, last), return_inverse=True)
        out = np.zeros(len(different), np.int64)
        for r, i, j in self.parts(different):
            if self.starts[r] < self.starts[r + 1]:
                at = self.stored(r).find(self.low(different[i:j]))
                out[i:j] = np.where(at >= 0, at + 1 + self.starts[r], 0)
        return out[place]

    def _by_range(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ranges = np.searchsorted(self.starts, numbers - 1, side="right") - 1
        for r in np.unique(ranges):
            here = np.flatnonzero(ranges == r)
            yield int(r), here, numbers[here] - 1 - self.starts[r]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for r, here, place in self._by_range(numbers):
            out[here] = self.stored(r).counts[place]
        return out

    def split(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first words, and the last word, of each phrase."""
        codes = np.zeros(len(numbers), np.uint64)
        for r, here, place in self._by_range(numbers):
            codes[here] = self.stored(r).at(place) | np.uint64(r << self.low_bits)
        keys = quotient_filter.restore(codes, self.bits)
        last = keys & np.uint64((1 << self.word_bits) - 1)
        return (keys >> np.uint64(self.word_bits)).astype(np.int64), last.astype(np.int64)


@dataclass(frozen=True)
class Model:
    words: Words
    #: Of two words and more.
    levels: tuple[Level, ...] = ()

    def counts(self, n: int, numbers: np.ndarray) -> np.ndarray:
        return (self.words if n == 1 else self.levels[n - 2]).counts(numbers)

    def extend(self, ids: np.ndarray) -> np.ndarray:
        """Number of the longest phrases known, starting at each word of running text; 0 if none."""
        numbers = ids
        for level in self.levels:
            found = np.zeros(len(ids), np.int64)
            here = self.open(numbers)
            if len(here):
                found[here] = level.numbers(numbers[here], ids[here + level.n - 1])
            numbers = found
        return numbers

    def open(self, numbers: np.ndarray) -> np.ndarray:
        """Places where both the phrase and the one a word later are frequent."""
        return np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))

    def spelled(self, n: int, numbers: np.ndarray) -> np.ndarray:
        """Word numbers of phrases of ``n`` words, a row each."""
        out = np.empty((len(numbers), n), np.int64)
        for level in reversed(self.levels[: n - 1]):
            numbers, out[:, level.n - 1] = level.split(numbers)
        out[:, 0] = numbers
        return out

    def inner(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Numbers of all stretches ``[i, j)`` of frequent phrases given by their words."""
        n = words.shape[1]
        out = {(i, i + 1): words[:, i] for i in range(n)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                first, last = out[i, i + size - 1], words[:, i + size - 1]
                out[i, i + size] = self.levels[size - 2].numbers(first, last)
        return out


def frequent_words(streams: DataFrame, folder: str, buckets: int, min_count: int) -> Words:
    """Number and store the words found at least ``min_count`` times in their language."""
    counted = (
        streams.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        .groupBy("lang", F.col("w.words").alias("word"))
        .agg(F.sum("w.counts").alias("n"))
        .filter(F.col("n") >= min_count)
    )
    key = F.concat(F.col("lang").cast("binary"), F.lit(b" "), F.col("word"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = _hashes(batch.column(0).to_pylist())
            columns = [pa.array(c) for c in (_bucket(high, buckets), high, low)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *batch.columns], ["range", "high", "low", "key", "n"]
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_range(batches):
            high, low, _, n = (c.to_numpy(zero_copy_only=False) for c in rows)
            keys = rows[2].to_pylist()
            text = np.frombuffer(b"".join(keys), np.uint8)
            ends = np.cumsum([len(k) for k in keys])
            arrays = {"high": high, "low": low, "count": n, "ends": ends, "text": text}
            for name, array in arrays.items():
                save(f"{folder}/words/{bucket}-{name}.npy", array)
            yield _sizes(bucket, len(keys))

    sizes = (
        counted.select(key.alias("key"), "n")
        .mapInArrow(hashed, "range long, high long, low long, key binary, n long")
        .repartition(buckets, "range")
        .sortWithinPartitions("range", "high", "low")
        .mapInArrow(write, SIZES)
        .collect()  # a row per bucket
    )
    return Words(folder, _starts(sizes, buckets))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
    """Whole ranges from batches sorted by their first column; the other columns of each."""
    held: list[list[pa.Array]] = []
    current = None
    for batch in batches:
        ranges = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for i, j in itertools.pairwise(cuts):
            if i == j:
                continue
            if current is not None and ranges[i] != current:
                yield int(current), [pa.concat_arrays(c) for c in zip(*held)]
                held = []
            current = ranges[i]
            held.append([c.slice(i, j - i) for c in batch.columns[1:]])
    if held:
        yield int(current), [pa.concat_arrays(c) for c in zip(*held)]


def _sizes(number: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size])], ["range", "size"])


def _starts(sizes: list, ranges: int) -> np.ndarray:
    out = np.zeros(ranges + 1, np.int64)
    for row in sizes:
        out[row["range"] + 1] = row["size"]
    return np.cumsum(out)


def _blocks(level: Level, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    rows = [
        (r, Filter.of(level.low(codes[i:j]), counts[i:j], level.low_bits).pack())
        for r, i, j in level.parts(codes)
    ]
    numbers, blocks = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int64()), pa.array(blocks, pa.binary())], ["range", "block"]
    )


def _count(
    model: Model, level: Level, limits: Limits, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Filters of the phrases in running text, one for each range."""
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for batch in batches:
        for i in range(batch.num_rows):
            lang, words, tokens = (c[i] for c in batch.columns)
            numbers = model.words.numbers(lang.as_py(), words.as_py())
            ids = np.concatenate([[0], numbers])[np.frombuffer(tokens.as_buffer(), np.int32)]
            firsts = model.extend(ids)
            here = model.open(firsts)
            codes = level.codes(firsts[here], ids[here + level.n - 1])
            found = np.unique(codes, return_counts=True)
            held = quotient_filter.added(*map(np.concatenate, zip(held, found)))
            if len(held[0]) >= limits.phrases:
                yield _blocks(level, *held)
                held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(held[0]):
        yield _blocks(level, *held)


def _merge(
    level: Level, min_count: int, limits: Limits, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Merge the filters of each range and store what is frequent."""

    def finish(number: int, filters: list[Filter]) -> pa.RecordBatch:
        whole = quotient_filter.merge(filters)
        often = whole.counts >= min_count
        if often.any():
            level.store(number, Filter.of(whole.codes()[often], whole.counts[often], level.low_bits))
        return _sizes(number, int(often.sum()))

    current, filters, size = None, [], 0
    for batch in batches:
        for number, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            if current is not None and number != current:
                yield finish(current, filters)
                filters, size = [], 0
            current = number
            filters.append(Filter.unpack(block.as_py()))
            size += len(block.as_buffer())
            if size >= limits.merged_bytes and len(filters) > 1:
                filters, size = [quotient_filter.merge(filters)], 0
    if filters:
        yield finish(current, filters)


def count_phrases(
    streams: DataFrame,
    words: Words,
    folder: str,
    ranges: int,
    min_count: int,
    max_words: int,
    limits: Limits,
) -> Model:
    """Frequent phrases of two words and more, a round for each length."""
    model = Model(words)
    size = words.size
    partitions = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(partitions, ranges // limits.ranges_a_task)
    for n in range(2, max_words + 1):
        if not size:
            break
        level = Level.after(folder, n, size, words.size, ranges)
        # Bound as defaults: each round's tasks see its own.
        sizes = (
            streams.select("lang", "words", "tokens")
            .mapInArrow(lambda b, m=model, v=level: _count(m, v, limits, b), BLOCK)
            .repartition(min(tasks, 1 << level.range_bits), "range")
            .sortWithinPartitions("range")
            .mapInArrow(lambda b, v=level: _merge(v, min_count, limits, b), SIZES)
            .collect()  # a row per range
        )
        level = replace(level, starts=_starts(sizes, 1 << level.range_bits))
        if not level.size:
            break
        model = replace(model, levels=(*model.levels, level))
        size = level.size
    return model


PHRASE = (
    "lang string, size int, number long, phrase string, a long, l array<long>, r array<long>, "
    "first long, last long, covers_first boolean, covers_last boolean"
)


def phrases_of(streams: DataFrame, model: Model) -> DataFrame:
    """All frequent phrases with their counts and those of their cuts' parts; a task per few ranges."""
    jobs = [(v.n, r) for v in model.levels for r in range(len(v.starts) - 1) if v.starts[r] < v.starts[r + 1]]
    names = [f.split()[0] for f in PHRASE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.column(0).to_pylist():
                n, r = jobs[job]
                level = model.levels[n - 2]
                numbers = np.arange(level.starts[r] + 1, level.starts[r + 1] + 1)
                spelled = model.spelled(n, numbers)
                inner = model.inner(spelled)
                a = level.counts(numbers)
                left = np.stack([model.counts(k, inner[0, k]) for k in range(1, n)], axis=1)
                right = np.stack([model.counts(n - k, inner[k, n]) for k in range(1, n)], axis=1)
                keys = model.words.keys(spelled.ravel()).reshape(spelled.shape)
                parts = [[k.rsplit(b" ", 1) for k in row] for row in keys]
                columns = [
                    pa.array([p[0][0].decode() for p in parts], pa.string()),
                    pa.array(np.full(len(a), n, np.int32)),
                    pa.array(numbers),
                    pa.array([b" ".join(w for _, w in p).decode("utf-8", "replace") for p in parts], pa.string()),
                    pa.array(a),
                    pa.array(left.tolist(), pa.list_(pa.int64())),
                    pa.array(right.tolist(), pa.list_(pa.int64())),
                    pa.array(inner[0, n - 1]),
                    pa.array(inner[1, n]),
                    pa.array(left[:, -1] == a),
                    pa.array(right[:, 0] == a),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    spark = streams.sparkSession
    tasks = max(1, min(len(jobs), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, len(jobs), 1, tasks).mapInArrow(run, PHRASE)


def _score(n: Column) -> Column:
    """The lowest-scoring cut as (score, k, l, r); products are decimals of 38 digits."""
    wide = "decimal(38,0)"

    def of(left: Column, k: Column) -> Column:
        right = F.get("r", k)
        above = F.col("a").cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)")
        above = above.cast("decimal(23,0)") * n.cast("decimal(15,0)")
        below = left.cast("decimal(19,0)") * right.cast("decimal(19,0)")
        score = F.call_function("div", above.cast(wide), below.cast(wide)).cast("long")
        return F.struct(score.alias("score"), (k + 1).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform("l", of))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int | None = TOP,
    limits: Limits = Limits(),
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and into
    words at blanks and tabs. ``n`` counts a language's words, ``a`` a phrase inside
    pieces, ``l`` and ``r`` the parts of the cut with the lowest score, the first of
    equal ones; ``score`` is floor(1000 a n / (l r)), exact. Phrases have two to
    ``max_words`` words and ``min_count`` occurrences. A phrase goes if a longer one holds
    it each time it occurs. Ties are ordered by count, then by the phrase's bytes. ``top``
    None returns all.

    Null texts are empty; a null language is ``und``, and so is one of that name. Repeated
    rows count each time, ids play no part. Bytes that are not UTF-8 are counted as they
    are and shown as the replacement character. An empty table, or one without frequent
    phrases, gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "phrases")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    streams = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        lambda b: _streams(limits, b), STREAM
    )
    streams = written(streams, "streams")
    sizes = written(streams.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    total, n_langs = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    words = frequent_words(streams, folder, partitions, min_count)
    ranges = max(2 * partitions, (total or 0) // limits.range_words, 2)
    model = count_phrases(streams, words, folder, ranges, min_count, max_words, limits)
    found = written(phrases_of(streams, model), "found")
    # A longer phrase with as many occurrences covers its first and its last part; what it
    # covers further inside, these do. A phrase is covered twice at most.
    covered = found.filter("covers_first").select("size", F.col("first").alias("number"))
    covered = covered.union(found.filter("covers_last").select("size", F.col("last").alias("number")))
    covered = covered.select((F.col("size") - 1).alias("size"), "number")
    kept = found.join(covered.hint("merge"), ["size", "number"], "left_anti")
    side = joined_side(sizes.withColumnRenamed("lang", "_lang"), n_langs)
    scored = kept.join(side, F.col("lang") == F.col("_lang")).withColumn("best", _score(F.col("n")))
    rows = scored.select(
        "lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    # The limit is applied before the shuffle as well, so a language is never sorted whole.
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def oracle(min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM split, (SELECT unnest(range(1, {max_words + 1})) AS k))
), counted AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {min_count}
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c
  FROM counted WHERE k > 1
), scored AS (
  SELECT x.lang, x.k, x.phrase, a, n, u.f AS l, v.f AS r, c,
         CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(u.f AS HUGEINT) * v.f) AS BIGINT) AS score
  FROM cuts x JOIN totals t ON t.lang = x.lang
  JOIN counted u ON u.lang = x.lang AND u.phrase = array_to_string(w[:c], ' ')
  JOIN counted v ON v.lang = x.lang AND v.phrase = array_to_string(w[c + 1:], ' ')
), best AS (
  SELECT * FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM counted o WHERE o.lang = s.lang AND o.k > s.k AND 100 * o.f >= 100 * s.a
                    AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best QUALIFY rank <= {top}
"""

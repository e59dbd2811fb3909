"""Interpolated modified Kneser-Ney bigram model.

Counting is done by Spark: words, then word pairs, then what each word needs for its
discounts. Words become numbers, the places of their hashes in one sorted array that is
cut into buckets by hash. A pair's two numbers make one 64-bit number, mixed so that
ranges of it are even buckets; these hashes are kept sorted with their counts. All
arrays lie in the shared folder; scoring workers map them and look up a batch's
different pairs by binary search.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import groups_of, raw_texts
from yieldloom.llm.shared_arrays import mapped, save
from yieldloom.sources.scratch import scratch_path

#: Stand-ins for the two ends of a text; no word holds a blank.
START, END = b"< s >", b"< /s >"
#: Text that a task counts, and scores, at once: scoring holds a dozen numbers a token.
TEXT_BYTES, SCORED_BYTES = 6 << 20, 3 << 20
#: Different pairs that a task adds up before it hands them on.
PAIRS_AT_ONCE = 1 << 21
#: Tokens for which there is one more bucket of pairs.
BUCKET = 1_000_000
WORD_BITS = 32
#: Odd, so that multiplying by it can be undone: pairs to evenly spread hashes and back.
MIX = 0x9E3779B97F4A7C15
UNMIX = pow(MIX, -1, 1 << 64)
#: Rows of the word statistics.
BEFORE, ONCE, TWICE, MORE = range(4)


def hashed(words: list[bytes]) -> np.ndarray:
    """63-bit hashes, so that Spark's long keeps their order."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) >> 1 for w in words), np.int64, len(words))


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, word places of all tokens, token count of each text).

    A text's tokens are its words with A-Z lower-cased, and END. END has place 0 and
    START, which is no token, place 1.
    """
    places = {END: 0, START: 1}
    place = places.setdefault
    tokens: list[int] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        tokens += [place(w, len(places)) for w in words]
        tokens.append(0)
        counts[i] = len(words) + 1
    return list(places), np.array(tokens, np.int64), counts


def previous(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The place before each token; START before a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = 1
    return before


@dataclass(frozen=True)
class Discounts:
    """What is taken off counts of one, two, and three or more."""

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n1: int, n2: int, n3: int, n4: int) -> Discounts:
        """From the numbers of entries counted once, twice, ...; 0.75 where these say nothing."""
        if not (n1 and n2):
            return cls(0.75, 0.75, 0.75)
        y = n1 / (n1 + 2 * n2)
        two = 2 - 3 * y * n3 / n2
        more = 3 - 4 * y * n4 / n3 if n3 else two
        # Never nothing: pairs not seen must keep some probability.
        return cls(1 - 2 * y * n2 / n1, max(0.05, min(2.0, two)), max(0.05, min(3.0, more)))

    def off(self, counts: np.ndarray) -> np.ndarray:
        """Discount of each count; zero has none."""
        return np.array([0.0, self.one, self.two, self.more])[np.minimum(counts, 3)]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that hold for the whole corpus."""

    folder: str
    starts: tuple[int, ...]
    pair_bits: int
    train_tokens: int
    vocabulary: int
    pair_types: int
    pair_discounts: Discounts
    word_discounts: Discounts
    #: Probability that the word level leaves to be shared evenly, unknown words included.
    even: float

    def array(self, kind: str, bucket: int, name: str) -> np.ndarray:
        return mapped(f"{self.folder}/{kind}/{bucket}-{name}.npy")

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for words not in the vocabulary."""
        out = np.full(len(hashes), -1, np.int64)
        bucket = bucket_of(hashes, len(self.starts) - 1)
        for b in np.unique(bucket):
            if self.starts[b] < self.starts[b + 1]:
                here = np.flatnonzero(bucket == b)
                at, hit = _search(self.array("words", b, "hash"), hashes[here])
                out[here[hit]] = self.starts[b] + at[hit]
        return out

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, and the four statistics, of words by number; zero for unknown ones."""
        count, stats = np.zeros(len(ids), np.int64), np.zeros((4, len(ids)), np.int64)
        bucket = np.searchsorted(np.array(self.starts), ids, side="right") - 1
        for b in np.unique(bucket[ids >= 0]):
            here = np.flatnonzero((bucket == b) & (ids >= 0))
            place = ids[here] - self.starts[b]
            count[here] = self.array("words", b, "count")[place]
            stats[:, here] = self.array("words", b, "stats")[:, place]
        return count, stats

    def of_pairs(self, codes: np.ndarray) -> np.ndarray:
        """Counts of sorted, different pair hashes; zero for pairs never seen."""
        out = np.zeros(len(codes), np.int64)
        starts, buckets = _runs(pair_bucket(codes, self.pair_bits))
        for a, b, bucket in zip(starts, [*starts[1:], len(codes)], buckets):
            at, hit = _search(self.array("pairs", bucket, "hash"), codes[a:b])
            out[a:b][hit] = self.array("pairs", bucket, "count")[at[hit]]
        return out


def _search(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in a sorted array, and which of them are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    keys = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
    return (keys * np.uint64(MIX)).view(np.int64)


def pair_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = codes.view(np.uint64) * np.uint64(UNMIX)
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def pair_bucket(codes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets are ranges of the hash, in its order."""
    return codes >> (64 - bits)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash: its high 31 bits, scaled."""
    return ((hashes >> 32) * buckets) >> 31


def _bucket_column(hash_col: str, buckets: int) -> Column:
    return F.shiftright(F.shiftright(hash_col, 32) * F.lit(buckets).cast("long"), 31)


def _table(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values in a sorted array, and these values."""
    if not len(values):
        return np.zeros(0, np.int64), values
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, values[starts]


def _added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in their order, and the sum of ``n`` over each."""
    order = np.argsort(codes, kind="stable")
    starts, codes = _runs(codes[order])
    return codes, np.add.reduceat(n[order], starts)


def _by_bucket(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Whole buckets from batches sorted by their first column, one at a time."""
    held: list[list[np.ndarray]] = []
    bucket = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        starts, values = _runs(columns[0])
        for a, b, value in zip(starts, [*starts[1:], len(columns[0])], values):
            if bucket is not None and value != bucket:
                yield int(bucket), [np.concatenate(c) for c in zip(*held)]
                held = []
            bucket = value
            held.append([c[a:b] for c in columns[1:]])
    if held:
        yield int(bucket), [np.concatenate(c) for c in zip(*held)]


WORDS, PAIRS = "hash long, n long", "hash long, n long"
STATS = "bucket long, id long, before int, once int, twice int, more int"
SIZES = "bucket long, size long, total long"
LEVEL = "n1 long, n2 long, n3 long, n4 long, entries long, total long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups_of(batches, TEXT_BYTES):
        if batch.num_rows:
            words, tokens, _ = numbered(raw_texts(batch.column(0)))
            # START is in the vocabulary with a count of zero.
            yield _table(WORDS, hashed(words), np.bincount(tokens, minlength=len(words)))


def vocabulary(texts: DataFrame, folder: str) -> tuple[tuple[int, ...], int]:
    """Write the sorted word hashes and their counts; (first number of each bucket, tokens)."""
    counted = texts.mapInArrow(_count_words, WORDS).groupBy("hash").agg(F.sum("n").alias("n"))
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * partitions

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (hashes, counts) in _by_bucket(batches):
            save(f"{folder}/words/{bucket}-hash.npy", hashes)
            save(f"{folder}/words/{bucket}-count.npy", counts)
            yield _table(SIZES, [bucket], [len(hashes)], [int(counts.sum())])

    sizes = (
        counted.withColumn("bucket", _bucket_column("hash", buckets))
        .select("bucket", "hash", "n")
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "hash")
        .mapInArrow(write, SIZES)
        .collect()  # a row per bucket
    )
    by_bucket = {r["bucket"]: r for r in sizes}
    lengths = [by_bucket[b]["size"] if b in by_bucket else 0 for b in range(buckets)]
    starts = (0, *itertools.accumulate(lengths))
    if starts[-1] >> WORD_BITS:
        raise ValueError(f"{starts[-1]} different words; a pair's number has room for 2^32")
    return starts, sum(r["total"] for r in sizes)


def _count_pairs(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[np.ndarray, np.ndarray] | None = None
    for batch in groups_of(batches, TEXT_BYTES):
        if batch.num_rows:
            words, tokens, counts = numbered(raw_texts(batch.column(0)))
            ids = model.ids(hashed(words))
            codes = pair_codes(ids[previous(tokens, counts)], ids[tokens])
            found = np.unique(codes, return_counts=True)
            held = _added(*map(np.concatenate, zip(held, found))) if held else found
            if len(held[0]) >= PAIRS_AT_ONCE:
                yield _table(PAIRS, *held)
                held = None
    if held:
        yield _table(PAIRS, *held)


def _write_pairs(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write each bucket's pairs; hand on what they say about their words.

    Rows with id -1 carry how many pairs were counted once to four times.
    """
    bounds = np.array(model.starts)

    def stats(ids: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
        bucket = np.searchsorted(bounds, ids, side="right") - 1
        return _table(STATS, bucket, ids, *[v.astype(np.int32) for v in values])

    for bucket, (codes, n) in _by_bucket(batches):
        starts, codes = _runs(codes)
        counts = np.add.reduceat(n, starts)
        save(f"{model.folder}/pairs/{bucket}-hash.npy", codes)
        # Most buckets need a byte or two a count.
        small = np.min_scalar_type(int(counts.max()))
        save(f"{model.folder}/pairs/{bucket}-count.npy", counts.astype(small))
        first, second = pair_words(codes)
        # Of each word: how many different ones come before, and how many follow once,
        # twice and more often.
        words, place = np.unique(np.concatenate([second, first]), return_inverse=True)
        often = np.concatenate([np.zeros(len(second), np.int64), np.minimum(counts, 3)])
        yield stats(words, *[np.bincount(place[often == k], minlength=len(words)) for k in range(4)])
        yield stats(np.array([-1]), *[np.array([(counts == k).sum()]) for k in (1, 2, 3, 4)])


def _write_stats(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up and write the word statistics of each bucket, in the order of the words.

    A row per bucket tells how many words have one to four different words before
    them, and how many have any; the row with -1 entries does this for the pairs.
    """
    for bucket, (ids, *values) in _by_bucket(batches):
        starts, ids = _runs(ids)
        sums = [np.add.reduceat(v.astype(np.int64), starts) for v in values]
        if bucket < 0:
            yield _table(LEVEL, *sums, [-1], [0])
            continue
        full = np.zeros((4, model.starts[bucket + 1] - model.starts[bucket]), np.uint32)
        full[:, ids - model.starts[bucket]] = sums
        save(f"{model.folder}/words/{bucket}-stats.npy", full)
        before = sums[BEFORE]
        often = [[int((before == k).sum())] for k in (1, 2, 3, 4)]
        yield _table(LEVEL, *often, [int((before > 0).sum())], [int(before.sum())])


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the model over all texts of ``docs`` and store its arrays in the shared folder.

    Null and empty texts are one END. Without any text the model gives every token the
    same probability. A task holds one batch of text or one bucket; the buckets grow in
    number with the tokens and the session's shuffle partitions.
    """
    spark = docs.sparkSession
    texts = docs.select(text_col)
    folder = scratch_path(spark, "ngrams")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts, tokens = vocabulary(texts, folder)
    bits = max(2 * partitions, tokens // BUCKET, 2).bit_length()
    flat = Discounts.of(0, 0, 0, 0)
    model = Model(folder, starts, bits, tokens, max(0, starts[-1] - 1), 0, flat, flat, 1.0)
    if not tokens:
        return model
    pair_range = F.shiftright("hash", 64 - bits)
    level = (
        texts.mapInArrow(lambda b: _count_pairs(model, b), PAIRS)
        # Buckets are ranges of the hash, so its order is theirs, and they need no column yet.
        .repartition(partitions, pair_range)
        .sortWithinPartitions("hash")
        .select(pair_range.alias("bucket"), "hash", "n")
        .mapInArrow(lambda b: _write_pairs(model, b), STATS)
        .repartition(partitions, "bucket")
        .sortWithinPartitions("id")
        .mapInArrow(lambda b: _write_stats(model, b), LEVEL)
        .collect()  # a row per bucket
    )
    often = [sum(r[i] for r in level if r["entries"] >= 0) for i in range(4)]
    of_pairs = next(tuple(r)[:4] for r in level if r["entries"] < 0)
    entries = sum(r["entries"] for r in level if r["entries"] >= 0)
    types = sum(r["total"] for r in level)
    by_word = Discounts.of(*often)
    more = entries - often[0] - often[1]
    left = by_word.one * often[0] + by_word.two * often[1] + by_word.more * more
    return replace(
        model,
        pair_types=types,
        pair_discounts=Discounts.of(*of_pairs),
        word_discounts=by_word,
        even=left / types,
    )


def score_texts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of each text; scores are sums of log10."""
    words, tokens, counts = numbered(texts)
    ids = model.ids(hashed(words))
    count, stats = model.of_words(ids)
    v = model.vocabulary + 1
    base = np.log10((count + 0.5) / (model.train_tokens + 0.5 * v))
    types = max(1, model.pair_types)
    before = stats[BEFORE]
    word_p = (before - model.word_discounts.off(before)) / types + model.even / v
    # A word is followed as often as it occurs, and START once in every text.
    follows = np.where(np.arange(len(ids)) == 1, count[0], count)
    d = model.pair_discounts
    left = d.one * stats[ONCE] + d.two * stats[TWICE] + d.more * stats[MORE]
    back = np.where(follows > 0, left / np.maximum(follows, 1), 1.0)
    prev = previous(tokens, counts)
    p = back[prev] * word_p[tokens]
    both = np.flatnonzero((ids[prev] >= 0) & (ids[tokens] >= 0))
    if len(both):
        codes = pair_codes(ids[prev[both]], ids[tokens[both]])
        different, place = np.unique(codes, return_inverse=True)
        seen = model.of_pairs(different)[place]
        p[both] += (seen - d.off(seen)) / np.maximum(follows[prev[both]], 1)
    at = np.cumsum(counts) - counts
    known = np.add.reduceat((count > 0)[tokens].astype(np.int64), at)
    return counts, known, np.add.reduceat(base[tokens], at), np.add.reduceat(np.log10(p), at)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score, perplexity.

    ``score`` is the model's log10 probability of the whole text with its END, and
    ``perplexity`` 10^(-score / n_tokens); ``base_score`` is an add-half unigram's. Null
    and empty texts are END alone; unknown words share what the word level leaves. Rows
    are scored one by one; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, SCORED_BYTES):
            if batch.num_rows:
                columns = score_texts(model, raw_texts(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *map(pa.array, columns)],
                    [f.split()[0] for f in schema.split(", ")],
                )

    scored = docs.select(id_col, text_col).mapInArrow(run, schema)
    return scored.withColumnRenamed("id", id_col).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )

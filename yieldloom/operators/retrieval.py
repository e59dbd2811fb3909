"""Batch retrieval: a table of queries against a table of records."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom import schemas
from yieldloom.functions import text as X
from yieldloom.operators.joins import MAX_BROADCAST_ROWS, broadcast_if_small, joined_side
from yieldloom.operators.ranking import top_per_group
from yieldloom.sources.scratch import checkpoint, scratch_path
from yieldloom.sources.spread import spread

# Shape of the keyword score, exact hits per query, context format.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
EXACT_LIMIT = 2
MIN_KEY_CHARS = 2
AFTER_OWN_NAMES = (1 << 31) - 1
CONTEXT_SEPARATOR = "\n\n---\n\n"
EMPTY_CONTEXT = "관련 지식을 찾을 수 없습니다."

# Characters of the gram that a text must hold of a key, and of the head of a long key.
GRAM, HEAD_CHARS = 4, 64
PIECE_CHARS = 256
# Filter of the keys: at most 32 MB; its probes, and the hashes that it is filled with.
MAX_FILTER_BITS = 28
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
HASH_BASE, HEAD_SALT = 0x2545F4914F6CDD1D, np.uint64(0x165667B19E3779F9)
# Characters of text looked at together.
TEXT_CHARS = 1 << 18
MAX_BROADCAST_BYTES = 16 << 20
# Kinds of grams; each is four characters and a count.
MAX_BROADCAST_GRAMS = 200_000

# Query vectors are sent to the tasks, up to this many values at a time.
MAX_BROADCAST_VALUES = 4_000_000
# Records and queries of one matrix product.
ROWS_PER_BLOCK = 10_000
QUERIES_PER_BLOCK = 1_000

# Tokens counted together, and summands of scores added up together.
TOKENS_PER_BLOCK = 1 << 20
SUMMANDS_PER_BLOCK = 1 << 20

# Term buckets of a written keyword index.
INDEX_BUCKETS = 64

DISTANCE_ROWS = "query_id long, kind string, id long, distance double"
TERM_COUNTS = T.StructType(
    [
        T.StructField("dl", T.IntegerType()),
        T.StructField("counts", T.ArrayType(T.StructType().add("term", "string").add("tf", "long"))),
    ]
)


# --- exact terms --------------------------------------------------------------------------


def term_index(cards: DataFrame, absorbed: DataFrame | None = None) -> DataFrame:
    """Normalised term and aliases -> card, for keys of at least two characters.

    ``absorbed`` has further names in long form (id, alias), after a card's own, so
    that a card which very many names refer to stays many rows.
    """
    names = F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))
    listed = cards.select("id", F.posexplode(names).alias("pos", "name"))
    if absorbed is not None:
        listed = listed.unionByName(
            absorbed.select("id", F.lit(AFTER_OWN_NAMES).alias("pos"), F.col("alias").alias("name"))
        )
    return listed.select(X.canonical_term(F.col("name")).alias("key"), "id", "pos").filter(
        F.length("key") >= MIN_KEY_CHARS
    )


def _substrings(column: str, last: Column, step: int, size: int) -> Column:
    """Substrings of ``size`` characters from every ``step``-th position up to ``last``."""
    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(step))
    return F.transform(starts, lambda at: F.substr(F.col(column), at, F.lit(size)))


def _grams(rows: DataFrame, column: str, sizes: tuple[int, ...]) -> DataFrame:
    """A row with ``gram`` for each substring of these sizes; the other columns stay.

    Texts are cut into overlapping pieces first, so that taking a substring never walks a
    whole text.
    """
    others, most = [c for c in rows.columns if c != column], max(sizes)
    pieces = rows.select(
        *others,
        F.explode_outer(
            _substrings(column, F.length(column), PIECE_CHARS, PIECE_CHARS + most - 1)
        ).alias("piece"),
    )
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("piece"), F.lit(PIECE_CHARS))))
    longest = pieces.select(*others, "piece", F.explode(places).alias("at")).select(
        *others, F.substr("piece", "at", F.lit(most)).alias("gram")
    )
    if len(sizes) > 1:
        cut = [F.when(F.length("gram") >= n, F.substr(F.col("gram"), F.lit(1), F.lit(n))) for n in sizes]
        longest = longest.select(*others, F.explode(F.array(*cut)).alias("gram"))
    return longest.filter(F.length("gram") >= min(sizes))


def text_grams(queries: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(query_id, gram) for the substrings of each normalised text, repeats included."""
    texts = queries.select("query_id", X.canonical_term(F.col("text")).alias("q"))
    return _grams(texts, "q", sizes)


def anchored_keys(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """(key, gram): keys whose first ``GRAM`` characters some text holds, with these.

    The others are in no text. Shorter keys stay, with themselves as gram. Few kinds of grams
    are broadcast; many are joined by shuffle.
    """
    known = broadcast_if_small(checkpoint(text_grams(queries, (GRAM,)).select("gram").distinct()), MAX_BROADCAST_GRAMS)
    headed = keys.select("key", F.substr(F.col("key"), F.lit(1), F.lit(GRAM)).alias("gram"))
    whole = headed.filter(F.length("key") >= GRAM).join(known, "gram", "left_semi")
    return whole.select("key", "gram").unionByName(headed.filter(F.length("key") < GRAM))


class _Joined:
    """Texts put end to end, so that all their substrings of one length are hashed at once."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.end_of = np.repeat(self.ends, sizes)
        powers = np.full(len(points) + 1, HASH_BASE, np.uint64)
        back = np.full(len(points) + 1, pow(HASH_BASE, -1, 1 << 64), np.uint64)
        powers[0] = back[0] = 1
        self.back = np.cumprod(back)
        sums = np.cumsum((points + np.uint64(1)) * np.cumprod(powers)[:-1], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Polynomial hashes, modulo 2^64, of the substrings that start at these places."""
        return (self.sums[at + length] - self.sums[at]) * self.back[at]


def _probe(hashes: np.ndarray, times: int, bits: int) -> np.ndarray:
    """Places in a filter of 2^bits."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(times)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _key_filter(keys: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(filter, bits): bits for whole keys and for the heads of long ones, 2^28 at most.

    The tasks' places are put together as bitmaps, so what reaches the driver has the
    size of the filter. In a fuller filter more substrings pass, which the join sorts out.
    """
    bits = min(MAX_FILTER_BITS, max(15, (16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _Joined(batch.column(0).to_pylist())
            sizes = keys.ends - keys.starts
            whole = keys.hashes(keys.starts, sizes)
            heads = keys.hashes(keys.starts[sizes > HEAD_CHARS], HEAD_CHARS) ^ HEAD_SALT
            found = [_probe(np.concatenate([whole, heads]), times, bits) for times in PROBES]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["place"])

    # A bitmap has 2^15 bits.
    parts = (
        keys.select("key")
        .mapInArrow(places, "place long")
        .groupBy(F.shiftright("place", 15).alias("block"))
        .agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit((1 << 15) - 1))).alias("part"))
    )
    filled = np.zeros((1 << (bits - 15), 1 << 12), np.uint8)
    for row in parts.collect():
        filled[row.block] = np.frombuffer(row.part, np.uint8)
    return filled.reshape(-1), bits


def _substrings_in(filled: np.ndarray, bits: int, lengths: list[int], texts: _Joined) -> Iterator[tuple]:
    """(places, length) of the substrings that pass the filter."""

    def passing(at: np.ndarray, length: int, salt: np.uint64) -> np.ndarray:
        at = at[texts.end_of[at] >= at + length]
        hashes = texts.hashes(at, length) ^ salt
        for times in PROBES:
            place = _probe(hashes, times, bits)
            held = filled[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
            at, hashes = at[held], hashes[held]
        return at

    at, headed = np.arange(len(texts.end_of)), False
    for length in lengths:
        if length > HEAD_CHARS and not headed:
            at, headed = passing(at, HEAD_CHARS, HEAD_SALT), True
        yield passing(at, length, np.uint64(0)), length


def _held_substrings(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key): the substrings of the texts that are keys, and few that are not.

    A substring as long as some key is looked up in a filter of all keys in the task that
    has the text, so only what passes is moved. Lengths above ``HEAD_CHARS`` are
    looked up only where the first ``HEAD_CHARS`` characters pass.
    """
    texts = queries.select("query_id", X.canonical_term(F.col("text")).alias("q")).filter(F.length("q") > 0)
    longest = texts.agg(F.max(F.length("q"))).first()[0] or 0
    possible = checkpoint(anchored_keys(keys.filter(F.length("key") <= longest), queries).select("key"))
    # No more lengths than the longest text has characters.
    sizes = possible.groupBy(F.length("key").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    lengths = sorted(r.length for r in sizes)
    filled, bits = _key_filter(possible, sum(r.n for r in sizes))
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bounded(batch, TEXT_CHARS):
                joined = _Joined(part.column(1).to_pylist())
                found, rows = [], []
                for at, length in _substrings_in(shared.value, bits, lengths, joined):
                    found += [joined.text[i : i + length] for i in at.tolist()]
                    rows.append(np.searchsorted(joined.ends, at, "right"))
                if found:
                    owner = part.column(0).take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([owner, pa.array(found, pa.string())], ["query_id", "key"])

    kind = T.StructType([texts.schema["query_id"], T.StructField("key", T.StringType())])
    return texts.mapInArrow(search, kind).distinct()


def _bounded(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many characters of text, one row at least."""
    before = np.cumsum([0, *pc.utf8_length(batch.column(1)).to_pylist()]) // chars
    cuts = [0, *(np.nonzero(np.diff(before[:-1]))[0] + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def exact_term_match(index: DataFrame, queries: DataFrame, limit: int = EXACT_LIMIT) -> DataFrame:
    """Cards whose key occurs in the query text: longest key first, ``limit`` cards per query.

    Containment is an equi-join of whole keys: of a text only those substrings move that
    pass a filter of the keys, so the work grows with the texts and not with
    texts times keys. Of a key shared by many cards only the first ``limit`` can ever be
    returned, so each key keeps just those before the join.
    """
    # Written once: the index is needed for the keys and for their cards.
    placed = checkpoint(index.groupBy("key", "id").agg(F.min("pos").alias("pos")))
    first = checkpoint(placed.groupBy("key").agg(F.min(F.struct("id", "pos")).alias("first")))
    per_key = top_per_group(placed, ["key"], ["id"], limit, "_n").join(first, "key").select(
        "key", F.col("id").alias("card_id"), "first"
    )
    found = checkpoint(_held_substrings(first.select("key"), queries))
    order = F.struct((-F.length("key")).alias("length"), "first")
    cards = (
        found.join(per_key.hint("merge"), "key")
        .groupBy("query_id", "card_id")
        .agg(F.min(order).alias("place"))
    )
    ranked = top_per_group(cards, ["query_id"], ["place", "card_id"], limit, "rank")
    return ranked.select(
        "query_id", "card_id", "rank", (-F.col("place.length")).cast("long").alias("key_chars")
    )


# --- vectors ------------------------------------------------------------------------------


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1.0, norms)


def _nearest(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    kinds: np.ndarray,
    records: np.ndarray,
    k: int,
) -> pd.DataFrame:
    """The k nearest records of each kind for each query, ties by id."""
    parts = []
    for kind in np.unique(kinds):
        mask = kinds == kind
        own_ids = ids[mask]
        distance = np.abs(np.round(1.0 - queries @ records[mask].T, 6))
        keep = min(k, len(own_ids))
        bound = np.partition(distance, keep - 1, axis=1)[:, keep - 1 : keep]
        rows, cols = np.nonzero(distance <= bound)
        parts.append(
            pd.DataFrame(
                {
                    "query_id": query_ids[rows],
                    "kind": kind,
                    "id": own_ids[cols],
                    "distance": distance[rows, cols],
                }
            )
        )
    if not parts:
        return pd.DataFrame({"query_id": [], "kind": [], "id": [], "distance": []})
    near = pd.concat(parts).sort_values(["query_id", "kind", "distance", "id"])
    return near.groupby(["query_id", "kind"], sort=False).head(k)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) % len(column) or len(set(pc.list_value_length(column).to_pylist())) > 1:
        raise ValueError("record vectors differ in length")
    return _unit_rows(values.reshape(len(column), -1))


def _by_broadcast(records: DataFrame, query_rows: list, k: int, rows_per_block: int) -> DataFrame:
    """Local top-k rows of every task; what a task multiplies at once is bounded on both sides."""
    query_ids = np.array([r.query_id for r in query_rows], dtype=np.int64)
    matrix = _unit_rows(np.array([r.vec for r in query_rows], dtype=np.float64))
    shared = records.sparkSession.sparkContext.broadcast((query_ids, matrix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_matrix = shared.value
        best: pd.DataFrame | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(start, rows_per_block)
                ids, vectors = part.column("id").to_numpy(), _matrix(part.column("vec"))
                kinds = part.column("kind").to_numpy(zero_copy_only=False)
                near = [
                    _nearest(own_ids[q : q + QUERIES_PER_BLOCK], own_matrix[q : q + QUERIES_PER_BLOCK], ids, kinds, vectors, k)
                    for q in range(0, len(own_ids), QUERIES_PER_BLOCK)
                ]
                best = (
                    pd.concat([*near] if best is None else [best, *near])
                    .sort_values(["query_id", "kind", "distance", "id"])
                    .groupby(["query_id", "kind"], sort=False)
                    .head(k)
                )
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return records.select("id", "kind", "vec").mapInArrow(search, DISTANCE_ROWS)


def _by_rounds(
    records: DataFrame, queries: DataFrame, k: int, rounds: int, rows_per_block: int
) -> DataFrame:
    """One share of the queries after the other goes to all tasks; records are never moved.

    Each round reads the records once and writes its local top-k rows, so that only one
    share is held at a time.
    """
    share = F.pmod(F.xxhash64("query_id"), F.lit(rounds))
    placed = checkpoint(queries.select("query_id", "vec", share.alias("share")))
    found = []
    for number in range(rounds):
        rows = placed.filter(F.col("share") == number).drop("share").collect()
        if rows:
            found.append(checkpoint(_by_broadcast(records, rows, k, rows_per_block)))
    return reduce(DataFrame.unionByName, found)


def vector_topk(
    records: DataFrame,
    queries: DataFrame,
    k: int,
    max_broadcast_values: int = MAX_BROADCAST_VALUES,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Exact nearest records by cosine distance, per query and collection.

    The records are never moved: queries go to every task, a large table of them in
    shares of ``max_broadcast_values`` one after the other. Only local top-k rows are
    shuffled. Records and queries without a vector have no neighbours
    (``without_vector`` counts them); vectors of different length are an error.
    """
    records, queries = records.filter("vec IS NOT NULL"), queries.filter("vec IS NOT NULL")
    size = queries.select(
        F.max(F.size("vec")).alias("dim"),
        F.min(F.size("vec")).alias("least"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if size.n and size.dim != size.least:
        raise ValueError(f"query vectors differ in length: {size.least} to {size.dim}")
    if not size.n:
        near = records.sparkSession.createDataFrame([], DISTANCE_ROWS)
    elif size.n * size.dim <= max_broadcast_values:
        near = _by_broadcast(
            records, queries.select("query_id", "vec").collect(), k, rows_per_block
        )
    else:
        rounds = math.ceil(size.n / max(1, max_broadcast_values // size.dim))
        near = _by_rounds(records, queries, k, rounds, rows_per_block)
    return top_per_group(near, ["query_id", "kind"], ["distance", "id"], k, "kind_rank")


def without_vector(rows: DataFrame) -> DataFrame:
    """How many rows a vector search leaves out for want of a vector."""
    return rows.agg(F.count_if(F.col("vec").isNull()).alias("without_vector"))


def vector_ranking(topk: DataFrame) -> DataFrame:
    """Both collections of a query in one list by distance; at most 2k rows per query."""
    place = Window.partitionBy("query_id").orderBy("distance", "id")
    return topk.withColumn("rank", F.row_number().over(place).cast("long")).select(
        "query_id", "id", "rank", "distance", "kind"
    )


def merge_by_distance(exact: DataFrame, topk: DataFrame, n: int) -> DataFrame:
    """Exact hits first at distance 0, then the n nearest records that are not exact hits."""
    hits = exact.select(
        "query_id",
        F.col("card_id").alias("id"),
        F.lit("glossary_exact").alias("kind"),
        F.lit(0.0).alias("distance"),
        F.lit(0).alias("level"),
        F.col("rank").alias("place"),
    )
    others = top_per_group(
        topk.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti"),
        ["query_id"],
        ["distance", "id"],
        n,
        "place",
    ).select("query_id", "id", "kind", "distance", F.lit(1).alias("level"), "place")
    # Both inputs are limited per query, so the list needs no cut of its own.
    place = Window.partitionBy("query_id").orderBy("level", "place")
    return (
        hits.unionByName(others)
        .withColumn("position", F.row_number().over(place).cast("long"))
        .select("query_id", "position", "id", "kind", "distance")
    )


def format_context(queries: DataFrame, results: DataFrame, texts: DataFrame) -> DataFrame:
    """Ranked results of a query as one context text; a fixed sentence when there are none."""
    link = F.when(
        F.coalesce("source_url", F.lit("")) != "",
        F.concat(F.lit(" (출처: "), "source_url", F.lit(")")),
    ).otherwise(F.lit(""))
    block = F.concat(F.lit("["), "title", F.lit("]"), link, F.lit("\n"), "content")
    # A query has at most n + 2 results.
    joined = (
        results.join(texts, "id")
        .withColumn("block", block)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "block"))).alias("blocks"))
    )
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id",
        F.coalesce(F.size("blocks"), F.lit(0)).alias("n_docs"),
        F.coalesce(
            F.array_join(F.transform("blocks", lambda b: b["block"]), CONTEXT_SEPARATOR),
            F.lit(EMPTY_CONTEXT),
        ).alias("context"),
    )


# --- keywords -----------------------------------------------------------------------------


# Rows are expanded with the outer variants below: the inner ones let Spark derive a filter on
# the expanded array, which would tokenise every text again at the scan.


def tokenize(records: DataFrame) -> DataFrame:
    return records.select("id", X.tokens(F.col("text")).alias("tokens"))


def _counted(ids: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
    """Length and distinct terms of each row, for all rows at once."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    words = tokens.flatten().dictionary_encode()
    kinds = max(len(words.dictionary), 1)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    keys, tf = np.unique(rows * kinds + words.indices.to_numpy(), return_counts=True)
    ends = np.searchsorted(keys, np.arange(len(lengths) + 1, dtype=np.int64) * kinds)
    terms = words.dictionary.take(pa.array(keys % kinds))
    counts = pa.StructArray.from_arrays([terms, pa.array(tf, pa.int64())], ["term", "tf"])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counts)
    return pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int32()), lists], ["id", "dl", "counts"])


def term_counts(records: DataFrame) -> DataFrame:
    """Length in tokens and distinct terms of every record, a row each: (id, dl, counts of (term, tf)).

    A record is one row, so its tokens are counted in its task, and no text or token is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
            start = 0
            while start < batch.num_rows:
                done = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, done + TOKENS_PER_BLOCK, "right")))
                part = batch.slice(start, stop - start)
                yield _counted(part.column("id"), part.column("tokens"))
                start = stop

    schema = T.StructType([records.schema["id"], *TERM_COUNTS.fields])
    return tokenize(records).mapInArrow(count, schema)


def _postings(counted: DataFrame) -> DataFrame:
    return (
        counted.select("id", "dl", F.inline_outer("counts"))
        .filter(F.col("term").isNotNull())
        .select("term", "id", "tf", "dl")
    )


def bm25_postings(records: DataFrame) -> DataFrame:
    """Postings (term, id, tf, dl) of all records, counted inside each record."""
    return _postings(term_counts(records))


def term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def write_index(postings: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Postings by term bucket. Each task writes its own file of a bucket, so nothing is moved and
    the bucket of a frequent term is as many files as any other."""
    rows = postings.withColumn("bucket", term_bucket(buckets))
    rows.write.partitionBy("bucket").mode("errorifexists").parquet(path)


def read_postings(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    schema = f"term string, id {id_type}, tf bigint, dl int, bucket int"
    return spark.read.schema(schema).parquet(path)


def idf_table(frequencies: DataFrame, n_records: int) -> DataFrame:
    """Inverse document frequency per term; a negative one becomes a share of the mean."""
    raw = frequencies.withColumn(
        "raw_idf", F.log(F.lit(n_records) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    floor = raw.agg((F.avg("raw_idf") * BM25_EPSILON).alias("floor")).scalar()
    return raw.withColumn(
        "idf", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf"))
    ).drop("raw_idf")


def term_frequencies(postings: DataFrame) -> DataFrame:
    """How many records hold a term, and how often it occurs."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")
    )


def bm25_index(records: DataFrame) -> DataFrame:
    """Vocabulary of the index: document frequency, total frequency, idf."""
    return idf_table(checkpoint(term_frequencies(bm25_postings(records))), records.count())


def build_index(records: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Write a keyword index: postings by term bucket, frequencies per term, totals.

    Texts are read and cut into tokens once; the rest comes from the postings.
    """
    spark = records.sparkSession
    write_index(bm25_postings(records), f"{path}/postings", buckets)
    postings = read_postings(spark, f"{path}/postings", dict(records.dtypes)["id"])
    term_frequencies(postings).write.parquet(f"{path}/terms")
    totals = spark.read.parquet(f"{path}/terms").agg(
        F.coalesce(F.sum("total_tf"), F.lit(0)).alias("tokens")
    )
    totals.select(
        "tokens", F.lit(records.count()).alias("records"), F.lit(buckets).alias("buckets")
    ).write.parquet(f"{path}/totals")


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, n: int, id_type: str = "bigint"
) -> DataFrame:
    """Best records per query; only the postings in the buckets of the query terms are read."""
    totals = spark.read.parquet(f"{path}/totals").first()
    # At most one number per bucket of the index.
    present = [
        r[0]
        for r in _query_terms(queries).select(term_bucket(totals.buckets)).distinct().collect()
    ]
    postings = read_postings(spark, f"{path}/postings", id_type).filter(
        F.col("bucket").isin(present)
    )
    terms = spark.read.parquet(f"{path}/terms")
    return _best(postings, terms, totals.records, totals.tokens, queries, n, scattered=True)


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): repeated terms of a query count each time."""
    return (
        queries.select("query_id", F.explode_outer(X.tokens(F.col("text"))).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def _best(
    postings: DataFrame,
    terms: DataFrame,
    n_records: int,
    n_tokens: int,
    queries: DataFrame,
    n: int,
    scattered: bool = False,
) -> DataFrame:
    """Best records per query by keyword score; only positive scores are returned.

    Only postings of query terms move. Query terms are counted first and broadcast
    only when they are few. ``scattered`` postings of a record don't lie together, so
    they are moved once, before they meet the queries, rather than once for each query.
    """
    query_terms = _query_terms(queries)
    n_terms = query_terms.limit(MAX_BROADCAST_ROWS + 1).count()
    weights = _weights(query_terms, n_terms, idf_table(terms, n_records))
    gains = _gains(postings, _mean_length(n_records, n_tokens))
    if scattered and n_terms <= MAX_BROADCAST_ROWS:
        known = F.broadcast(query_terms.select("term").distinct())
        gains = gains.join(known, "term", "left_semi").repartition("id")
    return _first_per_query(_scores(gains, joined_side(weights, n_terms)), n)


def _weights(query_terms: DataFrame, n_terms: int, idfs: DataFrame) -> DataFrame:
    """What a term counts in a query; terms that no record holds are left out."""
    return (
        joined_side(query_terms, n_terms)
        .join(idfs, "term")
        .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    )


def _mean_length(n_records: int, n_tokens: int | None) -> float:
    return (n_tokens or 1) / max(n_records, 1)


def _gains(postings: DataFrame, mean_length: float) -> DataFrame:
    length = F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("dl") / F.lit(mean_length)
    gain = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + F.lit(BM25_K1) * length)
    return postings.select("id", "term", gain.alias("gain"))


def _scores(gains: DataFrame, weights: DataFrame) -> DataFrame:
    """Positive scores (query_id, id, score), added up over all postings of an id."""
    return (
        gains.join(weights, "term")
        .groupBy("id", "query_id")
        .agg(F.round(F.sum(F.col("weight") * F.col("gain")), 6).alias("score"))
        .filter(F.col("score") > 0)
        .select("query_id", "id", "score")
    )


def _first_per_query(scores: DataFrame, n: int) -> DataFrame:
    return top_per_group(scores, ["query_id"], [F.desc("score"), "id"], n, "rank").select(
        "query_id", "id", "score", "rank"
    )


def _first_rows(found: list[pa.Table], n: int) -> pa.Table:
    """The first n rows of each query number (column q), by score and then id."""
    order = [("q", "ascending"), ("score", "descending"), ("id", "ascending")]
    rows = pa.concat_tables(found)
    rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
    q = rows.column("q").to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < n))


def _best_in_place(counted: DataFrame, weights: DataFrame, mean_length: float, n: int) -> DataFrame:
    """Best n records per query of every task; no score of another record leaves it.

    Each row of ``counted`` is taken as a whole record. ``weights`` go to the tasks.
    """
    rows = weights.toArrow()
    queries, terms = (
        rows.column(c).combine_chunks().dictionary_encode("encode") for c in ("query_id", "term")
    )
    order = np.argsort(terms.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
    owners, values = queries.indices.to_numpy()[order].astype(np.int64), rows.column("weight").to_numpy()[order]
    shared = counted.sparkSession.sparkContext.broadcast(
        (queries.dictionary, terms.dictionary, starts, owners, values)
    )
    # A record has at most as many summands as there are weights.
    rows_per_block = max(1, SUMMANDS_PER_BLOCK // max(rows.num_rows, 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known, first, owner, weight = shared.value
        floor, best, found, waiting = np.zeros(len(asked)), 0, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(start, rows_per_block)
                row, q, score = _block_scores(part, known, first, owner, weight, len(asked), mean_length, floor)
                if not len(row):
                    continue
                ids = part.column("id").take(pa.array(row))
                found.append(pa.table({"q": q, "id": ids, "score": score}))
                waiting += len(row)
                if waiting > max(best, ROWS_PER_BLOCK):
                    kept = _first_rows(found, n)
                    q = kept.column("q").to_numpy()
                    full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == n - 1)
                    floor[q[full]] = kept.column("score").to_numpy()[full]
                    found, best, waiting = [kept], len(kept), 0
        if found:
            kept = _first_rows(found, n)
            out = pa.table({"query_id": asked.take(kept.column("q").combine_chunks()), "id": kept.column("id"), "score": kept.column("score")})
            yield from out.to_batches(max_chunksize=ROWS_PER_BLOCK)

    schema = T.StructType([weights.schema["query_id"], counted.schema["id"]]).add("score", "double")
    return counted.mapInArrow(search, schema)


def _block_scores(
    part: pa.RecordBatch,
    known: pa.Array,
    first: np.ndarray,
    owner: np.ndarray,
    weight: np.ndarray,
    n_queries: int,
    mean_length: float,
    floor: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, query number and score of every positive score that isn't below the query's floor."""
    counts = part.column("counts")
    terms, tf = counts.flatten().flatten()
    row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(counts), 0).to_numpy())
    term = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()
    held = np.flatnonzero(term >= 0)
    row, term, tf = row[held], term[held], tf.to_numpy()[held]
    length = (1 - BM25_B) + BM25_B * part.column("dl").to_numpy()[row] / mean_length
    gain = tf * (BM25_K1 + 1) / (tf + BM25_K1 * length)
    # Each posting meets all queries that have its term.
    n = first[term + 1] - first[term]
    each = np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
    scores = np.bincount(
        np.repeat(row, n) * n_queries + owner[each],
        weight[each] * np.repeat(gain, n),
        part.num_rows * n_queries,
    ).reshape(part.num_rows, n_queries)
    scores = np.floor(scores * 1e6 + 0.5) / 1e6
    row, q = np.nonzero((scores > 0) & (scores >= floor))
    return row, q, scores[row, q]


def bm25_topk(records: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """One search without an index: term counts are written by record and read back.

    While the query terms can be sent to the tasks, a record is scored where it lies and only
    local top-n rows move; rows that share an id are added up by id. For more searches over
    the same records, ``build_index`` and ``search_index``.
    """
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "postings")
    counted = term_counts(records)
    counted.write.parquet(path)
    counted = spark.read.schema(counted.schema).parquet(path)
    # Written out: its rows, its mean and its total are all needed.
    terms = checkpoint(term_frequencies(_postings(counted)))
    n_tokens, n_records = terms.agg(F.sum("total_tf")).first()[0], records.count()
    query_terms = _query_terms(queries)
    n_terms = query_terms.limit(MAX_BROADCAST_ROWS + 1).count()
    rows_of_id = counted.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = checkpoint(rows_of_id.filter(F.col("_rows") > 1).select("_id"))
    n_repeated = repeated.count()
    if max(n_terms, n_repeated) > MAX_BROADCAST_ROWS:
        return _best(_postings(counted), terms, n_records, n_tokens, queries, n)
    weights = checkpoint(_weights(query_terms, n_terms, idf_table(terms, n_records)))
    mean_length = _mean_length(n_records, n_tokens)
    if not n_repeated:
        return _first_per_query(_best_in_place(counted, weights, mean_length, n), n)
    same = F.col("id").eqNullSafe(F.col("_id"))
    single = counted.join(F.broadcast(repeated), same, "left_anti")
    shared = _postings(counted.join(F.broadcast(repeated), same, "left_semi"))
    added_up = _scores(_gains(shared, mean_length), F.broadcast(weights))
    return _first_per_query(_best_in_place(single, weights, mean_length, n).unionByName(added_up), n)


# --- fusion and scoring -------------------------------------------------------------------


def rrf_fuse(rank_lists: DataFrame, k: int = schemas.RRF_K) -> DataFrame:
    """Rows (query_id, list, id, rank) -> fused rank; ties by vector rank, then id.

    Lists are top-n lists, so a query has no more rows than its lists together.
    """
    fused = rank_lists.groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 12).alias("score"),
        F.min(F.when(F.col("list") == "vector", F.col("rank"))).alias("vector_rank"),
    )
    place = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.col("vector_rank").asc_nulls_last(), "id"
    )
    return fused.withColumn("rank", F.row_number().over(place).cast("long")).select(
        "query_id", "id", "score", "rank"
    )


def as_rank_list(ranking: DataFrame, name: str) -> DataFrame:
    return ranking.select("query_id", F.lit(name).alias("list"), "id", "rank")


def retrieval_rank(expected: DataFrame, ranking: DataFrame, name: str) -> DataFrame:
    """Position of the relevant id in the query's list, null when it is not there."""
    place = ranking.select("query_id", F.col("id").alias("source_id"), F.col("rank").alias(name))
    return expected.join(place, ["query_id", "source_id"], "left")


def retrieval_metrics(ranked: DataFrame, rank: str, groups: list[str]) -> DataFrame:
    """Accuracy at 1, 3 and 5 and NDCG at 10, overall and per group column, in one pass."""
    place = F.col(rank)

    def within(k: int) -> Column:
        return F.round(F.avg(F.when(place <= k, 1.0).otherwise(0.0)), 4)

    gain = F.when(place <= 10, F.lit(1.0) / F.log2(place + 1)).otherwise(0.0)
    dimension, value = F.lit("overall"), F.lit("")
    for column in groups:
        inside = F.grouping(column) == 0
        dimension = F.when(inside, F.lit(column)).otherwise(dimension)
        value = F.when(inside, F.col(column)).otherwise(value)
    return (
        ranked.groupingSets([[], *[[F.col(c)] for c in groups]], *groups)
        .agg(
            F.count(F.lit(1)).alias("n"),
            within(1).alias("accuracy_1"),
            within(3).alias("accuracy_3"),
            within(5).alias("accuracy_5"),
            F.round(F.avg(gain), 4).alias("ndcg_10"),
            dimension.alias("dimension"),
            value.alias("value"),
        )
        .drop(*groups)
    )


def doc_cited(cases: DataFrame) -> DataFrame:
    """Whether the last part of ``related_doc`` occurs in one of the retrieved titles."""
    section = X.strip(F.substring_index("related_doc", "> ", -1))
    return cases.withColumn(
        "cited", F.exists(F.coalesce("titles", F.array().cast("array<string>")), lambda t: t.contains(section))
    )

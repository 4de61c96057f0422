"""Cross-entropy difference: how much better a target model predicts a text than a background model, for each token.

Both are bigram models of one form (Dirichlet smoothing with the model's own words) over one vocabulary, the words of both tables, counted
from all rows of a target table and of a background table. Nothing is cut: the counts of every word and every pair stay in
a distributed table, cut into buckets by hash. Texts are scored a chunk at a time. A chunk asks each bucket for its distinct
words and pairs, as one sorted list, and receives their counts in the same order; so what is shuffled are
compact lists, pre-aggregated in their chunk, and no word or pair is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, committed, give_back, mix64, release_shuffles, take_over

#: Counts that a context lends to the words alone, and what every word of the vocabulary has besides its count.
LENT, ADDED = 8.0, 0.5
#: Tokens of a chunk (the last text may go beyond), and characters of both tables for each bucket, of which there are at most MOST_BUCKETS.
CHUNK_TOKENS, BUCKET_CHARS, MOST_BUCKETS = 1 << 20, 8 << 20, 1 << 16
#: The hash of what stands before and after a text: of no word, for no word is empty.
EDGE = xxhash.xxh3_64_intdigest(b"")
BACKGROUND, TARGET, ASKED = 0, 1, 2
PLANS = "kind int, chunk long, hashes binary, tokens binary, ids array<long>, lengths array<int>"
PLAN_TYPES = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
REQUESTS = "bucket int, chunk long, kind int, keys binary, counts binary"
REQUEST_TYPES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = "chunk long, bucket int, words long, b binary, t binary"
ANSWER_TYPES = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.int64()), ("b", pa.binary()), ("t", pa.binary())])


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with ASCII letters in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def packed(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; small ones leave empty planes."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpacked(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


class Chunk:
    """Tokens of some texts as places in a list of distinct words; every text ends with the edge, which is place 0."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray):
        self.hashes, self.tokens = hashes, tokens
        before = np.concatenate([np.zeros(1, np.int64), tokens[:-1]])
        pairs, self.pair_of, self.pair_counts = np.unique(before << 32 | tokens, return_inverse=True, return_counts=True)
        self.first, self.second = pairs >> 32, pairs & 0xFFFFFFFF
        # Keys of words are odd, keys of pairs are even.
        mixed = mix64(hashes)
        word_keys, pair_keys = mixed | np.uint64(1), mix64(mixed[self.first] * np.uint64(0x9E3779B97F4A7C15) + mixed[self.second]) & ~np.uint64(1)
        keys = np.concatenate([word_keys, pair_keys])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self) -> np.ndarray:
        return np.concatenate([np.bincount(self.tokens, minlength=len(self.hashes)), self.pair_counts]).astype(np.uint32)[self.order]

    def token_losses(self, counts: np.ndarray, total: int, words: int) -> np.ndarray:
        """The loss of each token in nats, by counts of all keys in their order."""
        own = np.empty(len(counts))
        own[self.order] = counts
        word, pair = own[: len(self.hashes)], own[len(self.hashes) :]
        alone = (word + ADDED) / (total + ADDED * (words + 1))  # one more for all words of neither table
        return -np.log((pair + LENT * alone[self.second]) / (word[self.first] + LENT))[self.pair_of]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _row(types: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types.types)], schema=types)


def _chunks(df: DataFrame, id_col: str | None, text_col: str, kind: int) -> DataFrame:
    """Rows of PLANS: each chunk's distinct words' hashes, its tokens as places among them, and its texts' ids and numbers of tokens."""

    def run(batches):
        take_over("lm-chunks")
        part, n, held, index, hashes, tokens, ids, lengths = TaskContext.get().partitionId(), 0, 0, {}, [EDGE], [], [], []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = []
                for w in words_of(text.as_py()):
                    i = index.get(w)
                    if i is None:
                        i = index[w] = len(hashes)
                        hashes.append(xxhash.xxh3_64_intdigest(w))
                    found.append(i)
                found.append(0)
                tokens.append(np.array(found, np.uint32))
                ids.append(key)
                lengths.append(len(found))
                held += len(found)
                if held >= CHUNK_TOKENS:
                    yield _row(PLAN_TYPES, kind, (part << 32) + n, packed(np.array(hashes, np.uint64)), packed(np.concatenate(tokens)), ids, lengths)
                    n, held, index, hashes, tokens, ids, lengths = n + 1, 0, {}, [EDGE], [], [], []
        if held:
            yield _row(PLAN_TYPES, kind, (part << 32) + n, packed(np.array(hashes, np.uint64)), packed(np.concatenate(tokens)), ids, lengths)

    own = F.lit(None).cast("long") if id_col is None else F.col(id_col).cast("long")
    return df.select(own.alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PLANS)


def _planned(hashes: bytes, tokens: bytes) -> Chunk:
    return Chunk(unpacked(hashes, np.uint64), unpacked(tokens, np.uint32).astype(np.int64))


def _requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """Rows of REQUESTS: for each chunk and bucket its sorted keys and their counts there."""

    def run(batches):
        take_over("lm-requests")
        for batch in batches:
            for kind, chunk, hashes, tokens in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = _planned(hashes, tokens)
                counts, cuts = own.counts(), np.searchsorted(bucket_of(own.keys, buckets), np.arange(buckets + 1))
                rows = [(b, chunk, kind, packed_keys(own.keys[i:j]), packed(counts[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                del own, counts
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256]), REQUEST_TYPES.types)], schema=REQUEST_TYPES)
                del rows
                give_back()

    return chunks.select("kind", "chunk", "hashes", "tokens").mapInArrow(run, REQUESTS)


def _by_bucket(rows: DataFrame, handle, schema: str) -> DataFrame:
    """handle(bucket, list of that bucket's rows as tuples) -> record batches, for each bucket."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        take_over("lm-buckets")
        bucket, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[0] != bucket:
                    if held:
                        yield from handle(bucket, held)
                        give_back()
                    bucket, held = row[0], []
                held.append(row[1:])
        if held:
            yield from handle(bucket, held)

    return rows.repartition(n, rows.columns[0]).sortWithinPartitions(*rows.columns[:2]).mapInArrow(run, schema)


def _summed(rows: list[tuple]):
    """(distinct keys, where each row's keys are among them, background's counts, target's) of a bucket's requests."""
    parts = [(unpacked_keys(keys), unpacked(counts, np.uint32)) for _, _, keys, counts in rows]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sizes = [len(k) for k, _ in parts]
    counts, target = np.concatenate([c for _, c in parts]), np.repeat([kind == TARGET for _, kind, _, _ in rows], sizes)
    sums = [np.bincount(at[own], counts[own], len(keys)).astype(np.uint64) for own in (~target, target)]
    return keys, np.split(at, np.cumsum(sizes)[:-1]), *sums


def _table(requests: DataFrame) -> DataFrame:
    """(bucket, words, keys, b, t): the counts of every word and pair of a bucket, summed over chunks."""
    types = pa.schema([("bucket", pa.int32()), ("words", pa.int64()), ("keys", pa.binary()), ("b", pa.binary()), ("t", pa.binary())])

    def handle(bucket, rows):
        keys, _, b, t = _summed(rows)
        yield _row(types, bucket, int((keys & np.uint64(1)).sum()), packed_keys(keys), packed(b), packed(t))

    return _by_bucket(requests, handle, "bucket int, words long, keys binary, b binary, t binary")


def _own_answers(requests: DataFrame) -> DataFrame:
    """Rows of ANSWERS for the background's chunks from the requests that the counts are made of, and for each bucket a row of
    chunk -1 with its number of words."""

    def handle(bucket, rows):
        keys, places, b, t = _summed(rows)
        yield _row(ANSWER_TYPES, -1, bucket, int((keys & np.uint64(1)).sum()), None, None)
        for (chunk, kind, _, _), at in zip(rows, places):
            if kind == BACKGROUND:
                yield _row(ANSWER_TYPES, chunk, bucket, 0, packed(b[at]), packed(t[at]))

    return _by_bucket(requests, handle, ANSWERS)


def _other_answers(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ANSWERS for the chunks of another table; what the counts don't have is 0."""

    def handle(bucket, rows):
        keys, b, t = (np.zeros(0, np.uint64) for _ in range(3))
        for chunk, kind, asked, more_b, more_t in rows:
            if chunk == -1:  # the bucket's own row comes first
                keys, b, t = unpacked_keys(asked), unpacked(more_b, np.uint64), unpacked(more_t, np.uint64)
                continue
            own = unpacked_keys(asked)
            at = np.searchsorted(keys, own)
            held = np.append(keys, own[-1])[at] == own if len(keys) else np.zeros(len(own), bool)
            held &= at < len(keys)
            yield _row(ANSWER_TYPES, chunk, bucket, 0, *[packed(np.where(held, np.append(x, np.uint64(0))[at], np.uint64(0))) for x in (b, t)])

    none = F.lit(None).cast("binary")
    asked = requests.select("bucket", "chunk", "kind", "keys", none.alias("b"), none.alias("t"))
    return _by_bucket(table.select("bucket", F.lit(-1).cast("long").alias("chunk"), F.lit(ASKED).alias("kind"), "keys", "b", "t").union(asked), handle, ANSWERS)


@dataclass
class Models:
    """The chunks of both tables, with their numbers of tokens and what the background was read from. The counts become a table when
    another table than the background is scored."""

    chunks: DataFrame
    target: DataFrame
    buckets: int
    background_tokens: int
    target_tokens: int
    source: tuple
    held: tuple[DataFrame, int] | None = None

    def requests(self) -> DataFrame:
        return _requests(self.chunks.union(self.target), self.buckets)

    def counts(self) -> tuple[DataFrame, int]:
        """(table of counts, words of the vocabulary)."""
        if self.held is None:
            table = committed(_table(self.requests()), "lm-counts")
            self.held = table, table.agg(F.sum("words")).first()[0] or 0
        return self.held


def fit(background: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", id_col: str = "doc_id") -> Models:
    """Both models, from all words and pairs of all rows of both tables. Null texts count as empty ones; a table without
    rows gives a uniform model. Scoring the background itself does not read it again."""
    spark = background.sparkSession
    bounded_batches(spark)
    size = sum(df.agg(F.sum(F.length(F.col(c).cast("string")))).first()[0] or 0 for df, c in ((background, text_col), (target, target_col)))
    known = id_col if id_col in background.columns else None
    own, other = committed(_chunks(background, known, text_col, BACKGROUND), "lm-chunks"), committed(_chunks(target, None, target_col, TARGET), "lm-target")
    tokens = [df.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0 for df in (own, other)]
    return Models(own, other, min(max(math.ceil(size / BUCKET_CHARS), 1), MOST_BUCKETS), *tokens, (background, known, text_col))


def score(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (words and the end), target_loss, background_loss (nats for each token) and score (their difference;
    lower is more like the target) of every row. A null or wordless text is the end alone; extra columns are ignored;
    repeated rows repeat."""
    spark = df.sparkSession
    bounded_batches(spark)
    if models.source[0] is df and models.source[1:] == (id_col, text_col):
        chunks, answers = models.chunks, committed(_own_answers(models.requests()), "lm-answers")
        words = answers.agg(F.sum("words")).first()[0] or 0
    else:
        chunks, (table, words) = committed(_chunks(df, id_col, text_col, ASKED), "lm-chunks"), models.counts()
        answers = committed(_other_answers(_requests(chunks, models.buckets), table), "lm-answers")
    release_shuffles(spark)
    totals = models.target_tokens, models.background_tokens
    types = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])

    def finish(_, rows):
        _, hashes, tokens, ids, lengths = rows[0]  # the plan has bucket -1
        own = _planned(hashes, tokens)
        counts = [np.concatenate([unpacked(r[k], np.uint64) for r in rows[1:]]).astype(np.float64) for k in (2, 1)]
        n = np.array(lengths, np.int64)
        starts = np.cumsum(n) - n
        target, background = (np.add.reduceat(own.token_losses(c, total, words), starts) / n for c, total in zip(counts, totals))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(target), pa.array(background), pa.array(target - background)], schema=types)

    lists = [F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("lengths")]
    plans = chunks.select("chunk", F.lit(-1).alias("bucket"), "hashes", "tokens", "ids", "lengths")
    together = plans.union(answers.filter("chunk >= 0").select("chunk", "bucket", "b", "t", *lists))
    return _by_bucket(together, finish, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")

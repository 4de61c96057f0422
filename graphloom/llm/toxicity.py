"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself; a text is the mean of its words; a linear
softmax reads that mean. Misspellings and inflections share n-grams with words seen in training, so they share
their vectors. Vectors start at zero, every n-gram learns, and a penalty shortens vectors: what chance moves adds nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import TwoGenerations, bounded_batches, give_back, mix64, take_over
from .langid import in_training

#: Buckets and width of the embedding table, lengths of n-grams in bytes.
BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 18, 16, 3, 6
#: The most labelled rows that training reads (in expectation; chosen by a hash of doc_id), and its steps.
TRAIN_ROWS, STEPS, SEED = 8000, 120, 7
#: The first step's length, and what is taken off a vector's length by a step of rate 1.
RATE, SHRINK = 2.0, 3.0
#: Log odds of a text without any evidence, before labels speak.
NO_EVIDENCE = -0.5
#: Words remembered by a Python worker, half of them recent.
MEMO = 200_000
#: Words of the training sample whose n-grams are listed at once (under 2^16: places are kept in 16 bits).
PART = 25_000
EDGES = "\t\n !\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”„’‘–—…¿¡"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return (text or "").lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, bucket) of every n-gram of every word, and of each word as a whole."""
    raw = [b"<" + (w.strip(EDGES) or w).encode("utf-8", "surrogatepass") + b">" for w in words]
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(raw)), lengths)
    whose, code = [np.arange(len(raw))], []
    base = np.uint64(0x100000001B3)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # The whole word: a sum of mixed (byte, place) pairs, apart from all n-grams.
    code.append(mix64(np.add.reduceat(mix64(flat * np.uint64(1 << 20) + place.astype(np.uint64)), np.cumsum(lengths) - lengths)))
    rolling = flat.copy()
    for n in range(2, LONGEST + 1):
        if len(flat) < n:
            break
        rolling = rolling[:-1] * base + flat[n - 1 :]
        if n >= SHORTEST:
            inside = owner[: len(flat) - n + 1] == owner[n - 1 :]
            whose.append(owner[: len(inside)][inside])
            code.append(mix64(rolling[inside] + np.uint64(n << 56)))
    return np.concatenate(whose), (np.concatenate(code) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """What scoring needs: each bucket's part of the softmax's log odds, and the constant part."""

    bucket_odds: np.ndarray
    constant: float

    def word_odds(self, words: list[str]) -> list[float]:
        whose, bucket = subwords(words)
        total = np.bincount(whose, self.bucket_odds[bucket], len(words))
        return (total / np.maximum(np.bincount(whose, minlength=len(words)), 1)).tolist()


class Sample:
    """Labelled texts as counts of distinct words; the texts themselves are not held."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.labels: list[int] = []
        self.kinds: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, text: str | None, label: int) -> None:
        own = np.fromiter((self.index.setdefault(w, len(self.index)) for w in words_of(text)), np.int32)
        kinds, counts = np.unique(own, return_counts=True)
        self.labels.append(label)
        self.kinds.append(kinds)
        self.counts.append(counts.astype(np.int32))


class _Means:
    """Word means of bucket values and text means of word means, and both transposed. The pairs of words and buckets are
    kept in parts of PART words, so that no pass holds more than a part's values."""

    def __init__(self, sample: Sample):
        self.texts, self.words = len(sample.labels), len(sample.index)
        self.text = np.repeat(np.arange(self.texts), [len(k) for k in sample.kinds])
        self.kind = np.concatenate(sample.kinds) if self.texts else np.zeros(0, np.int32)
        counts = np.concatenate(sample.counts).astype(np.float64) if self.texts else np.zeros(0)
        self.share = counts / np.maximum(np.bincount(self.text, counts, self.texts), 1)[self.text]
        vocabulary, self.parts = list(sample.index), []
        for lo in range(0, self.words, PART):
            whose, bucket = subwords(vocabulary[lo : lo + PART])
            n = len(vocabulary[lo : lo + PART])
            self.parts.append((lo, n, whose.astype(np.uint16), bucket.astype(np.int32), 1.0 / np.maximum(np.bincount(whose, minlength=n), 1)))

    def of_texts(self, values: np.ndarray) -> np.ndarray:
        word = np.zeros(self.words)
        for lo, n, whose, bucket, weight in self.parts:
            word[lo : lo + n] = np.bincount(whose, values[bucket], n) * weight
        return np.bincount(self.text, word[self.kind] * self.share, self.texts)

    def back(self, errors: np.ndarray, power: int = 1) -> np.ndarray:
        """What each text's error gives each bucket; with power 2, how much each bucket weighs over all texts."""
        word, out = np.bincount(self.kind, errors[self.text] * self.share**power, self.words), np.zeros(BUCKETS)
        for lo, n, whose, bucket, weight in self.parts:
            out += np.bincount(bucket, (word[lo : lo + n] * weight**power)[whose], BUCKETS)
        return out


def fit(sample: Sample, steps: int = STEPS) -> Model:
    """Fit embeddings, softmax and constant together by full-batch descent with momentum and falling steps.

    The softmax has two classes, so its rows act through their difference: a text's log odds are the mean of the values
    table @ direction, and every gradient of the table is a number for each bucket times that direction. Steps are relative
    to the root of a bucket's weight over all texts, so that frequent words don't lead. Each step a bucket's vector is shortened
    by SHRINK (a penalty on the vectors' lengths): evidence of chance does not add up, and lasting evidence of any n-gram does.
    Without examples of both classes the constant alone answers."""
    y = np.array(sample.labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 4.0 if len(y) and y[0] else -4.0)
    means, rng = _Means(sample), np.random.default_rng(SEED)
    sample.index.clear()  # the words are not needed any more
    direction = rng.normal(0, 1, WIDTH)
    direction = (direction / np.linalg.norm(direction)).astype(np.float32)
    table, constant = np.zeros((BUCKETS, WIDTH), np.float32), 0.0
    moved, turned, shifted = np.zeros_like(table), np.zeros(WIDTH, np.float32), 0.0
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    root = np.sqrt(means.back(np.ones(len(y)), power=2)) + 1e-9
    for step in range(steps):
        rate = 1.0 - step / steps
        odds = means.of_texts(table @ direction) + constant
        error = (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - y) * balance
        raw = means.back(error)
        steep = raw / root
        moved *= np.float32(0.8)
        moved += (steep / max(float(np.abs(steep).max()), 1e-12)).astype(np.float32)[:, None] * direction
        turn = table.T @ raw.astype(np.float32)
        turned = (0.8 * turned + turn / max(float(np.abs(turn).max()), 1e-12)).astype(np.float32)
        shifted = 0.8 * shifted + float(error.sum()) / max(float(np.abs(error).sum()), 1e-12)
        table -= np.float32(RATE * rate) * moved
        direction = (direction - 0.01 * rate * turned).astype(np.float32)
        constant -= 0.2 * rate * shifted
        table *= np.maximum(1 - SHRINK * rate / np.maximum(np.sqrt(np.einsum("ij,ij->i", table, table)), 1e-12), 0).astype(np.float32)[:, None]
    values = table @ direction
    scale, constant = _rescaled(means.of_texts(values), constant, y)
    return Model((values * scale).astype(np.float32), constant)


def _rescaled(x: np.ndarray, constant: float, y: np.ndarray) -> tuple[float, float]:
    """The last layer's scale and constant fitted once more, without class balance (Newton steps on two numbers). A weak
    prior holds the scale to 1 and the constant to NO_EVIDENCE: a text of which nothing is known counts as clean."""
    a, b = 1.0, float(constant)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((q - y) * x).sum() + 0.05 * (a - 1), (q - y).sum() + 0.01 * (b - NO_EVIDENCE)])
        v = q * (1 - q)
        h = np.array([[(v * x * x).sum() + 0.05, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 1.0 / max(float(np.abs(d).max()), 1e-9))
        a, b = max(a - d[0], 0.05), b - d[1]
    return a, float(b)


def train(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """fit() on a list of texts."""
    sample = Sample()
    for text, label in zip(texts, labels):
        sample.add(text, label)
    return fit(sample, steps)


_memo: dict = {}


def _scores(model: Model, key: int, texts: list[str | None]):
    if _memo.get("key") != key:
        _memo.update(key=key, words=TwoGenerations(MEMO))
    memo: TwoGenerations = _memo["words"]
    for text in texts:
        words = words_of(text)
        new = list(dict.fromkeys(memo.missing(words)))
        if new:
            memo.add(new, model.word_odds(new))
        odds = sum(map(memo.young.__getitem__, words)) / max(len(words), 1) + model.constant
        yield 1 / (1 + np.exp(-min(max(odds, -40.0), 40.0)))
        memo.rotate()


def _identity(model: Model) -> int:
    return hash((model.bucket_odds.tobytes(), model.constant))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about `rows` labelled documents outside the held-out fold, chosen by a hash of doc_id.
    A null id, label or text teaches nothing; of several labels of one document the largest counts."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_training("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    there = known.count()
    cut = int(min(1.0, rows / max(there, 1)) * (1 << 30)) + 1
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut).groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most about `rows` ids: small whatever the size of the tables. One task trains on them; it holds distinct words and counts,
    # and the driver receives one row.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(chosen), "doc_id")
    types = pa.schema([("odds", pa.binary()), ("constant", pa.float64())])

    def run(batches):
        take_over("toxicity-training")
        sample, last = Sample(), None
        for batch in batches:
            for key, text, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                now = (key, hashlib.sha256(text.as_buffer()).digest())
                if now != last:  # rows that repeat teach once
                    sample.add(text.as_py(), min(max(label, 0), 1))
                last = now
        model = fit(sample)
        del sample
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.bucket_odds.tobytes()], pa.binary()), pa.array([model.constant])], schema=types)

    row = found.select("doc_id", "text", "label").repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(run, "odds binary, constant double").first()
    return Model(np.frombuffer(bytes(row.odds), np.float32), row.constant) if row else train([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted for every row, from its whole text alone. Null and empty texts get the
    score of the constant; repeated rows repeat; extra columns are ignored."""
    bounded_batches(docs.sparkSession)
    key, types = _identity(model), pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        take_over("toxicity", _memo.clear)
        for batch in batches:
            if batch.num_rows:
                s = np.fromiter(_scores(model, key, batch.column(1).to_pylist()), np.float64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=types)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, reject_at: float = 0.5) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores below `reject_at`."""
    bounded_batches(docs.sparkSession)
    key, at = _identity(model), docs.columns.index("text")

    def run(batches):
        take_over("toxicity", _memo.clear)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([s < reject_at for s in _scores(model, key, batch.column(at).to_pylist())]))
        give_back()

    return docs.mapInArrow(run, docs.schema)

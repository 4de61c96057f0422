"""Training-order materialisation: every sequence gets a global slot by a keyed permutation, and shards hold the slots.

A Feistel network permutes a power of four at or above the number of sequences; walking its cycles brings it onto the
number itself, so slots are a bijection that needs no sort, no table and no coordination. Sequences go straight to the
range of slots that holds theirs; each shard is one row of records of one stride, so a reader finds any slot by arithmetic and
can resume anywhere. Shards are committed by Spark's writer: a lost task writes its shards again, and none twice.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, committed, discard, mix64, release_shuffles
from .tokens import encoder

#: Ids of a sequence, sequences of a shard, rounds of the network. Records: document, piece, ids that count, then ids.
LENGTH, SHARD_ROWS, ROUNDS = 256, 8192, 6
HEAD, HEAD_BYTES = np.dtype([("doc_id", "<i8"), ("piece", "<u4"), ("n", "<u4")]), "<qII"
#: Chunks of text that a Python worker remembers one by one (long ones, and words before a mark); the others lie in a table.
MEMO = 100_000
#: A null doc_id in a record's head.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    n: int
    key: int
    rounds: int = ROUNDS

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round(self, i: int, x: np.ndarray) -> np.ndarray:
        salt = int(mix64(np.array([(self.key + 0x632BE59BD9B4E019 * (i + 1)) % (1 << 64)], np.uint64))[0])
        return mix64(x + np.uint64(salt)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._round(i, left), left
            else:
                left, right = right, left ^ self._round(i, right)
        return left << h | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        if (x >= self.n).any():
            raise ValueError("an index is outside the permutation")
        with np.errstate(over="ignore"):
            x = self._once(x, back)
            while (out := x >= self.n).any():
                x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, index) -> np.ndarray:
        return self._walk(index, False)

    def indexes(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def cut(ids: bytes, length: int, width: int) -> list[bytes]:
    """Ids (unsigned 32-bit) as sequences of at most `length`, in `width` bytes each."""
    x = np.frombuffer(ids, "<u4")
    if width == 2 and x.size and x.max() > 65535:
        raise ValueError("an id needs more than two bytes")
    raw = x.astype(f"<u{width}").tobytes()
    return [raw[i : i + length * width] for i in range(0, len(raw), length * width)]


@dataclass
class Shards:
    """The written table (shard, first_slot, n_slots, data) with what a reader needs."""

    table: DataFrame
    order: Permutation
    length: int
    width: int
    shard_rows: int

    @property
    def stride(self) -> int:
        return HEAD.itemsize + self.length * self.width

    def read(self, from_slot: int = 0):
        """(slot, doc_id, piece, ids) from a slot on, one shard in memory at a time."""
        first = from_slot // self.shard_rows
        for row in self.table.filter(F.col("shard") >= first).select("shard").orderBy("shard").collect():
            shard = self.table.filter(F.col("shard") == row.shard).first()
            for i in range(max(from_slot - shard.first_slot, 0), shard.n_slots):
                record = bytes(shard.data[i * self.stride : (i + 1) * self.stride])
                head = np.frombuffer(record, HEAD, 1)[0]
                ids = np.frombuffer(record, f"<u{self.width}", int(head["n"]), HEAD.itemsize)
                yield shard.first_slot + i, None if head["doc_id"] == NO_ID else int(head["doc_id"]), int(head["piece"]), ids.tolist()

    def records(self) -> DataFrame:
        """One row for each slot, read back from the shards: where it lies, its document and piece, and its ids' crc32."""
        stride, width = self.stride, self.width
        types = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64())])

        def run(batches):
            for batch in batches:
                for shard, first, n, data in zip(*(batch.column(i) for i in range(4))):
                    raw, n = data.as_py(), n.as_py()
                    head = np.ndarray(n, HEAD, raw, 0, (stride,))
                    crc = [zlib.crc32(raw[i * stride + HEAD.itemsize : i * stride + HEAD.itemsize + int(k) * width]) for i, k in enumerate(head["n"])]
                    ids = head["doc_id"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(first.as_py() + np.arange(n)), pa.array(np.full(n, shard.as_py())), pa.array(np.arange(n) * stride), pa.array(ids, mask=ids == NO_ID), pa.array(head["piece"].astype(np.int64)), pa.array(head["n"].astype(np.int64)), pa.array(crc, pa.int64())], schema=types)

        return self.table.mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, piece long, n_ids long, ids_crc32 long")


def sequences(df: DataFrame, tokenizer: str, end_id: int, length: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's sequences as records, numbered within the task that made them: part, number, record."""
    bounded_batches(df.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, part, n = encoder(tokenizer, MEMO).encode_all, TaskContext.get().partitionId(), 0
        for batch in batches:
            records = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(text.as_py() for text in batch.column(1))):
                for i, x in enumerate(cut(ids + tail, length, width)):
                    records.append(struct.pack(HEAD_BYTES, NO_ID if doc_id is None else doc_id, i, len(x) // width) + x)
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(records), part, np.int32)), pa.array(np.arange(n, n + len(records))), pa.array(records, pa.binary())], ["part", "number", "record"])
            n += len(records)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "part int, number long, record binary")


def materialise(df: DataFrame, tokenizer: str, end_id: int = 2, key: int = 20_240_229, length: int = LENGTH, width: int = 2, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Shards:
    """Write every sequence of every text at its slot.

    Sequences are made once and committed; a sequence's number is its place in its task after all tasks before, so the
    committed table fixes the order whatever is retried later. A text's sequences are its ids and the end id, cut after
    `length`; null and empty texts are the end id alone; repeated rows are sequences of their own; an empty table gives no shards."""
    spark = df.sparkSession
    made = committed(sequences(df, tokenizer, end_id, length, width, id_col, text_col), "sequences")
    # One row for each task that made some.
    base, total = {}, 0
    for r in sorted(made.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
        base[r.part], total = total, total + r.n
    order = Permutation(total, key)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                first = np.array([base[p] for p in batch.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(order.slots(first + np.asarray(batch.column(1)))), batch.column(2)], ["slot", "record"])

    stride = HEAD.itemsize + length * width

    def write(batches):
        shard, held = None, []

        def close():
            first = shard * shard_rows
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["shard", "first_slot", "n_slots", "data"])

        for batch in batches:
            for slot, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if slot // shard_rows != shard:
                    if held:
                        yield close()
                    shard, held = slot // shard_rows, []
                if slot != shard * shard_rows + len(held):
                    raise ValueError(f"slot {slot} is missing or taken twice")
                held.append(record.ljust(stride, b"\0"))
        if held:
            yield close()

    shards = -(-total // shard_rows)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards))
    to = (F.floor(F.col("slot") / shard_rows) * parts / max(shards, 1)).cast("int")
    ranged = made.mapInArrow(place, "slot long, record binary").repartitionById(parts, to).sortWithinPartitions("slot")
    table = committed(ranged.mapInArrow(write, "shard long, first_slot long, n_slots long, data binary"), "shards")
    discard(made)
    release_shuffles(spark)
    return Shards(table, order, length, width, shard_rows)

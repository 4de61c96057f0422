"""Packing by vector bin packing: a dot-product heuristic under simultaneous limits.

Examples have several sizes at once (tokens, segments, loss-bearing tokens). A sequence is filled by taking, again and
again, the example that fits and whose sizes have the largest weighted dot product with the room that is left; so a
sequence short of one resource takes examples that use the others. Groups of examples, dealt by hash, are packed apart.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, committed
from .tokens import MEMO, encoder

#: Tokens and segments of a sequence; examples that are packed together (more leave less padding, at quadratic cost).
TOKENS, SEGMENTS, GROUP_ROWS = 4096, 1024, 8192


def fill(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place in it) for each example; sizes: examples by resources, none above its limit.

    Weights are each resource's mean demand, so the scarcest counts most. Ties go to the example that comes first."""
    if len(sizes) and not ((sizes >= 0) & (sizes <= limits)).all():
        raise ValueError(f"a size is negative or above its limit {limits.tolist()}")
    n = len(sizes)
    sequence, place = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    if not n:
        return sequence, place
    share = sizes / limits
    weights = share.mean(0)
    left, opened = np.argsort(-sizes[:, 0], kind="stable"), 0  # largest first: what can fit is then a tail
    alone = sizes[left, 0] == limits[0]  # nothing fits beside these
    if alone.any():
        sequence[left[alone]] = np.arange(alone.sum())
        left, opened = left[~alone], int(alone.sum())
    columns = np.ascontiguousarray(share[left].T)
    first, gone = -columns[0], np.zeros(len(left), bool)
    live = len(left)
    while live:
        if live < len(left) // 2:
            left, columns = left[~gone], np.ascontiguousarray(columns[:, ~gone])
            first, gone = -columns[0], np.zeros(len(left), bool)
        room, taken = np.ones(sizes.shape[1]), 0
        while live:
            tail = int(np.searchsorted(first, -room[0] - 1e-12))
            fits = ~gone[tail:]
            score = columns[0, tail:] * (weights[0] * room[0])
            for d in range(1, len(room)):
                fits &= columns[d, tail:] <= room[d] + 1e-12
                score += columns[d, tail:] * (weights[d] * room[d])
            score[~fits] = -1.0
            best = int(score.argmax()) if len(score) else 0
            if not len(score) or score[best] < 0:
                break
            best += tail
            sequence[left[best]], place[left[best]] = opened, taken
            gone[best], room, taken, live = True, room - columns[:, best], taken + 1, live - 1
        opened += 1
    return sequence, place


def pack(df: DataFrame, limits: dict[str, int], order: list[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """df with sequence_id (long, unique over all groups) and offset (of the first size within its sequence).

    limits maps size columns to what a sequence may hold; the first is the one that offsets count. Null sizes count as
    0. A size above its limit is an error. order: columns that settle ties; rows equal in all of them may change places. The
    table is committed first; rows are dealt to groups by these columns and their place in it, so rows that repeat don't
    meet in one group. An empty table gives an empty one. Columns named as the new ones are replaced."""
    sizes, caps = list(limits), np.array(list(limits.values()), float)
    df = committed(df.drop("sequence_id", "offset", "__group"), "pack-sizes")
    groups = max(1, -(-df.count() // group_rows))
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        table = table.select(names)
        table = table.sort_by([(sizes[0], "descending"), *[(c, "ascending") for c in order]])
        amounts = np.stack([np.nan_to_num(table.column(c).to_numpy().astype(float)) for c in sizes], 1)
        sequence, place = fill(amounts, caps)
        by = np.lexsort((place, sequence))
        ends = np.cumsum(amounts[by, 0])
        first = np.flatnonzero(np.diff(sequence[by], prepend=-1))
        base = np.repeat(ends[first] - amounts[by[first], 0], np.diff(np.append(first, len(by))))
        offset = np.zeros(len(by), np.int64)
        offset[by] = (ends - amounts[by, 0] - base).astype(np.int64)
        return table.append_column("sequence_id", pa.array((group << 32) + sequence)).append_column("offset", pa.array(offset))

    dealt = df.withColumn("__group", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(run, schema)


def pieces(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", most: int = TOKENS, memo: int = MEMO) -> DataFrame:
    """Each text's ids and the end id, cut after every `most` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    bounded_batches(df.sparkSession)
    types = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer, memo).encode
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + tail
                n = len(ids) // 4
                for at in range(0, n, most):
                    part = ids[4 * at : 4 * (at + most)]
                    rows.append((key, at, len(part) // 4, zlib.crc32(part), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = TOKENS, segments: int = SEGMENTS, group_rows: int = GROUP_ROWS, memo: int = MEMO) -> DataFrame:
    """One row for each piece of each document with its sequence and offset. Every token of a document bears loss, so
    tokens and loss have one limit. `memo`: chunks that a worker remembers, for speed alone. Null and empty texts are the end id alone; repeated rows are packed each."""
    sized = pieces(df, tokenizer, end_id, most=tokens, memo=memo).withColumns({"segments": F.lit(1), "loss_tokens": F.col("length")})
    packed = pack(sized, {"length": tokens, "segments": segments, "loss_tokens": tokens}, ["doc_id", "start", "ids_crc32"], group_rows)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def turn_pieces(df: DataFrame, tokenizer: str, end_id: int = 2, most: int = TOKENS, loss_role: str = "assistant") -> DataFrame:
    """Every turn's ids and the end id, cut after every `most` ids: conv_id, turn, start, length, loss_tokens (the ids of
    turns of `loss_role`; 0 of others). Null texts are the end id alone; null keys and roles stay null and bear no loss."""
    bounded_batches(df.sparkSession)
    types = pa.schema([(c, pa.int64()) for c in ("conv_id", "turn", "start", "length", "loss_tokens")])

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = len(encode(text)) // 4 + 1
                rows += [(conv, turn, at, min(most, n - at), min(most, n - at) if role == loss_role else 0) for at in range(0, n, most)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

    own = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return own.mapInArrow(run, "conv_id long, turn long, start long, length long, loss_tokens long")


def pack_turns(df: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = TOKENS, segments: int = 64, loss_tokens: int = 2048, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each piece of each turn of conversations (conv_id, turn, role, text) with its sequence and offset. A
    sequence is limited in tokens, segments and loss-bearing tokens at once: prompts fill what answers may not. Turns are cut after
    the lesser of the limits on tokens and loss."""
    cut = turn_pieces(df, tokenizer, end_id, min(tokens, loss_tokens)).withColumn("segments", F.lit(1))
    return pack(cut, {"length": tokens, "segments": segments, "loss_tokens": loss_tokens}, ["conv_id", "turn", "start"], group_rows)

"""Repeated passages: difference-cover anchors find every window of words that an earlier document also has.

Short windows (anchors) are hashed only at word positions whose remainder by a period lies in a difference cover, so
any two equal long windows share an anchor at some common offset. Anchors of one document only are dropped; around
the others the long windows are hashed in full, and the smallest document of each long window decides. Work follows
the words near shared anchors; no pairs of occurrences are made.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, committed, discard, give_back, mix64, release_shuffles, take_over

#: Words of a window that counts as a repeated passage.
WINDOW = 50
#: Perfect difference sets, whose differences give every remainder of the period.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
ANCHOR_BASE, WINDOW_BASES = 0xD6E8FEB86659FD93, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Bits for each id of a bitmap, and the power of two that no bitmap's size exceeds (8 MB).
ID_BITS, MOST_BITS = 16, 26
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, words of an anchor): the longest period that leaves anchors of two fifths of the window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)
    return period, COVERS[period], window - period + 1


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2).astype(np.uint64)


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def window_hashes(h: np.ndarray, length: int, base: int, starts: np.ndarray) -> np.ndarray:
    """A hash of the `length` words from each start: differences of weighted prefix sums, brought to one weight."""
    room = 1 << max(10, (len(h) + 1).bit_length())
    up, down = _powers(base, room), _powers(pow(base, -1, 1 << 64), room)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix64((sums[starts + length] - sums[starts]) * down[starts])


def anchor_starts(n_words: int, window: int = WINDOW) -> np.ndarray:
    """Positions of a document's anchors, in order; none in a document shorter than a window."""
    period, cover, length = cover_for(window)
    if n_words < window:
        return np.zeros(0, np.int64)
    all_starts = (np.arange(0, n_words, period)[:, None] + np.array(cover)).ravel()
    return all_starts[all_starts + length <= n_words]


def _digest(words: list[bytes]) -> tuple[int, int, str]:
    line = b" ".join(words)
    return *np.frombuffer(xxhash.xxh3_128_digest(line), "<i8").tolist(), hashlib.sha256(line).hexdigest()


def _described(df: DataFrame, window: int) -> DataFrame:
    """Each row's words counted and hashed, with its anchors' hashes."""
    types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(pa.int64()))])
    length = cover_for(window)[2]

    def run(batches):
        take_over("passages")
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                starts = anchor_starts(len(words), window)
                anchors = window_hashes(word_hashes(words)[:, 0], length, ANCHOR_BASE, starts).view(np.int64) if len(starts) else starts
                rows.append((key, len(words), *_digest(words), anchors))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
        give_back()

    return df.mapInArrow(run, "doc_id long, n_words long, d1 long, d2 long, sha string, anchors array<long>")


def _candidates(df: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, at: places of shared anchors in anchor order) -> hashes of all windows over one of those anchors."""
    types = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("starts", pa.list_(pa.int32())), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int32())), ("words", pa.binary())])
    length = cover_for(window)[2]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for key, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                anchors = anchor_starts(len(words), window)
                at = np.asarray(at.values)
                p = anchors[at[at < len(anchors)]]
                if not len(p):
                    continue
                # Starts from p + length - window to p: marked by differences and summed up.
                edge = np.zeros(len(words) + 2, np.int32)
                np.add.at(edge, np.maximum(p + length - window, 0), 1)
                np.add.at(edge, np.minimum(p, len(words) - window) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[: len(words) - window + 1])
                h = word_hashes(words)
                k1 = window_hashes(h[:, 0], window, WINDOW_BASES[0], starts).view(np.int64)
                k2 = (window_hashes(h[:, 1], window, WINDOW_BASES[1], starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rows.append((key, *_digest(words)[:2], starts.astype(np.int32), k1, k2, pack.compress(b" ".join(words))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
        give_back()

    return df.mapInArrow(run, "doc_id long, d1 long, d2 long, starts array<int>, k1 array<long>, k2 array<int>, words binary")


def _cut(df: DataFrame, window: int) -> DataFrame:
    """(doc_id, d1, d2, words, starts of repeated windows) -> the words that are left."""
    types = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string()), ("kept", pa.string())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for key, d1, d2, packed, starts in zip(*(batch.column(i) for i in range(5))):
                words = unpack.decompress(packed.as_py()).split(b" ")
                starts = np.asarray(starts.values)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                covered = np.cumsum(edge)[: len(words)] > 0
                kept = b" ".join(w for w, c in zip(words, covered.tolist()) if not c)
                rows.append((key.as_py(), d1.as_py(), d2.as_py(), int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
        give_back()

    return df.mapInArrow(run, "doc_id long, d1 long, d2 long, n_removed long, sha string, kept string")


def _found(df: DataFrame, window: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(all rows described, with `copy` for whole copies of earlier ones; documents that lose some words and keep others)."""
    spark = df.sparkSession
    bounded_batches(spark)
    described = committed(_described(df, window), "passage-anchors")
    whole = committed(described.select("doc_id", "n_words", "d1", "d2", "sha"), "whole-passages")  # outlives the anchors
    known = whole.select("doc_id", "n_words", "d1", "d2").filter("doc_id is not null")
    first = known.filter(F.col("n_words") >= window).groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("d1", "d2", "first")
    copies = committed(known.join(first, ["d1", "d2"]).filter("doc_id > first").select("doc_id", "d1", "d2").distinct(), "whole-copies")
    few = copies.count() <= broadcast_rows
    mark = F.broadcast(copies) if few else copies
    # A whole copy has no passage that its first doesn't have: only firsts go on.
    rows = described.filter((F.col("doc_id").isNotNull()) & (F.size("anchors") > 0)).join(mark, ["doc_id", "d1", "d2"], "left_anti")
    anchors = rows.select("doc_id", F.posexplode("anchors").alias("at", "hash"))
    shared = anchors.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("hash")
    shared = committed(shared, "repeated-anchors")  # both sides of the join are plain shuffles then, which can be split
    release_shuffles(spark)
    at = anchors.join(shared, "hash", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    at = committed(at, "shared-anchors")
    _drop(spark, described, shared)
    near = committed(_candidates(_among(df, at).join(at, "doc_id"), window), "passage-windows")
    _drop(spark, at)
    windows = near.select("doc_id", "d1", "d2", F.explode(F.arrays_zip("starts", "k1", "k2")).alias("w")).select("doc_id", "d1", "d2", "w.*")
    least = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("k1", "k2", "first")
    least = committed(least, "repeated-windows")
    release_shuffles(spark)
    on = ["doc_id", "d1", "d2"]
    repeated = windows.join(least, ["k1", "k2"]).filter("doc_id > first").groupBy(*on).agg(F.collect_set("starts").alias("starts"))
    repeated = committed(repeated, "cut-windows")
    _drop(spark, least)
    words = _among(near.select(*on, "words"), repeated).dropDuplicates(on)
    cut = committed(_cut(words.join(repeated, on).select(*on, "words", "starts"), window), "passages-cut")
    _drop(spark, near, repeated)
    return whole, copies.withColumn("copy", F.lit(True)), cut


def _drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Free the disk of committed tables that were read for the last time, and of the shuffles behind them."""
    for table in tables:
        discard(table)
    release_shuffles(spark)


def _may_be(column: Column, ids: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """One row with a bitmap `name` of the hashes of ids' doc_id, and whether `column` hits it: every id among them does, and
    few others. It keeps texts that a join can't match out of its shuffle; the join decides."""
    size = 1 << min(MOST_BITS, max(6, (ID_BITS * ids.count()).bit_length()))

    def place(c: Column) -> tuple[Column, Column]:
        at = F.xxhash64(c.cast("long")).bitwiseAND(F.lit(size - 1))
        return F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place(F.col("doc_id"))
    found = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    row = ids.sparkSession.createDataFrame(pa.table({name: pa.array([bits], pa.list_(pa.int64()))}))
    word, bit = place(column)
    return F.broadcast(row), F.getbit(F.get(F.col(name), word), bit) == 1


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose doc_id may be one of ids: all that are, and few others."""
    row, held = _may_be(F.col("doc_id"), ids, _unused(df.columns, "__bits"))
    return df.crossJoin(row).filter(held).select(*[F.col(f"`{c}`") for c in df.columns])


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row: words covered by a window that starts in a document
    with a smaller doc_id go, judged on the input. Null texts have no words. Rows that share a doc_id don't shorten
    each other; rows with a null doc_id keep all words and shorten nothing. Extra columns are ignored."""
    described, copies, cut = _found(_source(df, id_col, text_col), window, broadcast_rows)
    on = ["doc_id", "d1", "d2"]
    out = described.join(cut.select(*on, "n_removed", F.col("sha").alias("cut_sha")), on, "left").join(copies, on, "left")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, broadcast_rows: int = 200_000) -> DataFrame:
    """docs with repeated passages cut from `text` (kept words joined by one space) and n_chars set anew for those
    rows; texts without a repeat stay as they are, byte for byte. No row goes: a whole copy keeps an empty text."""
    _, copies, cut = _found(_source(docs, "doc_id", "text"), window, broadcast_rows)
    names, at = docs.columns, docs.columns.index("text")
    d1, d2, key, c1, c2, kept = (_unused(names, c) for c in ("__d1", "__d2", "__id", "__c1", "__c2", "__kept"))
    new = cut.select(F.col("doc_id").alias(key), F.col("d1").alias(c1), F.col("d2").alias(c2), F.col("kept").alias(kept))
    new = new.union(copies.select("doc_id", "d1", "d2", F.lit("")))
    schema = StructType([*docs.schema.fields, StructField(d1, LongType()), StructField(d2, LongType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = [_digest(words_of(t))[:2] for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], [*batch.schema.names, d1, d2])

    # Only texts that may change are shuffled; the others are passed on as they are.
    row, held = _may_be(F.col("doc_id"), new.select(F.col(key).alias("doc_id")), _unused(names, "__bits"))
    own = [F.col(f"`{c}`") for c in names]
    joined = docs.crossJoin(row).filter(held).select(*own).mapInArrow(run, schema).join(new, (F.col("doc_id") == F.col(key)) & (F.col(d1) == F.col(c1)) & (F.col(d2) == F.col(c2)), "left")
    values = {"text": F.coalesce(kept, "text")} | ({"n_chars": F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in names else {})
    changed = joined.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in names])
    return docs.crossJoin(row).filter(~held).select(*own).union(changed)


def _unused(names: list[str], name: str) -> str:
    """A name that no column has, whatever its case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name

"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are made in Arrow batches. Equal ones are merged first, then each distinct one is sent to three groups,
by which third of its bits it shares: two that differ in at most two bits share a third. Each group sorts its
fingerprints by Gray rank, factors the bits that neighbours share into the nodes of a tree (mask and pattern, without
what the parent has already), and searches with pruning by accumulated differences. Found links leave a group as one
star for each of its sets, never as all pairs; links become components outside.

near_copies is the same method at another distance: shingles of five words and a Jaccard similarity of 0.8. Pairs at
that bound differ in a seventh of their bits, where thirds of 64 bits find nothing, so fingerprints are wider, groups
share chosen bits and are searched with the same index, and proposed pairs are verified by their shingles themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, committed, discard, give_back, mix64, release_shuffles, shrink_heaps, take_over
from .components import components

#: Words of a shingle and seed of its hash, differing bits that still link, fingerprints of an index node, nodes of an upper node.
SHINGLE, XX_SEED, MOST_BITS, LEAF, FAN = 3, 42, 2, 16, 16
#: The bits of each third; a group with more distinct fingerprints than this is divided again by thirds of its other bits.
THIRDS, MOST_GROUP = ((0, 21), (21, 42), (42, 64)), 1 << 17
U1 = np.uint64(1)
#: Of near_copies: words of a shingle, the least Jaccard similarity that links, 64-bit words of a fingerprint, the members from
#: which a group is searched in tiles, and the leaders that all members of such a group are compared with first.
COPY_SHINGLE, COPY_SIMILARITY, WIDE, COPY_GROUP, LEADERS = 5, 0.8, 4, 4096, 2
#: Bands whose groups propose links first; parts of the hash space that shingles are counted in.
FIRST_BANDS, PARTS = 3, 256
#: Ids that are broadcast to find their texts; more are joined by shuffle.
MOST_ENDS = 2_000_000
#: The share of pairs at the bound that groups may miss, and the fingerprints that a group has on average (2 to this).
MISSED, GROUP_BITS = 0.01, 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), XX_SEED)], np.uint64)
    else:
        line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], XX_SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row. Null and wordless texts get 0; other columns are ignored."""
    bounded_batches(df.sparkSession)
    types = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=types)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of 64-bit values in the reflected Gray code: neighbours in rank differ in few bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_order(fps: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words sorted as one long Gray code: the parity of the words before turns a word's order around."""
    ranks, odd = [], np.zeros(len(fps), bool)
    for word in fps.T:
        ranks.append(np.where(odd, ~gray_rank(word), gray_rank(word)))
        odd = odd ^ (np.bitwise_count(word) & 1).astype(bool)
    return np.lexsort(ranks[::-1])


class GrayIndex:
    """A tree over fingerprints (one row of 64-bit words each) sorted by Gray rank. levels[0] are the roots; a node has
    the bits that all below it share (mask, pattern) and that no node above it has, and the span of its children in the next level."""

    def __init__(self, fps: np.ndarray):
        self.order = gray_order(fps.reshape(len(fps), -1))
        self.fps = fps[self.order]
        ones = self.fps.reshape(len(fps), -1)
        zeros = ~ones
        level, width = [(ones, zeros)], LEAF
        while len(level[-1][0]) > FAN or len(level) == 1:
            cuts = np.arange(0, len(level[-1][0]), width)
            level.append((np.bitwise_and.reduceat(level[-1][0], cuts, axis=0), np.bitwise_and.reduceat(level[-1][1], cuts, axis=0)))
            width = FAN
        self.levels, above = [], None
        for i in range(len(level) - 1, -1, -1):
            ones, zeros = level[i]
            mask = ones | zeros
            if above is not None:
                mask = mask & ~np.repeat(above, LEAF if i == 0 else FAN, axis=0)[: len(mask)]
            self.levels.append((mask, ones))
            above = ones | zeros

    def within(self, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(query's place, fingerprint's place in self.fps) of all pairs that differ in at most `bits` bits."""
        return self.near(queries, bits)[:2]

    def near(self, queries: np.ndarray, bits: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, fingerprint's place in self.fps, differing bits) of all pairs that differ in at most `bits` bits.
        first: the queries are self.fps from there on, and only pairs with a later fingerprint are wanted."""
        queries = queries.reshape(len(queries), -1)
        q = np.repeat(np.arange(len(queries)), len(self.levels[0][0]))
        node = np.tile(np.arange(len(self.levels[0][0])), len(queries))
        past = np.zeros(len(q), np.int64)
        for depth, (mask, pattern) in enumerate(self.levels):
            past = past + sum(np.bitwise_count((queries[q, w] ^ pattern[node, w]) & mask[node, w]) for w in range(mask.shape[1]))
            keep = past <= bits
            if first is not None:
                reach = 1 if depth + 1 == len(self.levels) else LEAF * FAN ** (len(self.levels) - depth - 2)  # fingerprints below a node
                keep &= (node + 1) * reach > q + first + 1
            q, node, past = q[keep], node[keep], past[keep]
            if depth + 1 < len(self.levels):
                fan = LEAF if depth + 2 == len(self.levels) else FAN
                below = len(self.levels[depth + 1][0])
                start = node * fan
                n = np.minimum(start + fan, below) - start
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, past, node = np.repeat(q, n), np.repeat(past, n), np.repeat(start, n) + step
        return q, node, past


def stars(fps: np.ndarray, ids: np.ndarray, bits: int = MOST_BITS, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints with an id each: one link (id, smallest id of its set) for each that others link to."""
    index = GrayIndex(fps)
    ids = ids[index.order]
    parent = np.arange(len(ids))
    for at in range(0, len(ids), block):
        q, node = index.within(index.fps[at : at + block], bits)
        q = q + at
        a, b = q[node > q], node[node > q]
        while len(a):
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, ids)
    root = least[parent]
    linked = root != ids
    return ids[linked], root[linked]


def _thirds_of(fixed: int) -> list[int]:
    """Three masks that divide the bits not in `fixed`, each joined with `fixed`."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cut = [0, len(free) // 3, 2 * len(free) // 3, len(free)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, most_group: int = MOST_GROUP, bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) between representatives (rep) of distinct fingerprints (fp) that join all that differ in at most
    two bits. A group above `most_group` is divided by thirds of its remaining bits, and again: after three rounds
    a group has at most 2^20 members whatever the data, since its fingerprints are distinct."""
    if bits != 2:
        raise ValueError("thirds find all pairs of at most two differing bits only")
    spark = distinct.sparkSession
    masks = [sum(1 << i for i in range(a, b)) for a, b in THIRDS]
    found, part, rounds = None, distinct.select("fp", "rep"), 0
    part = part.withColumn("fixed", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])))
    while True:
        keyed = part.withColumn("bits", F.col("fp").bitwiseAND(F.col("fixed")))
        # Only groups of two or more matter; sizes are counted with partial sums before the shuffle.
        size = keyed.groupBy("fixed", "bits").agg(F.count("*").alias("size")).filter("size > 1")
        large = [] if rounds == 2 else size.filter(F.col("size") > most_group).groupBy("fixed").agg(F.count("*").alias("groups")).collect()
        now = keyed if not large else keyed.join(size.filter(F.col("size") > most_group).select("fixed", "bits"), ["fixed", "bits"], "left_anti")
        made = _stars_of(now, spark)
        found = made if found is None else found.union(made)
        if not large:
            return found
        divide = {_signed(m): [_signed(x) for x in _thirds_of(m)] for m in sorted({r.fixed & (1 << 64) - 1 for r in large})}
        table = F.create_map(*[x for k, v in divide.items() for x in (F.lit(k).cast("long"), F.array(*[F.lit(y).cast("long") for y in v]))])
        part = keyed.join(size.filter(F.col("size") > most_group).select("fixed", "bits"), ["fixed", "bits"], "left_semi").select("fp", "rep", F.explode(table[F.col("fixed")]).alias("fixed"))
        rounds += 1


def _stars_of(keyed: DataFrame, spark) -> DataFrame:
    types = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None

        def close():
            if sum(len(f) for f, _ in held) > 1:
                a, b = stars(np.concatenate([f for f, _ in held]).view(np.uint64), np.concatenate([r for _, r in held]))
                if len(a):
                    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=types)

        for batch in batches:
            if not batch.num_rows:
                continue
            fixed, bits, fp, rep = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(4))
            cut = np.flatnonzero((fixed[1:] != fixed[:-1]) | (bits[1:] != bits[:-1])) + 1
            spans = list(zip([0, *cut.tolist()], [*cut.tolist(), len(fp)]))
            for n, (i, j) in enumerate(spans):
                if (fixed[i], bits[i]) != key:
                    out, held, key = close(), [], (fixed[i], bits[i])
                    if out is not None:
                        yield out
                if j - i > 1 or n in (0, len(spans) - 1):
                    held.append((fp[i:j], rep[i:j]))
        out = close()
        if out is not None:
            yield out

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.select("fixed", "bits", "fp", "rep").repartition(n, "fixed", "bits").sortWithinPartitions("fixed", "bits").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_group: int = MOST_GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) for every row.

    Null and wordless texts have fingerprint 0 and link like any other; rows of one doc_id repeat with their own
    fingerprint and share a component; a row with a null doc_id keeps a null component. An empty table gives none."""
    spark = df.sparkSession
    made = committed(fingerprints(df, id_col, text_col), "fingerprints")
    own = made.filter("doc_id is not null")
    distinct = committed(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    edges = links(distinct, most_group)
    if id_col:  # one doc_id on several rows: its fingerprints belong together
        repeated = own.groupBy("doc_id").agg(F.min("fp").alias("f"), F.max("fp").alias("g")).filter("f != g").select("doc_id")
        more = own.join(repeated, "doc_id", "left_semi").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        edges = edges.union(more)
    joined = components(edges)
    release_shuffles(spark)
    of_fp = distinct.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return made.join(of_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingles(text: str | None, shingle: int = COPY_SHINGLE) -> set[bytes]:
    """The distinct shingles of a text, the whole text if it has fewer words, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))} if words else set()


def wide_fingerprint(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """WIDE words of 64 bits over the distinct shingles, each shingle counted once as Jaccard similarity does."""
    found = shingles(text, shingle)
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, XX_SEED) for x in found), np.uint64, len(found))
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        mixed = np.stack([mix64(part + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for i in range(WIDE)], 1)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def differing(similarity: float) -> float:
    """The expected share of differing bits at a Jaccard similarity: the angle of two sets of equal size."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def radius_for(similarity: float, bits: int = 64 * WIDE) -> int:
    """Differing bits that pairs at the bound exceed about once in 700: three standard deviations above their mean."""
    p = differing(similarity)
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def bands_for(rows: int, similarity: float) -> np.ndarray:
    """The bit places of each band. A band has more bits the more fingerprints there are, so that groups stay small,
    and there are as many bands as a pair one standard deviation beyond the mean needs to share one with 1 - MISSED."""
    p, k = differing(similarity), min(max(round(math.log2(max(rows, 2))) - GROUP_BITS, 8), 24)
    share = (1 - p - math.sqrt(p * (1 - p) / (64 * WIDE))) ** k
    bands = math.ceil(math.log(MISSED) / math.log1p(-share)) if share < 1 else 1
    rng = np.random.default_rng(XX_SEED)
    return np.stack([rng.permutation(64 * WIDE)[:k] for _ in range(bands)])


def spanning(a: np.ndarray, b: np.ndarray, apart: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b) of members, those of a minimum spanning forest over the members' sets; the order is by differing
    bits, then by the members' places, so the same pairs are chosen wherever the same members meet."""
    chosen, order = [], np.lexsort((b, a, apart))
    a, b = a[order], b[order]
    _, root = np.unique(sets, return_inverse=True)
    place = np.arange(len(a))
    while len(place):
        x, y = root[a[place]], root[b[place]]
        place, x, y = place[x != y], x[x != y], y[x != y]
        if not len(place):
            break
        least = np.full(int(root.max()) + 1, len(a))
        np.minimum.at(least, x, place)
        np.minimum.at(least, y, place)
        taken = np.unique(least[least < len(a)])
        chosen.append(taken)
        up = np.arange(len(least))
        p, q = root[a[taken]], root[b[taken]]
        while len(p):
            p, q = up[p], up[q]
            differ = p != q
            p, q = p[differ], q[differ]
            np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
            while (up[up] != up).any():
                up = up[up]
        root = up[root]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


WORDS = [f"f{i}" for i in range(WIDE)]


def _dealt(distinct: DataFrame, places: np.ndarray) -> DataFrame:
    """(band, rep, f0 ...): each wide fingerprint once for each band, by the bits that it has there."""
    weights, types = 1 << np.arange(places.shape[1], dtype=np.int64), pa.schema([("band", pa.int64()), ("rep", pa.int64()), *[(w, pa.int64()) for w in WORDS]])

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rep = part.column(0).to_numpy()
                fps = np.stack([part.column(1 + i).to_numpy() for i in range(WIDE)], 1)
                bits = np.unpackbits(np.ascontiguousarray(fps).astype("<i8").view(np.uint8).reshape(len(rep), -1), axis=1, bitorder="little")
                key = (bits[:, places] @ weights) + (np.arange(len(places), dtype=np.int64) << places.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *[pa.array(np.repeat(x, len(places))) for x in (rep, *fps.T)]], schema=types)

    return distinct.select("rep", *WORDS).mapInArrow(deal, "band long, rep long, " + ", ".join(f"{w} long" for w in WORDS))


def _searched(tiles: DataFrame, radius: int, everything: bool, members: bool = False, similarity: float = 0.0) -> DataFrame:
    """Tiles (key, rep, part, near, f0 ...) -> proposals (a, b): pairs within the radius of one tile, different parts and at least
    one near end; a spanning forest of them over the parts, or all with `everything`. With `members` also, as rows without b, who has such
    a pair. Tiles without the columns part and near are of members by themselves. A tile is searched
    with a Gray index, a block of queries at a time. Where rows have counts (column counts), pairs that these rule out are not
    proposed: of a large group of unlike copies only what may link leaves its tile."""
    parts, counted = "part" in tiles.columns, "counts" in tiles.columns
    types = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), *[(w, pa.int64()) for w in WORDS]])

    def tile(key, reps, part, near, fps, counts=None):
        by = np.argsort(reps, kind="stable")  # places follow ids, so ties fall alike in all tiles
        reps, part, near, fps = reps[by], part[by], near[by], fps[by]
        counts = None if counts is None else counts[by]
        index, found = GrayIndex(fps), []
        for at in range(0, len(reps), 512):
            q, node, bits = index.near(index.fps[at : at + 512], radius, at)
            i, j = index.order[q + at], index.order[node]
            good = (node > q + at) & (part[i] != part[j]) & (near[i] | near[j])
            i, j, bits = np.minimum(i, j)[good], np.maximum(i, j)[good], bits[good]
            if counts is not None and len(i):
                able = np.concatenate([_may_reach(counts[i[a : a + 8192]], counts[j[a : a + 8192]], similarity) for a in range(0, len(i), 8192)])
                i, j, bits = i[able], j[able], bits[able]
            if everything:
                found.append((i, j, bits))
            else:  # what is not in the forest of some of the pairs isn't in that of all
                if found:
                    i, j, bits = (np.concatenate(x) for x in zip(found.pop(), (i, j, bits)))
                chosen = spanning(i, j, bits, part)
                found.append((i[chosen], j[chosen], bits[chosen]))
        i, j, _ = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            return
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), key)), pa.array(reps[i]), pa.array(reps[j]), *[pa.nulls(len(i), pa.int64())] * WIDE], schema=types)
        if members:
            own = np.unique(np.concatenate([i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(reps[own]), pa.nulls(len(own), pa.int64()), *[pa.array(x) for x in fps[own].view(np.int64).T.copy()]], schema=types)

    def run(batches):
        key, held = None, []

        def close():
            if sum(len(x[0]) for x in held) > 1:
                yield from tile(key, *(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part, near = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)) if parts else (rep, np.ones(len(rep), bool))
            fps = np.stack([batch.column((4 if parts else 2) + i).to_numpy() for i in range(WIDE)], 1).view(np.uint64)
            counts = [np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), "<u4").reshape(-1, PARTS)] if counted else []
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if keys[i] != key:
                    yield from close()
                    key, held = keys[i], []
                held.append((rep[i:j], part[i:j], near[i:j], fps[i:j], *[c[i:j] for c in counts]))
        yield from close()
        give_back()

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.select("key", "rep", *(["part", "near"] if parts else []), *WORDS, *(["counts"] if counted else [])).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long, " + ", ".join(f"{w} long" for w in WORDS))


def part_counts(found: set[bytes]) -> bytes:
    """How many shingles fall into each of PARTS parts of the hash space. Two sets share at most the lesser count of each part."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, XX_SEED) for x in found), np.uint64, len(found))
    return np.bincount((hashes >> np.uint64(32)).astype(np.int64) % PARTS, minlength=PARTS).astype("<u4").tobytes()


def _may_reach(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    both = np.minimum(a, b).sum(-1, dtype=np.int64)
    return both >= similarity * (a.sum(-1, dtype=np.int64) + b.sum(-1, dtype=np.int64) - both)


def may_reach(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether sets with these counts can have the similarity; where they do, this is always true."""
    return bool(_may_reach(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity))


def _described(docs: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text, counts) of the documents whose id is among the ends."""
    ends = F.broadcast(ends) if ends.count() <= MOST_ENDS else ends  # ids only, counted

    def describe(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part_counts(shingles(t.as_py(), shingle)) for t in batch.column(1)], pa.binary())], ["doc_id", "text", "counts"])

    return docs.join(ends, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(describe, "doc_id long, text string, counts binary")


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose texts have the similarity. Counts of parts, which are short, rule most others out; the texts
    of what is left decide."""
    ends = committed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "copy-ends")
    texts = committed(_described(docs, ends, shingle), "copy-texts")
    named = lambda c, end: texts.select(F.col("doc_id").alias(end), F.col(c).alias(f"{c}_{end}"))

    def sift(batches):
        for batch in batches:
            keep = [may_reach(x, y, similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(batches):
        held: dict[tuple, set[bytes]] = {}  # one end of many pairs is taken apart once
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                text = x.as_py()
                if (a, text) not in held:
                    held.clear()
                    held[a, text] = shingles(text, shingle)
                x, y = held[a, text], shingles(y.as_py(), shingle)
                both = len(x & y)
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(named("counts", "b"), "b").join(named("counts", "a"), "a").select("a", "b", "counts_a", "counts_b").mapInArrow(sift, "a long, b long").distinct()
    left = committed(left, "copy-sifted")
    made = committed(left.join(named("text", "b"), "b").join(named("text", "a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "copy-links")
    discard(texts)
    return made


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY, most_group: int = COPY_GROUP) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links) of every row with an id. Links join texts of
    the same words and pairs whose sets of shingles have at least this Jaccard similarity; each pair that fingerprints
    propose is verified by its texts, so no link is wrong. Null and wordless texts link with each other; rows of one
    doc_id share a component.

    Proposals come in three turns: in each group of a few bands a nearest-first spanning forest over its members (in groups
    above most_group: every member with each of a few leaders), then in all groups one over the sets that verified links have joined so far,
    then every pair within the radius that still lies between two sets. So a group of copies costs about one verification a member, and no pair that
    could join two sets is left out. Large groups are cut into tiles: members of their first leader's set are compared
    with the members outside it only."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    types = pa.schema([("doc_id", pa.int64()), ("same", pa.binary()), *[(w, pa.int64()) for w in WORDS]])

    def run(batches):
        take_over("copies")
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(1).to_pylist()
                same = [xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())) for t in texts]
                fps = np.stack([wide_fingerprint(t, shingle) for t in texts]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), *[pa.array(np.ascontiguousarray(c)) for c in fps.T]], schema=types)

    made = committed(docs.mapInArrow(run, "doc_id long, same binary, " + ", ".join(f"{w} long" for w in WORDS)), "wide-fingerprints")
    distinct = committed(made.groupBy("same", *WORDS).agg(F.min("doc_id").alias("rep")), "distinct-texts")
    places = bands_for(distinct.count(), similarity)
    radius, dealt = radius_for(similarity), _dealt(distinct, places)
    # One doc_id with several texts: its texts belong together.
    repeated = made.groupBy("doc_id").agg(F.min("same").alias("p"), F.max("same").alias("q")).filter("p != q").select("doc_id")
    edges = made.join(repeated, "doc_id", "left_semi").join(distinct.select("same", "rep"), "same").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    large = committed(dealt.groupBy("band").agg(F.count("*").alias("size")).filter(F.col("size") > most_group), "large-groups")
    hot = large.count()
    mark = F.broadcast(large.select("band")) if hot <= 10_000 else large.select("band")
    cold = dealt if not hot else dealt.join(mark, "band", "left_anti")
    first = committed(_searched(cold.select(F.col("band").alias("key"), "rep", *WORDS), radius, False, members=True), "copy-groups")
    # The groups of a few bands join most copies; the others then propose only what those have left apart.
    pairs = first.filter(F.col("b").isNotNull() & (F.col("key") < FIRST_BANDS << places.shape[1])).select("a", "b")
    members = first.filter("b is null").select("key", F.col("a").alias("rep"), *WORDS)
    rows = None
    if hot:
        rows = committed(dealt.join(mark, "band", "left_semi"), "large-group-rows")
        leads = [F.min(F.struct(F.xxhash64("rep", F.lit(i)), "rep", *WORDS)).alias(f"l{i}") for i in range(LEADERS)]
        leaders = rows.groupBy("band").agg(*leads).select("band", F.explode(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("l")).select("band", F.col("l.rep").alias("lead"), *[F.col(f"l.{w}").alias(f"l_{w}") for w in WORDS]).distinct()
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"l_{w}"))) for w in WORDS), F.lit(0))
        # Four rows for each large group, of which there are at most rows x bands / most_group.
        led = rows.join(F.broadcast(leaders) if hot <= 10_000 else leaders, "band").filter((F.col("rep") != F.col("lead")) & (apart <= radius))
        pairs = pairs.union(led.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")))
    tested, joined, fresh = None, None, True

    def sets() -> DataFrame:
        """The sets that all links so far make, anew only if there are new links; later ones join these stars."""
        nonlocal edges, joined, fresh
        if fresh:
            joined = committed(components(edges), "copy-sets")
            edges, fresh = joined.select(F.col("id").alias("a"), F.col("component").alias("b")), False
        return joined

    for turn in range(3):
        if turn:
            joined = sets()
            part = F.coalesce("component", "rep")
            tiles = members.join(joined, F.col("rep") == F.col("id"), "left").select("key", "rep", part.alias("part"), F.lit(True).alias("near"), *WORDS)
            split = tiles.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("key")
            tiles = tiles.join(split, "key", "left_semi")
            if hot:
                tiles = tiles.union(_large_tiles(rows.join(joined, F.col("rep") == F.col("id"), "left").select("band", "rep", part.alias("part"), *WORDS), most_group))
            if turn == 2:  # every pair is wanted that may link: what rules the others out goes with the rows
                tiles = committed(tiles, "copy-tiles")
                known = _described(docs, committed(tiles.select(F.col("rep").alias("doc_id")).distinct(), "copy-ends"), shingle)
                tiles = tiles.join(committed(known.select(F.col("doc_id").alias("rep"), "counts"), "copy-counts"), "rep")
            pairs = _searched(tiles, radius, turn == 2, similarity=similarity).filter("b is not null").select("a", "b")
        pairs = pairs.filter("a != b").distinct()
        pairs = committed(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "copy-candidates")
        if turn and not pairs.head(1):
            continue
        tested = pairs if tested is None else tested.union(pairs)
        linked = _verified(pairs, docs, shingle, similarity)
        if not linked.isEmpty():
            edges, fresh = edges.union(linked), True
        release_shuffles(spark)
        shrink_heaps(spark)
    of_rep = sets().withColumnRenamed("id", "rep")
    of_same = distinct.select("same", "rep").join(of_rep, "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    release_shuffles(spark)
    return made.select("doc_id", "same").join(of_same, "same").select("doc_id", "component_id")


def _large_tiles(rows: DataFrame, most_group: int) -> DataFrame:
    """Tiles of large groups (band, rep, part, f0 ...), of at most about two most_group rows each, that together hold every
    pair of different parts: the members outside the part of the group's first leader are near ends, cut into slices,
    and each slice meets every row of the group, which are dealt to shares."""
    parts = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64("rep", F.lit(0)), "part")).getField("part").alias("main"), F.count("*").alias("size"))
    outside = rows.join(parts, "band").filter("part != main").groupBy("band").agg(F.count("*").alias("out"))
    known = parts.join(outside, "band").select("band", "main", F.ceil(F.col("out") / most_group).cast("int").alias("slices"), F.ceil(F.col("size") / most_group).cast("int").alias("shares"))
    placed = rows.join(known, "band").withColumns({"near": F.col("part") != F.col("main"), "slice": F.pmod(F.xxhash64("rep", F.lit("slice")), "slices"), "share": F.pmod(F.xxhash64("rep", F.lit("share")), "shares")})
    # Two tiles may fall on one key: their rows then meet too, which proposes nothing wrong.
    name = lambda s, t: F.xxhash64("band", F.col(s).cast("long"), F.col(t).cast("long")).alias("key")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    outer = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    met = placed.withColumn("to", every).select(name("to", "share"), "rep", "part", F.lit(False).alias("near"), *WORDS)
    near = placed.filter("near").withColumn("to", outer).select(name("slice", "to"), "rep", "part", "near", *WORDS)
    return met.union(near)


def keep_one(docs: DataFrame, broadcast_rows: int = 200_000, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of docs, all columns unchanged, without those whose doc_id isn't the smallest of its component; of rows
    with one doc_id all stay. With a similarity components are those of near_copies at that bound, otherwise those of
    near_duplicates, whose distance is fixed. Up to `broadcast_rows` dropped ids are broadcast (their number is counted
    first); more are joined by shuffle."""
    if similarity is None and shingle != SHINGLE:
        raise ValueError("near_duplicates has its own shingles; give a similarity with others")
    found = near_duplicates(docs) if similarity is None else near_copies(docs, shingle=shingle, similarity=similarity)
    gone = committed(found.filter("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    small = gone.count() <= broadcast_rows
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["doc_id"], "left_anti")

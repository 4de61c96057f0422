"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are laid on a grid of cells as wide as the join distance, over leading principal dimensions, and sorted
by cell. The sequence is cut into blocks of bounded bytes; blocks whose boxes are further apart than the distance are never compared.
A pair of blocks is joined by halving both intervals again and again, skipping distant halves, down to small products.
Products are taken in single precision with a margin, and what passes is decided in double precision.
Equal vectors are merged first; links leave a pair of blocks as counts and one star for each set, never as pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, committed, release_shuffles
from .components import components

#: Cosine that links; leading dimensions of the grid; vectors that the principal dimensions are fitted on (chosen by a hash of vec_id).
COSINE, GRID_DIMS, FIT_ROWS = 0.9, 6, 4096
#: Bytes of a block (in double precision; a task holds two), vectors of a product that is not halved further, rows of pairs that are broadcast.
BLOCK_BYTES, LEAF, BROADCAST_ROWS = 8 << 20, 512, 200_000
#: By how much a product in single precision may be wrong: half a unit in the last place for each of many more dimensions than there are.
MARGIN = 1e-3


def _reach(cosine: float) -> float:
    """The distance of unit vectors at this cosine, with room for rounding."""
    return float(np.sqrt(max(2 - 2 * cosine, 0.0))) * (1 + 1e-9) + 1e-9


def _normal(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and, for vectors that can link, their dimension, bytes (float32 where that is exact, else float64; zeros unsigned) and a
    128-bit digest."""
    types = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("vec", pa.binary()), ("digest", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = None if not v.is_valid or v.values.null_count or not len(v.values) else v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if x is None or not np.isfinite(x).all() or not x.any():
                    rows.append((key, None, None, None))
                else:
                    small = x.astype("<f4")
                    rows.append((key, len(x), (small if (small == x).all() else x.astype("<f8")).tobytes(), xxhash.xxh3_128_digest(x.astype("<f8").tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, dims int, vec binary, digest binary")


def unit(raw: list[bytes], dims: int) -> np.ndarray:
    """Vectors scaled to length 1 in double precision, first by their largest component so that none overflows."""
    x = np.empty((len(raw), dims))
    wide = np.fromiter((len(r) == 8 * dims for r in raw), bool, len(raw))
    for own, kind in ((wide, "<f8"), (~wide, "<f4")):
        if own.any():
            x[own] = np.frombuffer(b"".join(r for r, w in zip(raw, own) if w), kind).reshape(-1, dims)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def principal(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Orthonormal leading directions (columns); any orthonormal ones keep the join exact."""
    centred = vectors - vectors.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(axes[:, ::-1][:, :dims])


def _gridded(distinct: DataFrame, axes: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Each distinct vector with its cell, written so that cells sort in grid order."""
    types = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("dims", pa.int32()), ("vec", pa.binary()), ("y", pa.list_(pa.float64())), ("cell", pa.string())])

    def run(batches):
        for batch in batches:
            raw, dims = batch.column(2).to_pylist(), np.asarray(batch.column(3))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                y = unit([raw[i] for i in at], int(d)) @ axes[int(d)]
                cells = np.floor((y + 1.0) / reach).astype(int)
                names = [f"{d:06d}:" + ",".join(f"{c:03d}" for c in row) for row in cells]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(dims[at], pa.int32()), pa.array([raw[i] for i in at], pa.binary()), pa.array(y.tolist(), types.field(4).type), pa.array(names)], schema=types)

    return distinct.select("rep", "copies", "vec", "dims").mapInArrow(run, "rep long, copies long, dims int, vec binary, y array<double>, cell string")


def cut_sequence(cells: list[tuple[str, int]], block_rows) -> list[tuple[str, int, int]]:
    """(cell, first block, parts) for cells in grid order: blocks are runs of cells; a cell beyond a block is dealt to parts.
    block_rows: the rows of a block of vectors of so many dimensions."""
    out, block, filled, kind = [], -1, 0, None
    for cell, n in sorted(cells):
        rows = block_rows(int(cell.split(":")[0]))
        parts = -(-n // rows)
        if parts > 1 or block < 0 or filled + n > rows or cell.split(":")[0] != kind:
            block, filled = block + 1, 0
        out.append((cell, block, parts))
        if parts > 1:
            block, filled = block + parts - 1, rows
        filled, kind = filled + n, cell.split(":")[0]
    return out


def near_pairs(boxes: DataFrame, reach: float, width: int) -> DataFrame:
    """(first, second): pairs of blocks (first <= second) of one dimension whose boxes are no further apart than the distance.
    boxes: block, dims, low and high (arrays). Boxes meet on the slabs, as wide as the distance, that they touch in the first
    dimensions, so only neighbours are compared, in tasks of their own."""
    slabs = min(2, width)
    spans = lambda low, high: [F.sequence(F.floor((F.element_at("low", d + 1) - low) / reach), F.floor((F.element_at("high", d + 1) + high) / reach)) for d in range(slabs)]

    def dealt(df: DataFrame, more: float) -> DataFrame:
        for d, span in enumerate(spans(0.0, more)):
            df = df.withColumn(f"slab{d}", F.explode(span))
        return df

    # One side reaches a slab further up, the other one too: two boxes within the distance share a slab in every dimension.
    a = dealt(boxes, reach).select("dims", *[f"slab{d}" for d in range(slabs)], F.col("block").alias("x"), F.col("low").alias("lx"), F.col("high").alias("hx"))
    b = dealt(boxes, reach).select("dims", *[f"slab{d}" for d in range(slabs)], F.col("block").alias("y"), F.col("low").alias("ly"), F.col("high").alias("hy"))
    gap = F.zip_with(F.zip_with("ly", "hx", lambda p, q: p - q), F.zip_with("lx", "hy", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    square = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, ["dims", *[f"slab{d}" for d in range(slabs)]]).filter("x <= y").filter(square <= reach * reach).select(F.col("x").alias("first"), F.col("y").alias("second")).distinct()


def join_intervals(a: np.ndarray, ya: np.ndarray, b: np.ndarray, yb: np.ndarray, same: bool, cosine: float, reach: float, leaf: int = LEAF):
    """(places in a, places in b) of linked pairs, piece by piece. Both intervals are in grid order; distant halves are
    skipped by the boxes of their leading coordinates. same: both are one interval, whose pairs are given once (i < j)."""
    todo = [(0, len(a), 0, len(b))]
    fa = a.astype(np.float32)
    fb = fa if same else b.astype(np.float32)
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1 or same and b1 <= a0 + 1:
            continue
        gap = np.maximum(np.maximum(ya[a0:a1].min(0) - yb[b0:b1].max(0), yb[b0:b1].min(0) - ya[a0:a1].max(0)), 0)
        if gap @ gap > reach * reach:
            continue
        if a1 - a0 <= leaf and b1 - b0 <= leaf:
            i, j = np.divmod(np.flatnonzero(fa[a0:a1] @ fb[b0:b1].T >= cosine - MARGIN), b1 - b0)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            sure = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
            i, j = i[sure], j[sure]
            if len(i):
                yield i, j
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            todo += [(a0, a1, b0, m), (a0, a1, m, b1)]


def _joined(rows: DataFrame, axes: dict[int, np.ndarray], cosine: float, reach: float, leaf: int) -> DataFrame:
    """For each pair of blocks: rep, links found there (weighted by copies) and the smallest rep of its set there."""
    types = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        blocks = np.asarray(table.column("block"))
        order = np.lexsort((np.asarray(table.column("rep")), np.asarray(table.column("cell").to_pylist()), blocks != first))
        table, blocks = table.take(pa.array(order)), blocks[order]
        rep, copies = np.asarray(table.column("rep")), np.asarray(table.column("copies"))
        n = int((blocks == first).sum())
        dims = table.column("dims")[0].as_py()
        x = unit(table.column("vec").to_pylist(), dims)
        y = x @ axes[dims]
        links, parent = np.zeros(len(rep), np.int64), np.arange(len(rep))
        same = first == second
        shift = 0 if same else n
        for i, j in join_intervals(x[:n], y[:n], x[shift:], y[shift:], same, cosine, reach, leaf):
            j = j + shift
            links += np.bincount(i, copies[j], len(rep)).astype(np.int64) + np.bincount(j, copies[i], len(rep)).astype(np.int64)
            while len(i):
                a, b = parent[i], parent[j]
                i, j, a, b = i[a != b], j[a != b], a[a != b], b[a != b]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, parent, rep)
        some = links > 0
        return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array(least[parent][some])], schema=types)

    return rows.groupBy("first", "second").applyInArrow(run, "rep long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block_rows: int | None = None, grid_dims: int = GRID_DIMS, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links (other vectors at this cosine or above), component_id (smallest vec_id reachable) and kept.

    Exact for a cosine above 0. Vectors that are null, empty, zero or hold null or non-finite components have no links and are
    their own component; vectors of different dimensions never link. Rows with one vec_id count as vectors of their
    own and share a component; a null vec_id gives a null component and isn't kept. Extra columns are ignored. A block holds block_rows vectors
    or, unsaid, BLOCK_BYTES: a task's memory is the same at any size of the table."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    spark, reach = df.sparkSession, _reach(cosine)
    rows_of = lambda dims: block_rows or max(LEAF, BLOCK_BYTES // (8 * dims))
    bounded_batches(spark)
    normal = committed(_normal(df, id_col, vector_col), "vectors")
    usable = normal.filter("digest is not null")
    # Equal vectors become one, counted before the shuffle; a null id counts as a vector but represents none.
    distinct = committed(usable.groupBy("digest").agg(F.min(F.coalesce("vec_id", F.lit((1 << 63) - 1))).alias("rep"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"), F.any_value("dims").alias("dims")), "distinct-vectors")
    there = {r.dims: r.n for r in distinct.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    axes = {}
    for dims, n in there.items():
        share = int(min(1.0, FIT_ROWS / n) * (1 << 30)) + 1
        sample = distinct.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < share)).orderBy("rep").limit(2 * FIT_ROWS)
        raw = [bytes(r.vec) for r in sample.select("vec").collect()]
        axes[dims] = principal(unit(raw, dims), min(grid_dims, dims)) if raw else np.eye(dims)[:, : min(grid_dims, dims)]
    grid = committed(_gridded(distinct, axes, reach), "grid")
    # Cells are few whatever the rows: at most (2 / distance + 1) to the power of the grid's dimensions.
    sequence = cut_sequence([(r.cell, r.n) for r in grid.groupBy("cell").agg(F.count("*").alias("n")).collect()], rows_of)
    if not sequence:
        return normal.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    placed = grid.join(F.broadcast(spark.createDataFrame(sequence, "cell string, start int, parts int")), "cell").withColumn("block", F.col("start") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    width = min(a.shape[1] for a in axes.values())
    sides = [[f(F.col("y")[d]) for d in range(width)] for f in (F.min, F.max)]
    boxes = committed(placed.groupBy("block", "dims").agg(F.array(*sides[0]).alias("low"), F.array(*sides[1]).alias("high")), "block-boxes")
    pairs = committed(near_pairs(boxes, reach, width), "block-pairs")
    to = pairs.select(F.col("first").alias("block"), "first", "second").union(pairs.filter("first <> second").select(F.col("second"), "first", "second"))
    few = pairs.count() <= BROADCAST_ROWS
    found = committed(_joined(placed.select("block", "cell", "rep", "copies", "dims", "vec").join(F.broadcast(to) if few else to, "block"), axes, cosine, reach, leaf), "vector-links")
    release_shuffles(spark)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.filter("root != rep").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    repeated = usable.filter("vec_id is not null").groupBy("vec_id").agg(F.min("digest").alias("p"), F.max("digest").alias("q")).filter("p != q").select("vec_id")
    more = usable.join(repeated, "vec_id", "left_semi").join(distinct.select("digest", "rep"), "digest").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    joined = components(edges.union(more))
    of_rep = distinct.select("digest", "rep", "copies").join(linked, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    of_rep = of_rep.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = normal.select("vec_id", "digest").join(of_rep, "digest", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

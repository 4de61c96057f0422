"""Connected components of a link table, distributed: alternating large-star and small-star rounds.

Each round every vertex hands its larger (then smaller) neighbours to the smallest vertex it knows; the table never
grows beyond its links, and it ends as stars around the smallest vertex of each component in a number of rounds that
grows with the logarithm of the vertices, squared at worst. Minima are pre-aggregated and joined back; the few hubs' minima
are broadcast, so that a hub's links are never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import committed, discard


#: Vertices with more than this share of all ends are hubs (at most 1 / share of them, so their minima are broadcast), and
#: the ends that a vertex may have at any number of links without being one.
HUB_SHARE, FEW_ENDS = 1 / 512, 16


def _with_least(ends: DataFrame, links: int) -> DataFrame:
    """(u, v, m): every row of ends (u, v) with the smallest v of its u. Rows of hubs meet a broadcast of at most 512
    minima where they are; only the others are shuffled by u."""
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    cut = max(2 * links * HUB_SHARE, FEW_ENDS)
    hubs = least.filter(F.col("n") > cut).select("u", F.col("m").alias("hub"))
    marked = ends.join(F.broadcast(hubs), "u", "left")
    rest = marked.filter("hub is null").select("u", "v").join(least.filter(F.col("n") <= cut).select("u", "m"), "u")
    return marked.filter("hub is not null").select("u", "v", F.col("hub").alias("m")).union(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, links).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, links).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(down.groupBy("u").agg(F.min("v").alias("v")).select("u", "v"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link. Links may repeat, point both ways or
    at themselves; null ends are ignored; ids without links to others are absent; an empty table gives an empty one."""
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v")
    now = committed(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark, links = None, now.count()
    for _ in range(most_rounds if links else 0):
        new = committed(_small_star(_large_star(now, links), links).distinct(), "links")
        discard(now)
        now, was = new, mark
        row = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        mark, links = tuple(row), row[0]
        if mark == was:
            break
    else:
        if links:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

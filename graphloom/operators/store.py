"""Primitives of the stored graph: upserts, removals that cascade, counts, neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import edge_order
from ..workspace import committed, discard, likely


def upsert(rows: DataFrame, key: str = "id", sequence: str = "seq") -> DataFrame:
    """The last row of each key, at the place (`sequence`) where the key first came."""
    values = [c for c in rows.columns if c not in (key, sequence)]
    last = rows.groupBy(key).agg(F.min(sequence).alias(sequence), F.max_by(F.struct(*values), F.col(sequence)).alias("v"))
    return last.select(key, *[F.col(f"v.{c}").alias(c) for c in values], sequence)


def get(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.filter(F.col("id") == key)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in gone (id) and the edges that touch them. Only what may be gone is looked up."""
    gone = committed(gone.select("id").distinct(), "gone")
    seen = likely(edges, ["sourceId", "targetId"], gone)
    end = lambda c: gone.withColumnRenamed("id", c)
    maybe = seen.filter("__likely").drop("__likely").join(end("sourceId"), "sourceId", "left_anti").join(end("targetId"), "targetId", "left_anti")
    some = likely(nodes, ["id"], gone)
    kept = some.filter("not __likely").drop("__likely").union(some.filter("__likely").drop("__likely").join(gone, "id", "left_anti").select(nodes.columns))
    return kept, seen.filter("not __likely").drop("__likely").union(maybe.select(edges.columns))


def without_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, removed node ids) without everything that lies in the files of paths (filePath)."""
    gone = nodes.join(paths.select("filePath").distinct(), "filePath", "left_semi").select("id")
    return *without_nodes(nodes, edges, gone), gone


def replace_edges(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the ids in old gone and the rows of new in their place."""
    return edges.join(old.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("type", "sourceId", "targetId", "id")


def with_labels(nodes: DataFrame, labels: Iterable[str]) -> DataFrame:
    return nodes.filter(F.col("label").isin(*labels))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, depth) of all nodes within some hops of the start ids, along edges in either direction."""
    both = edges.select(F.col("sourceId").alias("a"), F.col("targetId").alias("b")).union(edges.select("targetId", "sourceId")).distinct()
    seen = committed(start.select("id", F.lit(0).alias("depth")).distinct(), "hops")
    frontier = seen
    for depth in range(1, hops + 1):
        new = both.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        new = committed(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "hops")
        if new.isEmpty():
            break
        seen, frontier = seen.union(new), new
    return seen


def visible(nodes: DataFrame, edges: DataFrame, labels: Iterable[str], start: DataFrame | None = None, hops: int | None = None) -> DataFrame:
    """Nodes with a visible label and, where a start and a number of hops are given, within that reach. A start that
    isn't in the graph hides nothing."""
    shown = with_labels(nodes, labels)
    if start is None or hops is None or nodes.join(start, "id", "left_semi").isEmpty():
        return shown
    return shown.join(neighbourhood(edges, start, hops), "id", "left_semi")


def merged_edges(edges: DataFrame, sequence: str = "seq") -> DataFrame:
    """Edges of one meaning as one: the first id, the largest confidence with the reason of its latest holder, the
    latest non-empty provenance, the first step. The meaning is source, target and type, with read or write for
    accesses and the called name for calls (columns `access` and `callName` where there are any)."""
    key = ["sourceId", "targetId", "type", *[c for c in ("access", "callName") if c in edges.columns]]
    seq = F.col(sequence)
    named = [c for c in ("resolutionSource", "fileHash") if c in edges.columns]
    return edges.groupBy(*key).agg(
        F.min_by("id", seq).alias("id"), F.max("confidence").alias("confidence"),
        *([F.max_by("reason", F.struct("confidence", sequence)).alias("reason")] if "reason" in edges.columns else []),
        *[F.max_by(c, F.when(F.col(c) != "", seq)).alias(c) for c in named],
        *([F.min_by("step", F.when(F.col("step").isNotNull(), seq)).alias("step")] if "step" in edges.columns else []),
    )


def export_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with the first of each id, edges with the labels of both ends in stored form, edges without known ends)."""
    first = nodes.dropDuplicates(["id"]) if "node_seq" not in nodes.columns else nodes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("node_seq"))).filter("r = 1").drop("r")
    ends = first.select("id", "label")
    shaped = edges.withColumn("confidence", F.when(F.col("confidence") == 0, 1.0).otherwise(F.coalesce("confidence", F.lit(1.0)))).withColumn("step", F.coalesce("step", F.lit(0)))
    joined = shaped.join(ends.select(F.col("id").alias("sourceId"), F.col("label").alias("from_label")), "sourceId", "left").join(ends.select(F.col("id").alias("targetId"), F.col("label").alias("to_label")), "targetId", "left")
    known = F.col("from_label").isNotNull() & F.col("to_label").isNotNull()
    return first, joined.filter(known), joined.filter(~known)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, strict: bool = True) -> int:
    """Parquet by label and by pair of labels; the number of skipped edges. strict: none may be skipped."""
    first, kept, skipped = export_tables(nodes, edges)
    n = skipped.count()
    if strict and n:
        raise ValueError(f"{n} edges have an end that is no node")
    first.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    kept.write.mode("overwrite").partitionBy("from_label", "to_label").parquet(f"{path}/edges")
    return n


def edge_key_order():
    return edge_order()


def drop_tables(*tables: DataFrame) -> None:
    for t in tables:
        discard(t)

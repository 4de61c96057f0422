"""Keeping a graph current: files that changed are removed with all their nodes and edges, and indexed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import without_files


def reindexed(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with everything of the changed files (filePath) replaced."""
    kept_nodes, kept_edges, _ = without_files(nodes, edges, changed)
    return kept_nodes.unionByName(new_nodes, allowMissingColumns=True), kept_edges.unionByName(new_edges, allowMissingColumns=True)


def watch(spark: SparkSession, folder: str, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], load: Callable[[], tuple[DataFrame, DataFrame]], save: Callable[[DataFrame, DataFrame], None], checkpoint: str, once: bool = True):
    """A streaming query over a folder of files: each batch of new or changed files goes through `extract` and replaces
    what the stored graph had of them. The checkpoint makes a restart go on where it stopped."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch.selectExpr("path filePath", "cast(content as string) content")
        save(*reindexed(*load(), rows.select("filePath"), *extract(rows)))

    stream = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()

"""Writing results: snapshots, statements, embedding rows, renames."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructType

from ..schema import EDGE_SCHEMA, EMBEDDING_SCHEMA, NODE_LABELS, NODE_SCHEMA


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The whole graph as one JSON document, row by row (nodes by id, edges in graph order), put in place at once."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        for name, rows in (("nodes", nodes.orderBy("id")), ("relationships", edges.orderBy("type", "sourceId", "targetId", "id"))):
            f.write("{\n" if name == "nodes" else ",\n")
            f.write(f'  "{name}": [')
            for i, r in enumerate(rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator()):
                f.write(("," if i else "") + "\n    " + r.j)
            f.write("\n  ]")
        f.write("\n}\n")
    os.replace(f"{path}.part", path)


def _type_name(kind) -> str:
    if isinstance(kind, ArrayType):
        return f"{_type_name(kind.elementType)}[]" if not isinstance(kind.elementType, StructType) else "STRING"
    return {LongType: "INT64", IntegerType: "INT32", DoubleType: "DOUBLE", FloatType: "FLOAT", BooleanType: "BOOLEAN"}.get(type(kind), "STRING")


def schema_statements(dims: int = 384) -> list[str]:
    """Statements that create a node table for each label, the table of relations, that of embeddings and its vector index."""
    own = ", ".join(f"{f.name} {_type_name(f.dataType)}" for f in NODE_SCHEMA if f.name not in ("label", "node_seq"))
    out = [f"CREATE NODE TABLE IF NOT EXISTS `{label}` ({own}, PRIMARY KEY (id))" for label in NODE_LABELS]
    relation = ", ".join(f"{f.name} {_type_name(f.dataType)}" for f in EDGE_SCHEMA if f.name not in ("sourceId", "targetId", "edge_seq"))
    out.append(f"CREATE REL TABLE GROUP IF NOT EXISTS CodeRelation ({', '.join(f'FROM `{a}` TO `{b}`' for a in NODE_LABELS for b in NODE_LABELS)}, {relation})")
    vector = ", ".join(f"{f.name} {'FLOAT[' + str(dims) + ']' if f.name == 'embedding' else _type_name(f.dataType)}" for f in EMBEDDING_SCHEMA)
    out.append(f"CREATE NODE TABLE IF NOT EXISTS CodeEmbedding ({vector}, PRIMARY KEY (id))")
    out.append("CALL CREATE_VECTOR_INDEX('CodeEmbedding', 'code_embedding_index', 'embedding', metric := 'cosine')")
    return out


def quoted(value: Column) -> Column:
    """A value as a string literal, null as NULL."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\\", r"\\\\"), "'", r"\\'")
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def node_statements(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(id, statement) that insert a node by row, where a bulk load is not to be had."""
    pairs = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), quoted(F.col(c))) for c in columns])
    return nodes.select("id", F.concat(F.lit("CREATE (:`"), "label", F.lit("` {"), pairs, F.lit("})")).alias("statement"))


def edge_statements(edges: DataFrame) -> DataFrame:
    """(id, statement) that insert an edge by row between stored ends (columns from_label, to_label)."""
    return edges.select("id", F.concat(F.lit("MATCH (a:`"), "from_label", F.lit("` {id: "), quoted(F.col("sourceId")), F.lit("}), (b:`"), "to_label", F.lit("` {id: "), quoted(F.col("targetId")), F.lit("}) CREATE (a)-[:CodeRelation {type: "), quoted(F.col("type")), F.lit(", confidence: "), F.col("confidence").cast("string"), F.lit("}]->(b)")).alias("statement"))


def replaced_embeddings(stored: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Stored embedding rows (id, nodeId, ...) without those of nodes that have new rows or are gone, and the new rows."""
    stale = new.select("nodeId") if gone is None else new.select("nodeId").union(gone.select("nodeId"))
    return stored.join(stale.distinct(), "nodeId", "left_anti").unionByName(new, allowMissingColumns=True)


def stored_hashes(rows: DataFrame) -> DataFrame:
    """(nodeId, hash) of stored embeddings; rows without a chunk or lines, of an older form, count as stale: their hash is empty."""
    known = F.col("chunkIndex").isNotNull() & F.col("startLine").isNotNull() & F.col("endLine").isNotNull()
    return rows.groupBy("nodeId").agg(F.when(F.bool_and(known), F.max("contentHash")).otherwise("").alias("hash"))


def apply_rename(root: str, edits: DataFrame) -> tuple[int, list[str]]:
    """Write the edits (filePath, line, old, new) of a rename preview into the files below root: (lines changed, paths whose text is no longer
    what the edit expects). A file changes as a whole or not at all."""
    changed, stale = 0, []
    todo: dict[str, list] = {}
    for e in edits.orderBy("filePath", "line").collect():  # edits are reviewed one by one: few
        todo.setdefault(e.filePath, []).append(e)
    top = os.path.realpath(root)
    for path, rows in todo.items():
        at = os.path.realpath(os.path.join(root, path))
        if os.path.commonpath([at, top]) != top:
            raise ValueError(f"{path} lies outside {root}")
        with open(at, encoding="utf-8", newline="") as f:
            parts = re.split("(\r\n|\n)", f.read())
        lines = parts[::2]
        if any(e.line > len(lines) or lines[e.line - 1] != e.old for e in rows):
            stale.append(path)
            continue
        for e in rows:
            parts[2 * (e.line - 1)] = e.new
        with open(f"{at}.part", "w", encoding="utf-8", newline="") as f:
            f.write("".join(parts))
        os.replace(f"{at}.part", at)
        changed += len(rows)
    return changed, sorted(stale)


def registry_line(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, sort_keys=True)

"""Folders, sections of documents, links between them, and the geometry of scopes."""

from __future__ import annotations

import itertools
import posixpath

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType


def folder_tree(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a folder for every prefix of a path, a file for the path, CONTAINS from each to its children."""
    parts = F.filter(F.split("filePath", "/"), lambda x: x != "")
    steps = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.element_at(parts, i).alias("name"), (i == F.size(parts)).alias("is_file")))).alias("s")).select("s.*").distinct()
    label = F.when(F.col("is_file"), "File").otherwise("Folder")
    nodes = steps.select(F.concat_ws(":", label, "path").alias("id"), label.alias("label"), "name", F.col("path").alias("filePath"))
    edges = steps.filter("parent <> ''").select(F.concat(F.lit("Folder:"), "parent").alias("sourceId"), F.concat_ws(":", label, "path").alias("targetId"), F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("project structure").alias("reason"))
    return nodes, edges


def headings(files: DataFrame) -> DataFrame:
    """(filePath, line, level, name) of Markdown headings outside fenced code, with the file's number of lines."""
    body = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n"), "\n")
    rows = files.select("filePath", F.size(body).alias("total"), F.posexplode(body).alias("at", "text"))
    by_line = Window.partitionBy("filePath").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fenced = F.sum(F.col("text").rlike("^\\s*```").cast("int")).over(by_line) % 2 == 1
    rows = rows.withColumn("fenced", fenced).filter(~F.col("fenced") & F.col("text").rlike("^#{1,6}\\s+\\S"))
    return rows.select("filePath", (F.col("at") + 1).cast("long").alias("line"), F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_extract("text", "^#+\\s+(.*)$", 1), "\\s+#+\\s*$", "")).alias("name"), "total")


def nested_sections(found: DataFrame) -> DataFrame:
    """(id, filePath, line, level, name, endLine, parent): a section ends before the next of its level or above; its parent is
    the nearest one before it of a lower level, else the file. Headings of one file are compared by levels, of which
    there are six, each by a running window."""
    ahead = Window.partitionBy("filePath").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)  # from the end: each row is added once
    behind = Window.partitionBy("filePath").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    name = F.concat_ws(":", F.lit("Section"), "filePath", F.concat(F.lit("L"), F.col("line").cast("string")), "name")
    levels = range(1, 7)
    out = found.withColumns({f"n{n}": F.min(F.when(F.col("level") == n, F.col("line"))).over(ahead) for n in levels})
    following = F.array_min(F.array(*[F.when(F.col("level") >= n, F.col(f"n{n}")) for n in levels]))
    out = out.select("filePath", "line", "level", "name", F.coalesce(following - 1, F.col("total").cast("long")).alias("endLine"), name.alias("id"))
    out = out.withColumns({f"p{n}": F.max(F.when(F.col("level") == n, F.struct("line", "id"))).over(behind) for n in levels})
    parent = F.array_max(F.array(*[F.when(F.col("level") > n, F.col(f"p{n}")) for n in levels]))
    return out.select("id", "filePath", "line", "level", "name", "endLine", F.coalesce(parent["id"], F.concat(F.lit("File:"), "filePath")).alias("parent"))


@F.pandas_udf(StringType())
def _resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([posixpath.normpath(posixpath.join(posixpath.dirname(b or ""), x)) if x else None for b, x in zip(base, link)])


def document_links(files: DataFrame) -> DataFrame:
    """IMPORTS between documents: relative Markdown links, without fragments, to files that exist; each once."""
    raw = files.select("filePath", F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\]\(([^)\s]+)[^)]*\)"), F.lit(1))).alias("raw"))
    raw = raw.filter(~F.lower("raw").rlike("^(https?:|mailto:|#)")).withColumn("link", F.substring_index("raw", "#", 1)).filter("link <> ''")
    to = raw.select("filePath", _resolved("filePath", "link").alias("target")).distinct()
    known = files.select(F.col("filePath").alias("target")).distinct()
    return to.join(known, "target").select(F.concat(F.lit("File:"), "filePath").alias("sourceId"), F.concat(F.lit("File:"), "target").alias("targetId"), F.lit("IMPORTS").alias("type"), F.lit(0.8).alias("confidence"))


def scope_at(positions: DataFrame, scopes: DataFrame) -> DataFrame:
    """(position columns, scope): the innermost scope (both ends inclusive) at each filePath, line, col; null outside all.

    Of the scopes that hold a position the one that starts last wins, then the one that ends first, then the last id. Scopes that hold a
    whole line are reduced to the best of each line before any position is looked at; only those that begin or end on a
    line are compared with its positions. All joins are by file and line, so a long file is spread over tasks."""
    s = scopes.filter("endLine >= startLine").select("filePath", "startLine", "startCol", "endLine", "endCol", "id")
    best = lambda c: F.max(F.struct(F.struct("startLine", "startCol").alias("a"), (-F.col("endLine")).alias("l"), (-F.col("endCol")).alias("c"), F.col("id").alias("scope"))).alias(c)
    # Scopes of the same lines hold the same whole ones, and those that begin or end on a line at the same column hold the same part of it.
    spans = s.filter("endLine - startLine >= 2").groupBy("filePath", "startLine", "endLine").agg(best("best"))
    inner = F.explode(F.sequence(F.col("startLine").cast("long") + 1, F.col("endLine").cast("long") - 1))
    whole = spans.select("filePath", inner.alias("on"), "best").groupBy("filePath", "on").agg(F.max("best").alias("whole"))
    ends = s.withColumn("on", F.explode(F.array_distinct(F.array("startLine", "endLine"))))
    ends = ends.withColumns({"from": F.when(F.col("startLine") == F.col("on"), F.col("startCol")), "to": F.when(F.col("endLine") == F.col("on"), F.coalesce("endCol", F.lit(-1))), "on": F.col("on").cast("long")})
    part = ends.groupBy("filePath", "on", "from", "to").agg(best("best"))
    keys = positions.columns
    p = positions.withColumn("on", F.col("line").cast("long")).withColumn("at", F.col("col").cast("int"))
    held = F.when((F.col("from").isNull() | (F.col("from") <= F.col("at"))) & (F.col("to").isNull() | (F.col("at") <= F.col("to"))), F.col("best"))
    found = p.join(part, ["filePath", "on"], "left").groupBy(*keys, "on").agg(F.max(held).alias("part")).join(whole, ["filePath", "on"], "left")
    return found.select(*keys, F.greatest("part", "whole")["scope"].alias("scope"))


def scope_ancestors(scopes: DataFrame) -> DataFrame:
    """(scope, ancestor, depth), the scope itself at depth 0; a cycle ends where it meets itself."""
    from ..workspace import committed

    parents = scopes.select(F.col("id").alias("ancestor"), "parent").filter("parent is not null")
    level = committed(scopes.select(F.col("id").alias("scope"), F.col("id").alias("ancestor"), F.lit(0).alias("depth")), "ancestors")
    out = level
    for depth in itertools.count(1):
        up = level.join(parents, "ancestor").select("scope", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        level = committed(up.join(out.select("scope", "ancestor"), ["scope", "ancestor"], "left_anti"), "ancestors")
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def scope_faults(scopes: DataFrame) -> DataFrame:
    """(rule, id): scopes that break one of six rules of a well-formed tree."""
    twice = scopes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate id").alias("rule"), "id")
    root = scopes.filter("parent is null and kind <> 'Module'").select(F.lit("root is no module"), "id")
    p = scopes.select(F.col("id").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("filePath", "startLine", "startCol", "endLine", "endCol")])
    lost = scopes.filter("parent is not null").join(p, "parent", "left_anti").select(F.lit("missing parent"), "id")
    j = scopes.join(p, "parent")
    other = j.filter("filePath <> p_filePath").select(F.lit("parent in another file"), "id")
    a, z = F.struct("startLine", "startCol"), F.struct("endLine", "endCol")
    pa, pz = F.struct("p_startLine", "p_startCol"), F.struct("p_endLine", "p_endCol")
    inside = (pa <= a) & (z <= pz) & ((pa != a) | (pz != z))
    out = j.filter("filePath = p_filePath").filter(~inside).select(F.lit("not inside its parent"), "id")
    order = Window.partitionBy("parent").orderBy("startLine", "startCol", "endLine", "endCol")
    ends = F.max(z).over(order.rowsBetween(Window.unboundedPreceding, -1))
    over = scopes.filter("parent is not null").withColumn("before", ends).filter(F.col("before").isNotNull() & (F.col("before") > a)).select(F.lit("overlaps a sibling"), "id")
    return twice.union(root).union(lost).union(other).union(out).union(over)

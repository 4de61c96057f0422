"""Finding symbols and what surrounds them: candidates, references, flows, panels, simple graph queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import clean_path
from ..workspace import committed, likely

# Relations that a symbol's context shows.
CONTEXT_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "INHERITS", "USES", "HAS_METHOD", "HAS_PROPERTY", "METHOD_OVERRIDES", "METHOD_IMPLEMENTS", "ACCESSES", "OVERRIDES")


def candidates(nodes: DataFrame, name: str = "", uid: str = "", file_path: str = "", kind: str = "") -> DataFrame:
    """Nodes that a name or id may mean, with a score: an id alone 1; a name 0.9, in other case 0.75, inside 0.5; hints add 0.2 each and are conditions."""
    if uid:
        return nodes.filter(F.col("id") == uid).withColumn("score", F.lit(1.0))
    lower = F.lower("name")
    score = F.when(F.col("name") == name, 0.9).when(lower == name.lower(), 0.75).when(lower.contains(name.lower()), 0.5)
    found = nodes.withColumn("score", score).filter("score is not null")
    if file_path:
        found = found.filter(clean_path(F.col("filePath")).contains(file_path.lower().replace("\\", "/"))).withColumn("score", F.col("score") + 0.2)
    if kind:
        found = found.filter(F.lower("label") == kind.lower()).withColumn("score", F.col("score") + 0.2)
    return found


def best_candidate(found: DataFrame) -> tuple[str, list]:
    """('found', [row]), ('ambiguous', rows) or ('missing', []): the first wins if it scores 0.9 and leads by over 0.09."""
    rows = found.orderBy(F.desc("score"), "filePath", "id").limit(20).collect()
    if not rows:
        return "missing", []
    if len(rows) == 1 or rows[0].score >= 0.9 and rows[0].score - rows[1].score > 0.09:
        return "found", rows[:1]
    return "ambiguous", rows


def references(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id, direction, type, uid, name, label, filePath) of the neighbours of the ids in `of`; a class or interface also
    has the callers of its constructors and the importers of its file."""
    own = committed(of.select(F.col("id").alias("own")).distinct(), "asked-ids")
    seen = edges.filter(F.col("type").isin(*CONTEXT_TYPES))

    def refs(e: DataFrame, at: str, other: str, direction: str, ends: DataFrame, end: str = "own", kind: str = "") -> DataFrame:
        return e.join(ends, F.col(at) == F.col(end)).select(F.col("own").alias("id"), F.lit(direction).alias("direction"), (F.lit(kind) if kind else F.lower("type")).alias("type"), F.col(other).alias("uid"))

    out, into = refs(seen, "sourceId", "targetId", "outgoing", own), refs(seen, "targetId", "sourceId", "incoming", own)
    classes = nodes.filter("label in ('Class', 'Interface')").select(F.col("id").alias("own")).join(own, "own", "left_semi")
    makers = edges.filter("type = 'HAS_METHOD'").join(classes, F.col("sourceId") == F.col("own")).select("own", F.col("targetId").alias("m")).join(nodes.filter("label = 'Constructor'").select(F.col("id").alias("m")), "m", "left_semi")
    makers = committed(makers, "makers")  # few as a rule; their size is known once they are stored, and edges need not be shuffled
    calls = refs(edges.filter("type = 'CALLS'"), "targetId", "sourceId", "incoming", makers, "m", "calls")
    files = edges.filter("type = 'DEFINES'").join(classes, F.col("targetId") == F.col("own")).select("own", F.col("sourceId").alias("f"))
    files = committed(files, "files-of-classes")
    imports = refs(edges.filter("type = 'IMPORTS'"), "targetId", "sourceId", "incoming", files, "f", "imports")
    found = committed(out.union(into).union(calls).union(imports).distinct(), "references")
    about = likely(nodes.select(F.col("id").alias("uid"), "name", "label", "filePath"), ["uid"], found.select(F.col("uid").alias("id"))).filter("__likely").drop("__likely")
    return found.join(about, "uid").select("id", "direction", "type", "uid", "name", "label", "filePath")


def grouped_references(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "direction", "type").agg(F.array_sort(F.collect_list(F.struct("filePath", "uid", "name", "label"))).alias("refs"))


def participation(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """Flows that the ids take part in, with the step."""
    steps = edges.filter("type = 'STEP_IN_PROCESS'").join(of.select(F.col("id").alias("sourceId")), "sourceId", "left_semi")
    return steps.select(F.col("sourceId").alias("id"), F.col("targetId").alias("process"), "step").join(nodes.select(F.col("id").alias("process"), F.col("name").alias("process_name")), "process")


def process_steps(nodes: DataFrame, edges: DataFrame, processes: Iterable[str] | None = None) -> DataFrame:
    """(process, step, id, name, filePath), for some flows or all."""
    steps = edges.filter("type = 'STEP_IN_PROCESS'")
    if processes is not None:
        steps = steps.filter(F.col("targetId").isin(*processes))
    return steps.select(F.col("targetId").alias("process"), "step", F.col("sourceId").alias("id")).join(nodes.select("id", "name", "filePath"), "id")


def concept_query(nodes: DataFrame, edges: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """Flows by how often the text occurs in their names and their steps' names and paths; the first flows if it occurs nowhere."""
    needle, limit = text.lower(), min(max(limit, 1), 50)
    has = lambda c: F.coalesce(F.lower(c).contains(needle).cast("int"), F.lit(0))
    steps = process_steps(nodes, edges).groupBy("process").agg(F.sum(has(F.col("name")) + has(F.col("filePath"))).alias("hits"), F.count("*").alias("step_count"))
    flows = nodes.filter("label = 'Process'").join(steps, F.col("id") == F.col("process"), "left")
    scored = flows.select("id", "name", (has(F.col("name")) + F.coalesce("hits", F.lit(0))).alias("score"), F.coalesce("step_count", F.lit(0)).alias("step_count"))
    hit = scored.filter("score > 0")
    if hit.isEmpty():
        return scored.orderBy("id").limit(limit)
    return hit.orderBy(F.desc("score"), F.desc("step_count"), "name", "id").limit(limit)


def matching_definitions(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """The first classes and interfaces, in graph order, whose name or path contains the text."""
    needle = text.lower()
    return nodes.filter(F.col("label").isin("Class", "Interface") & (F.lower("name").contains(needle) | F.lower("filePath").contains(needle))).orderBy("id").limit(limit)


def calls_between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    calls = edges.filter("type = 'CALLS'")
    return calls.join(sources.select(F.col("id").alias("sourceId")), "sourceId", "left_semi").join(targets.select(F.col("id").alias("targetId")), "targetId", "left_semi").select("sourceId", "targetId", "type")


def list_processes(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    steps = edges.filter("type = 'STEP_IN_PROCESS'").groupBy(F.col("targetId").alias("id")).agg(F.count("*").alias("step_count"))
    return nodes.filter("label = 'Process'").select("id", "name").join(steps, "id", "left").fillna(0, ["step_count"]).orderBy(F.desc("step_count"), "id").limit(min(max(limit, 1), 500))


def clusters(communities: DataFrame, least: int = 5) -> DataFrame:
    """Communities (id, label, symbols, cohesion) of one label as one: sums, cohesion weighted by symbols, the largest's id."""
    total = communities.groupBy("label").agg(F.sum("symbols").alias("symbols"), (F.sum(F.col("cohesion") * F.col("symbols")) / F.sum("symbols")).alias("cohesion"), F.min_by("id", F.struct(-F.col("symbols"), "id")).alias("id"))
    return total.filter(F.col("symbols") >= least)


def cluster_members(nodes: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """The first members of each community, in edge order."""
    first = edges.filter("type = 'MEMBER_OF'").select(F.col("targetId").alias("community"), F.col("sourceId").alias("id")).distinct()
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("id"))).filter(F.col("r") <= most)
    return ranked.join(nodes.select("id", "name", "filePath"), "id").select("community", "id", "name", "filePath")

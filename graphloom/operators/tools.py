"""What stands around the queries: arguments, metadata, repositories, resources."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, functions as F

# Modes and limits of a search, and what a callable's metadata may hold.
MODES, USUAL_LIMIT, MOST_LIMIT = ("hybrid", "semantic", "bm25"), 10, 100
METHOD_KEYS = (
    "visibility", "isStatic", "isAbstract", "isFinal", "isVirtual", "isOverride", "isAsync", "isPartial",
    "returnType", "parameterCount", "isVariadic", "requiredParameterCount", "parameterTypes", "annotations",
)
# Labels whose nodes a vector search may hand back.
RESOURCES = ("repos", "setup", "repo/{name}/context", "repo/{name}/clusters", "repo/{name}/processes", "repo/{name}/schema", "repo/{name}/cluster/{cluster}", "repo/{name}/process/{process}")


def search_arguments(mode: str | None = "", limit: int | None = 0) -> tuple[str, int]:
    """(mode, limit) as they are meant: hybrid and 10 where nothing is said, never more than 100; another mode is an error."""
    wanted = (mode or "").strip().lower() or "hybrid"
    if wanted not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return wanted, USUAL_LIMIT if not limit or limit <= 0 else min(limit, MOST_LIMIT)


def method_metadata(nodes: DataFrame) -> DataFrame:
    """(id, metadata) of callables: those of the fourteen keys that the node has, as text."""
    held = [k for k in METHOD_KEYS if k in nodes.columns]
    callables = nodes.filter(F.col("label").isin("Method", "Function", "Constructor"))
    text = lambda k: F.to_json(F.col(k)) if nodes.schema[k].dataType.typeName() == "array" else F.col(k).cast("string")
    all_ = F.map_from_arrays(F.array(*map(F.lit, held)), F.array(*[text(k) for k in held])) if held else F.create_map().cast("map<string,string>")
    return callables.select("id", F.map_filter(all_, lambda _, v: v.isNotNull()).alias("metadata"))


def hydrated(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits of a vector search (nodeId, ...) with their node's name, label, file and lines; the label is read from the id, and unknown nodes go."""
    about = nodes.select(F.col("id").alias("nodeId"), "name", "label", "filePath", "startLine", "endLine")
    return found.join(about, "nodeId").filter(F.substring_index("nodeId", ":", 1) == F.col("label"))


def over_fetch(limit: int) -> int:
    """Rows to ask for first when several chunks of one node may be among them."""
    return max(4 * limit, limit + 8)


def resolve_repo(entries: list[dict], asked: str = "") -> dict:
    """The registered repository (name, path) meant by a name in any case or an absolute path; the only one where nothing is asked."""
    if not asked:
        if len(entries) == 1:
            return entries[0]
        raise LookupError("no repository is registered" if not entries else "name one of: " + ", ".join(sorted(e["name"] for e in entries)))
    if os.path.isabs(asked):
        hits = [e for e in entries if os.path.normpath(e["path"]) == os.path.normpath(asked)]
    else:
        hits = [e for e in entries if e["name"].lower() == asked.lower()]
    if len(hits) != 1:
        raise LookupError(f"{asked} is {'unknown' if not hits else 'ambiguous: ' + ', '.join(sorted(e['path'] for e in hits))}")
    return hits[0]


def commits_behind(root: str, commit: str) -> int | None:
    """Commits of the working tree's HEAD that an index of `commit` lacks; null where git cannot tell."""
    try:
        out = subprocess.run(["git", "-C", root, "rev-list", "--count", f"{commit}..HEAD"], capture_output=True, text=True, timeout=30, check=True)
        return int(out.stdout.strip())
    except (OSError, ValueError, subprocess.SubprocessError):
        return None


def resource(uri: str) -> tuple[str, dict[str, str]]:
    """(template, values) of a resource's address; an unknown one is an error."""
    parts = uri.split("://", 1)[-1].strip("/").split("/")
    for template in RESOURCES:
        names = template.split("/")
        if len(names) == len(parts) and all(n.startswith("{") or n == p for n, p in zip(names, parts)):
            return template, {n[1:-1]: p for n, p in zip(names, parts) if n.startswith("{")}
    raise LookupError(f"no resource {uri}")


def prompts() -> dict[str, str]:
    """Questions to begin with, by name."""
    return {
        "detect_impact": "Use impact on each symbol that detect_changes reports, then sum up risk by flow.",
        "generate_map": "List clusters and processes, then describe how the flows pass through the clusters.",
    }

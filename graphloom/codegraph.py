"""One object for a stored graph: each tool is a method that returns a DataFrame (or a small dict where it decides)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import impact as impact_, lookup, routes, search, store, text
from .plans import cypher as cypher_
from .plans.analyze import analyze, communities_and_flows, inheritance
from .sources.files import IgnoreRules, walk


@dataclass
class CodeGraph:
    """nodes and edges with the methods of the query tools."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of_folder(cls, spark: SparkSession, root: str, ignore: list[str] = (), with_inheritance: bool = True) -> "CodeGraph":
        g = cls(*analyze(walk(spark, root, IgnoreRules(ignore))))
        g = g.with_inheritance() if with_inheritance else g
        return g.with_communities_and_flows()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CodeGraph":
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def save(self, path: str, strict: bool = False) -> int:
        return store.write_graph(self.nodes, self.edges, path, strict)

    def with_inheritance(self) -> "CodeGraph":
        more = inheritance(self.nodes, self.edges).withColumn("id", F.concat_ws(":", F.lit("rel"), "type", F.concat_ws("->", "sourceId", "targetId")))
        return CodeGraph(self.nodes, self.edges.unionByName(more, allowMissingColumns=True))

    def with_communities_and_flows(self) -> "CodeGraph":
        return CodeGraph(*communities_and_flows(self.nodes, self.edges))

    def resolve(self, name: str = "", uid: str = "", file_path: str = "", kind: str = "") -> tuple[str, list]:
        return lookup.best_candidate(lookup.candidates(self.nodes, name, uid, file_path, kind))

    def context(self, name: str = "", uid: str = "", file_path: str = "", kind: str = "") -> dict:
        status, rows = self.resolve(name, uid, file_path, kind)
        if status != "found":
            return {"status": status, "candidates": [r.asDict() for r in rows]}
        one = self.nodes.filter(F.col("id") == rows[0].id)
        return {"status": status, "symbol": rows[0].asDict(), "references": lookup.grouped_references(lookup.references(self.nodes, self.edges, one)), "processes": lookup.participation(self.nodes, self.edges, one)}

    def impact(self, target: str, **options) -> dict:
        """target: an id, or a name that means one symbol."""
        status, rows = self.resolve(uid=target) if not self.nodes.filter(F.col("id") == target).isEmpty() else self.resolve(target)
        if status != "found":
            return {"status": status, "candidates": [r.asDict() for r in rows]}
        found = impact_.impact(self.nodes, self.edges, rows[0].id, impact_.Options(**options))
        return {"status": status, "target": rows[0].id, "by_depth": impact_.by_depth(found), "processes": impact_.affected_processes(found, self.edges, self.nodes), "modules": impact_.affected_modules(found, self.edges, self.nodes), "summary": impact_.summary(found, self.edges, self.nodes)}

    def query(self, words: str, limit: int = 5) -> DataFrame:
        return lookup.concept_query(self.nodes, self.edges, words, limit)

    def cypher(self, query: str) -> DataFrame:
        return cypher_.run(query, self.nodes, self.edges)

    def detect_changes(self, diff: str) -> dict:
        spark = self.nodes.sparkSession
        hunks = spark.createDataFrame(text.parse_diff(diff), "filePath string, startLine int, endLine int, deleted boolean")
        changed = text.changed_symbols(self.nodes, hunks)
        flows = text.changed_processes(changed, self.edges)
        return {"symbols": changed, "processes": flows, "risk": flows.agg(text.change_risk(F.count("*")).alias("risk"))}

    def rename(self, target: str, new: str) -> DataFrame:
        old = self.nodes.filter(F.col("id") == target).select("name").first()
        files = self.nodes.filter("label = 'File'").select("filePath", "content")
        return text.rename_preview(self.nodes, self.edges, files, target, old.name, new)

    def grep(self, pattern: str, limit: int = 50) -> DataFrame:
        return text.grep(self.nodes.filter("label = 'File'").select("filePath", "content"), pattern, limit)

    def route_map(self, words: str = "") -> DataFrame:
        return routes.route_map(self.nodes, self.edges, words)

    def _consumers(self) -> tuple[DataFrame, DataFrame]:
        empty = F.array().cast("array<string>")
        held = lambda c: F.coalesce(F.col(c), empty).alias(c)
        r = self.nodes.filter("label = 'Route'").select(F.col("id").alias("route"), held("responseKeys"), held("errorKeys"))
        c = self.edges.filter("type = 'FETCHES'").select(F.col("targetId").alias("route"), F.col("sourceId").alias("consumer"), routes.reason_keys(F.col("reason")).alias("keys"), routes.reason_fetches(F.col("reason")).alias("fetches"))
        return r, c

    def shape_check(self) -> DataFrame:
        return routes.shape_check(*self._consumers())

    def api_impact(self) -> DataFrame:
        """Risk of each route with the flows that enter there and its middleware."""
        flows_ = self.edges.filter("type = 'ENTRY_POINT_OF'").groupBy(F.col("sourceId").alias("route")).agg(F.array_sort(F.collect_set("targetId")).alias("flows"))
        about = self.nodes.filter("label = 'Route'").select(F.col("id").alias("route"), "middleware")
        return routes.api_impact(*self._consumers()).join(flows_, "route", "left").join(about, "route", "left")

    def tool_map(self, words: str = "") -> DataFrame:
        found = self.nodes.filter("label = 'Tool'")
        return found.filter(F.col("name").contains(words)) if words else found

    def search(self, words: str, limit: int = 10) -> DataFrame:
        scored = search.bm25(self.nodes.filter("label in ('File', 'Function', 'Class', 'Method', 'Interface')").withColumn("text", F.concat_ws(" ", "name", "content")), words, text_col="text")
        return search.summed_by_file(scored.join(self.nodes.select("id", "label", "filePath"), "id"), limit).orderBy(F.desc("score"), "filePath").limit(limit)

    def ndjson(self, with_content: bool = False) -> DataFrame:
        """Lines of JSON, nodes first (column order), one for each node and relationship."""
        nodes = self.nodes if with_content else self.nodes.drop("content")
        line = lambda df, kind, n: df.select(F.lit(n).alias("part"), F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))
        return line(nodes, "node", 0).union(line(self.edges, "relationship", 1))

    def stats(self) -> str:
        return json.dumps({"nodes": self.nodes.count(), "edges": {r.type: r.n for r in store.edge_counts(self.edges).collect()}})

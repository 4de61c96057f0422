"""Comparing results: recall and precision of sets, shadow runs, digests, benchmark differences."""

from __future__ import annotations

import ast
import json

from pyspark.sql import Column, DataFrame, functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, 2))


def recall_precision(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """One row: matched, expected, candidates, recall and precision in percent."""
    e, f = expected.select(*key).distinct().withColumn("e", F.lit(1)), found.select(*key).distinct().withColumn("f", F.lit(1))
    n = e.join(f, key, "full").agg(F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("matched"), F.count("e").alias("expected"), F.count("f").alias("candidates"))
    return n.select("*", percent(F.col("matched"), F.col("expected")).alias("recall"), percent(F.col("matched"), F.col("candidates")).alias("precision"))


def shadow(baseline: DataFrame, new: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, language, status) of call sites under two resolvers (site, def)."""
    j = sites.join(baseline.select("site", F.col("def").alias("x")), "site", "left").join(new.select("site", F.col("def").alias("y")), "site", "left")
    both = F.when(F.col("x") == F.col("y"), "both-agree").otherwise("both-disagree")
    return j.select("site", "language", F.when(F.col("x").isNull() & F.col("y").isNull(), "both-empty").when(F.col("y").isNull(), "only-baseline").when(F.col("x").isNull(), "only-new").otherwise(both).alias("status"))


def shadow_parity(rows: DataFrame) -> DataFrame:
    """(language, total, agree, empty, parity) for each language and, with a null language, for all."""
    g = rows.rollup("language").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "both-agree").alias("agree"), F.count_if(F.col("status") == "both-empty").alias("empty"))
    return g.withColumn("parity", F.when(F.col("total") == F.col("empty"), 1.0).otherwise(F.col("agree") / (F.col("total") - F.col("empty"))))


def edge_digest(edges: DataFrame) -> DataFrame:
    """(type, n, digest): edges of each type as an order-free sum of row hashes, so that no list is gathered."""
    line = F.concat_ws("|", F.concat_ws("#", "type", F.coalesce(F.col("step").cast("string"), F.lit(""))), "sourceId", "targetId")
    parts = [F.conv(F.substring(F.sha2(line, 256), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(2)]
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.sum(parts[0]).alias("digest1"), F.sum(parts[1]).alias("digest2"))


def benchmark_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta, percent); no percent from 0."""
    j = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full")
    return j.withColumn("delta", F.col("after") - F.col("before")).withColumn("percent", F.when(F.col("before") != 0, 100 * F.col("delta") / F.col("before")))


def examples(expected: DataFrame, found: DataFrame, key: list[str], most: int = 20) -> DataFrame:
    """(kind, key columns): the first missing and surplus members of two sets, in order."""
    e, f = expected.select(*key).distinct(), found.select(*key).distinct()
    first = lambda df, kind: df.orderBy(*key).limit(most).select(F.lit(kind).alias("kind"), *key)
    return first(e.join(f, key, "left_anti"), "missing").union(first(f.join(e, key, "left_anti"), "surplus"))


def failed_gates(scores: DataFrame, least: float = 100.0) -> DataFrame:
    """(name, measure, value) of recalls and precisions (name, recall, precision) below the gate."""
    long = scores.select("name", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("recall", "precision")])).alias("g")).select("name", "g.*")
    return long.filter(F.col("value") < least)


def sorted_digest(edges: DataFrame) -> DataFrame:
    """(type, digest): sha256 of the sorted lines `TYPE#step|source|target` of each type. A type's lines are gathered: for comparing
    small graphs line by line; edge_digest is for any size."""
    line = F.concat_ws("|", F.concat_ws("#", "type", F.coalesce(F.col("step").cast("string"), F.lit(""))), "sourceId", "targetId")
    return edges.groupBy("type").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def python_truth(files: DataFrame) -> DataFrame:
    """(fact, filePath, name, line) that Python's own parser finds: definitions, imports and direct calls by plain names. What
    the analysis finds is held against these."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for f in batch.itertuples():
                try:
                    tree = ast.parse(f.content or "")
                except (SyntaxError, ValueError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        rows.append(("definition", f.filePath, n.name, n.lineno))
                    elif isinstance(n, (ast.Import, ast.ImportFrom)):
                        rows += [("import", f.filePath, a.name, n.lineno) for a in n.names]
                    elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
                        rows.append(("call", f.filePath, n.func.id, n.lineno))
            yield pd.DataFrame(rows, columns=["fact", "filePath", "name", "line"])

    return files.filter("language = 'python'").select("filePath", "content").mapInPandas(run, "fact string, filePath string, name string, line long")


#: Members that a question about one cluster, and about several, names.
ONE_MEMBERS, BATCH_MEMBERS = 20, 15


def cluster_prompts(communities: DataFrame, members: DataFrame, most: int = ONE_MEMBERS) -> DataFrame:
    """(community, prompt, tokens): a question for a name and a description of each cluster (community, label) with its first members
    (community, name, kind, in order of id), and how many tokens it is (a quarter of its characters)."""
    listed = members.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("id", "name", "kind"))).alias("m"))
    text = F.array_join(F.transform(F.slice("m", 1, most), lambda x: F.concat(x["name"], F.lit(" ("), x["kind"], F.lit(")"))), ", ")
    more = F.when(F.size("m") > most, F.concat(F.lit(" (+"), (F.size("m") - most).cast("string"), F.lit(" more)"))).otherwise("")
    prompt = F.concat(F.lit("Name this cluster of code and describe it in a sentence.\nHeuristic: "), "label", F.lit("\nMembers: "), text, more, F.lit('\nAnswer in JSON: {"name": ..., "keywords": [...], "description": ...}'))
    return communities.join(listed, "community").select("community", prompt.alias("prompt")).withColumn("tokens", F.length("prompt") / 4)


def parse_enrichment(answer: str, label: str) -> dict:
    """name, keywords and description in a model's answer: the JSON between its first and last brace; the label where there is none."""
    plain = {"name": label, "keywords": [], "description": ""}
    a, b = answer.find("{"), answer.rfind("}")
    if a < 0 or b < a:
        return plain
    try:
        found = json.loads(answer[a : b + 1])
    except ValueError:
        return plain
    if not isinstance(found, dict):
        return plain
    return {"name": found.get("name") or label, "keywords": found.get("keywords") or [], "description": found.get("description") or ""}


def parse_batch(answer: str) -> dict[str, dict]:
    """The same for an answer about several clusters: a JSON list of objects with ids; without one, nothing."""
    a, b = answer.find("["), answer.rfind("]")
    try:
        found = json.loads(answer[a : b + 1]) if 0 <= a < b else []
    except ValueError:
        found = []
    return {x["id"]: {"name": x.get("name") or "", "keywords": x.get("keywords") or [], "description": x.get("description") or ""} for x in found if isinstance(x, dict) and x.get("id")}

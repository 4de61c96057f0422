"""Execution flows: entry points, traces of calls, and what is kept of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import is_test_file
from ..workspace import committed

#: What defines the traces: entry points, branches of a step, steps, least steps, traces of an entry point.
ENTRIES, BRANCHES, DEPTH, LEAST, TRACES = 200, 4, 10, 3, 12


def call_graph(edges: DataFrame) -> DataFrame:
    """(a, b) of calls that are sure enough; repeated calls stay."""
    return edges.filter("type = 'CALLS' and (confidence = 0 or confidence >= 0.5)").select(F.col("sourceId").alias("a"), F.col("targetId").alias("b"))


def name_score(name: Column) -> Column:
    # Names that begin programs and requests.
    n = F.lower(name)
    return F.when(n.isin("main", "run", "start"), 5).when(n.startswith("handle") | n.startswith("on"), 4).when(n.startswith("create") | n.startswith("update") | n.startswith("delete") | n.contains("controller") | n.contains("command"), 3).otherwise(1)


def entry_scores(nodes: DataFrame, edges: DataFrame, limit: int = ENTRIES) -> DataFrame:
    """(id, score), best first: 3 for each callee, -2 for each caller, the name's score, 2 if exported, times a framework's
    multiplier above 1; tests, and symbols that call nothing or score nothing, are none."""
    calls = call_graph(edges)
    out = calls.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("callees"))
    into = calls.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("callers"))
    has = lambda c, value: F.coalesce(F.col(c), F.lit(value)) if c in nodes.columns else F.lit(value)
    s = nodes.filter(F.col("label").isin("Function", "Method") & ~is_test_file(F.col("filePath"))).join(out, "id").join(into, "id", "left")
    score = 3.0 * F.col("callees") - 2 * F.coalesce("callers", F.lit(0)) + name_score(F.col("name")) + F.when(has("isExported", False), 2).otherwise(0)
    times = has("astFrameworkMultiplier", 0.0)
    s = s.select("id", F.when(times > 1, F.round(score * times, 2)).otherwise(score).alias("score")).filter("score > 0")
    return s.orderBy(F.desc("score"), "id").limit(limit)


def traces(edges: DataFrame, entries: DataFrame, branches: int = BRANCHES, depth: int = DEPTH, least: int = LEAST, most: int = TRACES) -> DataFrame:
    """(entry, trace): the first `most` simple paths of each entry point, in the order in which they end when paths are
    followed breadth first over the first `branches` calls of a symbol (sorted; a call that repeats takes a place and is followed
    again). A path ends at a leaf, at a dead end or at the depth, and counts from `least` symbols on. An entry point is followed until it has its
    paths; before that none of its paths is left out, of which there are at most branches to the power of the depth."""
    callees = call_graph(edges).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("r") <= branches).groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "b"))), lambda x: x["b"]).alias("next"))
    callees = committed(callees, "callees")
    level = committed(entries.select(F.col("id").alias("entry"), F.array("id").alias("trace"), F.array().cast("array<int>").alias("way")), "traces")
    ended = None
    for _ in range(depth):
        j = level.join(callees.withColumnRenamed("a", "tip"), F.element_at("trace", -1) == F.col("tip"), "left")
        fresh = F.filter(F.transform(F.coalesce("next", F.array().cast("array<string>")), lambda x, i: F.struct(x.alias("b"), i.cast("int").alias("i"))), lambda x: ~F.array_contains("trace", x["b"]))
        j = j.withColumn("next", fresh)
        stop = (F.size("next") == 0) | (F.size("trace") >= depth)
        over = committed(j.filter(stop & (F.size("trace") >= least)).select("entry", "trace", "way"), "traces-ended")
        ended = over if ended is None else ended.union(over)
        full = ended.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("entry")
        on = j.filter(~stop).join(full, "entry", "left_anti").withColumn("x", F.explode("next"))
        level = committed(on.select("entry", F.concat("trace", F.array("x.b")).alias("trace"), F.concat("way", F.array("x.i")).alias("way")), "traces")
        if level.isEmpty():
            break
    ranked = ended.withColumn("r", F.row_number().over(Window.partitionBy("entry").orderBy(F.size("trace"), "way"))).filter(F.col("r") <= most)
    return ranked.select("entry", "trace")


def without_parts(found: DataFrame) -> DataFrame:
    """Traces that are no part of a longer one (as text joined by arrows), then the longest of each pair of ends. A part
    shares its first node with the whole, at some place: traces are compared only where one holds the other's first node."""
    t = found.select("entry", "trace", F.array_join("trace", "->").alias("text")).distinct()
    longer = t.select(F.col("text").alias("whole"), F.explode("trace").alias("node"))
    parts = t.join(longer, F.element_at("trace", 1) == F.col("node")).filter("length(whole) > length(text) and contains(whole, text)").select("text").distinct()
    kept = t.join(parts, "text", "left_anti")
    ends = Window.partitionBy(F.element_at("trace", 1), F.element_at("trace", -1)).orderBy(F.desc(F.size("trace")), "text")
    return kept.withColumn("r", F.row_number().over(ends)).filter("r = 1").select("entry", "trace")


def process_budget(symbols: Column, cap: int = 700) -> Column:
    return F.greatest(F.lit(20), F.least(F.round(symbols / 10), F.lit(cap))).cast("int")


def processes(nodes: DataFrame, kept: DataFrame, members: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(process nodes, ENTRY_POINT_OF and STEP_IN_PROCESS edges) of the longest traces, within the budget."""
    top = kept.orderBy(F.desc(F.size("trace")), F.array_join("trace", "->")).limit(budget)
    named = top.join(nodes.select(F.col("id").alias("entry"), "name"), "entry", "left")
    clean = F.regexp_replace(F.lower(F.coalesce("name", "entry")), "[^a-z0-9]+", "_")
    order = Window.orderBy(F.desc(F.size("trace")), F.array_join("trace", "->"))
    p = named.withColumn("id", F.concat(F.lit("proc_"), (F.row_number().over(order) - 1).cast("string"), F.lit("_"), clean))
    p = committed(p, "processes")
    steps = p.select("id", F.posexplode("trace").alias("at", "symbol"))
    inside = steps.join(members.select(F.col("id").alias("symbol"), "community"), "symbol").groupBy("id").agg(F.array_sort(F.collect_set("community")).alias("communities"))
    made = p.join(inside, "id", "left").select("id", F.lit("Process").alias("label"), "name", F.when(F.size("communities") > 1, "cross_community").otherwise("intra_community").alias("processType"), F.size("trace").alias("stepCount"), "communities", F.col("entry").alias("entryPointId"), F.element_at("trace", -1).alias("terminalId"))
    enters = p.select(F.col("entry").alias("sourceId"), F.col("id").alias("targetId"), F.lit("ENTRY_POINT_OF").alias("type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("int").alias("step"))
    walked = steps.select(F.col("symbol").alias("sourceId"), F.col("id").alias("targetId"), F.lit("STEP_IN_PROCESS").alias("type"), F.lit(1.0).alias("confidence"), (F.col("at") + 1).cast("int").alias("step"))
    return made, enters.union(walked)


def resource_links(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """ENTRY_POINT_OF from routes and tools to the flows that enter in the same file."""
    entry = made.select(F.col("id").alias("targetId"), F.col("entryPointId").alias("e")).join(nodes.select(F.col("id").alias("e"), "filePath"), "e")
    return nodes.filter("label in ('Route', 'Tool')").select(F.col("id").alias("sourceId"), "filePath").join(entry, "filePath").select("sourceId", "targetId", F.lit("ENTRY_POINT_OF").alias("type"), F.lit(0.85).alias("confidence"))


def trace_frame(traces_: list[list[str]]) -> pd.DataFrame:
    return pd.DataFrame({"entry": [t[0] for t in traces_], "trace": traces_})

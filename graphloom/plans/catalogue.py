"""Queries over the test tables: each operator applied to the projected graph, with the same question in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import is_test_path, normal_url
from ..operators import clusters, contracts, flows, impact, lookup, quality, resolution, routes, search, store, structure, text
from ..sources.projection import graph, tables, with_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BRAND, SUPPLIER, CUSTOMER = "Interface:Brand#11", "Class:s1", "Function:c1"


def query(sql: str | None = None, on_graph: bool = True):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_graph(sql) if on_graph else sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_brand(spark: SparkSession, sf_dir: str) -> str:
    return "Interface:" + _table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]


IS_TEST = "(lower({p}) LIKE '%/test/%' OR lower({p}) LIKE '%/tests/%' OR lower({p}) LIKE 'test/%' OR lower({p}) LIKE 'tests/%' OR lower({p}) LIKE '%.test.ts' OR lower({p}) LIKE '%.spec.ts')"
NOT_TEST = f"NOT coalesce({IS_TEST.format(p='filePath')}, false)"


def _bfs_sql(seed: str, upstream: bool, depth: int, edge_filter: str = "true", node_filter: str = NOT_TEST) -> str:
    a, b = ("targetId", "sourceId") if upstream else ("sourceId", "targetId")
    return f"""
    WITH RECURSIVE usable AS (SELECT {a} AS a, {b} AS b FROM edges WHERE type IN ('CALLS','IMPORTS','EXTENDS','IMPLEMENTS','INHERITS','USES','METHOD_OVERRIDES','OVERRIDES','METHOD_IMPLEMENTS') AND {edge_filter}),
    seen AS (SELECT id FROM nodes WHERE {node_filter}),
    own AS ({seed}),
    walk AS (SELECT id, 0 AS depth FROM own UNION SELECT usable.b, walk.depth + 1 FROM walk JOIN usable ON usable.a = walk.id JOIN seen ON seen.id = usable.b WHERE walk.depth < {depth}),
    hit AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY id HAVING min(depth) > 0)
    """


BRAND_SEED = "SELECT 'Interface:' || min(p_brand) AS id FROM part"
CUSTOMER_SEED = f"SELECT '{CUSTOMER}' AS id"
SUPPLIER_SEED = f"SELECT '{SUPPLIER}' AS id UNION SELECT targetId FROM edges WHERE type = 'HAS_METHOD' AND sourceId = '{SUPPLIER}'"


@query(_bfs_sql(BRAND_SEED, True, 3) + "SELECT id, depth FROM hit")
def impact_upstream(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.impact(n, e, _first_brand(spark, sf_dir)).select("id", "depth")


@query(_bfs_sql(CUSTOMER_SEED, False, 3) + "SELECT id, depth FROM hit")
def impact_downstream(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.impact(n, e, CUSTOMER, impact.Options("downstream")).select("id", "depth")


@query(_bfs_sql(BRAND_SEED, True, 2, "confidence >= 0.95") + "SELECT id, depth FROM hit")
def impact_min_confidence(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.impact(n, e, _first_brand(spark, sf_dir), impact.Options(max_depth=2, min_confidence=0.95)).select("id", "depth")


@query(_bfs_sql(BRAND_SEED, True, 2, node_filter="true") + "SELECT id, depth FROM hit")
def impact_include_tests(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.impact(n, e, _first_brand(spark, sf_dir), impact.Options(max_depth=2, include_tests=True)).select("id", "depth")


@query(_bfs_sql(SUPPLIER_SEED, True, 2) + "SELECT h.id, h.depth FROM hit h LEFT JOIN own ON own.id = h.id WHERE own.id IS NULL")
def impact_class_seeds(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.impact(n, e, SUPPLIER, impact.Options(max_depth=2)).select("id", "depth")


@query(_bfs_sql(BRAND_SEED, True, 1) + "SELECT e.targetId AS id, count(*) AS hits, min(e.step) AS earliest_step, any_value(n.name) AS name FROM edges e JOIN hit ON hit.id = e.sourceId JOIN nodes n ON n.id = e.targetId WHERE e.type = 'STEP_IN_PROCESS' GROUP BY e.targetId")
def impact_affected_processes(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.affected_processes(impact.impact(n, e, _first_brand(spark, sf_dir), impact.Options(max_depth=1)), e, n)


@query(_bfs_sql(BRAND_SEED, True, 3) + "SELECT e.targetId AS id, count(*) AS hits, min(hit.depth) = 1 AS direct, any_value(n.name) AS name FROM edges e JOIN hit ON hit.id = e.sourceId JOIN nodes n ON n.id = e.targetId WHERE e.type = 'MEMBER_OF' GROUP BY e.targetId")
def impact_affected_modules(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.affected_modules(impact.impact(n, e, _first_brand(spark, sf_dir)), e, n)


@query(_bfs_sql(BRAND_SEED, True, 3) + """, counts AS (SELECT count(*) AS impacted, count(*) FILTER (depth = 1) AS direct FROM hit),
p AS (SELECT count(DISTINCT targetId) AS processes FROM edges JOIN hit ON id_of(edges) = hit.id WHERE type = 'STEP_IN_PROCESS'), m AS (SELECT count(DISTINCT targetId) AS modules FROM edges JOIN hit ON id_of(edges) = hit.id WHERE type = 'MEMBER_OF')
SELECT impacted, direct, processes, modules, CASE WHEN direct >= 30 OR processes >= 5 OR modules >= 5 OR impacted >= 200 THEN 'CRITICAL' WHEN direct >= 15 OR processes >= 3 OR modules >= 3 OR impacted >= 100 THEN 'HIGH' WHEN direct >= 5 OR impacted >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM counts, p, m""".replace("id_of(edges)", "edges.sourceId"))
def impact_risk(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.summary(impact.impact(n, e, _first_brand(spark, sf_dir)), e, n)


@query("SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_counts_by_type(spark, sf_dir):
    return store.edge_counts(graph(spark, sf_dir)[1])


@query("SELECT id, type, sourceId, targetId FROM edges ORDER BY type, sourceId, targetId, id LIMIT 500")
def sorted_edges_topk(spark, sf_dir):
    return store.sorted_edges(graph(spark, sf_dir)[1]).select("id", "type", "sourceId", "targetId").limit(500)


@query("SELECT id FROM edges WHERE sourceId NOT IN (SELECT id FROM nodes WHERE label = 'Class') AND targetId NOT IN (SELECT id FROM nodes WHERE label = 'Class')")
def remove_node_cascade(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return store.without_nodes(n, e, n.filter("label = 'Class'"))[1].select("id")


@query("WITH gone AS (SELECT id FROM nodes WHERE filePath LIKE 'lib/%/part.ts') SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS nodes, (SELECT count(*) FROM edges WHERE sourceId NOT IN (SELECT id FROM gone) AND targetId NOT IN (SELECT id FROM gone)) AS edges, (SELECT count(*) FROM gone) AS removed")
def remove_by_file_cascade(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    a, b, gone = store.without_files(n, e, n.filter("filePath like 'lib/%/part.ts'").select("filePath"))
    one = [x.agg(F.count("*").alias(k)).withColumn("k", F.lit(1)) for x, k in ((a, "nodes"), (b, "edges"), (gone, "removed"))]
    return one[0].join(one[1], "k").join(one[2], "k").drop("k")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value, min(event_id) AS seq FROM events GROUP BY user_id", False)
def upsert_last_wins(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", "value", F.col("event_id").alias("seq"))
    return store.upsert(e).select("id", "event_type", F.round("value", 6).alias("value"), "seq")


@query("SELECT l_orderkey AS sourceId, l_partkey AS targetId, 'CALLS' AS type, max(round(1.0 - l_discount, 2)) AS confidence, arg_min('e' || l_linenumber, l_linenumber * 10000000 + l_suppkey) AS id, arg_max(l_returnflag, {'c': round(1.0 - l_discount, 2), 's': l_linenumber * 10000000 + l_suppkey}) AS reason FROM lineitem GROUP BY l_orderkey, l_partkey", False)
def semantic_edge_merge(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").alias("sourceId"), F.col("l_partkey").alias("targetId"), F.lit("CALLS").alias("type"), F.round(1.0 - F.col("l_discount"), 2).alias("confidence"), F.col("l_returnflag").alias("reason"), (F.col("l_linenumber") * 10_000_000 + F.col("l_suppkey")).alias("seq"))
    return store.merged_edges(line)


@query("""WITH RECURSIVE both_ways AS (SELECT sourceId AS a, targetId AS b FROM edges WHERE type <> 'STEP_IN_PROCESS' UNION SELECT targetId, sourceId FROM edges WHERE type <> 'STEP_IN_PROCESS'),
walk AS (SELECT 'Community:' || min(n_name) AS id, 0 AS depth FROM nation UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = walk.id WHERE depth < 2) SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY id""")
def khop_neighborhood(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    start = spark.table("nation").agg(F.concat(F.lit("Community:"), F.min("n_name")).alias("id"))
    return store.neighbourhood(e.filter("type <> 'STEP_IN_PROCESS'"), start, 2)


@query("SELECT id, label FROM nodes WHERE label IN ('Class', 'Interface', 'Folder')")
def label_filter(spark, sf_dir):
    return store.with_labels(graph(spark, sf_dir)[0], ["Class", "Interface", "Folder"]).select("id", "label")


@query("""WITH near AS (SELECT targetId AS id FROM edges WHERE sourceId = 'Class:s1' UNION SELECT sourceId FROM edges WHERE targetId = 'Class:s1' UNION SELECT 'Class:s1') SELECT nodes.id, label FROM nodes JOIN near USING (id) WHERE label IN ('Class', 'Method')""")
def depth_label_filter(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return store.visible(n, e, ["Class", "Method"], spark.createDataFrame([(SUPPLIER,)], "id string"), 1).select("id", "label")


@query("WITH ends AS (SELECT e.id, e.type, CASE WHEN e.confidence = 0 THEN 1.0 ELSE e.confidence END AS confidence, coalesce(e.step, 0) AS step, a.label AS from_label, b.label AS to_label FROM edges e JOIN nodes a ON a.id = e.sourceId JOIN nodes b ON b.id = e.targetId) SELECT from_label, to_label, type, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps, round(sum(confidence), 4) AS confidence FROM ends GROUP BY ALL")
def export_label_pairs(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    kept = store.export_tables(n, e)[1]
    return kept.groupBy("from_label", "to_label", "type").agg(F.count("*").alias("n"), F.sum("step").alias("steps"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("WITH known AS (SELECT id FROM nodes WHERE coalesce(filePath, '') NOT LIKE 'tests/%') SELECT type, count(*) AS n FROM edges WHERE sourceId NOT IN (SELECT id FROM known) OR targetId NOT IN (SELECT id FROM known) GROUP BY type")
def export_skipped(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return store.export_tables(n.filter("coalesce(filePath, '') not like 'tests/%'"), e)[2].groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT id, CAST(CASE WHEN name = 'order1' THEN 0.9 WHEN lower(name) = 'order1' THEN 0.75 ELSE 0.5 END + 0.2 AS DOUBLE) AS score FROM nodes WHERE lower(name) LIKE '%order1%' AND lower(filePath) LIKE '%src/orders/1%'")
def candidate_score(spark, sf_dir):
    return lookup.candidates(graph(spark, sf_dir)[0], "order1", file_path="src/orders/1").select("id", "score")


@query("""WITH refs AS (SELECT sourceId AS id, 'outgoing' AS direction, lower(type) AS type, targetId AS uid FROM edges WHERE type IN ('CALLS','EXTENDS','IMPLEMENTS','USES','HAS_METHOD') UNION SELECT targetId, 'incoming', lower(type), sourceId FROM edges WHERE type IN ('CALLS','EXTENDS','IMPLEMENTS','USES','HAS_METHOD'))
SELECT refs.id, direction, type, uid, name, label, filePath FROM refs JOIN nodes ON nodes.id = uid WHERE refs.id LIKE 'Class:s%'""")
def context_refs(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return lookup.references(n, e, n.filter("label = 'Class'"))


@query("SELECT e.sourceId AS id, e.targetId AS process, e.step, n.name AS process_name FROM edges e JOIN nodes n ON n.id = e.targetId JOIN nodes f ON f.id = e.sourceId WHERE e.type = 'STEP_IN_PROCESS' AND f.label = 'Function' AND n.label = 'Process'")
def context_processes(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return lookup.participation(n, e, n.filter("label = 'Function'").select("id"))


@query("""WITH steps AS (SELECT e.targetId AS process, sum(CAST(coalesce(contains(lower(n.name), 'steel'), false) AS INT) + CAST(coalesce(contains(lower(n.filePath), 'steel'), false) AS INT)) AS hits, count(*) AS step_count FROM edges e JOIN nodes n ON n.id = e.sourceId WHERE e.type = 'STEP_IN_PROCESS' GROUP BY e.targetId),
scored AS (SELECT id, name, CAST(CAST(contains(lower(name), 'steel') AS INT) + coalesce(hits, 0) AS BIGINT) AS score, coalesce(step_count, 0) AS step_count FROM nodes LEFT JOIN steps ON process = id WHERE label = 'Process'),
hit AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, step_count DESC, name, id LIMIT 20), fallback AS (SELECT * FROM scored WHERE (SELECT count(*) FROM hit) = 0 ORDER BY id LIMIT 20) SELECT * FROM hit UNION ALL SELECT * FROM fallback""")
def concept_query(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return lookup.concept_query(n, e, "steel", 20)


@query("SELECT id, name FROM nodes WHERE label IN ('Class', 'Interface') AND (contains(lower(name), '1') OR contains(lower(filePath), '1')) ORDER BY id LIMIT 25")
def matching_definitions(spark, sf_dir):
    return lookup.matching_definitions(graph(spark, sf_dir)[0], "1", 25).select("id", "name")


@query("SELECT e.targetId AS process, e.step, e.sourceId AS id, n.name, n.filePath FROM edges e JOIN nodes n ON n.id = e.sourceId WHERE e.type = 'STEP_IN_PROCESS'")
def process_steps(spark, sf_dir):
    return lookup.process_steps(*graph(spark, sf_dir)).select("process", "step", "id", "name", "filePath")


@query("SELECT sourceId, targetId, type FROM edges WHERE type = 'CALLS' AND sourceId IN (SELECT id FROM nodes WHERE filePath LIKE 'src/orders/1%') AND targetId IN (SELECT id FROM nodes WHERE filePath LIKE 'lib/%')")
def call_edges_between(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return lookup.calls_between(e, n.filter("filePath like 'src/orders/1%'"), n.filter("filePath like 'lib/%'"))


@query("SELECT id, name, filePath FROM nodes WHERE label = 'Interface' ORDER BY id LIMIT 50")
def nodes_by_label(spark, sf_dir):
    return store.with_labels(graph(spark, sf_dir)[0], ["Interface"]).select("id", "name", "filePath").orderBy("id").limit(50)


@query("SELECT id, sourceId, targetId FROM edges WHERE type = 'EXTENDS' ORDER BY sourceId, targetId LIMIT 500")
def edges_by_type(spark, sf_dir):
    return graph(spark, sf_dir)[1].filter("type = 'EXTENDS'").select("id", "sourceId", "targetId").orderBy("sourceId", "targetId").limit(500)


@query("WITH steps AS (SELECT targetId AS id, count(*) AS step_count FROM edges WHERE type = 'STEP_IN_PROCESS' GROUP BY targetId) SELECT nodes.id, name, coalesce(step_count, 0) AS step_count FROM nodes LEFT JOIN steps USING (id) WHERE label = 'Process' ORDER BY step_count DESC, id LIMIT 50")
def list_processes(spark, sf_dir):
    return lookup.list_processes(*graph(spark, sf_dir))


@query("WITH c AS (SELECT c_nationkey AS id, c_mktsegment AS label, count(*) AS symbols, round(avg(c_acctbal), 2) / 10000 AS cohesion FROM customer GROUP BY ALL) SELECT label, CAST(sum(symbols) AS BIGINT) AS symbols, round(sum(cohesion * symbols) / sum(symbols), 6) AS cohesion, arg_min(id, {'a': -symbols, 'b': id}) AS id FROM c GROUP BY label HAVING sum(symbols) >= 5", False)
def cluster_aggregate(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("symbols"), (F.round(F.avg("c_acctbal"), 2) / 10000).alias("cohesion"))
    return lookup.clusters(c).select("label", "symbols", F.round("cohesion", 6).alias("cohesion"), "id")


@query("WITH m AS (SELECT DISTINCT targetId AS community, sourceId AS id FROM edges WHERE type = 'MEMBER_OF'), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id) AS r FROM m) SELECT community, nodes.id, name, filePath FROM r JOIN nodes USING (id) WHERE r <= 30")
def cluster_members(spark, sf_dir):
    return lookup.cluster_members(*graph(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str, prefix: str = "doc") -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("filePath"), F.concat(F.lit("File:doc"), "doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("repo"), F.lit("File").alias("label"))


FILES = "files AS (SELECT 'docs/' || doc_id || '.txt' AS filePath, 'File:doc' || doc_id AS id, text AS content, source AS repo FROM documents)"
LINES = FILES + ", lines AS (SELECT filePath, unnest(string_split(regexp_replace(coalesce(content, ''), '\\n$', ''), chr(10))) AS text, unnest(range(1, 1 + len(string_split(regexp_replace(coalesce(content, ''), '\\n$', ''), chr(10))))) AS line FROM files)"


@query(f"WITH {LINES} SELECT filePath, line, substr(trim(text, ' '), 1, 200) AS text FROM lines WHERE regexp_matches(text, '(?i)worthless|trash') ORDER BY filePath, line LIMIT 200", False)
def grep_lines(spark, sf_dir):
    return text.grep(_files(spark, sf_dir), "worthless|trash", 200)


@query(f"WITH {LINES} SELECT filePath, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (line BETWEEN 2 AND 4), '') AS content, CAST(count(*) AS INT) AS total FROM lines GROUP BY filePath", False)
def file_slice(spark, sf_dir):
    return text.file_slice(_files(spark, sf_dir), 1, 3)


@query(f"WITH {LINES} SELECT filePath, line, text AS old, regexp_replace(text, '\\bidiot\\b', 'person', 'g') AS new, 'text_search' AS source FROM lines WHERE regexp_matches(text, '\\bidiot\\b')", False)
def rename_preview(spark, sf_dir):
    files = _files(spark, sf_dir)
    nodes = files.select("id", "filePath", F.lit(None).cast("long").alias("startLine")).union(spark.createDataFrame([("Function:x", "none", None)], "id string, filePath string, startLine long"))
    edges = files.select(F.concat(F.lit("rel"), "id").alias("id"), F.col("id").alias("sourceId"), F.lit("Function:x").alias("targetId"), F.lit("CALLS").alias("type"))
    edges = edges.withColumn("id", F.concat(F.lit("rel-"), F.regexp_replace("id", ":", "-")))
    return text.rename_preview(nodes, edges, files, "Function:x", "idiot", "person")


HUNKS = "hunks AS (SELECT DISTINCT 'orders/' || CAST(o_custkey % 50 AS VARCHAR) || '.ts' AS filePath, CAST(o_orderkey % 480 + 1 AS INT) AS startLine, CAST(o_orderkey % 480 + 3 AS INT) AS endLine FROM orders)"


def _hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("orders/"), (F.col("o_custkey") % 50).cast("string"), F.lit(".ts")).alias("filePath"), (F.col("o_orderkey") % 480 + 1).cast("int").alias("startLine"), (F.col("o_orderkey") % 480 + 3).cast("int").alias("endLine")).distinct()


@query(f"WITH {HUNKS} SELECT DISTINCT n.id, n.filePath, n.startLine, n.endLine FROM nodes n JOIN hunks h ON (lower(n.filePath) = h.filePath OR lower(n.filePath) LIKE '%/' || h.filePath) AND n.startLine <= h.endLine AND n.endLine >= h.startLine")
def changed_symbols(spark, sf_dir):
    n, _ = graph(spark, sf_dir)
    return text.changed_symbols(n, _hunks(spark, sf_dir)).select("id", "filePath", "startLine", "endLine")


@query("WITH changed AS (SELECT id FROM nodes WHERE filePath LIKE 'lib/%' AND startLine <= 60 AND endLine >= 40) SELECT targetId AS process, count(*) AS changed_steps, min(step) AS first_step FROM edges WHERE type = 'STEP_IN_PROCESS' AND sourceId IN (SELECT id FROM changed) GROUP BY targetId")
def changed_processes(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    hunks = n.filter("filePath like 'lib/%'").select("filePath", F.lit(40).alias("startLine"), F.lit(60).alias("endLine")).distinct()
    return text.changed_processes(text.changed_symbols(n, hunks), e)


# Routes and consumers of the test tables: parts' types are routes, events fetch them and read some keys.
ROUTES = """routes AS (SELECT 'Route:' || p_brand AS route, '/api/' || lower(replace(p_brand, '#', '-')) AS name, list_sort(list(DISTINCT 'k' || CAST(p_size % 7 AS VARCHAR))) AS responseKeys, list_sort(list(DISTINCT 'e' || CAST(p_size % 3 AS VARCHAR))) AS errorKeys FROM part GROUP BY p_brand),
consumers AS (SELECT 'Route:Brand#' || CAST(event_id % 5 + 1 AS VARCHAR) || CAST(event_id % 4 + 1 AS VARCHAR) AS route, 'Function:c' || CAST(user_id AS VARCHAR) AS consumer, list_sort(list(DISTINCT CASE WHEN event_id % 11 = 0 THEN 'e' || CAST(event_id % 3 AS VARCHAR) ELSE 'k' || CAST(event_id % 9 AS VARCHAR) END)) AS keys, CAST(count(*) AS INT) AS fetches FROM events GROUP BY 1, 2)"""


def _routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, e = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "events")
    named = lambda letter, c: F.array_sort(F.collect_set(F.concat(F.lit(letter), c.cast("string"))))
    routes_ = p.groupBy(F.concat(F.lit("Route:"), "p_brand").alias("route"), F.concat(F.lit("/api/"), F.lower(F.regexp_replace("p_brand", "#", "-"))).alias("name")).agg(named("k", F.col("p_size") % 7).alias("responseKeys"), named("e", F.col("p_size") % 3).alias("errorKeys"))
    key = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string"))).otherwise(F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")))
    consumers = e.groupBy(F.concat(F.lit("Route:Brand#"), (F.col("event_id") % 5 + 1).cast("string"), (F.col("event_id") % 4 + 1).cast("string")).alias("route"), F.concat(F.lit("Function:c"), F.col("user_id").cast("string")).alias("consumer")).agg(F.array_sort(F.collect_set(key)).alias("keys"), F.count("*").cast("int").alias("fetches"))
    return routes_, consumers


@query(f"WITH {ROUTES} SELECT r.route, c.consumer, array_to_string(list_sort(list_filter(c.keys, lambda k: NOT list_contains(r.responseKeys, k) AND NOT list_contains(r.errorKeys, k))), ',') AS mismatched, array_to_string(list_sort(list_filter(c.keys, lambda k: list_contains(r.errorKeys, k) AND NOT list_contains(r.responseKeys, k))), ',') AS error_path, CASE WHEN fetches > 1 THEN 'low' ELSE 'high' END AS confidence FROM routes r JOIN consumers c USING (route)", False)
def shape_check(spark, sf_dir):
    found = routes.shape_check(*_routes(spark, sf_dir))
    return found.withColumns({"mismatched": F.array_join("mismatched", ","), "error_path": F.array_join("error_path", ",")})


@query(f"""WITH {ROUTES}, bad AS (SELECT r.route, count(*) FILTER (len(list_filter(c.keys, lambda k: NOT list_contains(r.responseKeys, k) AND NOT list_contains(r.errorKeys, k))) > 0) AS mismatches FROM routes r JOIN consumers c USING (route) GROUP BY r.route),
n AS (SELECT route, count(DISTINCT consumer) AS consumers FROM consumers GROUP BY route), j AS (SELECT routes.route, coalesce(consumers, 0) AS consumers, coalesce(mismatches, 0) AS mismatches FROM routes LEFT JOIN n USING (route) LEFT JOIN bad USING (route))
SELECT *, ['LOW', 'MEDIUM', 'HIGH'][1 + least(2, CASE WHEN consumers >= 10 THEN 2 WHEN consumers >= 4 THEN 1 ELSE 0 END + CASE WHEN mismatches > 0 THEN 1 ELSE 0 END)] AS risk FROM j""", False)
def api_impact(spark, sf_dir):
    return routes.api_impact(*_routes(spark, sf_dir))


def _route_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r, c = _routes(spark, sf_dir)
    n = r.select(F.col("route").alias("id"), F.lit("Route").alias("label"), "name", F.concat(F.lit("app"), "name", F.lit("/route.ts")).alias("filePath"))
    users = c.select(F.col("consumer").alias("id"), F.lit("Function").alias("label"), F.col("consumer").alias("name"), F.concat(F.lit("web/"), "consumer", F.lit(".ts")).alias("filePath")).distinct()
    e = c.select(F.col("consumer").alias("sourceId"), F.col("route").alias("targetId"), F.lit("FETCHES").alias("type"), F.lit(0.9).alias("confidence"), routes.fetch_reason(F.col("keys"), F.col("fetches")).alias("reason"))
    return n.union(users), e


@query(f"WITH {ROUTES} SELECT r.route, r.name, string_agg('web/' || c.consumer || '.ts', ',' ORDER BY c.consumer) AS consumers FROM routes r LEFT JOIN consumers c USING (route) WHERE contains(r.name, 'brand-1') GROUP BY ALL", False)
def route_map(spark, sf_dir):
    found = routes.route_map(*_route_graph(spark, sf_dir), "brand-1")
    return found.select("route", "name", F.array_join(F.transform("consumers", lambda x: x["f"]), ",").alias("consumers"))


@query(f"WITH {ROUTES} SELECT route, consumer, array_to_string(keys, ',') AS keys, CASE WHEN fetches > 1 THEN fetches ELSE 0 END AS fetches FROM consumers", False)
def fetch_reason_decode(spark, sf_dir):
    _, e = _route_graph(spark, sf_dir)
    return e.select(F.col("targetId").alias("route"), F.col("sourceId").alias("consumer"), F.array_join(routes.reason_keys(F.col("reason")), ",").alias("keys"), routes.reason_fetches(F.col("reason")).alias("fetches"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("filePath"), F.col("html").alias("content"))


NORMAL_URL = "CASE WHEN regexp_matches(lower(u), '^https?://') OR contains(u, '+') OR contains(u, '(') OR u = '' THEN NULL ELSE CASE WHEN w = '/' THEN '/' WHEN rtrim(w, '/') = '' THEN '/' ELSE rtrim(w, '/') END END"
URLS = r"""raw AS (SELECT 'page' || page_id AS filePath, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS raw FROM pages),
cut AS (SELECT filePath, trim(raw) AS u, split_part(split_part(trim(raw), '?', 1), '#', 1) AS v FROM raw), led AS (SELECT filePath, u, CASE WHEN starts_with(v, '/') THEN v ELSE '/' || v END AS w FROM cut),"""


@query(f"WITH {URLS} n AS (SELECT filePath, {NORMAL_URL} AS url FROM led) SELECT DISTINCT filePath, 'navigation' AS kind, url FROM n WHERE url IS NOT NULL", False)
def href_routes(spark, sf_dir):
    return routes.navigation(_pages(spark, sf_dir))


@query(f"WITH {URLS.replace('raw AS (', 'x AS (SELECT 1), raw AS (', 1)} n AS (SELECT DISTINCT u, {NORMAL_URL} AS url FROM led) SELECT u AS raw, url FROM n", False)
def route_normalize(spark, sf_dir):
    found = _pages(spark, sf_dir).select(F.explode(F.regexp_extract_all("content", F.lit(routes.HREF), F.lit(1))).alias("raw")).select(F.trim("raw").alias("raw")).distinct()
    return found.select("raw", normal_url(F.col("raw")).alias("url"))


@query("""WITH urls AS (SELECT DISTINCT '/api/' || lower(c_mktsegment) || '/' || CAST(c_custkey % 40 AS VARCHAR) AS url FROM customer), plain AS (SELECT DISTINCT '/api/' || lower(c_mktsegment) || '/' || CAST(c_custkey % 9 AS VARCHAR) AS route FROM customer),
dynamic AS (SELECT DISTINCT '/api/' || lower(c_mktsegment) || '/:id' AS route FROM customer WHERE c_mktsegment <> 'BUILDING'), exact AS (SELECT url, route FROM urls JOIN plain ON url = route)
SELECT * FROM exact UNION ALL SELECT url, min(route) FROM urls JOIN dynamic ON split_part(url, '/', 3) = split_part(route, '/', 3) WHERE url NOT IN (SELECT url FROM exact) GROUP BY url""", False)
def route_match_dynamic(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("s", F.lower("c_mktsegment"))
    made = lambda n: c.select(F.concat(F.lit("/api/"), "s", F.lit("/"), (F.col("c_custkey") % n).cast("string")).alias("url")).distinct()
    dynamic = c.filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("/api/"), "s", F.lit("/:id")).alias("url")).distinct()
    return routes.matched_routes(made(40), made(9).union(dynamic))


BM25 = """docs AS (SELECT 'File:doc' || doc_id AS id, source AS label, lang AS filePath, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1) AS w FROM documents), c AS (SELECT id, label, filePath, len(w) AS n, len(list_filter(w, lambda x: x = 'idiot')) AS t0, len(list_filter(w, lambda x: x = 'worthless')) AS t1 FROM docs),
a AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
scored AS (SELECT id, label, filePath, ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c, a WHERE t0 + t1 > 0)"""


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, id LIMIT 50", False)
def bm25_topk(spark, sf_dir):
    return search.bm25(_files(spark, sf_dir), "worthless idiot").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("File:doc"), "doc_id").alias("id"), F.col("source").alias("label"), F.col("lang").alias("filePath"), F.col("text").alias("content"))
    return search.bm25(d, "worthless idiot").select("id", F.round("score", 6).alias("score")).join(d.select("id", "label", "filePath"), "id")


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 6) DESC, id) AS r FROM scored) SELECT filePath, round(sum(round(score, 6)), 4) AS score FROM r WHERE r <= 3 GROUP BY filePath", False)
def bm25_per_index_sum(spark, sf_dir):
    return search.summed_by_file(_scored(spark, sf_dir), 3).select("filePath", F.round("score", 4).alias("score"))


KNN = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS id, label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS distance FROM embeddings, q)"


def _query_vector(e: DataFrame) -> list[float]:
    return list(e.filter("vec_id = 0").first().embedding)


@query(f"WITH {KNN} SELECT id, round(distance, 6) AS distance FROM d ORDER BY d.distance, id LIMIT 20", False)
def knn_topk(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return search.nearest(e, _query_vector(e), 20).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {KNN}, n AS (SELECT label AS nodeId, id AS chunkIndex, distance FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY nodeId ORDER BY distance, chunkIndex) AS r FROM n) SELECT nodeId, chunkIndex, round(distance, 6) AS distance FROM r WHERE r = 1", False)
def knn_best_chunk(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    d = search.nearest(e, _query_vector(e), None).join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("nodeId")), "id")
    return search.best_chunks(d.withColumnRenamed("id", "chunkIndex")).select("nodeId", "chunkIndex", F.round("distance", 6).alias("distance"))


@query(f"""WITH {BM25}, {KNN}, k AS (SELECT filePath, sum(round(score, 6)) AS score FROM scored GROUP BY filePath), kr AS (SELECT filePath, row_number() OVER (ORDER BY round(score, 4) DESC, filePath) AS rank FROM k QUALIFY rank <= 50),
s AS (SELECT CASE label % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'v' || CAST(label AS VARCHAR) END AS filePath, row_number() OVER (ORDER BY distance, id) AS rank FROM d QUALIFY rank <= 20), sr AS (SELECT filePath, sum(1.0 / (60 + rank)) AS s FROM s GROUP BY filePath)
SELECT filePath, round(coalesce(1.0 / (60 + kr.rank), 0) + coalesce(s, 0), 9) AS score, concat_ws('+', CASE WHEN kr.rank IS NOT NULL THEN 'bm25' END, CASE WHEN s IS NOT NULL THEN 'semantic' END) AS sources FROM kr FULL JOIN sr USING (filePath) ORDER BY score DESC, filePath LIMIT 10""", False)
def rrf_hybrid(spark, sf_dir):
    k = search.ranked(_scored(spark, sf_dir).groupBy("filePath").agg(F.round(F.sum("score"), 4).alias("score")), 50, F.desc("score"), F.col("filePath"))
    e = _table(spark, sf_dir, "embeddings")
    path = F.when(F.col("label") % 6 == 0, "en").when(F.col("label") % 6 == 1, "de").when(F.col("label") % 6 == 2, "fr").otherwise(F.concat(F.lit("v"), F.col("label").cast("string")))
    s = search.nearest(e, _query_vector(e), 20).join(e.select(F.col("vec_id").alias("id"), path.alias("filePath")), "id")
    s = search.ranked(s, 20, F.col("distance"), F.col("id")).withColumn("score", 1 - F.col("distance"))
    return search.fused(k, s).select("filePath", F.round("score", 9).alias("score"), "sources")


@query("""WITH n AS (SELECT doc_id AS id, text AS t, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(CAST(ceil((length(text) - 120) / 1080.0) AS INT), 1) END AS c FROM documents), s AS (SELECT id, t, unnest(range(0, c)) AS chunk FROM n)
SELECT id, CAST(chunk AS INT) AS chunk, CAST(chunk * 1080 AS INT) AS start, sha256(substr(t, chunk * 1080 + 1, 1200)) AS text, CAST(1 + length(substr(t, 1, chunk * 1080)) - length(replace(substr(t, 1, chunk * 1080), chr(10), '')) AS BIGINT) AS startLine FROM s""", False)
def char_chunks(spark, sf_dir):
    c = text.char_chunks(_table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    return c.select("id", "chunk", "start", F.sha2("text", 256).alias("text"), "startLine")


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+', ''), '[ \t\n]+$', '')) AS clean FROM documents", False)
def clean_content(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean_content(F.col("text")), 256).alias("clean"))


@query("SELECT doc_id, sha1(text) AS hash FROM documents", False)
def content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("hash"))


@query("WITH now AS (SELECT doc_id AS id, sha1(text) AS h FROM documents WHERE doc_id % 7 <> 0), old AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha1(text) END AS s FROM documents WHERE doc_id % 3 <> 0) SELECT id, CASE WHEN s IS NULL THEN 'new' WHEN h IS NULL THEN 'gone' WHEN h = s THEN 'fresh' ELSE 'changed' END AS status FROM now FULL JOIN old USING (id)", False)
def embedding_freshness(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("hash"))
    return text.embedding_status(d.filter("id % 7 <> 0"), d.filter("id % 3 <> 0").withColumn("hash", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("hash"))))


CONTRACTS = """contracts AS (SELECT 'http::post::/api/' || lower(p_brand) || '/' AS contractId, 'http::POST::/api/' || lower(p_brand) AS key, 'provider' AS role, 'Route:' || CAST(min(p_partkey) AS VARCHAR) AS symbolUid, 'repo' || CAST(min(p_partkey) % 3 AS VARCHAR) AS repo, 1.0 AS confidence FROM part GROUP BY p_brand
UNION ALL SELECT 'http::POST::/api/brand#' || CAST(c_custkey % 7 + 9 AS VARCHAR), 'http::POST::/api/brand#' || CAST(c_custkey % 7 + 9 AS VARCHAR), 'consumer', 'Function:c' || CAST(c_custkey AS VARCHAR), 'repo' || CAST(c_custkey % 4 AS VARCHAR), CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE 0.8 END FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'http::*::/api/brand#' || CAST(c_custkey % 60 AS VARCHAR), 'http::*::/api/brand#' || CAST(c_custkey % 60 AS VARCHAR), 'consumer', 'Function:c' || CAST(c_custkey AS VARCHAR), 'repo' || CAST(c_custkey % 4 AS VARCHAR), 0.8 FROM customer WHERE c_custkey % 2 = 1)"""
LINKS = """links AS (SELECT c.contractId, c.repo AS c_repo, c.symbolUid AS c_symbol, p.repo AS p_repo, p.symbolUid AS p_symbol, least(CASE WHEN c.confidence = 0 THEN 1 ELSE c.confidence END, p.confidence) AS confidence FROM contracts c JOIN contracts p ON p.role = 'provider' AND (c.key = p.key OR c.key LIKE 'http::*::%' AND substr(c.key, 10) = substr(p.key, 13)) AND c.repo <> p.repo WHERE c.role = 'consumer')"""


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "customer")
    repo = lambda x, n: F.concat(F.lit("repo"), (x % n).cast("string")).alias("repo")
    a = p.groupBy("p_brand").agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("http::post::/api/"), F.lower("p_brand"), F.lit("/")).alias("contractId"), F.lit("provider").alias("role"), F.concat(F.lit("Route:"), F.col("k").cast("string")).alias("symbolUid"), repo(F.col("k"), 3), F.lit(1.0).alias("confidence"))
    k = F.col("c_custkey")
    uid = F.concat(F.lit("Function:c"), k.cast("string")).alias("symbolUid")
    b = c.filter(k % 2 == 0).select(F.concat(F.lit("http::POST::/api/brand#"), (k % 7 + 9).cast("string")), F.lit("consumer"), uid, repo(k, 4), F.when(k % 5 == 0, 0.0).otherwise(0.8))
    d = c.filter(k % 2 == 1).select(F.concat(F.lit("http::*::/api/brand#"), (k % 60).cast("string")), F.lit("consumer"), uid, repo(k, 4), F.lit(0.8))
    return a.union(b).union(d).withColumns({"service": F.lit(""), "type": F.lit("http")})


@query(f"WITH {CONTRACTS}, {LINKS} SELECT contractId, c_repo, c_symbol, p_repo, p_symbol, 'exact' AS \"matchType\", confidence FROM links", False)
def contract_exact_match(spark, sf_dir):
    return contracts.exact_links(_contracts(spark, sf_dir))


@query(f"WITH {CONTRACTS}, {LINKS}, ends AS (SELECT c_repo AS repo, c_symbol AS symbolUid FROM links UNION SELECT p_repo, p_symbol FROM links) SELECT repo, symbolUid, contractId, role, key FROM contracts ANTI JOIN ends USING (repo, symbolUid)", False)
def contract_unmatched(spark, sf_dir):
    c = _contracts(spark, sf_dir)
    return contracts.unmatched(c, contracts.exact_links(c)).select("repo", "symbolUid", "contractId", "role", "key")


@query("""WITH p AS (SELECT 'grpc::acme.s' || CAST(s_nationkey AS VARCHAR) || '/Get' || CAST(s_suppkey AS VARCHAR) AS contractId, 'acme.s' || CAST(s_nationkey AS VARCHAR) AS service, 'repo' || CAST(s_suppkey % 3 AS VARCHAR) AS repo, 'Method:' || CAST(s_suppkey AS VARCHAR) AS uid FROM supplier),
c AS (SELECT 'grpc::' || CASE WHEN n_nationkey % 2 = 0 THEN 'acme.' ELSE '' END || 'S' || CAST(n_nationkey AS VARCHAR) || '/*' AS contractId, lower(CASE WHEN n_nationkey % 2 = 0 THEN 'acme.' ELSE '' END || 's' || CAST(n_nationkey AS VARCHAR)) AS service, 'repo' || CAST(n_nationkey % 5 AS VARCHAR) AS repo, 'Function:' || n_name AS uid FROM nation)
SELECT c.contractId, p.contractId AS p_contract, c.repo AS c_repo, c.uid AS c_symbol, p.repo AS p_repo, p.uid AS p_symbol FROM c JOIN p ON c.repo <> p.repo AND (c.service = p.service OR c.service = split_part(p.service, '.', 2))""", False)
def contract_grpc_wildcard(spark, sf_dir):
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    text_ = lambda c: F.col(c).cast("string")
    p = s.select(F.concat(F.lit("grpc::acme.s"), text_("s_nationkey"), F.lit("/Get"), text_("s_suppkey")).alias("contractId"), F.lit("provider").alias("role"), F.concat(F.lit("repo"), (F.col("s_suppkey") % 3).cast("string")).alias("repo"), F.concat(F.lit("Method:"), text_("s_suppkey")).alias("symbolUid"))
    c = n.select(F.concat(F.lit("grpc::"), F.when(F.col("n_nationkey") % 2 == 0, "acme.").otherwise(""), F.lit("S"), text_("n_nationkey"), F.lit("/*")), F.lit("consumer"), F.concat(F.lit("repo"), (F.col("n_nationkey") % 5).cast("string")), F.concat(F.lit("Function:"), "n_name"))
    return contracts.grpc_links(p.union(c))


@query("SELECT source AS repo, lang AS contractId, 'provider' AS role, 'x' AS symbolUid, arg_min(n_chars, doc_id) AS confidence FROM documents GROUP BY ALL", False)
def contract_dedupe(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("contractId"), F.lit("provider").alias("role"), F.lit("x").alias("symbolUid"), F.col("n_chars").alias("confidence"), "doc_id")
    return contracts.distinct_contracts(d, "doc_id").select("repo", "contractId", "role", "symbolUid", "confidence")


@query("WITH r AS (SELECT source AS repo, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT repo, id, round(1.0 / (60 + r), 9) AS score FROM r ORDER BY score DESC, repo, id LIMIT 60", False)
def group_query_rrf(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("id"), F.col("n_chars").alias("relevance"))
    return contracts.group_query(d, 60).withColumn("score", F.round("score", 9))


@query("WITH b AS (SELECT 'src' AS dir, 'root' AS service UNION ALL SELECT 'src/orders', 'orders' UNION ALL SELECT 'lib/Brand#11', 'eleven' UNION ALL SELECT 'lib/Brand#1', 'one'), f AS (SELECT DISTINCT filePath FROM nodes WHERE filePath LIKE '%.ts') SELECT f.filePath, arg_max(b.service, length(b.dir)) AS service FROM f LEFT JOIN b ON starts_with(f.filePath, b.dir || '/') GROUP BY f.filePath")
def service_longest_prefix(spark, sf_dir):
    n, _ = graph(spark, sf_dir)
    b = spark.createDataFrame([("src", "root"), ("src/orders", "orders"), ("lib/Brand#11", "eleven"), ("lib/Brand#1", "one")], "dir string, service string")
    return contracts.service_of(n.filter("filePath like '%.ts'").select("filePath").distinct(), b)


@query("""WITH p AS (SELECT DISTINCT filePath, string_split(filePath, '/') AS parts FROM nodes WHERE filePath LIKE '%.ts'), s AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
SELECT DISTINCT CASE WHEN i = len(parts) THEN 'File:' ELSE 'Folder:' END || array_to_string(list_slice(parts, 1, i), '/') AS id, parts[i] AS name FROM s""")
def folder_tree(spark, sf_dir):
    n, _ = graph(spark, sf_dir)
    return structure.folder_tree(n.filter("filePath like '%.ts'").select("filePath").distinct())[0].select("id", "name")


SCOPES = "scopes AS (SELECT 'Method:o' || CAST(o_orderkey AS VARCHAR) AS scope, CAST(o_custkey % 50 AS VARCHAR) AS f, CAST(o_orderkey % 500 + 1 AS INT) AS a, CAST(o_orderkey % 500 + 1 + o_orderkey % 37 AS INT) AS z, CAST(o_orderkey % 13 AS INT) AS c FROM orders)"


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("Method:o"), k.cast("string")).alias("id"), (F.col("o_custkey") % 50).cast("string").alias("filePath"), (k % 500 + 1).cast("int").alias("startLine"), (k % 13).cast("int").alias("startCol"), (k % 500 + 1 + k % 37).cast("int").alias("endLine"), (k % 13 + 40).cast("int").alias("endCol"))


@query(f"WITH {SCOPES}, pos AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS f, CAST(o_orderkey % 520 AS INT) AS line, CAST(o_orderkey % 7 AS INT) AS col FROM orders), j AS (SELECT pos.*, scope, row_number() OVER (PARTITION BY pos.f, pos.line, pos.col ORDER BY a DESC NULLS LAST, c DESC, z, c + 40, scope DESC) AS r FROM pos LEFT JOIN scopes s ON s.f = pos.f AND (a < line OR a = line AND c <= col) AND (z > line OR z = line AND c + 40 >= col)) SELECT f AS \"filePath\", line, col, scope IS NOT NULL AS inside, (SELECT max(a) FROM scopes WHERE scopes.scope = j.scope) AS \"startLine\" FROM j WHERE r = 1", False)
def position_to_scope(spark, sf_dir):
    s, o = _scopes(spark, sf_dir), _table(spark, sf_dir, "orders")
    p = o.select((F.col("o_custkey") % 50).cast("string").alias("filePath"), (F.col("o_orderkey") % 520).cast("int").alias("line"), (F.col("o_orderkey") % 7).cast("int").alias("col")).distinct()
    found = structure.scope_at(p, s)
    return found.join(s.select(F.col("id").alias("scope"), "startLine"), "scope", "left").select("filePath", "line", "col", F.col("scope").isNotNull().alias("inside"), "startLine")


@query("""WITH s AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, 'Module' AS kind, 'f' || r_regionkey AS f, 1 AS a, 100 AS z FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'Function', 'f' || CASE WHEN n_nationkey = 3 THEN 9 ELSE n_regionkey END, n_nationkey * 3 + 1, n_nationkey * 3 + CASE WHEN n_nationkey % 6 = 0 THEN 40 ELSE 2 END FROM nation
UNION ALL SELECT 'x', CAST(NULL AS VARCHAR), 'Function', 'f0', 1, 2 UNION ALL SELECT 'y', 'gone', 'Function', 'f0', 1, 2),
j AS (SELECT s.*, p.f AS pf, p.a AS pa, p.z AS pz FROM s JOIN s p ON s.parent = p.id), o AS (SELECT id, a, max(z) OVER (PARTITION BY parent ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WHERE parent IS NOT NULL)
SELECT 'root is no module' AS rule, id FROM s WHERE parent IS NULL AND kind <> 'Module' UNION ALL SELECT 'missing parent', id FROM s WHERE parent = 'gone' UNION ALL SELECT 'parent in another file', id FROM j WHERE f <> pf
UNION ALL SELECT 'not inside its parent', id FROM j WHERE f = pf AND NOT (pa <= a AND z <= pz) UNION ALL SELECT 'overlaps a sibling', id FROM o WHERE before >= a""", False)
def scope_invariants(spark, sf_dir):
    r, n = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    base = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("Module").alias("kind"), F.concat(F.lit("f"), "r_regionkey").alias("filePath"), F.lit(1).alias("startLine"), F.lit(100).alias("endLine"))
    more = n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit("Function"), F.concat(F.lit("f"), F.when(k == 3, 9).otherwise(F.col("n_regionkey")).cast("string")), (k * 3 + 1).cast("int"), (k * 3 + F.when(k % 6 == 0, 40).otherwise(2)).cast("int"))
    odd = spark.createDataFrame([("x", None, "Function", "f0", 1, 2), ("y", "gone", "Function", "f0", 1, 2)], "id string, parent string, kind string, filePath string, startLine int, endLine int")
    return structure.scope_faults(base.union(more).union(odd).withColumns({"startCol": F.lit(0), "endCol": F.lit(0)}).withColumn("endCol", F.lit(1)))


# Every third word of a text plays a heading; windows by level find what follows and what is above.
SECTIONS = """body AS (SELECT 'd' || doc_id AS f, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), h AS (SELECT f, i AS line, 1 + (length(w[i]) + i) % 4 AS level, 'Section:' || f || ':L' || i || ':h' || i AS id, len(w) AS total FROM (SELECT f, w, unnest(range(1, len(w) + 1, 3)) AS i FROM body)),
seen AS (SELECT *, """ + ", ".join(f"min(CASE WHEN level = {k} THEN line END) OVER ahead AS n{k}, max(CASE WHEN level = {k} THEN line END) OVER behind AS p{k}" for k in range(1, 5)) + """ FROM h WINDOW ahead AS (PARTITION BY f ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), behind AS (PARTITION BY f ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
NEXT_LINE = "least(n1, CASE WHEN level >= 2 THEN n2 END, CASE WHEN level >= 3 THEN n3 END, CASE WHEN level >= 4 THEN n4 END)"
LAST_LINE = "greatest(CASE WHEN level > 1 THEN p1 END, CASE WHEN level > 2 THEN p2 END, CASE WHEN level > 3 THEN p3 END)"


@query(f"WITH {SECTIONS} SELECT f AS \"filePath\", line, coalesce({NEXT_LINE} - 1, total) AS \"endLine\", CASE WHEN {LAST_LINE} IS NULL THEN 'File:' || f ELSE 'Section:' || f || ':L' || {LAST_LINE} || ':h' || {LAST_LINE} END AS parent FROM seen", False)
def section_nesting(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("filePath"), F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)).alias("w"))
    h = d.select("filePath", F.size("w").alias("total"), F.posexplode("w").alias("at", "word")).withColumn("line", (F.col("at") + 1).cast("long")).filter("line % 3 = 1")
    h = h.select("filePath", "line", (1 + (F.length("word") + F.col("line")) % 4).alias("level"), F.concat(F.lit("h"), "line").alias("name"), "total")
    return structure.nested_sections(h).select("filePath", "line", "endLine", "parent")


@query("SELECT c_custkey AS ref, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS def FROM customer JOIN part ON p_size = c_custkey % 50 + 1 AND p_brand = 'Brand#' || CAST(c_custkey % 5 + 1 AS VARCHAR) || CAST(c_nationkey % 5 + 1 AS VARCHAR) GROUP BY c_custkey HAVING count(DISTINCT p_partkey) = 1", False)
def name_resolution_unique(spark, sf_dir):
    c, p = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "part")
    brand = F.concat(F.lit("Brand#"), (F.col("c_custkey") % 5 + 1).cast("string"), (F.col("c_nationkey") % 5 + 1).cast("string"))
    refs = c.select(F.col("c_custkey").alias("ref"), brand.alias("brand"), (F.col("c_custkey") % 50 + 1).alias("size"))
    defs = p.select(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("def"))
    return resolution.unique_by_key(refs, defs, "ref", "def", ["brand", "size"])


TIER_SQL = """found AS (SELECT l_orderkey * 10 + l_linenumber % 10 AS ref, CASE l_orderkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'member' ELSE 'constructor' END AS form, CASE WHEN l_orderkey % 2 = 0 THEN 'x' ELSE '' END AS receiver, CASE l_partkey % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'file' WHEN 2 THEN 'package' WHEN 3 THEN 'global' WHEN 4 THEN 'typed' ELSE 'imported' END AS tier, l_suppkey AS def FROM lineitem),
rank(form, tier, rank, confidence) AS (VALUES ('constructor','name',0,1.0),('constructor','file',1,0.95),('constructor','global',2,0.5),('member','typed',0,1.0),('member','imported',1,0.9),('member','global',2,0.5),('free','name',0,1.0),('free','file',1,0.95),('free','package',2,0.95),('free','global',3,0.5)),
one AS (SELECT ref, tier, rank, confidence, min(def) AS def FROM found JOIN rank USING (form, tier) WHERE NOT (form = 'member' AND tier = 'global' AND receiver <> '') GROUP BY ref, tier, rank, confidence HAVING count(DISTINCT def) = 1)"""


@query(f"WITH {TIER_SQL} SELECT ref, def, tier, CAST(confidence AS DOUBLE) AS confidence FROM one QUALIFY row_number() OVER (PARTITION BY ref ORDER BY rank) = 1", False)
def call_tier_resolution(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    form = F.element_at(F.array(*map(F.lit, ("free", "member", "constructor"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    tier = F.element_at(F.array(*map(F.lit, ("name", "file", "package", "global", "typed", "imported"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    found = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") % 10).alias("ref"), form.alias("form"), F.when(F.col("l_orderkey") % 2 == 0, "x").otherwise("").alias("receiver"), tier.alias("tier"), F.col("l_suppkey").alias("def"))
    return resolution.call_tiers(found)


@query("SELECT l_orderkey, l_linenumber, a IS NULL OR c IS NULL OR (a >= coalesce(r, c) AND a <= c) AS fits FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 4 END AS a, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 END AS r, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 5 END AS c FROM lineitem)", False)
def arity_compatible(spark, sf_dir):
    k = lambda c, n: F.when(F.col(c) % n != 0, F.col(c) % n)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", resolution.arity_fits(k("l_partkey", 4), k("l_suppkey", 3), k("l_suppkey", 5)).alias("fits"))


ANCESTORS = "parents AS (SELECT sourceId AS child, targetId AS parent FROM edges WHERE type = 'EXTENDS' UNION SELECT sourceId, 'Interface:' || targetId FROM edges WHERE type = 'EXTENDS' AND length(sourceId) = 8), up AS (SELECT child AS class, parent AS ancestor, 1 AS depth FROM parents WHERE child <> parent UNION SELECT up.class, parents.parent, depth + 1 FROM up JOIN parents ON parents.child = up.ancestor WHERE depth < 12), above AS (SELECT class, ancestor, CAST(min(depth) AS INT) AS depth FROM up WHERE class <> ancestor GROUP BY class, ancestor)"


def _above(spark: SparkSession, e: DataFrame) -> DataFrame:
    x = e.filter("type = 'EXTENDS'")
    p = x.select(F.col("sourceId").alias("child"), F.col("targetId").alias("parent"), F.lit("EXTENDS").alias("type"))
    faces = x.filter("length(sourceId) = 8").select("sourceId", F.concat(F.lit("Interface:"), "targetId"), F.lit("IMPLEMENTS"))
    return resolution.ancestors(p.union(faces))


@query(f"WITH RECURSIVE {ANCESTORS} SELECT * FROM above")
def heritage_ancestors(spark, sf_dir):
    _, e = graph(spark, sf_dir)
    return _above(spark, e).select("class", "ancestor", "depth")


METHODS = "methods AS (SELECT owner, name, min(method) AS method FROM (SELECT 'Class:s' || CAST(l_suppkey AS VARCHAR) AS owner, 'm' || CAST(l_orderkey % 1009 AS VARCHAR) AS name, 'Method:o' || CAST(l_orderkey AS VARCHAR) AS method FROM lineitem) x GROUP BY owner, name)"


def _methods(spark: SparkSession) -> DataFrame:
    first = spark.table("lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 1009).alias("n")).agg(F.min(F.col("l_orderkey").cast("string")).alias("k"))
    return first.select(F.concat(F.lit("Class:s"), F.col("l_suppkey").cast("string")).alias("owner"), F.concat(F.lit("m"), F.col("n").cast("string")).alias("name"), F.concat(F.lit("Method:o"), "k").alias("method"))


@query(f"WITH RECURSIVE {ANCESTORS}, {METHODS}, inherited AS (SELECT class, a.depth, ancestor, name, method FROM above a JOIN methods m ON m.owner = a.ancestor), foreign_ AS (SELECT * FROM inherited i WHERE NOT EXISTS (SELECT 1 FROM methods m WHERE m.owner = i.class AND m.name = i.name)) SELECT class, name, arg_min(method, {{'d': depth, 'a': ancestor, 'm': method}}) AS method, CAST(0.9 AS DOUBLE) AS confidence FROM foreign_ GROUP BY class, name HAVING count(DISTINCT method) >= 2")
def method_overrides(spark, sf_dir):
    _, e = graph(spark, sf_dir)
    return resolution.overrides(_above(spark, e), _methods(spark))


@query("""WITH RECURSIVE parents AS (SELECT sourceId AS child, targetId AS parent FROM edges WHERE type = 'EXTENDS'), up AS (SELECT child AS class, parent AS ancestor FROM parents WHERE child <> parent UNION SELECT up.class, parents.parent FROM up JOIN parents ON parents.child = up.ancestor),
m AS (SELECT 'Class:s' || CAST(s_suppkey AS VARCHAR) AS owner, 'm' || CAST(s_suppkey % 2 AS VARCHAR) AS name, 'Method:' || CAST(s_suppkey AS VARCHAR) AS method, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 2 END AS count FROM supplier),
kinds AS (SELECT id, CASE WHEN CAST(substr(id, 8) AS BIGINT) % 4 = 0 THEN 'Interface' ELSE 'Class' END AS label FROM nodes WHERE label = 'Class')
SELECT own.method, base.method AS target, CAST(CASE WHEN (own.count IS NULL) <> (base.count IS NULL) THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence FROM up JOIN kinds k ON k.id = class AND k.label = 'Class' JOIN kinds f ON f.id = ancestor AND f.label = 'Interface' JOIN m own ON own.owner = class JOIN m base ON base.owner = ancestor AND base.name = own.name WHERE class <> ancestor AND ((own.count IS NULL) <> (base.count IS NULL) OR own.count IS NOT DISTINCT FROM base.count)""")
def method_implements(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    p = e.filter("type = 'EXTENDS'").select(F.col("sourceId").alias("child"), F.col("targetId").alias("parent"), F.lit("EXTENDS").alias("type"))
    k = F.col("s_suppkey")
    m = spark.table("supplier").select(F.concat(F.lit("Class:s"), k.cast("string")).alias("owner"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("name"), F.concat(F.lit("Method:"), k.cast("string")).alias("method"), F.when(k % 3 != 0, k % 2).alias("count"), F.array().cast("array<string>").alias("types"))
    kinds = n.filter("label = 'Class'").select("id", F.when(F.substring("id", 8, 20).cast("long") % 4 == 0, "Interface").otherwise("Class").alias("label"))
    return resolution.implementations(resolution.ancestors(p), m, kinds)


LINKED = "sym AS (SELECT id FROM nodes WHERE label IN ('Function','Class','Method','Interface')), lk AS (SELECT DISTINCT least(sourceId, targetId) AS a, greatest(sourceId, targetId) AS b FROM edges WHERE type IN ('CALLS','EXTENDS','IMPLEMENTS') AND sourceId <> targetId AND sourceId IN (SELECT id FROM sym) AND targetId IN (SELECT id FROM sym) AND (confidence = 0 OR confidence >= 0.5)), deg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM lk UNION ALL SELECT b FROM lk) x GROUP BY id HAVING count(*) >= 2), links AS (SELECT a, b FROM lk WHERE a IN (SELECT id FROM deg) AND b IN (SELECT id FROM deg))"


@query(f"WITH {LINKED} SELECT a, b FROM links")
def clustering_projection(spark, sf_dir):
    return clusters.projection(*graph(spark, sf_dir), large=True)


MEMBERS = "members AS (SELECT id, 'c' || CAST(length(id) % 4 AS VARCHAR) || substr(label, 1, 1) AS community FROM nodes WHERE label IN ('Function','Class','Method','Interface'))"


def _members(n: DataFrame) -> DataFrame:
    return n.filter("label in ('Function','Class','Method','Interface')").select("id", F.concat(F.lit("c"), (F.length("id") % 4).cast("string"), F.substring("label", 1, 1)).alias("community"))


@query(f"WITH {LINKED}, {MEMBERS}, e2 AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), j AS (SELECT x.community, x.community = y.community AS same FROM e2 JOIN members x ON x.id = e2.a JOIN members y ON y.id = e2.b), s AS (SELECT community, avg(CAST(same AS DOUBLE)) AS v FROM j GROUP BY community) SELECT m.community, round(coalesce(v, 1.0), 6) AS cohesion FROM (SELECT DISTINCT community FROM members) m LEFT JOIN s USING (community)")
def cohesion(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return clusters.cohesion(clusters.projection(n, e, large=True), _members(n)).select("community", F.round("cohesion", 6).alias("cohesion"))


@query(f"WITH {LINKED}, {MEMBERS}, j AS (SELECT x.community AS ca, y.community AS cb FROM links JOIN members x ON x.id = a JOIN members y ON y.id = b), d AS (SELECT c, CAST(count(*) AS DOUBLE) AS d FROM (SELECT ca AS c FROM j UNION ALL SELECT cb FROM j) z GROUP BY c) SELECT round((SELECT avg(CAST(ca = cb AS DOUBLE)) FROM j) - (SELECT sum(d * d) FROM d) / (4.0 * (SELECT count(*) FROM j) * (SELECT count(*) FROM j)), 6) AS modularity")
def modularity(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return clusters.modularity(clusters.projection(n, e, large=True), _members(n)).select(F.round("modularity", 6).alias("modularity"))


@query(f"""WITH c AS (SELECT sourceId AS a, targetId AS b FROM edges WHERE type = 'CALLS' AND (confidence = 0 OR confidence >= 0.5)), o AS (SELECT a AS id, count(*) AS n FROM c GROUP BY a), i AS (SELECT b AS id, count(*) AS m FROM c GROUP BY b)
SELECT nodes.id, CAST(3 * n - 2 * coalesce(m, 0) + CASE WHEN lower(name) IN ('main','run','start') THEN 5 WHEN lower(name) LIKE 'handle%' OR lower(name) LIKE 'on%' THEN 4 WHEN lower(name) LIKE 'create%' OR lower(name) LIKE 'update%' OR lower(name) LIKE 'delete%' OR lower(name) LIKE '%controller%' OR lower(name) LIKE '%command%' THEN 3 ELSE 1 END AS DOUBLE) AS score FROM nodes JOIN o USING (id) LEFT JOIN i USING (id) WHERE label IN ('Function','Method') AND {NOT_TEST} AND score > 0 ORDER BY score DESC, id LIMIT 200""")
def entry_point_scores(spark, sf_dir):
    return flows.entry_scores(*graph(spark, sf_dir))


TRACES_SQL = "t AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) || '->' || string_agg(event_type, '->' ORDER BY event_id) AS text FROM events GROUP BY user_id, event_id // 900 UNION SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) || '->' || min(event_type) || '->z' FROM events GROUP BY user_id)"


@query(f"WITH {TRACES_SQL}, kept AS (SELECT text FROM t WHERE NOT EXISTS (SELECT 1 FROM t w WHERE length(w.text) > length(t.text) AND contains(w.text, t.text))) SELECT text AS trace FROM kept QUALIFY row_number() OVER (PARTITION BY split_part(text, '->', 1), split_part(text, '->', -1) ORDER BY len(string_split(text, '->')) DESC, text) = 1", False)
def trace_dedupe(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    a = e.groupBy("user_id", F.expr("event_id div 900")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x")).select(F.concat(F.array(user), F.transform("x", lambda s: s["event_type"])).alias("trace"))
    b = e.groupBy("user_id").agg(F.min("event_type").alias("m")).select(F.array(user, F.col("m"), F.lit("z")).alias("trace"))
    both = a.union(b).select(F.element_at("trace", 1).alias("entry"), "trace")
    return flows.without_parts(both).select(F.array_join("trace", "->").alias("trace"))


@query("WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 4 <> 0) SELECT m AS matched, x AS expected, y AS candidates, CASE WHEN x = 0 THEN 0.0 ELSE round(100.0 * m / x, 2) END AS recall, CASE WHEN y = 0 THEN 0.0 ELSE round(100.0 * m / y, 2) END AS precision FROM (SELECT (SELECT count(*) FROM e JOIN f USING (k)) AS m, (SELECT count(*) FROM e) AS x, (SELECT count(*) FROM f) AS y)", False)
def set_recall_precision(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return quality.recall_precision(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 4 <> 0"), ["k"])


@query("""WITH s AS (SELECT doc_id AS site, lang AS language FROM documents), x AS (SELECT doc_id AS site, doc_id % 17 AS d FROM documents WHERE doc_id % 3 <> 0), y AS (SELECT doc_id AS site, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id % 17 END AS d FROM documents WHERE doc_id % 4 <> 0),
r AS (SELECT language, CASE WHEN x.d IS NULL AND y.d IS NULL THEN 'e' WHEN y.d IS NULL OR x.d IS NULL THEN 'o' WHEN x.d = y.d THEN 'a' ELSE 'd' END AS st FROM s LEFT JOIN x USING (site) LEFT JOIN y USING (site))
SELECT language, count(*) AS total, count(*) FILTER (st = 'a') AS agree, count(*) FILTER (st = 'e') AS empty, round(CASE WHEN count(*) = count(*) FILTER (st = 'e') THEN 1.0 ELSE count(*) FILTER (st = 'a') / (count(*) - count(*) FILTER (st = 'e')) END, 9) AS parity FROM r GROUP BY ROLLUP (language)""", False)
def shadow_parity(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").withColumn("site", F.col("doc_id"))
    x = d.filter("doc_id % 3 <> 0").select("site", (F.col("doc_id") % 17).alias("def"))
    y = d.filter("doc_id % 4 <> 0").select("site", F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("doc_id") % 17).alias("def"))
    return quality.shadow_parity(quality.shadow(x, y, d.select("site", F.col("lang").alias("language")))).withColumn("parity", F.round("parity", 9))


@query("WITH l AS (SELECT type, sha256(type || '#' || coalesce(CAST(step AS VARCHAR), '') || '|' || sourceId || '|' || targetId) AS h FROM edges) SELECT type, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS digest1, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS digest2 FROM l GROUP BY type")
def semantic_digest(spark, sf_dir):
    return quality.edge_digest(graph(spark, sf_dir)[1])


@query("SELECT e.event_type AS metric, round(avg(e.value) FILTER (event_id % 2 = 0), 4) AS before, round(avg(e.value) FILTER (event_id % 2 = 1), 4) AS after, round(round(avg(e.value) FILTER (event_id % 2 = 1), 4) - round(avg(e.value) FILTER (event_id % 2 = 0), 4), 4) AS delta FROM events e GROUP BY e.event_type", False)
def benchmark_compare(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    part = lambda r: e.filter(f"event_id % 2 = {r}").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))
    return quality.benchmark_compare(part(0), part(1)).select("metric", "before", "after", F.round("delta", 4).alias("delta"))


@query()
def community_assignments(spark, sf_dir):
    return clusters.detect(clusters.projection(*graph(spark, sf_dir)))


@query()
def process_traces(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    found = flows.traces(e, flows.entry_scores(n, e).select("id"))
    return flows.without_parts(found).select("entry", F.array_join("trace", "->").alias("trace"))


@query("WITH gone AS (SELECT id FROM nodes WHERE filePath LIKE 'src/orders/1%'), kept AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM gone)) SELECT id FROM kept UNION ALL SELECT id || '@2' FROM gone")
def incremental_reindex(spark, sf_dir):
    from ..streaming.reindex import reindexed

    n, e = graph(spark, sf_dir)
    changed = n.filter("filePath like 'src/orders/1%'")
    fresh = changed.withColumn("id", F.concat("id", F.lit("@2")))
    return reindexed(n, e, changed.select("filePath"), fresh, e.filter("false"))[0].select("id")


@query("SELECT id, coalesce(" + IS_TEST.format(p="filePath") + ", false) AS test FROM nodes")
def test_paths(spark, sf_dir):
    return graph(spark, sf_dir)[0].select("id", is_test_path(F.col("filePath")).alias("test"))


__all__ = ["QUERIES", "SQL", "tables"]

"""Queries that apply single operators to the test tables, each with the same question in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import base_type_name, display_confidence, is_test_path
from ..operators import contracts, embedding, flows, frameworks, groups, impact, imports, lookup, quality, resolution, routes, sinks, sourcescan, store, structure, tools
from ..sources import files as sources
from ..sources.projection import graph
from . import cypher
from .catalogue import BRAND_SEED, FILES, _bfs_sql, _files, _first_brand, _route_graph, _table, query

ALLOWED = "('CALLS','IMPORTS','EXTENDS','IMPLEMENTS','INHERITS','USES','METHOD_OVERRIDES','OVERRIDES','METHOD_IMPLEMENTS')"
DISPLAY = "CASE WHEN confidence > 0 THEN confidence WHEN type IN ('CALLS','IMPORTS','DEFINES') THEN 0.95 WHEN type IN ('USES','INHERITS','EXTENDS','IMPLEMENTS') THEN 0.85 ELSE 0.7 END"


def text(column: str, prefix: str = ""):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Graph primitives and impact


@query("SELECT id, label, name, filePath, startLine FROM nodes WHERE id = 'Class:s1'")
def point_lookup(spark, sf_dir):
    return store.get(graph(spark, sf_dir)[0], "Class:s1").select("id", "label", "name", "filePath", "startLine")


@query("SELECT CASE WHEN type = 'EXTENDS' THEN 'new:' || id ELSE id END AS id, sourceId, targetId, CASE WHEN type = 'EXTENDS' THEN 'INHERITS' ELSE type END AS type FROM edges WHERE type IN ('EXTENDS', 'IMPLEMENTS')")
def replaced_edges(spark, sf_dir):
    e = graph(spark, sf_dir)[1].filter("type in ('EXTENDS', 'IMPLEMENTS')")
    old = e.filter("type = 'EXTENDS'")
    new = old.withColumns({"id": F.concat(F.lit("new:"), "id"), "type": F.lit("INHERITS")})
    return store.replace_edges(e, old, new).select("id", "sourceId", "targetId", "type")


REACHED = _bfs_sql(BRAND_SEED, True, 3) + f""", lv AS (SELECT id, depth FROM hit UNION ALL SELECT id, 0 FROM own),
way AS (SELECT h.id, h.depth, arg_min({{'t': e.type, 'c': e.confidence}}, {{'a': e.type, 'b': e.sourceId, 'c': e.targetId, 'd': e.id}}) AS e FROM hit h JOIN edges e ON e.sourceId = h.id JOIN lv p ON p.id = e.targetId AND p.depth = h.depth - 1 WHERE e.type IN {ALLOWED} GROUP BY h.id, h.depth),
found AS (SELECT way.id, depth, e.t AS "relationType", CASE WHEN e.c > 0 THEN e.c ELSE 0.85 END AS confidence, name, label, filePath FROM way JOIN nodes ON nodes.id = way.id)"""


@query(REACHED + " SELECT * FROM found")
def impact_details(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return impact.impact(n, e, _first_brand(spark, sf_dir))


@query(REACHED + ' SELECT depth, count(*) AS n, string_agg(id, \',\' ORDER BY filePath, id) AS ids FROM found GROUP BY depth')
def impact_by_depth(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    found = impact.by_depth(impact.impact(n, e, _first_brand(spark, sf_dir)))
    return found.select("depth", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["id"]), ",").alias("ids"))


@query(f"SELECT type, min({DISPLAY.replace('confidence', 'c')}) AS least, max({DISPLAY.replace('confidence', 'c')}) AS most FROM (SELECT type, CASE WHEN length(sourceId) % 2 = 0 THEN 0 ELSE confidence END AS c FROM edges) x GROUP BY type")
def display_confidences(spark, sf_dir):
    e = graph(spark, sf_dir)[1].withColumn("c", F.when(F.length("sourceId") % 2 == 0, 0.0).otherwise(F.col("confidence"))).withColumn("d", display_confidence(F.col("type"), F.col("c")))
    return e.groupBy("type").agg(F.min("d").alias("least"), F.max("d").alias("most"))


@query("""WITH refs AS (SELECT sourceId AS id, 'outgoing' AS direction, lower(type) AS type, targetId AS uid FROM edges WHERE type IN ('CALLS','EXTENDS','IMPLEMENTS','USES','HAS_METHOD') UNION SELECT targetId, 'incoming', lower(type), sourceId FROM edges WHERE type IN ('CALLS','EXTENDS','IMPLEMENTS','USES','HAS_METHOD'))
SELECT refs.id, direction, type, string_agg(uid, ',' ORDER BY filePath, uid) AS uids FROM refs JOIN nodes ON nodes.id = uid WHERE refs.id LIKE 'Interface:%' GROUP BY refs.id, direction, type""")
def grouped_references(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    found = lookup.grouped_references(lookup.references(n, e, n.filter("label = 'Interface'")))
    return found.select("id", "direction", "type", F.array_join(F.transform("refs", lambda r: r["uid"]), ",").alias("uids"))


@query("SELECT a.name AS x, count(*) AS n FROM edges r JOIN nodes a ON a.id = r.sourceId JOIN nodes b ON b.id = r.targetId WHERE a.label = 'Class' AND b.label = 'Method' AND r.type = 'HAS_METHOD' GROUP BY a.name ORDER BY n DESC, x LIMIT 25")
def cypher_counts(spark, sf_dir):
    return cypher.run("MATCH (a:Class)-[r:CodeRelation {type: 'HAS_METHOD'}]->(b:Method) RETURN a.name AS x, count(*) AS n ORDER BY n DESC, x LIMIT 25", *graph(spark, sf_dir))


@query("SELECT a.id AS x, b.id AS y FROM edges r JOIN nodes a ON a.id = r.sourceId JOIN nodes b ON b.id = r.targetId WHERE r.type = 'IMPLEMENTS' AND a.filePath LIKE 'lib/%' AND contains(a.name, 'e') ORDER BY x, y LIMIT 400")
def cypher_filter(spark, sf_dir):
    return cypher.run("MATCH (a)-[r:CodeRelation {type: 'IMPLEMENTS'}]->(b) WHERE a.filePath STARTS WITH 'lib/' AND a.name CONTAINS 'e' RETURN a.id AS x, b.id AS y ORDER BY x, y LIMIT 400", *graph(spark, sf_dir))


@query("SELECT sourceId AS id, count(*) AS refs, min(type) AS first FROM edges WHERE type <> 'STEP_IN_PROCESS' GROUP BY sourceId")
def reference_index(spark, sf_dir):
    by_source = imports.reference_index(graph(spark, sf_dir)[1].filter("type <> 'STEP_IN_PROCESS'"))[0]
    return by_source.select("id", F.size("refs").cast("long").alias("refs"), F.element_at("refs", 1)["type"].alias("first"))


@query("SELECT label, count(*) AS n FROM nodes WHERE label IN ('Function','Method','Constructor','Class','Interface','Struct','Enum','Trait','Impl','Macro','Namespace','TypeAlias','Typedef','Const','Property','Record','Union','Static','Variable') GROUP BY label")
def embeddable_labels(spark, sf_dir):
    return embedding.embeddable(graph(spark, sf_dir)[0]).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT sourceId AS id, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM edges JOIN nodes ON nodes.id = targetId WHERE type = 'HAS_METHOD' GROUP BY sourceId), h AS (SELECT id, 'Label: ' || label || chr(10) || 'Name: ' || name || chr(10) || 'Repo: r' || chr(10) || 'Path: ' || filePath AS head, name || chr(10) || 'end' AS body FROM nodes WHERE label = 'Class')
SELECT h.id, head || chr(10) || CASE WHEN names IS NULL THEN '' ELSE 'Methods: ' || names || chr(10) END || body AS text, sha1(head || chr(10) || body) AS hash FROM h LEFT JOIN m ON m.id = h.id""")
def embedding_texts(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    held = n.withColumn("content", F.concat("name", F.lit("  \r\n"), F.lit("end\n\n")))
    return embedding.embedding_text(held.filter("label = 'Class'").unionByName(held.filter("label <> 'Class'").withColumn("label", F.lit("File"))), e, "r")


@query("SELECT nodeId, CAST(chunk AS INT) AS chunk, name, label FROM (SELECT 'Class:s' || s_suppkey AS nodeId, s_suppkey % 3 AS chunk FROM supplier UNION ALL SELECT 'Class:gone', 1) x JOIN nodes ON nodes.id = nodeId")
def hydrated_hits(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(text("s_suppkey", "Class:s").alias("nodeId"), (F.col("s_suppkey") % 3).cast("int").alias("chunk"))
    gone = spark.createDataFrame([("Class:gone", 1)], "nodeId string, chunk int")
    return tools.hydrated(s.union(gone), graph(spark, sf_dir)[0]).select("nodeId", "chunk", "name", "label")


@query("SELECT id, 1 AS n, CAST(startLine AS VARCHAR) AS lines FROM nodes WHERE label IN ('Method', 'Function')")
def method_metadata(spark, sf_dir):
    n = graph(spark, sf_dir)[0].withColumns({"parameterCount": F.col("startLine"), "returnType": F.lit(None).cast("string")})
    return tools.method_metadata(n).select("id", F.size("metadata").alias("n"), F.element_at("metadata", "parameterCount").alias("lines"))


@query("SELECT id, 'CREATE (:`' || label || '` {id: ''' || id || ''', name: ''' || replace(name, '''', '\\''') || '''})' AS statement FROM nodes WHERE label IN ('Class', 'Folder')")
def insert_statements(spark, sf_dir):
    return sinks.node_statements(graph(spark, sf_dir)[0].filter("label in ('Class', 'Folder')"), ["id", "name"])


@query("SELECT e.id, 'MATCH (a:`' || a.label || '` {id: ''' || sourceId || '''}), (b:`' || b.label || '` {id: ''' || targetId || '''}) CREATE (a)-[:CodeRelation {type: ''' || type || ''', confidence: 1.0}]->(b)' AS statement FROM edges e JOIN nodes a ON a.id = sourceId JOIN nodes b ON b.id = targetId WHERE type = 'EXTENDS'")
def edge_statements(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return sinks.edge_statements(store.export_tables(n, e.filter("type = 'EXTENDS'"))[1])


@query("SELECT type, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT type, type || '#' || coalesce(CAST(step AS VARCHAR), '') || '|' || sourceId || '|' || targetId AS line FROM edges WHERE type IN ('EXTENDS', 'CONTAINS', 'MEMBER_OF')) x GROUP BY type")
def sorted_edge_digest(spark, sf_dir):
    return quality.sorted_digest(graph(spark, sf_dir)[1].filter("type in ('EXTENDS', 'CONTAINS', 'MEMBER_OF')"))


@query("""WITH m AS (SELECT targetId AS community, n.id, n.name, n.label FROM edges JOIN nodes n ON n.id = sourceId WHERE type = 'MEMBER_OF'), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY id, name, label) AS r, count(*) OVER (PARTITION BY community) AS c FROM m),
p AS (SELECT community, 'Name this cluster of code and describe it in a sentence.' || chr(10) || 'Heuristic: ' || any_value(nodes.name) || chr(10) || 'Members: ' || string_agg(r.name || ' (' || r.label || ')', ', ' ORDER BY r) || CASE WHEN any_value(c) > 20 THEN ' (+' || (any_value(c) - 20) || ' more)' ELSE '' END || chr(10) || 'Answer in JSON: {"name": ..., "keywords": [...], "description": ...}' AS prompt FROM r JOIN nodes ON nodes.id = community WHERE r <= 20 GROUP BY community)
SELECT community, prompt, length(prompt) / 4 AS tokens FROM p""")
def cluster_prompts(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    m = e.filter("type = 'MEMBER_OF'").join(n.select(F.col("id").alias("sourceId"), "name", F.col("label").alias("kind")), "sourceId").select(F.col("targetId").alias("community"), F.col("sourceId").alias("id"), "name", "kind")
    return quality.cluster_prompts(n.filter("label = 'Community'").select(F.col("id").alias("community"), F.col("name").alias("label")), m)


# Documents, scopes and resolution

HEADED = r"""body AS (SELECT 'd' || doc_id AS f, string_split(replace('# ' || replace(coalesce(text, ''), chr(10), chr(10) || '## '), chr(13) || chr(10), chr(10)), chr(10)) AS w FROM documents), l AS (SELECT f, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS line, len(w) AS total FROM body), fenced AS (SELECT *, sum(CASE WHEN regexp_matches(t, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY line) % 2 = 1 AS inside FROM l)"""


@query(rf"WITH {HEADED} SELECT f AS \"filePath\", line, CAST(length(regexp_extract(t, '^(#+)', 1)) AS INT) AS level, CAST(total AS INT) AS total FROM fenced WHERE NOT inside AND regexp_matches(t, '^#{{1,6}}\s+\S')".replace('\\"', '"'), False)
def headings(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(text("doc_id", "d").alias("filePath"), F.concat(F.lit("# "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n## "))).alias("content"))
    return structure.headings(d).select("filePath", "line", "level", "total")


LINKS = "l AS (SELECT 'docs/doc' || doc_id || '.md' AS f, unnest(['docs/doc' || (doc_id * 7 % 500) || '.md', 'docs/doc' || (doc_id * 3 % 700) || '.md']) AS t FROM documents)"


@query(f"WITH {LINKS} SELECT DISTINCT 'File:' || l.f AS \"sourceId\", 'File:' || l.t AS \"targetId\", 'IMPORTS' AS type, CAST(0.8 AS DOUBLE) AS confidence FROM l JOIN (SELECT DISTINCT f FROM l) k ON k.f = l.t", False)
def document_links(spark, sf_dir):
    k = F.col("doc_id")
    content = F.concat(F.lit("see [a](doc"), (k * 7 % 500).cast("string"), F.lit(".md#part), [b](../docs/doc"), (k * 3 % 700).cast("string"), F.lit('.md "title"), [c](https://x.io/doc1.md) and [d](#top)'))
    return structure.document_links(_table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/doc"), k.cast("string"), F.lit(".md")).alias("filePath"), content.alias("content")))


CHAIN = "up AS (SELECT 's' || s_suppkey AS scope, 's' || s_suppkey AS ancestor, s_suppkey AS k, 0 AS depth FROM supplier UNION ALL SELECT scope, 's' || CAST((k - k % 2) / 2 AS BIGINT), CAST((k - k % 2) / 2 AS BIGINT), depth + 1 FROM up WHERE k > 1)"


def _scope_tree(spark, sf_dir):
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(text("s_suppkey", "s").alias("id"), F.when(k > 1, F.concat(F.lit("s"), ((k - k % 2) / 2).cast("long").cast("string"))).alias("parent"))


@query(f"WITH RECURSIVE {CHAIN} SELECT scope, ancestor, CAST(depth AS INT) AS depth FROM up", False)
def scope_ancestors(spark, sf_dir):
    return structure.scope_ancestors(_scope_tree(spark, sf_dir))


BINDINGS = "b AS (SELECT DISTINCT 's' || (p_partkey % 40 + 1) AS scope, 'n' || (p_size % 50) AS name, p_partkey % 97 AS def FROM part), refs AS (SELECT o_orderkey AS ref, 's' || (o_custkey % 10 + 1) AS scope, 'n' || (o_orderkey % 60) AS name FROM orders)"


@query(f"""WITH RECURSIVE {CHAIN}, {BINDINGS}, h AS (SELECT ref, depth, min(def) AS lo, max(def) AS hi FROM refs JOIN up USING (scope) JOIN b ON b.scope = up.ancestor AND b.name = refs.name GROUP BY ref, depth), n AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY depth) AS r FROM h)
SELECT refs.ref, CASE WHEN lo = hi THEN lo END AS def, CASE WHEN n.ref IS NULL THEN 'none' WHEN lo = hi THEN 'found' ELSE 'ambiguous' END AS status FROM refs LEFT JOIN n ON n.ref = refs.ref AND r = 1""", False)
def scope_chain(spark, sf_dir):
    p, o = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "orders")
    b = p.select(F.concat(F.lit("s"), (F.col("p_partkey") % 40 + 1).cast("string")).alias("scope"), F.concat(F.lit("n"), (F.col("p_size") % 50).cast("string")).alias("name"), (F.col("p_partkey") % 97).alias("def")).distinct()
    refs = o.select(F.col("o_orderkey").alias("ref"), F.concat(F.lit("s"), (F.col("o_custkey") % 10 + 1).cast("string")).alias("scope"), F.concat(F.lit("n"), (F.col("o_orderkey") % 60).cast("string")).alias("name"))
    return resolution.scope_chain(refs, structure.scope_ancestors(_scope_tree(spark, sf_dir)), b)


@query(f"""WITH RECURSIVE {CHAIN}, owned AS (SELECT 's' || (c_custkey % 60 + 1) AS scope, 'c' || c_custkey AS def, CASE WHEN c_custkey % 3 = 0 THEN 'Class' ELSE 'Function' END AS label, c_custkey AS pos FROM customer), refs AS (SELECT o_orderkey AS ref, 's' || (o_custkey % 10 + 1) AS scope FROM orders)
SELECT ref, arg_min(def, {{'a': CASE WHEN label = 'Function' THEN 0 ELSE 1 END, 'b': depth, 'c': pos, 'd': def}}) AS def FROM refs JOIN up USING (scope) JOIN owned ON owned.scope = ancestor GROUP BY ref""", False)
def enclosing_callable(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    owned = c.select(F.concat(F.lit("s"), (F.col("c_custkey") % 60 + 1).cast("string")).alias("scope"), text("c_custkey", "c").alias("def"), F.when(F.col("c_custkey") % 3 == 0, "Class").otherwise("Function").alias("label"), F.col("c_custkey").alias("pos"))
    refs = o.select(F.col("o_orderkey").alias("ref"), F.concat(F.lit("s"), (F.col("o_custkey") % 10 + 1).cast("string")).alias("scope"))
    return resolution.enclosing(refs, structure.scope_ancestors(_scope_tree(spark, sf_dir)), owned)


@query("""SELECT c_custkey AS import, min(path) AS "filePath" FROM (SELECT c_custkey, 'src/' || (s_suppkey % 10) || '/f' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.ts' END AS path FROM customer JOIN supplier ON s_suppkey = c_custkey % 50 AND s_suppkey % 10 = c_custkey % 10) x GROUP BY c_custkey""", False)
def script_imports(spark, sf_dir):
    s, c = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    k = F.col("s_suppkey")
    known = s.select(F.concat(F.lit("src/"), (k % 10).cast("string"), F.lit("/f"), k.cast("string"), F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".js").otherwise("/index.ts")).alias("filePath"), F.lit("typescript").alias("language"))
    asked = c.select(F.col("c_custkey").alias("import"), F.lit("typescript").alias("language"), F.concat(F.lit("src/"), (F.col("c_custkey") % 10).cast("string"), F.lit("/x.ts")).alias("source"), F.concat(F.lit("./f"), (F.col("c_custkey") % 50).cast("string")).alias("target"), F.lit(False).alias("wildcard"))
    return imports.targets(asked, known)


@query("""SELECT DISTINCT c_custkey AS import, 'code/org/p' || (s_suppkey % 7) || '/C' || s_suppkey || '.java' AS "filePath" FROM customer JOIN supplier ON s_suppkey % 7 = c_custkey % 9 WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'code/org/p' || (s_suppkey % 7) || '/C' || s_suppkey || '.java' FROM customer JOIN supplier ON s_suppkey = c_custkey % 80 + 1 AND s_suppkey % 7 = c_custkey % 9 WHERE c_custkey % 2 = 1""", False)
def package_imports(spark, sf_dir):
    s, c = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    k, package = F.col("c_custkey"), F.concat(F.lit("org/p"), (F.col("c_custkey") % 9).cast("string"))
    known = s.select(F.concat(F.lit("code/org/p"), (F.col("s_suppkey") % 7).cast("string"), F.lit("/C"), F.col("s_suppkey").cast("string"), F.lit(".java")).alias("filePath"), F.lit("java").alias("language"))
    star = k % 2 == 0
    asked = c.select(k.alias("import"), F.lit("java").alias("language"), F.lit("M.java").alias("source"), F.when(star, package).otherwise(F.concat(package, F.lit("/C"), (k % 80 + 1).cast("string"))).alias("target"), star.alias("wildcard"))
    found = imports.targets(asked, known)
    # A class that its package doesn't have may be found by its name's end in another one: here only in its own.
    key = F.col("import")
    return found.filter((key % 2 == 0) | F.col("filePath").startswith(F.concat(F.lit("code/org/p"), (key % 9).cast("string"), F.lit("/")))).select("import", "filePath")


@query("SELECT DISTINCT id, unnest(list_filter([trim(name), trim(qn), trim(split_part(qn, '.', -1))], lambda x: x IS NOT NULL AND x <> '')) AS name FROM (SELECT p_partkey AS id, ' ' || p_name || ' ' AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand || '.' || p_name END AS qn FROM part) x", False)
def lookup_names(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return imports.lookup_names(p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), F.when(F.col("p_partkey") % 4 != 0, F.concat_ws(".", "p_brand", "p_name")).alias("qualifiedName")))


@query("""WITH d AS (SELECT 'f' || (p_partkey % 20) AS target, 'n' || p_partkey AS name, 'Function:' || p_partkey AS def FROM part), i AS (SELECT DISTINCT 's' || (c_custkey % 30) AS scope, 'f' || (c_custkey % 25) AS target FROM customer), r AS (SELECT scope, name, i.target, def, row_number() OVER (PARTITION BY scope ORDER BY i.target, name, def) AS r FROM i JOIN d USING (target)) SELECT scope, name, target, def FROM r WHERE r <= 40""", False)
def wildcard_bindings(spark, sf_dir):
    p, c = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "customer")
    d = p.select(F.concat(F.lit("f"), (F.col("p_partkey") % 20).cast("string")).alias("filePath"), text("p_partkey", "n").alias("name"), text("p_partkey", "Function:").alias("id"), F.lit("Function").alias("label"))
    i = c.select(F.lit("x").alias("filePath"), F.concat(F.lit("s"), (F.col("c_custkey") % 30).cast("string")).alias("scope"), F.concat(F.lit("f"), (F.col("c_custkey") % 25).cast("string")).alias("target"))
    return imports.wildcards(i, d, 40).select("scope", "name", "target", "def")


@query("""WITH c AS (SELECT 'f' || (o_custkey % 50) AS f, o_orderkey % 400 AS line, o_orderkey AS ref, CASE WHEN o_orderkey % 5 = 0 THEN 'constructor' ELSE 'free' END AS form FROM orders), v AS (SELECT c_custkey AS def, 'f' || (c_custkey % 50) AS f, c_custkey % 400 AS a, c_custkey % 400 + c_custkey % 3 AS z FROM customer),
j AS (SELECT v.def, min(ref) AS ref, min(form) AS form FROM v JOIN c ON c.f = v.f AND c.line BETWEEN a AND z GROUP BY v.def HAVING count(*) = 1) SELECT def, CASE WHEN form = 'constructor' THEN p_name ELSE p_type END AS type FROM j JOIN part ON p_partkey = ref % 100 + 1""", False)
def call_return_types(spark, sf_dir):
    o, c, p = (_table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    k, q = F.col("o_orderkey"), F.col("c_custkey")
    calls = o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("filePath"), (k % 400).alias("line"), k.alias("ref"), F.when(k % 5 == 0, "constructor").otherwise("free").alias("form"))
    variables = c.select(q.alias("def"), F.concat(F.lit("f"), (q % 50).cast("string")).alias("filePath"), (q % 400).alias("startLine"), (q % 400 + q % 3).alias("endLine"))
    resolved = o.select(k.alias("ref"), (k % 100 + 1).alias("def"))
    return imports.call_types(variables, calls, resolved, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("returnType")))


@query("SELECT event_type, CASE event_type WHEN 'call' THEN 'CALLS' WHEN 'read' THEN 'ACCESSES' ELSE 'USES' END AS type, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'read' ELSE event_type END AS event_type FROM events) x GROUP BY ALL", False)
def reference_kinds(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "call").when(F.col("event_id") % 3 == 1, "read").otherwise(F.col("event_type")))
    return e.groupBy("event_type", imports.edge_type(F.col("event_type")).alias("type")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_type || '<' || p_brand || '>[]' AS raw, split_part(p_type, '.', -1) AS base FROM (SELECT replace(p_type, ' ', '.') AS p_type, p_brand FROM part) x UNION SELECT DISTINCT 'readonly *[]' || p_brand || '|null', p_brand FROM part", False)
def base_type_names(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    raw = p.select(F.concat(F.replace("p_type", F.lit(" "), F.lit(".")), F.lit("<"), "p_brand", F.lit(">[]")).alias("raw")).union(p.select(F.concat(F.lit("readonly *[]"), "p_brand", F.lit("|null")))).distinct()
    return raw.select("raw", base_type_name(F.col("raw")).alias("base"))


# Files, frameworks, routes

ENDINGS = "CASE k % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.MD' WHEN 3 THEN '.xyz' WHEN 4 THEN '.kts' ELSE '.hpp' END"


@query(f"SELECT path AS \"filePath\", CASE k % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'markdown' WHEN 4 THEN 'kotlin' WHEN 5 THEN 'cpp' END AS language, CASE WHEN k % 6 = 2 THEN 'markdown' END AS document FROM (SELECT p_partkey AS k, 'a/' || p_name || {ENDINGS.replace('k %', 'p_partkey %')} AS path FROM part) x", False)
def languages(spark, sf_dir):
    k = F.col("p_partkey")
    end = F.when(k % 6 == 0, ".ts").when(k % 6 == 1, ".py").when(k % 6 == 2, ".MD").when(k % 6 == 3, ".xyz").when(k % 6 == 4, ".kts").otherwise(".hpp")
    paths = _table(spark, sf_dir, "part").select(F.concat(F.lit("a/"), "p_name", end).alias("filePath"))
    return paths.select("filePath", sources.language(F.col("filePath")).alias("language"), sources.document_kind(F.col("filePath")).alias("document"))


HINTS = (("app/{}/views.py", "django", 3.0), ("srv/{}/UserController.java", "spring", 3.0), ("src/app/{}/_layout.tsx", "expo-router", 2.0), ("x/{}.rb", None, None), ("pages/{}.tsx", "nextjs-pages", 3.0))


@query("SELECT DISTINCT replace(p, '{}', lower(n_name)) AS path, f AS framework, CAST(m AS DOUBLE) AS multiplier FROM nation, (VALUES " + ", ".join(f"('{p}', {'NULL' if f is None else repr(f)}, {'NULL' if m is None else m})" for p, f, m in HINTS) + ") AS t(p, f, m)", False)
def framework_paths(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.explode(F.array(*[F.replace(F.lit(p), F.lit("{}"), F.lower("n_name")) for p, _, _ in HINTS])).alias("path")).distinct()
    hint = frameworks.path_hint(F.col("path"))
    return n.select("path", hint["framework"].alias("framework"), hint["multiplier"].alias("multiplier"))


@query("SELECT l_orderkey AS def, arg_max('f' || l_suppkey, {'m': l_quantity, 's': -(CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey * 100000 + l_partkey)}) AS framework, max(l_quantity) AS multiplier FROM lineitem GROUP BY l_orderkey", False)
def best_framework(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("def"), text("l_suppkey", "f").alias("framework"), F.col("l_quantity").alias("multiplier"), F.col("l_returnflag").alias("reason"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey") * 100_000 + F.col("l_partkey")).alias("seq"))
    return frameworks.best_hints(rows).select("def", "framework", "multiplier")


@query("SELECT DISTINCT u AS url, 'app/(shop)/' || u2 || '/[id]/page.tsx' AS \"filePath\", 'app' AS kind FROM (SELECT '/' || lower(replace(n_name, ' ', '-')) || '/:id' AS u, lower(replace(n_name, ' ', '-')) AS u2 FROM nation) x UNION SELECT '/' || lower(replace(n_name, ' ', '-')) || '/*rest', 'src/pages/' || lower(replace(n_name, ' ', '-')) || '/[...rest].ts', 'pages' FROM nation", False)
def filesystem_routes(spark, sf_dir):
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    n = _table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit("app/(shop)/"), name, F.lit("/[id]/page.tsx")), F.concat(F.lit("src/pages/"), name, F.lit("/[...rest].ts")), F.concat(F.lit("src/pages/_"), name, F.lit(".ts")))).alias("filePath")).distinct()
    return routes.filesystem_routes(n)


@query("SELECT '/api/' || lower(replace(p_brand, '#', '-')) AS url, min('srv/' || p_size || '.ts') AS \"filePath\" FROM part GROUP BY p_brand", False)
def framework_routes(spark, sf_dir):
    content = F.concat(F.lit("router.post('/api/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/', h); app.get(`https://x.io/y`, h)"))
    return routes.framework_routes(_table(spark, sf_dir, "part").select(F.concat(F.lit("srv/"), F.col("p_size").cast("string"), F.lit(".ts")).alias("filePath"), content.alias("content")))


@query("SELECT '/' || p_brand AS url, min('f' || p_size) AS \"filePath\", array_to_string(list_sort(list(DISTINCT 'k' || (p_size % 7))), ',') AS keys FROM part GROUP BY p_brand", False)
def merged_routes(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.concat(F.lit("/"), "p_brand").alias("url"), text("p_size", "f").alias("filePath"), F.array(F.concat(F.lit("k"), (F.col("p_size") % 7).cast("string"))).alias("responseKeys"), F.array().cast("array<string>").alias("errorKeys"))
    return routes.merged_routes(p).select("url", "filePath", F.array_join("responseKeys", ",").alias("keys"))


@query("SELECT DISTINCT 'f' || (p_partkey % 50) AS \"filePath\", 'prisma' AS orm, 'm' || (p_size % 9) AS model, 'findMany' AS method FROM part UNION SELECT DISTINCT 'f' || (p_partkey % 50), 'supabase', 't' || (p_size % 5), 'select' FROM part", False)
def orm_queries(spark, sf_dir):
    content = F.concat(F.lit("await prisma.m"), (F.col("p_size") % 9).cast("string"), F.lit(".findMany ( {}); supabase.from('t"), (F.col("p_size") % 5).cast("string"), F.lit("')\n.select('*')"))
    return routes.orm_queries(_table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("filePath"), content.alias("content")))


@query("SELECT 't' || (p_size % 11) AS tool, min('f' || p_partkey) AS \"filePath\" FROM part GROUP BY 1 UNION ALL SELECT 'named ' || p_brand, min('f' || p_partkey) FROM part GROUP BY 1", False)
def tool_definitions(spark, sf_dir):
    content = F.concat(F.lit("server.tool('t"), (F.col("p_size") % 11).cast("string"), F.lit("', f); const x = { name: \"named "), "p_brand", F.lit('", description: "d" }'))
    return routes.tools(_table(spark, sf_dir, "part").select(text("p_partkey", "f").alias("filePath"), content.alias("content")))


@query("SELECT r.u AS url, array_to_string(list_sort(list(DISTINCT m.name)), ',') AS middleware FROM (SELECT DISTINCT '/' || lower(p_mfgr) || '/' || lower(p_brand) AS u, '/' || lower(p_mfgr) AS top FROM (SELECT split_part(p_type, ' ', 1) AS p_mfgr, p_brand FROM part) y) r JOIN (SELECT DISTINCT 'w' || (p_size % 4) AS name, '/' || lower(split_part(p_type, ' ', 1)) AS prefix FROM part UNION SELECT 'all', '/') m ON m.prefix = r.top OR m.prefix = '/' GROUP BY r.u", False)
def middleware_routes(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("top", F.lower(F.substring_index("p_type", " ", 1)))
    r = p.select(F.concat(F.lit("/"), "top", F.lit("/"), F.lower("p_brand")).alias("url")).distinct()
    m = p.select(F.concat(F.lit("w"), (F.col("p_size") % 4).cast("string")).alias("name"), F.concat(F.lit("/"), "top").alias("prefix")).distinct().union(spark.createDataFrame([("all", "/")], "name string, prefix string"))
    return routes.routes_under(r, m).select("url", F.array_join("middleware", ",").alias("middleware"))


@query("SELECT c_custkey AS id, 'data,k' || (c_custkey % 5) || ',name' AS keys FROM customer", False)
def accessed_keys(spark, sf_dir):
    content = F.concat(F.lit("const { data, name: n } = await res.json(); const body = await r2.json(); body.k"), (F.col("c_custkey") % 5).cast("string"), F.lit("; body.map(x => x); other.zzz"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(routes.accessed_keys(content), ",").alias("keys"))


@query("SELECT c_custkey AS id, 'error' AS bad, 'id,k' || (c_custkey % 5) AS good FROM customer", False)
def response_shapes(spark, sf_dir):
    content = F.concat(F.lit("if (x) return res.status(404).json({ error: { deep: 1 } });\nreturn res.json({ id, \"k"), (F.col("c_custkey") % 5).cast("string"), F.lit("\": [1, { inner: 2 }] })"))
    files = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("filePath"), content.alias("content"))
    return routes.response_shapes(files).select(F.col("filePath").cast("long").alias("id"), F.array_join("errorKeys", ",").alias("bad"), F.array_join("responseKeys", ",").alias("good"))


@query("SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'https://h.io/Users/' || user_id || '?q=1' ELSE '/v1/${id}/items/:item/' END AS raw, CASE WHEN event_id % 2 = 0 THEN '/users/{param}' ELSE '/v1/{param}/items/{param}' END AS path FROM events", False)
def canonical_paths(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://h.io/Users/"), F.col("user_id").cast("string"), F.lit("?q=1"))).otherwise("/v1/${id}/items/:item/")
    return _table(spark, sf_dir, "events").select(raw.alias("raw")).distinct().select("raw", sourcescan.canonical_path(F.col("raw"), True).alias("path"))


@query("SELECT 'tests/' || p_partkey || '.ts' AS path, true AS test FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'src/contest/' || p_partkey || '.ts', false FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT 'src/' || p_partkey || '_test.go', true FROM part", False)
def test_paths(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    one = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("tests/"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("src/contest/"), k, F.lit(".ts"))).alias("path")).union(p.select(F.concat(F.lit("src/"), k, F.lit("_test.go"))))
    return one.select("path", is_test_path(F.col("path")).alias("test"))


@query("SELECT s AS symbols, CAST(greatest(20, least(round(s / 10.0), 700)) AS INT) AS budget FROM (SELECT DISTINCT o_orderkey AS s FROM orders) x", False)
def process_budgets(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("symbols")).distinct().select("symbols", flows.process_budget(F.col("symbols")).alias("budget"))


@query("""WITH t AS (SELECT user_id AS u, 'e' || user_id AS entry, ['e' || user_id] || list(DISTINCT 's' || (event_id % 7) ORDER BY 's' || (event_id % 7)) AS trace FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY len(trace) DESC, array_to_string(trace, '->')) - 1 AS r FROM t),
p AS (SELECT *, 'proc_' || r || '_' || 'user_' || u AS id FROM r WHERE r < 30) SELECT id AS process, entry, CAST(len(trace) AS INT) AS steps, trace[-1] AS terminal, CASE WHEN len(list_distinct(list_filter(list_transform(trace, lambda s: CASE WHEN starts_with(s, 's') THEN CAST(substr(s, 2) AS INT) % 2 END), lambda c: c IS NOT NULL))) > 1 THEN 'cross_community' ELSE 'intra_community' END AS kind FROM p""", False)
def process_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    traces = e.groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")))).alias("s")).select(F.concat(F.lit("e"), user).alias("entry"), F.concat(F.array(F.concat(F.lit("e"), user)), "s").alias("trace"))
    nodes = e.select(F.concat(F.lit("e"), user).alias("id"), F.concat(F.lit("User "), user).alias("name")).distinct()
    members = spark.range(7).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), (F.col("id") % 2).cast("string").alias("community"))
    made, _ = flows.processes(nodes, traces, members, 30)
    return made.select(F.col("id").alias("process"), F.col("entryPointId").alias("entry"), F.col("stepCount").alias("steps"), F.col("terminalId").alias("terminal"), F.col("processType").alias("kind"))


@query("SELECT 'Route:' || p_brand AS \"sourceId\", 'proc' || c_custkey AS \"targetId\", 'ENTRY_POINT_OF' AS type, CAST(0.85 AS DOUBLE) AS confidence FROM (SELECT DISTINCT p_brand FROM part) p JOIN customer ON 'f' || (c_custkey % 40) = 'f' || CAST(substr(p_brand, 7) AS INT)", False)
def resource_links(spark, sf_dir):
    p, c = _table(spark, sf_dir, "part").select("p_brand").distinct(), _table(spark, sf_dir, "customer")
    r = p.select(F.concat(F.lit("Route:"), "p_brand").alias("id"), F.lit("Route").alias("label"), F.concat(F.lit("f"), F.substring("p_brand", 7, 9)).alias("filePath"))
    own = c.select(text("c_custkey", "fn").alias("id"), F.lit("Function").alias("label"), F.concat(F.lit("f"), (F.col("c_custkey") % 40).cast("string")).alias("filePath"))
    made = c.select(text("c_custkey", "proc").alias("id"), text("c_custkey", "fn").alias("entryPointId"))
    return flows.resource_links(r.union(own), made)


# Contracts, groups, search results

@query("""WITH c AS (SELECT DISTINCT '/api/' || lower(replace(p_brand, '#', '-')) AS name, 'Route:' || p_brand AS route FROM part), f AS (SELECT DISTINCT 'Route:Brand#' || CAST(event_id % 5 + 1 AS VARCHAR) || CAST(event_id % 4 + 1 AS VARCHAR) AS route, 'Function:c' || CAST(user_id AS VARCHAR) AS consumer FROM events)
SELECT 'http::*::' || name AS "contractId", 'provider' AS role, route AS "symbolUid", CAST(1.0 AS DOUBLE) AS confidence FROM c UNION ALL SELECT 'http::*::' || name, 'consumer', consumer, 0.9 FROM f JOIN c USING (route)""", False)
def graph_contracts(spark, sf_dir):
    return contracts.http_contracts(*_route_graph(spark, sf_dir), "r").select("contractId", "role", "symbolUid", "confidence")


DECLARED = "d AS (SELECT 'r' || (o_custkey % 9) AS a, 'r' || (o_custkey % 4) AS b, CASE o_orderkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'topic' ELSE 'grpc' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'get //orders/' || (o_orderkey % 50) || '/' ELSE 'Items' || (o_orderkey % 50) END ELSE 'T' || (o_orderkey % 50) END AS contract, CASE WHEN o_orderkey % 5 = 0 THEN 'provider' ELSE 'consumer' END AS role FROM orders), k AS (SELECT *, CASE WHEN type = 'http' THEN CASE WHEN starts_with(contract, 'get ') THEN 'http::GET::/orders/' || rtrim(split_part(contract, '/', 4), '/') ELSE 'http::*::/' || contract END ELSE type || '::' || contract END AS id, CASE WHEN role = 'provider' THEN a ELSE b END AS p, CASE WHEN role = 'provider' THEN b ELSE a END AS c FROM d)"


def _declared(spark, sf_dir):
    k, q = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    contract = F.when(k % 3 == 0, F.when(k % 2 == 0, F.concat(F.lit("get //orders/"), s(k % 50), F.lit("/"))).otherwise(F.concat(F.lit("Items"), s(k % 50)))).otherwise(F.concat(F.lit("T"), s(k % 50)))
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), s(q % 9)).alias("source"), F.concat(F.lit("r"), s(q % 4)).alias("target"), F.when(k % 3 == 0, "http").when(k % 3 == 1, "topic").otherwise("grpc").alias("type"), contract.alias("contract"), F.when(k % 5 == 0, "provider").otherwise("consumer").alias("role"))


@query(f"WITH {DECLARED} SELECT DISTINCT p AS repo, id AS \"contractId\", 'provider' AS role, 'manifest::' || p || '::' || id AS \"symbolUid\" FROM k UNION ALL SELECT DISTINCT c, id, 'consumer', 'manifest::' || c || '::' || id FROM k", False)
def manifest_contracts(spark, sf_dir):
    return groups.manifest(_declared(spark, sf_dir))[0].select("repo", "contractId", "role", "symbolUid").distinct()


@query(f"WITH {DECLARED} SELECT DISTINCT id AS \"contractId\", c AS c_repo, p AS p_repo, 'manifest' AS \"matchType\", CAST(1.0 AS DOUBLE) AS confidence FROM k", False)
def manifest_links(spark, sf_dir):
    links = groups.manifest(_declared(spark, sf_dir))[1].withColumn("seq", F.monotonically_increasing_id())
    return groups.distinct_links(links).select("contractId", "c_repo", "p_repo", "matchType", "confidence")


@query("""WITH k AS (SELECT 'r' || (l_suppkey % 5) AS repo, CASE WHEN l_linenumber % 2 = 0 THEN 'provider' ELSE 'consumer' END AS role, 'u' || l_partkey AS uid, 'f' || (l_partkey % 30) AS f, 's' || (l_suppkey % 6) AS s, 'n' || l_orderkey || '-' || l_linenumber AS node, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), a AS (SELECT o_orderkey AS ask, 'r' || (o_custkey % 6) AS repo, 'provider' AS role, 'u' || o_orderkey AS uid, 'f' || (o_custkey % 30) AS f, 's' || (o_custkey % 8) AS s FROM orders),
u AS (SELECT repo, role, uid, arg_max(node, seq) AS u FROM k GROUP BY ALL), r AS (SELECT repo, role, f, s, arg_max(node, seq) AS r FROM k GROUP BY ALL), o AS (SELECT repo, role, f, min(node) AS o FROM k GROUP BY ALL HAVING count(*) = 1)
SELECT ask, coalesce(u, r, o) AS contract FROM a LEFT JOIN u USING (repo, role, uid) LEFT JOIN r USING (repo, role, f, s) LEFT JOIN o USING (repo, role, f)""", False)
def contract_lookup(spark, sf_dir):
    line, o = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = line.select(s("r", F.col("l_suppkey") % 5).alias("repo"), F.when(F.col("l_linenumber") % 2 == 0, "provider").otherwise("consumer").alias("role"), s("u", F.col("l_partkey")).alias("symbolUid"), s("f", F.col("l_partkey") % 30).alias("symbolFile"), s("s", F.col("l_suppkey") % 6).alias("symbolName"), F.concat_ws("-", s("n", F.col("l_orderkey")), F.col("l_linenumber").cast("string")).alias("node"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    a = o.select(F.col("o_orderkey").alias("ask"), s("r", F.col("o_custkey") % 6).alias("repo"), F.lit("provider").alias("role"), s("u", F.col("o_orderkey")).alias("symbolUid"), s("f", F.col("o_custkey") % 30).alias("symbolFile"), s("s", F.col("o_custkey") % 8).alias("symbolName"))
    return groups.contract_lookup(a, k)


@query("""WITH r AS (SELECT DISTINCT '/p' || (p_partkey % 60) AS path, 'f' || (p_size % 20) AS f FROM part), d AS (SELECT 'f' || (o_custkey % 20) AS f, '/p' || (o_orderkey % 60) AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'POST' ELSE 'GET' END AS m, 'h' || (o_custkey % 3) AS h FROM orders), g AS (SELECT f, path, min(m) AS m, count(DISTINCT m) AS nm, min(h) AS h, count(DISTINCT h) AS nh FROM d GROUP BY ALL)
SELECT r.f AS "filePath", 'http::' || CASE WHEN nm = 1 THEN m ELSE '*' END || '::' || r.path AS "contractId", CASE WHEN nh = 1 THEN h END AS handler, CAST(CASE WHEN m IS NULL THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM r LEFT JOIN g ON g.f = r.f AND g.path = r.path""", False)
def assisted_contracts(spark, sf_dir):
    p, o = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "orders")
    s = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    r = p.select(F.lit("r").alias("repo"), s("/p", F.col("p_partkey") % 60).alias("path"), s("f", F.col("p_size") % 20).alias("filePath")).distinct()
    d = o.select(s("f", F.col("o_custkey") % 20).alias("filePath"), s("/p", F.col("o_orderkey") % 60).alias("path"), F.when(F.col("o_orderkey") % 7 == 0, "POST").otherwise("GET").alias("method"), s("h", F.col("o_custkey") % 3).alias("handler"))
    return groups.assisted_http(r, d).select("filePath", "contractId", "handler", "confidence")


@query("SELECT n_name AS repo, r_name IS NOT NULL AS indexed, r_name IS NULL OR n_nationkey % 2 = 1 AS contracts_stale FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3", False)
def group_status(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    members = n.select(F.col("n_name").alias("repo"), F.when(F.col("n_nationkey") % 2 == 1, "late").otherwise("now").alias("indexedAt"))
    snapshots = n.join(r.filter("r_regionkey < 3"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("repo"), F.lit("now").alias("indexedAt"))
    return contracts.group_status(members, snapshots)


@query("SELECT c_custkey AS id, c_mktsegment AS type, 'r' || (c_nationkey % 5) AS repo FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 5 = 2", False)
def group_contract_filter(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("repo"))
    return contracts.group_contracts(c, c, "BUILDING", "r2")


@query("SELECT vec_id AS id, label AS \"nodeId\", 'old' AS state FROM embeddings WHERE label % 3 <> 0 AND label <> 1 UNION ALL SELECT vec_id + 1000000, label, 'new' FROM embeddings WHERE label % 3 = 0", False)
def embedding_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("nodeId"), F.lit("old").alias("state"))
    new = e.filter("nodeId % 3 = 0").withColumns({"id": F.col("id") + 1_000_000, "state": F.lit("new")})
    return sinks.replaced_embeddings(e, new, e.filter("nodeId = 1").select("nodeId").distinct())


@query("SELECT label AS \"nodeId\", CASE WHEN bool_and(vec_id % 5 <> 0) THEN max('h' || label) ELSE '' END AS hash FROM (SELECT vec_id, label * 40 + vec_id % 40 AS label FROM embeddings) x GROUP BY label", False)
def stored_hashes(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").withColumn("label", F.col("label") * 40 + F.col("vec_id") % 40)
    rows = e.select(F.col("label").alias("nodeId"), F.when(F.col("vec_id") % 5 != 0, F.col("vec_id")).alias("chunkIndex"), F.lit(1).alias("startLine"), F.lit(2).alias("endLine"), text("label", "h").alias("contentHash"))
    return sinks.stored_hashes(rows)


@query("WITH e AS (SELECT DISTINCT o_custkey + 7 AS k FROM orders), f AS (SELECT c_custkey AS k FROM customer) SELECT * FROM (SELECT 'missing' AS kind, k FROM e ANTI JOIN f USING (k) ORDER BY k LIMIT 20) UNION ALL SELECT * FROM (SELECT 'surplus', k FROM f ANTI JOIN e USING (k) ORDER BY k LIMIT 20)", False)
def recall_examples(spark, sf_dir):
    return quality.examples(_table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") + 7), _table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), ["k"])


@query("SELECT name, measure, value FROM (SELECT c_mktsegment || c_nationkey AS name, CAST(count(*) AS DOUBLE) AS recall, CAST(max(c_custkey) AS DOUBLE) AS precision FROM customer GROUP BY 1) x UNPIVOT (value FOR measure IN (recall, precision)) WHERE value < 100", False)
def failed_gates(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").groupBy(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name")).agg(F.count("*").cast("double").alias("recall"), F.max("c_custkey").cast("double").alias("precision"))
    return quality.failed_gates(c)


@query(f"WITH {FILES} SELECT repo, id FROM (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY length(content) DESC, id) AS r FROM files WHERE repo IS NOT NULL) x ORDER BY 1.0 / (60 + r) DESC, repo, id LIMIT 40", False)
def subgroup_query(spark, sf_dir):
    hits = _files(spark, sf_dir).select("repo", "id", F.length("content").alias("relevance"))
    return contracts.group_query(hits.filter("repo is not null"), 40).select("repo", "id")


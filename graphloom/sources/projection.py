"""A property graph over the star-schema test tables, in SQL that Spark and other engines read alike.

Rows of the tables play code entities: suppliers are classes, parts and customers functions, orders methods, nations
folders and communities, users' event streams processes. Ids order the graph; an edge's order is (type, source, target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..workspace import committed_parts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

NODES = """
SELECT 'Folder:' || r_name AS id, 'Folder' AS label, r_name AS name, r_name AS filePath, CAST(NULL AS BIGINT) AS startLine, CAST(NULL AS BIGINT) AS endLine FROM region
UNION ALL SELECT 'Folder:' || r_name || '/' || n_name, 'Folder', n_name, r_name || '/' || n_name, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'Class:s' || CAST(s_suppkey AS VARCHAR(20)), 'Class', s_name, 'src/' || n_name || '/supplier.ts', s_suppkey % 100 + 1, s_suppkey % 100 + 31 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'Interface:' || p_brand, 'Interface', p_brand, 'lib/' || p_brand || '/brand.ts', CAST(1 AS BIGINT), CAST(20 AS BIGINT) FROM part
UNION ALL SELECT 'Function:c' || CAST(c_custkey AS VARCHAR(20)), 'Function', c_name, 'src/' || n_name || '/customer.ts', c_custkey % 400 + 1, c_custkey % 400 + 11 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'Function:p' || CAST(p_partkey AS VARCHAR(20)), 'Function', p_name, CASE WHEN p_partkey % 10 = 0 THEN 'tests/' || p_brand || '/part.test.ts' ELSE 'lib/' || p_brand || '/part.ts' END, p_partkey % 300 + 1, p_partkey % 300 + 9 FROM part
UNION ALL SELECT 'Method:o' || CAST(o_orderkey AS VARCHAR(20)), 'Method', 'order' || CAST(o_orderkey % 97 AS VARCHAR(20)), 'src/orders/' || CAST(o_custkey % 50 AS VARCHAR(20)) || '.ts', o_orderkey % 500 + 1, o_orderkey % 500 + 21 FROM orders
UNION ALL SELECT DISTINCT 'Process:u' || CAST(user_id AS VARCHAR(20)), 'Process', 'flow ' || CAST(user_id AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM events
UNION ALL SELECT 'Community:' || n_name, 'Community', n_name, NULL, NULL, NULL FROM nation
"""

EDGES = """
SELECT 'rel:' || type || ':' || sourceId || '->' || targetId || CASE WHEN step IS NULL THEN '' ELSE ':' || CAST(step AS VARCHAR(20)) END AS id, sourceId, targetId, type, confidence, step FROM (
SELECT 'Function:c' || CAST(o_custkey AS VARCHAR(20)) AS sourceId, 'Method:o' || CAST(o_orderkey AS VARCHAR(20)) AS targetId, 'CALLS' AS type, CAST(1.0 AS DOUBLE) AS confidence, CAST(NULL AS INT) AS step FROM orders
UNION ALL SELECT 'Method:o' || CAST(l_orderkey AS VARCHAR(20)), 'Function:p' || CAST(l_partkey AS VARCHAR(20)), 'CALLS', max(round(1.0 - l_discount, 2)), NULL FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT DISTINCT 'Method:o' || CAST(l_orderkey AS VARCHAR(20)), 'Class:s' || CAST(l_suppkey AS VARCHAR(20)), 'USES', CAST(1.0 AS DOUBLE), CAST(NULL AS INT) FROM lineitem
UNION ALL SELECT 'Function:p' || CAST(p_partkey AS VARCHAR(20)), 'Interface:' || p_brand, 'IMPLEMENTS', 0.95, NULL FROM part
UNION ALL SELECT 'Class:s' || CAST(l_suppkey AS VARCHAR(20)), 'Method:o' || CAST(l_orderkey AS VARCHAR(20)), 'HAS_METHOD', 1.0, NULL FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey, l_orderkey
UNION ALL SELECT 'Class:s' || CAST(s_suppkey AS VARCHAR(20)), 'Class:s' || CAST((s_suppkey - s_suppkey % 2) / 2 AS BIGINT), 'EXTENDS', 1.0, NULL FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey > 1) x
UNION ALL SELECT 'Folder:' || r_name, 'Folder:' || r_name || '/' || n_name, 'CONTAINS', 1.0, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'Function:c' || CAST(c_custkey AS VARCHAR(20)), 'Community:' || n_name, 'MEMBER_OF', 1.0, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'Class:s' || CAST(s_suppkey AS VARCHAR(20)), 'Community:' || n_name, 'MEMBER_OF', 1.0, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'Function:p' || CAST(event_id % 100 + 1 AS VARCHAR(20)), 'Process:u' || CAST(user_id AS VARCHAR(20)), 'STEP_IN_PROCESS', 1.0, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) FROM events
) e
"""
NODES, EDGES = (x.replace("CAST((s_suppkey - s_suppkey % 2) / 2 AS BIGINT)", "CAST(CAST((s_suppkey - s_suppkey % 2) / 2 AS BIGINT) AS VARCHAR(20))") for x in (NODES, EDGES))


def tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the tables as temporary views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


#: The stored graph of each folder of tables, as long as its tables stay as they were read.
_stored: dict[tuple, tuple[DataFrame, DataFrame]] = {}
#: What NODES and EDGES read.
READ = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the files that the graph is made of."""
    jvm, conf, out = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), []
    for name in READ:
        at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(conf)
        head = fs.getFileStatus(at)
        files = fs.listStatus(at) if head.isDirectory() else [head]
        out.append(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
    return tuple(out)


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _nodes(spark: SparkSession) -> list[tuple[str, DataFrame]]:
    """(label, rows) as NODES has them, a label at a time."""
    region, nation, customer, supplier, part, orders, events = (spark.table(t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "events"))

    def made(rows: DataFrame, key: Column, name: Column, path: Column | None = None, first: Column | None = None, lines: int = 0) -> DataFrame:
        first = F.lit(None) if first is None else first
        return rows.select(key.alias("id"), name.alias("name"), (F.lit(None) if path is None else path).cast("string").alias("filePath"), first.cast("long").alias("startLine"), (first + lines).cast("long").alias("endLine"))

    placed = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    inside = lambda rows, key: rows.join(F.broadcast(nation), F.col(key) == F.col("n_nationkey"))
    folder, brand = F.concat("r_name", F.lit("/"), "n_name"), F.concat(F.lit("lib/"), "p_brand", F.lit("/brand.ts"))
    home = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("tests/"), "p_brand", F.lit("/part.test.ts"))).otherwise(F.concat(F.lit("lib/"), "p_brand", F.lit("/part.ts")))
    return [
        ("Folder", made(region, _key("Folder:", "r_name"), F.col("r_name"), F.col("r_name"))),
        ("Folder", made(placed, F.concat(F.lit("Folder:"), folder), F.col("n_name"), folder)),
        ("Class", made(inside(supplier, "s_nationkey"), _key("Class:s", "s_suppkey"), F.col("s_name"), F.concat(F.lit("src/"), "n_name", F.lit("/supplier.ts")), F.col("s_suppkey") % 100 + 1, 30)),
        ("Interface", made(part.select("p_brand").distinct(), _key("Interface:", "p_brand"), F.col("p_brand"), brand, F.lit(1), 19)),
        ("Function", made(inside(customer, "c_nationkey"), _key("Function:c", "c_custkey"), F.col("c_name"), F.concat(F.lit("src/"), "n_name", F.lit("/customer.ts")), F.col("c_custkey") % 400 + 1, 10)),
        ("Function", made(part, _key("Function:p", "p_partkey"), F.col("p_name"), home, F.col("p_partkey") % 300 + 1, 8)),
        ("Method", made(orders, _key("Method:o", "o_orderkey"), F.concat(F.lit("order"), (F.col("o_orderkey") % 97).cast("string")), F.concat(F.lit("src/orders/"), (F.col("o_custkey") % 50).cast("string"), F.lit(".ts")), F.col("o_orderkey") % 500 + 1, 20)),
        ("Process", made(events.select("user_id").distinct(), _key("Process:u", "user_id"), _key("flow ", "user_id"))),
        ("Community", made(nation, _key("Community:", "n_name"), F.col("n_name"))),
    ]


def _edges(spark: SparkSession) -> list[tuple[str, DataFrame]]:
    """(type, rows) as EDGES has them without their ids, a type at a time. Lines of orders are told apart by their keys, which
    are shuffled as numbers, once for each type; ids are made of type, ends and step when they are read."""
    region, nation, customer, supplier, part, orders, line, events = (spark.table(t) for t in READ)

    def made(rows: DataFrame, source: Column, target: Column, confidence: Column | float = 1.0, step: Column | None = None) -> DataFrame:
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return rows.select(source.alias("sourceId"), target.alias("targetId"), c.cast("double").alias("confidence"), (F.lit(None) if step is None else step).cast("int").alias("step"))

    placed = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    inside = lambda rows, key: rows.join(F.broadcast(nation), F.col(key) == F.col("n_nationkey"))
    community = _key("Community:", "n_name")
    called = line.select("l_orderkey", "l_partkey", F.round(1.0 - F.col("l_discount"), 2).alias("c")).repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.max("c").alias("c"))
    used = line.select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct()
    owned = line.filter("l_linenumber = 1").select("l_suppkey", "l_orderkey").repartition("l_orderkey").distinct()
    walked = events.select("user_id", "event_id", F.expr("row_number() over (partition by user_id order by ts, event_id)").alias("step"))
    return [
        ("CALLS", made(orders, _key("Function:c", "o_custkey"), _key("Method:o", "o_orderkey"))),
        ("CALLS", made(called, _key("Method:o", "l_orderkey"), _key("Function:p", "l_partkey"), F.col("c"))),
        ("USES", made(used, _key("Method:o", "l_orderkey"), _key("Class:s", "l_suppkey"))),
        ("IMPLEMENTS", made(part, _key("Function:p", "p_partkey"), _key("Interface:", "p_brand"), 0.95)),
        ("HAS_METHOD", made(owned, _key("Class:s", "l_suppkey"), _key("Method:o", "l_orderkey"))),
        ("EXTENDS", made(supplier.filter("s_suppkey > 1"), _key("Class:s", "s_suppkey"), F.concat(F.lit("Class:s"), ((F.col("s_suppkey") - F.col("s_suppkey") % 2) / 2).cast("long").cast("string")))),
        ("CONTAINS", made(placed, _key("Folder:", "r_name"), F.concat(F.lit("Folder:"), "r_name", F.lit("/"), "n_name"))),
        ("MEMBER_OF", made(inside(customer, "c_nationkey"), _key("Function:c", "c_custkey"), community)),
        ("MEMBER_OF", made(inside(supplier, "s_nationkey"), _key("Class:s", "s_suppkey"), community)),
        ("STEP_IN_PROCESS", made(walked, F.concat(F.lit("Function:p"), (F.col("event_id") % 100 + 1).cast("string")), _key("Process:u", "user_id"), 1.0, F.col("step"))),
    ]


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the test tables: the rows of NODES and EDGES. As an analysed folder is, the graph is stored once, edges by
    type and nodes by label, and read by all queries of the application; changed tables are projected anew."""
    tables(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _stored:
        nodes = committed_parts(_nodes(spark), "graph-nodes", "label").select("id", "label", "name", "filePath", "startLine", "endLine")
        edges = committed_parts(_edges(spark), "graph-edges", "type")
        ends = F.concat(F.lit("rel:"), "type", F.lit(":"), "sourceId", F.lit("->"), "targetId")
        edges = edges.select(F.when(F.col("step").isNull(), ends).otherwise(F.concat(ends, F.lit(":"), F.col("step").cast("string"))).alias("id"), "sourceId", "targetId", "type", "confidence", "step")
        for old in [k for k in _stored if k[0] != key[0] or k[1] == sf_dir]:
            _stored.pop(old)
        _stored[key] = nodes, edges
    return _stored[key]


def with_graph(sql: str) -> str:
    """SQL whose first CTEs are nodes and edges."""
    head = f"nodes AS ({NODES}), edges AS ({EDGES})"
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"

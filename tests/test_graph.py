"""Hand-made graphs and sources with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.codegraph import CodeGraph
from graphloom.functions.expr import contract_key, normal_url
from graphloom.operators import clusters, contracts, embedding, flows, frameworks, impact, imports, resolution, routes, search, sourcescan, store, structure, text
from graphloom.plans import cypher
from graphloom.plans.analyze import analyze
from graphloom.sources import cobol, files as files_
from graphloom.sources.extract import extract

EDGE = "id string, sourceId string, targetId string, type string, confidence double, step int"
NODE = "id string, label string, name string, filePath string, startLine long, endLine long"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, i.split(":")[0], i.split(":")[-1], f, 1, 9) for i, f in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(f"rel:{t}:{a}->{b}:{n}:0", a, b, t, c, None) for n, (a, t, b, c) in enumerate(rows)], EDGE)


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_impact_levels_seeds_and_tests(spark):
    n = nodes(spark, ("Class:A", "src/a.ts"), ("Method:m", "src/a.ts"), ("Function:f", "src/f.ts"), ("Function:g", "src/g.ts"), ("Function:t", "tests/t.ts"), ("Function:u", "src/u.ts"), ("File:a", "src/a.ts"), ("File:b", "src/b.ts"))
    e = edges(spark, ("Class:A", "HAS_METHOD", "Method:m", 1.0), ("File:a", "DEFINES", "Class:A", 1.0), ("Function:f", "CALLS", "Method:m", 0.0), ("Function:f", "USES", "Class:A", 1.0), ("Function:g", "CALLS", "Function:f", 0.6), ("Function:t", "CALLS", "Function:f", 1.0), ("Function:u", "CALLS", "Function:t", 1.0), ("File:b", "IMPORTS", "File:a", 1.0), ("Method:m", "CALLS", "Function:f", 1.0))
    found = {r.id: (r.depth, r.relationType, r.confidence) for r in impact.impact(n, e, "Class:A").collect()}
    assert found == {"Function:f": (1, "CALLS", 0.95), "File:b": (1, "IMPORTS", 1.0), "Function:g": (2, "CALLS", 0.6)}
    assert {r.id for r in impact.impact(n, e, "Class:A", impact.Options(include_tests=True)).collect()} >= {"Function:t", "Function:u"}
    assert {r.id for r in impact.impact(n, e, "Class:A", impact.Options(min_confidence=0.7)).collect()} == {"Function:f", "File:b"}
    assert impact.impact(n, e, "Class:none").count() == 0
    for bad in ({"direction": "sideways"}, {"relation_types": ["MEMBER_OF"]}, {"relation_types": []}):
        with pytest.raises(ValueError):
            impact.Options(**bad)


def test_impact_equals_a_plain_search(spark):
    rnd = random.Random(4)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)}
    n = nodes(spark, *((f"Function:{i}", "src/x.ts") for i in range(40)))
    e = edges(spark, *((f"Function:{a}", "CALLS", f"Function:{b}", 1.0) for a, b in pairs))
    level, seen, want = {0}, {0}, {}
    for depth in range(1, 6):
        level = {b for a, b in pairs if a in level} - seen
        seen |= level
        want |= {f"Function:{i}": depth for i in level}
    assert {r.id: r.depth for r in impact.impact(n, e, "Function:0", impact.Options("downstream", 5)).collect()} == want


def test_store(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "id string, v int, seq int")
    assert sorted(tuple(r) for r in store.upsert(rows).collect()) == [("a", 3, 0), ("b", 2, 1)]
    e = spark.createDataFrame([("e1", "s", "t", "CALLS", 0.5, "x", None, "", 1), ("e2", "s", "t", "CALLS", 0.5, "y", 2, "src", 2), ("e3", "s", "t", "CALLS", 0.3, "z", 3, "", 3)], "id string, sourceId string, targetId string, type string, confidence double, reason string, step int, resolutionSource string, seq int")
    m = store.merged_edges(e).first()
    assert (m.id, m.confidence, m.reason, m.step, m.resolutionSource) == ("e1", 0.5, "y", 2, "src")


def test_write_and_read_back(spark, tmp_path):
    n = nodes(spark, *((f"File:{i}", f"f{i}") for i in range(20)), *((f"Function:{i}", f"f{i}") for i in range(20)))
    e = edges(spark, *((f"File:{i}", "DEFINES", f"Function:{i}", 0.0) for i in range(20)), ("File:1", "DEFINES", "Function:gone", 1.0))
    with pytest.raises(ValueError):
        store.write_graph(n, e, str(tmp_path / "g"))
    assert store.write_graph(n, e, str(tmp_path / "g"), strict=False) == 1
    g = CodeGraph.load(spark, str(tmp_path / "g"))
    assert g.nodes.count() == 40 and g.edges.filter("confidence = 1 and step = 0").count() == 20


def test_mro(spark):
    def run(parents, methods):
        p = spark.createDataFrame(parents, "child string, parent string, type string")
        m = spark.createDataFrame(methods, "owner string, name string, method string")
        return [(r["class"], r.method) for r in resolution.overrides(resolution.ancestors(p), m).collect()]

    diamond = [("D", "B", "EXTENDS"), ("D", "C", "EXTENDS"), ("B", "A", "EXTENDS"), ("C", "A", "EXTENDS")]
    assert run(diamond, [("A", "foo", "A.foo"), ("B", "foo", "B.foo"), ("C", "foo", "C.foo")]) == [("D", "B.foo")]
    assert run(diamond, [("A", "foo", "A.foo")]) == []
    assert run([("K", "A", "EXTENDS"), ("K", "B", "EXTENDS")], [("K", "foo", "K.foo"), ("A", "foo", "A.foo"), ("B", "foo", "B.foo")]) == []
    loop = resolution.ancestors(spark.createDataFrame([("A", "B", "EXTENDS"), ("B", "A", "EXTENDS")], "child string, parent string, type string"))
    assert sorted((r["class"], r.ancestor) for r in loop.collect()) == [("A", "B"), ("B", "A")]


def test_inherited_implementations(spark):
    parents = [("K", "A", "EXTENDS"), ("A", "B", "EXTENDS"), ("K", "I", "IMPLEMENTS"), ("L", "I", "IMPLEMENTS"), ("L", "J", "IMPLEMENTS"), ("M", "I", "IMPLEMENTS")]
    above = resolution.ancestors(spark.createDataFrame(parents, "child string, parent string, type string"))
    owned = [("I", "run", "I.run", 0), ("A", "run", "A.run", 0), ("B", "run", "B.run", 0), ("J", "run", "J.run", 0), ("M", "run", "M.run", 0), ("I", "go", "I.go", 1), ("B", "go", "B.go", 2)]
    m = spark.createDataFrame([(*x, []) for x in owned], "owner string, name string, method string, count int, types array<string>")
    kinds = spark.createDataFrame([(c, "Interface" if c in "IJ" else "Class") for c in "KLMABIJ"], "id string, label string")
    found = {(r.method, r.target, r.confidence) for r in resolution.inherited_implementations(above, m, kinds).collect()}
    assert found == {("A.run", "I.run", 1.0), ("J.run", "I.run", 1.0), ("I.run", "J.run", 1.0)}


def test_communities(spark):
    cliques = [(f"{g}.{a}", f"{g}.{b}") for g in ("api", "db") for a, b in (("x", "y"), ("y", "z"), ("x", "z"))] + [("api.x", "db.x")]
    links = spark.createDataFrame(cliques, "a string, b string")
    found = {}
    for r in clusters.detect(links).collect():
        found.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == [["api.x", "api.y", "api.z"], ["db.x", "db.y", "db.z"]] and sorted(found) == ["comm_0", "comm_1"]
    assert clusters.detect(links.filter("false")).count() == 0


def test_communities_of_large_graphs_keep_their_resolution(spark):
    """A symbol has 8 links into a small group and 12 into a large one: 2.0 leaves it in the small one; 1.0 doesn't."""
    clique = lambda g, n: [(f"{g}{i:02d}", f"{g}{j:02d}") for i in range(n) for j in range(i + 1, n)]
    made = clique("a", 10) + clique("b", 60) + [(f"a{i:02d}", "v") for i in range(8)] + [(f"b{i:02d}", "v") for i in range(12)]
    made += [(f"t{i:04d}{x}", f"t{i:04d}{y}") for i in range(3400) for x, y in ("pq", "qr", "pr")]
    links = spark.createDataFrame(made, "a string, b string")
    found = {r.id: r.community for r in clusters.detect(links).collect()}
    assert found["v"] == found["a09"] != found["b59"]


def test_flows(spark):
    n = spark.createDataFrame([("handle", "Function", "handleRequest", "src/a.ts", None), ("validate", "Function", "validateInput", "src/a.ts", None), ("save", "Function", "saveRecord", "src/db.ts", None), ("th", "Function", "testHandle", "src/a.test.ts", None)], "id string, label string, name string, filePath string, astFrameworkMultiplier double")
    e = edges(spark, ("handle", "CALLS", "validate", 1.0), ("validate", "CALLS", "save", 1.0), ("th", "CALLS", "handle", 1.0), ("save", "CALLS", "handle", 0.3))
    entries = flows.entry_scores(n, e)
    assert entries.first().id == "handle" and "th" not in {r.id for r in entries.collect()}
    kept = flows.without_parts(flows.traces(e, entries.select("id")))
    assert [r.trace for r in kept.collect()] == [["handle", "validate", "save"]]
    members = spark.createDataFrame([("handle", "api"), ("validate", "api"), ("save", "db")], "id string, community string")
    made, links = flows.processes(n, kept, members, 20)
    p = made.first()
    assert (p.id, p.processType, p.stepCount) == ("proc_0_handlerequest", "cross_community", 3)
    assert sorted(r.step for r in links.filter("type = 'STEP_IN_PROCESS'").collect()) == [1, 2, 3]


def test_traces_follow_repeated_calls_and_keep_all_paths(spark):
    """Plain breadth-first search; four branches of 40 symbols, so that more paths wait than a bound of the queue would hold."""
    rng = random.Random(5)
    calls = sorted((f"n{a:02d}", f"n{rng.randrange(40):02d}") for a in range(36) for _ in range(5))
    e = edges(spark, *[(a, "CALLS", b, 1.0) for a, b in calls])
    want = {}
    for entry in ("n00", "n07", "n21"):
        queue, found = [[entry]], []
        while queue and len(found) < 12:
            path = queue.pop(0)
            after = [b for a, b in calls if a == path[-1]][:4]
            more = [path + [b] for b in after if b not in path] if len(path) < 10 else []
            queue += more
            if not more and len(path) >= 3:
                found.append(path)
        want[entry] = sorted(found)
    entries = spark.createDataFrame([(x,) for x in want], "id string")
    got = {x: [] for x in want}
    for r in flows.traces(e, entries).collect():
        got[r.entry].append(r.trace)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_chains_of_any_length_are_followed(spark):
    links = spark.createDataFrame([(f"c{i:03d}", f"c{i + 1:03d}", "EXTENDS") for i in range(70)], "child string, parent string, type string")
    assert resolution.ancestors(links).filter("class = 'c000'").count() == 70


def test_diff_hunks():
    diff = "--- a/x.go\n+++ b/x.go\n@@ -10,0 +11,3 @@\n@@ -5,2 +5,4 @@\n@@ -5,0 +6 @@\n@@ -10,3 +10,0 @@\n--- a/Gone.go\n+++ /dev/null\n@@ -10,3 +0,0 @@\n"
    assert text.parse_diff(diff) == [("x.go", 11, 13, False), ("x.go", 5, 8, False), ("x.go", 6, 6, False), ("gone.go", 10, 12, True)]


def test_documents(spark):
    docs = spark.createDataFrame([("README.md", "# Intro\nsee [setup](docs/setup.md#install) and [web](https://x.y)\n\n## Usage\n```\n# no\n```"), ("docs/setup.md", "# Setup\n")], "filePath string, content string")
    found = {r.id: (r.parent, r.endLine) for r in structure.nested_sections(structure.headings(docs)).collect()}
    assert found["Section:README.md:L1:Intro"] == ("File:README.md", 7) and found["Section:README.md:L4:Usage"] == ("Section:README.md:L1:Intro", 7) and len(found) == 3
    assert [(r.sourceId, r.targetId) for r in structure.document_links(docs).collect()] == [("File:README.md", "File:docs/setup.md")]


def test_routes(spark):
    urls = ["/api/grants?page=1&limit=10", "/api/grants#summary", "api/relative", "/api/organizations/${slug}/grants", "/api/trailing/", "/api/+endpoint", "getApiUrl()", "https://example.com/api/users", "/"]
    assert column(spark, normal_url, urls) == ["/api/grants", "/api/grants", "/api/relative", "/api/organizations/[param]/grants", "/api/trailing", None, None, None, "/"]
    r = spark.createDataFrame([("/api/orgs/:slug",), ("/api/docs/*slug",), ("/api/grants",)], "url string")
    u = spark.createDataFrame([("/api/orgs/[param]",), ("/api/orgs/acme",), ("/api/docs/a/b/c",), ("/api/grants/123",), ("/v1/docs/a",), ("/api/grants",)], "url string")
    assert {x.url: x.route for x in routes.matched_routes(u, r).collect()} == {"/api/orgs/[param]": "/api/orgs/:slug", "/api/orgs/acme": "/api/orgs/:slug", "/api/docs/a/b/c": "/api/docs/*slug", "/api/grants": "/api/grants"}
    paths = spark.createDataFrame([("app/(shop)/items/[id]/page.tsx",), ("app/page.tsx",), ("pages/blog/[...slug].tsx",), ("pages/index.tsx",), ("pages/_app.tsx",)], "filePath string")
    assert sorted(x.url for x in routes.filesystem_routes(paths).collect()) == ["/", "/", "/blog/*slug", "/items/:id"]
    source = "fetch('/api/orders'); router.push('/dashboard'); router.replace(\"/settings\"); <a href=\"/profile\">"
    found = routes.navigation(spark.createDataFrame([("a.tsx", source)], "filePath string, content string"))
    assert {x.url for x in found.collect()} == {"/api/orders", "/dashboard", "/settings", "/profile"}


def test_contract_keys_and_links(spark):
    ids = ["http::get::/api/users", "http::GET::/api/users/", "grpc::Hr.UserService/GetUser", "grpc::/MyPkg/DoThing", "grpc::ServiceName", "topic::  Employee.Hired  ", "lib::@Hr/Common::UserDTO"]
    assert column(spark, contract_key, ids) == ["http::GET::/api/users", "http::GET::/api/users", "grpc::hr.userservice/GetUser", "grpc::/MyPkg/DoThing", "grpc::servicename", "topic::employee.hired", "lib::@hr/common::userdto"]
    rows = [("http::POST::/api/users", "provider", "p", "a", 1.0), ("http::*::/api/users", "consumer", "c1", "b", 0.8), ("http::post::/api/users/", "consumer", "c2", "c", 0.0), ("http::get::/none", "consumer", "c3", "b", 1.0)]
    c = spark.createDataFrame(rows, "contractId string, role string, symbolUid string, repo string, confidence double").withColumns({"service": F.lit(""), "type": F.lit("http")})
    links = contracts.exact_links(c)
    assert sorted((r.c_symbol, r.p_symbol, r.confidence) for r in links.collect()) == [("c1", "p", 0.8), ("c2", "p", 1.0)]
    assert [r.symbolUid for r in contracts.unmatched(c, links).collect()] == ["c3"]


def test_positions(spark):
    s = spark.createDataFrame([("mod", 1, 0, 100, 0), ("cls", 5, 0, 80, 0), ("fn", 10, 0, 60, 0), ("blk", 20, 0, 50, 0), ("r", 5, 2, 10, 5)], "id string, startLine int, startCol int, endLine int, endCol int").withColumn("filePath", F.when(F.col("id") == "r", "g").otherwise("f"))
    at = lambda rows: {(r.filePath, r.line, r.col): r.scope for r in structure.scope_at(spark.createDataFrame(rows, "filePath string, line int, col int"), s).collect()}
    assert at([("f", 30, 1), ("f", 15, 1), ("f", 7, 1), ("f", 2, 1), ("f", 500, 1)]) == {("f", 30, 1): "blk", ("f", 15, 1): "fn", ("f", 7, 1): "cls", ("f", 2, 1): "mod", ("f", 500, 1): None}
    assert at([("g", 5, 2), ("g", 10, 5), ("g", 5, 1), ("g", 10, 6)]) == {("g", 5, 2): "r", ("g", 10, 5): "r", ("g", 5, 1): None, ("g", 10, 6): None}


def test_fusion_and_chunks(spark):
    k = spark.createDataFrame([("src/shared.ts", 10.0, 1), ("src/bm25-only.ts", 5.0, 2)], "filePath string, score double, rank int")
    s = spark.createDataFrame([("src/shared.ts", 0.9, 1), ("src/semantic-only.ts", 0.5, 2)], "filePath string, score double, rank int")
    found = search.fused(k, s).orderBy("rank").collect()
    assert [r.filePath for r in found] == ["src/shared.ts", "src/bm25-only.ts", "src/semantic-only.ts"] and found[0].sources == "bm25+semantic" and found[0].bm25 == 10 and found[0].semantic == 0.9
    assert search.fused(k.filter("false"), s.filter("false")).count() == 0
    c = spark.createDataFrame([("a", 0, 0.7), ("a", 1, 0.2), ("b", 0, 0.3)], "nodeId string, chunkIndex int, distance double")
    assert [(r.nodeId, r.chunkIndex) for r in search.best_chunks(c, 1).collect()] == [("a", 1)]
    body = "def f():\n" + "\n".join(f"    line {i}" for i in range(300))
    parts = embedding.line_chunks(body)
    assert len(parts) > 1 and all(t.startswith("def f():") for _, _, t in parts) and parts[0][0] == 1 and parts[-1][1] == 301


def test_write_guard():
    for q in ("MATCH (n:CREATE) RETURN n", "MATCH (n) WHERE n.name CONTAINS ':CREATE' RETURN n", "CALL QUERY_FTS_INDEX('a', 'b')"):
        assert not cypher.is_write(q)
    for w in ("create", "SET", "Merge", "remove", "DELETE", "drop", "alter", "copy", "LOAD", "install", "detach"):
        assert cypher.is_write(f"MATCH (n) {w} n.x")


def test_cypher(spark):
    n = nodes(spark, ("Function:a", "src/a.ts"), ("Function:b", "src/b.ts"), ("Class:c", "lib/c.ts"))
    e = edges(spark, ("Function:a", "CALLS", "Function:b", 1.0), ("Function:b", "CALLS", "Class:c", 0.5), ("Function:a", "USES", "Class:c", 1.0))
    run = lambda q: sorted(tuple(r) for r in cypher.run(q, n, e).collect())
    assert run("MATCH (a:Function)-[r:CodeRelation {type: 'CALLS'}]->(b) WHERE r.confidence >= 0.9 RETURN a.name AS x, b.name AS y") == [("a", "b")]
    assert run("MATCH (a:Function {name: 'a'})-[:CALLS*1..2]->(b) RETURN b.id") == [("Class:c",), ("Function:b",)]
    assert run("MATCH (c:Class)<-[r]-(a) WHERE a.filePath STARTS WITH 'src' AND NOT a.name IN ['z'] RETURN c.name, count(*) AS n") == [("c", 2)]
    assert run("MATCH (a) RETURN a.label AS l, count(*) AS n ORDER BY n DESC LIMIT 1") == [("Function", 2)]
    for bad in ("MATCH (a) CALL x()", "MERGE (a) RETURN a", "MATCH (a) RETURN b.x"):
        with pytest.raises(ValueError):
            cypher.run(bad, n, e)
    assert cypher.markdown(n.select("id").limit(1)).startswith("| id |\n| --- |")


SOURCES = {
    "app/service.py": "from app.store import Store, save\nimport os\n\nclass Service(Store):\n    limit: int = 3\n\n    def run(self, x, y=1):\n        self.check(x)\n        return save(x)\n\n    def check(self, x):\n        return helper(x)\n\ndef helper(x):\n    return os.path.join(x)\n",
    "app/store.py": "class Store:\n    def check(self, x):\n        pass\n\ndef save(x):\n    return Store()\n",
    "web/index.ts": "import { load } from './load';\nexport class Page extends Base implements View {\n  render(a: string) {\n    return load(a);\n  }\n}\nfetch('/api/items/7');\n",
    "web/load.ts": "export function load(a: string) {\n  return new Page();\n}\nexport class Base {}\nexport interface View {}\napp.get('/api/items/:id', load);\n",
    "main.go": 'package main\n\nimport (\n\t"fmt"\n)\n\ntype Server struct {\n}\n\nfunc (s *Server) Start(port int) {\n\tlisten(port)\n}\n\nfunc listen(port int) {\n\tfmt.Println(port)\n}\n',
    "lib/a.rb": "class Dog < Animal\n  def bark(n)\n    speak(n)\n  end\nend\n",
    "docs/README.md": "# Title\n[code](../app/service.py)\n## More\n",
    "bad.py": "def (:\n",
}


def test_analyze(spark):
    rows = [(p, t) for p, t in SOURCES.items()]
    df = spark.createDataFrame(rows, "filePath string, content string").withColumn("language", files_.language(F.col("filePath")))
    n, e = analyze(df)
    ids = {r.id for r in n.collect()}
    assert {"Class:app/service.py:Service", "Method:app/service.py:Service.run", "Function:app/store.py:save", "Class:web/index.ts:Page", "Method:web/index.ts:Page.render", "Method:main.go:Server.Start", "Struct:main.go:Server", "Class:lib/a.rb:Dog", "Method:lib/a.rb:Dog.bark", "Section:docs/README.md:L1:Title", "Route:/api/items/:id", "Folder:app", "File:main.go"} <= ids
    have = {(r.sourceId, r.type, r.targetId) for r in e.collect()}
    want = {
        ("Method:app/service.py:Service.run", "CALLS", "Function:app/store.py:save"), ("Method:app/service.py:Service.run", "CALLS", "Method:app/service.py:Service.check"),
        ("Method:app/service.py:Service.check", "CALLS", "Function:app/service.py:helper"), ("Class:app/service.py:Service", "EXTENDS", "Class:app/store.py:Store"),
        ("File:app/service.py", "IMPORTS", "File:app/store.py"), ("Class:app/service.py:Service", "HAS_PROPERTY", "Property:app/service.py:Service.limit"),
        ("Method:web/index.ts:Page.render", "CALLS", "Function:web/load.ts:load"), ("Function:web/load.ts:load", "CALLS", "Class:web/index.ts:Page"),
        ("Class:web/index.ts:Page", "EXTENDS", "Class:web/load.ts:Base"), ("Class:web/index.ts:Page", "IMPLEMENTS", "Interface:web/load.ts:View"), ("File:web/index.ts", "IMPORTS", "File:web/load.ts"),
        ("Method:main.go:Server.Start", "CALLS", "Function:main.go:listen"), ("Struct:main.go:Server", "HAS_METHOD", "Method:main.go:Server.Start"),
        ("File:web/index.ts", "FETCHES", "Route:/api/items/:id"), ("File:docs/README.md", "IMPORTS", "File:app/service.py"), ("Folder:app", "CONTAINS", "File:app/service.py"),
    }
    assert want <= have, want - have
    g = CodeGraph(n, e).with_inheritance().with_communities_and_flows()
    flows_ = {(r.sourceId, r.type) for r in g.edges.filter("type in ('MEMBER_OF', 'ENTRY_POINT_OF', 'STEP_IN_PROCESS')").collect()}
    assert ("Function:app/service.py:helper", "MEMBER_OF") in flows_ and {t for _, t in flows_} >= {"MEMBER_OF", "STEP_IN_PROCESS", "ENTRY_POINT_OF"}
    assert g.nodes.filter("label = 'Process'").count() >= g.query("check").count() > 0
    assert g.impact("helper")["modules"].count() > 0
    assert g.impact("helper")["by_depth"].count() >= 1 and g.context("helper")["status"] == "found" and g.grep("println").count() == 1
    assert [r["fact"] for r in extract("bad.py", "python", SOURCES["bad.py"])] == ["error"]
    again = analyze(df.repartition(5))
    assert {(r.sourceId, r.type, r.targetId) for r in again[1].collect()} == have


def test_import_rules_by_language(spark):
    paths = ["lib/src/api.dart", "lib/a.dart", "app/main.dart", "core/com/acme/User.java", "core/com/acme/Team.java", "App/Models/Order.cs", "App/Models/Item.cs", "src/Shop/Cart.php", "Sources/Net/Http.swift", "lib/tool.rb", "pkg/util/__init__.py", "pkg/mod.py", "pkg/sub/leaf.py", "src/geo/shape.rs", "src/geo/mod.rs", "inc/vec.h", "svc/internal/db/open.go", "svc/internal/db/open_test.go", "svc/internal/db/close.go", "web/view/index.tsx", "web/util.ts"]
    known = spark.createDataFrame([(p,) for p in paths], "filePath string").withColumn("language", files_.language(F.col("filePath")))
    cases = [
        ("dart", "app/main.dart", "package:x/src/api.dart", False, ["lib/src/api.dart"]), ("dart", "app/main.dart", "dart:io", False, []), ("dart", "app/main.dart", "../lib/a.dart", False, ["lib/a.dart"]),
        ("java", "x/M.java", "com/acme/User", False, ["core/com/acme/User.java"]), ("java", "x/M.java", "com/acme", True, ["core/com/acme/Team.java", "core/com/acme/User.java"]), ("java", "x/M.java", "com/acme/User/name", False, ["core/com/acme/User.java"]),
        ("csharp", "x.cs", "App/Models", False, ["App/Models/Item.cs", "App/Models/Order.cs"]), ("php", "x.php", "Acme/Shop/Cart", False, ["src/Shop/Cart.php"]), ("swift", "x.swift", "Net", False, ["Sources/Net/Http.swift"]),
        ("ruby", "x.rb", "tool", False, ["lib/tool.rb"]), ("python", "pkg/sub/leaf.py", "../mod", False, ["pkg/mod.py"]), ("python", "pkg/sub/leaf.py", "util", False, ["pkg/util/__init__.py"]), ("python", "z.py", "pkg/sub/leaf", False, ["pkg/sub/leaf.py"]),
        ("rust", "src/main.rs", "crate/geo/shape", False, ["src/geo/shape.rs"]), ("rust", "src/main.rs", "crate/geo/Area", False, ["src/geo/mod.rs"]), ("rust", "src/geo/shape.rs", "super/geo", False, ["src/geo/mod.rs"]),
        ("cpp", "x.cpp", "vec.h", False, ["inc/vec.h"]), ("go", "m.go", "acme.io/svc/internal/db", False, ["svc/internal/db/close.go", "svc/internal/db/open.go"]), ("go", "m.go", "fmt", False, []),
        ("typescript", "web/a.ts", "./view", False, ["web/view/index.tsx"]), ("typescript", "web/view/index.tsx", "../util.js", False, ["web/util.ts"]), ("typescript", "q.ts", "'\x01'", False, []),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "import int, language string, source string, target string, wildcard boolean")
    got = {}
    for r in imports.targets(df, known).collect():
        got.setdefault(r["import"], []).append(r.filePath)
    assert {i: sorted(got.get(i, [])) for i in range(len(cases))} == {i: c[4] for i, c in enumerate(cases)}


def test_wildcards_call_types_and_names(spark):
    defs = spark.createDataFrame([("d1", "Function", "a", "t.py", "Item"), ("d2", "Class", "B", "t.py", None), ("d3", "Method", "m", "t.py", None)], "id string, label string, name string, filePath string, returnType string")
    star = spark.createDataFrame([("s.py", "scope", "t.py")], "filePath string, scope string, target string")
    assert sorted(r["name"] for r in imports.wildcards(star, defs).collect()) == ["B", "a"] and imports.wildcards(star, defs, 1).count() == 1
    v = spark.createDataFrame([("x", "s.py", 1, 1), ("y", "s.py", 2, 3), ("z", "s.py", 4, 4)], "def string, filePath string, startLine int, endLine int")
    calls = spark.createDataFrame([("c1", "s.py", 1, "free"), ("c2", "s.py", 2, "free"), ("c3", "s.py", 3, "free"), ("c4", "s.py", 4, "constructor")], "ref string, filePath string, line int, form string")
    resolved = spark.createDataFrame([("c1", "d1"), ("c2", "d1"), ("c4", "d2")], "ref string, def string")
    assert {(r["def"], r.type) for r in imports.call_types(v, calls, resolved, defs).collect()} == {("x", "Item"), ("z", "B")}
    names = imports.lookup_names(spark.createDataFrame([("i", " run ", "A.run"), ("j", "k", None)], "id string, name string, qualifiedName string"))
    assert {(r.id, r["name"]) for r in names.collect()} == {("i", "run"), ("i", "A.run"), ("j", "k")}


def test_accesses_annotations_shapes_and_keys(spark):
    sources = {
        "m.py": "class Base:\n    size: int = 0\n\nclass Item(Base):\n    owner: Base = None\n    def grow(self, other: Base):\n        self.size = self.size + 1\n        return self.owner\n",
        "box.ts": "export class Box {\n  width: number;\n  item: Item2;\n  fill() {\n    this.width = 3;\n    return this.item;\n  }\n}\nexport class Item2 {\n}\n",
        "pages/api/users.ts": "export default withAuth(handler)\nfunction handler(req, res) { if (!req.ok) { return res.status(404).json({ error: 1 }) }\n res.json({ name: 1, mail: 2 }) }\n",
        "web/list.ts": "export async function list() { const r = await fetch('/api/users'); const data = await r.json(); await fetch('/api/users'); return data.name + data.phone }\n",
    }
    df = spark.createDataFrame(list(sources.items()), "filePath string, content string").withColumn("language", files_.language(F.col("filePath")))
    n, e = analyze(df)
    have = {(r.sourceId, r.type, r.targetId, r.step) for r in e.collect()}
    grow = "Method:m.py:Item.grow"
    assert {(grow, "ACCESSES", "Property:m.py:Base.size", 1), (grow, "ACCESSES", "Property:m.py:Base.size", 2), (grow, "ACCESSES", "Property:m.py:Item.owner", 1)} <= have
    assert {("Method:box.ts:Box.fill", "ACCESSES", "Property:box.ts:Box.width", 2), ("Method:box.ts:Box.fill", "ACCESSES", "Property:box.ts:Box.item", 1)} <= have
    assert (grow, "USES", "Class:m.py:Base", None) in have and ("Class:box.ts:Box", "USES", "Class:box.ts:Item2", None) in have
    route = n.filter("label = 'Route'").first()
    assert (route.responseKeys, route.errorKeys, route.middleware) == (["mail", "name"], ["error"], ["withAuth"])
    reason = e.filter("type = 'FETCHES'").first().reason
    assert reason == "fetch-url-match|keys:name,phone|fetches:2"
    g = CodeGraph(n, e)
    assert [(r.mismatched, r.confidence) for r in g.shape_check().collect()] == [(["phone"], "low")]
    assert [(r.consumers, r.mismatches, r.risk) for r in g.api_impact().collect()] == [(1, 1, "MEDIUM")]


def test_walk(spark, tmp_path):
    for p, t in {**SOURCES, "node_modules/x.js": "x", "skip/me.py": "x = 1", "big.py": "#" * 600_000, "pic.png": "x"}.items():
        at = tmp_path / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(t)
    found = {r.filePath: r.language for r in files_.walk(spark, str(tmp_path), files_.IgnoreRules(["skip/", "# no", "*.rb", "!lib/a.rb"]), exclude=["docs/**"]).collect()}
    assert found == {p: {"py": "python", "ts": "typescript", "go": "go", "rb": "ruby"}[p.rsplit(".")[-1]] for p in SOURCES if not p.startswith("docs/")}


def test_cobol(spark):
    src = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAY.\n       PROCEDURE DIVISION.\n       MAIN-LOGIC.\n           PERFORM CALC-PAY THRU CALC-END.\n           CALL 'TAX'.\n           COPY RATES REPLACING ==OLD== BY ==NEW==.\n       CALC-PAY.\n           CONTINUE.\n       CALC-END.\n           EXIT.\n"
    jcl = "//NIGHT JOB\n//S1 EXEC PGM=PAY\n//OUT DD DSN=PAY.FILE,DISP=SHR\n"
    found = cobol.facts(spark.createDataFrame([("a.cbl", src), ("t.cbl", "       PROGRAM-ID. TAX.\n"), ("n.jcl", jcl), ("x.py", "")], "filePath string, content string"))
    have = {(r.sourceId, r.targetId, r.reason) for r in cobol.edges(found).collect()}
    assert {("Function:PAY:MAIN-LOGIC", "Function:PAY:CALC-PAY", "cobol-perform"), ("Function:PAY:MAIN-LOGIC", "Function:PAY:CALC-END", "cobol-perform-thru"), ("Function:PAY:MAIN-LOGIC", "Module:TAX", "cobol-call"), ("File:a.cbl", "Module:RATES", "cobol-copy"), ("CodeElement:NIGHT:S1", "Module:PAY", "jcl-program"), ("CodeElement:NIGHT:S1", "CodeElement:PAY.FILE", "jcl-dataset")} <= have
    assert cobol.expand("MOVE OLD-X TO OLD.", [("OLD", "NEW")]) == "MOVE OLD-X TO NEW."


def test_the_rest_works_without_the_training_part():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "graphloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                assert not any("llm" in n.split(".") for n in names), p


def test_shapes_keys_and_middleware(spark):
    js = "if (!x) return Response.json({ error: 'no', code: 1 }, { status: 404 });\nreturn NextResponse.json({ data: rows.map(r => ({ id: r.id })), total });\nexport const GET = withAuth(withLog(handler))"
    assert routes.response_keys(js) == (["data", "total"], ["code", "error"])
    php = "http_response_code(400); echo json_encode(['error' => 'x']); http_response_code(200); echo json_encode(['items' => [1, 2], 'n' => 2]);"
    assert routes.response_keys(php, True) == (["items", "n"], ["error"])
    use = "const { data, meta: m } = await res.json(); const body = await r2.json(); body.total; body.map(x => x.id)"
    assert column(spark, routes.accessed_keys, [use, ""]) == [["data", "meta", "total"], []]
    assert column(spark, routes.middleware, [js, "x"]) == [["withAuth", "withLog"], []]
    found = routes.response_shapes(spark.createDataFrame([("a.ts", js), ("b.ts", "")], "filePath string, content string")).collect()
    assert [(r.filePath, r.responseKeys) for r in found] == [("a.ts", ["data", "total"])]
    r = spark.createDataFrame([("/api/a",), ("/x",)], "url string")
    m = spark.createDataFrame([("auth", "/api"), ("log", "/")], "name string, prefix string")
    assert {x.url: x.middleware for x in routes.routes_under(r, m).collect()} == {"/api/a": ["auth", "log"], "/x": ["log"]}


def test_framework_hints(spark):
    paths = ["pages/about.tsx", "src/app/page.tsx", "srv/views.py", "cmd/main.go", "lib/x.rb", "src/UserController.java"]
    screens = ["src/app/_layout.tsx", "src/app/+not-found.tsx", "src/app/users+api.ts", "src/app/home.tsx"]
    assert [g.reason for g in column(spark, frameworks.path_hint, screens)] == ["expo-layout", "expo-special-route", "expo-api-route", "expo-screen"]
    got = column(spark, frameworks.path_hint, paths)
    assert [g and (g.framework, g.multiplier) for g in got] == [("nextjs-pages", 3.0), ("nextjs-app", 3.0), ("django", 3.0), ("go", 3.0), None, ("spring", 3.0)]
    df = spark.createDataFrame([("python", "@app.route('/x')"), ("go", "func h(c *gin.Context)"), ("go", "x")], "l string, t string")
    assert [r[0] and r[0].framework for r in df.select(frameworks.text_hint(F.col("l"), F.col("t"))).collect()] == ["flask", "gin", None]
    h = spark.createDataFrame([("d", "a", 2.0, "x", 0), ("d", "b", 3.0, "y", 1), ("d", "c", 3.0, "z", 2)], "def string, framework string, multiplier double, reason string, seq int")
    assert frameworks.best_hints(h).first().framework == "b"


def test_contracts_from_source(spark):
    rows = [
        ("a.ts", "app.get('/Users/:id', h); fetch(`https://h.io/users/42?x=1`); axios.post('/orders/${id}')"), ("b.py", "@app.post('/items/{item}')\nrequests.get('http://x/users/7')"),
        ("c.go", 'r.GET("/ping", h)\nhttp.HandleFunc("/raw", h)'), ("d.java", '@GetMapping("/v1/{id}") @KafkaListener(topics = "Jobs")'), ("e.ts", "producer.send({ topic: 'Jobs' })"),
        ("f.proto", "package hr.v1;\nservice Users { rpc Get (A) returns (B) {} rpc List (A) returns (B); }"), ("g.txt", "app.get('/no')"),
    ]
    found = {(r.contractId, r.role, r.framework) for r in sourcescan.scanned(spark.createDataFrame(rows, "filePath string, content string"), "r").collect()}
    assert found == {
        ("http::GET::/users/{param}", "provider", "express"), ("http::GET::/users/{param}", "consumer", "fetch"), ("http::POST::/orders/{param}", "consumer", "axios"), ("http::POST::/items/{param}", "provider", "fastapi"),
        ("http::GET::/users/{param}", "consumer", "requests"), ("http::GET::/ping", "provider", "go-router"), ("http::*::/raw", "provider", "go-stdlib"), ("http::GET::/v1/{param}", "provider", "spring"),
        ("topic::jobs", "consumer", "kafka"), ("topic::jobs", "provider", "kafka"), ("grpc::hr.v1.users/Get", "provider", "proto"), ("grpc::hr.v1.users/List", "provider", "proto"),
    }

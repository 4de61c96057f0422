"""Groups, sinks, tool arguments and quality operators on small fixtures."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.operators import groups, quality, sinks, tools

YAML = """
version: 1
name: shop   # comment
description: "All of it"
repos:
  web: web-app
  api: 'api-server'
  old: old-server
detect:
  http: true
links:
  - from: web
    to: api
    type: http
    contract: get /orders//
    role: consumer
  - from: api
    to: web
    type: topic
    contract: Jobs
    role: provider
"""


def graphs(spark):
    nodes = lambda *r: spark.createDataFrame(r, "id string, label string, name string, filePath string")
    edges = lambda *r: spark.createDataFrame(r, "sourceId string, targetId string, type string, confidence double")
    api = nodes(("Route:/items", "Route", "/items", "a.ts"), ("File:a.ts", "File", "a.ts", "a.ts")), edges(("File:a.ts", "Route:/items", "HANDLES_ROUTE", 1.0))
    web = nodes(("Route:/items", "Route", "/items", "w.ts"), ("File:w.ts", "File", "w.ts", "w.ts")), edges(("File:w.ts", "Route:/items", "FETCHES", 0.0))
    return {"api": api, "web": web}


def test_config():
    c = groups.parse_config(YAML)
    assert (c.name, c.version, c.description, c.repos["api"], c.detect) == ("shop", 1, "All of it", "api-server", {"http": True})
    assert [(x.source, x.target, x.type, x.contract, x.role) for x in c.links] == [("web", "api", "http", "get /orders//", "consumer"), ("api", "web", "topic", "Jobs", "provider")]
    for bad in ("repos:\n  a: b\n", "name: x\n", "name: x\nrepos:\n  a: b\nversion: one\n", "name: x\nrepos:\n  a: b\nlinks:\n  - from: a\n    to: q\n    type: http\n    contract: c\n", "name: x\nrepos:\n  a\n"):
        with pytest.raises(ValueError):
            groups.parse_config(bad)


def test_sync_registry_and_lookup(spark, tmp_path):
    c = groups.parse_config(YAML)
    result = groups.sync(c, graphs(spark), spark)
    assert result["missing"] == ["old"]
    links = {(r.contractId, r.c_repo, r.p_repo, r.matchType, r.confidence) for r in result["links"].collect()}
    assert {("http::GET::/orders", "web", "api", "manifest", 1.0), ("topic::Jobs", "web", "api", "manifest", 1.0)} <= links
    assert ("http::*::/items", "web", "api", "exact", 0.8) in links
    groups.write_registry(str(tmp_path / "g" / "contracts.json"), result, {"api": "t1"}, "now")
    back = groups.read_registry(spark, str(tmp_path / "g" / "contracts.json"))
    assert back["contracts"].count() == result["contracts"].count() and back["missing"] == ["old"] and back["snapshots"] == {"api": "t1"}
    rows = [("api", "provider", "u1", "a.ts", "x", "n1", 1), ("api", "provider", "u2", "b.ts", "y", "n2", 2), ("api", "provider", "", "b.ts", "z", "n3", 3)]
    known = spark.createDataFrame(rows, "repo string, role string, symbolUid string, symbolFile string, symbolName string, node string, seq int")
    asked = spark.createDataFrame([(1, "api", "provider", "u2", "", ""), (2, "api", "provider", "", "b.ts", "z"), (3, "api", "provider", "?", "a.ts", "?"), (4, "api", "provider", "?", "b.ts", "?")], "ask int, repo string, role string, symbolUid string, symbolFile string, symbolName string")
    assert {r.ask: r.contract for r in groups.contract_lookup(asked, known).collect()} == {1: "n2", 2: "n3", 3: "n1", 4: None}
    one = spark.createDataFrame([("r", "c", "provider", "f")], "a string, b string, c string, d string").select(groups.contract_node_id(*map(F.col, "abcd"))).first()[0]
    assert len(one) == 64


def test_assisted_contracts_and_subgroups(spark):
    routes = spark.createDataFrame([("api", "/a", "x.ts"), ("api", "/b", "x.ts"), ("api", "/c", "x.ts")], "repo string, path string, filePath string")
    found = spark.createDataFrame([("x.ts", "/a", "GET", "h"), ("x.ts", "/b", "GET", "h"), ("x.ts", "/b", "POST", "k")], "filePath string, path string, method string, handler string")
    assert {(r.contractId, r.handler, r.confidence) for r in groups.assisted_http(routes, found).collect()} == {("http::GET::/a", "h", 0.9), ("http::*::/b", None, 0.9), ("http::*::/c", None, 1.0)}
    hits = spark.createDataFrame([("a/b",), ("a/bc",), ("a",)], "repo string")
    assert sorted(r.repo for r in groups.subgroup(hits, "a/b/").collect()) == ["a/b"] and groups.subgroup(hits, "").count() == 3


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("b", "File", "it's"), ("a", "File", None)], "id string, label string, name string")
    e = spark.createDataFrame([("e", "a", "b", "CALLS", 0.5)], "id string, sourceId string, targetId string, type string, confidence double")
    sinks.write_snapshot(n, e, str(tmp_path / "s" / "graph.json"))
    data = json.loads((tmp_path / "s" / "graph.json").read_text())
    assert [x["id"] for x in data["nodes"]] == ["a", "b"] and data["relationships"][0]["type"] == "CALLS"
    statements = {r.id: r.statement for r in sinks.node_statements(n, ["id", "name"]).collect()}
    assert statements == {"a": "CREATE (:`File` {id: 'a', name: NULL})", "b": "CREATE (:`File` {id: 'b', name: 'it\\'s'})"}
    ends = e.withColumns({"from_label": F.lit("File"), "to_label": F.lit("File")})
    assert sinks.edge_statements(ends).first().statement == "MATCH (a:`File` {id: 'a'}), (b:`File` {id: 'b'}) CREATE (a)-[:CodeRelation {type: 'CALLS', confidence: 0.5}]->(b)"
    ddl = sinks.schema_statements()
    assert len(ddl) == 35 and ddl[0].startswith("CREATE NODE TABLE IF NOT EXISTS `File` (id STRING") and "FLOAT[384]" in ddl[-2]
    stored = spark.createDataFrame([("n:0", "n", "h"), ("m:0", "m", "h"), ("g:0", "g", "h")], "id string, nodeId string, contentHash string")
    new = spark.createDataFrame([("n:0", "n", "k"), ("n:1", "n", "k")], "id string, nodeId string, contentHash string")
    assert sorted((r.id, r.contentHash) for r in sinks.replaced_embeddings(stored, new, spark.createDataFrame([("g",)], "nodeId string")).collect()) == [("m:0", "h"), ("n:0", "k"), ("n:1", "k")]
    old = spark.createDataFrame([("n", 0, 1, 2, "h"), ("m", None, 1, 2, "h")], "nodeId string, chunkIndex int, startLine int, endLine int, contentHash string")
    assert {r.nodeId: r.hash for r in sinks.stored_hashes(old).collect()} == {"n": "h", "m": ""}


def test_rename_is_applied_whole_or_not(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1\r\nold()\nold\n")
    (tmp_path / "b.py").write_text("other\n")
    edits = spark.createDataFrame([("a.py", 2, "old()", "new()"), ("a.py", 3, "old", "new"), ("b.py", 1, "gone", "new")], "filePath string, line int, old string, new string")
    assert sinks.apply_rename(str(tmp_path), edits) == (2, ["b.py"])
    assert (tmp_path / "a.py").read_bytes() == b"x = 1\r\nnew()\nnew\n" and (tmp_path / "b.py").read_text() == "other\n"
    with pytest.raises(ValueError, match="outside"):
        sinks.apply_rename(str(tmp_path), spark.createDataFrame([("../x", 1, "a", "b")], edits.schema))


def test_tools(spark, tmp_path):
    assert tools.search_arguments() == ("hybrid", 10) and tools.search_arguments(" BM25 ", 500) == ("bm25", 100) and tools.over_fetch(3) == 12 and tools.over_fetch(1) == 9
    with pytest.raises(ValueError):
        tools.search_arguments("fuzzy")
    n = spark.createDataFrame([("Method:a", "Method", 2, None, ["int"]), ("Class:b", "Class", 1, "x", None)], "id string, label string, parameterCount int, returnType string, parameterTypes array<string>")
    assert [(r.id, r.metadata) for r in tools.method_metadata(n).collect()] == [("Method:a", {"parameterCount": "2", "parameterTypes": '["int"]'})]
    about = n.withColumns({"name": F.lit("n"), "filePath": F.lit("f"), "startLine": F.lit(1), "endLine": F.lit(2)})
    hits = spark.createDataFrame([("Method:a", 0.1), ("Class:gone", 0.2)], "nodeId string, distance double")
    assert [r.nodeId for r in tools.hydrated(hits, about).collect()] == ["Method:a"]
    known = [{"name": "Web", "path": "/r/web"}, {"name": "api", "path": "/r/api"}, {"name": "API", "path": "/s/api"}]
    assert tools.resolve_repo(known, "web")["path"] == "/r/web" and tools.resolve_repo(known, "/s/api")["name"] == "API" and tools.resolve_repo(known[:1])["name"] == "Web"
    for asked in ("api", "none", ""):
        with pytest.raises(LookupError):
            tools.resolve_repo(known, asked)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=n@example.com", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    git("commit", "-q", "--allow-empty", "-m", "one")
    first = git("rev-parse", "HEAD")
    git("commit", "-q", "--allow-empty", "-m", "two")
    assert tools.commits_behind(str(tmp_path), first) == 1 and tools.commits_behind(str(tmp_path), "nothing") is None
    assert tools.resource("graph://repo/web/cluster/c1") == ("repo/{name}/cluster/{cluster}", {"name": "web", "cluster": "c1"}) and len(tools.prompts()) == 2
    with pytest.raises(LookupError):
        tools.resource("graph://nothing/here")


def test_quality(spark):
    e, f = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("abc", "bcd"))
    assert [tuple(r) for r in quality.examples(e, f, ["k"]).collect()] == [("missing", "a"), ("surplus", "d")]
    scores = spark.createDataFrame([("calls", 100.0, 99.5), ("imports", 100.0, 100.0)], "name string, recall double, precision double")
    assert [tuple(r) for r in quality.failed_gates(scores).collect()] == [("calls", "precision", 99.5)]
    files = spark.createDataFrame([("a.py", "python", "import os\ndef f():\n    g()\n"), ("b.py", "python", "def ("), ("c.go", "go", "x")], "filePath string, language string, content string")
    assert {(r.fact, r.name, r.line) for r in quality.python_truth(files).collect()} == {("import", "os", 1), ("definition", "f", 2), ("call", "g", 3)}
    c = spark.createDataFrame([("c1", "api")], "community string, label string")
    m = spark.createDataFrame([("c1", f"i{i:02d}", f"n{i}", "Function") for i in range(23)], "community string, id string, name string, kind string")
    p = quality.cluster_prompts(c, m).first()
    assert "n19 (Function) (+3 more)" in p.prompt and p.tokens == len(p.prompt) / 4
    assert quality.parse_enrichment('so: {"name": "Api", "keywords": ["k"]} ok', "x") == {"name": "Api", "keywords": ["k"], "description": ""}
    assert quality.parse_enrichment("no json", "x")["name"] == "x" and quality.parse_enrichment("{bad}", "x")["name"] == "x"
    assert quality.parse_batch('[{"id": "c1", "name": "A"}, {"name": "no id"}]') == {"c1": {"name": "A", "keywords": [], "description": ""}} and quality.parse_batch("]x[") == {}

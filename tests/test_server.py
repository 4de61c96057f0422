"""JSON-RPC, HTTP paths and the command line over one small analysed folder."""

import json
import threading
import urllib.request

import pytest

from graphloom import __main__ as cli
from graphloom.codegraph import CodeGraph
from graphloom.operators import groups
from graphloom.server import TOOLS, Workbench, answer, handle, serve

SOURCES = {
    "app/main.py": "from app.store import save\n\n\ndef main():\n    check()\n    save(1)\n\n\ndef check():\n    save(2)\n",
    "app/store.py": "def save(x):\n    return write(x)\n\n\ndef write(x):\n    return x\n",
    "pages/api/users.ts": "export default withAuth(handler)\nfunction handler(req, res) { res.json({ name: 1 }) }\n",
    "web/list.ts": "export async function list() { const r = await fetch('/api/users'); const data = await r.json(); return data.phone }\n",
}


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, t in SOURCES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    out = Workbench(spark)
    out.register("shop", str(root), CodeGraph.of_folder(spark, f"file://{root}"))
    out.configs["g"] = groups.parse_config("name: g\nrepos:\n  a: shop\n  b: gone\n")
    return out


def rpc(bench, method_, **params):
    reply = answer(bench, {"jsonrpc": "2.0", "id": 1, "method": method_, "params": params})
    return reply.get("result") or reply.get("error")


def call(bench, tool_, **arguments):
    return json.loads(rpc(bench, "tools/call", name=tool_, arguments=arguments)["content"][0]["text"])


def test_rpc(bench):
    assert {t["name"] for t in rpc(bench, "tools/list")["tools"]} == set(TOOLS) and len(TOOLS) == 16
    assert rpc(bench, "initialize")["serverInfo"]["name"] == "graphloom" and answer(bench, {"id": 3, "method": "ping"})["result"] == {}
    assert rpc(bench, "nothing")["code"] == -32601 and rpc(bench, "tools/call", name="drop")["code"] == -32602 and answer(bench, {"method": "note"}) is None
    assert [r["name"] for r in call(bench, "list_repos")] == ["shop"]
    found = call(bench, "impact", target="write")
    assert found["status"] == "found" and {i["name"] for d in found["by_depth"] for i in d["items"]} >= {"save", "check", "main"}
    assert found["summary"][0]["processes"] >= 1 and call(bench, "context", name="save")["status"] == "found"
    assert call(bench, "cypher", query="MATCH (a:Function) RETURN count(*) AS n")["rows"][0]["n"] >= 5
    assert rpc(bench, "tools/call", name="cypher", arguments={"query": "CREATE (n) RETURN n"})["code"] == -32602
    assert [r["mismatched"] for r in call(bench, "shape_check")] == [["phone"]] and call(bench, "api_impact")[0]["middleware"] == ["withAuth"]
    assert call(bench, "route_map", route="users")[0]["name"] == "/api/users" and call(bench, "tool_map") == []
    assert call(bench, "detect_changes", diff="--- a/app/store.py\n+++ b/app/store.py\n@@ -1 +1 @@\n")["symbols"][0]["name"] == "save"
    assert {r["line"] for r in call(bench, "rename", target="Function:app/store.py:write", new_name="put")} >= {2, 5}
    assert call(bench, "query", query="save")["processes"]


def test_groups(bench):
    assert call(bench, "group_list") == [{"name": "g", "description": "", "repos": ["a", "b"]}]
    assert call(bench, "group_sync", group="g")["missing"] == ["b"]
    assert {r["role"] for r in call(bench, "group_contracts", group="g")} == {"provider", "consumer"}
    assert [r["indexed"] for r in call(bench, "group_status", group="g")] == [True, False] and call(bench, "group_query", group="g", query="save")


def test_resources_and_prompts(bench):
    assert len(rpc(bench, "resources/list")["resources"]) == 2 and len(rpc(bench, "resources/templates/list")["resourceTemplates"]) == 6
    read = lambda uri: json.loads(rpc(bench, "resources/read", uri=uri)["contents"][0]["text"])
    flows = read("graph://repo/shop/processes")
    assert flows and [s["step"] for s in read(f"graph://repo/shop/process/{flows[0]['id']}")] == list(range(1, flows[0]["step_count"] + 1))
    assert read("graph://repo/shop/clusters") and read("graph://repo/shop/schema")["nodes"] and read("graph://repo/shop/context")["nodes"] > 5
    name = rpc(bench, "prompts/list")["prompts"][0]["name"]
    assert rpc(bench, "prompts/get", name=name)["messages"]


def test_http(bench):
    assert handle(bench, "/api/nothing?repo=shop", {})[0] == 404 and handle(bench, "/api/grep?pattern=", {})[0] == 400
    assert handle(bench, "/api/file?path=app/store.py", {})[1][0]["content"] == SOURCES["app/store.py"]
    kinds = [r["type"] for r in handle(bench, "/api/graph", {})[1]]
    assert kinds == sorted(kinds) and set(kinds) == {"node", "relationship"}
    assert handle(bench, "/api/search?query=save&limit=3", {})[1]["results"] and handle(bench, "/api/search?mode=odd", {})[0] == 400
    server = serve(bench, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/grep?pattern=def%20save") as r:
            assert json.load(r)[0]["filePath"] == "app/store.py"
    finally:
        server.shutdown()


def test_command_line(bench, spark, tmp_path):
    out = f"file://{tmp_path}/graph"
    made = cli.run(spark, cli.parser().parse_args(["analyze", bench.entries[0]["path"], "--out", out]))
    assert made["edges"]["CALLS"] >= 4
    ask = lambda *a: cli.run(spark, cli.parser().parse_args([*a, "--graph", out]))
    assert ask("status")["nodes"] == made["nodes"] and ask("impact", "write", "--depth", "1")["summary"][0]["impacted"] == 1
    assert ask("grep", "return write")[0]["line"] == 2 and ask("cypher", "MATCH (n:Route) RETURN n.name AS x") == [{"x": "/api/users"}]

"""The tools as JSON-RPC calls and as HTTP paths: one table of names, the same rows either way.

A call names a stored repository; results are DataFrames that are limited before they leave Spark."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession

from .codegraph import CodeGraph
from .operators import contracts, groups, lookup, tools
from .plans.cypher import is_write, markdown

#: Rows that one answer holds at most.
MOST_ROWS = 500
# The names of the tools.
TOOLS = ("list_repos", "query", "cypher", "context", "detect_changes", "rename", "impact", "route_map", "tool_map", "shape_check", "api_impact", "group_list", "group_sync", "group_contracts", "group_query", "group_status")


def plain(value, limit: int = MOST_ROWS):
    """JSON values of a result: rows of a DataFrame, in its order, up to the limit."""
    if isinstance(value, DataFrame):
        return [json.loads(x) for x in value.limit(limit).toJSON().collect()]
    if isinstance(value, dict):
        return {k: plain(v, limit) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v, limit) for v in value]
    return value


@dataclass
class Workbench:
    """Registered repositories (name, path and, where known, commit and indexedAt) with their graphs, and groups of them."""

    spark: SparkSession
    entries: list[dict] = field(default_factory=list)
    graphs: dict[str, CodeGraph] = field(default_factory=dict)
    configs: dict[str, groups.Config] = field(default_factory=dict)
    synced: dict[str, dict] = field(default_factory=dict)

    def register(self, name: str, path: str, graph: CodeGraph, **about) -> None:
        self.entries = [e for e in self.entries if e["name"] != name] + [{"name": name, "path": path, **about}]
        self.graphs[name] = graph

    def graph(self, repo: str = "") -> CodeGraph:
        return self.graphs[tools.resolve_repo(self.entries, repo)["name"]]

    def call(self, name: str, arguments: dict):
        if name not in TOOLS:
            raise LookupError(f"no tool {name}")
        return plain(getattr(self, name)(**arguments))

    def list_repos(self):
        return [{**e, "commitsBehind": tools.commits_behind(e["path"], e["commit"]) if e.get("commit") else None} for e in sorted(self.entries, key=lambda e: e["name"])]

    def query(self, query: str, limit: int = 5, repo: str = ""):
        g = self.graph(repo)
        return {"processes": g.query(query, limit), "definitions": lookup.matching_definitions(g.nodes, query, limit)}

    def cypher(self, query: str, repo: str = ""):
        if is_write(query):
            raise ValueError("a query may not write")
        found = self.graph(repo).cypher(query)
        return {"rows": found, "markdown": markdown(found)}

    def context(self, name: str = "", uid: str = "", file_path: str = "", kind: str = "", repo: str = ""):
        return self.graph(repo).context(name, uid, file_path, kind)

    def detect_changes(self, diff: str, repo: str = ""):
        return self.graph(repo).detect_changes(diff)

    def rename(self, target: str, new_name: str, repo: str = ""):
        return self.graph(repo).rename(target, new_name)

    def impact(self, target: str, repo: str = "", **options):
        return self.graph(repo).impact(target, **options)

    def route_map(self, route: str = "", repo: str = ""):
        return self.graph(repo).route_map(route)

    def tool_map(self, tool: str = "", repo: str = ""):
        return self.graph(repo).tool_map(tool)

    def shape_check(self, repo: str = ""):
        return self.graph(repo).shape_check()

    def api_impact(self, repo: str = ""):
        return self.graph(repo).api_impact()

    def group_list(self):
        return [{"name": c.name, "description": c.description, "repos": sorted(c.repos)} for c in self.configs.values()]

    def _members(self, group: str) -> dict:
        named = {e["name"].lower(): e["name"] for e in self.entries}
        return {at: self.graphs[named[name.lower()]] for at, name in self.configs[group].repos.items() if name.lower() in named}

    def group_sync(self, group: str, exact_only: bool = False):
        known = {at: (g.nodes, g.edges) for at, g in self._members(group).items()}
        self.synced[group] = groups.sync(self.configs[group], known, self.spark, exact_only)
        return {k: v.count() if isinstance(v, DataFrame) else v for k, v in self.synced[group].items()}

    def group_contracts(self, group: str, kind: str = "", repo: str = "", unmatched_only: bool = False):
        if group not in self.synced:
            self.group_sync(group)
        found = self.synced[group]
        return contracts.group_contracts(found["contracts"], found["links"], kind, repo, unmatched_only)

    def group_query(self, group: str, query: str, limit: int = 5, subgroup: str = ""):
        hits = None
        for at, g in sorted(self._members(group).items()):
            own = g.query(query, limit).selectExpr(f"'{at}' as repo", "id", "score as relevance")
            hits = own if hits is None else hits.union(own)
        return [] if hits is None else contracts.group_query(groups.subgroup(hits, subgroup), limit)

    def group_status(self, group: str):
        known = {e["name"].lower(): e for e in self.entries}
        out = []
        for at, name in sorted(self.configs[group].repos.items()):
            e = known.get(name.lower())
            behind = tools.commits_behind(e["path"], e["commit"]) if e and e.get("commit") else None
            out.append({"repo": at, "indexed": e is not None, "commitsBehind": behind, "stale": bool(behind), "synced": group in self.synced})
        return out

    def read(self, uri: str):
        """A resource: lists, details, or the schema of a repository's graph."""
        template, values = tools.resource(uri)
        if template == "repos":
            return self.list_repos()
        if template == "setup":
            return "Analyse a folder, then ask with the tools; resources list what there is."
        g = self.graph(values["name"])
        kind = template.split("/")[2]
        if kind == "processes":
            return plain(lookup.list_processes(g.nodes, g.edges))
        if kind == "process":
            return plain(lookup.process_steps(g.nodes, g.edges, [values["process"]]).orderBy("step", "name"))
        if kind in ("clusters", "cluster"):
            found = g.nodes.filter("label = 'Community'")
            return plain(found if kind == "clusters" else found.filter((found["id"] == values["cluster"]) | (found["heuristicLabel"] == values["cluster"])))
        return {"nodes": g.nodes.schema.jsonValue(), "edges": g.edges.schema.jsonValue()} if kind == "schema" else json.loads(g.stats())


def answer(bench: Workbench, request: dict) -> dict | None:
    """The answer to one JSON-RPC request, null for a notification."""
    method, params, key = request.get("method"), request.get("params") or {}, request.get("id")
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "graphloom", "version": "0.2"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": t, "description": (getattr(Workbench, t).__doc__ or t.replace("_", " ")).strip(), "inputSchema": {"type": "object"}} for t in TOOLS]}
        elif method == "tools/call":
            result = {"content": [{"type": "text", "text": json.dumps(bench.call(params.get("name", ""), params.get("arguments") or {}), default=str)}]}
        elif method in ("resources/list", "resources/templates/list"):
            whole = method == "resources/list"
            result = {"resources" if whole else "resourceTemplates": [{"uri" if whole else "uriTemplate": f"graph://{r}", "name": r} for r in tools.RESOURCES if ("{" in r) != whole]}
        elif method == "resources/read":
            result = {"contents": [{"uri": params["uri"], "text": json.dumps(bench.read(params["uri"]), default=str)}]}
        elif method == "prompts/list":
            result = {"prompts": [{"name": n} for n in tools.prompts()]}
        elif method == "prompts/get":
            result = {"messages": [{"role": "user", "content": {"type": "text", "text": tools.prompts()[params["name"]]}}]}
        else:
            return None if key is None else {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"no method {method}"}}
    except (LookupError, ValueError, TypeError) as e:
        return {"jsonrpc": "2.0", "id": key, "error": {"code": -32602, "message": str(e)}}
    return None if key is None else {"jsonrpc": "2.0", "id": key, "result": result}


def handle(bench: Workbench, path: str, body: dict):
    """(status, value) of an HTTP path below /api."""
    at = urlsplit(path)
    args = dict(parse_qsl(at.query)) | body
    repo = args.pop("repo", "")
    route = at.path.removeprefix("/api/").strip("/")
    try:
        if route in ("heartbeat", "info"):
            return 200, {"status": "ok", "repos": len(bench.entries)}
        if route == "repos":
            return 200, bench.list_repos()
        if route == "repo":
            return 200, tools.resolve_repo(bench.entries, repo)
        g = bench.graph(repo)
        if route == "graph":
            return 200, [json.loads(r.value) for r in g.ndjson(args.get("includeContent") == "true").orderBy("part").toLocalIterator()]
        if route == "file":
            return 200, plain(g.nodes.filter("label = 'File'").filter(g.nodes["filePath"] == args.get("path", "")).select("filePath", "content"))
        if route == "grep":
            return 200, plain(g.grep(args.get("pattern", ""), int(args.get("limit", 50))))
        if route == "query":
            return 200, bench.call("cypher", {"query": args.get("query", ""), "repo": repo})
        if route == "search":
            mode, limit = tools.search_arguments(args.get("mode"), int(args.get("limit", 0)))
            return 200, {"mode": "bm25" if mode == "hybrid" else mode, "results": plain(g.search(args.get("query", ""), limit))}
        if route in ("processes", "clusters", "process", "cluster"):
            named = f"/{args['id']}" if route in ("process", "cluster") else ""
            return 200, bench.read(f"graph://repo/{tools.resolve_repo(bench.entries, repo)['name']}/{route}{named}")
        if route == "mcp":
            return 200, answer(bench, body)
    except (LookupError, ValueError, TypeError) as e:
        return 400, {"error": str(e)}
    return 404, {"error": f"no path {at.path}"}


def serve(bench: Workbench, host: str = "127.0.0.1", port: int = 4747) -> ThreadingHTTPServer:
    """A server of the paths of handle(); the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, body: dict) -> None:
            status, value = handle(bench, self.path, body)
            raw = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self._reply({})

        def do_POST(self):
            self._reply(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"))

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)

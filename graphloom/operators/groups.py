"""Groups of repositories: their configuration, declared contracts, synchronisation, lookups and registry."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .contracts import distinct_contracts, exact_links, grpc_links, http_contracts, unmatched

CONTRACT = "repo string, contractId string, type string, role string, symbolUid string, symbolFile string, symbolName string, confidence double, service string"
LINK = "contractId string, c_repo string, c_symbol string, p_repo string, p_symbol string, matchType string, confidence double"
ROLES, TYPES = ("consumer", "provider"), ("http", "grpc", "topic", "lib", "custom")


@dataclass
class Link:
    """A declared contract: `source` has the role, `target` the other one."""

    source: str
    target: str
    type: str
    contract: str
    role: str = "consumer"


@dataclass
class Config:
    name: str
    repos: dict[str, str]
    version: int = 1
    description: str = ""
    links: list[Link] = field(default_factory=list)
    detect: dict[str, bool] = field(default_factory=lambda: {"http": True})


def _value(text: str):
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text.split(" #")[0].strip()


def parse_config(text: str) -> Config:
    """A group's configuration in the plain subset of YAML that it is written in: scalars, one level of mappings, a list of links."""
    top: dict = {}
    section, item = None, None
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        body = line.strip()
        if line[0] not in " \t-":
            key, colon, value = body.partition(":")
            if not colon:
                raise ValueError(f"line {number}: expected key: value")
            section, item = (key, None) if not value.strip() else (None, None)
            top[key] = ([] if key == "links" else {}) if section or value.strip() in ("{}", "[]") else _value(value)
            continue
        if section is None:
            raise ValueError(f"line {number}: indented without a section")
        if body.startswith("- "):
            if not isinstance(top[section], list):
                raise ValueError(f"line {number}: {section} is no list")
            item = {}
            top[section].append(item)
            body = body[2:].strip()
        key, colon, value = body.partition(":")
        if not colon:
            raise ValueError(f"line {number}: expected key: value")
        (item if isinstance(top[section], list) else top[section])[_value(key)] = _value(value)
    if not top.get("name"):
        raise ValueError("name is required")
    if not isinstance(top.get("repos"), dict) or not top["repos"]:
        raise ValueError("repos is required and is a mapping")
    if not str(top.get("version", "1")).isdigit():
        raise ValueError("version must be a number")
    links = []
    for raw in top.get("links") or []:
        link = Link(raw.get("from", ""), raw.get("to", ""), raw.get("type", ""), raw.get("contract", ""), raw.get("role", "consumer"))
        if link.type not in TYPES or link.role not in ROLES or not link.contract:
            raise ValueError(f"a link has a contract, a type of {', '.join(TYPES)} and a role of {', '.join(ROLES)}")
        if {link.source, link.target} - set(top["repos"]):
            raise ValueError(f"a link names repositories outside the group: {link.source}, {link.target}")
        links.append(link)
    detect = {k: str(v).lower() == "true" for k, v in (top.get("detect") or {"http": "true"}).items()}
    return Config(top["name"], top["repos"], int(top.get("version", 1)), top.get("description", ""), links, detect)


def manifest_id(kind: Column, contract: Column) -> Column:
    """A declared contract's id: HTTP ones get their method (any where none is named) and a path that begins with one slash and ends without."""
    text = F.trim(contract)
    method = F.upper(F.regexp_extract(text, r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+", 1))
    path = F.trim(F.regexp_replace(text, r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+", ""))
    path = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(kind == "http", F.concat(F.lit("http::"), F.when(method == "", "*").otherwise(method), F.lit("::"), path)).otherwise(F.concat_ws("::", kind, contract))


def manifest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contracts, links) of declared links (source, target, type, contract, role): a provider and a consumer for each, and the link between."""
    provider = F.when(F.col("role") == "provider", F.col("source")).otherwise(F.col("target"))
    consumer = F.when(F.col("role") == "provider", F.col("target")).otherwise(F.col("source"))
    known = links.select("type", "contract", manifest_id(F.col("type"), F.col("contract")).alias("contractId"), provider.alias("p_repo"), consumer.alias("c_repo"))
    uid = lambda repo: F.concat_ws("::", F.lit("manifest"), repo, "contractId")
    known = known.withColumns({"p_symbol": uid("p_repo"), "c_symbol": uid("c_repo")})

    def side(letter: str, role: str) -> DataFrame:
        return known.select(F.col(f"{letter}_repo").alias("repo"), "contractId", "type", F.lit(role).alias("role"), F.col(f"{letter}_symbol").alias("symbolUid"), F.lit("").alias("symbolFile"), F.col("contract").alias("symbolName"), F.lit(1.0).alias("confidence"), F.lit("").alias("service"))

    return side("p", "provider").union(side("c", "consumer")), known.select("contractId", "c_repo", "c_symbol", "p_repo", "p_symbol", F.lit("manifest").alias("matchType"), F.lit(1.0).alias("confidence"))


def distinct_links(links: DataFrame, sequence: str = "seq") -> DataFrame:
    """The first link of each pair of ends, contract and way of matching."""
    key = ["c_repo", "c_symbol", "p_repo", "p_symbol", "contractId", "matchType"]
    return links.groupBy(*key).agg(F.min_by("confidence", sequence).alias("confidence"))


def sync(config: Config, graphs: dict[str, tuple[DataFrame, DataFrame]], spark: SparkSession, exact_only: bool = False) -> dict:
    """Contracts and links of a group: of each repository's graph (by name; those without one are missing), declared ones
    first, matched exactly and, unless only that is wanted, by whole services."""
    missing = sorted(r for r in config.repos if r not in graphs)
    declared, declared_links = manifest(spark.createDataFrame([(x.source, x.target, x.type, x.contract, x.role) for x in config.links], "source string, target string, type string, contract string, role string"))
    order = [c.split(" ")[0] for c in CONTRACT.split(", ")]
    found = None
    for i, repo in enumerate(sorted(r for r in config.repos if r in graphs)):
        if config.detect.get("http", True):
            own = http_contracts(*graphs[repo], repo).select(*order).withColumn("seq", F.lit(i))
            found = own if found is None else found.union(own)
    every = declared.select(*order).withColumn("seq", F.lit(len(config.repos)))
    every = distinct_contracts(every if found is None else found.union(every), "seq").drop("seq")
    links = exact_links(every)
    if not exact_only:
        wild = grpc_links(every).select("contractId", "c_repo", "c_symbol", "p_repo", "p_symbol", F.lit("wildcard").alias("matchType"), F.lit(1.0).alias("confidence"))
        links = links.union(wild)
    all_links = distinct_links(declared_links.withColumn("seq", F.lit(0)).union(links.withColumn("seq", F.lit(1))))
    return {"contracts": every, "links": all_links, "unmatched": unmatched(every, all_links), "missing": missing}


def contract_node_id(repo: Column, contract: Column, role: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", repo, contract, role, path), 256)


def contract_lookup(asked: DataFrame, contracts: DataFrame) -> DataFrame:
    """(ask, contract) for questions (ask, repo, role, symbolUid, symbolFile, symbolName): the last contract of that symbol, else of that
    file and name, else the only one of the file; null where none fits. contracts: the same columns with `node` and `seq`."""
    where = ["repo", "role"]
    by_uid = contracts.filter("symbolUid <> ''").groupBy(*where, "symbolUid").agg(F.max_by("node", "seq").alias("u"))
    by_ref = contracts.groupBy(*where, "symbolFile", "symbolName").agg(F.max_by("node", "seq").alias("r"))
    by_file = contracts.groupBy(*where, "symbolFile").agg(F.min("node").alias("f"), F.count("*").alias("n")).filter("n = 1").drop("n")
    j = asked.join(by_uid, [*where, "symbolUid"], "left").join(by_ref, [*where, "symbolFile", "symbolName"], "left").join(by_file, [*where, "symbolFile"], "left")
    return j.select("ask", F.coalesce("u", "r", "f").alias("contract"))


def assisted_http(routes: DataFrame, detected: DataFrame) -> DataFrame:
    """Route rows (repo, path, filePath) with what the source scan (filePath, path, method, handler) says of them: the method where the file has one
    for the path, else any; the handler where it is the only one. Confidence 0.9 with a detection, 1.0 without."""
    d = detected.groupBy("filePath", "path").agg(F.min("method").alias("m"), F.countDistinct("method").alias("nm"), F.min("handler").alias("h"), F.countDistinct("handler").alias("nh"))
    j = routes.join(d, ["filePath", "path"], "left")
    method = F.when(F.col("nm") == 1, F.col("m")).otherwise("*")
    return j.select("repo", "filePath", F.concat_ws("::", F.lit("http"), method, "path").alias("contractId"), F.when(F.col("nh") == 1, F.col("h")).alias("handler"), F.when(F.col("m").isNotNull(), 0.9).otherwise(1.0).alias("confidence"))


def write_registry(path: str, result: dict, snapshots: dict[str, str], generated: str) -> None:
    """The group's registry as one JSON file, put in place at once. A registry is small: it lists contracts, not code."""
    rows = lambda df: [r.asDict() for r in df.orderBy(*df.columns).toLocalIterator()]
    data = {"version": 1, "generatedAt": generated, "repoSnapshots": snapshots, "missingRepos": result["missing"], "contracts": rows(result["contracts"]), "crossLinks": rows(result["links"])}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.part", path)


def read_registry(spark: SparkSession, path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    table = lambda rows, schema: spark.createDataFrame([tuple(r.get(c.split(" ")[0]) for c in schema.split(", ")) for r in rows], schema)
    return {"contracts": table(data["contracts"], CONTRACT), "links": table(data["crossLinks"], LINK), "missing": data["missingRepos"], "snapshots": data["repoSnapshots"]}


def subgroup(hits: DataFrame, prefix: str) -> DataFrame:
    """Hits of the repositories at or below a path of the group."""
    clean = re.sub("/+$", "", prefix)
    return hits.filter((F.col("repo") == clean) | F.col("repo").startswith(f"{clean}/")) if clean else hits


def first_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")

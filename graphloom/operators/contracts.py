"""Contracts between repositories: extraction from graphs, matching, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import contract_key


def http_contracts(nodes: DataFrame, edges: DataFrame, repo: str) -> DataFrame:
    """Routes provide, fetches consume; the id is of any method."""
    routes = nodes.filter("label = 'Route'").select(F.concat(F.lit("http::*::"), "name").alias("contractId"), F.lit("http").alias("type"), F.lit("provider").alias("role"), F.col("id").alias("symbolUid"), F.col("filePath").alias("symbolFile"), F.col("name").alias("symbolName"), F.lit(1.0).alias("confidence"))
    fetches = edges.filter("type = 'FETCHES'").join(nodes.select(F.col("id").alias("targetId"), F.col("name").alias("route")), "targetId").join(nodes.select(F.col("id").alias("sourceId"), "filePath", "name"), "sourceId")
    consumers = fetches.select(F.concat(F.lit("http::*::"), "route").alias("contractId"), F.lit("http").alias("type"), F.lit("consumer").alias("role"), F.col("sourceId").alias("symbolUid"), F.col("filePath").alias("symbolFile"), F.col("name").alias("symbolName"), F.when(F.col("confidence") == 0, 0.8).otherwise(F.col("confidence")).alias("confidence"))
    return routes.union(consumers).withColumns({"service": F.lit(""), "repo": F.lit(repo)})


def keyed(contracts: DataFrame) -> DataFrame:
    return contracts.withColumn("key", contract_key(F.col("contractId")))


def _http_any(key: Column) -> Column:
    return key.startswith("http::*::")


def is_wildcard(contract: Column) -> Column:
    return contract.startswith("grpc::") & contract.endswith("/*")


def exact_links(contracts: DataFrame) -> DataFrame:
    """Consumers joined with providers of one key; where no provider has a consumer's `http::*` key, with those of its
    path under any method. Ends are of different repositories, or different named services of one."""
    k = keyed(contracts).filter(~is_wildcard(F.col("contractId")))
    p = k.filter("role = 'provider'").select(F.col("key").alias("pkey"), F.col("repo").alias("p_repo"), F.col("service").alias("p_service"), F.col("symbolUid").alias("p_symbol"), F.col("confidence").alias("p_conf"))
    c = k.filter("role = 'consumer'").select("contractId", "key", F.col("repo").alias("c_repo"), F.col("service").alias("c_service"), F.col("symbolUid").alias("c_symbol"), F.col("confidence").alias("c_conf"))
    straight = c.join(p, F.col("key") == F.col("pkey"))
    path = F.expr("substring(pkey, length('http::') + length(substring_index(substring(pkey, 7), '::', 1)) + 3)")
    alone = c.filter(_http_any(F.col("key"))).join(p.select(F.col("pkey").alias("key")).distinct(), "key", "left_anti").withColumn("path", F.expr("substring(key, 10)"))
    loose = alone.join(p.filter("pkey like 'http::%'").withColumn("path", path), "path").select(*straight.columns)
    apart = (F.col("c_repo") != F.col("p_repo")) | ((F.col("c_service") != "") & (F.col("p_service") != "") & (F.col("c_service") != F.col("p_service")))
    one = lambda x: F.when(F.col(x) == 0, 1.0).otherwise(F.col(x))
    return straight.union(loose).filter(apart).select("contractId", "c_repo", "c_symbol", "p_repo", "p_symbol", F.lit("exact").alias("matchType"), F.least(one("c_conf"), one("p_conf")).alias("confidence"))


def grpc_links(contracts: DataFrame) -> DataFrame:
    """Consumers of a whole service (`grpc::service/*`) with providers of its methods: the service equal, or the
    consumer's unqualified name the provider's last dotted segment."""
    service = F.lower(F.regexp_extract("contractId", "^grpc::([^/]*)", 1))
    c = contracts.filter((F.col("role") == "consumer") & is_wildcard(F.col("contractId"))).select("contractId", F.col("repo").alias("c_repo"), F.col("symbolUid").alias("c_symbol"), service.alias("name"))
    p = contracts.filter((F.col("role") == "provider") & F.col("contractId").startswith("grpc::") & ~is_wildcard(F.col("contractId")))
    p = p.select(F.col("contractId").alias("p_contract"), F.col("repo").alias("p_repo"), F.col("symbolUid").alias("p_symbol"), F.explode(F.array_distinct(F.array(service, F.substring_index(service, ".", -1)))).alias("name"))
    return c.join(p, "name").filter("c_repo <> p_repo").select("contractId", "p_contract", "c_repo", "c_symbol", "p_repo", "p_symbol").distinct()


def unmatched(contracts: DataFrame, links: DataFrame) -> DataFrame:
    """Wildcards, and contracts whose repository and key are at no end of a link."""
    key = contract_key(F.col("contractId"))
    ends = links.select(F.col("c_repo").alias("repo"), F.col("c_symbol").alias("symbolUid")).union(links.select("p_repo", "p_symbol")).distinct()
    return contracts.join(ends, ["repo", "symbolUid"], "left_anti").withColumn("key", key)


def distinct_contracts(contracts: DataFrame, sequence: str) -> DataFrame:
    """The first of each repository, contract, role and symbol."""
    key = ["repo", "contractId", "role", "symbolUid"]
    rest = [c for c in contracts.columns if c not in key]
    return contracts.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(sequence)).alias("v")).select(*key, *[f"v.{c}" for c in rest])


def group_query(hits: DataFrame, limit: int) -> DataFrame:
    """(repo, id, score) over repositories: each hit's reciprocal rank within its repository (columns repo, id, relevance)."""
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("relevance"), "id")))
    return ranked.select("repo", "id", (1 / (60 + F.col("r"))).alias("score")).orderBy(F.desc("score"), "repo", "id").limit(limit)


def group_contracts(contracts: DataFrame, links: DataFrame, kind: str = "", repo: str = "", unmatched_only: bool = False) -> DataFrame:
    out = unmatched(contracts, links) if unmatched_only else contracts
    out = out.filter(F.col("type") == kind) if kind else out
    return out.filter(F.col("repo") == repo) if repo else out


def group_status(members: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo, indexed, contracts_stale): members without a snapshot, or with one of another time, are stale."""
    return members.join(snapshots.select("repo", F.col("indexedAt").alias("at")), "repo", "left").select("repo", F.col("at").isNotNull().alias("indexed"), (~F.col("indexedAt").eqNullSafe(F.col("at"))).alias("contracts_stale"))


def service_of(files: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Each file's service: the longest boundary directory (dir, service) above it. Files join on each of their directories."""
    parts = F.split("filePath", "/")
    above = files.withColumn("dir", F.explode_outer(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))))
    return above.join(boundaries, "dir", "left").groupBy("filePath").agg(F.max_by("service", F.when(F.col("service").isNotNull(), F.length("dir"))).alias("service"))


def boundaries(files: DataFrame, markers: list[str], extensions: list[str]) -> DataFrame:
    """(dir, service, confidence): directories with a marker file and a source file below, not the root; 0.75, 0.9 and 1 for one, two and more markers."""
    d = F.regexp_extract("filePath", "^(.*)/[^/]*$", 1)
    marked = files.filter(F.substring_index("filePath", "/", -1).isin(*markers) & F.col("filePath").contains("/")).groupBy(d.alias("dir")).agg(F.countDistinct(F.substring_index("filePath", "/", -1)).alias("n"))
    sources = files.filter(F.lower(F.regexp_extract("filePath", r"(\.[^./]*)$", 1)).isin(*extensions))
    parts = F.split("filePath", "/")
    above = sources.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir")).distinct()
    return marked.join(above, "dir", "left_semi").select("dir", F.substring_index("dir", "/", -1).alias("service"), F.when(F.col("n") == 1, 0.75).when(F.col("n") == 2, 0.9).otherwise(1.0).alias("confidence"))

"""Contracts found in source text: HTTP providers and consumers, message topics, gRPC services, by a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.files import extension

_QUOTED = r"""["'`]([^"'`]+)["'`]"""
_JS, _VERB = ".js .jsx .ts .tsx .mjs .cjs", "(?i)(get|post|put|patch|delete)"
#: (extensions, kind, role, framework, confidence, pattern, group of the method or 0, group of the path or name, method where there is no group)
RULES = (
    (_JS, "http", "provider", "express", 0.8, rf"\b(?:app|router)\.{_VERB}\(\s*{_QUOTED}", 1, 2, ""),
    (_JS, "http", "provider", "nest", 0.8, rf"@{_VERB}\(\s*{_QUOTED}\s*\)", 1, 2, ""),
    (_JS, "http", "consumer", "fetch", 0.7, rf"\bfetch\(\s*{_QUOTED}", 0, 1, "GET"),
    (_JS, "http", "consumer", "axios", 0.75, rf"\baxios\.{_VERB}\(\s*{_QUOTED}", 1, 2, ""),
    (_JS, "http", "consumer", "jquery", 0.7, rf"\$\.{_VERB}\(\s*{_QUOTED}", 1, 2, ""),
    (".java .kt", "http", "provider", "spring", 0.8, r"""@(?i)(get|post|put|patch|delete)mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]+)\"""", 1, 2, ""),
    (".java .kt", "http", "consumer", "resttemplate", 0.7, r"""\b(?i)(get|post|put|delete)for(?:object|entity)\(\s*"([^"]+)\"""", 1, 2, ""),
    (".py", "http", "provider", "fastapi", 0.8, rf"@(?:app|router)\.{_VERB}\(\s*{_QUOTED}", 1, 2, ""),
    (".py", "http", "consumer", "requests", 0.75, rf"\brequests\.{_VERB}\(\s*f?{_QUOTED}", 1, 2, ""),
    (".go", "http", "provider", "go-router", 0.8, r"""\b\w+\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*"(/[^"]*)\"""", 1, 2, ""),
    (".go", "http", "provider", "go-stdlib", 0.75, r"""\bHandleFunc\(\s*"(/[^"]*)\"""", 0, 1, "*"),
    (".go", "http", "consumer", "go-http", 0.7, r"""\bhttp\.(Get|Post|Head)\(\s*"([^"]+)\"""", 1, 2, ""),
    (".php", "http", "provider", "laravel", 0.8, rf"Route::{_VERB}\(\s*{_QUOTED}", 1, 2, ""),
    (_JS + " .py .java .kt .go", "topic", "provider", "kafka", 0.7, rf"""\.(?:send|produce|publish)\(\s*(?:\{{\s*topic:\s*)?{_QUOTED}""", 0, 1, ""),
    (_JS + " .py .java .kt .go", "topic", "consumer", "kafka", 0.7, rf"""\.(?:subscribe|consume)\(\s*(?:\{{\s*topics?:\s*\[?\s*|\[\s*)?{_QUOTED}""", 0, 1, ""),
    (".java .kt", "topic", "consumer", "kafka", 0.8, r"""@KafkaListener\([^)]*topics\s*=\s*\{?\s*"([^"]+)\"""", 0, 1, ""),
    (".java .kt", "topic", "consumer", "rabbitmq", 0.8, r"""@RabbitListener\([^)]*queues\s*=\s*\{?\s*"([^"]+)\"""", 0, 1, ""),
)


def canonical_path(path: Column, consumer: bool) -> Column:
    """Lower case with every parameter as {param}; a consumer's also without scheme and host, template parts and numbers as parameters."""
    p = F.substring_index(F.lower(path), "?", 1)
    if consumer:
        p = F.regexp_replace(F.regexp_replace(p, r"^[a-z]+://[^/]*", ""), r"\$\{[^}]*\}", "{param}")
        p = F.regexp_replace(p, r"(?<=/)\d+(?=/|$)", "{param}")
    p = F.regexp_replace(F.substring_index(p, "#", 1), r":[a-z_]\w*|\{[^}]*\}|\[[^\]]*\]", "{param}")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def scanned(files: DataFrame, repo: str = "") -> DataFrame:
    """Contracts (contractId, type, role, symbolFile, framework, confidence, repo) of files, each once. One pass over the
    rows: every rule is a column, not a join."""
    body = F.coalesce(F.col("content"), F.lit(""))
    found = []
    for extensions, kind, role, framework, confidence, pattern, method, group, fixed in RULES:
        names = F.regexp_extract_all(body, F.lit(pattern), F.lit(group))
        methods = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(method)), F.upper) if method else F.transform(names, lambda x: F.lit(fixed))  # noqa: B023
        row = lambda n, m: F.struct(F.lit(kind).alias("type"), F.lit(role).alias("role"), F.lit(framework).alias("framework"), F.lit(confidence).alias("confidence"), m.alias("method"), n.alias("raw"))  # noqa: B023, E731
        rows = F.zip_with(names, methods, row)
        found.append(F.when(extension(F.col("filePath")).isin(*extensions.split()), rows).otherwise(F.slice(rows, 1, 0)))
    hits = files.select("filePath", F.explode(F.flatten(F.array(*found))).alias("h")).select("filePath", "h.*")
    path = F.when(F.col("role") == "consumer", canonical_path(F.col("raw"), True)).otherwise(canonical_path(F.col("raw"), False))
    key = F.when(F.col("type") == "http", F.concat(F.lit("http::"), F.col("method"), F.lit("::"), path)).otherwise(F.concat(F.lit("topic::"), F.lower(F.trim("raw"))))
    out = hits.select(key.alias("contractId"), "type", "role", F.col("filePath").alias("symbolFile"), "framework", "confidence")
    return out.union(grpc(files)).distinct().withColumn("repo", F.lit(repo))


def grpc(files: DataFrame) -> DataFrame:
    """Providers of every method of the services that .proto files declare, under their package."""
    proto = files.filter(F.lower("filePath").endswith(".proto")).select("filePath", F.regexp_replace(F.coalesce("content", F.lit("")), r"//[^\n]*", "").alias("c"))
    package = F.regexp_extract("c", r"\bpackage\s+([\w.]+)\s*;", 1)
    services = proto.select("filePath", package.alias("p"), F.explode(F.regexp_extract_all("c", F.lit(r"\bservice\s+(\w+\s*\{(?:[^{}]|\{[^{}]*\})*\})"), F.lit(1))).alias("s"))
    each = services.select("filePath", "p", F.regexp_extract("s", r"^(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("s", F.lit(r"\brpc\s+(\w+)"), F.lit(1))).alias("method"))
    name = F.concat(F.when(F.col("p") != "", F.concat("p", F.lit("."))).otherwise(""), "service")
    return each.select(F.concat(F.lit("grpc::"), F.lower(name), F.lit("/"), "method").alias("contractId"), F.lit("grpc").alias("type"), F.lit("provider").alias("role"), F.col("filePath").alias("symbolFile"), F.lit("proto").alias("framework"), F.lit(0.85).alias("confidence"))

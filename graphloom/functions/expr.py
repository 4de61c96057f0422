"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_path(path: Column) -> Column:
    """Forward slashes, lower case."""
    return F.lower(F.translate(path, "\\", "/"))


def is_test_path(path: Column) -> Column:
    """Paths of tests, as impact analysis leaves them out; a null path is no test."""
    p = clean_path(path)
    # Parts, beginnings and endings that mark tests.
    inside = [p.contains(x) for x in ("/test/", "/tests/", "/__tests__/")]
    begins = [p.startswith(x) for x in ("test/", "tests/", "__tests__/")]
    ends = [p.endswith(x) for x in ("_test.go", "_test.py", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx")]
    out = F.lit(False)
    for x in inside + begins + ends:
        out = out | x
    return F.coalesce(out, F.lit(False))


def is_test_file(path: Column) -> Column:
    """Files that are never entry points."""
    p = clean_path(path)
    return F.coalesce(is_test_path(path) | p.contains(".test.") | p.contains(".spec."), F.lit(False))


def display_confidence(kind: Column, confidence: Column) -> Column:
    """The stored confidence, or a usual one for the type where none is stored."""
    usual = F.when(kind.isin("CALLS", "IMPORTS", "DEFINES"), 0.95).when(kind.isin("USES", "INHERITS", "EXTENDS", "IMPLEMENTS"), 0.85).otherwise(0.7)
    return F.when(confidence > 0, confidence).otherwise(usual)


def edge_order(*columns: str) -> Column:
    """What orders edges: type, source, target, id."""
    return F.struct(*(columns or ("type", "sourceId", "targetId", "id")))


def base_type_name(raw: Column) -> Column:
    """`readonly` and leading pointers and brackets off, cut at generics, unions and calls, last dotted segment."""
    x = F.trim(F.regexp_replace(F.trim(raw), r"^readonly\s+", ""))
    x = F.regexp_replace(x, r"^(\[\]|[*&\s])+", "")
    x = F.trim(F.regexp_extract(x, r"^([^<|&\[\](]*)", 1))
    return F.substring_index(x, ".", -1)


def normal_url(url: Column) -> Column:
    """A route of the own application, or null: absolute and computed addresses are dropped."""
    x = F.trim(url)
    x = F.regexp_replace(x, r"\$\{[^}]*\}", "[param]")
    dropped = F.lower(x).rlike("^https?://") | x.contains("+") | x.contains("(") | (x == "")
    x = F.substring_index(F.substring_index(x, "?", 1), "#", 1)
    x = F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    x = F.when(x == "/", x).otherwise(F.regexp_replace(x, "/+$", ""))
    return F.when(dropped, F.lit(None)).otherwise(F.when(x == "", F.lit("/")).otherwise(x))


def contract_key(contract: Column) -> Column:
    """A contract id in the form that providers and consumers are compared by."""
    kind = F.lower(F.trim(F.substring_index(contract, "::", 1)))
    rest = F.substring(contract, F.length(F.substring_index(contract, "::", 1)) + 3, 1 << 30)
    method, path = F.upper(F.substring_index(rest, "::", 1)), F.expr("1")
    path = F.substring(rest, F.length(F.substring_index(rest, "::", 1)) + 3, 1 << 30)
    path = F.when(F.length(path) > 1, F.regexp_replace(F.trim(path), "/+$", "")).otherwise(path)
    http = F.concat(F.lit("http::"), method, F.lit("::"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    service, slash = F.lower(F.substring_index(rest, "/", 1)), F.instr(rest, "/")
    grpc = F.when(slash == 1, F.concat(F.lit("grpc::"), rest)).when(slash > 1, F.concat(F.lit("grpc::"), service, F.substring(rest, slash, 1 << 30))).otherwise(F.concat(F.lit("grpc::"), F.lower(rest)))
    return F.when(kind == "http", http).when(kind == "grpc", grpc).when(kind.isin("topic", "lib"), F.concat(kind, F.lit("::"), F.lower(F.trim(rest)))).otherwise(contract)

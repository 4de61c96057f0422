"""Routes, fetches and tools: extraction from content, matching, maps, checks of response shapes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import normal_url

# Patterns of links, fetches, routes and tools in content.
HREF, FETCH, PUSH = r"""href=["']([^"']+)["']""", r"""fetch\(\s*["'`]([^"'`]+)["'`]""", r"""router\.(?:push|replace|navigate)\(\s*["'`]([^"'`]+)["'`]"""
FRAMEWORK_ROUTE = r"""\b(?:app|router)\.(?:get|post|put|delete|patch|all|use)\(\s*["'`]([^"'`]+)["'`]"""
TOOL_CALL, TOOL_NAME = r"""\.tool\(\s*["']([^"']+)["']""", r"""name:\s*["']([^"']+)["']\s*,\s*description:"""
PRISMA, SUPABASE = r"""prisma\.([a-zA-Z_]\w*)\.([a-zA-Z_]\w*)\s*\(""", r"""supabase\s*\.\s*from\(\s*["'](\w+)["']\s*\)\s*\.\s*(\w+)"""


def _found(files: DataFrame, pattern: str, kind: str) -> DataFrame:
    return files.select("filePath", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(pattern), F.lit(1))).alias("raw"))


def navigation(files: DataFrame) -> DataFrame:
    """(filePath, kind, url) of fetches, pushes and links to the own application, each once a file."""
    found = _found(files, FETCH, "fetch").union(_found(files, PUSH, "navigation")).union(_found(files, HREF, "navigation"))
    return found.select("filePath", "kind", normal_url(F.col("raw")).alias("url")).filter("url is not null").distinct()


def fetch_sites(files: DataFrame) -> DataFrame:
    """(filePath, url, n): fetches of the own application and how often each address is fetched in a file."""
    return _found(files, FETCH, "fetch").select("filePath", normal_url(F.col("raw")).alias("url")).filter("url is not null").groupBy("filePath", "url").agg(F.count("*").alias("n"))


def framework_routes(files: DataFrame) -> DataFrame:
    """(url, filePath): routes declared on an app or router; the first file of each address."""
    return _found(files, FRAMEWORK_ROUTE, "route").select(normal_url(F.col("raw")).alias("url"), "filePath").filter("url is not null").groupBy("url").agg(F.min("filePath").alias("filePath"))


def filesystem_routes(files: DataFrame) -> DataFrame:
    """(url, filePath, kind) of page and route files in app/ and pages/ directories: [x] is a parameter, [...x] the
    rest, (group) nothing, index the directory."""
    app = F.regexp_extract("filePath", r"(?:^|/)app/(?:(.*)/)?(?:page|route)\.(?:tsx?|jsx?)$", 1)
    is_app = F.col("filePath").rlike(r"(?:^|/)app/(?:.*/)?(?:page|route)\.(?:tsx?|jsx?)$")
    pages = F.regexp_extract("filePath", r"(?:^|/)pages/(.*)\.(?:tsx?|jsx?)$", 1)
    is_pages = F.col("filePath").rlike(r"(?:^|/)pages/.*\.(?:tsx?|jsx?)$") & ~F.col("filePath").rlike(r"/_[^/]*$")
    raw = F.when(is_app, app).when(is_pages, F.regexp_replace(pages, r"(?:^|/)index$", ""))
    parts = F.filter(F.split(raw, "/"), lambda x: (x != "") & ~x.rlike(r"^\(.*\)$"))
    named = F.transform(parts, lambda x: F.when(x.rlike(r"^\[\[?\.\.\..+\]\]?$"), F.concat(F.lit("*"), F.regexp_replace(x, r"[\[\].]", ""))).when(x.rlike(r"^\[.+\]$"), F.concat(F.lit(":"), F.regexp_replace(x, r"[\[\]]", ""))).otherwise(x))
    return files.filter(is_app | is_pages).select(F.concat(F.lit("/"), F.array_join(named, "/")).alias("url"), "filePath", F.when(is_app, "app").otherwise("pages").alias("kind"))


def merged_routes(routes: DataFrame) -> DataFrame:
    """One row for each address: the first file, and all keys once (columns url, filePath, responseKeys, errorKeys)."""
    return routes.groupBy("url").agg(F.min("filePath").alias("filePath"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("responseKeys")))).alias("responseKeys"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("errorKeys")))).alias("errorKeys"))


def _dynamic(segment: Column) -> Column:
    return segment.startswith(":") | segment.rlike(r"^\[[^.].*\]$")


def matched_routes(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """(url, route): the equal route, else the first dynamic one that fits. Dynamic routes join on the number of
    segments and their first fixed segment at its place (those without one on the number alone, catch-alls on their fixed beginning)."""
    exact = urls.join(routes.select(F.col("url").alias("route")), F.col("url") == F.col("route")).select("url", "route")
    rest = urls.join(exact, "url", "left_anti").withColumn("parts", F.split(F.expr("substring(url, 2)"), "/"))
    dynamic = routes.select(F.col("url").alias("route"), F.split(F.expr("substring(url, 2)"), "/").alias("pattern"))
    star = F.element_at("pattern", -1).startswith("*")
    plain = dynamic.filter(~star & F.exists("pattern", _dynamic)).withColumn("n", F.size("pattern"))
    fits = F.forall(F.zip_with("parts", "pattern", lambda a, b: (a == b) | _dynamic(b) | (_dynamic(a) & _dynamic(b))), lambda x: x)
    at = F.array_position(F.transform("pattern", lambda x: ~_dynamic(x)), True).cast("int")
    plain = plain.withColumn("at", at).withColumn("fixed", F.when(F.col("at") > 0, F.try_element_at("pattern", F.col("at"))))
    sized = rest.withColumn("n", F.size("parts"))
    placed = sized.select("url", "parts", "n", F.posexplode("parts").alias("i", "fixed")).withColumn("at", F.col("i") + 1).drop("i")
    one = placed.join(plain.filter("at > 0"), ["n", "at", "fixed"]).filter(fits).select("url", "route").union(sized.join(plain.filter("at = 0").drop("at", "fixed"), "n").filter(fits).select("url", "route"))
    heads = dynamic.filter(star).select("route", F.array_join(F.slice("pattern", F.lit(1), F.size("pattern") - 1), "/").alias("head"))
    begun = rest.withColumn("head", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))))
    many = begun.join(heads, "head").select("url", "route")
    return exact.union(one.union(many).groupBy("url").agg(F.min("route").alias("route")))


def fetch_reason(keys: Column, fetches: Column) -> Column:
    """`fetch-url-match`, the accessed keys where there are any, and the number of fetches where over one."""
    return F.concat_ws("|", F.lit("fetch-url-match"), F.when(F.size(keys) > 0, F.concat(F.lit("keys:"), F.array_join(keys, ","))), F.when(fetches > 1, F.concat(F.lit("fetches:"), fetches.cast("string"))))


def reason_keys(reason: Column) -> Column:
    part = F.element_at(F.filter(F.split(reason, r"\|"), lambda x: x.startswith("keys:")), 1)
    return F.coalesce(F.array_sort(F.filter(F.transform(F.split(F.substring(part, 6, 1 << 20), ","), lambda x: F.trim(x)), lambda x: x != "")), F.array().cast("array<string>"))


def reason_fetches(reason: Column) -> Column:
    n = F.regexp_extract(reason, r"(?:^|\|)fetches:(\d+)", 1)
    return F.when((n != "") & (n.try_cast("int") > 1), n.try_cast("int")).otherwise(0)


def route_map(nodes: DataFrame, edges: DataFrame, text: str = "") -> DataFrame:
    """(route, name, filePath, consumers, flows): who fetches each route, and the flows that enter there."""
    routes = nodes.filter("label = 'Route'").select(F.col("id").alias("route"), "name", "filePath")
    routes = routes.filter(F.col("name").contains(text)) if text else routes
    c = edges.filter("type = 'FETCHES'").join(nodes.select(F.col("id").alias("sourceId"), F.col("filePath").alias("f"), F.col("name").alias("n")), "sourceId").groupBy(F.col("targetId").alias("route")).agg(F.array_sort(F.collect_list(F.struct("f", "n", "reason"))).alias("consumers"))
    w = edges.filter("type = 'ENTRY_POINT_OF'").groupBy(F.col("sourceId").alias("route")).agg(F.array_sort(F.collect_set("targetId")).alias("flows"))
    return routes.join(c, "route", "left").join(w, "route", "left")


def shape_check(routes: DataFrame, consumers: DataFrame) -> DataFrame:
    """(route, consumer, mismatched, error_path, confidence): keys a consumer reads (column keys) against those of a
    route (responseKeys, errorKeys). Several fetches in one place make the finding uncertain."""
    j = routes.filter((F.size("responseKeys") > 0) | (F.size("errorKeys") > 0)).join(consumers.filter(F.size("keys") > 0), "route")
    return j.select("route", "consumer", F.array_sort(F.array_except("keys", F.array_union("responseKeys", "errorKeys"))).alias("mismatched"), F.array_sort(F.array_except(F.array_intersect("keys", "errorKeys"), "responseKeys")).alias("error_path"), F.when(F.col("fetches") > 1, "low").otherwise("high").alias("confidence"))


def api_impact(routes: DataFrame, consumers: DataFrame) -> DataFrame:
    """(route, consumers, mismatches, risk): 10 and 4 consumers make it high and medium, a mismatch lifts it one step."""
    bad = shape_check(routes, consumers).groupBy("route").agg(F.count_if(F.size("mismatched") > 0).alias("mismatches"))
    n = consumers.groupBy("route").agg(F.countDistinct("consumer").alias("consumers"))
    j = routes.select("route").join(n, "route", "left").join(bad, "route", "left").fillna(0, ["consumers", "mismatches"])
    level = F.when(F.col("consumers") >= 10, 2).when(F.col("consumers") >= 4, 1).otherwise(0) + F.when(F.col("mismatches") > 0, 1).otherwise(0)
    return j.withColumn("risk", F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.least(level, F.lit(2)) + 1))


def tools(files: DataFrame) -> DataFrame:
    """(tool, filePath): tools defined by calls or by schema objects; the first file of each name."""
    return _found(files, TOOL_CALL, "tool").union(_found(files, TOOL_NAME, "tool")).groupBy(F.col("raw").alias("tool")).agg(F.min("filePath").alias("filePath"))


def orm_queries(files: DataFrame) -> DataFrame:
    """(filePath, orm, model, method), each once."""
    def pairs(pattern: str, orm: str) -> DataFrame:
        body = F.coalesce(F.col("content"), F.lit(""))
        return files.select("filePath", F.lit(orm).alias("orm"), F.explode(F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("model"), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("method"))).alias("m")).select("filePath", "orm", "m.model", "m.method")

    return pairs(PRISMA, "prisma").union(pairs(SUPABASE, "supabase")).distinct()


# What a consumer's variable offers besides the response's own keys.
COMMON_NAMES = ("json", "text", "ok", "status", "then", "catch", "map", "filter", "length", "forEach", "find", "reduce", "push", "slice", "headers")
_JSON_CALL = re.compile(r"\.json\(\s*\{")
_STATUS = re.compile(r"status\s*[:(]\s*(\d{3})")
_PHP_CALL = re.compile(r"json_encode\(\s*(?:\[|array\()")


def _closed(text: str, at: int, pair: str) -> int:
    """Where the bracket opened at `at` closes; strings are passed over."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c == pair[0]:
            depth += 1
        elif c == pair[1]:
            depth -= 1
            if not depth:
                return i
    return len(text)


def _top_keys(body: str, php: bool) -> list[str]:
    """Keys of an object literal's own level."""
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote and body[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(body[last:i])
            last = i + 1
    parts.append(body[last:])
    pattern = r"""^\s*["'](\w+)["']\s*=>""" if php else r"""^\s*["']?([A-Za-z_$][\w$]*)["']?\s*(?::|$)"""
    return [m[1] for p in parts if (m := re.match(pattern, p))]


def response_keys(text: str, php: bool = False) -> tuple[list[str], list[str]]:
    """(keys of good responses, keys of errors): a response whose status is 400 or more is an error."""
    good, bad = [], []
    for m in (_PHP_CALL if php else _JSON_CALL).finditer(text):
        pair = "()" if php and text[m.end() - 1] == "(" else "[]" if php else "{}"
        end = _closed(text, m.end() - 1, pair)
        near = text[max(0, m.start() - 120) : m.start()] if php else text[max(0, m.start() - 20) : m.start()] + text[end : end + 60].split(";")[0]
        codes = re.findall(r"http_response_code\(\s*(\d{3})", near) if php else _STATUS.findall(near)
        (bad if codes and int(codes[-1]) >= 400 else good).extend(_top_keys(text[m.end() : end], php))
    return sorted(set(good)), sorted(set(bad))


def response_shapes(files: DataFrame) -> DataFrame:
    """(filePath, responseKeys, errorKeys) of files that answer with JSON."""

    def run(batches):
        for batch in batches:
            rows = [(f.filePath, *response_keys(f.content or "", f.filePath.endswith(".php"))) for f in batch.itertuples()]
            yield pd.DataFrame([r for r in rows if r[1] or r[2]], columns=["filePath", "responseKeys", "errorKeys"])

    return files.select("filePath", "content").mapInPandas(run, "filePath string, responseKeys array<string>, errorKeys array<string>")


def accessed_keys(content: Column) -> Column:
    """Keys that a consumer takes from `await x.json()`: destructured, or read from the variable it is put in."""
    taken = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(r"\{([^{}]*)\}\s*=\s*await\s+\w+\.json\(\)"), F.lit(1)), lambda x: F.split(x, ",")))
    names = F.filter(F.transform(taken, lambda x: F.trim(F.regexp_replace(x, "[:=].*$", ""))), lambda x: x != "")
    held = F.regexp_extract_all(content, F.lit(r"(?:const|let|var)\s+(\w+)\s*=\s*await\s+\w+\.json\(\)"), F.lit(1))
    read = F.regexp_extract_all(content, F.lit(r"\b(\w+\.\w+)"), F.lit(1))
    of_held = F.transform(F.filter(read, lambda x: F.array_contains(held, F.substring_index(x, ".", 1))), lambda x: F.substring_index(x, ".", -1))
    return F.array_sort(F.array_except(F.array_distinct(F.concat(names, of_held)), F.array(*map(F.lit, COMMON_NAMES))))


def middleware(content: Column) -> Column:
    """Wrappers (withAuth(withLog(handler))) of the first exported verb or default, outermost first."""
    line = F.regexp_extract(content, r"export\s+(?:const\s+(?:GET|POST|PUT|PATCH|DELETE)\s*=|default)\s*((?:with\w+\(\s*)+)", 1)
    return F.regexp_extract_all(line, F.lit(r"(with\w+)\("), F.lit(1))


def routes_under(routes: DataFrame, matchers: DataFrame) -> DataFrame:
    """(url, middleware): project middleware (name, prefix) by the beginnings of addresses; routes join on each beginning."""
    parts = F.split(F.expr("substring(url, 2)"), "/")
    begun = routes.select("url", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("prefix"))
    return begun.distinct().join(matchers, "prefix").groupBy("url").agg(F.array_sort(F.collect_set("name")).alias("middleware"))

"""From files to a graph: structure, documents, definitions, resolved references, inheritance, routes, tools and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import base_type_name
from ..operators import clusters, flows, frameworks, imports as I, resolution as R, routes, structure
from ..operators.store import merged_edges
from ..sources.extract import facts as extract_facts
from ..workspace import committed

EDGE = ("sourceId", "targetId", "type", "confidence", "reason", "line")


def _edge(df: DataFrame, source: str, target: str, kind: str, confidence=1.0, reason="", line=None) -> DataFrame:
    c = lambda v: v if not isinstance(v, (str, float, int)) else F.lit(v)
    return df.select(F.col(source).alias("sourceId"), F.col(target).alias("targetId"), F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), c(confidence).alias("confidence"), c(reason).alias("reason"), (F.col(line) if line else F.lit(None).cast("int")).alias("line"))


def definitions(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of definitions; of several with one id the first counts; content is cut from the file's lines."""
    d = facts.filter("fact = 'definition'").groupBy("id").agg(F.min_by(F.struct("label", "name", "filePath", "startLine", "endLine", "required", "count", "type"), "seq").alias("d")).select("id", "d.*")
    lines = files.select("filePath", F.split("content", "\n").alias("lines"))
    body = F.array_join(F.slice("lines", F.col("startLine"), F.greatest(F.col("endLine") - F.col("startLine") + 1, F.lit(0))), "\n")
    return d.join(lines, "filePath", "left").select("id", "label", "name", "filePath", F.col("startLine").cast("long").alias("startLine"), F.col("endLine").cast("long").alias("endLine"), F.col("count").alias("parameterCount"), "required", F.col("type").alias("returnType"), body.alias("content"))


def resolved_calls(facts: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, def, tier, confidence, name, line, source): calls by tier, from their enclosing callable or else their file."""
    scopes = facts.filter("fact = 'scope'").select("id", "parent")
    above = committed(structure.scope_ancestors(scopes), "scope-ancestors")
    calls = committed(facts.filter("fact = 'call'").select(F.concat_ws("#", "filePath", "seq").alias("ref"), "filePath", "name", "scope", "form", "receiver", "arity", F.col("startLine").alias("line")), "calls")
    target = defs.filter("label in ('Function', 'Method', 'Constructor', 'Class', 'Struct', 'Record')").select(F.col("id").alias("def"), "name", F.col("filePath").alias("file"), "required", "parameterCount", "label")
    fits = R.arity_fits(F.col("arity"), F.col("required"), F.col("parameterCount")) & ((F.col("form") != "constructor") | F.col("label").isin("Class", "Struct", "Record", "Constructor"))
    own = facts.filter("fact = 'definition'").select("scope", "name", F.col("id").alias("def"))
    brought = imports.filter("def is not null").select("scope", "name", "def")
    chained = R.scope_chain(calls.filter("form <> 'member'").select("ref", "scope", "name"), above, own.union(brought)).filter("status = 'found'").select("ref", "def", F.lit("name").alias("tier"))
    # Calls of one name, number of arguments and form mean the same everywhere: they are matched once, and only a name with one target goes back.
    kinds = calls.select("name", "arity", "form").distinct()
    alone = kinds.join(target, "name").filter(fits).groupBy("name", "arity", "form").agg(F.min("def").alias("def"), F.max("def").alias("last")).filter("def = last")
    everywhere = calls.join(alone, (calls["name"] == alone["name"]) & calls["arity"].eqNullSafe(alone["arity"]) & (calls["form"] == alone["form"])).select("ref", "def", F.lit("global").alias("tier"))
    same = calls.filter("form <> 'member'").join(target, (calls["name"] == target["name"]) & (F.col("filePath") == F.col("file"))).filter(fits).select("ref", "def", F.lit("file").alias("tier"))
    folder = lambda c: F.regexp_extract(c, "^(.*/)?[^/]*$", 1)
    near = target.filter(F.col("file").endswith(".go")).withColumn("folder", folder("file"))
    package = calls.filter("form <> 'member'").filter(F.col("filePath").endswith(".go")).withColumn("folder", folder("filePath")).join(near, ["name", "folder"]).filter(fits).select("ref", "def", F.lit("package").alias("tier"))
    members = facts.filter("fact = 'member'").select(F.col("parent").alias("owner"), "name", F.col("id").alias("def"))
    inside = calls.filter("form = 'member' and receiver in ('self', 'this', 'cls', '$this', '')")
    enclosing = facts.filter("fact = 'owned' and label not in ('Function', 'Method', 'Constructor')").select(F.col("scope").alias("ancestor"), F.col("id").alias("owner"))
    typed = inside.join(above, "scope").join(enclosing, "ancestor").join(members, ["owner", "name"]).groupBy("ref", "depth").agg(F.min("def").alias("def"), F.countDistinct("def").alias("n")).groupBy("ref").agg(F.min_by(F.struct("def", "n"), "depth").alias("b")).filter("b.n = 1").select("ref", "b.def", F.lit("typed").alias("tier"))
    through = calls.filter("form = 'member'").join(imports.select(F.col("filePath"), F.col("name").alias("receiver"), F.col("target").alias("file")).distinct(), ["filePath", "receiver"]).join(target.select("name", "file", "def"), ["name", "file"]).select("ref", "def", F.lit("imported").alias("tier"))
    found = chained.union(same).union(package).union(everywhere).union(typed).union(through)
    best = R.call_tiers(found.join(calls.select("ref", "form", F.when(F.col("receiver").isin("self", "this", "cls", "$this"), "").otherwise(F.col("receiver")).alias("receiver")), "ref"))
    owned = facts.filter("fact = 'owned'").select("scope", F.col("id").alias("def"), "label", F.col("seq").alias("pos"))
    source = R.enclosing(calls.select("ref", "scope"), above, owned).withColumnRenamed("def", "source")
    return best.join(calls.select("ref", "filePath", "name", "line"), "ref").join(source, "ref", "left").withColumn("source", F.coalesce("source", F.concat(F.lit("File:"), "filePath")))


def resolved_imports(facts: DataFrame, files: DataFrame, defs: DataFrame) -> DataFrame:
    """(filePath, scope, name, form, target, def): imports with the files they name by the rules of their language, and the
    definition where there is just one: of the imported name, else of the local one. Wildcards bring what the files define."""
    raw = facts.filter("fact = 'import'").select(F.concat_ws("#", "filePath", "seq").alias("import"), "filePath", "scope", "name", "form", "parent", "target")
    raw = committed(raw.join(files.select("filePath", "language"), "filePath"), "imports")
    asked = raw.select("import", "language", F.col("filePath").alias("source"), "target", (F.col("form") == "wildcard").alias("wildcard"))
    hit = committed(I.targets(asked, files.select("filePath", "language")), "import-files")
    at = raw.drop("target", "language").join(hit.select("import", F.col("filePath").alias("target")), "import").filter("filePath <> target")
    d = defs.select(F.col("filePath").alias("target"), F.col("name").alias("wanted"), F.col("id").alias("def"))
    wanted = at.select("import", "target", F.posexplode(F.array("parent", "name")).alias("rank", "wanted")).filter("wanted is not null and wanted <> '*'")
    ranked = wanted.join(d, ["target", "wanted"]).groupBy("import", "rank").agg(F.min("def").alias("def"), F.countDistinct("def").alias("n"))
    one = ranked.groupBy("import").agg(F.min_by(F.struct("def", "n"), "rank").alias("b")).filter("b.n = 1").select("import", "b.def")
    bound = at.join(one, "import", "left").select("filePath", "scope", "name", "form", "target", "def")
    stars = I.wildcards(at.filter("form = 'wildcard'"), defs).select("filePath", "scope", "name", F.lit("wildcard").alias("form"), "target", "def")
    return committed(bound.union(stars), "resolved-imports")


# Names of types that no definition stands for.
BUILTIN_TYPES = ("string", "number", "boolean", "any", "unknown", "void", "never", "object", "int", "float", "bool", "str", "None", "null", "undefined")


def resolved_accesses(facts: DataFrame, heritage: DataFrame) -> DataFrame:
    """(source, def, form, line): accesses through self or this to a property of the enclosing owner, or else of the nearest of its
    ancestors that has just one of the name."""
    above = committed(structure.scope_ancestors(facts.filter("fact = 'scope'").select("id", "parent")), "scope-ancestors")
    used = committed(facts.filter("fact = 'access' and receiver in ('self', 'this', 'cls', '$this')").select(F.concat_ws("#", "filePath", "seq").alias("ref"), "filePath", "scope", "name", "form", F.col("startLine").alias("line")), "accesses")
    owned = facts.filter("fact = 'owned'").select("scope", F.col("id").alias("def"), "label", F.col("seq").alias("pos"))
    owners = owned.filter("label not in ('Function', 'Method', 'Constructor')").select(F.col("scope").alias("ancestor"), F.col("def").alias("class"))
    mine = used.join(above, "scope").join(owners, "ancestor").groupBy("ref").agg(F.min_by("class", "depth").alias("class"))
    line = R.ancestors(heritage.select(F.col("child"), F.col("def").alias("parent"), "type")).select("class", "ancestor", "depth")
    reach = mine.select("ref", F.col("class").alias("ancestor"), F.lit(0).alias("depth")).union(mine.join(line, "class").select("ref", "ancestor", "depth"))
    properties = facts.filter("fact = 'member' and label in ('Property', 'Variable', 'Const')").select(F.col("parent").alias("ancestor"), "name", F.col("id").alias("def"))
    hits = reach.join(used.select("ref", "name"), "ref").join(properties, ["ancestor", "name"]).groupBy("ref", "depth").agg(F.min("def").alias("def"), F.countDistinct("def").alias("n"))
    best = hits.groupBy("ref").agg(F.min_by(F.struct("def", "n"), "depth").alias("b")).filter("b.n = 1").select("ref", "b.def")
    source = R.enclosing(used.select("ref", "scope"), above, owned).withColumnRenamed("def", "source")
    return best.join(used, "ref").join(source, "ref").select("source", "def", "form", "line")


def resolved_annotations(facts: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, def, line): types named by annotations, through the chain of scopes, else a type whose name is unique."""
    above = committed(structure.scope_ancestors(facts.filter("fact = 'scope'").select("id", "parent")), "scope-ancestors")
    named = facts.filter("fact = 'annotation'").select(F.concat_ws("#", "filePath", "seq").alias("ref"), "filePath", "scope", base_type_name(F.col("type")).alias("name"), F.col("startLine").alias("line"))
    named = committed(named.filter((F.col("name") != "") & ~F.col("name").isin(*BUILTIN_TYPES)), "annotations")
    types = defs.filter("label in ('Class', 'Interface', 'Struct', 'Trait', 'Record', 'Enum', 'TypeAlias')").select("name", F.col("id").alias("def"))
    own = facts.filter("fact = 'definition' and label in ('Class', 'Interface', 'Struct', 'Trait', 'Record', 'Enum', 'TypeAlias')").select("scope", "name", F.col("id").alias("def"))
    chain = R.scope_chain(named.select("ref", "scope", "name"), above, own.union(imports.filter("def is not null").select("scope", "name", "def")))
    alone = R.unique_or_none(types, "name", "def")
    found = chain.filter("status = 'found'").select("ref", "def").union(chain.filter("status = 'none'").select("ref").join(named, "ref").join(alone, "name").select("ref", "def"))
    owned = facts.filter("fact = 'owned'").select("scope", F.col("id").alias("def"), "label", F.col("seq").alias("pos"))
    source = R.enclosing(named.select("ref", "scope"), above, owned).withColumnRenamed("def", "source")
    return found.join(named, "ref").join(source, "ref", "left").select(F.coalesce("source", F.concat(F.lit("File:"), "filePath")).alias("source"), "def", "line").filter("source <> def")


def analyze(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (filePath, language, content)."""
    files = committed(files.select("filePath", "language", "content"), "files")
    facts = committed(extract_facts(files), "facts")
    defs = committed(definitions(facts, files), "definitions")
    folders, contains = structure.folder_tree(files)
    sections = structure.nested_sections(structure.headings(files.filter("language = 'markdown'")))
    imports = resolved_imports(facts, files, defs)
    calls = resolved_calls(facts, defs, imports)
    types = defs.filter("label in ('Class', 'Interface', 'Struct', 'Trait', 'Record', 'Enum')").select("name", F.col("id").alias("def"), "filePath")
    h = facts.filter("fact = 'heritage'").select("filePath", F.col("id").alias("child"), "name", "type")
    near = h.join(types, "name").withColumn("far", (h["filePath"] != types["filePath"]).cast("int"))
    heritage = near.groupBy("child", "name", "type", "far").agg(F.min("def").alias("def"), F.countDistinct("def").alias("n")).filter("n = 1").groupBy("child", "name", "type").agg(F.min_by("def", "far").alias("def")).filter("child <> def")
    members = facts.filter("fact = 'member'")
    routes_ = routes.filesystem_routes(files).select("url", "filePath").union(routes.framework_routes(files)).groupBy("url").agg(F.min("filePath").alias("filePath"))
    tools, models = routes.tools(files), routes.orm_queries(files)
    sites = committed(routes.fetch_sites(files), "fetch-sites")
    fetched = routes.matched_routes(sites.select("url").distinct(), routes_)
    keys = files.select("filePath", routes.accessed_keys(F.coalesce("content", F.lit(""))).alias("keys"))
    fetches = sites.join(fetched, "url").groupBy("filePath", "route").agg(F.sum("n").alias("n")).join(keys, "filePath").withColumn("reason", routes.fetch_reason(F.col("keys"), F.col("n")))
    accesses, annotations = resolved_accesses(facts, heritage), resolved_annotations(facts, defs, imports)
    shapes = routes.response_shapes(files)
    about = files.select("filePath", routes.middleware(F.coalesce("content", F.lit(""))).alias("middleware")).join(shapes, "filePath", "left").join(routes_, "filePath").select(F.concat(F.lit("Route:"), "url").alias("id"), "responseKeys", "errorKeys", "middleware")
    hints = files.select("filePath", frameworks.path_hint(F.col("filePath"))["multiplier"].alias("byPath"), "language")
    name = lambda prefix, c: F.concat(F.lit(prefix), c)
    edges = [
        contains.withColumn("line", F.lit(None).cast("int")).select(*EDGE),
        _edge(sections, "parent", "id", "CONTAINS", 1.0, "document structure"),
        structure.document_links(files).withColumns({"reason": F.lit("document link"), "line": F.lit(None).cast("int")}).select(*EDGE),
        _edge(defs.withColumn("f", name("File:", F.col("filePath"))), "f", "id", "DEFINES"),
        _edge(members, "parent", "id", F.when(F.col("label") == "Property", "HAS_PROPERTY").otherwise("HAS_METHOD")),
        _edge(imports.select(name("File:", F.col("filePath")).alias("a"), name("File:", F.col("target")).alias("b")).distinct(), "a", "b", "IMPORTS"),
        _edge(calls, "source", "def", "CALLS", F.col("confidence"), F.col("tier"), "line"),
        _edge(heritage, "child", "def", F.col("type")),
        _edge(routes_.select(name("File:", F.col("filePath")).alias("a"), name("Route:", F.col("url")).alias("b")), "a", "b", "HANDLES_ROUTE"),
        _edge(fetches.select(name("File:", F.col("filePath")).alias("a"), name("Route:", F.col("route")).alias("b"), "reason"), "a", "b", "FETCHES", 0.9, F.col("reason")),
        _edge(accesses, "source", "def", "ACCESSES", 1.0, F.col("form"), "line"),
        _edge(annotations, "source", "def", "USES", 1.0, "type-annotation", "line"),
        _edge(imports.filter("def is not null").select(name("File:", F.col("filePath")).alias("a"), F.col("def").alias("b")).distinct(), "a", "b", "USES", 1.0, "import"),
        _edge(tools.select(name("File:", F.col("filePath")).alias("a"), name("Tool:", F.col("tool")).alias("b")), "a", "b", "HANDLES_TOOL"),
        _edge(models.select(name("File:", F.col("filePath")).alias("a"), name("CodeElement:", F.col("model")).alias("b"), F.concat_ws(".", "orm", "method").alias("m")), "a", "b", "QUERIES", 0.9, F.col("m")),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    out = out.withColumn("id", F.concat_ws(":", F.lit("rel"), "type", F.concat_ws("->", "sourceId", "targetId"), F.coalesce("line", F.lit(0)).cast("string"), F.lit("0")))
    kept = merged_edges(out.withColumns({"seq": F.col("id"), "callName": F.when(F.col("type") == "CALLS", F.substring_index("targetId", ".", -1)).otherwise(""), "access": F.when(F.col("type") == "ACCESSES", F.col("reason")).otherwise("")})).drop("callName")
    kept = kept.withColumn("step", F.when(F.col("access") == "read", 1).when(F.col("access") == "write", 2)).drop("access")
    blank = lambda c, t: F.lit(None).cast(t).alias(c)
    plain = lambda df, label: df.select("id", F.lit(label).alias("label"), "name", "filePath", blank("startLine", "long"), blank("endLine", "long"), blank("parameterCount", "int"), blank("returnType", "string"), blank("content", "string"))
    nodes = (
        folders.join(files.select("filePath", "content"), "filePath", "left").select("id", "label", "name", "filePath", blank("startLine", "long"), blank("endLine", "long"), blank("parameterCount", "int"), blank("returnType", "string"), F.when(F.col("label") == "File", F.col("content")).alias("content"))
        .union(defs.drop("required").select("id", "label", "name", "filePath", "startLine", "endLine", "parameterCount", "returnType", "content"))
        .union(sections.select("id", F.lit("Section"), "name", "filePath", F.col("line"), F.col("endLine"), blank("p", "int"), blank("r", "string"), blank("c", "string")))
        .union(plain(routes_.select(name("Route:", F.col("url")).alias("id"), F.col("url").alias("name"), "filePath"), "Route"))
        .union(plain(tools.select(name("Tool:", F.col("tool")).alias("id"), F.col("tool").alias("name"), "filePath"), "Tool"))
        .union(plain(models.groupBy("model").agg(F.min("filePath").alias("filePath")).select(name("CodeElement:", F.col("model")).alias("id"), F.col("model").alias("name"), "filePath"), "CodeElement"))
    )
    nodes = nodes.dropDuplicates(["id"]).join(about, "id", "left").join(hints, "filePath", "left")
    by_text = frameworks.text_hint(F.col("language"), F.col("content"))["multiplier"]
    callable_ = F.col("label").isin("Function", "Method", "Class", "Constructor")
    nodes = nodes.withColumn("astFrameworkMultiplier", F.when(callable_, F.greatest("byPath", by_text))).drop("byPath", "language")
    return committed(nodes, "nodes"), committed(kept, "edges")


def communities_and_flows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with its communities (MEMBER_OF) and execution flows (ENTRY_POINT_OF, STEP_IN_PROCESS, routes and tools linked)."""
    links = committed(clusters.projection(nodes, edges), "cluster-links")
    members = committed(clusters.detect(links), "members")
    made, belongs = clusters.emitted(nodes, links, members)
    kept = flows.without_parts(flows.traces(edges, flows.entry_scores(nodes, edges).select("id")))
    symbols = nodes.filter(F.col("label").isin("Function", "Method", "Class", "Interface")).count()
    budget = max(20, min(int(symbols / 10 + 0.5), 700))
    processes, steps = flows.processes(nodes, kept, members, budget)
    linked = flows.resource_links(nodes, processes)
    new_nodes = made.withColumn("name", F.coalesce("heuristicLabel", "id")).unionByName(processes, allowMissingColumns=True)
    new_edges = belongs.unionByName(steps, allowMissingColumns=True).unionByName(linked, allowMissingColumns=True)
    step = F.when(F.col("step").isNotNull(), F.concat(F.lit(":"), F.col("step").cast("string"))).otherwise("")
    new_edges = new_edges.withColumn("id", F.concat(F.lit("rel:"), "type", F.lit(":"), "sourceId", F.lit("->"), "targetId", step))
    return committed(nodes.unionByName(new_nodes, allowMissingColumns=True), "nodes"), committed(edges.unionByName(new_edges, allowMissingColumns=True), "edges")


def inheritance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """METHOD_OVERRIDES and METHOD_IMPLEMENTS edges of an analysed graph."""
    parents = edges.filter("type in ('EXTENDS', 'IMPLEMENTS')").select(F.col("sourceId").alias("child"), F.col("targetId").alias("parent"), "type")
    above = committed(R.ancestors(parents), "class-ancestors")
    methods = edges.filter("type = 'HAS_METHOD'").select(F.col("sourceId").alias("owner"), F.col("targetId").alias("method")).join(nodes.select(F.col("id").alias("method"), "name", F.col("parameterCount").alias("count")), "method").withColumn("types", F.array().cast("array<string>"))
    o = R.overrides(above, methods).select(F.col("class").alias("sourceId"), F.col("method").alias("targetId"), F.lit("METHOD_OVERRIDES").alias("type"), "confidence")
    i = R.implementations(above, methods, nodes.select("id", "label")).select(F.col("method").alias("sourceId"), F.col("target").alias("targetId"), F.lit("METHOD_IMPLEMENTS").alias("type"), "confidence")
    more = R.inherited_implementations(above, methods, nodes.select("id", "label")).select(F.col("method").alias("sourceId"), F.col("target").alias("targetId"), F.lit("METHOD_IMPLEMENTS").alias("type"), "confidence")
    return o.union(i).union(more.join(i, ["sourceId", "targetId"], "left_anti").select(*o.columns))

"""Growth of the graph queries: what they shuffle and hand from step to step, on inputs that took too much before."""

from pyspark.sql import functions as F

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from graphloom.operators import clusters, impact, imports, lookup, resolution, store, structure, text
from graphloom.sources import projection
from graphloom.workspace import committed


def stages(spark):
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [store.apply(i) for i in range(store.size())]


def shuffled_mb(spark, work):
    """MB that `work` writes to shuffles, and its result."""
    last = max((s.stageId() for s in stages(spark)), default=-1)
    out = work()
    return sum(s.shuffleWriteBytes() for s in stages(spark) if s.stageId() > last) / 1e6, out


@contextmanager
def no_small_tables(spark, most="-1"):
    """As with tables too large to be broadcast unasked: all, or those beyond so many bytes."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def large_graph(spark):
    """60,000 calls between 40,000 functions, of which few touch f0 to f9."""
    n = committed(spark.range(40_000).selectExpr("concat('Function:f', id) as id", "'Function' as label", "concat('f', id) as name", "concat('src/', id % 100, '.ts') as filePath", "1L as startLine", "9L as endLine"), "n")
    e = spark.range(60_000).selectExpr("id as k", "concat('Function:f', 10 + pmod(xxhash64(id), 39990)) as sourceId", "concat('Function:f', 10 + pmod(xxhash64(id + 7), 39990)) as targetId", "'CALLS' as type", "1.0D as confidence", "cast(null as int) as step")
    few = spark.range(20).selectExpr("id + 100000", "concat('Function:f', id + 5)", "concat('Function:f', id % 4)", "'CALLS'", "1.0D", "cast(null as int)")
    return n, committed(e.union(few).selectExpr("concat('rel:', k) as id", "sourceId", "targetId", "type", "confidence", "step"), "e")


def most_rows(df):
    """The most rows that one step of the plan handed on, and the rows of the result."""
    rows = df.collect()

    def steps(plan):
        yield plan
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        for child in inner + [plan.children().apply(i) for i in range(plan.children().size())]:
            yield from steps(child)

    counts = [p.metrics().apply("numOutputRows").value() for p in steps(df._jdf.queryExecution().executedPlan()) if p.metrics().contains("numOutputRows")]
    return max(counts), rows


def test_the_graph_is_stored_without_shuffling_its_rows(spark):
    """7 MB when whole rows of text were dealt out by their ends; the numbers that tell lines apart are under 2."""
    moved, (n, e) = shuffled_mb(spark, lambda: projection.graph(spark, "/root/testdata/sf0.01/."))
    assert moved < 3.5
    for got, sql in ((n, projection.NODES), (e, projection.EDGES)):
        want = spark.sql(sql.replace("VARCHAR(20)", "STRING"))
        assert got.columns == want.columns and got.count() == want.count()
        assert got.exceptAll(want).isEmpty()


def test_enclosing_does_not_meet_references_with_all_that_scopes_own(spark):
    """2,000 references in a scope of 2,000 definitions below one of 2,000: 8 million pairs before."""
    refs = spark.range(2000).selectExpr("id as ref", "if(id % 2 = 0, 's', 't') as scope")
    above = spark.createDataFrame([("s", "s", 0), ("s", "m", 1), ("t", "t", 0)], "scope string, ancestor string, depth int")
    owned = spark.range(4000).selectExpr("case id % 3 when 0 then 's' when 1 then 'm' else 't' end as scope", "concat('d', id) as def", "if(id % 3 = 1 and id > 100, 'Function', 'Class') as label", "4000 - id as pos")
    most, rows = most_rows(resolution.enclosing(refs, above, owned))
    assert {(r.ref % 2, r["def"]) for r in rows} == {(0, "d3997"), (1, "d3998")} and len(rows) == 2000
    assert most <= 4000


def test_scope_chain_does_not_meet_references_with_all_bindings_of_a_name(spark):
    refs = spark.range(2000).selectExpr("id as ref", "'s' as scope", "if(id % 2 = 0, 'a', 'b') as name")
    above = spark.createDataFrame([("s", "s", 0), ("s", "m", 1)], "scope string, ancestor string, depth int")
    bound = spark.range(2000).selectExpr("'m' as scope", "'a' as name", "id as def").union(spark.range(1).selectExpr("'m'", "'b'", "id + 7"))
    most, rows = most_rows(resolution.scope_chain(refs, above, bound))
    assert {(r.ref % 2, r["def"], r.status) for r in rows} == {(0, None, "ambiguous"), (1, 7, "found")} and len(rows) == 2000
    assert most <= 8000


def test_folders_are_spread_only_for_the_steps_that_won(spark):
    """1,500 imports of a folder of 1,500 files: the 2.25 million pairs were shuffled twice, 20 MB and more, and dealt out by folder."""
    files = spark.range(1500).selectExpr("concat('code/org/p/C', id, '.java') as filePath", "'java' as language")
    asked = spark.range(1500).selectExpr("id as import", "'java' as language", "'M.java' as source", "'org/p' as target", "true as wildcard")
    moved, n = shuffled_mb(spark, lambda: imports.targets(asked, files).count())
    assert n == 2_250_000 and moved < 1


def test_large_folders_are_dealt_out_in_slices(spark, monkeypatch):
    monkeypatch.setattr(imports, "TASK_PAIRS", 100)
    files = spark.range(60).selectExpr("concat('x/p', id % 2, '/C', id, '.java') as filePath", "'java' as language")
    files = files.union(files.limit(3))
    asked = spark.range(90).selectExpr("id as import", "'java' as language", "'M.java' as source", "concat('p', id % 3) as target", "true as wildcard")
    asked = asked.union(spark.createDataFrame([(0, "java", "M.java", "x/p0", True), (0, "java", "M.java", "p1", True)], asked.schema))
    got = sorted((r["import"], r.filePath) for r in imports.targets(asked, files).collect())
    own = lambda p: [f"x/p{p}/C{i}.java" for i in range(60) if i % 2 == p]
    assert got == sorted((i, f) for i in range(90) for p in ((0, 1) if i == 0 else (i % 3,)) if p < 2 for f in own(p))


def plain_overrides(parents, methods):
    """The rule in words: every ancestor by its least number of steps, then all definitions of a name that the class lacks."""
    up, out = {}, set()
    for c, p, _ in parents:
        up.setdefault(c, set()).add(p)
    for c in up:
        depth, level, d = {}, {c}, 0
        while level:
            d += 1
            level = {p for x in level for p in up.get(x, ())} - set(depth)
            depth |= dict.fromkeys(level, d)
        own, seen = {n for o, n, _ in methods if o == c}, {}
        for o, n, m in methods:
            if o in depth and o != c and n not in own:
                seen.setdefault(n, []).append((depth[o], o, m))
        out |= {(c, n, min(v)[2]) for n, v in seen.items() if len({m for _, _, m in v}) > 1}
    return out


def test_overrides_equal_the_rule_with_circles_diamonds_and_shared_methods(spark):
    rnd = random.Random(3)
    for circles in (False, True):
        parents = sorted({(f"c{a}", f"c{rnd.randrange(40) if circles and a % 9 == 0 else rnd.randrange(a)}", "EXTENDS") for a in range(1, 40) for _ in range(2)})
        methods = sorted({(f"c{rnd.randrange(40)}", f"n{rnd.randrange(4)}", f"m{rnd.randrange(25)}") for _ in range(70)})
        p = spark.createDataFrame(parents, "child string, parent string, type string")
        got = [(r["class"], r["name"], r.method) for r in resolution.overrides(resolution.ancestors(p), spark.createDataFrame(methods, "owner string, name string, method string")).collect()]
        want = plain_overrides(parents, methods)
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_overrides_hand_on_names_and_not_all_definitions_of_all_ancestors(spark):
    """A chain of 12 classes below 4 with 1,000 names each: 48,000 pairs of class and definition before."""
    p = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}", "EXTENDS") for i in range(15)], "child string, parent string, type string")
    m = spark.range(16 * 1000).selectExpr("concat('c', lpad(id % 16, 2, '0')) as owner", "concat('n', id div 16) as name", "concat('m', id) as method").filter("owner > 'c11'")
    above = committed(resolution.ancestors(p), "above")
    most, rows = most_rows(resolution.overrides(above, m))
    assert len(rows) == 12 * 1000 and most <= 20_000


def test_variables_meet_lines_and_not_all_calls_of_a_line(spark):
    """1,000 variables and 1,000 calls on one line: a million pairs before."""
    v = spark.range(1000).selectExpr("id as def", "'f' as filePath", "7L as startLine", "if(id = 3, 8L, 7L) as endLine").union(spark.createDataFrame([(5000, "f", 9, 9)], "def long, filePath string, startLine long, endLine long"))
    calls = spark.range(1000).selectExpr("id as ref", "'f' as filePath", "7L as line", "'free' as form").union(spark.createDataFrame([(2000, "f", 9, "constructor")], "ref long, filePath string, line long, form string"))
    resolved, defs = spark.createDataFrame([(2000, 1)], "ref long, def long"), spark.createDataFrame([(1, "C", "int")], "id long, name string, returnType string")
    most, rows = most_rows(imports.call_types(v, calls, resolved, defs))
    assert [tuple(r) for r in rows] == [(5000, "C")] and most <= 5000


def test_scopes_of_the_same_lines_are_spread_once(spark):
    """2,000 scopes over the same 30 lines: 56,000 rows of scope and line, and each compared with each position, before."""
    scopes = spark.range(2000).selectExpr("concat('s', lpad(id, 4, '0')) as id", "'f' as filePath", "1 as startLine", "2 as startCol", "30 as endLine", "4 as endCol")
    odd = [("one", "f", 31, 3, 31, 5), ("back", "f", 40, 0, 33, 9), ("late", "f", 30, 6, 32, 1)]
    at = [(1, 1), (1, 2), (9, 0), (30, 4), (30, 5), (30, 6), (31, 4), (32, 1), (32, 2), (33, 3), (40, 1)]
    places = spark.createDataFrame([("f", a, b) for a, b in at], "filePath string, line int, col int")
    most, rows = most_rows(structure.scope_at(places, scopes.union(spark.createDataFrame(odd, scopes.schema))))
    got = {(r.line, r.col): r.scope for r in rows}
    assert [got[x] for x in at] == [None, "s1999", "s1999", "s1999", None, "late", "one", "late", None, None, None]
    assert most <= 4100


def test_what_follows_a_heading_is_kept_while_reading_from_the_end(spark):
    """Frames from a row to the file's end are read anew for every row: a square of the headings."""
    rnd = random.Random(1)
    rows = [(f, i, rnd.randrange(1, 7), f"h{i}", 400) for f in ("a", "b") for i in range(1, 400, 3)]
    out = structure.nested_sections(spark.createDataFrame(rows, "filePath string, line long, level int, name string, total int"))
    got = {(r.filePath, r.line): (r.endLine, r.parent) for r in out.collect()}
    for f, line, level, _, total in rows:
        after = [x[1] for x in rows if x[0] == f and x[1] > line and x[2] <= level]
        above = [x for x in rows if x[0] == f and x[1] < line and x[2] < level]
        assert got[f, line] == (min(after) - 1 if after else total, f"Section:{f}:L{above[-1][1]}:{above[-1][3]}" if above else f"File:{f}")
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()


def test_definitions_of_a_key_are_told_apart_before_references(spark):
    """1,000 references and 1,000 definitions of one key: a million pairs before."""
    refs = spark.range(1002).selectExpr("id as ref", "if(id < 1000, 'a', if(id = 1000, 'b', 'c')) as k")
    defs = spark.range(1001).selectExpr("id as def", "if(id < 1000, 'a', 'b') as k")
    most, rows = most_rows(resolution.unique_by_key(refs, defs, "ref", "def", ["k"]))
    assert [tuple(r) for r in rows] == [(1000, 1000)] and most <= 1002


def test_symbols_of_unchanged_files_are_not_spread_over_ends_of_paths(spark):
    """3,000 symbols five folders deep were 15,000 rows, dealt out by ends that most files share."""
    n = spark.range(3000).selectExpr("concat('n', id) as id", "concat('a/b/c/d/f', id % 3, '.ts') as filePath", "id % 50 + 1 as startLine", "id % 50 + 2 as endLine")
    hunks = spark.createDataFrame([("c/d/f1.ts", 10, 11), ("d/f1.ts", 11, 12), ("b/f2.ts", 1, 90)], "filePath string, startLine int, endLine int")
    most, rows = most_rows(text.changed_symbols(n, hunks))
    assert sorted(r.id for r in rows) == sorted(f"n{i}" for i in range(3000) if i % 3 == 1 and i % 50 + 1 <= 12 and i % 50 + 2 >= 10)
    assert most <= 3000


def test_a_file_gives_wildcards_no_more_than_a_scope_may_have(spark):
    """100 scopes that import a file of 1,000 names each: 100,000 rows were sorted for five of each scope."""
    defs = spark.range(2000).selectExpr("if(id < 1000, 'g', 'f') as filePath", "concat('n', lpad(id, 4, '0')) as name", "id", "'Function' as label")
    asked = spark.range(100).selectExpr("'x' as filePath", "concat('s', id) as scope", "'g' as target").union(spark.createDataFrame([("x", "s0", "f")], "filePath string, scope string, target string"))
    most, rows = most_rows(imports.wildcards(asked, defs, 5))
    assert {(r.scope, r["def"]) for r in rows} == {(f"s{i}", 1000 + j if i == 0 else j) for i in range(100) for j in range(5)}
    assert most <= 2000


def test_impact_shuffles_only_edges_that_may_meet_the_level(spark):
    """All 60,000 edges were shuffled at each level, with four texts more for their order: 6.3 MB."""
    n, e = large_graph(spark)
    with no_small_tables(spark):
        moved, rows = shuffled_mb(spark, lambda: impact.impact(n, e, "Function:f1", impact.Options(max_depth=2)).collect())
    assert {r.id for r in rows if r.depth == 1} == {f"Function:f{i + 5}" for i in range(20) if i % 4 == 1}
    callers = {r.sourceId for r in e.collect() if r.targetId in {x.id for x in rows if x.depth == 1}}
    assert {r.id for r in rows if r.depth == 2} == callers - {x.id for x in rows if x.depth == 1} - {"Function:f1"}
    assert moved < 0.5


def test_removal_shuffles_only_what_may_be_gone(spark):
    n, e = large_graph(spark)
    gone = spark.createDataFrame([("Function:f1",), ("Function:f2",), ("Function:f11",)], "id string")
    with no_small_tables(spark):
        moved, (a, b) = shuffled_mb(spark, lambda: [sorted(r.id for r in x.collect()) for x in store.without_nodes(n, e, gone)])
    out = {"Function:f1", "Function:f2", "Function:f11"}
    assert a == sorted(r.id for r in n.collect() if r.id not in out)
    assert b == sorted(r.id for r in e.collect() if not {r.sourceId, r.targetId} & out)
    assert moved < 0.5


def test_links_of_communities_do_not_depend_on_the_size_of_the_graph(spark):
    """Beyond 10,000 symbols links of low confidence and symbols of one link were left out."""
    n, e = large_graph(spark)
    e = e.withColumn("confidence", F.when(F.col("id") == "rel:100001", 0.1).otherwise(F.col("confidence")))
    got = {(r.a, r.b) for r in clusters.projection(n, e).collect()}
    assert got == {tuple(sorted((r.sourceId, r.targetId))) for r in e.collect() if r.sourceId != r.targetId}


def test_projection_tells_links_apart_once(spark):
    """5.4 MB when links were told apart by both ends and made twice, to count loose ends."""
    n, e = large_graph(spark)
    with no_small_tables(spark):
        moved, count = shuffled_mb(spark, lambda: clusters.projection(n, e, large=True).count())
    assert count > 50_000 and moved < 4.5


def test_references_of_few_symbols_shuffle_no_other_edges(spark):
    n, e = large_graph(spark)
    with no_small_tables(spark, "20000"):
        moved, rows = shuffled_mb(spark, lambda: lookup.grouped_references(lookup.references(n, e, n.filter("id in ('Function:f1', 'Function:f2')"))).collect())
    assert {(r.id, r.direction, len(r.refs)) for r in rows} >= {("Function:f1", "incoming", 5), ("Function:f2", "incoming", 5)}
    assert moved < 0.1

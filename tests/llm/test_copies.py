"""SimHash, repeated passages and the epsilon grid join against brute force, and their odd rows."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from compare import duck, of_spark, of_sql

from graphloom.llm import common, egojoin, queries, simhash, substring
from graphloom.llm.components import components

SF = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, fp long, starts string, copy int"


def sets(n, links):
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("most_group", [1 << 17, 2])
def test_simhash_equals_brute_force(spark, most_group):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, plain_fingerprint(r.text)) for r in docs.collect())
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2]
    root = sets(len(rows), near)
    want = {d: (f"{f:016x}", rows[root[i]][0]) for i, (d, f) in enumerate(rows)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, most_group=most_group).collect()} == want


def test_gray_index_finds_all_pairs_in_a_dense_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3000, 2)).astype(np.uint64)
    fps = np.unique(base[rng.integers(0, 6, 3000)] ^ flips[:, 0] ^ flips[:, 1])
    index = simhash.GrayIndex(fps)
    q, node = index.within(index.fps, 2)
    want = np.bitwise_count(index.fps[:, None] ^ index.fps[None, :]) <= 2
    got = np.zeros_like(want)
    got[q, node] = True
    assert (got == want).all()


def test_simhash_links_across_thirds_and_divided_groups(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    for i in range(0, 64, 3):
        for j in range(i, 64, 7):
            fps.add(base ^ 1 << i ^ 1 << j)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    root = sets(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for most in (1 << 17, 5):
        found = {r.id: r.component for r in components(simhash.links(df, most)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == root


def test_simhash_odd_rows(spark):
    long = "word " * 100_000
    rows = [(5, None), (3, ""), (4, " \t\n"), (7, "A b C"), (6, "a B c"), (6, "a b c"), (None, "a b c"), (8, long), (9, long + "x"), (6, "other words here now")]
    df = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in rows], TEXT)
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert len(found) == len(rows)
    assert {f for f in found if f[0] in (3, 4, 5)} == {(3, "0" * 16, 3), (4, "0" * 16, 3), (5, "0" * 16, 3)}
    assert {f[2] for f in found if f[0] in (6, 7)} == {6} and {f[2] for f in found if f[0] is None} == {None}
    assert {f[2] for f in found if f[0] in (8, 9)} == {8}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [3, 6, 6, 6, 8]
    assert simhash.near_duplicates(df.filter("false")).count() == 0


def jaccard_pairs(texts, least=0.8):
    words = [(t or "").encode().lower().split() for t in texts]
    sets_of = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets_of[i] & sets_of[j]) >= least * len(sets_of[i] | sets_of[j])}


def edited_texts(n=60):
    """Random texts, each with a copy of one word replaced in every fifty or so."""
    rng = np.random.default_rng(11)
    texts = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        copy = list(words)
        for at in rng.choice(len(copy), max(len(copy) // 60, 1), replace=False):
            copy[at] = "changed"
        texts += [" ".join(words), " ".join(copy)]
    return texts


def test_near_copies_find_jaccard_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for rows in (sorted((r.doc_id, r.text) for r in docs.collect()), list(enumerate(edited_texts()))):
        ids, texts = [d for d, _ in rows], [t for _, t in rows]
        near = jaccard_pairs(texts)
        df = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in rows], TEXT)
        found = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
        root = sets(len(rows), near)
        joined = sum(found[ids[i]] == found[ids[j]] for i, j in near)
        assert near and joined >= 0.97 * len(near)
        assert all(ids[root[i]] == ids[root[ids.index(c)]] for i, c in enumerate(found[d] for d in ids))  # no wrong link
    old = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sum(old[i] == old[j] for i, j in near) < 0.5 * len(near)  # the digest's radius misses most


def chained_texts():
    """A family whose copies each change other words, so that many pairs are near without linking, and two more families."""
    rng = np.random.default_rng(13)
    texts = []
    for n in (60, 25, 4):
        base = [f"w{x}" for x in rng.integers(0, 9000, 120)]
        texts.append(" ".join(base))
        for i in range(n):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(1, 3)), replace=False):
                copy[at] = f"c{i}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("most_group", [simhash.COPY_GROUP, 5])
def test_near_copies_in_large_groups(spark, most_group):
    texts = chained_texts()
    root = sets(len(texts), jaccard_pairs(texts))
    df = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in enumerate(texts)], TEXT)
    found = {r.doc_id: r.component_id for r in simhash.near_copies(df, most_group=most_group).collect()}
    assert [found[i] for i in range(len(texts))] == root


def test_part_counts_never_rule_out_a_link():
    texts = edited_texts(30) + chained_texts()[:40]
    found = [simhash.shingles(t) for t in texts]
    counts = [simhash.part_counts(x) for x in found]
    near = jaccard_pairs(texts)
    passed = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if simhash.may_reach(counts[i], counts[j], 0.8)}
    assert near <= passed and simhash.may_reach(simhash.part_counts(set()), simhash.part_counts(set()), 0.8)
    unlike = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(found[i] & found[j]) < 0.6 * len(found[i] | found[j])]
    assert sum(p in passed for p in unlike) < 0.05 * len(unlike)


def test_spanning_forest_is_least():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, (2, 300))
    a, b, apart = a[a < b], b[a < b], rng.integers(0, 9, 300)[a < b]
    chosen = simhash.spanning(a, b, apart, np.arange(40))
    parent, want = list(range(40)), 0
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i in np.lexsort((b, a, apart)):
        if root(a[i]) != root(b[i]):
            parent[root(a[i])] = root(b[i])
            want += apart[i]
    assert apart[chosen].sum() == want and sets(40, zip(a[chosen], b[chosen])) == sets(40, zip(a, b))


def test_near_copies_odd_rows(spark):
    rows = [(5, None), (3, ""), (7, "A b C"), (6, "a B c"), (None, "a b c"), (8, "a b d"), (9, "one two three four five six"), (9, "other")]
    df = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in rows], TEXT)
    assert {(r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()} == {(3, 3), (5, 3), (6, 6), (7, 6), (8, 8), (9, 9)}
    kept = simhash.keep_one(df, shingle=5, similarity=0.8)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [3, 6, 8, 9, 9]
    assert simhash.near_copies(df.filter("false")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 700)] + [(900, i) for i in range(901, 1000)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links + [(1, None), (7, 7)], "a long, b long")).collect()}
    root = sets(1000, links)
    assert all(found.get(i, i) == root[i] for i in range(1000))


def plain_repeats(rows, window=50):
    docs = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in rows]
    first, out = {}, []
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [1, 5, 12, 50])
def test_repeats_equal_brute_force(spark, window):
    rng = np.random.default_rng(window)
    words = [f"w{i}" for i in range(30 if window < 20 else 400)]
    passages = [[words[i] for i in rng.integers(0, len(words), window + int(extra))] for extra in rng.integers(-3, 40, 12) if window + extra > 0]
    rows = []
    for d in range(60):
        text = [words[i] for i in rng.integers(0, len(words), int(rng.integers(0, 3 * window)))]
        for p in rng.choice(len(passages), 2):
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = passages[p]
        rows.append((int(d * 3 % 61), " ".join(text)))
    rows += [(100, rows[5][1]), (101, rows[5][1] + " tail"), (102, None), (103, "")]
    df = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in rows], TEXT)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_passages(df, window=window, broadcast_rows=0).collect()}
    want = plain_repeats(rows, window)
    assert got == {w[0]: w[1:4] for w in want}
    cut = {r.doc_id: r.text for r in substring.without_repeats(df, window).collect()}
    texts = dict(rows)
    assert cut == {w[0]: (w[4] if w[2] else texts[w[0]]) for w in want}


def test_repeats_odd_rows(spark):
    p = " ".join(f"x{i}" for i in range(60))
    rows = [(2, p), (2, p), (2, p + " y"), (None, p), (3, "a " + p), (1, None), (4, p * 3000)]
    df = spark.createDataFrame([(d, t, 1, "s", 2) for d, t in rows], TEXT)
    found = [(r.doc_id, r.n_removed) for r in substring.repeated_passages(df).collect()]
    assert sorted(found, key=str)[:5] == [(1, 0), (2, 0), (2, 0), (2, 0), (3, 60)] and len(found) == 7 and (None, 0) in found
    out = substring.without_repeats(df)
    assert out.columns == df.columns and out.count() == 7
    assert substring.repeated_passages(df.filter("false")).count() == 0


def test_repeats_and_vectors_equal_their_sql(spark):
    con = duck(SF)
    for name, sql in queries.oracle_sql().items():
        assert of_spark((queries.queries() | queries.further_queries())[name](spark, SF)) == of_sql(con, sql), name


@pytest.mark.parametrize("options", [{}, {"block_rows": 50, "leaf": 8}, {"block_rows": 7, "leaf": 3, "grid_dims": 2}])
def test_vectors_equal_brute_force(spark, options):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 24))
    x = np.concatenate([centre[rng.integers(0, 20, 300)] + rng.normal(size=(300, 24)) * 0.25, rng.normal(size=(150, 24))])
    x[5] = x[6] = x[300]
    x[7] = 3 * x[6]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = sets(len(x), np.argwhere(near).tolist())
    df = spark.createDataFrame([(i, v.tolist(), 1, "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, links int, digest string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in egojoin.near_duplicates(df, **options).collect()}
    assert got == {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))}


def test_vectors_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [-0.0, 1.0]), (9, [0.0, 1.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1e300, 1e300]), (12, [1e-300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in egojoin.near_duplicates(df).collect()]
    assert len(found) == len(rows)
    assert {f for f in found if f[0] in (1, 2, 3, 4, 5, 6, 10)} == {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)}
    assert {f[2] for f in found if f[0] in (7, 8, 9)} == {7} and (11, 1, 11, True) in found and (12, 1, 11, False) in found
    assert egojoin.near_duplicates(df.filter("false")).count() == 0 and egojoin.near_duplicates(df.filter("vec_id = 1")).count() == 1


def test_passages_are_cut_whatever_the_columns_are_called(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a " + passage, 5, "x", "y"), (2, passage + " z", 5, "x", "y"), (3, None, 5, None, "y"), (4, passage + " z", 5, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __d1 int, __kept string, __ID string")
    got = substring.without_repeats(df)
    assert got.columns == df.columns and {(r.doc_id, r.text, r["__d1"]) for r in got.collect()} == {(1, "a " + passage, 5), (2, "z", 5), (3, None, 5), (4, "", 5)}


def shuffled_mb(spark, after):
    """MB that stages after that one have written to shuffles, and the last stage."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    own = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in own if s.stageId() > after) / 1e6, max((s.stageId() for s in own), default=-1)


def test_texts_without_repeats_are_not_shuffled_and_work_tables_go(spark, tmp_path):
    rng = np.random.default_rng(4)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [" ".join(rng.bytes(40).hex() for _ in range(100)) for _ in range(500)]
    rows = [(i, t + " " + shared if i % 100 == 7 else t) for i, t in enumerate(texts)] + [(None, shared + " n"), (507, shared)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs, (before, held) = spark.read.parquet(f"{tmp_path}/docs"), ("spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    root = Path(common.work_root(spark).removeprefix("file://"))
    was = set(root.glob("*"))
    spark.conf.set(before, "-1")  # small tables are joined as large ones are
    try:
        _, last = shuffled_mb(spark, -1)
        got = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
        moved, _ = shuffled_mb(spark, last)
    finally:
        spark.conf.set(before, held)
    want = {i: texts[i] if i and i > 7 and i < 500 else t for i, t in rows}
    assert got == want | {507: ""}
    whole = sum(len(t) for t in texts) / 1e6
    assert moved < whole / 3, (moved, whole)
    left = {p.name.rsplit("-", 1)[0] for p in set(root.glob("*")) - was}
    assert left <= {"whole-passages", "whole-copies", "passages-cut"}

"""The pipeline's stages on a small folder of tables, each against a plain version of its decision."""

import random

import pytest

import corpus_pipeline
from graphloom.llm import langid, substring, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 300")
    words = sorted({w for r in base.filter("lang = 'en' and doc_id < 60").collect() for w in r.text.split() if w.isalpha() and w.islower()})
    deal = random.Random(1)
    passage = " ".join(deal.sample(words, 70)) + " marker " + " ".join(deal.sample(words, 70))
    own = [" ".join(deal.sample(words, 250)) for _ in range(2)]
    extra = [(1000, "!!! 123 ???", "en", "s", 11), (1001, "an idiot and a moron, pathetic scum " * 8, "en", "s", 1), (1002, None, None, None, None), (1003, own[0] + " " + passage, "en", "s", 2), (1004, own[1] + " " + passage, "en", "s", 2)]
    base.union(spark.createDataFrame(extra, base.schema)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return str(at)


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_every_stage_takes_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_every_stage_begins_with_heaps_given_back(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName())
    for name, stage in corpus_pipeline.STAGES:
        before = whole()
        stage(spark, docs, folder)
        assert whole() > before, name


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "simhash", "substring", "packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    scored = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert ids(clean) == sorted(d for d, p in scored.items() if not p) and 1001 not in ids(clean)
    clean = clean.cache()
    known = corpus_pipeline.keep_languages(spark, clean, folder).cache()
    assert set(ids(clean)) - set(ids(known)) >= {1000, 1002}
    found = {r.doc_id: r for r in langid.identify(clean, langid.learn(clean)).collect()}
    assert ids(known) == sorted(d for d, r in found.items() if r.lang_pred != "und" and r.score >= 0.18 * r.letters / (r.letters + 100))
    single = corpus_pipeline.drop_near_copies(spark, known, folder).cache()
    rows = sorted((r.doc_id, r.text) for r in known.collect())
    root = list(range(len(rows)))  # brute force: shingles of five words, Jaccard similarity of 0.8
    find = lambda i: i if root[i] == i else find(root[i])
    shingles = [plain_shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids(single) == sorted({rows[find(i)][0] for i in range(len(rows))})
    cut = corpus_pipeline.cut_repeats(spark, single, folder).cache()
    removed = {r.doc_id: r.n_removed for r in substring.repeated_passages(single).collect()}
    assert ids(cut) == ids(single) and cut.columns == docs.columns == single.columns == known.columns == clean.columns
    before = {r.doc_id: r.text for r in single.collect()}
    for r in cut.collect():
        assert len(r.text.split()) <= len(before[r.doc_id].split()) and (removed[r.doc_id] > 0) == (r.text != before[r.doc_id])
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert "marker" in texts[1003] and "marker" not in texts[1004]
    packed = corpus_pipeline.pack_sequences(spark, cut, folder)
    assert {r.doc_id for r in packed.collect()} == set(ids(cut))
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted(whole.drop_duplicates(["doc_id", "start"]).doc_id) == sorted(whole.doc_id) and set(whole.doc_id) == set(ids(cut))

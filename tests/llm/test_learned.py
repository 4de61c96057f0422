"""Language, toxicity and LM scores: held-out accuracy, plain versions, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import langid, lmscore, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "en", 5), (2, "", None, 5), (3, "1234 !!", "en", 5), (4, "the and of " * 30_000, "en", 5), (4, "the and of", "de", 5), (None, "la de que", "es", 5), (5, "日本語" * 10, None, 5)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, score int")


def test_language_held_out_and_blind_to_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.learn(docs)
    found = langid.identify(docs.select("doc_id", "text"), profiles).join(docs.select("doc_id", "lang"), "doc_id").filter(~langid.in_training())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_language_matches_plain_vectors(spark):
    texts = ["Hello, World", "naïve café", "x", "ab " * 200_000]
    made, letters = langid.bundle(texts)
    v = langid.GramVectors()
    for t, row in zip(texts, made):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        codes = [0] + [ord(c) for c in " ".join(s.split())] + [0]
        codes = [0 if c == 32 else c for c in codes]
        want = np.zeros(langid.DIM)
        counts = {}
        for i in range(len(codes) - 2):
            counts[tuple(codes[i : i + 3])] = counts.get(tuple(codes[i : i + 3]), 0) + 1
        for (a, b, c), n in counts.items():
            want += float(n) * np.roll(v.of_letter(a), 2) * np.roll(v.of_letter(b), 1) * v.of_letter(c)
        assert np.allclose(row, want)
    assert letters.tolist() == [10, 9, 1, 400_000]


def test_language_odd_rows(spark):
    df = odd(spark)
    found = langid.identify(df, langid.learn(df)).collect()
    assert len(found) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred != "und" for r in found if r.doc_id == 4)
    nothing = langid.learn(df.filter("false"))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    kept = langid.keep_identified(df, langid.learn(df))
    assert sorted((r.doc_id or 0, r.text[:4]) for r in kept.collect()) == [(4, "the "), (4, "the ")]  # what was learned is like no other row
    assert langid.identify(df.filter("false"), nothing).count() == 0 and langid.keep_identified(df, nothing).count() == 0


def test_language_query_equals_plain_vectors(spark):
    """lang_pred and score by dictionaries of n-grams over the same letters' vectors; ties go to the first language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 250")
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    v = langid.GramVectors()

    def vector(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        codes = [0, *[0 if c == " " else ord(c) for c in " ".join(letters)], 0]
        out, seen = np.zeros(langid.DIM), {}
        for i in range(len(codes) - 2):
            key = tuple(codes[i : i + 3])
            seen[key] = seen.get(key, 0) + 1
        for (a, b, c), n in seen.items() if letters else ():
            out += float(n) * np.roll(v.of_letter(a), 2) * np.roll(v.of_letter(b), 1) * v.of_letter(c)
        return out / max(np.linalg.norm(out), 1e-30)

    import zlib

    vectors = {k: vector(t) for k, (t, _) in texts.items()}
    sums = {}
    for k, (t, lang) in texts.items():
        if lang and t is not None and zlib.crc32(str(k).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + vectors[k]
    langs = sorted(sums)
    found = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), langid.learn(docs)).collect()}
    for k in texts:
        cos = [float(vectors[k] @ sums[x] / np.linalg.norm(sums[x])) for x in langs]
        has = any(c.isalpha() for c in texts[k][0] or "")
        assert found[k].lang_pred == (langs[int(np.argmax(cos))] if has else "und") or max(cos) - sorted(cos)[-2] < 1e-4
        assert abs(found[k].score - (max(max(cos), 0) if has else 0)) < 1e-4
    tie = langid.Profiles(["aa", "bb"], np.stack([sums[langs[0]] / np.linalg.norm(sums[langs[0]])] * 2).astype(np.float32))
    assert {r[0] for r in tie.compare(["the and of", "x"])} == {"aa"}


def test_language_learns_rare_languages(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(4000)] + [(i, "日本語の文章です", "ja") for i in range(4000, 4004)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert df.filter(langid.in_training()).filter("lang = 'ja'").count() > 0
    assert langid.learn(df, rows=100).langs == ["en", "ja"]


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels)
    found = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(~langid.in_training()).toPandas()
    assert (found.predicted == found.toxic).mean() > 0.95
    assert found.predicted[found.toxic == 1].mean() > 0.8 and found.predicted[found.toxic == 0].mean() < 0.03
    seen, unseen = model.word_odds(["idiot"])[0], model.word_odds(["idiooot"])[0]
    assert seen > 50 and unseen > 20  # a misspelling shares n-grams


def test_toxicity_odd_rows(spark):
    df = odd(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for model in (toxicity.learn(df, labels), toxicity.learn(df, labels.filter("false")), toxicity.train(["a b", "c d"], [1, 1])):
        found = toxicity.score(df, model).collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    model = toxicity.train(["idiot the", "the of"] * 20, [1, 0] * 20)
    kept = toxicity.keep_clean(df.union(spark.createDataFrame([(8, "idiot idiot", "en", 1)], df.schema)), model)
    assert kept.columns == df.columns and kept.filter("doc_id = 8").count() == 0 and kept.count() == len(ODD)


def test_toxicity_scores_equal_a_plain_sum(spark):
    """Scores are the logistic of the mean over words of the mean over subwords, computed one by one; ties and repeats score alike."""
    model = toxicity.train(["idiot the of", "the of and"] * 20, [1, 0] * 20)
    texts = ["", None, "idiot", "the idiot of idiots", "and and and", "The IDIOT!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, "idiot")], "doc_id long, text string")
    found = [(r.doc_id, r.score, r.predicted) for r in toxicity.score(df, model).collect()]
    for i, t in enumerate(texts):
        words, odds = (t or "").lower().split(), []
        for w in words:
            whose, bucket = toxicity.subwords([w])
            odds.append(float(np.mean([model.bucket_odds[b] for b in bucket])))
        want = 1 / (1 + np.exp(-(sum(odds) / max(len(words), 1) + model.constant)))
        for _, score, predicted in [f for f in found if f[0] == i]:
            assert abs(score - want) < 1e-6 and predicted == (score >= 0.5)
    assert len(found) == 7 and toxicity.score(df.filter("false"), model).count() == 0


def plain_losses(background, target, texts):
    """Bigram models by dictionaries: every word and every pair counts."""

    def words(t):
        return ["<e>", *[w.decode() for w in (t or "").encode().lower().split()], "<e>"]

    def counted(docs):
        one, two = {}, {}
        for d in docs:
            x = words(d)
            for a, b in zip(x, x[1:]):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
        return one, two

    tables = [counted(target), counted(background)]
    size = len(set(tables[0][0]) | set(tables[1][0])) + 1
    out = []
    for t in texts:
        x, means = words(t), []
        for one, two in tables:
            n = sum(one.values())
            alone = lambda w, one=one, n=n: (one.get(w, 0) + 0.5) / (n + 0.5 * size)
            means.append(float(np.mean([-np.log((two.get((a, b), 0) + 8 * alone(b)) / (one.get(a, 0) + 8)) for a, b in zip(x, x[1:])])))
        out.append(means)
    return out


def test_cross_entropy_difference_matches_a_plain_version(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows, target = docs.select("doc_id", "text").collect(), [r.text for r in bench.collect()]
    other = spark.createDataFrame([(1, "words that no table has"), (2, rows[0].text), (2, None)], "doc_id long, text string")
    want = plain_losses([r.text for r in rows], target, [r.text for r in rows])
    for chunk, chars in ((lmscore.CHUNK_TOKENS, lmscore.BUCKET_CHARS), (500, 10_000)):  # one chunk and bucket, and many
        monkeypatch.setattr(lmscore, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(lmscore, "BUCKET_CHARS", chars)
        models = lmscore.fit(docs, bench)
        for df, texts, losses in ((docs, rows, want), (other, other.collect(), plain_losses([r.text for r in rows], target, [r.text for r in other.collect()]))):
            found = sorted((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lmscore.score(df, models).collect())
            plain = sorted((r.doc_id, len((r.text or "").encode().split()) + 1, t, b, t - b) for r, (t, b) in zip(texts, losses))
            assert len(found) == len(plain) and all(f[:2] == p[:2] and np.allclose(f[2:], p[2:], rtol=0, atol=1e-9) for f, p in zip(found, plain))


def test_rare_words_and_pairs_count_at_any_size(spark):
    """A pair that one text of very many has is held: the same words turned around are less likely."""
    rows = [(i, "the same old line of words") for i in range(20_000)] + [(20_000, "quaint zephyr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = lmscore.fit(docs, docs.filter("doc_id < 3"))
    asked = spark.createDataFrame([(1, "quaint zephyr"), (2, "zephyr quaint"), (3, "never seen")], "doc_id long, text string")
    found = {r.doc_id: r for r in lmscore.score(asked, models).collect()}
    assert found[1].background_loss + 0.05 < found[2].background_loss < found[3].background_loss
    assert abs(found[1].target_loss - found[2].target_loss) < 1e-9


def test_cross_entropy_odd_rows(spark):
    df = odd(spark)
    for target in (df, df.filter("false")):
        models = lmscore.fit(df, target)
        found = lmscore.score(df, models).collect()
        assert len(found) == len(ODD) and all(np.isfinite([r.target_loss, r.background_loss]).all() for r in found)
        assert {r.n_tokens for r in found if r.doc_id in (1, 2)} == {1}
    assert lmscore.score(df.filter("false"), models).count() == 0

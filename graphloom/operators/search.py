"""Keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Constants of the keyword score (the usual ones), and of reciprocal rank fusion.
K1, B, FUSION = 1.2, 0.75, 60


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def _equals(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, score) of every document with a word of the query. One pass over the texts keeps each document's length and
    its counts of the query's words only; nothing of the other words is shuffled."""
    words = sorted(set(query.lower().split()))
    own = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    counts = own.select("id", F.size("w").alias("n"), *[F.size(F.filter("w", _equals(q))).alias(f"t{i}") for i, q in enumerate(words)])
    total = counts.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(words))])
    both = counts.join(F.broadcast(total))  # one row of totals
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"t{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    found = F.lit(False)
    for i in range(len(words)):
        found = found | (F.col(f"t{i}") > 0)
    return both.filter(found).select("id", score.alias("score"))


def summed_by_file(scored: DataFrame, limit: int) -> DataFrame:
    """(filePath, score): the best `limit` rows of each index (label), summed by file."""
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= limit)
    return top.groupBy("filePath").agg(F.sum("score").alias("score"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], limit: int | None, most: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance) by cosine, exact, closest first (all, in no order, without a limit); vectors without a length are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    d = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("n", F.sqrt(_dot(F.col("v"), F.col("v")))).filter("n > 0")
    d = d.select("id", (1 - _dot(F.col("v"), q) / (F.col("n") * norm)).alias("distance"))
    if most is not None:
        d = d.filter(F.col("distance") < most)
    return d if limit is None else d.orderBy("distance", "id").limit(limit)


def ranked(found: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows with their rank: limited first, so that only those are numbered in one place."""
    return found.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_chunks(found: DataFrame, limit: int | None = None) -> DataFrame:
    """The closest chunk of each node: (nodeId, chunkIndex, distance)."""
    best = found.groupBy("nodeId").agg(F.min(F.struct("distance", "chunkIndex")).alias("b")).select("nodeId", F.col("b.chunkIndex").alias("chunkIndex"), F.col("b.distance").alias("distance"))
    return best if limit is None else best.orderBy("distance", "nodeId").limit(limit)


def fused(keyword: DataFrame, semantic: DataFrame, limit: int = 10) -> DataFrame:
    """(filePath, score, bm25, semantic, sources, rank): reciprocal ranks summed by file. Of a file's keyword ranks
    the last counts, as each overwrites the one before; all of its semantic ranks do."""
    k = keyword.groupBy("filePath").agg(F.max(F.struct("rank", "score")).alias("k"))
    s = semantic.groupBy("filePath").agg(F.sum(1 / (FUSION + F.col("rank"))).alias("s"), F.max("score").alias("semantic"))
    both = k.join(s, "filePath", "full")
    total = F.coalesce(1 / (FUSION + F.col("k.rank")), F.lit(0.0)) + F.coalesce("s", F.lit(0.0))
    out = both.select("filePath", total.alias("score"), F.col("k.score").alias("bm25"), "semantic", F.concat_ws("+", F.when(F.col("k").isNotNull(), "bm25"), F.when(F.col("s").isNotNull(), "semantic")).alias("sources"))
    top = out.orderBy(F.desc("score"), "filePath").limit(limit if limit > 0 else 10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "filePath")))

"""One query for each operator, over its whole table, with the digest columns that its result is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import egojoin, langid, lmscore, matroska, order, packing, piecebpe, simhash, substring, toxicity

#: Vocabulary files of the public tokenizers, and the ids that end a text with them.
PIECE_BPE, WORD_BPE, END_ID = "piece_bpe_32k.model", "word_bpe_49k.json", 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", ~langid.in_training("doc_id"))


def op1_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_as_media(_table(spark, sf_dir, "documents"))


def op2_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _held_out(langid.identify(docs, langid.learn(docs))).select("doc_id", "held_out", "lang_pred", "score")


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lmscore.score(docs, lmscore.fit(docs, _table(spark, sf_dir, "benchmark")))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.materialise(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID).records()


def op5_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return _held_out(toxicity.score(docs, model)).select("doc_id", "held_out", "score", "predicted")


def op7_piece_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE), end_id=END_ID)


def op8_cover_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)


def op10_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicates(_table(spark, sf_dir, "embeddings"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 on instruction data: turns under simultaneous limits on tokens, segments and loss-bearing tokens."""
    return packing.pack_turns(_table(spark, sf_dir, "conversations"), tokenizer_path(WORD_BPE), END_ID)


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 1 read back of every document, as far as SQL can say it."""
    return matroska.store_as_media(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def media_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet table that operator 1 parses from the stored media of every document."""
    stored = matroska.store_as_media(_table(spark, sf_dir, "documents"), with_media=True)
    return matroska.packet_table(stored, "doc_id").select(F.col("media_id").alias("doc_id"), "packet", "track", "codec", "timestamp_ms", "size", "keyframe")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def further_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Other results of the same operators: the packet table, and packing of instruction data."""
    return {f.__name__: f for f in (media_payload, media_packets, conversation_packing)}


#: Repeated windows of 50 words, decided for every start of every document.
OP8_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50),
hashed AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS first FROM hashed GROUP BY h),
bad AS (SELECT doc_id, s FROM hashed JOIN least USING (h) WHERE first < doc_id),
marks AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM bad),
each AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS line, count(*) AS n FROM each ANTI JOIN marks USING (doc_id, i) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


#: All pairs of vectors by cosine in double precision, and the smallest id reachable from each.
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (vec_id)
"""


#: Texts with zeros up to a positive multiple of 64 bytes, and packets of 512 samples at 8000 a second.
PAYLOAD_SQL = """
SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(octet_length(raw) + pad AS BIGINT) AS payload_bytes,
  sha256(raw || unhex(repeat('00', pad))) AS payload_sha256
FROM (SELECT doc_id, raw, CAST(greatest(64, (octet_length(raw) + 63) // 64 * 64) - octet_length(raw) AS INTEGER) AS pad
      FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents))
"""
PACKETS_SQL = """
WITH p AS (SELECT doc_id, greatest(64, (octet_length(encode(coalesce(text, ''))) + 63) // 64 * 64) AS n FROM documents),
e AS (SELECT doc_id, n, unnest(range((n + 511) // 512)) AS i FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS packet, 1 AS track, 'A_PCM/INT/LIT' AS codec, CAST(i * 64 AS DOUBLE) AS timestamp_ms,
  CAST(least(512, n - 512 * i) AS BIGINT) AS size, true AS keyframe FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_epsilon_grid_join": OP10_SQL, "op8_cover_anchor_repeats": OP8_SQL, "media_payload": PAYLOAD_SQL, "media_packets": PACKETS_SQL}

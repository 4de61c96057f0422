"""What embeddings are made of: which symbols, their text, its hash, its chunks, and a plain embedder for tests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .text import clean_content

# Labels whose bodies are cut into chunks, and labels that are embedded whole.
CHUNKED = ("Function", "Method", "Constructor", "Class", "Interface", "Struct", "Enum", "Trait", "Impl", "Macro", "Namespace")
WHOLE = ("TypeAlias", "Typedef", "Const", "Property", "Record", "Union", "Static", "Variable")


def embeddable(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("label").isin(*CHUNKED, *WHOLE))


def short_description(text):
    """At most 150 characters, ended at a sentence or else at a space."""
    cut = F.substring(text, 1, 150)
    sentence = F.regexp_extract(cut, r"^(.*[.!?])\s", 1)
    return F.when(F.length(text) <= 150, text).when(sentence != "", sentence).otherwise(F.regexp_replace(cut, r"\s+\S*$", ""))


def embedding_text(nodes: DataFrame, edges: DataFrame, repo: str = "") -> DataFrame:
    """(id, text, hash): a header, for types their members' names, and the cleaned body; the hash leaves members out."""
    has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    members = edges.filter("type in ('HAS_METHOD', 'HAS_PROPERTY')").join(nodes.select(F.col("id").alias("targetId"), F.col("name").alias("member")), "targetId")
    names = members.groupBy(F.col("sourceId").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("type") == "HAS_METHOD", F.col("member")))).alias("methods"), F.array_sort(F.collect_set(F.when(F.col("type") == "HAS_PROPERTY", F.col("member")))).alias("fields"))
    line = lambda title, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{title}: "), value))
    head = F.concat_ws("\n", line("Label", F.col("label")), line("Name", F.col("name")), line("Repo", F.lit(repo)), line("Path", F.col("filePath")), line("Description", short_description(has("description"))))
    body = F.coalesce(clean_content(F.col("content")), F.lit(""))
    j = embeddable(nodes).join(names, "id", "left")
    extra = F.concat_ws("\n", line("Methods", F.array_join("methods", ", ")), line("Fields", F.array_join("fields", ", ")))
    return j.select("id", F.concat_ws("\n", head, F.when(extra != "", extra), body).alias("text"), F.sha1(F.concat_ws("\n", head, body)).alias("hash"))


def line_chunks(text: str, most: int = 1200, keep_head: bool = True) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of chunks of whole lines up to `most` bytes; for code the first line heads each chunk.
    A longer line is a chunk of its own; a text that fits is one chunk."""
    rows = text.split("\n")
    if len(text.encode()) <= most:
        return [(1, len(rows), text)]
    out, start, held, size = [], 0, [], 0
    for i, row in enumerate(rows):
        n = len(row.encode()) + 1
        if held and size + n > most:
            out.append((start + 1, i, "\n".join(held)))
            start, held, size = i, [], 0
        held.append(row)
        size += n
    out.append((start + 1, len(rows), "\n".join(held)))
    return [(a, b, t if i == 0 or not keep_head else f"{rows[0]}\n{t}") for i, (a, b, t) in enumerate(out)]


def structural_chunks(texts: DataFrame, most: int = 1200) -> DataFrame:
    """(id, chunkIndex, startLine, endLine, text) of texts (id, text)."""

    def run(batches):
        for batch in batches:
            rows = [(r.id, i, a, b, t) for r in batch.itertuples() for i, (a, b, t) in enumerate(line_chunks(r.text or "", most))]
            yield pd.DataFrame(rows, columns=["id", "chunkIndex", "startLine", "endLine", "text"])

    return texts.select("id", "text").mapInPandas(run, "id string, chunkIndex int, startLine long, endLine long, text string")


def hashed_vectors(texts: list[str], dims: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashed words, scaled to length 1."""
    import zlib

    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dims] += 1 if h >> 16 & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


def embed(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_vectors, batch: int = 16) -> DataFrame:
    """chunks with a column embedding; the embedder gets lists of at most `batch` texts."""
    names = chunks.columns

    def run(batches):
        for pdf in batches:
            vectors = [v for i in range(0, len(pdf), batch) for v in embedder(pdf["text"].iloc[i : i + batch].fillna("").tolist()).tolist()]
            yield pdf.assign(embedding=vectors)[[*names, "embedding"]]

    return chunks.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema)}, embedding array<float>")

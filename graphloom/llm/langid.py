"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector; an n-gram's vector binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a text's vector bundles (adds) the vectors of its n-grams. A language's prototype bundles
the unit vectors of labelled texts; a text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, give_back, take_over

#: Fixed parameters of the profiles. Texts are read in slices, so that a very long one needs no more memory.
DIM, ORDER, SEED, SLICE = 1024, 3, 20_011, 1 << 18
#: The most labelled rows that prototypes learn from (in expectation; they are chosen by a hash of doc_id).
TRAIN_ROWS = 8192
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def symbol_slices(text: str):
    """The lower-cased letters of a text as code points, any run of other characters as one 0; slices overlap by ORDER - 1."""
    table, carry = letter_table(), np.zeros(1, np.int64)
    for at in range(0, len(text), SLICE):
        raw = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        raw = np.where(table[raw], raw, 0)
        raw = np.concatenate([carry, raw, np.zeros(1, np.int64)] if at + SLICE >= len(text) else [carry, raw])
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
        out = raw[keep]
        yield out
        carry = out[-(ORDER - 1) :]


def grams(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct n-gram codes (21 bits a symbol) with counts, and the number of letters."""
    found, letters = [], 0
    for i, s in enumerate(symbol_slices(text)):
        letters += int(np.count_nonzero(s[0 if i == 0 else ORDER - 1 :]))
        if len(s) >= ORDER:
            code = s[: len(s) - ORDER + 1].copy()
            for k in range(1, ORDER):
                code = code << 21 | s[k : len(s) - ORDER + 1 + k]
            found.append(np.unique(code, return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    if len(found) == 1:
        return *found[0], letters
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64), letters


class GramVectors:
    """Vectors of n-grams, bound when first met; the table starts anew when it holds too many."""

    def __init__(self, most: int = 32_768):
        self.most, self.letter, self.codes, self.table = most, {}, np.zeros(0, np.int64), np.zeros((0, DIM), np.int8)

    def of_letter(self, point: int) -> np.ndarray:
        v = self.letter.get(point)
        if v is None:
            if len(self.letter) > 20_000:
                self.letter.clear()
            rng = np.random.Generator(np.random.Philox(key=SEED, counter=point))
            v = self.letter[point] = (rng.integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)
        return v

    def bind(self, code: int) -> np.ndarray:
        out = np.ones(DIM, np.int8)
        for place in range(ORDER):
            out = out * np.roll(self.of_letter(code >> 21 * (ORDER - 1 - place) & 0x1FFFFF), ORDER - 1 - place)
        return out

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """float32 vectors of sorted distinct codes."""
        new = codes[~np.isin(codes, self.codes, assume_unique=True)]
        if len(new):
            made = np.stack([self.bind(int(c)) for c in new])
            if len(self.codes) + len(new) > self.most:
                old = codes[np.isin(codes, self.codes, assume_unique=True)]
                kept = self.table[np.searchsorted(self.codes, old)]
            else:
                old, kept = self.codes, self.table
            all_codes = np.concatenate([old, new])
            order = np.argsort(all_codes)
            self.codes, self.table = all_codes[order], np.concatenate([kept, made])[order]
        return self.table[np.searchsorted(self.codes, codes)].astype(np.float32)


_vectors: GramVectors | None = None


def _forget() -> None:
    global _vectors, _letters
    _vectors = _letters = None


def bundle(texts: list[str], group: int = 64):
    """(matrix of text vectors, letters of each text) for a list of texts, a group of texts at a time."""
    global _vectors
    take_over("languages", _forget)
    _vectors = _vectors or GramVectors()
    out, letters = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    for first in range(0, len(texts), group):
        part = [grams(t) for t in texts[first : first + group]]
        letters[first : first + group] = [p[2] for p in part]
        codes = np.unique(np.concatenate([p[0] for p in part]))
        if not len(codes):
            continue
        for lo in range(0, len(codes), 8192):
            span = codes[lo : lo + 8192]
            counts = np.zeros((len(part), len(span)), np.float32)
            for i, (c, n, _) in enumerate(part):
                a, b = np.searchsorted(c, span[0]), np.searchsorted(c, span[-1], "right")
                counts[i, np.searchsorted(span, c[a:b])] = n[a:b]
            out[first : first + len(part)] += counts @ _vectors.rows(span)
    return out, letters


#: Rows that a language teaches with at any size of the table, if it has as many.
LEAST_ROWS = 64


@dataclass
class Profiles:
    """Languages with the unit vectors of their prototypes; languages are sorted, so a tie goes to the first."""

    langs: list[str]
    prototypes: np.ndarray

    def compare(self, texts: list[str]):
        """(language, cosine held to 0..1, lead over the next language, letters) of each text."""
        vectors, letters = bundle(texts)
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ self.prototypes.T / np.maximum(norms, 1e-30)[:, None] if self.langs else np.zeros((len(texts), 1))
        best = np.argmax(cosines, axis=1)
        top = np.sort(cosines, axis=1)
        lead = top[:, -1] - top[:, -2] if cosines.shape[1] > 1 else top[:, -1]
        for i in range(len(texts)):
            if letters[i] and self.langs:
                yield self.langs[best[i]], float(np.clip(cosines[i, best[i]], 0, 1)), float(lead[i]), int(letters[i])
            else:
                yield UNKNOWN, 0.0, 0.0, int(letters[i])


def in_training(id_col: str = "doc_id"):
    """Rows that may teach: crc32 of the id's decimal text modulo 5 is not 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Profiles:
    """Prototypes from at most about `rows` labelled rows outside the held-out fold, chosen by a hash of the id, each
    language by its own bound: rare ones teach with all their rows, common ones share what is left, and none has
    fewer than about LEAST_ROWS where it has as many. Rows with a null id, text or language teach nothing; with no labelled row there is no language."""
    bounded_batches(df.sparkSession)
    labelled = df.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & in_training(id_col)).withColumn("__lang", F.col(lang_col).cast("string"))
    there = {r["__lang"]: r["n"] for r in labelled.groupBy("__lang").agg(F.count("*").alias("n")).collect()}
    left, bound = rows, {}
    for i, (lang, n) in enumerate(sorted(there.items(), key=lambda x: (x[1], x[0]))):
        bound[lang] = min(n, max(left // (len(there) - i), LEAST_ROWS))
        left = max(left - bound[lang], 0)
    cuts = df.sparkSession.createDataFrame([(lang, (1 << 30) * bound[lang] // n + 1) for lang, n in there.items()], "__lang string, __cut long")
    chosen = labelled.join(F.broadcast(cuts), "__lang").filter(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 30)) < F.col("__cut"))
    schema = pa.schema([("lang", pa.string()), ("total", pa.list_(pa.float64()))])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors, letters = bundle(texts)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-30)[:, None]
            for lang, v, n in zip(langs, vectors, letters):
                if n:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], schema.field(1).type)], schema=schema)

    # The sample is small by its parameter: a few tasks bundle it, and each returns one vector for each language.
    parts = chosen.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).repartition(8).mapInArrow(run, "lang string, total array<double>").collect()
    sums: dict[str, np.ndarray] = {}
    for lang, total in sorted((p.lang, p.total) for p in parts):
        sums[lang] = sums.get(lang, 0) + np.array(total)
    langs = sorted(sums)
    prototypes = np.array([sums[x] / max(np.linalg.norm(sums[x]), 1e-30) for x in langs], np.float32).reshape(len(langs), DIM)
    return Profiles(langs, prototypes)


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), lead over the next language and letters for every row.

    Only the text is read. A null text, or one without letters, gets `und` and score 0; so does every text when no
    language was learned. Repeated rows give repeated rows; extra columns are ignored."""
    bounded_batches(df.sparkSession)
    types = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("lead", pa.float64()), ("letters", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = profiles.compare([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows), types.types[1:])], schema=types)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, lead double, letters long")


def least_cosine(letters: int, least: float = 0.18, half: int = 100) -> float:
    """The cosine that a text of so many letters must have with some language: it rises with the evidence from nearly
    nothing, over half of `least` at `half` letters, towards `least`. One rule for texts of all lengths."""
    return least * letters / (letters + half)


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = 0.18, half: int = 100) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text has letters and resembles some language: a cosine of at
    least least_cosine. Null texts, texts without letters and, where no language was learned, all texts go."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = [lang != UNKNOWN and score >= least_cosine(n, least, half) for lang, score, _, n in profiles.compare([t or "" for t in batch.column(at).to_pylist()])]
                yield batch.filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(run, docs.schema)

"""SentencePiece rounds, token memo, packing and training order against their libraries and plain versions."""

import hashlib
import json
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import order, packing, piecebpe, queries, tokens

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "e", "th", " ", "  ", "\n", "é", "ß", "漢", "😀", "▁", "\t", "<0x41>", "<s>", "</s>", "ing", "́", "\x00", "aaaa", ".", "zz", "'s", "ﬁ", "Σ", "İ", "\x1c", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "!", "it's,", "1234"]


def strings(n=1500, seed=4):
    rnd = random.Random(seed)
    return ["", " ", "\n", " a", "a ", "x" * 300, "aaab" * 100] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_pieces_equal_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rnd = random.Random(9)
    for s in [*strings(), *("".join(rnd.choice("abcdethning") for _ in range(250)) for _ in range(40))]:
        want = lib.encode(s, add_eos=True)
        got = piecebpe.encode_text(PIECE, s, 2)
        assert got == want, s
        assert piecebpe.decode_ids(PIECE, got) == lib.decode(want)
    for _ in range(300):
        ids = [rnd.randrange(32_000) for _ in range(30)]
        assert piecebpe.decode_ids(PIECE, ids) == lib.decode(ids)


def test_long_words_equal_the_library(monkeypatch):
    """Words of any length take the same rounds, in slices too: random letters, ties, text without spaces."""
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rnd = random.Random(21)
    signs = [lib.id_to_piece(i) for i in range(3, 32_000, 7)]
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "a" * 9_999, "ab" * 5_000, "".join(rnd.choice("aeinst") for _ in range(3_000))]
    texts += ["".join(rnd.choice(signs).replace("▁", "") for _ in range(2_000)) for _ in range(4)] + ["日本語の文章です。" * 300, "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(3_000))]
    for at_once in (1 << 20, 100):
        monkeypatch.setattr(piecebpe, "AT_ONCE", at_once)
        m = piecebpe.PieceModel(PIECE)
        for t in texts:
            assert [x for ids in m.merge(m.words(t)) for x in ids] == lib.encode(t), t[:50]


def test_new_words_take_no_call_each():
    """The work of many new words lies in arrays: no Python function is called for each of them."""
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rnd = random.Random(33)
    text = " ".join("".join(rnd.choice("aeinrstlo") for _ in range(rnd.randint(3, 12))) for _ in range(30_000))
    piecebpe.model(PIECE)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        got = piecebpe.encode_text(PIECE, text, 2)
    finally:
        sys.setprofile(None)
    assert got == lib.encode(text, add_eos=True) and len(calls) < 10_000


@pytest.mark.parametrize("memo,window,kinds", [(120_000, 1 << 19, 2), (5, 64, 2), (50, 300, 3), (7, 40, 1 << 40)])
def test_words_that_share_a_key_are_told_apart(monkeypatch, memo, window, kinds):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    keys = piecebpe._keys
    monkeypatch.setattr(piecebpe, "_keys", lambda *a: keys(*a) % np.uint64(kinds))
    monkeypatch.setattr(piecebpe, "MEMO", memo)
    monkeypatch.setattr(piecebpe, "WINDOW", window)
    monkeypatch.setattr(piecebpe, "_memos", {})
    texts = strings(300, 6) + [None, "the cat the dog the cow " * 20, "漢" * 500, "\n\n a\n \n", "same", "same"]
    for _ in range(2):
        assert piecebpe.encode_texts(PIECE, texts, 2) == [lib.encode(t or "", add_eos=True) for t in texts]


def test_piece_tables(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "hello  world\n", 1), (3, "hello  world\n", 1), (None, "x", 1), (4, "long " * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = piecebpe.round_trip(df, PIECE).collect()
    assert len(got) == 6 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    back = {r.doc_id: r.text for r in piecebpe.decode(piecebpe.encode(df, PIECE), PIECE).collect()}
    assert back == {1: "", 2: "", 3: "hello  world\n", None: "x", 4: "long " * 200_000}
    assert piecebpe.round_trip(df.filter("false"), PIECE).count() == 0


def test_chunk_ids_equal_the_library():
    lib = Tokenizer.from_file(WORD)
    e = tokens.ChunkEncoder(WORD, memo=50)
    texts = [*strings(), "naïve CAFÉ straße ǅ ǆ ʹ ͅ ſ ª º ĳ ŉ ͻ ԥ", " ".join(chr(i) for i in range(33, 0x600)), "".join(chr(i) for i in range(33, 0x600))]
    for s in [*texts, *(s.lower() for s in texts)]:
        assert np.frombuffer(e.encode(s), "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids, s


@pytest.mark.parametrize("rows, chunks, ids, window, together", [(1 << 12, 1 << 10, 1 << 20, 1 << 10, 1 << 10), (1 << 12, 1 << 10, 200, 100, 50), (1 << 16, 1 << 15, 1 << 20, 1 << 14, 1 << 18)])
def test_texts_together_have_the_ids_of_each(monkeypatch, rows, chunks, ids, window, together):
    """Chunks of the table's bounds, zero bytes, tables that are nearly full or drop chunks, texts cut into slices."""
    for name, value in (("TABLE_ROWS", rows), ("TABLE_CHUNKS", chunks), ("TABLE_IDS", ids), ("WINDOW", window), ("TOGETHER", together)):
        monkeypatch.setattr(tokens, name, value)
    lib, rnd = Tokenizer.from_file(WORD), random.Random(3)
    words = ["".join(rnd.choice("aeinst\0é,漢") for _ in range(rnd.randint(0, 18))) for _ in range(3000)]
    words += [x * n for x in ("a", "\0", "é") for n in range(1, 19)] + ["a" * n + "\0" * k for n in range(3) for k in range(18 - n)]
    texts = [*strings(), "", "", " " * 3000, " a", "<|endoftext|>", "x" * 4000, "a<|startoftext|> b " * 100]
    texts += [" ".join(rnd.choices(words, k=rnd.randint(0, 400))) for _ in range(60)] + ["漢字 ΑΣ İ \n" * 500]
    rnd.shuffle(texts)
    e = tokens.ChunkEncoder(WORD, memo=50)
    for _ in range(2):
        for s, found in zip(texts, e.encode_all(iter(texts)), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids, s
    assert list(e.encode_all([None, "a", None])) == [b"", e.encode("a"), b""] and list(e.encode_all([])) == []


def test_words_merged_together_are_the_library_s():
    lib, rnd = Tokenizer.from_file(WORD), random.Random(12)
    merges = tokens._Merges.of(lib)
    words = [c * n for c in "aelmosé" for n in range(1, 17)] + [w.removesuffix("</w>") for w in sorted(lib.get_vocab()) if w.removesuffix("</w>").isalpha() and w.isascii()][::7]
    words += ["".join(rnd.choice(x) for _ in range(rnd.randint(1, 16))) for x in ("abcdefghijklmnopqrstuvwxyz", "aeinst", "ab", "aéßñ", "漢字テスト") for _ in range(1500)]
    words = [w for w in words if w == w.lower()]
    raw = [w.encode() for w in words]
    ids, n = merges.ids(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(w, add_special_tokens=False).ids for w in words]


def test_models_with_other_merges_go_through_the_library():
    """A merge that comes before the one that makes its part isn't done in rounds."""
    model = json.loads(Tokenizer.from_file(WORD).to_str())
    model["model"]["merges"] = model["model"]["merges"][::-1]
    other = Tokenizer.from_str(json.dumps(model))
    assert tokens._Merges.of(other) is None
    e = tokens.ChunkEncoder(WORD)
    e.table, e.merges = tokens._Table(), None
    assert list(e.encode_all(["the cat's hat, naïve"])) == [e.encode("the cat's hat, naïve")]


def test_signs_after_letters_cut_chunks_as_the_library_does():
    lib, rnd = Tokenizer.from_file(WORD), random.Random(14)
    signs = ["".join(rnd.choice("aest'’,.!<>=|_1²é\u0301\u0338٣") for _ in range(rnd.randint(1, 20))) for _ in range(20_000)]
    texts = [" ".join(signs[i : i + 10]) for i in range(0, len(signs), 10)] + signs[:3000]
    for s, found in zip(texts, tokens.ChunkEncoder(WORD).encode_all(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids, s


def test_order_looks_known_words_up_in_arrays(spark, monkeypatch):
    """Training order takes no step of Python for each word that it has met."""
    class Local:
        sparkSession, select, mapInArrow = spark, lambda self, *_: self, lambda self, run, _: run

    class Task:
        get, partitionId = staticmethod(lambda: Task), staticmethod(lambda: 0)

    rnd, looked = random.Random(5), []
    words = ["".join(rnd.choice("aeinst") for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    batch = order.pa.record_batch({"doc_id": [1, 2], "text": [" ".join(rnd.choices(words, k=10_000)) for _ in range(2)]})
    monkeypatch.setattr(order, "TaskContext", Task)
    monkeypatch.setattr(tokens._Memo, "__getitem__", lambda self, chunk: looked.append(chunk) or dict.__getitem__(self, chunk), raising=False)
    tokens._encoders.clear()
    made = order.pa.Table.from_batches(order.sequences(Local(), WORD, 2, 256, 2)(iter([batch])))
    tokens._encoders.clear()
    assert made.num_rows > 80 and len(looked) <= 500


def test_fill_keeps_limits_and_wastes_little():
    rng = np.random.default_rng(8)
    sizes = np.stack([rng.integers(1, 4000, 3000), np.ones(3000, int), np.zeros(3000, int)], 1).astype(float)
    sizes[:, 2] = np.minimum(np.floor(sizes[:, 0] * rng.random(3000)), 3000)
    limits = np.array([4096.0, 6.0, 3000.0])
    sequence, place = packing.fill(sizes, limits)
    for s in np.unique(sequence):
        own = sequence == s
        assert (sizes[own].sum(0) <= limits).all() and sorted(place[own]) == list(range(own.sum()))
    bound = max(np.ceil(sizes.sum(0) / limits).max(), 1)
    assert len(np.unique(sequence)) <= 1.15 * bound


def test_pack_general(spark):
    rows = [(i, 10 * (i % 7) + 1, 1, i % 5, "x") for i in range(200)] + [(3, 31, 1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, length long, segments int, loss long, sequence_id string")
    out = packing.pack(df, {"length": 100, "segments": 4, "loss": 9}, ["doc_id"], group_rows=60).toPandas()
    assert len(out) == 201
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 100 and len(g) <= 4 and g.loss.fillna(0).sum() <= 9
        assert (g.offset.to_numpy() == np.append(0, g.length.cumsum()[:-1])).all()
    assert packing.pack(df.filter("false"), {"length": 100}, ["doc_id"]).count() == 0
    with pytest.raises(Exception, match="above its limit"):
        packing.pack(df, {"length": 5}, ["doc_id"]).count()


def test_packed_documents_cover_every_id(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(1000, None), (1001, ""), (1002, "word " * 9000), (1003, "a<|endoftext|> hi <|startoftext|><|EndOfText|>")]
    lib = Tokenizer.from_file(WORD)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD).toPandas()
    seen = {i: [] for i in ids}
    for r in out.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += range(r.start, r.start + r.length)
    assert all(sorted(v) == list(range(len(ids[k]))) for k, v in seen.items())
    total = padding = 0
    for _, g in out.groupby("sequence_id"):
        n = int(g.length.sum())
        assert n <= 4096
        total, padding = total + n, padding + (0 if n & (n - 1) == 0 else 4096 - n)
    assert padding / total < 0.05


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    for key in (0, 1, 1 << 63):
        p = order.Permutation(n, key)
        s = p.slots(np.arange(n))
        assert sorted(s) == list(range(n)) and (p.indexes(s) == np.arange(n)).all()
    assert n < 64 or (order.Permutation(n, 1).slots(np.arange(n)) != order.Permutation(n, 2).slots(np.arange(n))).any()
    with pytest.raises(ValueError):
        order.Permutation(n, 0).slots([n])


def test_shards_hold_every_sequence_once_and_resume(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + [(900, None), (901, ""), (None, "lost id"), (900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    made = order.materialise(spark.read.parquet(str(tmp_path / "t")), WORD, length=32, shard_rows=100)
    e = tokens.encoder(WORD)
    want = sorted(((d, i, x) for d, t in rows for i, x in enumerate(order.cut(e.encode(t) + b"\2\0\0\0", 32, 2))), key=repr)
    read = list(made.read())
    assert [r[0] for r in read] == list(range(len(want)))
    assert sorted(((d, i, np.array(x, "<u2").tobytes()) for _, d, i, x in read), key=repr) == want
    assert list(made.read(150)) == read[150:]
    found = {r.slot: r for r in made.records().collect()}
    assert all((found[s].doc_id, found[s].piece, found[s].n_ids, found[s].ids_crc32) == (d, i, len(x), zlib.crc32(np.array(x, "<u2").tobytes())) for s, d, i, x in read)
    assert {r.byte_offset for r in found.values()} <= {i * made.stride for i in range(100)}
    assert [r[1:] for r in read] != sorted((r[1:] for r in read), key=repr)
    (spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e")))
    empty = order.materialise(spark.read.parquet(str(tmp_path / "e")), WORD)
    assert empty.records().count() == 0 and list(empty.read()) == []


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))


def test_round_trip_digests_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = {r.doc_id: r for r in queries.op7_piece_bpe_rounds(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        assert tuple(found[r.doc_id])[1:4] == want


def test_equal_pieces_are_dealt_apart(spark):
    rows = [(7, 10, "x")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, length long, text string").repartition(6)
    out = packing.pack(df, {"length": 100}, ["doc_id"], group_rows=100).toPandas()
    groups = (out.sequence_id.to_numpy() >> 32)
    assert len(out) == 3000 and np.bincount(groups).max() < 200 and out.groupby("sequence_id").length.sum().max() <= 100


def test_turns_keep_all_limits(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"word {t} " * (1 + (c * 7 + t) % 90)) for c in range(80) for t in range(6)] + [(1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, ""), (2, 9, "assistant", "many " * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as length", "2 as sequence_id")
    lib = Tokenizer.from_file(WORD)
    out = packing.pack_turns(df, WORD, tokens=1024, segments=9, loss_tokens=400).toPandas()
    want = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for *_, t in rows)
    loss = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for *_, r, t in rows if r == "assistant")
    assert out.length.sum() == want and out.loss_tokens.sum() == loss
    limits = np.array([1024, 9, 400])
    sums = np.array([(g.length.sum(), len(g), g.loss_tokens.sum()) for _, g in out.groupby("sequence_id")])
    assert (sums <= limits).all() and len(sums) <= 1.2 * max(np.ceil(sums.sum(0) / limits))
    assert packing.pack_turns(df.filter("false"), WORD).count() == 0


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", 3)] * 40 + [(None, "x", 1), (None, None, 1)], "doc_id long, text string, offset int").selectExpr("*", "'q' as sequence_id", "5 as length")
    out = packing.pack_documents(df, WORD).collect()
    assert len(out) == 42 and sum(r.doc_id is None for r in out) == 2 and sorted({r.length for r in out}) == [1, 2, 3]
    assert packing.pack_documents(df.filter("false"), WORD).count() == 0

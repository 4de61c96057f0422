import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from compare import duck, of_spark, of_sql

from graphloom.llm import matroska as m
from graphloom.llm import queries


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 4096, 4160, 131_072, 300_001])
@pytest.mark.parametrize("lacing", ["auto", "xiph", "ebml"])
def test_round_trip(n, lacing):
    payload = m.padded("é" * (n // 2) + "x" * (n % 2))[1]
    stored = m.mux(payload, lacing)
    media = m.parse(stored)
    assert m.samples(stored, media) == payload
    assert len(payload) % 64 == 0 and payload
    assert [p.timestamp_ms for p in media.packets] == [i * 64.0 for i in range(len(media.packets))]
    assert len(media.cues) == len({p.cluster for p in media.packets})


def test_fixed_lacing_and_seek():
    payload = bytes(range(256)) * 1024
    stored = m.mux(payload, "fixed")
    media = m.parse(stored)
    assert {p.lacing for p in media.packets} == {"fixed"} and m.samples(stored, media) == payload
    for t in (0, 63, 64, 20_000, 32_767):
        assert m.seek(stored, media, t).timestamp_ms == max(p.timestamp_ms for p in media.packets if p.timestamp_ms <= t)


def test_unknown_sizes_block_groups_and_voids():
    unknown = b"\x01" + b"\xff" * 7
    group = m._element(m.BLOCK_GROUP, m._element(m.BLOCK, b"\x81" + struct.pack(">hB", 5, 0) + b"abc") + m._element(m.REFERENCE, 1))
    cluster = b"\x1f\x43\xb6\x75" + unknown + m._element(m.TIME, 100) + m._element(0xEC, b"\0" * 9) + group
    data = m._element(m.EBML, m._element(m.DOC_TYPE, "webm")) + b"\x18\x53\x80\x67" + unknown + m._element(m.INFO, m._element(m.SCALE, 2_000_000)) + cluster + cluster
    media = m.parse(data)
    assert [(p.timestamp_ms, p.size, p.keyframe) for p in media.packets] == [(210.0, 3, False)] * 2


def test_packet_table_and_malformed_rows(spark):
    good = m.mux(m.padded("word " * 2000)[1])
    rows = [(1, good), (2, None), (3, b"\x00\x01junk"), (4, good[:-100]), (5, b""), (1, good)]
    df = spark.createDataFrame(rows, "media_id long, media binary").selectExpr("*", "'x' as error", "0 as packet")
    found = m.packet_table(df).collect()
    by = {k: [r for r in found if r.media_id == k] for k in range(1, 6)}
    assert len(by[1]) == 2 * len(m.parse(good).packets) and not by[2]
    assert [r.error is not None for r in by[3]] == [True] and [r.error is not None for r in by[4]] == [True] and len(by[5]) == 1
    r = by[1][3]
    assert good[r.start : r.start + r.size] and r.track == 1 and r.codec == "A_PCM/INT/LIT"


def test_store_edge_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "a" * 1_000_000, 9), (4, "ß", 9), (4, "ß", 9), (None, "x", 9)]
    found = m.store_as_media(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")).collect()
    assert len(found) == 6
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert (by[1][0].n_bytes, by[1][0].payload_bytes) == (0, 64) and by[1][0][2:] == by[2][0][2:]
    assert by[3][0].payload_bytes == 1_000_000 and by[4][0] == by[4][1] and by[4][0].n_bytes == 2 and None in by
    assert m.store_as_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_columns_against_a_plain_version(spark):
    """Each column computed apart from the text; the stored form's digest from a muxed copy read with plain offsets."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op1_matroska_media(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r, stored = found[d.doc_id], m.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(float)
        got = dict(p.split("=") for p in r.feature.split(";"))
        assert int(got["packets"]) == -(-len(payload) // 512) == r.n_packets and float(got["mean"]) == pytest.approx(x.mean(), abs=1e-3)
        assert float(got["rms"]) == pytest.approx(np.sqrt(((x - 128) ** 2).mean()), abs=1e-3)
        assert int(got["zc"]) == sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        assert stored[:4] == bytes.fromhex("1a45dfa3") and len(re.findall(rb"A_PCM/INT/LIT", stored[:400])) == 1


@pytest.mark.parametrize("name", ["media_payload", "media_packets"])
def test_media_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert of_spark(queries.further_queries()[name](spark, sf)) == of_sql(duck(sf), queries.oracle_sql()[name])

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import matroska as m


@given(st.text(max_size=3000), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_round_trip(text, times):
    payload, n = m.payload_of(text * times)
    assert n == len((text * times).encode()) and len(payload) % 64 == 0 and payload
    data = m.write_pcm(payload)
    parsed = m.read(data)
    assert m.track_bytes(data, parsed) == payload
    assert parsed["tracks"][1] == {"type": 2, "codec": "A_PCM/INT/LIT", "step": 64_000_000}
    assert [p[2] for p in parsed["packets"]] == [i * 64_000_000 for i in range(len(parsed["packets"]))]
    for _, _, at in parsed["cues"]:
        assert data[at : at + 4] == b"\x1f\x43\xb6\x75"


@pytest.mark.parametrize("how", [0, 1, 2, 3])
def test_every_lacing(how):
    frames = {0: [b"a" * 700], 1: [b"a" * 255, b"b" * 256, b"", b"c" * 600], 2: [b"x" * 9] * 5, 3: [b"a" * 700, b"b" * 3, b"c" * 400, b"d" * 20_000, b"e"]}[how]
    cluster = m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 5000) + m.element(m.SIMPLE_BLOCK, m.block(1, -20, frames, how, key=False)))
    data = m.element(m.SEGMENT, cluster)
    got = m.read(data)["packets"]
    assert [data[p[4] : p[5]] for p in got] == frames
    assert {p[1:4] for p in got} == {(1, 4_980_000_000, False)}


def test_block_groups_unknown_sizes_and_strange_elements():
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(2, 7, [b"one", b"two"], 2)) + m.uint(m.BLOCK_DURATION, 10) + m.uint(m.REFERENCE, 1))
    cluster = m._id(m.CLUSTER) + b"\x01" + b"\xff" * 7 + m.uint(m.TIMESTAMP, 100) + m.element(0xEC, b"void") + group
    data = m.element(m.EBML, b"") + m._id(m.SEGMENT) + b"\xff" + m.element(m.INFO, m.uint(m.SCALE, 1000)) + cluster + cluster
    got = m.read(data)
    assert [(p[0], p[1], p[2], p[3], data[p[4] : p[5]]) for p in got["packets"]] == [(c, 2, t, False, b) for c in (0, 1) for t, b in ((107_000, b"one"), (112_000, b"two"))]


@pytest.mark.parametrize("data", [b"", b"\x00\x00", b"RIFF", m.element(m.EBML, b""), m._id(m.SEGMENT) + b"\x84ab", m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, b"\x81\x00"))), m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x04\x02abcd")))])
def test_malformed_files_are_refused(data):
    with pytest.raises((ValueError, struct.error)):
        m.read(data)


def test_every_cue_is_checked():
    data = m.write_pcm(bytes(range(256)) * 1200)
    cues = [at for _, _, at in m.read(data)["cues"]]
    assert len(cues) > 2 and f";clusters={len(cues)};cues={len(cues)};cued={len(cues)};" in m.features(data)[1]
    base = len(data) - len(data[data.index(m._id(m.INFO)) :])
    old = m.uint(m.CUE_CLUSTER, cues[-1] - base)
    bad = old[:-1] + bytes([old[-1] ^ 1])
    assert data.count(old) == 1 and f";cued={len(cues) - 1};" in m.features(data.replace(old, bad))[1]


def test_tables(spark):
    df = spark.createDataFrame([(1, "abc", 5), (1, "abc", 6), (None, None, 7), (2, "é" * 5000, 8)], "doc_id long, text string, media int")
    media = m.encode_media(df)
    rows = m.media_features(media).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in rows) == [(0, 0, 64), (1, 3, 64), (1, 3, 64), (2, 10_000, 10_048)]
    packets = m.packet_table(media).where("doc_id = 2").orderBy("packet").collect()
    assert sum(p.end - p.start for p in packets) == 10_048 and len(packets) == 20
    bad = m.packet_table(spark.createDataFrame([(1, b"xx"), (2, None)], "doc_id long, media binary")).collect()
    assert all(r.error and r.packet is None for r in bad)
    assert m.media_features(m.encode_media(df.limit(0))).collect() == []


def test_every_returned_column(spark):
    texts = [None, "", "abc", "x" * 64, "é" * 70_000]
    out = {r.doc_id: r for r in m.media_features(m.encode_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, text in enumerate(texts):
        body = (text or "").encode()
        payload = body + bytes(max(1, -(-len(body) // 64)) * 64 - len(body))
        data, r = m.write_pcm(payload), out[i]
        counts = [payload.count(bytes([b])) for b in range(256)]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(body), len(payload), len(data))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(data).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) & 0xFFFFFFFF
        feature = dict(x.split("=") for x in r.feature.split(";"))
        assert int(feature["packets"]) == -(-len(payload) // m.FRAME) and feature["cues"] == feature["cued"] == feature["clusters"]
        assert abs(float(feature["mean"]) - sum(b * n for b, n in enumerate(counts)) / len(payload)) < 1e-4
    assert (out[0].n_bytes, out[0].payload_sha256, out[0].feature) == (out[1].n_bytes, out[1].payload_sha256, out[1].feature)


def test_null_and_malformed_media(spark):
    rows = [(1, 3, None), (2, 4, b"RIFF"), (None, None, m.write_pcm(bytes(64)))]
    out = {r.doc_id: r for r in m.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert out[1].feature.startswith("error=") and out[1].media_bytes is None and out[1].payload_sha256 is None
    assert out[2].feature.startswith("error=") and out[2].media_bytes == 4 and out[2].payload_bytes is None
    assert out[None].payload_bytes == 64

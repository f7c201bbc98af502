from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from evidora.llm import matroska as M


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml"])
@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4608, 4609, 576 * 401, 600_001])
def test_round_trip(lacing, n):
    payload = M.padded(random.Random(n).randbytes(n))
    raw = M.write(payload, lacing)
    parsed = M.Parsed(raw)
    assert parsed.error is None and parsed.payload(raw) == payload
    assert parsed.time == [i * M.FRAME_MS * 1_000_000 for i in range(len(payload) // 576)]
    assert len(parsed.cues) == parsed.clusters and set(parsed.track) == {1}
    assert bytes(parsed.tracks[1][M.CODEC]) == b"A_PCM/INT/LIT" and parsed.tracks[1][M.BIT_DEPTH] == 8
    start = raw.index(M.SEGMENT.to_bytes(4, "big"))
    _, body, _ = M.read_size(raw, start + 4)
    assert all(raw[body + at : body + at + 4] == M.CLUSTER.to_bytes(4, "big") for _, _, at in parsed.cues)


@pytest.mark.parametrize("kind", ["xiph", "ebml"])
def test_unequal_laces(kind):
    r = random.Random(1)
    frames = [r.randbytes(n) for n in (3, 700, 0, 254, 255, 256, 20_000, 1)]
    body = M.lace(frames, kind)
    at, *sizes = M.unlace(body, 0, len(body), M.LACINGS[kind])
    assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def test_unknown_sizes_and_groups():
    block = b"\x81" + (5).to_bytes(2, "big") + b"\0" + b"abc"
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M.number(M.CLUSTER_TIME, 1000) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block))
    raw = M.element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster + M.element(M.CUES, b"")
    parsed = M.Parsed(raw)
    assert parsed.error is None and parsed.clusters == 2 and parsed.payload(raw) == b"abcabc" and parsed.time == [1_005_000_000] * 2


def test_damage():
    raw = M.write(M.padded(b"x" * 9000))
    for cut in range(0, len(raw), 97):
        parsed = M.Parsed(raw[:cut])
        assert parsed.error and parsed.payload(raw[:cut]) == (b"x" * 9000)[: len(parsed.size) * 576]
    assert M.Parsed(None).error and M.Parsed(b"RIFF").error


def test_columns(spark):
    rows = [(1, "héllo", "a"), (1, "héllo", "a"), (2, None, "b"), (None, "", "c"), (3, "z" * 300_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, payload string")
    out = M.read_media(M.store_texts(df)).withColumn("crc", F.crc32(F.substring("payload", -32, 32))).collect()
    assert len(out) == 5
    for r in out:
        want = M.padded((r.text or "").encode())
        assert r.payload == want and r.error is None and r.crc == zlib.crc32(want[-32:])
        assert sum(p.size for p in r.packets) == len(want)
    assert M.read_media(M.store_texts(df.limit(0))).count() == 0


def test_a_file_made_by_hand():
    """The bytes follow the published format, with its own examples of Xiph and EBML lacing (frames of 800, 500 and 1,000 bytes)."""
    head = bytes.fromhex("1A45DFA39F4286810142F7810142F2810442F381084282847765626D4287810242858102")
    info = bytes.fromhex("1549A966 8F 2AD7B1830F4240 4D808178 57418179")
    tracks = bytes.fromhex("1654AE6B 95 AE 93 D78101 73C58201F4 838102 8686415F4F505553")
    void = bytes.fromhex("EC 83 000000")
    frames = b"a" * 800 + b"b" * 500 + b"c" * 1000
    xiph = bytes.fromhex("81 0000 82 02 FFFFFF23 FFF5") + frames
    ebml = bytes.fromhex("81 000A 06 02 4320 5ED3") + frames
    group = bytes.fromhex("A1 400A 81 FFFF 00") + b"123456"
    blocks = b"".join(b"\xa3" + (0x4000 | len(x)).to_bytes(2, "big") + x for x in (xiph, ebml))
    cluster = bytes.fromhex("1F43B675 01FFFFFFFFFFFFFF E78203E8") + blocks + bytes.fromhex("A0 8D") + group
    cues = bytes.fromhex("1C53BB6B 8E BB8C B38203E8 B786 F78101 F18132")
    raw = head + bytes.fromhex("18538067 01FFFFFFFFFFFFFF") + info + void + tracks + cluster + cues
    parsed = M.Parsed(raw)
    assert parsed.error is None and parsed.clusters == 1
    assert parsed.size == [800, 500, 1000, 800, 500, 1000, 6] and parsed.in_lace == [0, 1, 2, 0, 1, 2, 0]
    assert parsed.payload(raw) == frames * 2 + b"123456"
    assert [t // 1_000_000 for t in parsed.time] == [1000] * 3 + [1010] * 3 + [999]
    assert bytes(parsed.tracks[1][M.CODEC]) == b"A_OPUS" and parsed.cues == [(1000, 1, 0x32)]


def test_packed_tracks():
    def media(encoding, packet):
        track = M.element(M.TRACK, M.number(M.TRACK_NUMBER, 1) + M.element(M.ENCODINGS, M.element(M.ENCODING, encoding)))
        block = M.element(M.SIMPLE_BLOCK, b"\x81\0\0\x80" + packet)
        return M.element(M.EBML, b"") + M.element(M.SEGMENT, M.element(M.TRACKS, track) + M.element(M.CLUSTER, M.number(M.CLUSTER_TIME, 0) + block))

    packed = zlib.compress(b"text" * 50)
    cases = [
        (M.element(M.COMPRESSION, M.number(M.ALGORITHM, 3) + M.element(M.SETTINGS, b"HEAD")), b"tail", b"HEADtail", None),
        (M.element(M.COMPRESSION, b""), packed, b"text" * 50, None),
        (M.element(M.COMPRESSION, b""), packed[:-6], b"", "packet ends early or is too large"),
        (M.element(M.COMPRESSION, M.number(M.ALGORITHM, 2)), b"x", b"", "unknown compression"),
        (M.number(M.ENCODING_TYPE, 1), b"x", b"", "encrypted track"),
    ]
    for encoding, packet, want, error in cases:
        raw = media(encoding, packet)
        parsed = M.Parsed(raw)
        assert parsed.payload(raw) == want and parsed.error == error
    huge = b"\0" * (70 << 20)  # whole, unless the caller bounds it
    raw = media(M.element(M.COMPRESSION, b""), zlib.compress(huge))
    whole, bounded = M.Parsed(raw), M.Parsed(raw)
    assert whole.payload(raw) == huge and whole.error is None
    assert bounded.payload(raw, 1 << 20) == b"" and bounded.error == "packet ends early or is too large"


def test_hostile_files(spark):
    deep = b""
    for _ in range(5000):
        deep = M.BLOCK_GROUP.to_bytes(1, "big") + b"\x01" + b"\xff" * 7 + deep
    scale = M.element(M.INFO, M.number(M.TIMESTAMP_SCALE, (1 << 63) - 1))
    cluster = M.element(M.CLUSTER, M.number(M.CLUSTER_TIME, 1 << 40) + M.element(M.SIMPLE_BLOCK, b"\x81\0\0\x80x"))
    cue = M.element(M.CUES, M.element(M.CUE_POINT, M.number(M.CUE_TIME, (1 << 64) - 1)))
    files = [M.element(M.EBML, b"") + x for x in (deep, M.element(M.SEGMENT, scale + cluster), cue, b"\x01" * 40, b"\0" * 9, M.element(M.SEGMENT, deep + b"\x42"))]
    r = random.Random(5)
    whole = M.write(M.padded(b"y" * 5000))
    for _ in range(300):
        raw = bytearray(whole)
        for _ in range(r.randint(1, 8)):
            raw[r.randrange(len(raw))] = r.randrange(256)
        files.append(bytes(raw))
    out = M.read_media(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id long, media binary")).orderBy("id").collect()
    assert len(out) == len(files) and out[0].error is None and all(r.error for r in out[1:5])

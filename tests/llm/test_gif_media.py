import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.gif_media import decode_gif, encode_samples, frames, histogram, lzw_decode, lzw_encode, op3_gif_media, read_payload


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 9))
def test_lzw_round_trip(data, times):
    data *= times
    assert lzw_decode(lzw_encode(data), 8, len(data)) == data


@pytest.mark.parametrize("data", [b" " * 192, bytes(range(256)) * 192, b"ab" * 96 * 200, bytes(np.random.default_rng(1).integers(0, 256, 192 * 130, np.uint8))])
def test_payload_round_trip(data):
    assert b"".join(f.samples for f in decode_gif(encode_samples(data))[2]) == data


def plain_lzw(codes, bits):
    """A code stream of given codes and of width bits + 1 all along (under 2 ** (bits + 1) table entries)."""
    n = out = 0
    for c in codes:
        out |= c << n
        n += bits + 1
    return out.to_bytes((n + 7) // 8, "little")


def gif(blocks, w=2, h=2, palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    return struct.pack("<6sHHBBB", b"GIF89a", w, h, 0x81, 0, 0) + bytes(x for c in palette for x in c) + b"".join(blocks) + b";"


def image(samples, box=(0, 0, 2, 2), disposal=0, transparent=None, delay=5, flags=0, local=b""):
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    codes = [4]
    for s in samples:
        codes += [s, 4]  # a clear code after each sample keeps the width
    stream = plain_lzw([*codes, 5], 2)
    return control + struct.pack("<BHHHHB", 0x2C, *box, flags) + local + bytes([2, len(stream)]) + stream + b"\0"


R, G, B = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)


def pixels(f):
    return [tuple(int(v) for v in p) for p in f.canvas.reshape(-1, 4)]


def test_disposal_and_transparency():
    blocks = [image([0, 0, 0, 0]), image([1], (1, 1, 1, 1), disposal=2), image([2, 3, 3, 3], transparent=3, disposal=3), image([1], (1, 0, 1, 1))]
    _, _, f = decode_gif(gif(blocks))
    assert pixels(f[0]) == [R] * 4
    assert pixels(f[1]) == [R, R, R, G]
    assert pixels(f[2]) == [B, R, R, (0, 0, 0, 0)]  # the second frame's box was cleared
    assert pixels(f[3]) == [R, G, R, (0, 0, 0, 0)]  # the third was taken back
    assert [x.delay_ms for x in f] == [50] * 4


def test_local_palette_interlace_and_errors():
    local = bytes([7, 7, 7, 8, 8, 8, 0, 0, 0, 0, 0, 0])
    _, _, f = decode_gif(gif([image([0, 1], (0, 0, 1, 2), flags=0x81 | 0x40, local=local)], 1, 2))
    assert pixels(f[0]) == [(7, 7, 7, 255), (8, 8, 8, 255)]
    for bad in (b"", b"GIF89a", gif([image([0, 0, 0, 0])])[:-8], b"PNG" * 9, gif([image([0])])):
        with pytest.raises(ValueError):
            decode_gif(bad)


def test_frame_rows(spark):
    two = gif([image([0, 0, 0, 0]), image([1], (0, 0, 1, 1), delay=7)])
    df = spark.createDataFrame([(1, bytearray(two), "x"), (2, None, "y"), (3, bytearray(b"bad"), "z")], "id long, media binary, histogram string")
    got = sorted(frames(df, "id", "media").collect(), key=lambda r: (r.id, r.frame_no or 0))
    assert [(r.id, r.frame_no, r.start_ms, r.delay_ms) for r in got] == [(1, 0, 0, 50), (1, 1, 50, 70), (3, None, None, None)]
    assert sum(got[1].histogram) == 4 and got[2].error == "not a GIF"


def test_query(spark, tmp_path):
    texts = [None, "", "héllo", "x" * 192, "long text " * 5000, "x" * 192]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_gif_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        timed = [histogram(f.canvas) for f in decode_gif(encode_samples(padded))[2]]
        assert [tuple(f) for f in r.frames] == [(40 * k, 40, h) for k, h in enumerate(timed)] and len(timed) == -(-len(padded) // (192 * 64))
        assert json.loads(r.feature)["colours"] == [sum(h) for h in zip(*timed, strict=True)]
    assert got[3][2:] == got[5][2:]


def test_reading_of_missing_broken_and_huge_images(spark):
    """Each gives a row: NULLs for NULL, the error for a stream that can't be decoded or a screen that memory should not hold."""
    import struct

    huge = struct.pack("<6sHHBBB", b"GIF89a", 60_000, 60_000, 0, 0, 0) + b";"
    blobs = [None, b"bad", gif([image([0, 0, 0, 0])])[:-8], huge, encode_samples(b"a" * 192)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(blobs)], "id long, media binary")
    got = [r.r for r in sorted(df.select("id", read_payload(df["media"]).alias("r")).collect())]
    assert [r.error for r in got] == [None, "not a GIF", "truncated GIF", "screen too large", None]
    assert [r.media_bytes for r in got] == [None, *(len(b) for b in blobs[1:])]
    assert got[0].frames is None and got[1].frames is None and [f.delay_ms for f in got[4].frames] == [40]
    assert got[0].payload_bytes is None and got[4].payload_bytes == 192 and got[4].n_frames == 1
    assert sorted((r.id, r.error) for r in frames(df, "id", "media").where("error is not null").collect()) == [(1, "not a GIF"), (2, "truncated GIF"), (3, "screen too large")]

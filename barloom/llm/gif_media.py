"""Media columns: GIF images as binary columns.

``decode_gif`` reads any GIF87a/89a stream: LZW code streams, global and local
palettes, interlacing, disposal methods and transparency, and frame delays.
``frames`` turns a binary column into one row per timed frame with a
colour-histogram column; ``encode_payload``/``read_payload`` keep arbitrary
bytes losslessly as 8-bit palette samples and read them back.

Defined cases: a NULL media value has no frames and a NULL payload is an empty
text (one row of 192 spaces); a broken stream raises ``ValueError`` in
``decode_gif`` and gives no frame rows and an ``error`` text in ``frames`` and
``read_payload``, which gives NULLs for a NULL; canvases are drawn one at a time;
equal texts give equal bytes; other columns are passed through untouched.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 192
FRAME_ROWS = 64
DELAY_CS = 4
BINS = 64  # colour histogram: two bits of each of red, green and blue
MAX_CODES = 4096
MAX_PIXELS = 1 << 26  # of a screen or frame that is decoded; a larger one is an error, as it may come from a few bytes


def _widths(code_bits: int, n: int) -> np.ndarray:
    """Bit width of the j-th code after a clear code: the table then has max(0, j - 1) entries beyond the fixed ones."""
    size = (1 << code_bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, code_bits + 1, 12)


_WIDTHS = {bits: _widths(bits, 2 * MAX_CODES) for bits in range(1, 9)}


def _lzw_codes(data: bytes) -> list[list[int]]:
    """Codes of ``data`` (8-bit samples), one list for each stretch between clear codes."""
    runs, codes, free = [], [], 258
    following: list[dict[int, int] | None] = [None] * MAX_CODES  # of each code: next byte -> longer code
    held = data[0]
    for byte in data[1:]:
        longer = following[held]
        if longer is None:
            longer = following[held] = {}
        elif (code := longer.get(byte)) is not None:
            held = code
            continue
        codes.append(held)
        held = byte
        if free == MAX_CODES - 1:
            codes.append(256)
            runs.append(codes)
            codes, free, following = [], 258, [None] * MAX_CODES
        else:
            longer[byte] = free
            free += 1
    runs.append([*codes, held, 257])
    return runs


def lzw_encode(data: bytes) -> bytes:
    runs = _lzw_codes(data)
    codes = np.concatenate([np.array([256], np.int64), *(np.array(r, np.int64) for r in runs)])
    ends = np.cumsum(np.concatenate([np.array([9]), *(_WIDTHS[8][: len(r)] for r in runs)]))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    n_bytes, at, shifted = int(ends[-1] + 7) // 8, starts >> 3, codes << (starts & 7)
    out = np.zeros(n_bytes + 3)
    for i in range(3):  # a code touches three bytes at most, and no bit is set twice
        out[i:] += np.bincount(at, (shifted >> 8 * i) & 255, n_bytes + 3 - i)
    return out[:n_bytes].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, code_bits: int, n_samples: int) -> bytes:
    """Samples of an LZW code stream; stops at the end code, at ``n_samples`` or where the stream ends."""
    clear, end = 1 << code_bits, (1 << code_bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    n_bits = 8 * len(stream)
    fixed = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    have, at, table_, previous = 0, 0, fixed[:], None
    read = 0  # codes since the last clear code
    while have < n_samples and at < n_bits:
        widths = _WIDTHS[code_bits][min(read, MAX_CODES) :][: min(MAX_CODES, (n_bits - at) // (code_bits + 1) + 1)]
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, n_bits, side="right"))
        if not n:
            break
        starts, widths = (ends - widths)[:n], widths[:n]
        codes = words[starts >> 3] >> (starts & 7) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        todo = codes[:stop].tolist()
        if previous is None and todo:
            previous = table_[todo[0]] if todo[0] < clear else b""
            out.append(previous)
            todo = todo[1:]
        for code in todo:
            try:
                entry = table_[code]
            except IndexError:
                entry = previous + previous[:1]
            if not entry or code > len(table_):
                raise ValueError("LZW code out of range")
            out.append(entry)
            if len(table_) < MAX_CODES:
                table_.append(previous + entry[:1])
            previous = entry
        have = sum(map(len, out))
        if stop == n:
            at, read = int(ends[n - 1]), read + n
        elif codes[stop] == end:
            break
        else:
            at, read, table_, previous = int(ends[stop]), 0, fixed[:], None
    return b"".join(out)[:n_samples]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: bytes  # palette indices, row by row
    palette: np.ndarray  # (n, 3) uint8
    canvas: np.ndarray | None = None  # (screen height, screen width, 4) after drawing


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _interlaced_rows(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes, draw: bool = True) -> tuple[int, int, list[Frame]]:
    """Screen width and height, and the frames; with ``draw`` each has the canvas as shown during its delay."""
    try:
        return _decode_gif(data, draw)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("truncated GIF") from e


def _decode_gif(data: bytes, draw: bool) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    screen_w, screen_h, flags = struct.unpack_from("<HHB", data, 6)
    if screen_w * screen_h > MAX_PIXELS:
        raise ValueError("screen too large")
    at, shared = 13, np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            block, at = _sub_blocks(data, at + 2)
            if kind == 0xF9:
                control, hundredths, index = struct.unpack_from("<BHB", block)
                delay, disposal = hundredths * 10, control >> 2 & 7
                transparent = index if control & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, width, height, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if width * height > MAX_PIXELS:
            raise ValueError("frame too large")
        code_bits = data[at]
        stream, at = _sub_blocks(data, at + 1)
        samples = lzw_decode(stream, code_bits, width * height)
        if len(samples) < width * height:
            raise ValueError("too few samples")
        if flags & 0x40:
            rows = np.frombuffer(samples, np.uint8).reshape(height, width)
            placed = np.empty_like(rows)
            placed[_interlaced_rows(height)] = rows
            samples = placed.tobytes()
        frames.append(Frame(left, top, width, height, delay, disposal, transparent, samples, palette))
        delay, disposal, transparent = 0, 0, None
    if draw:
        for f, canvas in drawn_frames(screen_w, screen_h, frames):
            f.canvas = canvas.copy()
    return screen_w, screen_h, frames


def drawn_frames(screen_w: int, screen_h: int, frames: list[Frame]) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with the canvas as shown during its delay; it is the same array each time, drawn over for the next."""
    canvas = np.zeros((screen_h, screen_w, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        box = np.s_[f.top : f.top + f.height, f.left : f.left + f.width]
        index = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)[: max(0, screen_h - f.top), : max(0, screen_w - f.left)]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        drawn = colours[index]
        if f.transparent is not None:
            drawn = np.where((index == f.transparent)[:, :, None], canvas[box], drawn)
        canvas[box] = drawn
        yield f, canvas
        if f.disposal == 2:
            canvas[box] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels in each of 64 colour bins."""
    opaque = canvas[canvas[:, :, 3] > 0]
    bins = (opaque[:, 0] >> 6).astype(np.int64) * 16 + (opaque[:, 1] >> 6) * 4 + (opaque[:, 2] >> 6)
    return np.bincount(bins, minlength=BINS).tolist()


#: Entry i has colour (i, a bit-rotated i, 255 - i): all 256 samples have colours of their own.
_PALETTE = np.stack([np.arange(256), (np.arange(256) * 8 + np.arange(256) // 32) % 256, 255 - np.arange(256)], 1).astype(np.uint8)


def encode_samples(samples: bytes) -> bytes:
    """A GIF whose frames hold ``samples``, a positive multiple of 192, in order: 192 columns, up to 64 rows each."""
    n_rows = len(samples) // WIDTH
    out = [struct.pack("<6sHHBBB", b"GIF89a", WIDTH, min(n_rows, FRAME_ROWS), 0xF7, 0, 0), _PALETTE.tobytes()]
    for row in range(0, n_rows, FRAME_ROWS):
        rows = min(FRAME_ROWS, n_rows - row)
        stream = lzw_encode(samples[row * WIDTH : (row + rows) * WIDTH])
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2, DELAY_CS, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, rows, 0, 8))
        out += [bytes([len(b := stream[i : i + 255])]) + b for i in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b";"])


def encode_payload(text: Column) -> Column:
    """Binary GIF of a text: UTF-8, padded with spaces to a positive multiple of 192 (NULL: empty)."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bytes:
            raw = (t or "").encode()
            return encode_samples(raw + b" " * (WIDTH - len(raw) % WIDTH if not raw or len(raw) % WIDTH else 0))

        return texts.map(one, na_action=None)

    return run(text)


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, error string, frames array<struct<start_ms:long,delay_ms:long,histogram:array<long>>>"


def read_payload(media: Column) -> Column:
    """Decode a GIF column: the payload's size and digests, the stored form's, a feature text of all frames, and the timed frames.

    ``frames`` has the start, the delay and the colour histogram of each frame's
    canvas, in order. A NULL gives NULLs. A broken GIF, or one with a screen or frame of more
    than ``MAX_PIXELS``, gives the stored form's size and digest and the error.
    """

    def one(blob: bytes | None) -> tuple:
        if blob is None:
            return (None,) * 9
        stored = len(blob), hashlib.sha256(blob).hexdigest()
        try:
            w, h, found = decode_gif(blob, draw=False)
        except ValueError as e:
            return None, None, None, *stored, None, None, str(e), None
        payload = b"".join(f.samples for f in found)
        timed, start, colours = [], 0, np.zeros(BINS, np.int64)
        for f, canvas in drawn_frames(w, h, found):
            timed.append({"start_ms": start, "delay_ms": f.delay_ms, "histogram": histogram(canvas)})
            start += f.delay_ms
            colours += timed[-1]["histogram"]
        feature = json.dumps({"screen": [w, h], "frames": len(found), "ms": start, "colours": colours.tolist()}, separators=(",", ":"))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, feature, len(found), None, timed

    @F.pandas_udf(_READ)
    def run(blobs: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(b) for b in blobs], columns=[c.split()[0] for c in _READ.split(", ")])
        whole = ["payload_bytes", "tail_crc32", "media_bytes", "n_frames"]
        return out.astype(dict.fromkeys(whole, "Int64"))

    return run(media)


_FRAME = "frame_no int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, transparent int, histogram array<long>, rgba_sha256 string, error string"


def frames(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per timed frame of each GIF: (key, frame_no, start_ms, delay_ms, box, disposal, transparent, histogram, rgba_sha256).

    A broken stream gives one row with only ``error`` set; a NULL none.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {_FRAME}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, blob in zip(batch[key], batch[media], strict=True):
                try:
                    w, h, found = decode_gif(blob, draw=False)
                except ValueError as e:
                    rows.append([k, *[None] * 11, str(e)])
                    continue
                start = 0
                for i, (f, canvas) in enumerate(drawn_frames(w, h, found)):
                    rows.append([k, i, start, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, histogram(canvas), hashlib.sha256(canvas.tobytes()).hexdigest(), None])
                    start += f.delay_ms
            out = pd.DataFrame(rows, columns=names)
            for c in names[1:10]:
                out[c] = out[c].astype("Int64")
            yield out

    return df.select(key, media).where(F.col(media).isNotNull()).mapInPandas(run, schema)


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), encode_payload(F.col("text")).alias("media"))
    return stored.select("doc_id", "n_bytes", read_payload(F.col("media")).alias("r")).select("doc_id", "n_bytes", "r.*")

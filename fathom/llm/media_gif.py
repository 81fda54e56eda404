"""GIF media columns: texts as animations, decoded frame by frame.

encode() writes payload bytes as palette indices of a grey ramp, WIDTH pixels a row, at most HEIGHT rows a
frame, each frame compressed by LZW. decode() reads any GIF: logical screen, global and local palettes,
interlacing, graphic controls (delay, disposal, transparency) and LZW code streams. composed() draws the
frames onto the canvas in turn and yields what is shown.

Null texts are empty; an empty text is one unit of padding; long texts have more frames; equal texts give
equal files; repeated rows give repeated rows; an empty table gives none; other columns are ignored. decode() raises
ValueError for a broken file, and for one whose canvas or frames have more than MOST_PIXELS (a header of 13 bytes may ask for
17 GB); timed_frames() gives such a file one row with its error and goes on. A null file has no rows.
"""

from __future__ import annotations

import hashlib
import threading
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import reachable, table

UNIT = 576
WIDTH, HEIGHT = 96, 96
DELAY_CS = 10
#: Levels of each colour in a histogram.
LEVELS = 4
BINS = LEVELS**3
MOST_PIXELS = 1 << 26
CLEAR, END = 256, 257
RAMP = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


def code_widths(bits: int, n: int) -> np.ndarray:
    """Width of the j-th code after a clear: the table holds j - 1 new entries by then, and 12 bits are the most."""
    held = (1 << bits) + 2 + np.maximum(0, np.arange(n) - 1)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(held)).astype(np.int64) + 1))


#: No more codes than these differ in width; the rest have 12 bits.
BLOCK = 4100
_WIDTHS = code_widths(8, BLOCK)
#: Pixels that a numpy pass expands at a time.
GROUP = 1 << 16
_local = threading.local()


def lzw_encode(pixels: bytes) -> bytes:
    """The code stream of 8-bit pixels; the table is cleared when it is full."""
    if not hasattr(_local, "table"):
        _local.table = [0] * (4096 << 8)
    # codes stand as code << 8; table[code << 8 | pixel] is the longer entry, or 0, and all zeros again in the end
    table, limit = _local.table, 4096 << 8
    puts, runs, free, last, at = [CLEAR << 8], [1], 258 << 8, pixels[0] * 256, 1
    try:
        while at < len(pixels):
            room = (limit - free) >> 8
            for b in pixels[at : at + room]:
                key = last + b
                last = table[key]
                if not last:
                    puts.append(key)
                    table[key] = free
                    free += 256
                    last = b * 256
            at += room
            while free == limit and at < len(pixels):
                key = last + pixels[at]
                last = table[key]
                if not last:
                    for k in puts[runs[-1] :]:
                        table[k] = 0
                    puts += [key, CLEAR << 8]
                    runs.append(len(puts))
                    free, last = 258 << 8, pixels[at] * 256
                at += 1
    finally:
        for k in puts[runs[-1] :]:
            table[k] = 0
    puts += [last, END << 8]
    codes = np.fromiter(puts, np.int64, len(puts)) >> 8
    widths = np.concatenate([_WIDTHS[:1], *(_WIDTHS[:k] for k in np.diff([*runs, len(codes)]))])
    ends = np.cumsum(widths)
    where = ends - widths
    # a code has 9 bits or more, so no two begin in the same byte
    codes <<= where & 7
    where >>= 3
    out = np.zeros((int(ends[-1]) >> 3) + 3, np.uint8)
    for k in range(3):
        out[where + k] |= (codes >> 8 * k).astype(np.uint8)
    return out[: (int(ends[-1]) + 7) >> 3].tobytes()


def _expand(codes: np.ndarray, clear: int, out: np.ndarray, at: int) -> int:
    """Writes the phrases of codes between two clears to out[at:], as far as it goes; returns where they end.

    An entry is the phrase of the code it was made after and the pixel that follows, so a code's phrase stands in the
    output already (from the start of that earlier code) and pointers to there, doubled until they rest, lead to literals.
    """
    entry, own = codes - clear - 2, np.arange(len(codes))
    if codes[0] >= clear:
        raise ValueError("a code stream starts with an unknown code")
    if (entry >= own).any():
        raise ValueError("a code stream has an unknown code")
    literal = entry < 0
    entry = np.where(literal, own, entry)
    up, size = entry, (~literal).astype(np.int64)
    while (more := size.take(up)).any():
        size += more
        up = up.take(up)
    size += 1
    ends = at + np.cumsum(size)
    start = ends - size
    back = start - start[entry]
    # a pointer goes down its phrase's entries, then down those of the phrase after one of them
    steps = (2 * int(size.max())).bit_length()
    i, needed = 0, int(np.searchsorted(start, len(out)))
    while i < needed:
        a = int(start[i])
        j = min(needed, int(np.searchsorted(start, a + GROUP)))
        b = int(ends[j - 1])
        pixel = np.arange(b - a)
        source, value = pixel - np.repeat(back[i:j], size[i:j]), np.zeros(b - a, np.uint8)
        plain = np.flatnonzero(literal[i:j]) + i
        value[start[plain] - a] = codes[plain]
        if i:
            before = np.flatnonzero(source < 0)
            value[before] = out[a + source[before]]
            source[before] = before
        for _ in range(steps):
            source = source.take(source)
        out[a:b] = value[source][: len(out) - a]
        i = j
    return int(ends[-1])


def lzw_decode(data: bytes, bits: int, n: int) -> bytes:
    """The first n pixels of a code stream whose literals have `bits` bits; what follows their codes and the next clear is not read."""
    clear, end = 1 << bits, (1 << bits) + 1
    widths = _WIDTHS if bits == 8 else code_widths(bits, BLOCK)
    ends = np.cumsum(widths)
    words = np.ndarray(len(data) + 1, "<u4", data + b"\0\0\0\0", strides=(1,))  # four bytes from each byte on
    out, size, at, stop = np.empty(n, np.uint8), 0, 0, clear
    while size < n and stop == clear:
        got, read, stop = [], 0, None
        while stop is None and size + read < n + 1:
            if read:
                w = np.full(min(BLOCK, (len(data) * 8 - at) // 12), 12)
                upto = np.arange(12, 12 * len(w) + 1, 12)
            else:
                upto = ends[: np.searchsorted(ends, len(data) * 8 - at, side="right")]
                w = widths[: len(upto)]
            if not len(w):
                break
            where = at + upto - w
            codes = words[where >> 3] >> (where & 7) & ((1 << w) - 1)
            stops = np.flatnonzero(codes >> 1 == clear >> 1)
            k = int(stops[0]) if len(stops) else len(codes) - 1
            stop, at = int(codes[k]) if len(stops) else None, at + int(upto[k])
            got.append(codes[:k] if len(stops) else codes)
            read += len(got[-1])
        if read:
            size = _expand(np.concatenate(got), clear, out, size)
    if size < n:
        raise ValueError("a code stream is too short")
    return out.tobytes()


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame]


def encode(payload: bytes) -> bytes:
    """A GIF whose frames hold `payload`, whose length is a positive multiple of WIDTH."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"the payload is no positive multiple of {WIDTH} bytes")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), min(rows, HEIGHT).to_bytes(2, "little"), b"\xf7\0\0", RAMP.tobytes()]
    for top in range(0, rows, HEIGHT):
        part = payload[top * WIDTH : (top + HEIGHT) * WIDTH]
        stream = lzw_encode(part)
        out += [b"\x21\xf9\x04\x08", DELAY_CS.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", WIDTH.to_bytes(2, "little"), (len(part) // WIDTH).to_bytes(2, "little"), b"\0\x08"]
        for i in range(0, len(stream), 255):
            block = stream[i : i + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> Gif:
    """All frames of a GIF file."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF header")
    number = lambda i: data[i] | data[i + 1] << 8
    out, at, shared = Gif(number(6), number(8), []), 13, None
    if out.width * out.height > MOST_PIXELS:
        raise ValueError(f"a canvas of {out.width} x {out.height}")

    def palette(flags: int, i: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if i + 3 * n > len(data):
            raise ValueError("the file ends early")
        colours = np.zeros((256, 3), np.uint8)
        colours[:n] = np.frombuffer(data, np.uint8, 3 * n, i).reshape(n, 3)
        return colours, i + 3 * n

    def parts(i: int) -> tuple[bytes, int]:
        got = []
        while n := data[i]:
            got.append(data[i + 1 : i + 1 + n])
            i += n + 1
        return b"".join(got), i + 1

    if data[10] & 0x80:
        shared, at = palette(data[10], at)
    control: dict = {}
    try:
        while data[at] != 0x3B:
            if data[at] == 0x21:
                block, after = parts(at + 2)
                if data[at + 1] == 0xF9:
                    control = {"disposal": block[0] >> 2 & 7, "delay_cs": block[1] | block[2] << 8, "transparent": block[3] if block[0] & 1 else None}
                at = after
            elif data[at] == 0x2C:
                left, top, width, height, flags = number(at + 1), number(at + 3), number(at + 5), number(at + 7), data[at + 9]
                colours, at = palette(flags, at + 10) if flags & 0x80 else (shared, at + 10)
                bits = data[at]
                if not 1 <= bits <= 8 or width * height > MOST_PIXELS:
                    raise ValueError(f"a frame of {width} x {height} with codes of {bits} bits")
                stream, at = parts(at + 1)
                pixels = np.frombuffer(lzw_decode(stream, bits, width * height), np.uint8).reshape(height, width)
                if flags & 0x40:
                    straight = np.empty_like(pixels)
                    straight[np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])] = pixels
                    pixels = straight
                if colours is None:
                    raise ValueError("a frame has no palette")
                out.frames.append(Frame(left, top, width, height, pixels, colours, **control))
                control = {}
            else:
                raise ValueError("unknown block")
    except IndexError:
        raise ValueError("the file ends early") from None
    return out


def composed(gif: Gif) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The RGB canvas and its mask of drawn pixels after each frame, by the disposal and transparency rules."""
    canvas, drawn = np.zeros((gif.height, gif.width, 3), np.uint8), np.zeros((gif.height, gif.width), bool)
    for f in gif.frames:
        area = slice(f.top, min(f.top + f.height, gif.height)), slice(f.left, min(f.left + f.width, gif.width))
        before = (canvas.copy(), drawn.copy()) if f.disposal == 3 else None
        seen = f.indices[: area[0].stop - f.top, : area[1].stop - f.left]
        if f.transparent is None:
            canvas[area], drawn[area] = f.palette.take(seen, axis=0), True
        else:
            solid = seen != f.transparent
            canvas[area][solid], drawn[area][solid] = f.palette.take(seen[solid], axis=0), True
        yield canvas, drawn
        if f.disposal == 2:
            canvas[area], drawn[area] = 0, False
        elif before:
            canvas, drawn = before


def histogram(canvas: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Drawn pixels by colour: LEVELS equal ranges of red, by those of green, by those of blue."""
    pixels = canvas.reshape(-1, 3) if drawn.all() else canvas[drawn]
    level = pixels // (256 // LEVELS)
    return np.bincount(level[:, 0] * np.uint8(LEVELS * LEVELS) + level[:, 1] * np.uint8(LEVELS) + level[:, 2], minlength=BINS)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


def payload_of(gif: Gif) -> tuple[bytes, np.ndarray]:
    """The samples that the frames show, in order, and their histogram."""
    got, counts = [], np.zeros(BINS, np.int64)
    for f, (canvas, drawn) in zip(gif.frames, composed(gif), strict=True):
        got.append(canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
        counts += histogram(canvas, drawn)
    return b"".join(got), counts


def _arrow(docs: DataFrame, schema: str, kinds: list[pa.DataType], rows) -> DataFrame:
    reachable(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [r for i, x in zip(part.column(0).to_pylist(), part.column(1), strict=True) for r in rows(i, x.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.mapInArrow(run, schema)


def media(docs: DataFrame) -> DataFrame:
    """doc_id and the GIF of each text."""
    return _arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, media binary", [pa.int64(), pa.binary()], lambda i, t: [(i, encode(padded(t)[0]))])


def timed_frames(files: DataFrame) -> DataFrame:
    """One row per frame of (doc_id, media): when it shows, for how long, its size and its colour histogram; or a file's error."""

    def rows(i, data):
        if data is None:
            return
        try:
            gif, at = decode(data), 0
        except ValueError as e:
            yield i, None, None, None, None, None, None, str(e)
            return
        for k, (f, shown) in enumerate(zip(gif.frames, composed(gif), strict=True)):
            yield i, k, at * 10, f.delay_cs * 10, f.width, f.height, histogram(*shown).tolist(), None
            at += f.delay_cs

    schema = "doc_id long, frame int, at_ms long, delay_ms long, width int, height int, histogram array<long>, error string"
    return _arrow(files.select(F.col("doc_id").cast("long").alias("doc_id"), "media"), schema, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()], rows)


def media_digests(docs: DataFrame) -> DataFrame:
    """The digests of each text's GIF, all computed from the file read back."""

    def rows(i, text):
        payload, n = padded(text)
        data = encode(payload)
        gif = decode(data)
        back, counts = payload_of(gif)
        feature = f"{len(gif.frames)}f{sum(f.delay_cs for f in gif.frames)}cs:" + ",".join(map(str, counts.tolist()))
        yield i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], rows)


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))

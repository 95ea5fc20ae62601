"""GIF media columns: timed frames with colour histograms, read from and written to LZW code streams.

The reader takes any GIF87a or GIF89a stream: global and local palettes, interlaced
images, transparency, the disposal methods and deferred clear codes. The writer stores
bytes as 8-bit indices into a grey palette, so that the composed frames give them back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.text import slices, utf8

WIDTH, ROWS = 192, 256
DELAY = 10  # hundredths of a second
GREY = bytes(x for i in range(256) for x in (i, i, i))
BINS = 8


@dataclass
class Frame:
    """A composed frame: RGB canvas, the rectangle that it drew, and its time."""

    canvas: np.ndarray
    box: tuple[int, int, int, int]  # left, top, width, height
    delay_ms: int
    disposal: int


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the i-th code after a clear code, for minimum code size `size`."""
    filled = (1 << size) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(filled)).astype(np.int64) + 1, size + 1, 12)


_plan: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets of the codes of one table's life."""
    if size not in _plan:
        widths = _widths(size, 4096)
        _plan[size] = widths, np.concatenate(([0], np.cumsum(widths)))
    return _plan[size]


def lzw_encode(data: bytes) -> bytes:
    """The code stream for 8-bit samples: greedy longest match, a clear code when the table is full."""
    codes, segment = [256], [0]
    append, table, free = codes.append, {}, 258
    get, reach = table.get, iter(data)
    string = next(reach, None)
    if string is not None:
        for c in reach:
            key = string << 8 | c
            known = get(key)
            if known is None:
                append(string)
                if free < 4096:
                    table[key] = free
                    free += 1
                else:
                    append(256)
                    segment.append(len(codes) - 1)
                    table.clear()
                    free = 258
                string = c
            else:
                string = known
        append(string)
    append(257)
    value = np.array(codes, np.int64)
    widths, _ = _layout(8)
    position = np.arange(len(value)) - 1
    for at in segment[1:]:
        position[at + 1 :] = np.arange(len(value) - at - 1)
    bits = widths[np.maximum(position, 0)]
    starts = np.cumsum(bits) - bits
    total = int(starts[-1] + bits[-1])
    shifted, byte = value << (starts & 7), starts >> 3
    size = (total + 7) // 8 + 3
    out = np.bincount(byte, shifted & 255, size) + np.bincount(byte + 1, (shifted >> 8) & 255, size) + np.bincount(byte + 2, shifted >> 16, size)
    return out[: (total + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """At most `most` samples of a code stream with minimum code size `size` (2 to 11).

    Codes are cut from the stream a table's life at a time with NumPy; the table of
    strings is then walked code by code. A code beyond the table is an error.
    """
    if not 1 <= size <= 11:
        raise ValueError(f"minimum code size {size}")
    clear, stop = 1 << size, (1 << size) + 1
    data = np.concatenate((np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8))).astype(np.int64)
    end = 8 * len(stream)
    widths, offsets = _layout(size)
    roots = [bytes((i,)) if i < 256 else b"" for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, n, ended = 0, 0, False
    while not ended and n < most and at < end:
        table, previous, first = roots.copy(), b"", True
        tail = 0  # codes after the table is full keep 12 bits
        while True:
            if tail == 0:
                fit = int(np.searchsorted(offsets, end - at, "right")) - 1
                bits, starts = widths[:fit], at + offsets[:fit]
            else:
                fit = min(4096, (end - at) // 12)
                bits, starts = np.full(fit, 12), at + 12 * np.arange(fit)
            if fit <= 0:
                ended = True
                break
            byte = starts >> 3
            word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
            codes = (word >> (starts & 7)) & ((1 << bits) - 1)
            marks = np.flatnonzero((codes == clear) | (codes == stop))
            taken = int(marks[0]) if len(marks) else fit
            add, known = out.append, len(table)
            for code in codes[:taken].tolist():
                if code < known:
                    entry = table[code]
                    if not first and known < 4096:
                        table.append(previous + entry[:1])
                        known += 1
                elif code == known and not first and known < 4096:
                    entry = previous + previous[:1]
                    table.append(entry)
                    known += 1
                else:
                    raise ValueError(f"code {code} of {known}")
                first = False
                add(entry)
                previous = entry
            if len(marks):
                at = int(starts[taken] + bits[taken])
                ended = codes[taken] == stop
                break
            at = int(starts[-1] + bits[-1])
            tail = 1
        n = sum(map(len, out)) if most < 1 << 20 or len(out) > 1 << 16 else 0
    return b"".join(out)[:most]


def write_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the payload, a whole number of rows, row by row."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\x00\x00", GREY]
    step = width * rows
    for start in range(0, len(payload), step):
        part = payload[start : start + step]
        out.append(b"\x21\xf9\x04\x04" + delay.to_bytes(2, "little") + b"\x00\x00")  # leave the frame in place
        out.append(b"\x2c\x00\x00\x00\x00" + width.to_bytes(2, "little") + (len(part) // width).to_bytes(2, "little") + b"\x00\x08")
        stream = lzw_encode(part)
        out.extend(bytes((len(x),)) + x for x in (stream[i : i + 255] for i in range(0, len(stream), 255)))
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


#: Pixels that a canvas may have at most, unless the caller says otherwise: a header alone can ask for billions.
MOST_PIXELS = 1 << 24


def _bounded(wide: int, high: int, most: int) -> None:
    if wide * high > most:
        raise ValueError(f"a canvas of {wide} x {high} is beyond {most} pixels")


def read_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """Frames in order, each composed as a viewer would show it; a canvas or frame of more pixels than allowed is an error."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    wide, high = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    flags, at = data[10], 13
    shared = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    _bounded(wide, high, most_pixels)
    canvas = np.zeros((high, wide, 3), np.uint8)
    delay = disposal = 0
    clear: int | None = None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                packed = data[at + 3]
                disposal, delay = packed >> 2 & 7, 10 * int.from_bytes(data[at + 4 : at + 6], "little")
                clear = data[at + 6] if packed & 1 else None
            at = _blocks(data, at + 2)[1]
            continue
        if kind != 0x2C:
            raise ValueError(f"block {kind:#x}")
        left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
        flags, at = data[at + 9], at + 10
        _bounded(max(left + w, canvas.shape[1]), max(top + h, canvas.shape[0]), most_pixels)
        palette = shared
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        if palette is None:
            raise ValueError("no palette")
        size = data[at]
        stream, at = _blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8)
        if len(samples) < w * h:
            raise ValueError("the image ends early")
        image = samples.reshape(h, w)
        if flags & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            rows = np.empty_like(image)
            rows[order] = image
            image = rows
        before = canvas.copy() if disposal == 3 else None
        if top + h > canvas.shape[0] or left + w > canvas.shape[1]:
            grown = np.zeros((max(canvas.shape[0], top + h), max(canvas.shape[1], left + w), 3), np.uint8)
            grown[: canvas.shape[0], : canvas.shape[1]] = canvas
            canvas = grown
        area = canvas[top : top + h, left : left + w]
        if clear is None:
            area[:] = palette[np.minimum(image, len(palette) - 1)]
        else:
            seen = image != clear
            area[seen] = palette[np.minimum(image[seen], len(palette) - 1)]
        yield Frame(canvas.copy(), (left, top, w, h), delay, disposal)
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, None


def histogram(pixels: np.ndarray, bins: int = BINS) -> list[int]:
    """Counts of each channel's values in equal ranges, red then green then blue."""
    flat = pixels.reshape(-1, 3)
    return [int(x) for c in range(3) for x in np.bincount(flat[:, c].astype(np.int64) * bins // 256, minlength=bins)]


def payload_of(text: bytes, width: int = WIDTH) -> bytes:
    """The text with spaces appended up to a positive multiple of the width."""
    return text + b" " * (max(1, -(-len(text) // width)) * width - len(text))


def drawn(frame: Frame) -> bytes:
    """The bytes that a grey frame holds: what it drew, read from the composed canvas."""
    left, top, w, h = frame.box
    return frame.canvas[top : top + h, left : left + w, 0].tobytes()


FRAMES = "frame int, start_ms long, delay_ms long, width int, height int, disposal int, histogram array<long>"


def gif_frames(df: DataFrame, key: str, column: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row for each frame of each GIF of a binary column: time, canvas, colour histogram.

    Null and empty values have no frames. A damaged file gives the frames before the
    damage and then one row that has only `error`; so does one whose canvas has more than `most_pixels`.
    """
    kind = df.schema[key].dataType.simpleString()
    given = df.select(key, column)
    fields = [("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 1 << 20):
            at: list[int] = []
            rows: list[tuple] = []
            for i, data in enumerate(utf8(batch.column(1))):
                start, n = 0, 0
                try:
                    for n, f in enumerate(read_gif(data, most_pixels) if data else ()):
                        rows.append((n, start, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.disposal, histogram(f.canvas), None))
                        at.append(i)
                        start += f.delay_ms
                except (ValueError, IndexError) as e:
                    rows.append((None,) * 7 + (str(e),))
                    at.append(i)
            columns = [pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, *(n for n, _ in fields)])

    return given.mapInArrow(run, f"`{key}` {kind}, {FRAMES}, error string")


def store_texts(df: DataFrame, key: str = "doc_id", column: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each text as a GIF, read it back and describe what was read.

    A null text counts as empty; the smallest payload is one row of spaces. Rows repeat
    as they come in, equal texts with equal values. Other columns are left out, so no
    name clashes. Adds `media` (the file) unless `keep_media` is false.
    """
    kind = df.schema[key].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media

    def one(text: bytes) -> tuple:
        media = write_gif(payload_of(text))
        parts, bins, spent, n = [], np.zeros(BINS, np.int64), 0, 0
        for n, frame in enumerate(read_gif(media), 1):
            part = drawn(frame)
            parts.append(part)
            bins += np.bincount(np.frombuffer(part, np.uint8) >> 5, minlength=BINS)
            spent += frame.delay_ms
        back = b"".join(parts)
        feature = f"frames={n};ms={spent};histogram={','.join(map(str, bins))}"
        got = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*got, media) if keep_media else got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            made: dict[bytes, tuple] = {}  # of this slice alone: copies often follow one another
            rows = [made.get(t) or made.setdefault(t, one(t)) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], [key, *names])

    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(key, column).mapInArrow(run, schema + ", media binary" * keep_media)


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)


SQL: dict[str, str] = {}
QUERIES = {"op10_gif_media": op10_gif_media}

"""GIF columns: frames written and read without an image library.

Reading follows the 87a and 89a formats: LZW code streams of any starting size, global and local palettes, interlacing,
transparency, and the four ways a frame is disposed of. The work of a row is bounded by its own image; rows are independent.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CODES = 4096
BINS = 64


@lru_cache(maxsize=16)
def _widths(min_size: int) -> np.ndarray:
    """Bits of the k-th code after a clear code: a code is added to the table after each but the first."""
    free = (1 << min_size) + 2 + np.maximum(np.arange(2 * MOST_CODES) - 1, 0)
    return np.minimum(np.floor(np.log2(np.maximum(free, 1 << min_size))).astype(np.int64) + 1, 12)


def lzw_pack(data: bytes, min_size: int = 8) -> bytes:
    """The LZW code stream of ``data`` (values below 2**min_size)."""
    clear = 1 << min_size
    full = MOST_CODES - clear - 2 - 1  # codes between two clear codes
    widths = _widths(min_size)
    runs: list[list[int]] = []
    if data:
        table: dict[int, int] = {}
        get, codes = table.get, []
        add, free, at = codes.append, clear + 2, data[0]
        for c in memoryview(data)[1:]:
            key = at << 8 | c
            found = get(key)
            if found is None:
                add(at)
                table[key] = free
                free += 1
                at = c
                if len(codes) == full:
                    runs.append(codes)
                    codes = []
                    add = codes.append
                    table.clear()
                    free = clear + 2
            else:
                at = found
        add(at)
        runs.append(codes)
    values = [np.array([clear])]
    sizes = [np.array([min_size + 1])]
    for k, codes in enumerate(runs):
        last = clear + 1 if k == len(runs) - 1 else clear
        values.append(np.array([*codes, last]))
        sizes.append(widths[: len(codes) + 1])
    if not runs:
        values.append(np.array([clear + 1]))
        sizes.append(np.array([min_size + 1]))
    value, size = np.concatenate(values), np.concatenate(sizes)
    ends = np.cumsum(size)
    start = ends - size
    shifted, at_byte = value << (start & 7), start >> 3
    n = int(ends[-1] + 7) >> 3
    out = np.zeros(n + 3, np.int64)
    for k in range(3):  # no two codes share a bit, so sums are as good as ors
        out[k : k + at_byte[-1] + 1] += np.bincount(at_byte, (shifted >> 8 * k) & 255).astype(np.int64)
    return out[:n].astype(np.uint8).tobytes()


def _runs(data: bytes, min_size: int) -> list[np.ndarray]:
    """The codes of a stream, cut at its clear codes, up to its end code or its last whole code."""
    clear = 1 << min_size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int32)
    bits, bit, k, runs = 8 * len(data), 0, 0, [[]]
    while True:
        size = _widths(min_size)[k : k + MOST_CODES] if k < MOST_CODES else _widths(min_size)[-MOST_CODES:]
        size = size[: (bits - bit) // (min_size + 1) + 1]
        end = bit + np.cumsum(size)
        n = int(np.searchsorted(end, bits, "right"))
        if not n:
            break
        size, start = size[:n], end[:n] - size[:n]
        at = start >> 3
        codes = ((raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16) >> (start & 7)) & ((1 << size) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(marks):
            runs[-1].append(codes)
            bit, k = int(end[n - 1]), k + n
            continue
        stop = int(marks[0])
        runs[-1].append(codes[:stop])
        if codes[stop] == clear + 1:
            break
        bit, k = int(end[stop]), 0
        runs.append([])
    return [np.concatenate(r) for r in runs if r]


def lzw_unpack(data: bytes, min_size: int, most: int) -> bytes:
    """At most ``most`` values of an LZW code stream. A stream that breaks off gives what it holds; a code that cannot stand raises.

    The table entry made after the k-th code is that code's string and the first value of the next one. So a code that names
    this entry is a link to k, a string's length is the length of its chain of links, and its values, from the last to the
    first, are the first values of the codes after those linked to. All chains are walked at once.
    """
    runs = [r for r in _runs(data, min_size) if len(r)]
    if not runs:
        return b""
    first = (1 << min_size) + 2
    codes = np.concatenate(runs)
    base = np.repeat(np.cumsum([0, *map(len, runs[:-1])]), list(map(len, runs)))
    link = np.where(codes >= first, codes - first + base, -1)
    if (link >= np.arange(len(codes))).any() or ((codes >= first) & (link < base)).any():
        raise ValueError("a code that is not in the table")
    length, root = np.ones(len(codes), np.int64), np.arange(len(codes))
    at = np.flatnonzero(link >= 0)
    to = link[at]
    while len(at):
        length[at] += 1
        root[at] = to
        to = link[to]
        more = to >= 0
        at, to = at[more], to[more]
    head = codes[root].astype(np.uint8)
    place = np.cumsum(length) - 1
    out = np.empty(int(place[-1]) + 1, np.uint8)
    follow = np.concatenate([head[1:], head[:1]])  # the first value of the code after
    literal = link < 0
    out[place[literal]] = head[literal]
    to, place = link[~literal], place[~literal]
    while len(to):
        out[place] = follow[to]
        place = place - 1
        on = link[to]
        done = on < 0
        out[place[done]] = head[to[done]]
        more = ~done
        to, place = on[more], place[more]
    return out.tobytes()[:most]


@dataclass
class Frame:
    """One picture: its place, the palette numbers as stored (rows in order), and how it is shown."""

    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


def _blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


def write_gif(width: int, height: int, palette: np.ndarray, frames: list[Frame]) -> bytes:
    """A GIF 89a with one global palette (its length a power of two); a frame with a palette of its own gets a local one."""
    depth = max(1, int(palette.shape[0] - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | depth - 1, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0, 0))
        own = f.palette is not palette
        bits = max(1, int(f.palette.shape[0] - 1).bit_length())
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, (0x80 | bits - 1) if own else 0))
        if own:
            out.append(f.palette.astype(np.uint8).tobytes())
        size = max(2, bits)
        out.append(bytes([size]) + _blocks(lzw_pack(f.indices.astype(np.uint8).tobytes(), size)))
    out.append(b"\x3b")
    return b"".join(out)


def _chain(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _interlaced(rows: np.ndarray) -> np.ndarray:
    h = len(rows)
    order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def palette(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 3 << (flags & 7) + 1
        return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n

    common, at = palette(flags, at)
    frames, delay, disposal, transparent = [], 0, 0, None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _chain(data, at + 2)
            if label == 0xF9:
                how, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = how >> 2 & 7, index if how & 1 else None
        elif kind == 0x2C:
            left, top, w, h, how = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = palette(how, at + 10)
            size = data[at]
            body, at = _chain(data, at + 1)
            values = np.frombuffer(lzw_unpack(body, size, w * h), np.uint8)
            if len(values) < w * h:
                raise ValueError("a frame that breaks off")
            rows = values.reshape(h, w)
            frames.append(Frame(left, top, w, h, _interlaced(rows) if how & 0x40 else rows, common if own is None else own, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("an unknown block")
    return width, height, frames


def shown(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The whole canvas (height, width, RGBA) as each frame shows it. It is given out to be read, not kept."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        box = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        indices = f.indices[: box.shape[0], : box.shape[1]]
        colours = np.column_stack([f.palette, np.full(len(f.palette), 255, np.uint8)])[indices]
        if f.transparent is None:
            box[:] = colours
        else:
            seen = indices != f.transparent
            box[seen] = colours[seen]
        yield canvas
        if f.disposal == 2:
            box[:] = 0
        elif f.disposal == 3:
            canvas = before


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels by their two top bits of red, green and blue: 64 counts."""
    c = canvas.view(np.uint32)[..., 0]  # bytes r, g, b, a from low to high
    bins = (c >> 2 & 0x30) | (c >> 12 & 0x0C) | (c >> 22 & 0x03)
    return np.bincount(bins[c >> 24 != 0], minlength=BINS)


GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
UNIT = 576
ROWS = 64
DELAY = 10


def payload(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def bytes_to_gif(data: bytes) -> bytes:
    """Bytes as grey samples, 576 in a row, 64 rows in a frame, the last frame as high as it needs."""
    samples = np.frombuffer(payload(data), np.uint8).reshape(-1, UNIT)
    parts = [samples[k : k + ROWS] for k in range(0, len(samples), ROWS)]
    return write_gif(UNIT, len(parts[0]), GREY, [Frame(0, 0, UNIT, len(p), p, GREY, DELAY, 1) for p in parts])


def encode_texts(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text (null: empty) as a GIF."""
    column = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [x or b"" for x in rows["body"].to_pylist()]
            media = pa.array([bytes_to_gif(x) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(map(len, texts), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column.cast("string").cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAME_TYPE = "array<struct<start_cs:int,delay_cs:int,left:int,top:int,width:int,height:int,disposal:int,transparent:int,histogram:array<int>>>"


def decode_media(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Reads the column ``media``: ``keep`` columns, canvas ``width, height``, timed ``frames`` with colour histograms of the whole
    canvas as shown, ``samples`` (the first colour component of each frame's own pixels) and ``error``. Null or broken media give
    null columns and the reason in ``error``."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", width int, height int, frames {FRAME_TYPE}, samples binary, error string"

    frame_type = pa.list_(pa.struct([*((n, pa.int32()) for n in ("start_cs", "delay_cs", "left", "top", "width", "height", "disposal", "transparent")), ("histogram", pa.list_(pa.int32()))]))
    types = {"width": pa.int32(), "height": pa.int32(), "frames": frame_type, "samples": pa.binary(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch["media"].to_pylist():
                try:
                    width, height, frames = read_gif(data or b"")
                    told, start = [], 0
                    for f, canvas in zip(frames, shown(width, height, frames), strict=True):
                        told.append({"start_cs": start, "delay_cs": f.delay, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "transparent": f.transparent, "histogram": colour_histogram(canvas).tolist()})
                        start += f.delay
                    samples = b"".join((f.indices if f.palette is None or np.array_equal(f.palette, GREY) else f.palette[:, 0][f.indices]).tobytes() for f in frames)
                    out.append((width, height, told, samples, None))
                except (ValueError, IndexError, TypeError, struct.error) as e:
                    out.append((None, None, None, None, str(e)))
            more = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), *more], [*keep, *types])

    return rows.select(*keep, "media").mapInArrow(run, schema)


def media_report(docs: DataFrame) -> DataFrame:
    """Each text stored as a GIF and read back: digests of what was read, and the frames' times and colours as ``feature``."""
    stored = encode_texts(docs)
    kept = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    rows = decode_media(kept, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    whole = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), BINS), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    duration = F.aggregate("frames", F.lit(0), lambda acc, f: acc + f["delay_cs"])
    spots = F.filter(F.transform(whole, lambda n, k: F.when(n > 0, F.concat(k.cast("string"), F.lit(":"), n.cast("string")))), lambda s: s.isNotNull())
    feature = F.concat_ws(" ", F.concat(F.col("width"), F.lit("x"), F.col("height")), F.concat(F.size("frames"), F.lit("f")), F.concat(duration, F.lit("cs")), F.array_join(spots, ","))
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


def expected_report(doc_id: int, text: str | None) -> dict:
    """What ``media_report`` must say of a text as far as it does not depend on how the media is stored."""
    data = (text or "").encode()
    stored = payload(data)
    return {"doc_id": doc_id, "n_bytes": len(data), "payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-32:])}

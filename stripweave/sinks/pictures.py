"""Pictures written as files, each of its own, by the tasks that hold them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from stripweave.session import ship


def png_bytes(data: bytes, width: int, height: int, channels: int) -> bytes:
    """An 8-bit PNG of grey pixels, or of blue, green and red ones (the order in which Spark decodes)."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :: -1 if channels == 3 else 1]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_pictures(pictures: DataFrame, folder: str) -> DataFrame:
    """Writes each row (``path``, relative; ``width, height, channels, data``, grey or of three channels) under ``folder``: as PNG where the
    path ends so, else its bytes as they are. Gives ``path, length``; nothing is written before that is asked for. A task done again
    writes the same files. ``folder`` may be in any store that pyarrow reaches; Spark's own writers make no single files."""
    ship(pictures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for r in batch.to_pylist():
                png = r["path"].endswith(".png")
                body = png_bytes(r["data"], r["width"], r["height"], r["channels"]) if png else r["data"]
                own = f"{root}/{r['path']}".rsplit("/", 1)[0]
                if own not in made:
                    store.create_dir(own, recursive=True)
                    made.add(own)
                with store.open_output_stream(f"{root}/{r['path']}") as out:
                    out.write(body)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(sizes, pa.int64())], ["path", "length"])

    return pictures.select("path", "width", "height", "channels", "data").mapInArrow(run, "path string, length long")

"""Scenes inside a panel: bands between white rows, and parts of a band between white columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stripweave.session import ship
from stripweave.sources.files import _edges, _grey

#: A row or column of this mean is white; smaller panels are one scene; rows and columns taken off a scene's sides; the least
#: sides of a band and of a part of it.
WHITE, LEAST_HEIGHT, LEAST_WIDTH, TRIM, LEAST_BAND, LEAST_PART = 245, 200, 150, 3, 20, 30
PARTS = "path string, name string, band int, part int, x0 int, y0 int, x1 int, y1 int"


def _between(low: int, value: int, high: int) -> int:
    return max(low, min(high, value))


def _runs(mask: np.ndarray) -> np.ndarray:
    """Start and end (exclusive) of each run of a mask."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)


def _white_runs(means: np.ndarray, least: int) -> np.ndarray:
    """Runs of white rows or columns, each decided by the majority of its neighbours."""
    k = _between(3, len(means) // 800, 21)
    votes = np.convolve((means >= WHITE).astype(int), np.ones(k, int), mode="same")
    runs = _runs(votes > k // 2)
    return runs[runs[:, 1] - runs[:, 0] >= least]


def dark_background(grey: np.ndarray) -> bool:
    """A panel that is dark as a whole or along its borders."""
    m = _between(1, len(grey) // 50, 20)
    rim = np.mean([grey[:m].mean(), grey[-m:].mean(), grey[:, :m].mean(), grey[:, -m:].mean()])
    return bool(grey.mean() < 70 or rim < 60)


def _spread(grey: np.ndarray) -> list[tuple[int, int]]:
    """Where a panel has no white rows that part content: the stretches of rows that are rich in edges, their faint ends cut off."""
    h = len(grey)
    k, tall, look = _between(3, h // 800, 31), _between(80, h // 120, 600), _between(10, h // 2000, 80)
    dense = np.convolve(_edges(grey).mean(1), np.ones(k) / k, mode="same")
    level = max(0.0005, float(dense.mean()) * 0.6)
    found = []
    for start, end in _runs(dense > level).tolist():
        if end - start < tall:
            continue
        strong = np.flatnonzero(dense[start:end] > level * 1.2) + start
        head, tail = strong[strong < start + look], strong[strong > end - look]
        first, last = int(head[0]) if len(head) else start, int(tail[-1]) + 1 if len(tail) else end
        if last - first >= tall:
            found.append((first, last))
    return found if len(found) > 1 else [(0, h)]


def scene_bands(grey: np.ndarray) -> list[tuple[int, int]]:
    """The bands of rows of a panel that hold scenes of their own; the whole panel where it has one."""
    h, w = grey.shape
    if h < LEAST_HEIGHT or w < LEAST_WIDTH:
        return [(0, h)]
    light = 255 - grey if dark_background(grey) else grey
    gaps = _white_runs(light.mean(1), _between(5, h // 800, 80))
    if not len(gaps):
        return [(0, h)]
    tall = _between(80, h // 120, 600)
    edges = zip([0, *gaps[:, 1].tolist()], [*gaps[:, 0].tolist(), h], strict=True)
    bands = [(a, b) for a, b in edges if b - a >= tall and (light[a:b] < WHITE).mean() > 0.01]
    return bands or _spread(light)


def band_parts(band: np.ndarray) -> list[tuple[int, int]]:
    """The columns between a band's white ones, trimmed; none where it has no white columns or no part is large enough."""
    light = 255 - band if dark_background(band) else band
    height, width = band.shape
    gaps = _white_runs(light.mean(0), max(4, width // 600))
    if not len(gaps):
        return []
    edges = zip([0, *gaps[:, 1].tolist()], [*gaps[:, 0].tolist(), width], strict=True)
    parts = [(a + TRIM, max(a + TRIM + 1, b - TRIM)) for a, b in edges]
    return [(a, min(b, width)) for a, b in parts if height >= LEAST_PART and min(b, width) - a >= LEAST_PART]


def split_panel(name: str, grey: np.ndarray) -> list[tuple[str, int, int, int, int, int, int]]:
    """``name, band, part, x0, y0, x1, y1`` of a panel's scenes: ``_s01`` and so on by bands, ``_s01_x01`` by parts of a band (part 0 is a
    whole band). A panel with one scene has none."""
    bands = scene_bands(grey)
    out = []
    for i, (start, end) in enumerate(bands if len(bands) > 1 else [], 1):
        y0 = start + TRIM
        y1 = min(max(y0 + 1, end - TRIM), len(grey))
        band = grey[y0:y1]
        if min(band.shape) < LEAST_BAND:
            continue
        parts = band_parts(band)
        out += [(f"{name}_s{i:02d}_x{k:02d}", i, k, a, y0, b, y1) for k, (a, b) in enumerate(parts, 1)]
        if not parts:
            out.append((f"{name}_s{i:02d}", i, 0, 0, y0, grey.shape[1], y1))
    return out


def panel_scenes(pictures: DataFrame) -> DataFrame:
    """The scenes inside each picture (``path, width, height, channels, data``): PARTS. A picture is split in its own row's task."""
    ship(pictures.sparkSession)
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                base = r["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
                grey = _grey(r["data"], r["height"], r["width"], r["channels"])
                rows += [(r["path"], *found) for found in split_panel(base, grey)]
            kinds = [pa.string(), pa.string(), *[pa.int32()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return pictures.select("path", "width", "height", "channels", "data").mapInArrow(run, PARTS)

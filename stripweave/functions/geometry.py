"""Column functions over boxes (``x, y, w, h``) and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in "xywh")


def bbox_iou(a: Box, b: Box) -> Column:
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    iw = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = iw * ih
    return inter / F.greatest(F.lit(1.0), aw * ah + bw * bh - inter)


def bbox_clip(b: Box, width: Column | int, height: Column | int, pad: int = 0) -> Box:
    x, y, w, h = b
    width, height = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    x0, y0 = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad)
    x1, y1 = F.least(width, x + w + pad), F.least(height, y + h + pad)
    return x0, y0, F.greatest(F.lit(0), x1 - x0), F.greatest(F.lit(0), y1 - y0)


def bbox_center(b: Box) -> tuple[Column, Column]:
    x, y, w, h = b
    return x + w / 2, y + h / 2


def yolo_box(b: Box, width: Column, height: Column) -> Box:
    """Centre and size as shares of the image."""
    x, y, w, h = b
    return (x + w / 2) / width, (y + h / 2) / height, w / width, h / height


def coco_box(b: Box, width: Column, height: Column) -> Box:
    """The absolute box of centre and size shares."""
    cx, cy, nw, nh = b
    return (cx - nw / 2) * width, (cy - nh / 2) * height, nw * width, nh * height


def flip_box(b: Box, width: Column) -> Box:
    x, y, w, h = b
    return width - (x + w), y, w, h


def bbox_problem(b: Box, width: Column, height: Column) -> Column:
    """Why a box cannot be a label; null for a good one."""
    x, y, w, h = b
    cx, cy, nw, nh = yolo_box(b, width, height)
    inside = lambda v: (v >= 0) & (v <= 1)
    return F.when((w <= 0) | (h <= 0), "empty").when(~(inside(cx) & inside(cy)), "centre_outside").when(~(inside(nw) & inside(nh)), "too_large")


def fit_scale(width: Column, height: Column, target_width: int | Column) -> tuple[Column, Column]:
    """Size at the target width, aspect kept."""
    target_width = F.lit(target_width) if isinstance(target_width, int) else target_width
    return target_width, F.greatest(F.lit(1), F.floor(height * target_width / width + 0.5)).cast("int")


def optimal_width(width: Column, height: Column, target: int = 1200) -> tuple[Column, Column, Column]:
    """Size at the target width, rows rounded down, and the longest side then allowed; a page of that width stays as it is."""
    rows = F.when(width == target, height).otherwise(F.floor(height * (target / width)).cast("int"))
    return F.lit(target), rows, F.greatest(F.lit(target), rows)


def rotate_hint(width: Column, height: Column) -> Column:
    return width > height * 1.5


def shape_family(width: Column, height: Column) -> Column:
    """The frame a scene is shown in: ``name, width, height``, by its height over width."""
    ratio = height / width

    def frame(name: str, w: int, h: int) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(w).alias("width"), F.lit(h).alias("height"))

    return F.when(ratio <= 0.72, frame("landscape", 1600, 900)).when(ratio <= 1.12, frame("square", 1080, 1080)).otherwise(frame("portrait", 1080, 1350))


def contain(width: Column, height: Column, frame: Column) -> tuple[Column, Column, Column, Column]:
    """Size in the frame and the padding left and top, aspect kept."""
    scale = F.least(frame["width"] / width, frame["height"] / height)
    w, h = F.greatest(F.lit(1), F.floor(width * scale + 0.5)).cast("int"), F.greatest(F.lit(1), F.floor(height * scale + 0.5)).cast("int")
    return w, h, F.floor((frame["width"] - w) / 2).cast("int"), F.floor((frame["height"] - h) / 2).cast("int")


def tokens(text: Column) -> Column:
    """The set of lower-case words and numbers."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard_tokens(a: Column, b: Column) -> Column:
    """Shared share of the sets of lower-case words and numbers; 0 if one is empty."""
    aa, bb = tokens(a), tokens(b)
    return F.when((F.size(aa) > 0) & (F.size(bb) > 0), F.size(F.array_intersect(aa, bb)) / F.size(F.array_union(aa, bb))).otherwise(0.0)

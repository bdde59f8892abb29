"""Files of a stage: page files, decoded images, annotations, label lines and JSON documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.functions.text import natural_key
from stripweave.session import ship

#: File endings by stage.
EXTENSIONS = {"pages": ("jpg", "jpeg", "png", "webp"), "stitch": ("jpg", "jpeg", "png", "webp", "avif"), "dataset": ("jpg", "jpeg", "png", "webp", "bmp")}


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def page_files(spark: SparkSession, path: str, stage: str | Sequence[str] = "pages", content: bool = False) -> DataFrame:
    """``path, name, folder, ext, length, modified`` and the sort key of a stage's files, or of those with the given endings; contents only if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = _name(F.col("path"))
    rows = rows.select("path", name.alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.lower(F.substring_index(name, ".", -1)).alias("ext"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return rows.filter(F.col("ext").isin(*(EXTENSIONS[stage] if isinstance(stage, str) else stage))).withColumn("key", natural_key(F.col("name")))


def images(spark: SparkSession, path: str, least_side: int = 10) -> DataFrame:
    """``path, width, height, channels, data`` of the images that can be decoded, small ones left out."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")).filter((F.col("width") >= least_side) & (F.col("height") >= least_side))


def scanned_images(spark: SparkSession, path: str, stage: str = "stitch", least_side: int = 10) -> DataFrame:
    """``path, problem`` of every file of a stage, and ``width, height, channels, data`` of those that can be decoded (else nulls). ``problem`` is null where ``images`` gives the file;
    ``too_small`` where a side is; ``unknown_format`` where no reader of this kind is there (webp, avif); else ``unreadable``. The folder is listed and its files are opened once."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    read = F.col("image.height") >= 0  # a file that cannot be decoded has sides below 0
    sides = {"width": "width", "height": "height", "channels": "nChannels", "data": "data"}
    rows = rows.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), *(F.when(read, F.col(f"image.{v}")).alias(k) for k, v in sides.items()))
    ext = F.lower(F.substring_index(_name(F.col("path")), ".", -1))
    none = F.when(ext.isin("webp", "avif"), "unknown_format").otherwise("unreadable")
    problem = F.when(F.least("width", "height") < least_side, "too_small").when(F.col("height").isNull(), none)
    return rows.filter(ext.isin(*EXTENSIONS[stage])).withColumn("problem", problem)


def image_report(spark: SparkSession, path: str, stage: str = "stitch", least_side: int = 10) -> DataFrame:
    """``path, problem`` of every file of a stage, as ``scanned_images`` tells them."""
    return scanned_images(spark, path, stage, least_side).select("path", "problem")


BOX = "struct<x:double,y:double,width:double,height:double,class:string>"
ANNOTATION = f"image_path string, image_width int, image_height int, annotations array<{BOX}>, panels array<{BOX}>, _corrupt_record string"


def annotations(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """``stem, img_w, img_h, ann_id, x, y, w, h, class`` from annotation files; the older key ``panels`` counts where there is no other, and a box without
    a class is a panel. Broken files give no rows. With several documents in a file, one a line, the stem is that of a document's own image."""
    rows = spark.read.schema(ANNOTATION).option("multiLine", one_per_file).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    named = _name(F.col("_metadata.file_path")) if one_per_file else _name(F.col("image_path"))
    rows = rows.select(F.regexp_replace(named, r"\.[^.]*$", "").alias("stem"), "image_width", "image_height", F.posexplode(F.coalesce("annotations", "panels")).alias("ann_id", "b"))
    return rows.select("stem", F.col("image_width").alias("img_w"), F.col("image_height").alias("img_h"), "ann_id", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.width").alias("w"), F.col("b.height").alias("h"), F.coalesce("b.class", F.lit("panel")).alias("class"))


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """``stem, class_id, cx, cy, nw, nh`` from label lines; lines of fewer than five fields or without numbers are left out. The stem is what stands before a line's tab, else
    the file's name."""
    own = F.when(F.instr("value", "\t") > 0, F.substring_index("value", "\t", 1)).otherwise(F.regexp_replace(_name(F.col("_metadata.file_path")), r"\.[^.]*$", ""))
    rows = spark.read.text(path).select(own.alias("stem"), F.split(F.trim(F.substring_index("value", "\t", -1)), r"\s+").alias("f")).filter(F.size("f") >= 5)
    number = lambda k: F.col("f")[k].try_cast("double")
    return rows.select("stem", F.col("f")[0].try_cast("int").alias("class_id"), number(1).alias("cx"), number(2).alias("cy"), number(3).alias("nw"), number(4).alias("nh")).na.drop()


def json_documents(spark: SparkSession, path: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """JSON documents under a schema, one a file or one a line, with ``corrupt``: broken ones are rows of nulls, never an error."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", one_per_file).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("corrupt", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


COCO = (
    "split string, part int, info struct<version:string>, categories array<struct<id:long,name:string>>, images array<struct<id:long,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>"
)


def coco_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as ``write_coco_json`` writes them, one row each; their schema is known, so they are not read once more to find it."""
    return spark.read.schema(COCO).json(path)


def _grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return pixels[:, :, 0] if channels < 3 else pixels[:, :, :3] @ (0.114, 0.587, 0.299)


def _edges(grey: np.ndarray, level: float = 60.0) -> np.ndarray:
    """Where the Sobel gradient of a picture, or of each of a stack, is above the level."""
    p = np.pad(grey, [(0, 0)] * (grey.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
    up, mid, down = p[..., :-2, :], p[..., 1:-1, :], p[..., 2:, :]
    gx = (up[..., 2:] + 2 * mid[..., 2:] + down[..., 2:]) - (up[..., :-2] + 2 * mid[..., :-2] + down[..., :-2])
    gy = (down[..., :-2] + 2 * down[..., 1:-1] + down[..., 2:]) - (up[..., :-2] + 2 * up[..., 1:-1] + up[..., 2:])
    return np.hypot(gx, gy) > level


def _saliency(grey: np.ndarray, edges: np.ndarray, saturation: np.ndarray) -> np.ndarray:
    """What catches the eye in each pixel: fine detail, edges and strong colours."""
    p = np.pad(grey, 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    detail = np.abs(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey)
    detail = np.clip(detail / (np.percentile(detail, 97) + 1), 0, 1)
    return 0.55 * detail + 0.3 * edges + 0.15 * saturation[:, None]


#: ``foreground`` is what differs from the borders, ``energy`` and ``focus`` (0 to 1) the amount and the centre of what catches the eye; ``white``, ``ink`` and ``dark`` are
#: the shares of pixels over 242, under 232 and under 72.
ROW_PROFILE = "path string, y int, row_mean double, row_std double, edge_density double, foreground double, saturation double, energy double, focus double, white double, ink double, dark double"


def row_profiles(pictures: DataFrame) -> DataFrame:
    """One row per pixel row of each image, for the sequence operators."""
    ship(pictures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grey = _grey(r["data"], r["height"], r["width"], r["channels"])
                colours = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])[:, :, :3].astype(float)
                top = colours.max(2)
                saturation = ((top - colours.min(2)) / np.maximum(top, 1)).mean(1)
                border = max(1, min(r["width"] // 2, max(4, r["width"] // 24)))
                rim = np.concatenate([grey[:, :border], grey[:, -border:]], axis=1).mean(1)
                edges = _edges(grey)
                catching = _saliency(grey, edges, saturation)
                weight = catching.sum(1)
                focus = np.where(weight > 1e-6, catching @ np.arange(r["width"]) / np.maximum(weight, 1e-6), r["width"] / 2) / max(1, r["width"])
                values = [grey.mean(1), grey.std(1), edges.mean(1), (np.abs(grey - rim[:, None]) > 18).mean(1), saturation, catching.mean(1), focus, (grey > 242).mean(1), (grey < 232).mean(1), (grey < 72).mean(1)]
                h = r["height"]
                names = [x.split()[0] for x in ROW_PROFILE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * h), pa.array(range(h), pa.int32()), *(pa.array(v, pa.float64()) for v in values)], names)

    return pictures.select("path", "width", "height", "channels", "data").mapInArrow(run, ROW_PROFILE)


#: Shares of pixels: ``white_ratio`` over 242, ``bright_ratio`` over 240, ``light_ratio`` over 210, ``ink_ratio`` under 232, ``shade_ratio`` under 80, ``dark_ratio`` under 70, ``black_ratio``
#: under 15; ``uniformity`` is that of the commonest grey, ``light_share`` that over the threshold which parts light from dark best. ``border_std`` is the largest deviation
#: within a border, ``border_dark`` each border's share under 150, and ``centre_variance`` that of the middle half, ``rim_variance`` that of the four outer quarters.
SHARES = {"white_ratio": (242, 1), "bright_ratio": (240, 1), "light_ratio": (210, 1), "ink_ratio": (232, -1), "shade_ratio": (80, -1), "dark_ratio": (70, -1), "black_ratio": (15, -1)}
PANEL_STATS = (
    "path string, width int, height int, mean double, std double, " + "".join(f"{c} double, " for c in SHARES)
    + "edge_ratio double, uniformity double, light_share double, border_std double, centre_variance double, rim_variance double, border_dark array<double>, grid8 array<double>, grid16 array<double>"
)


#: Fixed value: pixels of the pictures of one size that are worked on at once.
STACK_PIXELS = 1 << 19


def _flat(greys: np.ndarray) -> np.ndarray:
    return greys.reshape(len(greys), -1)


def _counts(greys: np.ndarray) -> np.ndarray:
    """How often each grey from 0 to 255 is in each picture of a stack."""
    n = len(greys)
    at = _flat(np.clip(greys, 0, 255).astype(int)) + 256 * np.arange(n)[:, None]
    return np.bincount(at.ravel(), minlength=256 * n).reshape(n, 256)


def _light_share(greys: np.ndarray) -> np.ndarray:
    """The share of pixels above the grey that parts them into the two classes furthest apart, as Otsu's method does."""
    n = _counts(np.rint(greys)).astype(float)
    below, sums = np.cumsum(n, 1), np.cumsum(n * np.arange(256), 1)
    above = below[:, -1:] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (sums / below - (sums[:, -1:] - sums) / above) ** 2
    at = np.argmax(np.where(np.isfinite(apart), apart, -1), 1)
    return above[np.arange(len(n)), at] / below[:, -1]


def _borders(greys: np.ndarray, thickness: int) -> tuple[np.ndarray, ...]:
    return greys[:, :thickness], greys[:, -thickness:], greys[:, :, :thickness], greys[:, :, -thickness:]


def _centre_and_rim(greys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, h, w = greys.shape
    centre = _flat(greys[:, h // 4 : 3 * h // 4, w // 4 : 3 * w // 4])
    rim = np.concatenate([_flat(x) for x in (greys[:, : h // 4], greys[:, 3 * h // 4 :], greys[:, :, : w // 4], greys[:, :, 3 * w // 4 :])], 1)
    return (centre.var(1), rim.var(1)) if centre.size and rim.size else (np.zeros(n), np.zeros(n))


def _grid(greys: np.ndarray, n: int) -> np.ndarray:
    _, h, w = greys.shape
    rows = np.array_split(np.arange(h), n) if h >= n else [np.array([min(k * h // n, h - 1)]) for k in range(n)]
    cols = np.array_split(np.arange(w), n) if w >= n else [np.array([min(k * w // n, w - 1)]) for k in range(n)]
    return np.stack([_flat(greys[:, r[0] : r[-1] + 1, c[0] : c[-1] + 1]).mean(1) for r in rows for c in cols], 1)


def _panel_stats(greys: np.ndarray) -> list[np.ndarray]:
    """The columns of PANEL_STATS after the sides, of a stack of pictures of one size."""
    flat, side = _flat(greys), min(greys.shape[1:])
    shares = [((flat > level) if sign > 0 else (flat < level)).mean(1) for level, sign in SHARES.values()]
    uniform = _counts(greys).max(1) / flat.shape[1]
    border_std = np.max([_flat(b).std(1) for b in _borders(greys, max(5, side // 20))], 0)
    borders = np.stack([_flat(b < 150).mean(1) for b in _borders(greys, max(3, side // 30))], 1)
    return [flat.mean(1), flat.std(1), *shares, _flat(_edges(greys)).mean(1), uniform, _light_share(greys), border_std, *_centre_and_rim(greys), borders, _grid(greys, 8), _grid(greys, 16)]


def _column(found: np.ndarray) -> pa.Array:
    """A column of numbers, or of lists of one length."""
    values = pa.array(found.ravel(), pa.float64())
    return values if found.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), values)


def panel_stats(pictures: DataFrame) -> DataFrame:
    """One row of statistics per image, for the panel operators. Pictures of one size in a batch are worked on together: small ones cost no array calls of their own."""
    ship(pictures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PANEL_STATS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            sizes: dict[tuple[int, int], list[dict]] = {}
            for r in batch.to_pylist():
                sizes.setdefault((r["height"], r["width"]), []).append(r)
            for (h, w), rows in sizes.items():
                each = max(1, STACK_PIXELS // max(1, h * w))
                for k in range(0, len(rows), each):
                    some = rows[k : k + each]
                    found = _panel_stats(np.stack([_grey(r["data"], h, w, r["channels"]) for r in some]))
                    about = [pa.array([r[c] for r in some], t) for c, t in zip(("path", "width", "height"), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*about, *map(_column, found)], names)

    return pictures.select("path", "width", "height", "channels", "data").mapInArrow(run, PANEL_STATS)


def dct8(grid16: Column) -> Column:
    """The 64 lowest coefficients of the cosine transform of a 16 x 16 grid, as two products of matrices for each batch. Nulls where the grid, or a value of it, is missing.

    As nested functions of arrays each step would be worked out anew wherever it is used, and value by value."""
    n = 16
    wave = np.array([[np.sqrt((1 if u == 0 else 2) / n) * np.cos(np.pi * (2 * x + 1) * u / (2 * n)) for x in range(n)] for u in range(8)])

    def run(grids: pa.Array) -> pa.Array:
        at = np.flatnonzero(pc.list_value_length(grids).fill_null(0).to_numpy(zero_copy_only=False) >= n * n)
        places = grids.offsets.to_numpy()[at][:, None] + np.arange(n * n)
        whole = ~grids.values.is_null().to_numpy(zero_copy_only=False)[places].any(1)
        at, places = at[whole], places[whole]
        found, missing = np.zeros((len(grids), 64)), np.ones((len(grids), 64), bool)
        found[at] = (wave @ grids.values.to_numpy(zero_copy_only=False)[places].reshape(-1, n, n) @ wave.T).reshape(-1, 64)
        missing[at] = False
        return pa.ListArray.from_arrays(pa.array(np.arange(len(grids) + 1) * 64, pa.int32()), pa.array(found.ravel(), mask=missing.ravel()))

    return F.arrow_udf(run, "array<double>")(grid16)


def clean_pages(pictures: DataFrame, by: Sequence[str] = ("folder",)) -> DataFrame:
    """Decoded pages (``path`` and statistics) in natural order, copies dropped, numbered anew, with a hint to turn wide ones."""
    from stripweave.functions.geometry import rotate_hint
    from stripweave.functions.vectors import avg_hash64
    from stripweave.operators.dedupe import exact_hash_dedupe
    from stripweave.operators.panels import natural_order, renumbered

    rows = pictures.withColumn("name", _name(F.col("path"))).withColumn("folder", F.element_at(F.split("path", "/"), -2)).withColumn("hash", avg_hash64(F.col("grid8")))
    kept = exact_hash_dedupe(natural_order(rows, by), by)
    return renumbered(kept, by, ["seq"], "%03d.png").withColumn("rotate", rotate_hint(F.col("width"), F.col("height")))

"""Detection data sets: box labels, splits with exact counts, augmented labels, and the tables of a COCO document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.functions import geometry as G
from stripweave.operators.ranking import global_row_number
from stripweave.session import stored

#: Class names by id.
CLASSES = ("panel", "dialogue", "face", "sfx", "caption")


def class_table(spark: SparkSession, names: Sequence[str] = CLASSES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "class_id int, class string")


def checked_boxes(boxes: DataFrame, classes: int = len(CLASSES)) -> DataFrame:
    """The boxes with ``problem``: unknown_class, or why the box is no label, or null."""
    unknown = F.col("class_id").isNull() | (F.col("class_id") < 0) | (F.col("class_id") >= classes)
    return boxes.withColumn("problem", F.when(unknown, "unknown_class").otherwise(G.bbox_problem(G.box(), F.col("img_w"), F.col("img_h"))))


def yolo_labels(boxes: DataFrame) -> DataFrame:
    """``image_id, ann_id, class_id, cx, cy, nw, nh`` of the good boxes."""
    cx, cy, nw, nh = G.yolo_box(G.box(), F.col("img_w"), F.col("img_h"))
    return checked_boxes(boxes).filter(F.col("problem").isNull()).select("image_id", "ann_id", "class_id", cx.alias("cx"), cy.alias("cy"), nw.alias("nw"), nh.alias("nh"))


def label_line() -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "nw", "nh")


def label_files(labels: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per image: the text of its label file."""
    rows = F.array_sort(F.collect_list(F.struct("ann_id", "class_id", "cx", "cy", "nw", "nh", label_line().alias("line"))))
    return labels.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("value"))


def class_distribution(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Count and percentage of every class, also of those without a box."""
    counts = classes.join(labels.groupBy("class_id").agg(F.count("*").alias("n")), "class_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("class_id", "class", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)).alias("percent"))


def split_class_distribution(labels: DataFrame) -> DataFrame:
    """Count and share within its split of each class; a row with a null class sums a split up."""
    rows = labels.rollup("split", "class_id").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).filter("level < 3")
    share = F.col("n") * 100.0 / F.sum(F.when(F.col("level") == 0, F.col("n"))).over(Window.partitionBy("split"))
    return rows.select("split", "class_id", "n", share.alias("percent"))


def conversion_summary(boxes: DataFrame) -> DataFrame:
    rows = checked_boxes(boxes)
    return rows.agg(F.count_distinct("image_id").alias("images"), F.count_if(F.col("problem").isNull()).alias("annotations"), F.count_if(F.col("problem").isNotNull()).alias("errors"), F.count_if(F.col("problem") == "unknown_class").alias("unknown_classes"))


def split_images(images: DataFrame, key: str, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``split`` for each distinct key: exact counts (whole parts for train and val, the rest for test), by a seeded hash of the key, whatever
    the order of the input."""
    if abs(sum(ratios) - 1) > 0.001:
        raise ValueError("ratios must sum to 1")
    rows = images.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    ranked = global_row_number(rows, F.substring("_hash", 1, 3), ["_hash", key], "_rank")
    total = rows.agg(F.count("*").alias("_total"))
    at = F.col("_rank")
    train, val = (F.floor(F.col("_total") * r + 1e-9) for r in ratios[:2])
    split = F.when(at <= train, "train").when(at <= train + val, "val").otherwise("test")
    return ranked.crossJoin(F.broadcast(total)).select(key, split.alias("split"))  # one row: the count


def augment_labels(labels: DataFrame, flipped_classes: Sequence[int] = (0, 2)) -> DataFrame:
    """Originals, ``_bright`` and ``_noise`` with the same labels, and ``_flip`` with mirrored boxes of the given classes only. An image without any
    such box has no flip."""
    same = F.array(F.lit(""), F.lit("_bright"), F.lit("_noise"))
    variants = F.when(F.col("class_id").isin(*flipped_classes), F.array_append(same, F.lit("_flip"))).otherwise(same)
    rows = labels.withColumn("variant", F.explode(variants))
    return rows.withColumn("cx", F.when(F.col("variant") == "_flip", 1 - F.col("cx")).otherwise(F.col("cx")))


def image_label_join(images: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Images with a label, and those without any."""
    keys = labels.select(key).distinct()
    return images.join(keys, key, "left_semi"), images.join(keys, key, "left_anti")


def first_extension(files: DataFrame, order: Sequence[str] = ("jpg", "jpeg", "png", "bmp", "webp")) -> DataFrame:
    """Of files with one stem, the one whose extension comes first; files of other kinds go."""
    place = F.array_position(F.array(*map(F.lit, order)), F.lower("ext"))
    best = F.row_number().over(Window.partitionBy("stem").orderBy(place, "name"))
    return files.filter(place > 0).withColumn("_at", best).filter(F.col("_at") == 1).drop("_at")


def coco_images(labels: DataFrame, splits: DataFrame, image_key: str = "image_id", width: int = 800, height: int = 600) -> DataFrame:
    """One row per image of ``splits`` (one row each) that has labels: ``split``, its id from 1 on in its split, ``file_name``, sides, its annotations in order, and ``of``, the images of
    the split. Only images are numbered and their labels counted up; labels are sent once to their image, and annotations take their ids from its place."""
    boxes = F.array_sort(F.collect_list(F.struct("ann_id", "class_id", "cx", "cy", "nw", "nh"))).alias("_boxes")
    images = labels.groupBy(image_key).agg(boxes).join(splits.select("split", image_key), image_key)
    images = stored(images.withColumns({"_n": F.size("_boxes").cast("long"), "_bucket": F.floor(F.col(image_key) / 4096)}))
    counts = images.groupBy("split", "_bucket").agg(F.count("*").alias("_images"), F.sum("_n").alias("_labels"))
    split = Window.partitionBy("split")
    before = split.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_images", "_labels")}
    counts = counts.withColumns(sums | {"of": F.sum("_images").over(split)}).drop("_images", "_labels")
    inner = Window.partitionBy("split", "_bucket").orderBy(image_key)
    earlier = F.coalesce(F.sum("_n").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    images = images.withColumns({"_at": F.row_number().over(inner), "_earlier": earlier}).join(counts, ["split", "_bucket"])
    images = images.withColumns({"id": (F.col("_at") + F.col("_images_before")).cast("long"), "_first": F.col("_earlier") + F.col("_labels_before") + 1})

    def annotation(b: Column, i: Column) -> Column:
        x, y, w, h = G.coco_box((b["cx"], b["cy"], b["nw"], b["nh"]), F.lit(width), F.lit(height))
        names = {"id": F.col("_first") + i, "image_id": F.col("id"), "category_id": b["class_id"] + 1, "bbox": F.array(x, y, w, h), "area": w * h, "iscrowd": F.lit(0)}
        return F.struct(*(v.alias(k) for k, v in names.items()))

    name = F.format_string("img_%d.jpg", F.col(image_key).cast("long")).alias("file_name")
    return images.select("split", "id", image_key, name, F.lit(width).alias("width"), F.lit(height).alias("height"), F.transform("_boxes", annotation).alias("annotations"), "of")


def coco_categories(spark: SparkSession) -> DataFrame:
    return class_table(spark).select((F.col("class_id") + 1).alias("id"), F.col("class").alias("name"))


def coco_tables(labels: DataFrame, splits: DataFrame, image_key: str = "image_id", width: int = 800, height: int = 600) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of each split's document; ids start at 1 in every split."""
    rows = coco_images(labels, splits, image_key, width, height)
    anns = rows.select("split", F.inline("annotations"))
    return rows.drop("annotations", "of"), anns, coco_categories(labels.sparkSession)


def dataset_export(boxes: DataFrame, seed: int = 42) -> DataFrame:
    """Good labels, as shares of their image, with the split of the image."""
    labels = yolo_labels(boxes)
    return labels.join(split_images(labels, "image_id", seed=seed), "image_id")

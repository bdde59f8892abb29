"""Queries of the data-set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.functions import geometry as G
from stripweave.operators import dataset as O
from stripweave.plans.registry import query
from stripweave.session import work_dir
from stripweave.sinks.writers import write_yolo_labels as write_labels
from stripweave.sources.feeds import feed, with_feeds

PROBLEM = """CASE WHEN class_id >= 5 THEN 'unknown_class' WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN NOT ((x + w / 2) / img_w BETWEEN 0 AND 1 AND (y + h / 2) / img_h BETWEEN 0 AND 1) THEN 'centre_outside' WHEN NOT (w / img_w BETWEEN 0 AND 1 AND h / img_h BETWEEN 0 AND 1) THEN 'too_large' END"""
LABELS = f"labels_ok AS (SELECT image_id, ann_id, class_id, (x + w / 2) / img_w AS cx, (y + h / 2) / img_h AS cy, w / img_w AS nw, h / img_h AS nh FROM boxes WHERE ({PROBLEM}) IS NULL)"
SPLITS = """images AS (SELECT image_id, row_number() OVER (ORDER BY md5('42|' || image_id), image_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM labels_ok)),
splits AS (SELECT image_id, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.7 + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM images)"""
CLASS_SQL = "classes AS (SELECT * FROM (VALUES (0, 'panel'), (1, 'dialogue'), (2, 'face'), (3, 'sfx'), (4, 'caption')) v(class_id, class))"


def _with(sql: str, *parts: str) -> str:
    return with_feeds(f"WITH {', '.join(parts)} {sql}", "boxes")


@query("bbox_valid", with_feeds(f"SELECT image_id, ann_id, class_id, x, y, {PROBLEM} AS problem FROM boxes", "boxes"))
def bbox_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.checked_boxes(feed(spark, sf_dir, "boxes")).select("image_id", "ann_id", "class_id", "x", "y", "problem")


@query("yolo_box", _with("SELECT * REPLACE (round(cx, 6) AS cx, round(cy, 6) AS cy, round(nw, 6) AS nw, round(nh, 6) AS nh) FROM labels_ok", LABELS))
def yolo_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.yolo_labels(feed(spark, sf_dir, "boxes")).withColumns({c: F.round(c, 6) for c in ("cx", "cy", "nw", "nh")})


@query("flip_box", with_feeds("SELECT image_id, ann_id, x, w, img_w - (x + w) AS flipped, greatest(0, x - 8) AS cx, greatest(0, least(img_w, x + w + 8) - greatest(0, x - 8)) AS cw FROM boxes", "boxes"))
def flip_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = G.bbox_clip(G.box(), F.col("img_w"), F.col("img_h"), 8)
    return feed(spark, sf_dir, "boxes").select("image_id", "ann_id", "x", "w", G.flip_box(G.box(), F.col("img_w"))[0].alias("flipped"), clipped[0].alias("cx"), clipped[2].alias("cw"))


@query("class_distribution", _with("SELECT c.class_id, c.class, count(l.image_id) AS n, count(l.image_id) * 100.0 / sum(count(l.image_id)) OVER () AS percent FROM classes c LEFT JOIN labels_ok l USING (class_id) GROUP BY 1, 2", LABELS, CLASS_SQL))
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.class_distribution(O.yolo_labels(feed(spark, sf_dir, "boxes")), O.class_table(spark))


@query("train_val_test_split", _with("SELECT image_id, split FROM splits", LABELS, SPLITS))
def train_val_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.split_images(O.yolo_labels(feed(spark, sf_dir, "boxes")), "image_id")


@query("dataset_export", _with("SELECT l.* REPLACE (round(cx, 6) AS cx, round(cy, 6) AS cy, round(nw, 6) AS nw, round(nh, 6) AS nh), split FROM labels_ok l JOIN splits USING (image_id)", LABELS, SPLITS))
def dataset_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.dataset_export(feed(spark, sf_dir, "boxes")).withColumns({c: F.round(c, 6) for c in ("cx", "cy", "nw", "nh")})


@query("split_class_distribution", _with("SELECT split, class_id, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split) AS percent FROM labels_ok JOIN splits USING (image_id) GROUP BY 1, 2 UNION ALL SELECT split, NULL, count(*), 100.0 FROM labels_ok JOIN splits USING (image_id) GROUP BY 1", LABELS, SPLITS))
def split_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.split_class_distribution(O.dataset_export(feed(spark, sf_dir, "boxes")))


@query("conversion_summary", with_feeds(f"SELECT count(DISTINCT image_id) AS images, count(*) FILTER (p IS NULL) AS annotations, count(p) AS errors, count(*) FILTER (p = 'unknown_class') AS unknown_classes FROM (SELECT *, {PROBLEM} AS p FROM boxes) b", "boxes"))
def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.conversion_summary(feed(spark, sf_dir, "boxes"))


@query("augment_labels", _with("SELECT image_id, ann_id, class_id, variant, round(CASE variant WHEN '_flip' THEN 1 - cx ELSE cx END, 6) AS cx FROM labels_ok, (VALUES (''), ('_bright'), ('_noise'), ('_flip')) v(variant) WHERE variant <> '_flip' OR class_id IN (0, 2)", LABELS))
def augment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.augment_labels(O.yolo_labels(feed(spark, sf_dir, "boxes"))).select("image_id", "ann_id", "class_id", "variant", F.round("cx", 6).alias("cx"))


@query("write_yolo_labels", _with("SELECT image_id, count(*) AS lines, string_agg(class_id::VARCHAR, ' ' ORDER BY class_id) AS classes FROM labels_ok GROUP BY 1", LABELS))
def write_yolo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by split, and the lines of each image read back."""
    path = work_dir(spark)
    write_labels(O.yolo_labels(feed(spark, sf_dir, "boxes")).withColumn("split", F.lit("train")), path)
    line = F.split(F.substring_index("value", "\t", -1), " ")
    rows = spark.read.text(f"{path}/labels").select(F.substring_index("value", "\t", 1).cast("long").alias("image_id"), line[0].alias("class_id"))
    return rows.groupBy("image_id").agg(F.count("*").alias("lines"), F.array_join(F.array_sort(F.collect_list("class_id")), " ").alias("classes"))


COCO_IMAGES = "coco_images AS (SELECT split, image_id, row_number() OVER (PARTITION BY split ORDER BY image_id) AS id FROM (SELECT DISTINCT split, image_id FROM labels_ok JOIN splits USING (image_id)))"


@query("coco_box", _with("SELECT split, row_number() OVER (PARTITION BY split ORDER BY i.id, ann_id, class_id, cx, cy, nw, nh) AS id, i.id AS image_id, class_id + 1 AS category_id, round(nw * 800 * (nh * 600), 4) AS area FROM labels_ok l JOIN coco_images i USING (image_id)", LABELS, SPLITS, COCO_IMAGES))
def coco_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = O.yolo_labels(feed(spark, sf_dir, "boxes"))
    _, anns, _ = O.coco_tables(labels, O.split_images(labels, "image_id"))
    return anns.select("split", "id", "image_id", "category_id", F.round("area", 4).alias("area"))


@query("image_label_join", _with("SELECT image_id, image_id IN (SELECT image_id FROM labels_ok) AS labelled FROM (SELECT DISTINCT image_id FROM boxes)", LABELS))
def image_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = feed(spark, sf_dir, "boxes")
    with_label, without = O.image_label_join(boxes.select("image_id").distinct(), O.yolo_labels(boxes), "image_id")
    return with_label.withColumn("labelled", F.lit(True)).unionByName(without.withColumn("labelled", F.lit(False)))


@query("annotation_image_join", with_feeds(r"""SELECT stem, name FROM (SELECT stem, name, row_number() OVER (PARTITION BY stem ORDER BY list_position(['jpg', 'jpeg', 'png', 'bmp', 'webp'], lower(ext)), name) AS r
FROM (SELECT name, 's' || (doc_id // 3) AS stem, string_split(name, '.')[-1] AS ext FROM files) f WHERE lower(ext) IN ('jpg', 'jpeg', 'png', 'bmp', 'webp')) x WHERE r = 1""", "files"))
def annotation_image_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = feed(spark, sf_dir, "files").select("name", F.concat(F.lit("s"), F.floor(F.col("doc_id") / 3)).alias("stem"), F.substring_index("name", ".", -1).alias("ext"))
    return O.first_extension(files).select("stem", "name")

"""Writers: label files, data-set documents, split folders, manifests, scripts, rejects and versioned state."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.operators.dataset import CLASSES, coco_categories, coco_images, label_line


def write_yolo_labels(labels: DataFrame, path: str, classes: Sequence[str] = CLASSES) -> None:
    """Label lines under ``split=`` folders, each after its image's name and a tab, and the class names in order of their ids. A file of its own for each image would be
    millions of them; whoever needs these splits the lines by name."""
    lines = labels.select("split", F.concat(F.col("image_id").cast("string"), F.lit("\t"), label_line()).alias("value"))
    lines.write.mode("overwrite").partitionBy("split").text(f"{path}/labels")
    labels.sparkSession.createDataFrame([("\n".join(classes),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/classes")


def coco_documents(labels: DataFrame, splits: DataFrame, images_each: int = 10_000) -> DataFrame:
    """Documents of about ``images_each`` images and all their annotations, numbered within each split: info, categories, images and annotations. Images are dealt by a hash of
    their ids, so that no document grows with the split."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("of") / images_each)).cast("int").alias("part")
    one = F.struct("id", "file_name", "width", "height", "annotations")  # ids of annotations rise with those of images
    docs = coco_images(labels, splits).select("split", part, one.alias("i")).groupBy("split", "part").agg(F.array_sort(F.collect_list("i")).alias("i"))
    images = F.transform("i", lambda i: i.dropFields("annotations")).alias("images")
    docs = docs.select("split", "part", images, F.flatten(F.transform("i", lambda i: i["annotations"])).alias("annotations"))
    c = coco_categories(labels.sparkSession).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))
    return docs.crossJoin(F.broadcast(c)).withColumn("info", F.struct(F.lit("1.0").alias("version")))  # one row: the classes


def write_coco_json(labels: DataFrame, splits: DataFrame, path: str, images_each: int = 10_000) -> None:
    coco_documents(labels, splits, images_each).write.mode("overwrite").partitionBy("split", "part").json(path)


def write_splits(rows: DataFrame, path: str, seed: int = 42) -> None:
    """Rows under ``split=`` folders, and a document of each split's size and first names."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    info = rows.select("split", "image_id").distinct().groupBy("split").agg(F.count("*").alias("images"))
    at = F.row_number().over(Window.partitionBy("split").orderBy("image_id"))  # no more than ten rows a task are sent on
    first = rows.select("split", "image_id").distinct().withColumn("_at", at).filter(F.col("_at") <= 10)
    first = first.groupBy("split").agg(F.array_sort(F.collect_list("image_id")).alias("first_names"))
    info.join(first, "split").withColumn("seed", F.lit(seed)).coalesce(1).write.mode("overwrite").json(f"{path}/info")


SECTION = "struct<index:long,source:string,height:long,y_start:long,y_end:long>"
RANGE = "struct<name:string,start:long,end:long>"
MANIFEST = f"strip_id string, sections array<{SECTION}>, canvas_height long, version int, panels array<{RANGE}>, scenes array<{RANGE}>"


def write_manifest(sections: DataFrame, path: str) -> None:
    """A nested document per strip, one a line: its sections in order, the canvas height, and the version."""
    one = F.struct("index", "source", "height", "y_start", "y_end")
    doc = sections.groupBy("strip_id").agg(F.array_sort(F.collect_list(one)).alias("sections"), F.max("y_end").alias("canvas_height"))
    doc.withColumn("version", F.lit(2)).write.mode("overwrite").json(f"{path}/change=0")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Each strip's document as it is now: of those written for it the last."""
    rows = spark.read.schema(MANIFEST + ", change long").json(path)
    last = F.row_number().over(Window.partitionBy("strip_id").orderBy(F.desc("change")))
    return rows.withColumn("_at", last).filter("_at = 1").drop("_at", "change")


def update_manifests(spark: SparkSession, path: str, updates: DataFrame, number: int) -> None:
    """Puts ``panels`` and ``scenes`` (``strip_id`` and one or both, arrays of RANGE) into the strips' documents. Only documents that change
    are written, as change ``number``; all others stay the files that they are, and an update done again takes its own place."""
    rows = manifests(spark, path).join(updates.select("strip_id", *(F.col(c).alias(f"_{c}") for c in updates.columns if c != "strip_id")), "strip_id")
    new = {c: F.coalesce(F.col(f"_{c}").cast(f"array<{RANGE}>"), F.col(c)) for c in ("panels", "scenes") if c in updates.columns}
    rows.withColumns(new).drop("_panels", "_scenes").write.mode("overwrite").json(f"{path}/change={number}")


def write_dialogue(documents: DataFrame, path: str) -> None:
    """A document per chapter, one a line; a folder for each chapter would be as many files."""
    documents.write.mode("overwrite").json(path)


def write_scripts(scripts: DataFrame, path: str) -> None:
    """The whole, the clean and the spoken text of every chapter, one a line with its keys, by kind in folders of their own."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("script", "clean", "spoken"))))
    scripts.select("series", "chapter", kinds.alias("_k")).select("series", "chapter", "_k.*").write.mode("overwrite").partitionBy("kind").json(path)


def write_rejects(rows: DataFrame, path: str, reason: str = "reason") -> None:
    """All rows under ``reason=`` folders; kept ones under ``kept``."""
    rows.withColumn(reason, F.coalesce(reason, F.lit("kept"))).write.mode("overwrite").partitionBy(reason).parquet(path)


def write_panel_meta(panels: DataFrame, path: str) -> None:
    panels.select("panel_id", "source", "y_start", "y_end", "width", "height").write.mode("overwrite").parquet(path)


def save_state(state: DataFrame, path: str, number: int) -> str:
    """The state as version ``number`` (of the batch or change that made it) beside the others. Once it is whole, its number is noted; readers take the
    greatest noted. A batch done again writes under its own number in a folder of its own, so a state that is read is never overwritten."""
    version = f"{path}/versions/{number}-{time.time_ns()}"
    state.write.parquet(version)
    done = state.sparkSession.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(version.rsplit("/", 1)[1]).alias("folder"))
    done.coalesce(1).write.mode("append").parquet(f"{path}/done")
    return version


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that was written whole."""
    newest = spark.read.parquet(f"{path}/done").agg(F.max(F.struct("version", "folder")).alias("m")).first().m.folder
    return spark.read.parquet(f"{path}/versions/{newest}")

"""The plan of a stitched strip: one width, seams, places, parts, and the document that says so. No pixel is moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.functions.geometry import fit_scale
from stripweave.operators.dedupe import seam_overlaps
from stripweave.operators.panels import format_detect
from stripweave.operators.sequence import part_cuts, stitch_plan

#: Fixed value: a canvas is at least so wide, where the target is not less.
LEAST_CANVAS = 400


def canvas_widths(pages: DataFrame, target: int = 800) -> DataFrame:
    """``strip_id, canvas_width``: the median of the pages' widths, whole, at least LEAST_CANVAS and at most ``target``."""
    median = F.floor(F.percentile("width", F.lit(0.5)))
    width = F.least(F.lit(target), F.greatest(F.lit(LEAST_CANVAS), median)).cast("int")
    return pages.groupBy("strip_id").agg(width.alias("canvas_width"))


def fitted_pages(pages: DataFrame, target: int = 800) -> DataFrame:
    """``strip_id, seq, canvas_width, height``: every page at the width of its strip's canvas, aspect kept."""
    rows = pages.join(canvas_widths(pages, target), "strip_id")
    same = F.col("width") == F.col("canvas_width")
    scaled = fit_scale(F.col("width"), F.col("height"), F.col("canvas_width"))[1]
    return rows.select("strip_id", "seq", "canvas_width", F.when(same, F.col("height")).otherwise(scaled).cast("int").alias("height"))


def stitch_chain(
    pages: DataFrame, rows: DataFrame, *, target: int = 800, seams: dict | None = None, parts: dict | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, parts and documents of the strips of ``pages`` (``strip_id, seq, width, height``), whose rows at the canvas' width are
    ``rows`` (``strip_id, seq, y, height, vec, edge_vec, row_mean, edge_density``).

    Pages are fitted to their strip's canvas; what a page repeats of the one before is taken off; what is left of the pages follows each
    other from 0 on; the rows of this canvas are cut into parts. A page that repeats wholly keeps all its rows, and rows that a page lacks
    are paper. ``seams`` and
    ``parts`` are the limits of ``seam_overlaps`` and ``part_cuts``. A document tells whether its sections tile the canvas and its
    parts too: each starts where the one before ends, the first at 0, the last ends at the canvas' height.
    """
    fitted = fitted_pages(pages, target)
    overlaps = seam_overlaps(rows, **(seams or {})).join(fitted.select("strip_id", "seq", "height"), ["strip_id", "seq"])
    left = F.col("overlap") < F.col("height")
    overlaps = overlaps.select(
        "strip_id", "seq", F.when(left, F.col("overlap")).otherwise(0).alias("overlap"),
        F.when(left, F.round("score", 4)).otherwise(0.0).alias("score"),
    )
    plan = stitch_plan(fitted.select("strip_id", "seq", "height"), overlaps)
    sections = plan.join(fitted.select("strip_id", "seq", "canvas_width"), ["strip_id", "seq"])
    every = F.explode(F.sequence(F.col("overlap").cast("int"), F.col("height") - 1)).alias("y")
    canvas = sections.select("strip_id", "seq", "overlap", "y_start", every)
    canvas = canvas.join(rows.select("strip_id", "seq", "y", "row_mean", "edge_density"), ["strip_id", "seq", "y"], "left")
    canvas = canvas.na.fill({"row_mean": 255.0, "edge_density": 0.0})
    y = (F.col("y_start") + F.col("y") - F.col("overlap")).cast("int").alias("y")
    found = part_cuts(sections, canvas.select("strip_id", y, "row_mean", "edge_density"), **(parts or {}))

    def tiled(table: DataFrame, start: str, end: str, name: str, *columns: str) -> DataFrame:
        """The ranges of a strip in order, and whether each starts where the one before ends."""
        order = Window.partitionBy("strip_id").orderBy(start)
        gap = F.col(start) != F.coalesce(F.lag(end).over(order), F.lit(0))
        one = F.struct(F.col(start).cast("long").alias("y_start"), F.col(end).cast("long").alias("y_end"), *columns)
        rows = table.withColumn("_gap", gap)
        all_of = F.array_sort(F.collect_list(one)).alias(name)
        return rows.groupBy("strip_id").agg(all_of, (F.count_if("_gap") == 0).alias(f"{name}_tile"), F.max(end).alias(f"_{name}"))

    inner = tiled(sections, "y_start", "y_end", "sections", "seq", "height", "overlap", "score")
    outer = tiled(found, "start", "end", "parts", "part")
    docs = inner.join(outer, "strip_id", "left").join(canvas_widths(pages, target), "strip_id")
    height = F.col("_sections")
    tile = F.col("sections_tile") & F.coalesce(F.col("parts_tile") & (F.col("_parts") == height), F.lit(False))
    size = F.struct(F.col("canvas_width").alias("width"), height.alias("height"))
    kind = format_detect(F.col("canvas_width"), height)
    return sections, found, docs.select("strip_id", size.alias("canvas"), kind.alias("format"), "sections", "parts", tile.alias("tiles"))

"""Panels and files: gates, classes, labels, counts and numbering, as columns over their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.functions.text import natural_key
from stripweave.operators.dedupe import near_hash_dedupe
from stripweave.session import stored

#: Files of fewer bytes are broken.
LEAST_BYTES = 1000


def download_completeness(files: DataFrame, *, least_bytes: int = LEAST_BYTES, least_files: int = 10) -> DataFrame:
    """Per series and chapter: valid and suspicious files, and whether there are enough valid ones."""
    ok = F.count_if(F.col("length") >= least_bytes)
    return files.groupBy("series", "chapter").agg(ok.alias("valid"), F.count_if(F.col("length") < least_bytes).alias("suspicious"), (ok >= least_files).alias("complete"))


def image_format(content: Column) -> Column:
    """jpg, png, webp, avif or gif by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(F.substring(head, 9, 16).isin("6674797061766966", "6674797061766973"), "avif")
    )


def payload_gate(content: Column, content_type: Column, width: Column, height: Column, *, least_bytes: int = 1024, least_side: int = 100) -> Column:
    """Why a payload is no page image; null for a good one."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) < least_bytes, "too_few_bytes").when(kind.contains("html") | kind.contains("json") | kind.contains("svg"), "content_type")
        .when(image_format(content).isNull(), "unknown_format").when((width < least_side) | (height < least_side), "too_small")
    )


def blank(white: Column, ink: Column, std: Column, edge: Column) -> Column:
    """``white`` is the share of pixels over 242, ``ink`` that under 232."""
    return ((white > 0.975) & (edge < 0.004)) | ((std < 12) & (edge < 0.003)) | ((ink < 0.012) & (edge < 0.0025))


def panel_gate(width: Column, height: Column, is_blank: Column, duplicate: Column) -> Column:
    """The first reason to reject a panel: unreadable, too_small, extreme_shape, blank, duplicate; null to keep it."""
    return (
        F.when(width.isNull() | height.isNull(), "unreadable").when((height < 140) | (width < 200), "too_small").when((width / height > 8) | (height / width > 12), "extreme_shape")
        .when(is_blank, "blank").when(duplicate, "duplicate")
    )


def validated_panels(panels: DataFrame, is_blank: Column, most_bits: int = 3) -> DataFrame:
    """Panels with ``reason``: what rejects them, null if nothing does. A panel that the other rules let pass is a duplicate if its ``hash`` differs
    in at most ``most_bits`` bits from that of an earlier accepted panel of its ``chapter``, by ``seq`` (unique in it). Rejected panels, and those
    without a hash, are nobody's copies and have none."""
    gated = panels.withColumn("reason", panel_gate(F.col("width"), F.col("height"), is_blank, F.lit(False)))
    sound = stored(gated.filter(F.col("reason").isNull() & F.col("hash").isNotNull()).select("chapter", "seq", "hash"))
    copies = near_hash_dedupe(sound, most_bits).filter(~F.col("kept")).select("chapter", "seq", F.lit("duplicate").alias("_copy"))
    return gated.join(copies, ["chapter", "seq"], "left").withColumn("reason", F.coalesce("reason", "_copy")).drop("_copy")


def interface_borders(border_std: Column, edge: Column) -> Column:
    """Buttons and bars: one border of high contrast, and edges all over."""
    return (border_std > 60) & (edge > 0.15)


def profile_card(width: Column, height: Column, centre_variance: Column, rim_variance: Column) -> Column:
    """A small portrait: the middle half varies more than twice as much as the rim."""
    return (height < 300) & (width <= 400) & (centre_variance > 2 * rim_variance)


def promotional(mean: Column, std: Column, light_share: Column) -> Column:
    """Nearly white or black without contrast, or of one colour: ``light_share`` is the share of pixels over the threshold that parts them best."""
    return (((mean > 240) | (mean < 30)) & (std < 50)) | (light_share > 0.8) | (1 - light_share > 0.8)


def unwanted(stats: dict[str, Column], position: Column, total: Column) -> Column:
    """Site furniture by its looks: tiny, small uniform squares, bars, interface parts among the first or last three (``position`` from 0), portraits and
    promotion. ``stats`` has the columns width, height, uniformity, edge, border_std, centre_variance, rim_variance, mean, std and light_share."""
    c, aspect = stats, stats["height"] / stats["width"]
    square = (aspect >= 0.8) & (aspect <= 1.25) & (c["height"] < 200) & (c["uniformity"] > 0.4)
    end = ((position < 3) | (position >= total - 3)) & interface_borders(c["border_std"], c["edge"])
    small = (c["width"] < 80) | (c["height"] < 80)
    card = profile_card(c["width"], c["height"], c["centre_variance"], c["rim_variance"])
    return F.coalesce(small | square | (aspect < 0.08) | (aspect > 15) | end | card | promotional(c["mean"], c["std"], c["light_share"]), F.lit(False))


def cut(width: Column, height: Column, borders: Sequence[Column]) -> Column:
    """Cut off on all sides: height to width out of range, or four dark borders."""
    aspect, dark = height / width, F.lit(True)
    for b in borders:
        dark = dark & (b > 0.4)
    return (aspect < 0.05) | (aspect > 25) | dark


def panel_class(width: Column, height: Column, white: Column, black: Column, edge: Column, variance: Column) -> Column:
    """panel, bubble, black, strip, fragment or other: the first of seven rules that fits. ``white`` is the share of pixels over 240, ``black`` that under 15."""
    aspect = height / width
    return (
        F.when((height > 200) & (width > 200) & (aspect > 0.3) & (aspect < 3) & (edge > 0.02) & (variance > 200), "panel")
        .when(((height < 200) | (width < 200)) & (white > 0.5) & (edge > 0.01), "bubble")
        .when((black > 0.5) & (height > 100) & (width > 100), "black")
        .when((aspect < 0.3) | (aspect > 4), F.when((height > 300) | (width > 300), "strip").otherwise("fragment"))
        .when((height < 100) | (width < 100) | (variance < 100) | (edge < 0.005), "fragment")
        .when((height > 100) & (width > 100) & (aspect > 0.2) & (aspect < 5) & (variance > 150), "panel")
        .otherwise("other")
    )


def scene_is_dark(mean: Column, dark: Column) -> Column:
    """``dark`` is the share of pixels under 70."""
    return (dark > 0.38) | (mean < 96)


def scene_label(mean: Column, dark: Column, light: Column, edge: Column) -> Column:
    """``light`` is the share of pixels over 210."""
    night = scene_is_dark(mean, dark) & (light < 0.2)
    return F.when(night, "night_or_black_background").when(edge > 0.12, "action_or_high_detail").when(light > 0.55, "bright_dialogue").otherwise("mixed_scene")


def scene_type(mean: Column, dark: Column) -> Column:
    return F.when((mean < 96) | (dark > 0.52), "night").when((mean > 188) & (dark < 0.2), "bright").otherwise("mixed")


def box_style(mean: Column, dark: Column, light: Column, scene_dark: Column) -> Column:
    return F.when((mean > 185) & (light > 0.35), "light_bubble").when(scene_dark & (dark > 0.45), "dark_caption").when((dark > 0.35) & (light > 0.2), "high_contrast_bubble").otherwise("mixed")


def scene_reject(bubble_share: Column, cut_bubbles: Column, density: Column, quality: Column, coverage: Column) -> Column:
    """Five rules by which a scene is mostly dialogue, or shows too little, and is not used."""
    return (
        ((cut_bubbles > 0) & (bubble_share > 0.3) & (density < 0.46)) | ((bubble_share > 0.38) & (density < 0.36)) | ((bubble_share > 0.48) & (density < 0.24))
        | ((bubble_share > 0.68) & (coverage < 0.86)) | ((quality < 0.24) & (coverage < 0.3))
    )


def format_detect(width: Column, height: Column, forced: Column | None = None) -> Column:
    found = F.when(height / width > 2.5, "webtoon").otherwise("manga")
    return found if forced is None else F.coalesce(forced, found)


def bubble_candidate(box: dict[str, Column], page_width: Column, page_height: Column) -> Column:
    """Confidence of a bright or dark region as a speech bubble; null where its size, place, fill or texture speak against it. ``box`` has the columns x, y, w, h,
    area (pixels of the region), edge (share of edge pixels in the box) and std."""
    x, y, w, h, area = (box[c] for c in ("x", "y", "w", "h", "area"))
    touches = (x <= 2) | (y <= 2) | (x + w >= page_width - 2)
    size = (w >= 0.1 * page_width) & (w <= 0.94 * page_width) & (h >= 24) & (h <= F.least(F.lit(560.0), 0.3 * page_height))
    place = ~(touches & (w > 0.44 * page_width) & (h > 0.22 * page_height))
    fill = area / F.greatest(F.lit(1), w * h)
    solid = (area >= F.greatest(F.lit(260), F.floor(0.1 * page_width * h))) & (fill >= 0.2)
    texture = (box["edge"] >= 0.0025) | (box["std"] >= 10)
    return F.when(size & place & solid & texture, F.round(F.least(F.lit(0.98), 0.4 + 0.35 * fill + 3 * box["edge"]), 3))


def ocr_threshold(threshold: float) -> float:
    return max(8.0, min(85.0, max(18.0, threshold)) - 22)


def engine_confidence_ok(engine: Column, confidence: Column, threshold: float = 60) -> Column:
    """Each engine's own scale: words above the threshold, the second above 0.5, the structured one from 0.35."""
    return F.when(engine == "words", confidence > threshold).when(engine == "second", confidence > 0.5).when(engine == "structured", confidence >= 0.35).otherwise(False)


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Per chapter: rows per reason, kept ones, and the share kept."""
    counts = rows.groupBy("chapter").pivot(reason, ["too_small", "extreme_shape", "blank", "duplicate", "kept"]).count().na.fill(0)
    total = sum((F.col(c) for c in ("too_small", "extreme_shape", "blank", "duplicate", "kept")), F.lit(0))
    return counts.withColumn("retention", F.round(F.col("kept") * 100.0 / total, 4))


def file_counts(files: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Files per series and chapter by kind."""
    return files.groupBy("series", "chapter").pivot("kind", list(kinds)).count().na.fill(0)


def renumbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], pattern: str = "panel_%04d") -> DataFrame:
    """``new_name`` by place within ``by``."""
    return rows.withColumn("new_name", F.format_string(pattern, F.row_number().over(Window.partitionBy(*by).orderBy(*order))))


def natural_order(files: DataFrame, by: Sequence[str] = ("series", "chapter")) -> DataFrame:
    """``seq``: the place of a file's name in natural order."""
    return files.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(natural_key(F.col("name")), "name")))


def recent_library(files: DataFrame, n: int = 40) -> DataFrame:
    """The n chapters changed last that hold any panel, newest first: a report of fixed size."""
    return files.groupBy("series", "chapter").agg(F.max("changed").alias("changed"), F.count_if(F.col("kind") == "panel").alias("panels")).filter("panels > 0").orderBy(F.desc("changed"), "series", "chapter").limit(n)


def without_subscenes(panels: DataFrame, subscenes: DataFrame) -> DataFrame:
    """Panels that were not cut further, and the scenes of those that were."""
    whole = panels.join(subscenes.select("base").distinct(), "base", "left_anti")
    return whole.select("base", F.col("base").alias("name")).unionByName(subscenes.select("base", "name"))


def fragment_pairs(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fragments paired one after the other, two by two: ``first, second`` (null for the last of an odd number)."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    pair = rows.withColumn("_at", at).withColumn("pair", F.floor(F.col("_at") / 2))
    return pair.groupBy(*by, "pair").agg(F.max(F.when(F.col("_at") % 2 == 0, F.col("name"))).alias("first"), F.max(F.when(F.col("_at") % 2 == 1, F.col("name"))).alias("second"))


def page_plan(files: DataFrame) -> DataFrame:
    """Pages of a chapter's document: its parts in natural order, or its full strip where it has none."""
    rows = files.filter(F.col("kind").isin("part", "full")).withColumn("_parts", F.count_if(F.col("kind") == "part").over(Window.partitionBy("series", "chapter")))
    rows = natural_order(rows.filter((F.col("kind") == "part") | (F.col("_parts") == 0)))
    label = F.when(F.col("kind") == "part", F.format_string("Part %d", "seq")).otherwise(F.lit("Full strip"))
    return rows.select("series", "chapter", "seq", "name", label.alias("label"))

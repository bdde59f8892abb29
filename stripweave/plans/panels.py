"""Queries of the panel and file operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.functions import geometry as G
from stripweave.operators import panels as O
from stripweave.plans.registry import greedy_sql, query
from stripweave.plans.texts import _scalar
from stripweave.sources.feeds import feed, with_feeds

C = F.col
ID = ["panel_id"]


def _blank() -> Column:
    return O.blank(C("white_ratio"), C("ink_ratio"), C("std"), C("edge_ratio"))


BLANK_SQL = "(white_ratio > 0.975 AND edge_ratio < 0.004) OR (std < 12 AND edge_ratio < 0.003) OR (ink_ratio < 0.012 AND edge_ratio < 0.0025)"


def _panel(name: str, columns: Callable[[], dict[str, Column]], sql: str, source: str = "panels") -> None:
    _scalar(name, "panels", ID, columns, with_feeds(f"SELECT panel_id, {sql} FROM {source}", "panels"))


_panel("blank_panel", lambda: {"blank": _blank()}, f"({BLANK_SQL}) AS blank")
_panel("cut_panel", lambda: {"cut": O.cut(C("width"), C("height"), [C(f"b{k}") for k in range(4)])}, "height / width < 0.05 OR height / width > 25 OR (b0 > 0.4 AND b1 > 0.4 AND b2 > 0.4 AND b3 > 0.4) AS cut")
_panel("panel_class", lambda: {"kind": O.panel_class(C("width"), C("height"), C("bright_ratio"), C("black_ratio"), C("edge_ratio"), C("std") * C("std"))},
    """CASE WHEN height > 200 AND width > 200 AND height / width > 0.3 AND height / width < 3 AND edge_ratio > 0.02 AND std * std > 200 THEN 'panel' WHEN (height < 200 OR width < 200) AND bright_ratio > 0.5 AND edge_ratio > 0.01 THEN 'bubble'
    WHEN black_ratio > 0.5 AND height > 100 AND width > 100 THEN 'black' WHEN height / width < 0.3 OR height / width > 4 THEN CASE WHEN height > 300 OR width > 300 THEN 'strip' ELSE 'fragment' END
    WHEN height < 100 OR width < 100 OR std * std < 100 OR edge_ratio < 0.005 THEN 'fragment' WHEN height > 100 AND width > 100 AND height / width > 0.2 AND height / width < 5 AND std * std > 150 THEN 'panel' ELSE 'other' END AS kind""")  # fmt: skip
_panel("scene_label", lambda: {"label": O.scene_label(C("mean"), C("dark_ratio"), C("light_ratio"), C("edge_ratio"))},
    "CASE WHEN (dark_ratio > 0.38 OR mean < 96) AND light_ratio < 0.2 THEN 'night_or_black_background' WHEN edge_ratio > 0.12 THEN 'action_or_high_detail' WHEN light_ratio > 0.55 THEN 'bright_dialogue' ELSE 'mixed_scene' END AS label")
_panel("scene_type", lambda: {"kind": O.scene_type(C("mean"), C("dark_ratio"))}, "CASE WHEN mean < 96 OR dark_ratio > 0.52 THEN 'night' WHEN mean > 188 AND dark_ratio < 0.2 THEN 'bright' ELSE 'mixed' END AS kind")
_panel("box_style", lambda: {"style": O.box_style(C("mean"), C("dark_ratio"), C("light_ratio"), C("mean") < 96)}, "CASE WHEN mean > 185 AND light_ratio > 0.35 THEN 'light_bubble' WHEN mean < 96 AND dark_ratio > 0.45 THEN 'dark_caption' WHEN dark_ratio > 0.35 AND light_ratio > 0.2 THEN 'high_contrast_bubble' ELSE 'mixed' END AS style")
_panel("scene_reject", lambda: {"reject": O.scene_reject(C("b0"), C("seq") % 4, C("b3"), C("b1"), C("b2"))},
    "(seq % 4 > 0 AND b0 > 0.3 AND b3 < 0.46) OR (b0 > 0.38 AND b3 < 0.36) OR (b0 > 0.48 AND b3 < 0.24) OR (b0 > 0.68 AND b2 < 0.86) OR (b1 < 0.24 AND b2 < 0.3) AS reject")


def _frame() -> Column:
    return G.shape_family(C("width"), C("height"))


_panel("shape_family", lambda: {"family": _frame()["name"], **dict(zip(("fit_w", "fit_h", "pad_x", "pad_y"), G.contain(C("width"), C("height"), _frame()), strict=True))},
    "family, greatest(1, floor(width * s + 0.5))::INT AS fit_w, greatest(1, floor(height * s + 0.5))::INT AS fit_h, floor((fw - greatest(1, floor(width * s + 0.5))) / 2)::INT AS pad_x, floor((fh - greatest(1, floor(height * s + 0.5))) / 2)::INT AS pad_y", "(SELECT *, least(fw / width, fh / height) AS s FROM (SELECT *, CASE WHEN r <= 0.72 THEN 'landscape' WHEN r <= 1.12 THEN 'square' ELSE 'portrait' END AS family, CASE WHEN r <= 0.72 THEN 1600 ELSE 1080 END AS fw, CASE WHEN r <= 0.72 THEN 900 WHEN r <= 1.12 THEN 1080 ELSE 1350 END AS fh FROM (SELECT *, height / width AS r FROM panels) p) q) r")
_panel("format_detect", lambda: {"format": O.format_detect(C("width"), C("height")), "forced": O.format_detect(C("width"), C("height"), F.when(C("seq") % 5 == 0, "manga"))}, "CASE WHEN height / width > 2.5 THEN 'webtoon' ELSE 'manga' END AS format, CASE WHEN seq % 5 = 0 THEN 'manga' WHEN height / width > 2.5 THEN 'webtoon' ELSE 'manga' END AS forced")
_panel("fit_scale", lambda: {"h": G.fit_scale(C("width"), C("height"), 1200)[1], **dict(zip(("page_w", "page_h", "longest"), G.optimal_width(C("width"), C("height"), 700), strict=True))},
    "greatest(1, floor(height * 1200 / width + 0.5))::INT AS h, 700 AS page_w, CASE WHEN width = 700 THEN height ELSE floor(height * (700 / width))::INT END AS page_h, greatest(700, CASE WHEN width = 700 THEN height ELSE floor(height * (700 / width))::INT END) AS longest")
_panel("rotate_hint", lambda: {"rotate": G.rotate_hint(C("width"), C("height"))}, "width > height * 1.5 AS rotate")
def _box() -> dict[str, Column]:
    w, h = F.floor(C("width") * C("b2")), F.floor(C("height") * C("b3") / 2)
    return {"x": F.floor(C("b0") * 100), "y": F.floor(C("b1") * 100), "w": w, "h": h, "area": F.floor(w * h * C("light_ratio")), "edge": C("edge_ratio"), "std": C("std")}


_panel("bubble_candidate_filter", lambda: {"confidence": O.bubble_candidate(_box(), C("width"), C("height"))},
    """CASE WHEN w >= 0.1 * width AND w <= 0.94 * width AND h >= 24 AND h <= least(560.0, 0.3 * height) AND NOT ((x <= 2 OR y <= 2 OR x + w >= width - 2) AND w > 0.44 * width AND h > 0.22 * height)
    AND area >= greatest(260, floor(0.1 * width * h)) AND area / greatest(1, w * h) >= 0.2 AND (edge_ratio >= 0.0025 OR std >= 10) THEN round(least(0.98, 0.4 + 0.35 * (area / greatest(1, w * h)) + 3 * edge_ratio), 3) END AS confidence""",
    "(SELECT *, floor(w * h * light_ratio) AS area FROM (SELECT *, floor(b0 * 100) AS x, floor(b1 * 100) AS y, floor(width * b2) AS w, floor(height * b3 / 2) AS h FROM panels) p) q")
_panel("ocr_conf_filter_legacy", lambda: {"ok": O.engine_confidence_ok(F.element_at(F.array(F.lit("words"), F.lit("second"), F.lit("structured")), (C("seq") % 3 + 1).cast("int")), F.when(C("seq") % 3 == 0, C("b0") * 100).otherwise(C("b0")))}, "CASE seq % 3 WHEN 0 THEN b0 * 100 > 60 WHEN 1 THEN b0 > 0.5 ELSE b0 >= 0.35 END AS ok")

#: A panel that passes the other rules is a copy if it is near to an earlier accepted one of its chapter.
GATE_SQL = f"CASE WHEN height < 140 OR width < 200 THEN 'too_small' WHEN width / height > 8 OR height / width > 12 THEN 'extreme_shape' WHEN {BLANK_SQL} THEN 'blank' END"
VALID_SQL = f"""first_gate AS (SELECT *, {GATE_SQL} AS early FROM panels), ranked AS (SELECT chapter, seq, hash, row_number() OVER (PARTITION BY chapter ORDER BY seq) AS n FROM first_gate WHERE early IS NULL),
near AS (SELECT x.chapter, x.seq AS a, y.seq AS b FROM ranked x JOIN ranked y ON x.chapter = y.chapter AND x.n < y.n AND bit_count(xor(x.hash, y.hash)) <= 3), {greedy_sql("chapter", "seq")},
seen AS (SELECT p.*, coalesce(early, CASE WHEN NOT kept THEN 'duplicate' END) AS verdict FROM first_gate p LEFT JOIN greedy g ON g.chapter = p.chapter AND g.ident = p.seq)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.validated_panels(feed(spark, sf_dir, "panels"), _blank())


@query("panel_gate", with_feeds(f"WITH RECURSIVE {VALID_SQL} SELECT panel_id, verdict AS reason FROM seen", "panels"))
def panel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).select("panel_id", "reason")


@query("unwanted_panel", with_feeds("""SELECT panel_id, width < 80 OR height < 80 OR (height / width >= 0.8 AND height / width <= 1.25 AND height < 200 AND uniformity > 0.4) OR height / width < 0.08 OR height / width > 15
    OR ((r < 3 OR r >= n - 3) AND border_std > 60 AND edge_ratio > 0.15) OR (height < 300 AND width <= 400 AND centre_variance > 2 * rim_variance) OR ((mean > 240 OR mean < 30) AND std < 50) OR light_share > 0.8 OR 1 - light_share > 0.8 AS unwanted
    FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq) - 1 AS r, count(*) OVER (PARTITION BY chapter) AS n FROM panels) p""", "panels"))
def unwanted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq) - 1 AS r, count(*) OVER (PARTITION BY chapter) AS n FROM {p}", p=feed(spark, sf_dir, "panels"))
    stats = {c: C(c) for c in ("width", "height", "uniformity", "border_std", "centre_variance", "rim_variance", "mean", "std", "light_share")} | {"edge": C("edge_ratio")}
    return rows.select("panel_id", O.unwanted(stats, C("r"), C("n")).alias("unwanted"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).na.fill("kept", ["reason"])


GATED = f"{VALID_SQL}, gated AS (SELECT *, coalesce(verdict, 'kept') AS reason FROM seen)"


@query("validation_counts", with_feeds(f"WITH RECURSIVE {GATED} SELECT chapter, count(*) FILTER (reason = 'too_small') AS too_small, count(*) FILTER (reason = 'extreme_shape') AS extreme_shape, count(*) FILTER (reason = 'blank') AS blank, count(*) FILTER (reason = 'duplicate') AS duplicate, count(*) FILTER (reason = 'kept') AS kept, round(count(*) FILTER (reason = 'kept') * 100.0 / count(*), 4) AS retention FROM gated GROUP BY 1", "panels"))
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reason_counts(_gated(spark, sf_dir))


@query("panel_validation", with_feeds(f"WITH RECURSIVE {GATED} SELECT panel_id, chapter, reason, CASE WHEN reason = 'kept' THEN format('panel_{{:04d}}', row_number() OVER (PARTITION BY chapter, reason ORDER BY seq)) END AS new_name FROM gated", "panels"))
def panel_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.renumbered(_gated(spark, sf_dir), ["chapter", "reason"], ["seq"])
    return rows.select("panel_id", "chapter", "reason", F.when(C("reason") == "kept", C("new_name")).alias("new_name"))


@query("valid_file_filter", with_feeds("SELECT series, chapter, count(*) FILTER (length >= 1000) AS valid, count(*) FILTER (length < 1000) AS suspicious, count(*) FILTER (length >= 1000) >= 10 AS complete FROM files GROUP BY 1, 2", "files"))
def valid_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.download_completeness(feed(spark, sf_dir, "files"))


KEY_SQL = "array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(ltrim(x, '0'), 20, '0') ELSE '1' || x END), chr(1))"


@query("natural_order", with_feeds(f"SELECT series, chapter, name, row_number() OVER (PARTITION BY series, chapter ORDER BY {KEY_SQL}, name)::INT AS seq FROM files", "files"))
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.natural_order(feed(spark, sf_dir, "files")).select("series", "chapter", "name", "seq")


KIND = "CASE doc_id % 4 WHEN 0 THEN 'panel' WHEN 1 THEN 'part' WHEN 2 THEN 'full' ELSE 'transcript' END"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "files").withColumn("kind", F.expr(KIND))


@query("file_counts", with_feeds(f"SELECT series, chapter, count(*) FILTER (k = 'panel') AS panel, count(*) FILTER (k = 'part') AS part, count(*) FILTER (k = 'full') AS \"full\", count(*) FILTER (k = 'transcript') AS transcript FROM (SELECT *, {KIND} AS k FROM files) f GROUP BY 1, 2", "files"))
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.file_counts(_kinds(spark, sf_dir), ["panel", "part", "full", "transcript"])


@query("recent_library", with_feeds(f"SELECT series, chapter, max(doc_id) AS changed, count(*) FILTER (k = 'panel') AS panels FROM (SELECT *, {KIND} AS k FROM files) f GROUP BY 1, 2 HAVING panels > 0 ORDER BY changed DESC, series, chapter LIMIT 40", "files"))
def recent_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recent_library(_kinds(spark, sf_dir).withColumn("changed", C("doc_id")))


@query("pdf_page_plan", with_feeds(f"SELECT series, chapter, seq::INT AS seq, name, CASE WHEN k = 'part' THEN 'Part ' || seq ELSE 'Full strip' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY series, chapter ORDER BY {KEY_SQL}, name) AS seq FROM (SELECT *, {KIND} AS k, count(*) FILTER ({KIND} = 'part') OVER (PARTITION BY series, chapter) AS parts FROM files) f WHERE k = 'part' OR (k = 'full' AND parts = 0)) g", "files"))
def pdf_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.page_plan(_kinds(spark, sf_dir))


@query("multi_scene_anti_join", with_feeds("SELECT panel_id, CASE WHEN panel_id % 3 = 0 THEN 'p' || panel_id || '_s0' || k ELSE 'p' || panel_id END AS name FROM panels, (SELECT unnest(range(1, 3)) AS k) WHERE panel_id % 3 = 0 OR k = 1", "panels"))
def multi_scene_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = feed(spark, sf_dir, "panels").select("panel_id", F.concat(F.lit("p"), C("panel_id").cast("string")).alias("base"))
    subs = base.filter("panel_id % 3 = 0").select("base", F.explode(F.array(F.lit("_s01"), F.lit("_s02"))).alias("s")).select("base", F.concat("base", "s").alias("name"))
    return O.without_subscenes(base, subs).select(F.substring(C("base"), 2, 30).cast("long").alias("panel_id"), "name")


@query("pair_fragments", with_feeds("SELECT chapter, pair, max(name) FILTER (k % 2 = 0) AS first, max(name) FILTER (k % 2 = 1) AS second FROM (SELECT chapter, k, k // 2 AS pair, 'f' || panel_id AS name FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq) - 1 AS k FROM panels) p) q GROUP BY 1, 2", "panels"))
def pair_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir, "panels").select("chapter", "seq", F.concat(F.lit("f"), C("panel_id").cast("string")).alias("name"))
    return O.fragment_pairs(rows, ["chapter"], ["seq"])


@query("renumber", with_feeds("SELECT panel_id, format('{:03d}.png', row_number() OVER (PARTITION BY chapter ORDER BY seq)) AS new_name FROM panels", "panels"))
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.renumbered(feed(spark, sf_dir, "panels"), ["chapter"], ["seq"], "%03d.png").select("panel_id", "new_name")


@query("strip_canvas", with_feeds("SELECT series, chapter, least(1200, greatest(400, median(width)))::DOUBLE AS canvas_width, sum(height)::BIGINT AS total_height FROM files GROUP BY 1, 2", "files"))
def strip_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "files").groupBy("series", "chapter").agg(F.least(F.lit(1200.0), F.greatest(F.lit(400.0), F.median("width"))).alias("canvas_width"), F.sum("height").alias("total_height"))


@query("running_offsets", with_feeds(f"SELECT doc_id, (sum(height) OVER w - height)::BIGINT AS y_start, (sum(height) OVER w)::BIGINT AS y_end FROM files WINDOW w AS (PARTITION BY series, chapter ORDER BY {KEY_SQL}, name ROWS UNBOUNDED PRECEDING)", "files"))
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.sum("height").over(Window.partitionBy("series", "chapter").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return O.natural_order(feed(spark, sf_dir, "files")).select("doc_id", (end - C("height")).alias("y_start"), end.alias("y_end"))

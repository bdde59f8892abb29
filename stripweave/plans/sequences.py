"""Queries of the sequence operators over row profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.operators import sequence as O
from stripweave.plans.registry import query
from stripweave.sources.feeds import feed, with_feeds

C = F.col
QUIET = "row_std < 10 AND edge_density < 0.006 AND foreground < 0.045"
#: The test strips have 720 rows, so heights are scaled down.
SCENES = {"least": 60, "most": 240, "target": 120}
PANELS = {"shortest": 4, "gap": 3, "most": 20, "target": 16, "near": 3, "margin": 4, "least": 4}
BEAT = 0.1
W = "WINDOW w AS (PARTITION BY strip_id ORDER BY y)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "rows")


def _runs(mask: str, name: str, source: str = "strip_rows") -> str:
    return f"{name} AS (SELECT strip_id, min(y) AS start, max(y) + 1 AS \"end\" FROM (SELECT strip_id, y, y - row_number() OVER (PARTITION BY strip_id ORDER BY y) AS i FROM {source} WHERE {mask}) r GROUP BY strip_id, i)"


CONTENT = "marked AS (SELECT *, abs(row_mean - quantile_cont(row_mean, 0.88) OVER (PARTITION BY strip_id)) > 9 OR edge_density > 0.01 AS content FROM strip_rows), grown AS (SELECT *, coalesce(sum(content::INT) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) > 0 AS mask FROM marked)"


@query("quiet_rows", with_feeds(f"SELECT strip_id, y, {QUIET} AS quiet FROM strip_rows", "rows"))
def quiet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("strip_id", "y", O.quiet(C("row_std"), C("edge_density"), C("foreground")).alias("quiet"))


@query("content_rows", with_feeds(f"WITH {CONTENT} SELECT strip_id, y, content FROM marked", "rows"))
def content_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.content_rows(_rows(spark, sf_dir)).select("strip_id", "y", "content")


@query("boolean_runs", with_feeds(f"WITH {_runs(QUIET, 'runs')} SELECT * FROM runs", "rows"))
def boolean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.boolean_runs(_rows(spark, sf_dir).withColumn("q", O.quiet(C("row_std"), C("edge_density"), C("foreground"))), "q")


@query("smooth_rows", with_feeds("SELECT strip_id, y, round(sum(row_mean) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 9) AS odd, round(sum(row_std) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8, 9) AS even FROM strip_rows", "rows"))
def smooth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("strip_id", "y", F.round(O.smoothed("row_mean", 7), 9).alias("odd"), F.round(O.smoothed("row_std", 8), 9).alias("even"))


@query("dilate_mask", with_feeds(f"WITH {CONTENT} SELECT strip_id, y, mask FROM grown", "rows"))
def dilate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.content_rows(_rows(spark, sf_dir)).select("strip_id", "y", O.dilated(C("content"), 2).alias("mask"))


MERGED = f"{CONTENT}, {_runs('mask', 'runs', 'grown')}, merged AS (SELECT strip_id, min(start) AS start, max(\"end\") AS \"end\" FROM (SELECT *, sum(n) OVER (PARTITION BY strip_id ORDER BY start) AS g FROM (SELECT *, coalesce(start - lag(\"end\") OVER (PARTITION BY strip_id ORDER BY start) >= 3, true)::INT AS n FROM runs) a) b GROUP BY strip_id, g)"
STATS = """SELECT m.strip_id, m.start, m."end", avg(row_mean) AS mean, sqrt(greatest(0, avg(row_std * row_std + row_mean * row_mean) - avg(row_mean) * avg(row_mean))) AS contrast, avg(edge_density) AS edge, avg(foreground) AS content_ratio, avg(white) AS white_ratio, avg(ink) AS ink_ratio, avg(dark) AS dark_ratio FROM merged m JOIN strip_rows r ON r.strip_id = m.strip_id AND r.y >= m.start AND r.y < m."end" GROUP BY 1, 2, 3"""


@query("merge_close_ranges", with_feeds(f"WITH {MERGED} SELECT * FROM merged", "rows"))
def merge_close_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = O.content_rows(_rows(spark, sf_dir)).withColumn("mask", O.dilated(C("content"), 2))
    return O.merge_close(O.boolean_runs(marked, "mask"), 3)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_close_ranges(spark, sf_dir)


@query("range_stats", with_feeds(f"WITH {MERGED} SELECT strip_id, start, \"end\", round(mean, 6) AS mean, round(contrast, 6) AS contrast, round(edge, 8) AS edge, round(white_ratio, 8) AS white_ratio, round(ink_ratio, 8) AS ink_ratio, round(dark_ratio, 8) AS dark_ratio FROM ({STATS}) s", "rows"))
def range_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = O.range_stats(_rows(spark, sf_dir), _merged(spark, sf_dir))
    return s.select("strip_id", "start", "end", *(F.round(c, n).alias(c) for c, n in (("mean", 6), ("contrast", 6), ("edge", 8), ("white_ratio", 8), ("ink_ratio", 8), ("dark_ratio", 8))))


@query("content_range_filter", with_feeds(f"WITH {MERGED} SELECT strip_id, start, \"end\" FROM ({STATS}) s WHERE \"end\" - start >= 4 AND NOT ((white_ratio > 0.955 AND edge < 0.006) OR (contrast < 14 AND edge < 0.004) OR (ink_ratio < 0.018 AND edge < 0.0035))", "rows"))
def content_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = O.range_stats(_rows(spark, sf_dir), _merged(spark, sf_dir))
    return s.filter(O.content_range_ok(C("end") - C("start"), C("white_ratio"), C("ink_ratio"), C("contrast"), C("edge"), 4)).select("strip_id", "start", "end")


def _smooth_sql(c: str) -> str:
    return f"sum({c}) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS {c}"


TRANSITION = f"""s AS (SELECT strip_id, y, {', '.join(map(_smooth_sql, ('row_mean', 'row_std', 'foreground', 'edge_density')))} FROM strip_rows),
t AS (SELECT strip_id, y, round(abs(lead(row_mean, 10) OVER w - lag(row_mean, 10) OVER w) / 255 + abs(lead(row_std, 10) OVER w - lag(row_std, 10) OVER w) / 90 + abs(lead(foreground, 10) OVER w - lag(foreground, 10) OVER w) * 0.9 + abs(lead(edge_density, 10) OVER w - lag(edge_density, 10) OVER w) * 5, 9) AS strength FROM s {W}),
u AS (SELECT *, max(strength) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top, quantile_cont(strength, 0.96) OVER (PARTITION BY strip_id) AS q FROM t WHERE strength IS NOT NULL)"""


@query("transition_score", with_feeds(f"WITH {TRANSITION} SELECT strip_id, y, strength FROM u WHERE strength >= greatest(0.16, q) AND strength >= top", "rows"))
def transition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.transition_scores(_rows(spark, sf_dir))


def _beats_sql(source: str = "strip_rows") -> str:
    """Span 150, gap 30, smoothing over 41 rows, radius 37: those of a strip 720 wide."""
    smooth = ", ".join(f"sum({c}) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) / 41 * {scale!r} AS {c}" for c, scale, _ in O.BEATS)
    score = " + ".join(f"abs(avg({c}) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 150 PRECEDING AND 31 PRECEDING) - avg({c}) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 30 FOLLOWING AND 149 FOLLOWING)) * {weight!r}" for c, _, weight in O.BEATS)
    return f"""bs AS (SELECT strip_id, y, {smooth} FROM {source}), bt AS (SELECT strip_id, y, round({score}, 8) AS strength, max(y) OVER (PARTITION BY strip_id) + 1 AS total FROM bs),
bu AS (SELECT *, max(strength) OVER (PARTITION BY strip_id ORDER BY y ROWS BETWEEN 37 PRECEDING AND 37 FOLLOWING) AS top, quantile_cont(strength, 0.94) OVER (PARTITION BY strip_id) AS q FROM bt WHERE y >= 150 AND y < total - 150 AND total >= {O.BEAT_ROWS}),
beats AS (SELECT strip_id, y, strength FROM bu WHERE strength >= greatest({BEAT}, q) AND strength >= top)"""


BEAT_ROWS_SQL = "cut_rows AS (SELECT * FROM strip_rows WHERE strip_id % 5 > 1 OR strip_id % 5 = 0 AND y < 419 OR strip_id % 5 = 1 AND y < 420)"


@query("action_beats", with_feeds(f"WITH {BEAT_ROWS_SQL}, {_beats_sql('cut_rows')} SELECT * FROM beats", "rows"))
def action_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth strip is just too short for beats, and the next one just long enough."""
    part = F.col("strip_id") % 5
    rows = _rows(spark, sf_dir).filter((part > 1) | ((part == 0) & (C("y") < 419)) | ((part == 1) & (C("y") < 420)))
    return O.action_beats(rows, least=BEAT)


@query("safe_boundary", with_feeds(f"""WITH {_runs(QUIET, 'runs')}, h AS (SELECT strip_id, max(y) + 1 AS total FROM strip_rows GROUP BY 1), c AS (SELECT strip_id, start + ("end" - start) // 2 AS target, greatest(1, start) AS low, least(total - 1, "end") AS high FROM runs JOIN h USING (strip_id) WHERE "end" - start >= 6)
SELECT strip_id, target, y AS cut FROM (SELECT c.strip_id, target, y, row_number() OVER (PARTITION BY c.strip_id, target, low, high ORDER BY round(0.42 * least(1.0, row_std / 55) + 0.38 * least(1.0, edge_density / 0.08) + 0.16 * least(1.0, foreground) + 0.04 * abs(y - target) / greatest(1, high - low), 12), y) AS r FROM c JOIN strip_rows s ON s.strip_id = c.strip_id AND y >= low AND y < high) x WHERE r = 1""", "rows"))
def safe_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    runs = O.boolean_runs(rows.withColumn("q", O.quiet(C("row_std"), C("edge_density"), C("foreground"))), "q").withColumn("n", C("end") - C("start")).filter("n >= 6")
    total = rows.groupBy("strip_id").agg((F.max("y") + 1).alias("total"))
    candidates = runs.join(total, "strip_id").select("strip_id", (C("start") + F.floor(C("n") / 2)).alias("target"), F.greatest(F.lit(1), "start").alias("low"), F.least(C("total") - 1, C("end")).alias("high"))
    return O.safe_boundaries(candidates, rows)


def _safest(source: str) -> str:
    return f"""SELECT strip_id, y AS cut, strength, kind FROM (SELECT c.strip_id, c.strength, c.kind, s.y, row_number() OVER (PARTITION BY c.strip_id, target, low, high, c.strength, c.kind ORDER BY round(0.42 * least(1.0, row_std / 55) + 0.38 * least(1.0, edge_density / 0.08) + 0.16 * least(1.0, foreground) + 0.04 * abs(s.y - target) / greatest(1, high - low), 12), s.y) AS r
FROM {source} c JOIN strip_rows s ON s.strip_id = c.strip_id AND s.y >= low AND s.y < high) x WHERE r = 1"""


CANDIDATES = f"""{_runs(QUIET, 'runs')}, h AS (SELECT strip_id, max(y) + 1 AS total FROM strip_rows GROUP BY 1), {TRANSITION}, {_beats_sql()},
wanted AS (SELECT strip_id, start + ("end" - start) // 2 AS target, greatest(1, start) AS low, least(total - 1, "end") AS high, 3 + least(2.0, ("end" - start) / 40) AS strength, 'gutter' AS kind FROM runs JOIN h USING (strip_id) WHERE "end" - start >= 6
  UNION ALL SELECT strip_id, y, greatest(1, y - 36), least(total - 1, y + 37), 1 + strength, 'transition' FROM u JOIN h USING (strip_id) WHERE strength >= greatest(0.16, q) AND strength >= top
  UNION ALL SELECT strip_id, y, greatest(1, y - 75), least(total - 1, y + 76), 1.6 + least(2.2, strength), 'action_beat' FROM beats JOIN h USING (strip_id)), candidates AS ({_safest('wanted')})"""


@query("candidate_union", with_feeds(f"WITH {CANDIDATES} SELECT strip_id, cut, round(strength, 6) AS strength, kind FROM candidates", "rows"))
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cut_candidates(_rows(spark, sf_dir), beat=BEAT).withColumn("strength", F.round("strength", 6))


@query("dedupe_boundaries", with_feeds(f"""WITH RECURSIVE {CANDIDATES}, r AS MATERIALIZED (SELECT strip_id, cut, round(strength, 9) AS strength, kind, row_number() OVER (PARTITION BY strip_id ORDER BY cut, kind, round(strength, 9) DESC) AS n FROM candidates),
g AS (SELECT strip_id, n, cut, strength, kind, 1 AS place FROM r WHERE n = 1 UNION ALL
 SELECT strip_id, n, CASE WHEN far OR stronger THEN new_cut ELSE cut END, CASE WHEN far OR stronger THEN new_strength ELSE strength END, CASE WHEN far OR stronger THEN new_kind ELSE kind END, place + far::INT
 FROM (SELECT g.strip_id, r.n, g.cut, g.strength, g.kind, place, r.cut AS new_cut, r.strength AS new_strength, r.kind AS new_kind, r.cut - g.cut >= 30 AS far, r.strength > g.strength AS stronger FROM g JOIN r ON r.strip_id = g.strip_id AND r.n = g.n + 1) x)
SELECT strip_id, arg_max(cut, n) AS cut, round(arg_max(strength, n), 6) AS strength, arg_max(kind, n) AS kind FROM g GROUP BY strip_id, place""", "rows"))
def dedupe_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.cut_candidates(_rows(spark, sf_dir), beat=BEAT).withColumn("strength", F.round("strength", 9))
    return O.dedupe_boundaries(found, 30).withColumn("strength", F.round("strength", 6))


@query("scene_cuts")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return O.scene_cuts(O.gutter_candidates(rows), rows, **SCENES)


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bubbles = feed(spark, sf_dir, "boxes").select((C("image_id") % 1000).alias("strip_id"), F.concat_ws(":", "image_id", "ann_id").alias("box_id"), "x", ((C("y") + C("image_id") * 13) % 690).alias("y"), C("w").alias("width"), (C("h") / 2).alias("height"))
    return O.scene_detection(_rows(spark, sf_dir), bubbles, spacing=30, trim=40, beat=BEAT, **SCENES)


@query("scene_detection")
def scene_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir)


@query("scene_manifest_stats")
def scene_manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.scene_manifest(_scenes(spark, sf_dir))


@query("trim_quiet_edges", with_feeds(f"""WITH w AS (SELECT strip_id, k * 120 AS start, k * 120 + 120 AS "end" FROM (SELECT DISTINCT strip_id FROM strip_rows) d, (SELECT unnest(range(6)) AS k)),
l AS (SELECT w.strip_id, w.start, w."end", min(y) AS a, max(y) AS b FROM w LEFT JOIN (SELECT * FROM strip_rows WHERE NOT ({QUIET})) r ON r.strip_id = w.strip_id AND y >= start AND y < "end" GROUP BY 1, 2, 3),
t AS (SELECT *, greatest(start, least(start + 40, "end" - 60, coalesce(a, "end"))) AS top FROM l)
SELECT strip_id, top AS start, least("end", greatest(coalesce(b + 1, 0), greatest(top + 60, "end" - 40) + 1)) AS "end" FROM t""", "rows"))
def trim_quiet_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    whole = rows.select("strip_id").distinct().select("strip_id", F.posexplode(F.sequence(F.lit(0), F.lit(600), F.lit(120)))).select("strip_id", C("col").alias("start"), (C("col") + 120).alias("end"))
    return O.trim_quiet_edges(whole, rows, limit=40)


@query("split_long_ranges")
def split_long_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.split_long(_merged(spark, sf_dir), _rows(spark, sf_dir), most=20, target=16, reach=3, margin=4)


@query("content_panels")
def content_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.content_panels(_rows(spark, sf_dir), **PANELS).select("strip_id", "start", "end", F.round("mean", 6).alias("mean"))


WEB = {"least": 5, "gap": 2, "padding": 2, "margin": 4, "most": 60, "shortest": 10}


@query("webtoon_panels")
def webtoon_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.webtoon_panels(_rows(spark, sf_dir), **WEB)


@query("panels_no_filter")
def panels_no_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run between rows of paper, whole."""
    return O.webtoon_panels(_rows(spark, sf_dir), least=1, gap=1, padding=0, margin=0, most=1 << 30, shortest=0)


@query("chunk_by_count")
def chunk_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return O.chunks_by_count(O.webtoon_panels(rows, **{**WEB, "padding": 0}), rows, shortest=5)


@query("bubble_scene_overlap", with_feeds("WITH b AS (SELECT panel_id % 100 AS strip_id, panel_id AS box_id, (panel_id * 37) % 700 AS y, 10 + panel_id % 60 AS height FROM panels), s AS (SELECT strip_id, k * 90 AS start, k * 90 + 90 AS \"end\" FROM (SELECT DISTINCT strip_id FROM b) d, (SELECT unnest(range(8)) AS k)) SELECT b.strip_id, box_id, start, greatest(0, y - start) AS scene_y FROM b JOIN s ON b.strip_id = s.strip_id AND y < \"end\" AND y + height > start", "panels"))
def bubble_scene_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = feed(spark, sf_dir, "panels").select((C("panel_id") % 100).alias("strip_id"), C("panel_id").alias("box_id"), ((C("panel_id") * 37) % 700).alias("y"), (10 + C("panel_id") % 60).alias("height"))
    scenes = boxes.select("strip_id").distinct().select("strip_id", F.explode(F.sequence(F.lit(0), F.lit(630), F.lit(90))).alias("start")).withColumn("end", C("start") + 90)
    return O.overlapping(boxes, scenes).select("strip_id", "box_id", "start", "scene_y")


@query("range_manifest_join", with_feeds(f"WITH {_runs(QUIET, 'runs')}, a AS (SELECT *, row_number() OVER (PARTITION BY strip_id ORDER BY start) AS n FROM runs), c AS (SELECT strip_id, n FROM a UNION ALL SELECT strip_id, coalesce(max(n), 0) + 1 FROM (SELECT DISTINCT strip_id FROM strip_rows) d LEFT JOIN a USING (strip_id) GROUP BY 1) SELECT c.strip_id, 'cut_' || lpad(c.n::VARCHAR, 3, '0') AS name, a.start, a.\"end\" FROM c LEFT JOIN a ON a.strip_id = c.strip_id AND a.n = c.n", "rows"))
def range_manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many cuts as a strip has quiet runs, and one that has none."""
    rows = _rows(spark, sf_dir)
    runs = O.boolean_runs(rows.withColumn("q", O.quiet(C("row_std"), C("edge_density"), C("foreground"))), "q")
    counts = rows.select("strip_id").distinct().join(runs.groupBy("strip_id").agg(F.count("*").alias("n")), "strip_id", "left").na.fill(0, ["n"])
    cuts = counts.select("strip_id", F.explode(F.sequence(F.lit(1), C("n") + 1)).alias("n")).select("strip_id", F.format_string("cut_%03d", "n").alias("name"))
    return O.manifest_by_place(cuts, runs)


@query("visual_focus", with_feeds("SELECT strip_id, round(coalesce(sum(edge_density * y) / nullif(sum(edge_density), 0), 360), 6) AS focus FROM strip_rows GROUP BY 1", "rows"))
def visual_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.visual_focus(_rows(spark, sf_dir), ["strip_id"], C("edge_density"), C("y"), 360.0).withColumn("focus", F.round("focus", 6))


@query("part_cuts")
def part_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections end where the quiet runs do."""
    rows = _rows(spark, sf_dir)
    runs = O.boolean_runs(rows.withColumn("q", O.quiet(C("row_std"), C("edge_density"), C("foreground"))), "q").filter(C("end") - C("start") > 3)
    return O.part_cuts(runs.select("strip_id", C("end").alias("y_end")), rows, most=140, shortest=20, before=9, after=3, margin=10)

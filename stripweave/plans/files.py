"""Queries of sources, writers, pictures and streams: tables are written to the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.operators import dataset as D
from stripweave.operators import dialogue as L
from stripweave.operators import panels as P
from stripweave.operators import stories as T
from stripweave.operators.folds import ordered_fold, parts
from stripweave.operators.stitching import stitch_chain
from stripweave.plans.attempts import ARM_SQL, METHODS
from stripweave.plans.dataset import CLASS_SQL, COCO_IMAGES, LABELS, SPLITS, _with
from stripweave.plans.dedup import VECTORS, _vectors
from stripweave.plans.dialogue import _mentions, _spoken
from stripweave.plans.panels import GATED, KEY_SQL, _gated, running_offsets
from stripweave.plans.registry import query
from stripweave.plans.stories import CAST, NAMES, RETAINED, _chapters, _summaries
from stripweave.plans.texts import TYPE_SQL
from stripweave.session import stored, work_dir
from stripweave.sinks import writers as W
from stripweave.sinks.pictures import write_pictures
from stripweave.sources import files as X
from stripweave.sources.feeds import feed, read, with_feeds
from stripweave.sources.subscenes import panel_scenes
from stripweave.streaming import learners

C = F.col


@query("payload_gate", "SELECT doc_id, CASE WHEN strlen(text) + 3 < 1024 THEN 'too_few_bytes' WHEN doc_id % 5 = 0 THEN 'content_type' WHEN doc_id % 5 = 1 THEN 'unknown_format' WHEN doc_id % 400 < 100 THEN 'too_small' END AS problem FROM documents")
def payload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    content = F.concat(F.unhex(F.when(C("doc_id") % 5 == 1, "414243").otherwise("FFD8FF")), C("text").cast("binary"))
    kind = F.when(C("doc_id") % 5 == 0, "text/html").otherwise("image/jpeg")
    return docs.select("doc_id", P.payload_gate(content, kind, (C("doc_id") % 400).cast("int"), F.lit(500)).alias("problem"))


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dataset_export(feed(spark, sf_dir, "boxes"))


@query("scan_yolo_labels", _with("SELECT image_id::VARCHAR AS stem, class_id, count(*) AS n FROM labels_ok JOIN splits USING (image_id) GROUP BY 1, 2", LABELS, SPLITS))
def scan_yolo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of all images, written by split and scanned again."""
    path = work_dir(spark)
    W.write_yolo_labels(_exported(spark, sf_dir), path)
    return X.yolo_labels(spark, f"{path}/labels").groupBy("stem", "class_id").agg(F.count("*").alias("n"))


@query("scan_annotations", with_feeds("SELECT image_id, count(*) AS n, round(sum(x), 4) AS x, round(sum(w), 4) AS w, min(CASE WHEN image_id % 2 = 0 THEN 'face' ELSE 'panel' END) AS class FROM boxes GROUP BY 1", "boxes"))
def scan_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document has classes; the others use the older key."""
    boxes = feed(spark, sf_dir, "boxes")
    box = F.struct("x", "y", C("w").alias("width"), C("h").alias("height"), F.when(C("image_id") % 2 == 0, "face").alias("class"))
    docs = boxes.groupBy("image_id").agg(F.collect_list(box).alias("b"))
    path = work_dir(spark)
    new = C("image_id") % 2 == 0
    docs.select(F.concat(F.lit("a/"), "image_id", F.lit(".png")).alias("image_path"), F.lit(800).alias("image_width"), F.lit(600).alias("image_height"), F.when(new, C("b")).alias("annotations"), F.when(~new, C("b")).alias("panels")).write.json(path)
    rows = X.annotations(spark, path, one_per_file=False)
    return rows.groupBy(C("stem").cast("long").alias("image_id")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("w"), 4).alias("w"), F.min("class").alias("class"))


@query("write_coco_json", _with("SELECT split, image_id AS id, 'img_' || i.image_id || '.jpg' AS file_name, count(*) AS annotations, string_agg(DISTINCT class, ',' ORDER BY class) AS classes, round(sum((cx - nw / 2) * 800), 4) AS x, round(sum((cy - nh / 2) * 600), 4) AS y, round(sum(nw * 800), 4) AS w, round(sum(nh * 600), 4) AS h FROM labels_ok l JOIN coco_images i USING (image_id) JOIN classes USING (class_id) GROUP BY ALL", LABELS, SPLITS, COCO_IMAGES, CLASS_SQL))
def write_coco_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of every image, read back from its document."""
    labels = D.yolo_labels(feed(spark, sf_dir, "boxes"))
    path = work_dir(spark)
    W.write_coco_json(labels, D.split_images(labels, "image_id"), path, images_each=2000)
    docs = X.coco_documents(spark, path)
    names = F.map_from_entries(F.transform("categories", lambda c: F.struct(c["id"], c["name"])))
    image = F.transform("images", lambda i: F.struct(i["id"].alias("image"), i["file_name"].alias("file_name"), F.lit(None).cast("long").alias("category"), F.array().cast("array<double>").alias("b")))
    ann = F.transform("annotations", lambda a: F.struct(a["image_id"].alias("image"), F.lit(None).cast("string").alias("file_name"), a["category_id"].alias("category"), a["bbox"].alias("b")))
    rows = docs.select("split", "part", names.alias("names"), F.explode(F.concat(image, ann)).alias("r"))  # a document is read once
    rows = rows.select("split", "part", "r.*", F.try_element_at("names", C("r.category")).alias("class"))
    sides = {s: F.round(F.sum(F.get("b", F.lit(i))), 4).alias(s) for i, s in enumerate("xywh")}
    classes = F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes")
    rows = rows.filter("file_name IS NOT NULL OR class IS NOT NULL").groupBy("split", "part", "image").agg(F.max("file_name").alias("file_name"), F.count("class").alias("annotations"), classes, *sides.values())
    rows = rows.filter("file_name IS NOT NULL AND annotations > 0")
    return rows.select("split", F.regexp_extract("file_name", "[0-9]+", 0).cast("long").alias("id"), "file_name", "annotations", "classes", *sides)


@query("write_splits", _with("SELECT split, count(*) AS labels, count(DISTINCT image_id) AS images, round(sum(cx + cy + nw + nh), 3) AS total, array_to_string(list_sort(list_distinct(list(image_id)))[:10], ',') AS first_names, 42::BIGINT AS seed FROM labels_ok JOIN splits USING (image_id) GROUP BY 1", LABELS, SPLITS))
def write_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    W.write_splits(_exported(spark, sf_dir), path)
    rows = spark.read.parquet(f"{path}/rows").groupBy("split").agg(F.count("*").alias("labels"), F.round(F.sum(C("cx") + C("cy") + C("nw") + C("nh")), 3).alias("total"))
    info = spark.read.json(f"{path}/info").select("split", "images", F.array_join("first_names", ",").alias("first_names"), "seed")
    return rows.join(info, "split")


def _manifest(spark: SparkSession, sf_dir: str) -> str:
    files = P.natural_order(feed(spark, sf_dir, "files")).join(running_offsets(spark, sf_dir), "doc_id")
    path = work_dir(spark)
    W.write_manifest(files.select(F.concat_ws("-", "series", "chapter").alias("strip_id"), C("seq").alias("index"), C("name").alias("source"), "height", "y_start", "y_end"), path)
    return path


@query("write_manifest", with_feeds(f"SELECT series || '-' || chapter AS strip_id, name AS source, height, (sum(height) OVER w)::BIGINT AS y_end, (sum(height) OVER (PARTITION BY series, chapter))::BIGINT AS canvas_height FROM files WINDOW w AS (PARTITION BY series, chapter ORDER BY {KEY_SQL}, name ROWS UNBOUNDED PRECEDING)", "files"))
def write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.manifests(spark, _manifest(spark, sf_dir)).select("strip_id", "canvas_height", F.explode("sections").alias("s"))
    return rows.select("strip_id", C("s.source").alias("source"), C("s.height").alias("height"), C("s.y_end").alias("y_end"), "canvas_height")


@query("update_manifest", with_feeds("""SELECT series || '-' || chapter AS strip_id, count(*) AS sections, CASE WHEN even THEN 3 ELSE 0 END AS panels, CASE WHEN even THEN 1 ELSE 0 END AS scenes,
 CASE WHEN even THEN 'chapter/' || chapter || '/2' END AS last_panel, NOT even AS same
 FROM (SELECT *, regexp_extract(chapter, '[0-9]+')::BIGINT % 2 = 0 AS even FROM files) f GROUP BY series, chapter, even""", "files"))
def update_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels and scenes of every other chapter's strips put into their manifests, panels twice; all else stays byte for byte."""
    path = _manifest(spark, sf_dir)
    before = W.manifests(spark, path)
    text = lambda rows: F.to_json(F.struct(*(c for c in rows.columns if c not in ("panels", "scenes"))))
    old = stored(before.select("strip_id", text(before).alias("old"), F.to_json(F.struct(*before.columns)).alias("whole")))
    chapter = F.substring_index("strip_id", "-", -1)
    strips = old.filter(F.regexp_extract(chapter, "[0-9]+", 0).cast("long") % 2 == 0).select("strip_id", chapter.alias("chapter"))

    def ranges(n: int, mark: str) -> Column:
        name = lambda i: F.concat(F.lit(mark), C("chapter"), F.lit("/"), i.cast("string"))
        of = lambda i: F.struct(name(i).alias("name"), (i * 10).cast("long").alias("start"), (i * 10 + 10).cast("long").alias("end"))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)

    W.update_manifests(spark, path, strips.select("strip_id", ranges(2, "first/").alias("panels")), 1)
    W.update_manifests(spark, path, strips.select("strip_id", ranges(3, "chapter/").alias("panels"), ranges(1, "scene/").alias("scenes")), 2)
    now = W.manifests(spark, path)
    rows = now.withColumns({"new": text(now), "now": F.to_json(F.struct(*now.columns))}).join(old, "strip_id").filter("new = old")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    last = F.when(size("panels") > 0, F.element_at("panels", -1)["name"])
    return rows.select("strip_id", F.size("sections").cast("long").alias("sections"), size("panels").alias("panels"), size("scenes").alias("scenes"), last.alias("last_panel"), (C("now") == C("whole")).alias("same"))


@query("scan_documents_json", with_feeds("SELECT series || '-' || chapter AS strip_id, 2 AS version, false AS corrupt FROM files GROUP BY series, chapter", "files"))
def scan_documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.json_documents(spark, _manifest(spark, sf_dir), "version int, canvas_height long, strip_id string", one_per_file=False)
    return rows.select("strip_id", "version", "corrupt")


@query("write_dialogue", with_feeds(f"SELECT series, chapter, row_number() OVER (PARTITION BY series, chapter ORDER BY block) AS place, panel, text, speaker, {TYPE_SQL} AS kind FROM blocks", "blocks"))
def write_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    W.write_dialogue(L.chapter_documents(_spoken(spark, sf_dir)), path)
    panels = spark.read.json(path).select("series", "chapter", F.posexplode("panels").alias("at", "p"))
    rows = panels.select("series", "chapter", (C("at") + 1).cast("long").alias("place"), C("p.panel").alias("panel"), F.explode("p.text_boxes").alias("t"))
    return rows.select("series", "chapter", "place", "panel", "t.text", "t.speaker", "t.kind")


@query("write_scripts", with_feeds(f"""WITH b AS (SELECT *, {TYPE_SQL} AS k, nullif(trim(text), '') AS t FROM blocks),
l AS (SELECT *, CASE k WHEN 'sfx' THEN '[SFX] ' WHEN 'narration' THEN 'Narrator: ' ELSE coalesce(nullif(speaker, ''), 'Unknown') || ': ' END || t AS line FROM b),
s AS (SELECT series, chapter, string_agg('[Panel ' || panel || ' | mixed_scene' || CASE WHEN is_dark THEN ' | dark' ELSE '' END || ']' || chr(10) || coalesce(line, '[Silent panel]'), chr(10) || chr(10) ORDER BY block) AS script,
 coalesce(string_agg(line, chr(10) ORDER BY block), '') AS clean, coalesce(string_agg(line, chr(10) ORDER BY block) FILTER (k NOT IN ('sfx', 'narration')), '') AS spoken FROM l GROUP BY 1, 2)
SELECT series::VARCHAR AS series, chapter::VARCHAR AS chapter, kind, text FROM (UNPIVOT s ON script, clean, spoken INTO NAME kind VALUE text) u""", "blocks"))
def write_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three texts of all chapters, read back whole from their files."""
    path = work_dir(spark)
    W.write_scripts(L.render_scripts(_spoken(spark, sf_dir)), path)
    return spark.read.json(path).select(C("series").cast("string").alias("series"), C("chapter").cast("string").alias("chapter"), "kind", "text")


@query("write_rejects", with_feeds(f"WITH RECURSIVE {GATED} SELECT panel_id, chapter, reason FROM gated", "panels"))
def write_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    W.write_rejects(_gated(spark, sf_dir).withColumn("reason", F.nullif("reason", F.lit("kept"))), path)
    return spark.read.parquet(path).select("panel_id", "chapter", "reason")


@query("write_panel_meta", with_feeds("SELECT doc_id AS panel_id, height FROM files", "files"))
def write_panel_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir, "files").join(running_offsets(spark, sf_dir), "doc_id")
    path = work_dir(spark)
    W.write_panel_meta(rows.select(C("doc_id").alias("panel_id"), C("name").alias("source"), "y_start", "y_end", "width", "height"), path)
    return spark.read.parquet(path).select("panel_id", (C("y_end") - C("y_start")).cast("int").alias("height"))


@query("atomic_state_save", with_feeds("SELECT domain, count(*) * 2 AS attempts FROM attempts GROUP BY 1", "attempts"))
def atomic_state_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions; the newest is what is read."""
    counts = feed(spark, sf_dir, "attempts").groupBy("domain").agg(F.count("*").alias("attempts"))
    path = work_dir(spark)
    W.save_state(counts, path, 1)
    W.save_state(W.latest_state(spark, path).withColumn("attempts", C("attempts") * 2), path, 2)
    return W.latest_state(spark, path)


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a grey picture of 16 by 16: its 64 values, four rows each."""
    grey = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + v * 200))).cast("long")), 2, "0"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda y: F.array_join(F.slice(F.flatten(F.array(grey, grey)), (y % 4) * 16 + 1, F.lit(16)), ""))
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("x/c"), C("vec_id") % 10, F.lit("/page-"), C("vec_id"), F.lit(".png")).alias("path"), F.lit(16).alias("width"), F.lit(16).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(rows, "")).alias("data"))


SCANNED = """SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'unknown_format' WHEN vec_id % 11 = 0 THEN 'unreadable' WHEN vec_id % 5 = 0 THEN 'too_small' END AS problem,
 CASE WHEN vec_id % 9 <> 0 AND vec_id % 11 <> 0 AND vec_id % 5 <> 0 THEN round(list_avg(list_transform(embedding, lambda v: greatest(0, least(255, floor(128 + v::DOUBLE * 200))))), 6) END AS mean FROM embeddings"""


@query("scan_images", SCANNED)
def scan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture as a file, read back: some are of a format without a reader, some broken, some too small."""
    number = F.regexp_extract("path", r"page-(\d+)", 1).cast("long")
    rows = _pictures(spark, sf_dir).withColumn("n", number)
    strange, broken, small = C("n") % 9 == 0, C("n") % 11 == 0, C("n") % 5 == 0
    name = F.when(strange, F.regexp_replace("path", "png$", "webp")).when(broken, F.regexp_replace("path", "png$", "jpg")).otherwise(C("path"))
    sides = {c: F.when(small & ~strange & ~broken, 8).otherwise(C(c)) for c in ("width", "height")}
    data = F.when(small & ~strange & ~broken, F.substring("data", 1, 64)).otherwise(C("data"))
    folder = work_dir(spark)
    rows = rows.select(name.alias("path"), *(v.alias(c) for c, v in sides.items()), "channels", data.alias("data"))
    stored(write_pictures(rows.repartition(parts(rows)), folder))
    seen = stored(X.scanned_images(spark, folder))
    means = X.panel_stats(seen.filter("problem IS NULL")).select(number.alias("vec_id"), F.lit(None).cast("string").alias("problem"), F.round("mean", 6).alias("mean"))
    return means.unionByName(seen.filter("problem IS NOT NULL").select(number.alias("vec_id"), "problem", F.lit(None).cast("double").alias("mean")))


GREYS = "list_transform(embedding, lambda v: greatest(0, least(255, floor(128 + v::DOUBLE * 200))))"


@query("pixel_row_profile", f"SELECT 'x/c' || (vec_id % 10) || '/page-' || vec_id || '.png' AS path, y::INT AS y, round(list_avg(g[(y % 4) * 16 + 1 : (y % 4) * 16 + 16]), 6) AS row_mean FROM (SELECT vec_id, {GREYS} AS g FROM embeddings) e, (SELECT unnest(range(16)) AS y)")
def pixel_row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.row_profiles(_pictures(spark, sf_dir)).select("path", "y", F.round("row_mean", 6).alias("row_mean"))


SHARES_SQL = ", ".join(f"round(len(list_filter(g, lambda v: v {'>' if sign > 0 else '<'} {level})) / 64, 9) AS {name}" for name, (level, sign) in X.SHARES.items())


@query("pixel_panel_stats", f"SELECT 'x/c' || (vec_id % 10) || '/page-' || vec_id || '.png' AS path, round(list_avg(g), 6) AS mean, round(list_stddev_pop(g), 6) AS std, {SHARES_SQL} FROM (SELECT vec_id, {GREYS} AS g FROM embeddings) e")
def pixel_panel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.panel_stats(_pictures(spark, sf_dir)).select("path", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *(F.round(c, 9).alias(c) for c in X.SHARES))


def _dct_sql() -> str:
    """All 64 coefficients, from the pictures' pixels: the n-th of a row is in its column, every fourth row is the same."""
    wave = "sqrt(CASE {u} WHEN 0 THEN 1.0 ELSE 2.0 END / 16) * cos(pi() * (2 * {x} + 1) * {u} / 32)"
    return f"""SELECT path, u, v, round(sum(g[(y % 4) * 16 + x + 1] * {wave.format(u='u', x='y')} * {wave.format(u='v', x='x')}), 6) AS value
FROM (SELECT 'x/c' || (vec_id % 10) || '/page-' || vec_id || '.png' AS path, {GREYS} AS g FROM embeddings) e, (SELECT unnest(range(16)) AS x), (SELECT unnest(range(16)) AS y), (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS v) GROUP BY ALL"""


@query("dct8", _dct_sql())
def dct8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.panel_stats(_pictures(spark, sf_dir)).select("path", F.posexplode(X.dct8(C("grid16"))).alias("k", "value"))
    return rows.select("path", F.floor(C("k") / 8).alias("u"), (C("k") % 8).cast("long").alias("v"), F.round("value", 6).alias("value"))


@query("page_cleaning")
def page_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clean_pages(X.panel_stats(_pictures(spark, sf_dir))).select("path", "seq", "new_name", "rotate")


#: Pictures of 300 by 200: bands of 90, 90 and 100 rows with 10 white ones between, each of one to three parts with 8 white columns between.
BANDS = ((0, 90), (100, 190), (200, 300))
COLUMNS = {1: ((0, 200),), 2: ((0, 96), (104, 200)), 3: ((0, 60), (68, 130), (138, 200))}


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for every embedding; every seventh is a negative, every fourth has no white rows."""
    v, first = C("vec_id"), F.get("embedding", F.lit(0))
    shade = 200 + F.pmod(F.floor(first * 1000), F.lit(41))
    negative, whole = v % 7 == 0, v % 4 == 0
    ink = F.lpad(F.hex(F.when(negative, 255 - shade).otherwise(shade).cast("long")), 2, "0")
    paper = F.when(negative, "00").otherwise("ff")
    gap = F.repeat(F.when(whole, ink).otherwise(paper), 2000)  # ten rows

    def row(parts: tuple) -> Column:
        pieces = [F.repeat(ink, b - a) for a, b in parts]
        return F.concat(pieces[0], *(x for p in pieces[1:] for x in (F.repeat(paper, 8), p)))

    def band(i: int) -> Column:
        n = (v + i) % 3 + 1
        own = F.when(n == 1, row(COLUMNS[1])).when(n == 2, row(COLUMNS[2])).otherwise(row(COLUMNS[3]))
        return F.repeat(own, BANDS[i][1] - BANDS[i][0])

    path = F.concat(F.lit("panels/p"), v.cast("string"), F.lit(".png"))
    data = F.unhex(F.concat(band(0), gap, band(1), gap, band(2)))
    size = {"width": 200, "height": 300, "channels": 1}
    return read(spark, sf_dir, "embeddings").select(path.alias("path"), *(F.lit(n).alias(c) for c, n in size.items()), data.alias("data"))


BAND_ROWS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(BANDS))
PART_ROWS = ", ".join(f"({n}, {k}, {a}, {b})" for n, parts in COLUMNS.items() for k, (a, b) in enumerate(parts, 1))


@query("subscene_split", f"""SELECT 'panels/p' || vec_id || '.png' AS path, 'p' || vec_id || '_s0' || (i + 1) || CASE WHEN n > 1 THEN '_x0' || k ELSE '' END AS name,
 i + 1 AS band, CASE WHEN n > 1 THEN k ELSE 0 END AS part, CASE WHEN n > 1 THEN a + 3 ELSE 0 END AS x0, y0 + 3 AS y0, CASE WHEN n > 1 THEN b - 3 ELSE 200 END AS x1, y1 - 3 AS y1
FROM embeddings, (VALUES {BAND_ROWS}) t(i, y0, y1), (VALUES {PART_ROWS}) c(n, k, a, b) WHERE vec_id % 4 <> 0 AND n = (vec_id + i) % 3 + 1""")
def subscene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes of pictures whose grids are known."""
    return panel_scenes(_grids(spark, sf_dir))


STITCH_SQL = f"""WITH {VECTORS}, s AS (SELECT strip_id, seq, k, round(0.65 * (1 - d) + 0.35 * (1 - de), 9) AS s FROM m WHERE n = k),
b AS (SELECT strip_id, seq, max(k) FILTER (s >= 0.94) AS gk, max(s) AS fs, arg_max(k, s) AS fk FROM s GROUP BY 1, 2),
o AS (SELECT strip_id, seq, coalesce(gk, CASE WHEN fs >= 0.9 THEN fk END, 0) AS overlap FROM (SELECT DISTINCT strip_id, seq FROM v) x LEFT JOIN b USING (strip_id, seq)),
y AS (SELECT *, (sum(24 - overlap) OVER (PARTITION BY strip_id ORDER BY seq))::BIGINT AS y_end, (sum(24 - overlap) OVER (PARTITION BY strip_id))::BIGINT AS total FROM o)
SELECT strip_id, seq, overlap, y_end - (24 - overlap) AS y_start, y_end, 500 AS canvas_width, total AS canvas_height, CASE WHEN total / 500 > 2.5 THEN 'webtoon' ELSE 'manga' END AS format, true AS tiles FROM y"""


@query("stitch_plan", STITCH_SQL)
def stitch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over pages of which every third is twice as large as the canvas; parts are held by the tiling rule."""
    tall = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x) / F.size("vec")
    edge = F.aggregate("edge_vec", F.lit(0.0), lambda s, x: s + x) / F.size("edge_vec")
    rows = stored(_vectors(spark, sf_dir).withColumns({"row_mean": tall * 255, "edge_density": edge}))
    size = F.when(C("seq") % 3 == 2, 2).otherwise(1)
    pages = rows.select("strip_id", "seq").distinct().select("strip_id", "seq", (size * 500).alias("width"), (size * 24).alias("height"))
    seams, parts = {"most": 12, "least": 2, "step": 2}, {"most": 140, "shortest": 20, "before": 9, "after": 3, "margin": 10}
    docs = stitch_chain(pages, rows, seams=seams, parts=parts)[2]
    out = docs.select("strip_id", "canvas", "format", "tiles", F.explode("sections").alias("s"))
    of = {c: C(f"s.{c}") for c in ("seq", "overlap", "y_start", "y_end")}
    return out.select("strip_id", *(c.alias(n) for n, c in of.items()), C("canvas.width").alias("canvas_width"), C("canvas.height").alias("canvas_height"), "format", "tiles")


@query("greedy_fold", """WITH RECURSIVE e AS (SELECT user_id, event_id, (date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)))::BIGINT AS t FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
g AS (SELECT user_id, n, event_id, t AS last, true AS kept FROM r WHERE n = 1 UNION ALL
 SELECT r.user_id, r.n, r.event_id, CASE WHEN r.t - g.last < 7200 THEN g.last ELSE r.t END, r.t - g.last >= 7200 FROM g JOIN r ON r.user_id = g.user_id AND r.n = g.n + 1)
SELECT user_id, event_id FROM g WHERE kept""")
def greedy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events that come at least two hours after the last one kept."""

    def step(s: dict, r: object) -> list[tuple]:
        if s.get("at") is not None and r.t - s["at"] < 7200:
            return []
        s["at"] = r.t
        return [(r.user_id, r.event_id)]

    rows = read(spark, sf_dir, "events").select("user_id", "event_id", ((F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")) * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("t"))
    return ordered_fold(rows, "user_id", ["t", "event_id"], lambda _: {}, step, lambda k, s: [], "user_id long, event_id long")


def _streamed(spark: SparkSession, parts: list[DataFrame], transform: object, out: str, checkpoint: str) -> None:
    """Parts as the files of a stream, each taken by a run of one batch from the same checkpoint (timers would keep a longer one going); each batch's rows with its number."""
    path = work_dir(spark)
    for rows in parts:
        rows.write.mode("append").parquet(path)
        stream = transform(spark.readStream.schema(parts[0].schema).parquet(path))
        put = learners.keep_changes(stream, out, checkpoint)
        put.trigger(once=True).start().awaitTermination()


def _halves(rows: DataFrame, at: Column) -> list[DataFrame]:
    """Rows up to the middle of ``at``, and the rest; nothing else is needed of the median than that it cuts."""
    middle = rows.select(F.percentile_approx(at, F.lit(0.5)).alias("m")).first().m
    return [rows.filter(at <= F.lit(middle)), rows.filter(at > F.lit(middle))]


def _last(spark: SparkSession, parts: list[DataFrame], transform: object, keys: list[str]) -> DataFrame:
    """The last change of every key after all parts."""
    out = work_dir(spark)
    _streamed(spark, parts, transform, out, work_dir(spark))
    return learners.latest_changes(spark, out, keys)


ARM_STREAM = f"""WITH {ARM_SQL} SELECT arm, requests, successes, round(ema, 6) AS ema, strftime(cooldown, '%Y-%m-%d %H:%M:%S') AS cooldown_end, false AS cooling FROM arms"""


@query("arm_learner", with_feeds(ARM_STREAM, "attempts"))
def arm_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts in two runs of a stream; their cooldowns ended long ago."""
    rows = feed(spark, sf_dir, "attempts").select("arm", "ts", "attempt_id", "success", "blocked", "duration")
    found = _last(spark, _halves(rows, C("ts")), learners.arm_learner, ["arm"])
    end = F.date_format("cooldown_end", "yyyy-MM-dd HH:mm:ss").alias("cooldown_end")
    return found.select("arm", "requests", "successes", F.round("ema", 6).alias("ema"), end, "cooling")


@query("attempt_learner_stream", with_feeds("SELECT domain, count(*) AS attempts, count(*) FILTER (success) AS successes, least(10.0, 0.5 + count(*) FILTER (blocked AND NOT success)) AS delay FROM attempts GROUP BY 1", "attempts"))
def attempt_learner_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts in two runs of a stream. Tests hold the preferred method against the batch fold."""
    rows = feed(spark, sf_dir, "attempts").select("domain", "ts", "attempt_id", "method", "success", "blocked")
    found = _last(spark, _halves(rows, C("ts")), lambda s: learners.attempt_learner(s, METHODS), ["domain"])
    return found.select("domain", "attempts", "successes", "delay")


@query("identity_stream")
def identity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of all mentions, earlier chapters first; tests hold them against the batch fold."""
    out = work_dir(spark)
    _streamed(spark, _halves(_mentions(spark, sf_dir), C("chapter")), learners.identity_stream, out, work_dir(spark))
    return spark.read.parquet(out).drop("batch")


@query("status_stream", with_feeds("SELECT job_id, CAST(ts AS DATE)::VARCHAR AS day, arg_max(status, (ts, event_id)) AS status, max(progress) AS progress FROM jobs GROUP BY 1, 2", "jobs"))
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = feed(spark, sf_dir, "jobs").withColumn("ts", C("ts").cast("timestamp"))
    rows = _last(spark, [jobs], learners.status_feed, ["job_id", "day"])
    return rows.select("job_id", F.date_format("day.start", "yyyy-MM-dd").alias("day"), "status", "progress")


@query("missing_pages", with_feeds("SELECT series, chapter, doc_id AS seq FROM files WHERE doc_id % 9 = 0 OR length < 1000", "files"))
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are wanted; every ninth has not come, and small ones came broken."""
    files = feed(spark, sf_dir, "files").select("series", "chapter", C("doc_id").alias("seq"), "length")
    arrived = files.filter("seq % 9 <> 0")
    return learners.missing_pages(files.drop("length"), arrived, ["series", "chapter", "seq"], valid=C("length") >= P.LEAST_BYTES)


@query("series_memory_stream", with_feeds(f"WITH {NAMES}, {CAST} SELECT * FROM cast_", "chapters"))
def series_memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.story_names(_chapters(spark, sf_dir)).select("series", "chapter", "name")
    return _last(spark, _halves(names, C("chapter")), learners.series_memory, ["series", "name"])


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.story_names(_chapters(spark, sf_dir)).groupBy("series", "chapter").agg(F.collect_list("name").alias("names"))
    rows = _summaries(spark, sf_dir).join(names, ["series", "chapter"], "left").withColumn("sent", F.lit(2).cast("long"))
    return rows.select("series", "chapter", "sent", "names", "dialogue_count", "has_action")


def _memory(spark: SparkSession, sf_dir: str) -> str:
    """Late chapters, early ones, then some of both again: as they are, and as an earlier sending that must not count."""
    early, late = _halves(stored(_sent(spark, sf_dir)), C("chapter"))
    again = early.unionByName(late).filter("chapter % 3 = 0")
    stale = again.withColumns({"sent": F.lit(1).cast("long"), "names": F.array(F.lit("Nobody")), "has_action": F.lit(True)})
    out = work_dir(spark)
    _streamed(spark, [late, early.unionByName(stale.filter("chapter % 2 = 0")), again.unionByName(stale)], learners.chapter_memory, out, work_dir(spark))
    return out


@query("chapter_memory_stream", RETAINED)
def chapter_memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept after three batches is what the batch operator keeps of all chapters."""
    return learners.kept_chapters(spark, _memory(spark, sf_dir)).select("series", "chapter")


@query("character_memory_stream", with_feeds(f"WITH {NAMES}, {CAST} SELECT * FROM cast_", "chapters"))
def character_memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the same three batches: no chapter counts twice."""
    return learners.kept_characters(spark, _memory(spark, sf_dir))


@query("page_arrival_stream", "SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def page_arrival_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a table written from all documents, as they arrive."""
    path, out = work_dir(spark), work_dir(spark)
    read(spark, sf_dir, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    learners.page_arrivals(spark, path, out, work_dir(spark)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).select(F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "length")
    return rows.groupBy("source").agg(F.sum("length").alias("bytes"))


@query("scan_page_files", "SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def scan_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in files by source, listed with their sizes."""
    path = work_dir(spark)
    read(spark, sf_dir, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    return X.page_files(spark, path, ("txt",)).groupBy(F.regexp_extract("folder", "source=(.*)", 1).alias("source")).agg(F.sum("length").alias("bytes"))

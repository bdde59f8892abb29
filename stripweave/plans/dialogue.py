"""Queries of the dialogue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.operators import dialogue as O
from stripweave.plans.registry import query
from stripweave.plans.texts import TYPE_SQL, block_kind
from stripweave.sources.feeds import feed, with_feeds

C = F.col
NOISE = r"(length(regexp_replace({t}, '[^A-Za-z0-9]', '', 'g')) <= 1 OR (length({t}) <= 3 AND NOT regexp_matches({t}, '[A-Za-z]{{2}}')) OR (length(regexp_replace({t}, '[^A-Za-z0-9]', '', 'g')) / greatest(length({t}), 1) < 0.25 AND length({t}) < 10) OR length(regexp_replace({t}, '[^_~=+{{}}\[\]<>]', '', 'g')) / greatest(length({t}), 1) > 0.35)"
OCR = f"ocr AS (SELECT * FROM words WHERE conf >= 33 AND NOT {NOISE.format(t='text')})"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "words")


@query("ocr_word_filter", with_feeds(f"WITH {OCR} SELECT panel_id, pos, text FROM ocr", "words"))
def ocr_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ocr_words(_words(spark, sf_dir)).select("panel_id", "pos", "text")


@query("word_lines", with_feeds(f"SELECT * FROM (SELECT panel_id, variant, line_num, string_agg(text, ' ' ORDER BY x, pos) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, round(avg(conf), 9) AS conf, count(*) AS words FROM words GROUP BY 1, 2, 3) l WHERE NOT {NOISE.format(t='text')}", "words"))
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.word_lines(_words(spark, sf_dir)).withColumn("conf", F.round("conf", 9))


@query("variant_vote", with_feeds(f"WITH {OCR} SELECT panel_id, variant, votes FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY votes DESC, variant) AS r FROM (SELECT panel_id, variant, sum(greatest(1, length(text)) * greatest(1, conf))::BIGINT AS votes FROM ocr GROUP BY 1, 2) v) x WHERE r = 1", "words"))
def variant_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.variant_vote(O.ocr_words(_words(spark, sf_dir)))


@query("combine_engines", with_feeds("SELECT panel_id, line_num, text FROM (SELECT panel_id, line_num, text, row_number() OVER (PARTITION BY panel_id, line_num ORDER BY length(text) DESC, variant) AS r FROM (SELECT panel_id, line_num, variant, string_agg(text, ' ' ORDER BY pos) AS text FROM words GROUP BY 1, 2, 3) t) x WHERE r = 1", "words"))
def combine_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    texts = _words(spark, sf_dir).groupBy("panel_id", "line_num", C("variant").alias("engine")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    return O.combine_engines(texts, ["panel_id", "line_num"])


@query("line_block_merge")
def line_block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.line_blocks(O.word_lines(_words(spark, sf_dir)))


@query("dialogue_blocks")
def dialogue_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh panel has no page to read style from; the second engine has one line for each panel."""
    words = _words(spark, sf_dir)
    panels = words.select("panel_id").distinct().filter("panel_id % 7 <> 0").select("panel_id", F.lit(1200).alias("height"), (C("panel_id") * 17 % 256).cast("double").alias("mean"), (C("panel_id") * 29 % 101 / 100).alias("shade_ratio"), (C("panel_id") * 31 % 101 / 100).alias("light_ratio"), (C("panel_id") % 3 == 0).alias("is_dark"))
    other = words.groupBy("panel_id").agg(F.min_by("text", "pos").alias("text")).select("panel_id", "text", F.lit(0).alias("x"), F.lit(5).alias("y"), F.lit(60).alias("w"), F.lit(20).alias("h"), F.lit(50.0).alias("conf"))
    return O.dialogue_blocks(words, fallback=other, panels=panels).select("panel_id", "block", "text", "kind", "name_hint", "box_style", "order")


@query("reading_order", with_feeds('SELECT chapter, block, (row_number() OVER (PARTITION BY chapter ORDER BY y, x, block))::INT AS "order" FROM blocks', "blocks"))
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reading_order(feed(spark, sf_dir, "blocks"), ["chapter"]).select("chapter", "block", "order")


@query("alias_lookup", with_feeds("WITH a AS (SELECT series, regexp_replace(lower(name_hint), '[^a-z0-9]', '', 'g') AS k, max_by('P' || chapter, chapter * 1000 + block) AS profile_id FROM blocks WHERE name_hint IS NOT NULL GROUP BY 1, 2) SELECT b.series, chapter, block, upper(name_hint) || '!' AS name, profile_id FROM blocks b LEFT JOIN a ON a.series = b.series AND a.k = regexp_replace(lower(b.name_hint), '[^a-z0-9]', '', 'g') WHERE name_hint IS NOT NULL", "blocks"))
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = feed(spark, sf_dir, "blocks").filter("name_hint IS NOT NULL")
    aliases = blocks.select("series", C("name_hint").alias("alias"), F.concat(F.lit("P"), C("chapter").cast("string")).alias("profile_id"), (C("chapter") * 1000 + C("block")).alias("at"))
    return O.alias_lookup(aliases, blocks.select("series", "chapter", "block", F.concat(F.upper("name_hint"), F.lit("!")).alias("name")), "series")


@query("speaker_counts", with_feeds("SELECT series, chapter, count(*) AS blocks, count(DISTINCT panel) AS text_panels, count(DISTINCT panel) FILTER (is_dark) AS dark_panels, count(*) FILTER (speaker = 'user') AS users FROM blocks GROUP BY 1, 2", "blocks"))
def speaker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.speaker_counts(feed(spark, sf_dir, "blocks"), ["series", "chapter"])
    return rows.select("series", "chapter", "blocks", "text_panels", "dark_panels", F.coalesce(F.try_element_at("speakers", F.lit("user")), F.lit(0)).alias("users"))


@query("profile_rollup", with_feeds("SELECT series, speaker, count(*) AS dialogue_count, min(chapter) AS first_chapter, max(chapter) AS last_chapter, least(20, count(DISTINCT text)) AS samples, count(*) FILTER (is_dark) AS dark FROM blocks GROUP BY 1, 2", "blocks"))
def profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.profile_rollup(feed(spark, sf_dir, "blocks"))
    return rows.select("series", "speaker", "dialogue_count", "first_chapter", "last_chapter", F.size("dialogue_samples").cast("long").alias("samples"), F.coalesce(F.try_element_at("scene_counts", F.lit("dark")), F.lit(0)).alias("dark"))


@query("characters_snapshot", with_feeds("SELECT series, count(*) AS characters, string_agg(speaker || ':' || n, ',' ORDER BY speaker) AS cast FROM (SELECT series, speaker, count(*) AS n FROM blocks GROUP BY 1, 2) p GROUP BY 1", "blocks"))
def characters_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.characters_snapshot(O.profile_rollup(feed(spark, sf_dir, "blocks")))
    return rows.select("series", "characters", F.array_join(F.transform("profiles", lambda p: F.concat(p["speaker"], F.lit(":"), p["lines"].cast("string"))), ",").alias("cast"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = feed(spark, sf_dir, "faces").select(C("chapter"), (C("face") % 8).alias("block"), "signature", "face")
    faces = faces.groupBy("chapter", "block").agg(F.min_by("signature", "face").alias("signature"))
    return feed(spark, sf_dir, "blocks").select("series", "chapter", "block", "name_hint").join(faces, ["chapter", "block"], "left")


@query("identity_fold")
def identity_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.identity_fold(_mentions(spark, sf_dir))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reading_order(feed(spark, sf_dir, "blocks").withColumn("kind", block_kind()), ["chapter", "panel"])


@query("speaker_assignment")
def speaker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = feed(spark, sf_dir, "faces").withColumn("panel", F.concat(F.lit("p"), (C("face") % 8).cast("string")))
    rows = O.assign_speakers(_spoken(spark, sf_dir).withColumn("series", C("series").cast("long")), faces)
    return rows.select("series", "chapter", "panel", "block", "speaker_id", "speaker", "reason", "speaker_confidence")


@query("chapter_dialogue_model", with_feeds("SELECT series, chapter, count(DISTINCT panel) AS panels, count(*) AS boxes FROM blocks GROUP BY 1, 2", "blocks"))
def chapter_dialogue_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.chapter_documents(_spoken(spark, sf_dir))
    return rows.select("series", "chapter", F.size("panels").cast("long").alias("panels"), F.aggregate("panels", F.lit(0).cast("long"), lambda s, p: s + F.size(p["text_boxes"])).alias("boxes"))


@query("script_render", with_feeds(f"""SELECT series, chapter, string_agg(CASE WHEN kind = 'sfx' THEN '[SFX] ' || trim(text) WHEN kind = 'narration' THEN 'Narrator: ' || trim(text) ELSE speaker || ': ' || trim(text) END, chr(10) ORDER BY block) AS clean,
coalesce(string_agg(speaker || ': ' || trim(text), chr(10) ORDER BY block) FILTER (kind NOT IN ('sfx', 'narration')), '') AS spoken FROM (SELECT *, {TYPE_SQL} AS kind FROM blocks) b GROUP BY 1, 2""", "blocks"))
def script_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.render_scripts(_spoken(spark, sf_dir)).select("series", "chapter", "clean", "spoken")


@query("chapter_scripts", with_feeds(f"""WITH k AS (SELECT *, {TYPE_SQL} AS kind FROM blocks), c AS (SELECT DISTINCT series, chapter FROM blocks UNION SELECT series + 100, chapter FROM blocks UNION SELECT series + 200, chapter FROM blocks),
s AS (SELECT series, chapter, coalesce(string_agg(speaker || ': ' || trim(text), chr(10) ORDER BY block) FILTER (kind NOT IN ('sfx', 'narration')), '') AS spoken FROM k GROUP BY 1, 2),
t AS (SELECT series + 100 AS series, chapter, string_agg('[Panel ' || panel || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY block) AS told FROM blocks WHERE trim(text) <> '' GROUP BY 1, 2)
SELECT series, chapter, coalesce(spoken, '') AS spoken, coalesce(told, '') AS told, CASE WHEN spoken IS NOT NULL THEN 'blocks' WHEN told IS NOT NULL THEN 'transcripts' ELSE 'none' END AS source FROM c LEFT JOIN s USING (series, chapter) LEFT JOIN t USING (series, chapter)""", "blocks"))
def chapter_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter with blocks, and twice more: with transcripts only, and with nothing."""
    blocks = _spoken(spark, sf_dir)
    chapters = blocks.select("series", "chapter", F.explode(F.array(F.lit(0), F.lit(100), F.lit(200))).alias("k")).select((C("series") + C("k")).alias("series"), "chapter")
    rows = O.chapter_scripts(blocks, blocks.select((C("series") + 100).alias("series"), "chapter", "panel", "text"), chapters)
    return rows.select("series", "chapter", "spoken", F.when(C("source") == "transcripts", C("script")).otherwise("").alias("told"), "source")

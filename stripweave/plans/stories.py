"""Queries of the story operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.operators import stories as O
from stripweave.plans.registry import query
from stripweave.sources.feeds import feed, with_feeds

C = F.col
STOP = ", ".join(f"'{s}'" for s in O.STOP_NAMES)
#: Every line of a chapter follows a tag.
TAGGED = r"tagged AS (SELECT series, chapter, '[Ann] ' || replace(text, chr(10), chr(10) || '[Bo] ') AS text FROM chapters)"
NAMES = rf"{TAGGED}, names AS (SELECT series, chapter, name, count(*) AS n FROM (SELECT series, chapter, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS name FROM tagged) w WHERE regexp_matches(name, '^[A-Z][a-z]{{2,}}$') AND name NOT IN ({STOP}) GROUP BY 1, 2, 3 HAVING count(*) >= 2)"
CAST = "cast_ AS (SELECT series, name, count(*) AS appearances, min(chapter) AS first_chapter, max(chapter) AS last_seen FROM names GROUP BY 1, 2)"
SUMMARY = r"lines AS (SELECT series, chapter, text, regexp_extract_all(text, '\[.*?\]\s*(.+)', 1) AS l FROM tagged)"


def _any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "chapters").withColumn("text", F.concat(F.lit("[Ann] "), F.replace("text", F.lit("\n"), F.lit("\n[Bo] "))))


@query("story_names", with_feeds(f"WITH {NAMES} SELECT * FROM names", "chapters"))
def story_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.story_names(_chapters(spark, sf_dir))


@query("chapter_summary", with_feeds(f"WITH {TAGGED}, {SUMMARY} SELECT series, chapter, array_to_string(list_concat(l[1:2], CASE WHEN len(l) > 4 THEN l[-2:] ELSE [] END), '|') AS key_dialogue, array_to_string(list_transform(list_filter(l[1:10], lambda x: {_any_sql('x', O.TALK_WORDS)}), lambda x: substr(x, 1, 100))[1:3], '|') AS interactions, length(text) AS text_length, {_any_sql('text', O.ACTION_WORDS)} AS has_action, contains(text, '[') AS has_emotion, len(l) AS dialogue_count FROM lines", "chapters"))
def chapter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chapter_summary(_chapters(spark, sf_dir)).withColumns({c: F.array_join(c, "|") for c in ("key_dialogue", "interactions")})


@query("series_characters", with_feeds(f"WITH {NAMES}, {CAST} SELECT * FROM cast_", "chapters"))
def series_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.series_characters(story_names(spark, sf_dir))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = story_names(spark, sf_dir).groupBy("series", "chapter").agg(F.count("*").alias("characters"))
    return O.chapter_summary(_chapters(spark, sf_dir)).join(counts, ["series", "chapter"], "left").withColumn("characters", F.coalesce("characters", F.lit(0).cast("long")))


KEPT = f"""WITH {NAMES}, {SUMMARY}, s AS (SELECT l.series, l.chapter, len(l) AS d, {_any_sql('text', O.ACTION_WORDS)} AS a, (SELECT count(*) FROM names n WHERE n.series = l.series AND n.chapter = l.chapter) AS c FROM lines l),
r AS (SELECT *, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY chapter DESC) AS age FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY series, age > 20 ORDER BY 2 * c + 0.1::DOUBLE * d + CASE WHEN a THEN 5 ELSE 0 END DESC, chapter) AS best FROM r)"""
RETAINED = with_feeds(f"{KEPT} SELECT series, chapter FROM b WHERE n <= 30 OR age <= 20 OR best <= 10", "chapters")


@query("retained_chapters", with_feeds(f"""{KEPT}
SELECT series, chapter, CASE WHEN n <= 30 THEN 'all' WHEN age <= 20 THEN 'recent' ELSE 'best' END AS why FROM b WHERE n <= 30 OR age <= 20 OR best <= 10""", "chapters"))
def retained_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.retained_chapters(_summaries(spark, sf_dir)).select("series", "chapter", "why")


@query("token_budget", with_feeds(f"WITH {TAGGED} SELECT series, chapter, tokens, used::BIGINT AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY series ORDER BY chapter DESC) AS used, row_number() OVER (PARTITION BY series ORDER BY chapter DESC) AS age FROM (SELECT series, chapter, greatest(1, length(text) // 3) AS tokens FROM tagged) t) u WHERE age <= 10 AND used <= 6000", "chapters"))
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.token_budget(_chapters(spark, sf_dir), 6000)


@query("context_digest")
def context_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.context_digest(series_characters(spark, sf_dir), _summaries(spark, sf_dir))


@query("series_memory_report", with_feeds(f"WITH {NAMES}, {CAST}, t AS (SELECT series, count(*) AS chapters, max(chapter) AS last_chapter FROM chapters GROUP BY 1), f AS (SELECT series, string_agg(chapter::VARCHAR, ',' ORDER BY chapter) AS last_five FROM (SELECT series, chapter, row_number() OVER (PARTITION BY series ORDER BY chapter DESC) AS r FROM chapters) x WHERE r <= 5 GROUP BY 1) SELECT t.*, last_five, (SELECT count(*) FROM cast_ c WHERE c.series = t.series) AS characters FROM t JOIN f USING (series)", "chapters"))
def series_memory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.series_report(series_characters(spark, sf_dir), _summaries(spark, sf_dir))


@query("prompt_assembly")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's panels are its lines."""
    chapters = _chapters(spark, sf_dir)
    panels = chapters.select("series", "chapter", F.posexplode(F.split("text", "\n")).alias("panel", "line")).select("series", "chapter", "panel", (F.trim("line") != "").alias("has_text"))
    return O.prompts(chapters, context_digest(spark, sf_dir), token_budget(spark, sf_dir), series_characters(spark, sf_dir), panels)


@query("scan_transcripts", with_feeds("SELECT series, chapter, (row_number() OVER (PARTITION BY series, chapter ORDER BY doc_id))::INT AS panel_number, trim(text) <> '' AS has_text FROM (SELECT source AS series, 'Chapter_' || (doc_id % 25) AS chapter, doc_id, text FROM documents) d", "files"))
def scan_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(C("source").alias("series"), F.concat(F.lit("Chapter_"), C("doc_id") % 25).alias("chapter"), F.concat(F.lit("t"), C("doc_id"), F.lit(".txt")).alias("name"), "text")
    return O.transcripts(docs).select("series", "chapter", "panel_number", "has_text")

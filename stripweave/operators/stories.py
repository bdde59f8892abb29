"""Stories over chapters: names, summaries, series memory, retention, context windows and prompt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Capitalised words that are not names, words that tell of two people, and words that tell of action.
STOP_NAMES = ("Panel", "Chapter", "The", "And", "But", "This", "That")
TALK_WORDS = ("you", "your", "me", "my", "us", "we")
ACTION_WORDS = ("fight", "run", "attack", "move", "go")


def story_names(chapters: DataFrame, least: int = 2) -> DataFrame:
    """``series, chapter, name, n``: capitalised words of more than two letters that come up at least so often."""
    words = chapters.select("series", "chapter", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("name")).filter(F.col("name").rlike("^[A-Z][a-z]{2,}$") & ~F.col("name").isin(*STOP_NAMES))
    return words.groupBy("series", "chapter", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def chapter_summary(chapters: DataFrame) -> DataFrame:
    """Per chapter, from what follows a bracketed tag: its key lines (the first two, and the last two of more than four), up to three of its first ten lines that speak of
    two people, cut to 100 characters, flags and counts."""
    lines = F.regexp_extract_all("text", F.lit(r"(?d)\[.*?\]\s*(.+)"), F.lit(1))
    rows = chapters.withColumn("_l", lines).withColumn("_n", F.size("_l"))
    last = F.when(F.col("_n") > 4, F.slice("_l", F.col("_n") - 1, F.lit(2))).otherwise(F.array().cast("array<string>"))
    talks = F.slice(F.transform(F.filter(F.slice("_l", 1, 10), lambda x: _holds_any(x, TALK_WORDS)), lambda x: F.substring(x, 1, 100)), 1, 3)
    return rows.select(
        "series", "chapter", F.concat(F.slice("_l", 1, 2), last).alias("key_dialogue"), talks.alias("interactions"), F.length("text").cast("long").alias("text_length"),
        _holds_any(F.col("text"), ACTION_WORDS).alias("has_action"), F.col("text").contains("[").alias("has_emotion"), F.col("_n").cast("long").alias("dialogue_count"),
    )


def series_characters(names: DataFrame) -> DataFrame:
    return names.groupBy("series", "name").agg(F.count("*").alias("appearances"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_seen"))


def retained_chapters(summaries: DataFrame, *, most: int = 30, recent: int = 20, older: int = 10) -> DataFrame:
    """Of a series with more chapters than ``most`` the recent ones and the best of the older, by twice its characters, lines and action, ties to the older; else all. A snapshot: what is left out may come back."""
    series = Window.partitionBy("series")
    rows = summaries.withColumn("_n", F.count("*").over(series)).withColumn("_age", F.row_number().over(series.orderBy(F.desc("chapter"))))
    score = 2 * F.col("characters") + 0.1 * F.col("dialogue_count") + F.when(F.col("has_action"), 5).otherwise(0)
    rows = rows.withColumn("_score", score).withColumn("_best", F.row_number().over(Window.partitionBy("series", F.col("_age") > recent).orderBy(F.desc("_score"), "chapter")))
    keep = (F.col("_n") <= most) | (F.col("_age") <= recent) | (F.col("_best") <= older)
    return rows.filter(keep).withColumn("why", F.when(F.col("_n") <= most, "all").when(F.col("_age") <= recent, "recent").otherwise("best")).drop("_n", "_age", "_best", "_score")


def token_budget(chapters: DataFrame, budget: int, *, most: int = 10) -> DataFrame:
    """Each series' last chapters, newest first, while their tokens (a third of their characters, 1 at least) fit the budget; it ends at the first that does not. Texts stay out of the window."""
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 3))
    newest = Window.partitionBy("series").orderBy(F.desc("chapter"))
    rows = chapters.select("series", "chapter", tokens.cast("long").alias("tokens")).withColumn("_age", F.row_number().over(newest))
    rows = rows.withColumn("used", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("_age") <= most) & (F.col("used") <= budget)).select("series", "chapter", "tokens", "used")


def context_digest(characters: DataFrame, summaries: DataFrame, *, top: int = 6, lines: int = 3, width: int = 30) -> DataFrame:
    """``series, digest`` (JSON): chapters in all, the most frequent characters with their appearances and first and last chapter, the first key line of the last chapters,
    cut short, and of every max(10, n / 5)-th chapter its number of characters and whether it has action."""
    best = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("appearances"), "first_chapter", "name"))
    about = F.struct(F.col("appearances").alias("app"), F.col("first_chapter").alias("first"), F.col("last_seen").alias("last"))
    cast = characters.withColumn("_r", best).filter(F.col("_r") <= top).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("_r", "name", about.alias("about")))).alias("_c"))
    cast = cast.select("series", F.map_from_entries(F.transform("_c", lambda c: F.struct(c["name"], c["about"]))).alias("main_characters"))
    series = Window.partitionBy("series")
    s = summaries.withColumn("_n", F.count("*").over(series)).withColumn("_age", F.row_number().over(series.orderBy(F.desc("chapter")))).withColumn("_i", F.row_number().over(series.orderBy("chapter")) - 1)
    event = F.struct(F.col("chapter").alias("ch"), F.concat(F.substring(F.get("key_dialogue", F.lit(0)), 1, width), F.lit("...")).alias("key"))
    mark = F.struct(F.col("chapter").alias("ch"), F.col("characters").alias("c"), F.col("has_action").alias("act"))
    told = s.groupBy("series").agg(
        F.max("_n").alias("total_chapters"), F.array_sort(F.collect_list(F.when((F.col("_age") <= lines) & (F.size("key_dialogue") > 0), event))).alias("recent_events"),
        F.array_sort(F.collect_list(F.when(F.col("_i") % F.greatest(F.lit(10), F.floor(F.col("_n") / 5)) == 0, mark))).alias("series_progression"),
    )
    rows = told.join(cast, "series", "left").withColumn("main_characters", F.coalesce("main_characters", F.from_json(F.lit("{}"), cast.schema["main_characters"].dataType)))
    return rows.select("series", F.to_json(F.struct("total_chapters", "main_characters", "recent_events", "series_progression")).alias("digest"))


def series_report(characters: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per series: chapters, characters, last chapter, and its last five."""
    series = Window.partitionBy("series")
    last = summaries.withColumn("_age", F.row_number().over(series.orderBy(F.desc("chapter")))).filter("_age <= 5").groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list("chapter")), lambda c: c.cast("string")), ",").alias("last_five"))
    totals = summaries.groupBy("series").agg(F.count("*").alias("chapters"), F.max("chapter").alias("last_chapter"))
    cast = characters.groupBy("series").agg(F.count("*").alias("characters"))
    return totals.join(last, "series").join(cast, "series", "left").withColumn("characters", F.coalesce("characters", F.lit(0).cast("long")))


def prompts(chapters: DataFrame, digests: DataFrame, budget: DataFrame, characters: DataFrame | None = None, panels: DataFrame | None = None, style: str = "Plain prose, present tense.") -> DataFrame:
    """``series, chapter, prompt``: for each chapter the series' digest, what of the recent chapters fits, notes on its characters, which of its panels have text, the style and the
    chapter's own text. A table; no model is called. ``characters`` has ``series, name, appearances`` (most frequent first in the notes), ``panels`` has ``series, chapter, panel, has_text``."""
    recent = budget.groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list("chapter")), lambda c: c.cast("string")), ", ").alias("recent"))
    rows = chapters.join(digests, "series", "left").join(recent, "series", "left").withColumns({"notes": F.lit(None).cast("string"), "seen": F.lit(None).cast("string")})
    if characters is not None:
        place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("appearances"), "name"))
        note = F.concat("name", F.lit(" ("), F.col("appearances").cast("string"), F.lit(")"))
        notes = characters.withColumn("_r", place).filter(F.col("_r") <= 12).groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", note.alias("n")))), lambda c: c["n"]), ", ").alias("notes"))
        rows = rows.drop("notes").join(notes, "series", "left")
    if panels is not None:
        text = F.array_sort(F.collect_list(F.when(F.col("has_text"), F.col("panel"))))
        seen = panels.groupBy("series", "chapter").agg(F.concat(F.size(text).cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(": "), F.array_join(F.transform(text, lambda p: p.cast("string")), ", ")).alias("seen"))
        rows = rows.drop("seen").join(seen, ["series", "chapter"], "left")
    parts = F.concat_ws("\n\n", F.lit("Write this chapter as a script."), F.concat(F.lit("Story so far: "), "digest"), F.concat(F.lit("Recent chapters: "), "recent"), F.concat(F.lit("Characters: "), "notes"), F.concat(F.lit("Panels with text: "), "seen"), F.lit("Style: " + style), F.concat(F.lit("Text:\n"), "text"))
    return rows.select("series", "chapter", parts.alias("prompt"))


def transcripts(files: DataFrame) -> DataFrame:
    """``series, chapter, panel_number, has_text, text`` of transcript files in natural order; unreadable (null) ones have a mark in their place."""
    from stripweave.operators.panels import natural_order

    rows = natural_order(files)
    return rows.select("series", "chapter", F.col("seq").alias("panel_number"), F.coalesce(F.trim("text") != "", F.lit(False)).alias("has_text"), F.coalesce("text", F.lit("[unreadable]")).alias("text"), F.col("text").isNull().alias("unreadable"))

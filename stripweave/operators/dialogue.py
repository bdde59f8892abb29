"""Dialogue: words to lines to blocks, speakers, profiles, and the chapter's document and scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.functions import text as X
from stripweave.operators.folds import ordered_fold
from stripweave.operators.panels import ocr_threshold
from stripweave.session import stored


def ocr_words(words: DataFrame, threshold: float = 55) -> DataFrame:
    """Words of enough confidence that are not noise."""
    return words.filter((F.col("conf") >= ocr_threshold(threshold)) & ~X.is_noise(F.col("text")))


def word_lines(words: DataFrame, keys: Sequence[str] = ("panel_id", "variant", "line_num")) -> DataFrame:
    """Lines: words left to right, the box around them, their mean confidence; noise lines go."""
    parts = F.array_sort(F.collect_list(F.struct("x", "pos", "text")))
    rows = words.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.avg("conf").alias("conf"), F.count("*").alias("words")
    )
    rows = rows.withColumn("w", F.col("_r") - F.col("x")).withColumn("h", F.col("_b") - F.col("y")).drop("_r", "_b")
    return rows.filter(~X.is_noise(F.col("text")))


def variant_vote(words: DataFrame) -> DataFrame:
    """``panel_id, variant, votes``: of each panel the reading with the most length times confidence, the first of equals."""
    votes = words.groupBy("panel_id", "variant").agg(F.sum(F.greatest(F.lit(1), F.length("text")) * F.greatest(F.lit(1), F.col("conf"))).alias("votes"))
    at = F.row_number().over(Window.partitionBy("panel_id").orderBy(F.desc("votes"), "variant"))
    return votes.withColumn("_at", at).filter(F.col("_at") == 1).drop("_at")


def combine_engines(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of several engines' texts the longest, the first engine's of equals."""
    return texts.groupBy(*by).agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("engine")).alias("e"), "text")).getField("text").alias("text"))


def line_blocks(lines: DataFrame, key: str = "panel_id") -> DataFrame:
    """``key, block, text, x, y, w, h, conf, lines``: a line joins the block before it if it starts soon below it and overlaps it sideways or lies under its middle; the block's box grows."""

    def close(k: object, b: dict) -> tuple:
        return (k, b["n"], " ".join(b["text"]), b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"], b["conf"] / len(b["text"]), len(b["text"]))

    def step(s: dict, r: object) -> list[tuple]:
        b = s.get("open")
        x0, y0, x1, y1 = r.x, r.y, r.x + r.w, r.y + r.h
        if b is not None:
            near = y0 - b["y1"] <= max(24, 0.85 * r.h)
            shared = max(0, min(x1, b["x1"]) - max(x0, b["x0"])) / max(1, min(x1 - x0, b["x1"] - b["x0"]))
            centre = abs((x0 + x1) / 2 - (b["x0"] + b["x1"]) / 2)
            if near and (shared > 0.15 or centre < max(80, 0.7 * r.w)):
                b["text"].append(r.text)
                b["x0"], b["y0"], b["x1"], b["y1"] = min(b["x0"], x0), min(b["y0"], y0), max(b["x1"], x1), max(b["y1"], y1)
                b["conf"] += r.conf
                return []
        s["n"] = s.get("n", 0) + 1
        s["open"] = {"n": s["n"], "text": [r.text], "x0": x0, "y0": y0, "x1": x1, "y1": y1, "conf": r.conf}
        return [close(getattr(r, key), b)] if b is not None else []

    finish = lambda k, s: [close(k, s["open"])] if s.get("open") else []
    rows = lines.select(key, "x", "y", "w", "h", "text", "conf")
    return ordered_fold(rows, key, ["y", "x", "text"], lambda _: {}, step, finish, f"{key} {dict(lines.dtypes)[key]}, block int, text string, x int, y int, w int, h int, conf double, lines int")


def with_fallback(blocks: DataFrame, words: DataFrame, fallback: DataFrame | None, least: int = 250) -> DataFrame:
    """``blocks`` and, for panels whose best reading has less than so many votes or none, those of another engine (``panel_id, text, x, y, w, h, conf``)."""
    if fallback is None:
        return blocks
    well = variant_vote(words).filter(F.col("votes") >= least).select("panel_id")
    first = blocks.groupBy("panel_id").agg(F.max("block").alias("_last"))
    more = fallback.join(well, "panel_id", "left_anti").join(first, "panel_id", "left")
    at = F.row_number().over(Window.partitionBy("panel_id").orderBy("y", "x", "text")) + F.coalesce("_last", F.lit(0))
    more = more.select("panel_id", at.cast("int").alias("block"), "text", *(F.col(c).cast("int").alias(c) for c in "xywh"), F.col("conf").cast("double").alias("conf"), F.lit(1).alias("lines"))
    return blocks.unionByName(more)


def dialogue_blocks(words: DataFrame, threshold: float = 55, *, fallback: DataFrame | None = None, panels: DataFrame | None = None) -> DataFrame:
    """Blocks of each panel's best reading, or of another engine's where that is poor, nearly equal ones that overlap only once, cleaned, with name hint, box style, kind and
    reading order. ``panels`` has ``panel_id, height, mean, shade_ratio, light_ratio, is_dark``; without it a panel is 1200 high and its boxes' style is mixed."""
    from stripweave.operators.dedupe import text_block_dedupe
    from stripweave.operators.panels import box_style

    kept = ocr_words(words, threshold)
    vote = variant_vote(kept).select("panel_id", F.array("variant").alias("_best"))
    # Words join by panel alone, by which they may be dealt already: an equality of variants would become a second key, and words be sent anew.
    best = kept.join(vote, "panel_id").filter(F.array_contains("_best", F.col("variant"))).drop("_best")
    blocks = stored(with_fallback(line_blocks(word_lines(best)), kept, fallback))  # read twice
    single = text_block_dedupe(blocks.select("panel_id", F.col("block").alias("box_id"), "x", "y", "w", "h", F.col("conf").alias("confidence"), "text"), "panel_id").filter("kept")
    blocks = blocks.join(single.select("panel_id", F.col("box_id").alias("block")), ["panel_id", "block"], "left_semi")
    blocks = blocks.withColumn("raw_text", F.col("text")).withColumn("text", X.clean_text(F.col("text")))
    blocks = blocks.withColumn("name_hint", X.name_hint(F.col("text"))).withColumn("text", X.hinted_speech(F.col("text")))
    if panels is None:
        blocks = blocks.withColumns({"box_style": F.lit("mixed"), "_height": F.lit(1200)})
    else:
        style = box_style(F.col("mean"), F.col("shade_ratio"), F.col("light_ratio"), F.col("is_dark"))
        own = panels.select("panel_id", style.alias("_style"), F.col("height").alias("_own"))
        blocks = blocks.join(own, "panel_id", "left").withColumns({"box_style": F.coalesce("_style", F.lit("mixed")), "_height": F.coalesce("_own", F.lit(1200))}).drop("_style", "_own")
    kind = X.block_type(F.col("text"), F.col("name_hint"), F.col("y"), F.col("h"), F.col("_height"), F.col("box_style"))
    return reading_order(blocks.withColumn("kind", kind), ["panel_id"]).drop("_height")


def reading_order(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``order``: from top to bottom, then left to right."""
    return rows.withColumn("order", F.row_number().over(Window.partitionBy(*by).orderBy("y", "x", "block")))


def alias_lookup(aliases: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """``by, name, profile_id``: the profile that last took the name, in any spelling; null for unknown names."""
    known = aliases.withColumn("_key", X.norm_name(F.col("alias"))).groupBy(by, "_key").agg(F.max_by("profile_id", "at").alias("profile_id"))
    return names.withColumn("_key", X.norm_name(F.col("name"))).join(known, [by, "_key"], "left").drop("_key")


def speaker_counts(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per chapter: blocks, panels with text, dark panels, and a map of speakers to their blocks."""
    each = blocks.groupBy(*by, "speaker").agg(F.count("*").alias("n"))
    speakers = each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "n")))).alias("speakers"))
    totals = blocks.groupBy(*by).agg(F.count("*").alias("blocks"), F.count_distinct("panel").alias("text_panels"), F.count_distinct(F.when(F.col("is_dark"), F.col("panel"))).alias("dark_panels"))
    return totals.join(speakers, list(by))


def profile_rollup(blocks: DataFrame, by: Sequence[str] = ("series", "speaker"), samples: int = 20) -> DataFrame:
    """Per profile: lines, first and last chapter, its last distinct samples, and blocks per kind of scene. Samples are cut to their number before they are gathered."""
    order = ("chapter", "block")
    scenes = blocks.groupBy(*by, F.when(F.col("is_dark"), "dark").otherwise("light").alias("scene")).agg(F.count("*").alias("n"))
    scenes = scenes.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scene", "n")))).alias("scene_counts"))
    last = blocks.groupBy(*by, "text").agg(F.max(F.struct(*order)).alias("_at"))
    last = last.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_at"), "text"))).filter(F.col("_n") <= samples)
    last = last.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_s")).select(*by, F.transform("_s", lambda s: s["text"]).alias("dialogue_samples"))
    totals = blocks.groupBy(*by).agg(F.count("*").alias("dialogue_count"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"))
    return totals.join(last, list(by)).join(scenes, list(by))


def characters_snapshot(profiles: DataFrame) -> DataFrame:
    """Per series its profiles in natural order of their names, and how many."""
    return profiles.groupBy("series").agg(F.count("*").alias("characters"), F.transform(F.array_sort(F.collect_list(F.struct(X.natural_key(F.col("speaker")).alias("k"), "speaker", "dialogue_count"))), lambda p: F.struct(p["speaker"].alias("speaker"), p["dialogue_count"].alias("lines"))).alias("profiles"))


class Profiles:
    """A series' profiles: matched by name or by signature, else made anew; numbered in order."""

    def __init__(self, most: float, novelty: float, signatures: int, aliases: int):
        self.most, self.novelty, self.signatures, self.aliases = most, novelty, signatures, aliases
        self.made = 0
        self.all: dict[str, dict] = {}
        self.names: dict[str, str] = {}
        self.merged: dict[str, str] = {}  # profiles that are part of another now

    @staticmethod
    def _key(name: str) -> str:
        return "".join(c for c in name.lower() if c.isascii() and c.isalnum())[:64]

    @staticmethod
    def _distance(a: list[float], b: list[float]) -> float:
        if not a or len(a) != len(b):
            return 999.0
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm > 0 else 999.0

    def _number(self) -> str:
        self.made += 1
        return f"Character_{self.made:02d}"

    def _new(self, chapter: object) -> str:
        name = self._number()
        self.all[name] = {"aliases": [], "signatures": [], "first": chapter, "last": chapter, "seen": 0}
        return name

    def nearest(self, signature: list[float]) -> tuple[str | None, float]:
        found = min(((self._distance(signature, s), p) for p, d in self.all.items() for s in d["signatures"]), default=(999.0, ""))
        return (found[1], 1 - found[0] / self.most) if found[0] <= self.most else (None, 0.0)

    def merge(self, keeper: str, duplicate: str) -> None:
        a, b = self.all[keeper], self.all.pop(duplicate)
        a["aliases"] = (a["aliases"] + [x for x in b["aliases"] if x not in a["aliases"]])[-self.aliases :]
        a["signatures"] = (a["signatures"] + b["signatures"])[-self.signatures :]
        a["first"], a["last"], a["seen"] = min(a["first"], b["first"]), max(a["last"], b["last"]), a["seen"] + b["seen"]
        self.names = {k: keeper if p == duplicate else p for k, p in self.names.items()}
        self.merged = {k: keeper if p == duplicate else p for k, p in self.merged.items()} | {duplicate: keeper}

    def named(self, name: str, chapter: object) -> str | None:
        """The profile that goes by the name, made if there is none; nothing for a name without letters and digits."""
        key = self._key(name)
        if not key:
            return None
        profile = self.names.get(key) or self._new(chapter)
        self.names[key] = profile
        if name not in self.all[profile]["aliases"]:
            self.all[profile]["aliases"] = [*self.all[profile]["aliases"], name][-self.aliases :]
        return profile

    def display(self, profile: str) -> str:
        """The first of its names, or its number."""
        return next(iter(self.all[profile]["aliases"]), profile) if profile in self.all else profile

    def observe(self, chapter: object, name: str | None, signature: list[float]) -> tuple[str, float, str]:
        """The mention's profile, confidence and reason. A name known under one profile and a face known under another make them one. What has neither takes a number, but nothing
        leads to it again and it is not kept: what is held grows with the characters, not with the mentions."""
        by_name = self.named(name, chapter) if name else None
        if not by_name and not signature:
            return self._number(), 0.42, "new_visual_profile"
        by_face, near = self.nearest(signature) if signature else (None, 0.0)
        if by_name and by_face and by_name != by_face:
            self.merge(by_name, by_face)
            by_face = by_name
        if by_face:
            profile, confidence, reason = by_face, max(near, 0.62) if by_name else near, "matched_face"
        elif by_name:
            profile, confidence, reason = by_name, 0.9, "explicit_name"
        else:
            profile, confidence, reason = self._new(chapter), 0.42, "new_visual_profile"
        p = self.all[profile]
        if signature and min((self._distance(signature, s) for s in p["signatures"]), default=999.0) > self.novelty:
            p["signatures"] = [*p["signatures"], signature][-self.signatures :]
        p["last"], p["seen"] = max(p["last"], chapter), p["seen"] + 1
        return profile, confidence, reason


MENTION = "series long, chapter long, block long, profile_id string, confidence double, reason string"


def new_profiles() -> Profiles:
    return Profiles(most=0.18, novelty=0.04, signatures=16, aliases=12)


def identity_fold(mentions: DataFrame) -> DataFrame:
    """Profiles of mentions (``series, chapter, block, name_hint, signature``) in order of chapter and block. What a series holds is bounded by its characters."""

    def step(p: Profiles, r: object) -> list[tuple]:
        signature = [] if r.signature is None else [float(x) for x in r.signature]
        return [(r.series, r.chapter, r.block, *p.observe(r.chapter, r.name_hint if isinstance(r.name_hint, str) else None, signature))]

    return ordered_fold(mentions.select("series", "chapter", "block", "name_hint", "signature"), "series", ["chapter", "block"], lambda _: new_profiles(), step, lambda k, p: [], MENTION)


SPOKEN = "series long, chapter long, panel string, block long, speaker_id string, speaker string, reason string, speaker_confidence double"


def assign_speakers(blocks: DataFrame, faces: DataFrame) -> DataFrame:
    """``blocks`` with ``speaker_id, speaker, reason, speaker_confidence``.

    Sound effects and captions go by kind. Other blocks take the profile of their name, of their panel's nearest face, or of both, which then are one; a face
    without a profile gets a new one. Profiles live through a series, in order of chapter, panel and block; faces are matched when their panel begins. A series
    is one fold: what it holds is bounded by its characters. ``blocks`` has ``series, chapter, panel, block, kind, name_hint`` and boxes, ``faces`` has ``chapter, panel,
    face, signature`` and boxes.
    """
    from stripweave.operators.dedupe import nearest_face

    key = F.concat_ws(":", "chapter", "panel").alias("_panel")
    own = faces.select("*", key)
    near = nearest_face(blocks.select("*", key), own, "_panel").select("_panel", "block", "face")
    # A panel's faces that any block is near to, at most the few that a panel has, ride along with each of its blocks.
    met = own.join(near.select("_panel", "face").distinct(), ["_panel", "face"]).groupBy("_panel").agg(F.array_sort(F.collect_list(F.struct("face", F.col("signature").cast("array<double>").alias("signature")))).alias("panel_faces"))
    rows = blocks.select("series", "chapter", "panel", "block", "kind", "name_hint", key).join(near, ["_panel", "block"], "left").join(met, "_panel", "left")
    rows = rows.select("series", "chapter", "panel", "block", "kind", "name_hint", "face", "panel_faces", X.natural_key(F.col("panel")).alias("place"))

    def step(s: dict, r: object) -> list[tuple]:
        p: Profiles = s["profiles"]
        if s.get("panel") != (r.chapter, r.panel):
            s["panel"] = (r.chapter, r.panel)
            s["faces"] = {f["face"]: [float(x) for x in f["signature"]] for f in (r.panel_faces if r.panel_faces is not None else ())}
            s["known"] = {f: p.nearest(v)[0] for f, v in s["faces"].items()}
        face = None if r.face is None or r.face != r.face else r.face
        name = r.name_hint if isinstance(r.name_hint, str) else None
        at = (r.series, r.chapter, r.panel, r.block)
        if r.kind == "sfx":
            return [(*at, None, "SFX", "sound_effect", 1.0)]
        if r.kind == "narration":
            return [(*at, None, "Narrator", "caption_or_edge_text", 0.82)]
        if face is None:
            profile = p.named(name, r.chapter) if name else None
            if profile is None:
                return [(*at, None, "Unknown", "no_name_or_face_match", 0.0)]
            return [(*at, profile, p.display(profile), "explicit_name_no_face", 0.88)]
        known = s["known"].get(face)
        known = p.merged.get(known, known)
        if name or known is None:
            profile, confidence, reason = p.observe(r.chapter, name, s["faces"][face])
            s["known"][face] = profile
            confidence = confidence if name else min(0.72, max(confidence, 0.42))
        else:
            profile, confidence, reason = known, 0.56, "nearest_known_face"
        return [(*at, profile, p.display(profile), reason, confidence)]

    found = ordered_fold(rows, "series", ["chapter", "place", "panel", "block"], lambda _: {"profiles": new_profiles()}, step, lambda k, s: [], SPOKEN)
    return blocks.drop("speaker").join(found, ["series", "chapter", "panel", "block"], "left")


def chapter_documents(blocks: DataFrame) -> DataFrame:
    """One nested document per series and chapter: its panels in order, each with its blocks in order."""
    panels = blocks.groupBy("series", "chapter", "panel").agg(F.array_sort(F.collect_list(F.struct("order", "text", "speaker", "kind"))).alias("text_boxes"))
    panels = panels.select("series", "chapter", F.struct(X.natural_key(F.col("panel")).alias("k"), "panel", "text_boxes").alias("p"))
    return panels.groupBy("series", "chapter").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["panel"].alias("panel"), p["text_boxes"].alias("text_boxes"))).alias("panels"))


def transcript_scripts(transcripts: DataFrame) -> DataFrame:
    """``series, chapter, script``: the transcripts' texts under their panels' names, in natural order; empty ones go, and unreadable (null) ones say so."""
    body = F.when(F.col("text").isNull(), F.concat(F.lit("[Panel "), "panel", F.lit(" - Error]"))).otherwise(F.concat(F.lit("[Panel "), "panel", F.lit("]\n"), F.trim("text")))
    rows = transcripts.filter(F.col("text").isNull() | (F.trim("text") != "")).select("series", "chapter", F.struct(X.natural_key(F.col("panel")).alias("k"), "panel", body.alias("t")).alias("p"))
    return rows.groupBy("series", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n\n").alias("script"))


def chapter_scripts(blocks: DataFrame, transcripts: DataFrame, chapters: DataFrame, emotions: bool = False) -> DataFrame:
    """``series, chapter, script, clean, spoken, source`` of every chapter in ``chapters``: from its blocks; where it has none, from its transcripts; with neither, empty."""
    own = render_scripts(blocks, emotions)
    rest = transcript_scripts(transcripts).select("series", "chapter", F.col("script").alias("_t"))
    rows = chapters.select("series", "chapter").distinct().join(own, ["series", "chapter"], "left").join(rest, ["series", "chapter"], "left")
    source = F.when(F.col("script").isNotNull(), "blocks").when(F.col("_t").isNotNull(), "transcripts").otherwise("none")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select("series", "chapter", F.coalesce("script", "_t", F.lit("")).alias("script"), empty("clean"), empty("spoken"), source.alias("source"))


def render_scripts(blocks: DataFrame, emotions: bool = False) -> DataFrame:
    """``series, chapter, script, clean, spoken``: the whole script with panel headers, its lines without them, and what is spoken. Lines are made before they are put together."""
    line = X.script_line(F.col("kind"), F.col("speaker"), F.col("text"), emotions)
    rows = blocks.withColumn("_line", line).withColumn("_said", F.when(~F.col("kind").isin("sfx", "narration"), line))
    panels = rows.groupBy("series", "chapter", "panel").agg(F.array_sort(F.collect_list(F.struct("order", "_line", "_said"))).alias("_l"), F.max("is_dark").alias("_dark"))
    texts = lambda f: F.array_compact(F.transform("_l", lambda x: x[f]))
    header = X.panel_header(F.col("panel"), F.lit(None).cast("string"), F.col("_dark"))
    body = F.when(F.size(texts("_line")) > 0, F.array_join(texts("_line"), "\n")).otherwise(F.lit("[Silent panel]"))
    panels = panels.select("series", "chapter", F.struct(X.natural_key(F.col("panel")).alias("k"), "panel", F.concat(header, F.lit("\n"), body).alias("script"), F.array_join(texts("_line"), "\n").alias("clean"), F.array_join(texts("_said"), "\n").alias("spoken")).alias("p"))
    out = panels.groupBy("series", "chapter").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    join = lambda f, by: F.array_join(F.filter(F.transform("_p", lambda p: p[f]), lambda t: t != ""), by)
    return out.select("series", "chapter", join("script", "\n\n").alias("script"), join("clean", "\n").alias("clean"), join("spoken", "\n").alias("spoken"))

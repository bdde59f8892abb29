"""Column functions over recognised text: cleaning, noise, name hints, kinds of block, emotion tags, script lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u0001"


def natural_key(name: Column) -> Column:
    """A string that sorts names as people do: digit runs by value, all else by its lower-cased text."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(x: Column) -> Column:
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.ltrim(x, F.lit("0")), 20, "0"))).otherwise(F.concat(F.lit("1"), x))

    return F.array_join(F.transform(parts, part), SEPARATOR)


def clean_text(text: Column) -> Column:
    """Bars read as I, white space collapsed, runs of a mark cut to three, quotes and spaces off the ends."""
    out = F.regexp_replace(F.replace(text, F.lit("|"), F.lit("I")), r"\s+", " ")
    for mark in "!?.,":
        out = F.regexp_replace(out, "[" + mark + "]{4,}", mark * 3)
    return F.btrim(out, F.lit(" \t\r\n\"'`"))


def is_noise(text: Column) -> Column:
    """Too few letters and digits, or too many stray marks, to be text."""
    alnum, size = F.regexp_count(text, F.lit("[A-Za-z0-9]")), F.length(text)
    junk = F.regexp_count(text, F.lit(r"[_~=+{}\[\]<>]"))
    thin = (alnum / F.greatest(size, F.lit(1)) < 0.25) & (size < 10)
    return F.coalesce((alnum <= 1) | ((size <= 3) & ~text.rlike("[A-Za-z]{2}")) | thin | (junk / F.greatest(size, F.lit(1)) > 0.35), F.lit(True))


NAME_LINE = r"^\s*([A-Z][A-Za-z0-9 ._'()-]{1,28})\s*[:\-]\s*(.{2,})$"


def name_hint(text: Column) -> Column:
    """The name before the first colon or dash, of four words at most; else null."""
    name = F.trim(F.regexp_extract(text, NAME_LINE, 1))
    return F.when((name != "") & (F.size(F.split(name, r"\s+")) <= 4), name)


def hinted_speech(text: Column) -> Column:
    """What follows the name, cleaned; the text itself where there is no name."""
    return F.when(name_hint(text).isNotNull(), clean_text(F.regexp_extract(text, NAME_LINE, 2))).otherwise(text)


def norm_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), 1, 64)


def block_type(text: Column, hint: Column, y: Column, h: Column, height: Column, style: Column) -> Column:
    """unknown, dialogue, sfx or narration. Short loud text is a sound effect, edge captions are narration."""
    t = F.trim(text)
    alpha = F.regexp_count(t, F.lit("[A-Za-z]"))
    words = F.regexp_count(t, F.lit("[A-Za-z0-9]+"))
    near_edge = (y < height * 0.12) | (y + h > height * 0.88)
    loud = (words <= 4) & ~t.rlike(r"\p{Ll}") & (alpha >= 2)
    marked = t.rlike("[!.-]")
    return (
        F.when(t == "", "unknown").when(hint.isNotNull() & (hint != ""), "dialogue").when((loud & marked) | (loud & (alpha <= 10)), "sfx")
        .when(near_edge & (words >= 4) & style.isin("dark_caption", "mixed"), "narration").otherwise("dialogue")
    )


#: The cue words of each emotion, tried in this order within their kind of sentence.
SHOUT_WORDS = ("no", "stop", "help", "wait")
GLAD_WORDS = ("wow", "amazing", "great", "awesome", "yes")
ANGRY_WORDS = ("no", "damn", "hell")
QUESTION_WORDS = ("what", "how", "why", "when", "where")
THINK_WORDS = ("hmm", "uh", "um", "well")
RESIGNED_WORDS = ("sigh", "oh")
HAPPY_WORDS = ("haha", "hehe", "lol", "laugh", "smile", "happy")
SAD_WORDS = ("sob", "cry", "sad", "tears", "weep")
SURPRISE_WORDS = ("whoa", "oh my", "incredible", "unbelievable")
AGREE_WORDS = ("yes", "okay", "sure", "alright", "good")
DISAGREE_WORDS = ("no", "nope", "never", "stop")


def emotion(text: Column) -> Column:
    """One of fourteen tags from marks and cue words (as substrings); null if none applies."""
    low = F.trim(F.lower(text))

    def has(words: tuple[str, ...]) -> Column:
        out = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(low, F.lit(w))
        return out

    upper = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    loud = F.when(has(SHOUT_WORDS), "shouting").otherwise("excited")
    strong = F.when(has(GLAD_WORDS), "excited").when(has(ANGRY_WORDS), "angry").otherwise("emphatic")
    asking = F.when(has(QUESTION_WORDS), "questioning").otherwise("confused")
    fading = F.when(has(THINK_WORDS), "thoughtful").when(has(RESIGNED_WORDS), "resigned").otherwise("trailing")
    return (
        F.when(upper | text.contains("!!"), loud).when(text.contains("!"), strong).when(text.contains("?"), asking)
        .when(text.contains("...") | low.endswith("."), fading).when(has(HAPPY_WORDS), "happy").when(has(SAD_WORDS), "sad")
        .when(has(SURPRISE_WORDS), "surprised").when(has(AGREE_WORDS), "agreeing").when(has(DISAGREE_WORDS), "disagreeing")
    )


def emotion_tagged(text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), emotion(text), F.lit("] "), text), text)


def script_line(kind: Column, speaker: Column, text: Column, emotions: bool = False) -> Column:
    """A block as a line of the script; null for blank text."""
    t = F.trim(text)
    said = emotion_tagged(t) if emotions else t
    line = F.when(kind == "sfx", F.concat(F.lit("[SFX] "), t)).when(kind == "narration", F.concat(F.lit("Narrator: "), t))
    return F.when(t != "", line.otherwise(F.concat(F.coalesce(F.nullif(speaker, F.lit("")), F.lit("Unknown")), F.lit(": "), said)))


def panel_header(name: Column, scene: Column, dark: Column) -> Column:
    return F.concat(F.lit("[Panel "), F.coalesce(name, F.lit("unknown")), F.lit(" | "), F.coalesce(scene, F.lit("mixed_scene")), F.when(dark, " | dark").otherwise(""), F.lit("]"))


def speaker_confidence(reason: Column, match: Column) -> Column:
    """Confidence of a speaker by the reason it was chosen for; ``match`` is the face match's."""
    near = F.least(F.lit(0.72), F.greatest(match, F.lit(0.42)))
    return (
        F.when(reason == "sound_effect", 1.0).when(reason == "caption_or_edge_text", 0.82).when(reason == "explicit_name_no_face", 0.88)
        .when(reason == "explicit_name", match).when(reason == "nearest_known_face", 0.56).when(reason == "nearest_face", near).otherwise(0.0)
    )


def tagged_lines(text: Column) -> Column:
    """What follows a bracketed tag on its line."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]\n]*\][ \t]*([^\n]+)"), F.lit(1))


def series_id(name: Column) -> Column:
    """The name in small letters, trimmed: its first 30 word characters and hyphens, spaces as underscores, and eight digits of its hash; ``unknown_series`` where there is no name."""
    low = F.regexp_replace(F.lower(name), r"(?U)^\s+|\s+$", "")
    clean = F.substring(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s-]", ""), r"(?U)\s+", "_"), 1, 30)
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown_series").otherwise(F.concat(clean, F.lit("_"), F.substring(F.md5(F.encode(low, "UTF-8")), 1, 8)))


def token_estimate(text: Column, characters: int = 3) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / characters)).cast("int")


def unfenced_json(text: Column) -> Column:
    """The JSON between code fences, or the text itself where there are none."""
    inner = F.regexp_extract(text, r"```(?:json)?\s*([^`]*)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def spoken_script(text: Column) -> Column:
    """A script without panel and visual headers, runs of blank lines cut to one."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~(x.startswith("[Panel") | x.startswith("[Visual:")))
    return F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")

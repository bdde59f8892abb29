"""Queries of the text and address functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.functions import text as X
from stripweave.functions import urls as U
from stripweave.plans.registry import query
from stripweave.sources.feeds import feed, read, with_feeds


def _scalar(name: str, source: str, keys: list[str], columns: Callable[[], dict[str, Column]], oracle: str | None) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, source[1:]) if source[0] == "@" else feed(spark, sf_dir, source)
        return rows.select(*keys, *(c.alias(n) for n, c in columns().items()))


LINE = ["doc_id", "pos"]


def _lines(name: str, columns: Callable[[], dict[str, Column]], sql: str, source: str = "lines") -> None:
    _scalar(name, "lines", LINE, columns, with_feeds(f"SELECT doc_id, pos, {sql} FROM {source}", "lines"))


_lines("clean_text", lambda: {"clean": X.clean_text(F.col("line"))}, r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(line, '|', 'I'), '\s+', ' ', 'g'), '!{4,}', '!!!', 'g'), '\?{4,}', '???', 'g'), '\.{4,}', '...', 'g'), ',{4,}', ',,,', 'g'), ' ' || chr(9) || chr(13) || chr(10) || '"''`') AS clean""")
_lines("is_noise", lambda: {"noise": X.is_noise(F.col("line"))}, r"""(n <= 1 OR (length(line) <= 3 AND NOT regexp_matches(line, '[A-Za-z]{2}')) OR (n / greatest(length(line), 1) < 0.25 AND length(line) < 10) OR length(regexp_replace(line, '[^_~=+{}\[\]<>]', '', 'g')) / greatest(length(line), 1) > 0.35) AS noise""", "(SELECT *, length(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) AS n FROM lines) l")
NAME = r"'^\s*([A-Z][A-Za-z0-9 ._''()-]{1,28})\s*[:\-]\s*(.{2,})$'"
_lines("split_name_hint", lambda: {"hint": X.name_hint(F.col("line"))}, rf"""CASE WHEN regexp_extract(line, {NAME}, 1) <> '' AND len(regexp_split_to_array(trim(regexp_extract(line, {NAME}, 1)), '\s+')) <= 4 THEN trim(regexp_extract(line, {NAME}, 1)) END AS hint""")
_lines("norm_name", lambda: {"name": X.norm_name(F.col("line"))}, "substr(regexp_replace(lower(line), '[^a-z0-9]', '', 'g'), 1, 64) AS name")


def _like_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def emotion_sql(text: str) -> str:
    low = f"trim(lower({text}))"
    has = lambda words: _like_any(low, words)
    return rf"""CASE WHEN (regexp_matches({text}, '\p{{Lu}}') AND NOT regexp_matches({text}, '\p{{Ll}}')) OR contains({text}, '!!') THEN CASE WHEN {has(X.SHOUT_WORDS)} THEN 'shouting' ELSE 'excited' END
WHEN contains({text}, '!') THEN CASE WHEN {has(X.GLAD_WORDS)} THEN 'excited' WHEN {has(X.ANGRY_WORDS)} THEN 'angry' ELSE 'emphatic' END
WHEN contains({text}, '?') THEN CASE WHEN {has(X.QUESTION_WORDS)} THEN 'questioning' ELSE 'confused' END
WHEN contains({text}, '...') OR ends_with({low}, '.') THEN CASE WHEN {has(X.THINK_WORDS)} THEN 'thoughtful' WHEN {has(X.RESIGNED_WORDS)} THEN 'resigned' ELSE 'trailing' END
WHEN {has(X.HAPPY_WORDS)} THEN 'happy' WHEN {has(X.SAD_WORDS)} THEN 'sad' WHEN {has(X.SURPRISE_WORDS)} THEN 'surprised' WHEN {has(X.AGREE_WORDS)} THEN 'agreeing' WHEN {has(X.DISAGREE_WORDS)} THEN 'disagreeing' END"""


_lines("emotion_tag", lambda: {"emotion": X.emotion(F.col("line"))}, emotion_sql("line") + " AS emotion")

TYPE_SQL = r"""CASE WHEN trim(text) = '' THEN 'unknown' WHEN name_hint IS NOT NULL THEN 'dialogue'
WHEN len(regexp_extract_all(trim(text), '[A-Za-z0-9]+')) <= 4 AND NOT regexp_matches(trim(text), '\p{Ll}') AND length(regexp_replace(trim(text), '[^A-Za-z]', '', 'g')) >= 2
 AND (regexp_matches(trim(text), '[!.-]') OR length(regexp_replace(trim(text), '[^A-Za-z]', '', 'g')) <= 10) THEN 'sfx'
WHEN (y < height * 0.12 OR y + h > height * 0.88) AND len(regexp_extract_all(trim(text), '[A-Za-z0-9]+')) >= 4 AND box_style IN ('dark_caption', 'mixed') THEN 'narration' ELSE 'dialogue' END"""


def block_kind() -> Column:
    return X.block_type(F.col("text"), F.col("name_hint"), F.col("y"), F.col("h"), F.col("height"), F.col("box_style"))


_scalar("block_type", "blocks", ["chapter", "block"], lambda: {"kind": block_kind()}, with_feeds(f"SELECT chapter, block, {TYPE_SQL} AS kind FROM blocks", "blocks"))
_scalar(
    "script_line", "blocks", ["chapter", "block"], lambda: {"line": X.script_line(block_kind(), F.col("speaker"), F.col("text"), True), "header": X.panel_header(F.col("panel"), F.lit(None).cast("string"), F.col("is_dark"))},
    with_feeds(f"""SELECT chapter, block, CASE WHEN t = '' THEN NULL WHEN kind = 'sfx' THEN '[SFX] ' || t WHEN kind = 'narration' THEN 'Narrator: ' || t ELSE coalesce(nullif(speaker, ''), 'Unknown') || ': ' || coalesce('[' || {emotion_sql('t')} || '] ' || t, t) END AS line,
    '[Panel ' || panel || ' | mixed_scene' || CASE WHEN is_dark THEN ' | dark' ELSE '' END || ']' AS header FROM (SELECT *, trim(text) AS t, {TYPE_SQL} AS kind FROM blocks) b""", "blocks"),
)
_scalar(
    "speaker_confidence", "blocks", ["chapter", "block"],
    lambda: {"confidence": X.speaker_confidence(F.element_at(F.array(*map(F.lit, ("sound_effect", "caption_or_edge_text", "explicit_name_no_face", "explicit_name", "nearest_known_face", "nearest_face", "none"))), (F.col("confidence") % 7 + 1).cast("int")), F.col("confidence") / 100)},
    with_feeds("SELECT chapter, block, CASE confidence % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.82 WHEN 2 THEN 0.88 WHEN 3 THEN confidence / 100 WHEN 4 THEN 0.56 WHEN 5 THEN least(0.72, greatest(confidence / 100, 0.42)) ELSE 0.0 END AS confidence FROM blocks", "blocks"),
)
_scalar("natural_key", "files", ["doc_id"], lambda: {"key": X.natural_key(F.col("name"))}, with_feeds(
    "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(ltrim(x, '0'), 20, '0') ELSE '1' || x END), chr(1)) AS key FROM files", "files"))
_scalar("series_id", "files", ["doc_id"], lambda: {"id": X.series_id(F.concat(F.lit(" "), "series", F.lit("  The "), "chapter", F.lit("!-")))}, with_feeds(
    r"SELECT doc_id, substr(regexp_replace(regexp_replace(l, '[^\w\s-]', '', 'g'), '\s+', '_', 'g'), 1, 30) || '_' || substr(md5(l), 1, 8) AS id FROM (SELECT doc_id, lower(trim(series || '  The ' || chapter || '!-')) AS l FROM files) f", "files"))
_scalar("token_estimate", "@documents", ["doc_id"], lambda: {"by3": X.token_estimate(F.col("text")), "by4": X.token_estimate(F.col("text"), 4)}, "SELECT doc_id, greatest(1, length(text) // 3)::INT AS by3, greatest(1, length(text) // 4)::INT AS by4 FROM documents")
_scalar("extract_tagged_lines", "blocks", ["chapter", "block"], lambda: {"lines": F.array_join(X.tagged_lines(F.concat(F.lit("["), F.col("speaker"), F.lit("] "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n[x]")))), "|")}, with_feeds(
    r"SELECT chapter, block, array_to_string(regexp_extract_all('[' || speaker || '] ' || replace(text, chr(10), chr(10) || '[x]'), '\[[^\]\n]*\][ \t]*([^\n]+)', 1), '|') AS lines FROM blocks", "blocks"))
_scalar("strip_json_fence", "@events", ["event_id"], lambda: {"k": F.get_json_object(X.unfenced_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))), "$.k").cast("int")}, "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
_scalar("script_header_clean", "@documents", ["doc_id"], lambda: {"script": X.spoken_script(F.concat(F.lit("[Panel 1]\n"), F.col("text"), F.lit("\n\n\n\n[Visual: x]\nend")))},
    "SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split('[Panel 1]' || chr(10) || text || repeat(chr(10), 4) || '[Visual: x]' || chr(10) || 'end', chr(10)), lambda x: NOT (starts_with(x, '[Panel') OR starts_with(x, '[Visual:'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') AS script FROM documents")

PAGE = ["page_id"]
NETLOC = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_scalar("domain_strip_www", "@pages", PAGE, lambda: {"domain": U.domain_strip_www(F.col("url"))}, rf"SELECT page_id, regexp_replace({NETLOC}, '^www\.', '') AS domain FROM pages")
_scalar("domain_lower_replace", "@pages", PAGE, lambda: {"domain": U.domain_lower_replace(F.col("url"))}, f"SELECT page_id, replace(lower(coalesce(nullif({NETLOC}, ''), url)), 'www.', '') AS domain FROM pages")
_scalar("url_key", "@pages", PAGE, lambda: {"key": U.url_key(F.col("url")), "same": U.same_page(F.col("url"), F.concat(F.col("url"), F.lit("/#x")))}, "SELECT page_id, rtrim(string_split(url, '#')[1], '/') AS key, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') = rtrim(regexp_extract(url || '/#x', '^([^?#]*)', 1), '/') AS same FROM pages")
_scalar("chapter_number", "@pages", PAGE, lambda: {"last": U.chapter_number(F.col("url")), "first": U.chapter_number(F.concat(F.lit("x/ch-"), F.col("page_id")), 7), "none": U.chapter_number(F.col("url"), 7)},
    "SELECT page_id, coalesce(list_last(regexp_extract_all(lower(url), '[0-9]+'))::INT, 1) AS last, page_id::INT AS first, coalesce(nullif(regexp_extract(lower(url), '(?:chapter|ch|episode|ep)[-_]?([0-9]+)', 1), '')::INT, 7) AS none FROM pages")
_scalar("series_name", "@pages", PAGE, lambda: {"name": U.series_name(F.concat(F.lit("https://a.example/series/big-"), F.col("page_id"), F.lit("-story/chapter-1"))), "given": U.series_name(F.col("url"), F.when(F.col("page_id") % 2 == 0, "Own name")), "last": U.series_name(F.concat(F.lit("https://www.a.example/o'neil-2nd/"), "page_id")), "auto": U.series_name(F.concat(F.lit("p"), "page_id"))},
    "SELECT page_id, 'Big ' || page_id || ' Story' AS name, 'O''Neil 2Nd' AS last, 'Auto_chapter' AS auto, CASE WHEN page_id % 2 = 0 THEN 'Own name' ELSE (SELECT string_agg(upper(x[1]) || substr(x, 2), '' ORDER BY k) FROM (SELECT unnest(r) AS x, unnest(range(len(r))) AS k FROM (SELECT regexp_extract_all(lower(replace(string_split(u, '/')[-2], '-', ' ')), '[a-z]+|[^a-z]+') AS r) q) t) END AS given FROM (SELECT page_id, rtrim(url, '/') AS u FROM pages) p")
_scalar("abs_url", "@pages", PAGE, lambda: {"rooted": U.abs_url(F.lit("/a?b"), F.col("url")), "up": U.abs_url(F.lit("../x/./y"), F.lit("https://h.example/a/b/c")), "other": U.abs_url(F.lit("//o.example/z"), F.col("url"))},
    "SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/a?b' AS rooted, 'https://h.example/a/x/y' AS up, regexp_extract(url, '^([A-Za-z]+):', 1) || '://o.example/z' AS other FROM pages")


@query("expand_template", "SELECT page_id, k, 'https://r.example/' || page_id || '/chapter-' || lpad((page_id + k)::VARCHAR, greatest(3, length((page_id + k)::VARCHAR))::INT, '0') AS counted, 'u' || page_id || '/' || (k + 1) AS ranged FROM pages, (SELECT unnest(range(4)) AS k) n")
def expand_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    counted = U.expand_template(F.concat(F.lit("https://r.example/"), F.col("page_id"), F.lit("/chapter-"), F.lpad(F.col("page_id").cast("string"), F.greatest(F.lit(3), F.length(F.col("page_id").cast("string"))), F.lit("0"))), 4)
    ranged = U.expand_template(F.concat(F.lit("u"), F.col("page_id"), F.lit("/{chapter}")), 4)
    return pages.select("page_id", F.posexplode(F.arrays_zip(counted.alias("c"), ranged.alias("r"))).alias("k", "x")).select("page_id", "k", F.col("x.c").alias("counted"), F.col("x.r").alias("ranged"))


LINK_SQL = """SELECT page_id, unnest(l) AS href, unnest(range(len(l))) AS idx FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages) p"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link's address with an ending and a number, so that every rule has something to decide."""
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("idx", "href"))


VARIED = "concat('https://cdn.example/', CASE idx % 5 WHEN 0 THEN 'episode/' WHEN 1 THEN 'img/' WHEN 2 THEN 'ads/' WHEN 3 THEN 'image-40x60/' ELSE 'v/' END, '1234567890', CAST(page_id AS STRING), href, CASE idx % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.webp?type=w800' WHEN 2 THEN '.svg' ELSE '.gif' END)"


def _any_sql(column: str, words: tuple[str, ...]) -> str:
    return _like_any(column, words)


def _link_rule(name: str, rule: Callable[[], Column], sql: str) -> None:
    @query(name, f"SELECT page_id, idx, coalesce({sql}, false) AS ok FROM (SELECT *, lower(url) AS low FROM (SELECT *, {VARIED} AS url FROM ({LINK_SQL}) l) v) w")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return page_links(spark, sf_dir).withColumn("url", F.expr(VARIED)).select("page_id", "idx", rule().alias("ok"))


PATH = "regexp_extract(low, '^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_link_rule("url_is_page_generic", lambda: U.url_is_page_generic(F.col("url")), rf"NOT {_any_sql('low', U.SKIP_GENERIC)} AND (regexp_matches({PATH}, '\.(jpg|jpeg|png|webp|gif|avif)$') OR contains(low, 'image') OR contains({PATH}, 'img'))")
_link_rule("url_is_page_theme", lambda: U.url_is_page_theme(F.col("url")), rf"(regexp_matches(low, '\.(jpg|jpeg|png|webp|gif)') OR contains(low, 'image')) AND NOT {_any_sql('low', U.SKIP_THEME)} AND coalesce(NOT (try_cast(regexp_extract(low, '[/=_-]([0-9]+)x([0-9]+)', 1) AS INT) < 50 OR try_cast(regexp_extract(low, '[/=_-]([0-9]+)x([0-9]+)', 2) AS INT) < 50), true)")
_link_rule("url_is_page_cdn_strict", lambda: U.url_is_page_cdn_strict(F.col("url")), rf"""CASE WHEN {_any_sql('low', U.SKIP_CDN)} OR NOT contains(low, 'cdn.') THEN false
 WHEN regexp_matches(string_split(list_last(string_split(low, '/')), '?')[1], '[0-9]{{10,}}') AND (contains(low, '/episode/') OR contains(low, 'viewer') OR contains(low, 'title_no=')) THEN true
 WHEN contains(low, 'type=w') AND contains(low, '/episode/') THEN try_cast(regexp_extract(low, 'type=w([0-9]+)', 1) AS INT) >= 600 ELSE contains(low, 'viewer') AND contains(low, 'episode_no=') END""")
_link_rule("url_is_page_engine", lambda: U.url_is_page_engine(F.col("url")), rf"NOT {_any_sql('low', U.SKIP_ENGINE)} AND (regexp_matches(string_split(low, '?')[1], '\.(jpg|jpeg|png|webp)') OR contains(low, 'image') OR contains(low, 'img'))")
_link_rule("junk_element_filter", lambda: U.is_junk_element(F.col("url"), F.array(F.lit("x"), F.when(F.col("idx") == 3, "site-header").otherwise("page"))), rf"{_any_sql('low', U.JUNK_WORDS)} OR idx = 3 OR {_any_sql('low', U.AD_MARKS)} OR ends_with(string_split(low, '?')[1], '.svg') OR (NOT regexp_matches(string_split(low, '?')[1], '\.(jpg|jpeg|png|webp)') AND (contains(low, '.gif') OR contains(low, 'base64')))")
_link_rule("candidate_size_filter", lambda: U.candidate_size_ok(F.col("page_id") % 1200, F.col("idx") * 200, F.col("url")), "greatest(page_id % 1200, idx * 200) >= 900 OR (page_id % 1200 >= 600 AND idx * 200 >= 600) OR coalesce(try_cast(regexp_extract(low, 'type=w([0-9]+)', 1) AS INT) >= 700, false)")


@query("scan_url_list", "SELECT page_id, address FROM (SELECT page_id, trim(unnest(regexp_split_to_array(list, '[\\n,]+'))) AS address FROM (SELECT page_id, url || ', ' || chr(10) || '# note' || chr(10) || replace(url, 'https://', '') AS list FROM pages) p) a WHERE address <> '' AND NOT starts_with(address, '#')")
def scan_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripweave.sources.lists import split_address_lists

    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.col("url"), F.lit(", \n# note\n"), F.replace("url", F.lit("https://"), F.lit(""))).alias("value"))
    return split_address_lists(pages)


@query("normalise_url_queue", "SELECT page_id, k, CASE WHEN regexp_matches(trim(u), '^https?://') THEN trim(u) ELSE 'https://' || trim(u) END AS address, contains(CASE WHEN regexp_matches(trim(u), '^https?://') THEN trim(u) ELSE 'https://' || trim(u) END, '.') AND NOT contains(trim(u), ' ') AS valid FROM (SELECT page_id, 0 AS k, url AS u FROM pages UNION ALL SELECT page_id, 1, regexp_replace(url, '^https?://', '') || ' x' FROM pages UNION ALL SELECT page_id, 2, 'nowhere' FROM pages) q")
def normalise_url_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    given = F.array(F.col("url"), F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(" x")), F.lit("nowhere"))
    rows = pages.select("page_id", F.posexplode(given).alias("k", "u"))
    return rows.select("page_id", "k", U.queue_address(F.col("u")).alias("address"), U.queue_valid(F.col("u")).alias("valid"))

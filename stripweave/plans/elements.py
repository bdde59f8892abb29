"""Queries over pages and their elements. The test pages hold links rather than images, so links are what is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.functions import urls as U
from stripweave.operators import elements as O
from stripweave.operators.ranking import global_row_number
from stripweave.plans.registry import query
from stripweave.plans.texts import LINK_SQL, page_links
from stripweave.sources.feeds import read
from stripweave.sources.pages import html_elements


def _href() -> Column:
    return F.try_element_at(F.col("attrs"), F.lit("href"))


DOMAIN = r"replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.', '')"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return O.scored_elements(html_elements(pages, ("a",)), pages, "a", _href())


@query("html_elements", """SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<li>')) AS items, 1 AS articles FROM pages""")
def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_elements(read(spark, sf_dir, "pages"))
    return rows.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "li").alias("items"), F.count_if(F.col("tag") == "article").cast("int").alias("articles"))


@query("scan_pages_html", "SELECT page_id, url, length(html) AS n FROM pages")
def scan_pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("site_config_join", f"SELECT page_id, CASE WHEN contains(d, 'shop') THEN 'shop' WHEN contains(d, 'blog.') THEN 'blog' WHEN contains(d, 'example.org') THEN 'org' WHEN contains(d, 'm.') THEN 'mobile' ELSE 'default' END AS name, contains(d, 'shop') OR contains(d, 'blog.') OR contains(d, 'example.org') OR contains(d, 'm.') AS known FROM (SELECT page_id, {DOMAIN} AS d FROM pages) p")
def site_config_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").withColumn("site", O.site_config(F.col("url"))).select("page_id", "site.name", "site.known")


@query("site_config_table", "SELECT fragment, name FROM (VALUES ('shop', 'shop2'), ('blog.', 'blog'), ('example.org', 'org'), ('m.', 'mobile')) v(fragment, name) UNION ALL SELECT DISTINCT regexp_extract(url, '\\.([a-z]+)[/?#]', 1), 'found' FROM pages WHERE regexp_extract(url, '\\.([a-z]+)[/?#]', 1) <> ''")
def site_config_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([s[:2] for s in O.SITES], "fragment string, name string")
    found = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"\.([a-z]+)[/?#]", 1).alias("fragment")).filter("fragment <> ''").distinct()
    new = found.withColumn("name", F.lit("found")).unionByName(spark.createDataFrame([("shop", "shop2")], "fragment string, name string"))
    return O.register_site(table, new)


@query("url_dedupe_first", f"SELECT page_id, href, min(idx)::INT AS idx FROM ({LINK_SQL}) l GROUP BY 1, 2")
def url_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.dedupe_first(page_links(spark, sf_dir), "href")


@query("dynamic_threshold_keep", f"SELECT page_id, idx, score FROM (SELECT *, max(score) OVER (PARTITION BY page_id) AS top FROM (SELECT page_id, idx::INT AS idx, (length(href) * 7 + idx * 13 + page_id) % 90 AS score FROM ({LINK_SQL}) l) s) t WHERE top >= 30 AND score >= greatest(20, top * 0.6)")
def dynamic_threshold_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_links(spark, sf_dir).select("page_id", "idx", ((F.length("href") * 7 + F.col("idx") * 13 + F.col("page_id")) % 90).alias("score"))
    return O.keep_by_threshold(rows)


@query("element_score")
def element_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("page_id", "idx", "score")


@query("pick_src")
def pick_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_elements(read(spark, sf_dir, "pages"), ("a",))
    return rows.select("page_id", "idx", U.pick_src(F.col("attrs"), ("href",)).alias("src"))


@query("selector_priority_match")
def selector_priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_elements(read(spark, sf_dir, "pages"), ("a", "div", "p"))
    return O.selector_priority(rows, ["a.reader", ".ad", "li a", "p"], F.lit(True)).select("page_id", "idx", "tag", "rank")


@query("induce_selector")
def induce_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.induce_selector(_scored(spark, sf_dir))


@query("learned_selector_probe")
def learned_selector_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("score", F.col("score") + 30)
    return O.probe_selectors(scored, O.induce_selector(scored))


@query("page_image_extraction")
def page_image_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.page_images(_scored(spark, sf_dir).withColumn("score", F.col("score") + 30)).select("page_id", "domain", "seq", "url", "score")


@query("page_link_edges")
def page_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit('<a href="'), F.lit('<a rel="next" href="')))
    return O.link_edges(pages)


@query("raw_url_scan", f"SELECT page_id, href, min(idx)::INT AS idx FROM ({LINK_SQL}) l GROUP BY 1, 2")
def raw_url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit('<a href="/'), F.lit('<a href="//cdn.example/')))
    rows = O.raw_url_scan(pages, "cdn.example", F.lit(True))
    return rows.select("page_id", F.replace("url", F.lit("https://cdn.example"), F.lit("")).alias("href"), "idx")


@query("api_image_list", f"SELECT page_id, href, min(idx)::INT AS idx FROM ({LINK_SQL}) l WHERE page_id % 2 = 0 GROUP BY 1, 2")
def api_image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = page_links(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "href"))).alias("l"))
    payload = F.to_json(F.struct((F.col("page_id") % 2 == 0).alias("success"), F.transform("l", lambda x: x["href"]).alias("images")))
    return O.api_images(links.select("page_id", payload.alias("payload"))).withColumnRenamed("url", "href")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).select("page_id", "idx", F.concat(F.lit("https://r.example/"), F.when(F.col("idx") % 4 == 1, "list/").otherwise("chapter-"), F.col("idx").cast("string")).alias("url"))


@query("episode_lookup", f"SELECT page_id, CASE WHEN max(idx) >= 1 THEN 'https://r.example/list/1' END AS list_url, CASE WHEN max(idx) >= 3 THEN 'https://r.example/chapter-3' END AS episode_url FROM ({LINK_SQL}) l GROUP BY 1")
def episode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.episode_lookup(_numbered(spark, sf_dir), F.lit(3))


@query("next_link_chain", """WITH c AS (SELECT DISTINCT conv_id FROM conversations), n AS (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS nxt, row_number() OVER (ORDER BY conv_id DESC) AS to_end FROM c),
w AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS r FROM c)
SELECT 'https://r.example/c' || s.conv_id AS seed, (t.r - w.r + 1)::INT AS step, 'https://r.example/c' || t.conv_id AS url, NULL::VARCHAR AS reason FROM n s JOIN w USING (conv_id) JOIN w t ON t.r BETWEEN w.r AND w.r + 3 WHERE s.to_end >= 4
UNION ALL SELECT 'https://r.example/c' || conv_id, 1, NULL, 'chain too short' FROM n WHERE to_end < 4""")
def next_link_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stand for pages, each linking to the one with the next number."""
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    numbered = global_row_number(ids, F.floor(F.col("conv_id") / 10_000), ["conv_id"], "n")
    later = numbered.select(F.col("conv_id").alias("a"), (F.col("n") + 1).alias("n")).join(numbered.select(F.col("conv_id").alias("b"), "n"), "n")
    page = lambda c: F.concat(F.lit("https://r.example/c"), F.col(c).cast("string"))
    return O.follow_links(later.select(page("a").alias("source"), page("b").alias("target")), ids.select(page("conv_id").alias("url")), 4)


@query("chapter_window_from_seed", f"WITH l AS ({LINK_SQL}), n AS (SELECT page_id, max(idx) AS m FROM l GROUP BY 1) SELECT page_id, k + 1 AS step, 'https://r.example/o' || (2 + k) AS url FROM n, (SELECT unnest(range(3))::INT AS k) WHERE m >= 4")
def chapter_window_from_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = page_links(spark, sf_dir).select("page_id", "idx", F.concat(F.lit("https://r.example/o"), F.col("idx").cast("string")).alias("target"))
    seeds = options.filter("idx = 2").select("page_id", F.concat("target", F.lit("/#top")).alias("url"))
    return O.chapter_window(options, seeds, 3)


@query("chapter_jobs", "SELECT page_id AS queue_id, k, 'https://r.example/s/' || (page_id % 7) || '/chapter-' || (k + 1) AS url, (k + 1)::INT AS chapter_number, 'Chapter_' || (k + 1) || CASE WHEN r > 1 THEN '_' || lpad(r::VARCHAR, greatest(2, length(r::VARCHAR))::INT, '0') ELSE '' END AS folder, page_id % 7 AS series FROM (SELECT page_id, k, row_number() OVER (PARTITION BY page_id % 7, k ORDER BY page_id) AS r FROM pages, (SELECT unnest(range(3)) AS k)) x")
def chapter_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = read(spark, sf_dir, "pages").select(F.col("page_id").alias("queue_id"), (F.col("page_id") % 7).alias("series"), F.concat(F.lit(" r.example/s/"), F.col("page_id") % 7, F.lit("/chapter-{chapter}")).alias("address"))
    return O.chapter_jobs(queue, 3)


@query("collision_free_folders", "SELECT doc_id, 'Chapter_' || (doc_id % 25) || CASE WHEN r > 1 THEN '_' || lpad(r::VARCHAR, greatest(2, length(r::VARCHAR))::INT, '0') ELSE '' END AS folder FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, doc_id % 25 ORDER BY doc_id) AS r FROM documents) d")
def collision_free_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Chapter_"), F.col("doc_id") % 25).alias("base"))
    return O.collision_free(rows, ["source"], ["doc_id"]).select("doc_id", "folder")

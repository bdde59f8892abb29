"""Page elements: site rules, scoring, learned selectors, image extraction, link edges and chapter jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.functions import urls as U
from stripweave.functions.text import natural_key

#: Neutral sample rows; callers bring their own. ``fragment, name, selectors``, in order of precedence.
SITES = (("shop", "shop", ["img.product"]), ("blog.", "blog", ["article img", "img.post"]), ("example.org", "org", ["img.page"]), ("m.", "mobile", ["img"]))
DEFAULT_SITE = ("", "default", ["img"])


def site_config(url: Column, sites: Sequence[tuple] = SITES) -> Column:
    """The first site whose fragment is in the address's domain, else the default: ``name, selectors, known``."""
    host = U.domain_lower_replace(url)
    out = F.struct(F.lit(DEFAULT_SITE[1]).alias("name"), F.array(*map(F.lit, DEFAULT_SITE[2])).alias("selectors"), F.lit(False).alias("known"))
    for fragment, name, selectors in reversed(sites):
        out = F.when(F.contains(host, F.lit(fragment)), F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, selectors)).alias("selectors"), F.lit(True).alias("known"))).otherwise(out)
    return out


def register_site(sites: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the new rows in the place of those with their fragment."""
    return sites.join(new, "fragment", "left_anti").unionByName(new)


def selector_matches(selector: Column) -> Column:
    """Whether an element (columns tag, id, classes, parent_id, parent_classes) fits ``tag``, ``.c``, ``tag.c``, ``#id``, or ``parent tag`` of these."""
    last, above = F.substring_index(selector, " ", -1), F.when(selector.contains(" "), F.substring_index(selector, " ", 1))

    def fits(part: Column, tag: Column | None, id: Column, classes: Column) -> Column:
        name, css, by_id = F.regexp_extract(part, "^([A-Za-z0-9*]*)", 1), F.regexp_extract(part, r"\.([^.#]+)", 1), F.regexp_extract(part, "#([^.#]+)", 1)
        out = ((css == "") | F.array_contains(classes, css)) & ((by_id == "") | (id == by_id))
        return out if tag is None else out & (name.isin("", "*") | (tag == name))

    return fits(last, F.col("tag"), F.col("id"), F.col("classes")) & (above.isNull() | fits(above, None, F.col("parent_id"), F.col("parent_classes")))


def selector_priority(elements: DataFrame, selectors: Sequence[str], valid: Column) -> DataFrame:
    """Of each page the valid elements of the first selector that has any, with its ``rank``."""
    table = F.array(*map(F.lit, selectors))
    rows = elements.filter(valid).select("*", F.posexplode(table).alias("rank", "selector")).filter(selector_matches(F.col("selector")))
    return rows.withColumn("_least", F.min("rank").over(Window.partitionBy("page_id"))).filter(F.col("rank") == F.col("_least")).drop("_least")


def dedupe_first(rows: DataFrame, key: Column | str = "url", order: Sequence[str] = ("idx",)) -> DataFrame:
    """Of each page's equal addresses the first."""
    at = F.row_number().over(Window.partitionBy("page_id", key).orderBy(*order))
    return rows.withColumn("_at", at).filter(F.col("_at") == 1).drop("_at")


def keep_by_threshold(rows: DataFrame, *, least_top: float = 30, least: float = 20, share: float = 0.6) -> DataFrame:
    """Elements with a score of at least ``share`` of their page's best, and ``least``; none of a page whose best is under ``least_top``."""
    rows = rows.withColumn("_top", F.max("score").over(Window.partitionBy("page_id")))
    return rows.filter((F.col("_top") >= least_top) & (F.col("score") >= F.greatest(F.lit(least), F.col("_top") * share))).drop("_top")


def scored_elements(elements: DataFrame, pages: DataFrame, tag: str = "img", source: Column | None = None) -> DataFrame:
    """``page_id, domain, idx, url, score`` and selectors' columns of the elements with an address that is not furniture.

    Addresses are made once: as the only element of an array that is exploded, for a condition on a plain column goes below it and repeats how it is made at each of its uses.
    """
    source = U.pick_src(F.col("attrs")) if source is None else source
    rows = elements.filter(F.col("tag") == tag)
    page = Window.partitionBy("page_id")
    rows = rows.withColumn("nth", F.row_number().over(page.orderBy("idx")) - 1).withColumn("total", F.count("*").over(page))
    rows = rows.join(pages.select("page_id", F.col("url").alias("base")), "page_id").withColumn("src", F.explode(F.array(source))).filter(F.col("src").isNotNull())
    rows = rows.withColumn("url", F.explode(F.array(U.abs_url(F.col("src"), F.col("base"))))).filter(~U.is_junk_element(F.col("url"), F.col("classes")))
    score = U.element_score("tag", F.col("classes"), F.col("id"), F.col("attrs"), F.col("parent_classes"), F.col("depth"), F.col("nth"), F.col("total"))
    return rows.select("page_id", U.domain_strip_www(F.col("base")).alias("domain"), "idx", "tag", "id", "classes", "parent_id", "parent_classes", "url", score.alias("score"))


def page_images(scored: DataFrame) -> DataFrame:
    """The likely page images, each once, numbered in natural order of their addresses."""
    rows = dedupe_first(keep_by_threshold(scored), "url", ["idx"])
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy(natural_key(F.col("url")), "idx")))


#: Classes that say nothing about a site.
COMMON_CLASSES = ("img", "lazy", "lazyload")


def induce_selector(elements: DataFrame) -> DataFrame:
    """Per domain the selector that all its elements share: a class, else the parent's id, else a class of the parent; none gives the bare tag."""
    totals = elements.groupBy("domain").agg(F.count("*").alias("total"), F.min("tag").alias("tag"))
    own = elements.select("domain", F.explode(F.array_distinct("classes")).alias("name")).filter(~F.col("name").isin(*COMMON_CLASSES)).withColumn("kind", F.lit(0))
    by_id = elements.filter(F.col("parent_id") != "").select("domain", F.col("parent_id").alias("name"), F.lit(1).alias("kind"))
    above = elements.select("domain", F.explode(F.array_distinct("parent_classes")).alias("name")).withColumn("kind", F.lit(2))
    counts = own.unionByName(by_id).unionByName(above).groupBy("domain", "kind", "name").agg(F.count("*").alias("n"))
    shared = counts.join(totals, "domain").filter(F.col("n") == F.col("total"))
    best = shared.groupBy("domain").agg(F.min(F.struct("kind", "name")).alias("best"))
    name = F.col("best.name")
    text = F.when(F.col("best.kind") == 0, F.concat("tag", F.lit("."), name)).when(F.col("best.kind") == 1, F.concat(F.lit("#"), name, F.lit(" "), "tag")).when(F.col("best.kind") == 2, F.concat(F.lit("."), name, F.lit(" "), "tag")).otherwise(F.col("tag"))
    return totals.join(best, "domain", "left").select("domain", text.alias("selector"), F.col("best").isNotNull().alias("learned"), "total")


def probe_selectors(scored: DataFrame, learned: DataFrame, least: int = 3) -> DataFrame:
    """Page images by the domain's learned selector where it finds at least ``least``; by score elsewhere."""
    rows = scored.join(learned.filter("learned").select("domain", "selector"), "domain", "left")
    hit = F.coalesce(F.col("selector").isNotNull() & selector_matches(F.col("selector")), F.lit(False))
    rows = rows.withColumn("_hit", hit).withColumn("_hits", F.count_if("_hit").over(Window.partitionBy("page_id")))
    fast = dedupe_first(rows.filter((F.col("_hits") >= least) & F.col("_hit"))).select("page_id", "idx", "url", F.lit("learned").alias("by"))
    slow = dedupe_first(keep_by_threshold(rows.filter(F.col("_hits") < least))).select("page_id", "idx", "url", F.lit("scored").alias("by"))
    return fast.unionByName(slow)


def link_edges(pages: DataFrame) -> DataFrame:
    """``page_id, kind, idx, target``: chapter options and next links of each page, each target once, by regex over the html."""
    html = F.col("html")
    options = pages.select("page_id", "url", F.lit("option").alias("kind"), F.posexplode(F.regexp_extract_all(html, F.lit(r"""<option[^>]*\bvalue=["']([^"']+)["']"""), F.lit(1))).alias("idx", "href"))
    next_link = F.array_union(F.regexp_extract_all(html, F.lit(r"""<(?:a|link)\b(?=[^>]*\brel=["']?next\b)[^>]*\bhref=["']([^"']+)["']"""), F.lit(1)), F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\bhref=["']([^"']+)["'][^>]*>\s*next chapter"""), F.lit(1)))
    follows = pages.select("page_id", "url", F.lit("next").alias("kind"), F.posexplode(next_link).alias("idx", "href"))
    rows = options.unionByName(follows).withColumn("target", U.url_key(U.abs_url(F.col("href"), F.col("url"))))
    at = F.row_number().over(Window.partitionBy("page_id", "kind", "target").orderBy("idx"))
    return rows.withColumn("_at", at).filter(F.col("_at") == 1).select("page_id", "kind", "idx", "target")


def follow_links(edges: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """``seed, step, url``: from each seed the chain of next links (``source, target``), ``count`` pages long; a chain that repeats or ends before
    is empty but for one row with a ``reason``. Every step is a join over all seeds."""
    now = seeds.select(F.col("url").alias("seed"), U.url_key(F.col("url")).alias("at"), F.array(U.url_key(F.col("url"))).alias("seen"))
    nexts = edges.groupBy(F.col("source").alias("at")).agg(F.min("target").alias("target"))
    for _ in range(count - 1):
        step = now.join(nexts, "at", "left")
        ok = F.col("target").isNotNull() & ~F.array_contains("seen", F.col("target"))
        now = step.select("seed", F.when(ok, F.col("target")).alias("at"), F.when(ok, F.concat("seen", F.array("target"))).otherwise(F.col("seen")).alias("seen"))
    whole = F.size("seen") == count
    rows = now.select("seed", F.posexplode(F.when(whole, F.col("seen")).otherwise(F.array(F.lit(None).cast("string")))).alias("step", "url"), F.when(~whole, "chain too short").alias("reason"))
    return rows.select("seed", (F.col("step") + 1).alias("step"), "url", "reason")


def chapter_window(options: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """``page_id, step, url``: from the page's own place in its list of options the next ``count``; pages with fewer give none."""
    place = options.join(seeds.select("page_id", U.url_key(F.col("url")).alias("target")), ["page_id", "target"]).groupBy("page_id").agg(F.min("idx").alias("here"))
    rows = options.join(place, "page_id").filter((F.col("idx") >= F.col("here")) & (F.col("idx") < F.col("here") + count))
    page = Window.partitionBy("page_id")
    rows = rows.withColumn("_n", F.count("*").over(page)).filter(F.col("_n") == count)
    return rows.select("page_id", (F.col("idx") - F.col("here") + 1).alias("step"), F.col("target").alias("url"))


def raw_url_scan(pages: DataFrame, host: str, accept: Column) -> DataFrame:
    """Addresses of a host anywhere in the html, scripts and styles included; backslashes undone, ``//`` as https, the accepted ones, each once in order."""
    found = F.regexp_extract_all(F.replace("html", F.lit("\\/"), F.lit("/")), F.lit(r"((?:https?:)?//[^\s\"'<>()\\]*" + host.replace(".", r"\.") + r"[^\s\"'<>()\\]*)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("idx", "url"))
    rows = rows.withColumn("url", F.when(F.col("url").startswith("//"), F.concat(F.lit("https:"), "url")).otherwise(F.col("url"))).filter(accept)
    return dedupe_first(rows)


def api_images(rows: DataFrame, key: str = "images", flag: str = "success") -> DataFrame:
    """``page_id, idx, url`` of JSON payloads whose flag is true: the strings of the array under ``key``, each once."""
    body = F.from_json("payload", f"{flag} boolean, {key} array<string>")
    found = rows.select("page_id", body.alias("b")).filter(F.col(f"b.{flag}")).select("page_id", F.posexplode(f"b.{key}").alias("idx", "url"))
    return dedupe_first(found.filter(F.col("url").isNotNull() & (F.col("url") != "") & ~F.col("url").startswith("{") & ~F.col("url").startswith("[")))


def episode_lookup(links: DataFrame, number: Column) -> DataFrame:
    """Per page the first link to a list, and the first link to the wanted episode: ``page_id, list_url, episode_url``."""
    is_list = F.col("url").contains("/list")
    episode = U.chapter_number(F.col("url"), -1) == number
    return links.groupBy("page_id").agg(F.min_by("url", F.when(is_list, F.col("idx"))).alias("list_url"), F.min_by("url", F.when(episode & ~is_list, F.col("idx"))).alias("episode_url"))


def chapter_jobs(addresses: DataFrame, count: int) -> DataFrame:
    """``queue_id, k, url, chapter_number, folder``: queued addresses expanded, numbered, each with a folder of its own name; repeated names get ``_02`` and so on."""
    rows = addresses.filter(U.queue_valid(F.col("address"))).withColumn("address", U.queue_address(F.col("address")))
    rows = rows.select("queue_id", "series", F.posexplode(U.expand_template(F.col("address"), count)).alias("k", "url"))
    rows = rows.withColumn("chapter_number", U.chapter_number(F.col("url")))
    return collision_free(rows.withColumn("base", F.concat(F.lit("Chapter_"), "chapter_number")), ["series"], ["queue_id", "k"]).drop("base")


def collision_free(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``folder``: the base name, later ones of the same name numbered from 02."""
    at = F.row_number().over(Window.partitionBy(*by, "base").orderBy(*order))
    return rows.withColumn("_at", at).withColumn("folder", F.when(F.col("_at") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.lpad(F.col("_at").cast("string"), F.greatest(F.lit(2), F.length(F.col("_at").cast("string"))), F.lit("0"))))).drop("_at")

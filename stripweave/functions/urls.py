"""Column functions over addresses: hosts, keys, chapter numbers, series names, and which images can be pages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def netloc(url: Column) -> Column:
    """Host and port between the scheme's slashes and the path; empty where there is no scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def domain_strip_www(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def domain_lower_replace(url: Column) -> Column:
    return F.replace(F.lower(F.coalesce(F.nullif(netloc(url), F.lit("")), url)), F.lit("www."), F.lit(""))


def url_key(url: Column) -> Column:
    """An address without its fragment and trailing slashes."""
    return F.rtrim(F.substring_index(url, "#", 1), F.lit("/"))


def same_page(a: Column, b: Column) -> Column:
    """Same scheme, host and path."""
    base = r"^([^?#]*)"
    return F.rtrim(F.regexp_extract(a, base, 1), F.lit("/")) == F.rtrim(F.regexp_extract(b, base, 1), F.lit("/"))


def abs_url(href: Column, base: Column) -> Column:
    """An address as seen from a page: whole, protocol-relative, rooted, query, fragment, or relative to the page's folder, with ``./`` and ``../`` resolved."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), netloc(base))
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(path(base).contains("/"), F.regexp_replace(page, "[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    whole = (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href)).when(href.startswith("#") | (href == ""), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href)).otherwise(F.concat(folder, href))
    )
    relative = ~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & F.regexp_extract(href, "^([^?#]*)", 1).rlike(r"(^|/)\.{1,2}(/|$)")
    steps = F.split(path(whole), "/")

    def walk(kept: Column, step: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(step == "..", up).when(step == ".", kept).otherwise(F.concat(kept, F.array(step)))

    walked = F.aggregate(steps, F.array().cast("array<string>"), walk)
    tail = F.regexp_extract(whole, r"^[^?#]*(.*)$", 1)
    ended = F.when(path(whole).rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(relative, F.concat(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.array_join(walked, "/"), ended, tail)).otherwise(whole)


def chapter_number(url: Column, fallback: int | None = None) -> Column:
    """The last number after ``chapter``, else the last number, else 1; with ``fallback`` the first number after chapter, ch, episode or ep, else the fallback."""
    low = F.lower(url)
    if fallback is not None:
        found = F.regexp_extract(low, r"(?:chapter|ch|episode|ep)[-_]?([0-9]+)", 1)
        return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(fallback))
    named = F.get(F.reverse(F.regexp_extract_all(low, F.lit("chapter[-_]?([0-9]+)"), F.lit(1))), F.lit(0))
    last = F.get(F.reverse(F.regexp_extract_all(low, F.lit("([0-9]+)"), F.lit(1))), F.lit(0))
    return F.coalesce(F.coalesce(named, last).try_cast("int"), F.lit(1))


def _title(text: Column) -> Column:
    """Every run of letters with a capital first and small letters after, hyphens as spaces."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.replace(F.array_join(F.transform(runs, F.initcap), ""), F.lit("-"), F.lit(" "))


def series_name(url: Column, given: Column | None = None) -> Column:
    """The given name; else the path segment after manga, series, comic, title or read; else the last but one of the address's parts; else ``Auto_`` and the domain."""
    found = F.regexp_extract(url, r"/(?:manga|series|comic|title|read)/([^/?]+)", 1)
    parts = F.filter(F.split(url, "/"), lambda x: x != "")
    domain = F.replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("www."), F.lit(""))
    auto = F.concat(F.lit("Auto_"), F.coalesce(F.nullif(domain, F.lit("")), F.lit("chapter")))
    name = F.when(found != "", _title(found)).when(F.size(parts) >= 2, _title(F.get(parts, F.size(parts) - 2))).otherwise(auto)
    return name if given is None else F.coalesce(F.nullif(given, F.lit("")), name)


def _any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


#: Strings that no page image's address holds, by rule set, and the accepted endings.
SKIP_GENERIC = ("logo", "avatar", "icon", "banner", "thumb", "button", "background", "advertising", "pixel", "tracking", "spacer", "transparent", "gravatar", "captcha", "ad.", "/ads/")
SKIP_THEME = ("logo", "avatar", "icon", "banner", "button", "background", "zeropixel", "pixel", "tracking", "spacer", "transparent", "ad-", "/ads/", "advertisement", "promo", "sponsor", "favicon", "emoji", "smiley", "captcha", "badge", "gravatar", "wp-content/plugins", "wp-includes")
SKIP_ENGINE = ("logo", "avatar", "icon", "banner", "button", "background", "zeropixel", "pixel", "tracking", "spacer", "transparent", "gravatar", "captcha", "/ads/")
SKIP_DOWNLOAD = ("logo", "avatar", "icon", "banner", "button", "background", "zeropixel", "pixel", "tracking", "spacer", "transparent")
SKIP_CDN = ("thumbnail", "thumb", "landing-page", "landing_page", "mobile.jpg", "icon", "logo", "avatar", "profile", "button", "banner", "ad", "promo", "cover", "poster", "type=a92", "type=f218", "type=q85", "type=a100", "type=m", "_m.jpg", "_s.jpg", "_thumb", "genre", "title_card", "character", "creator", "notice", "event", "sharing", "facebook", "twitter", "instagram")
JUNK_WORDS = ("logo", "avatar", "icon", "banner", "button", "background", "zeropixel", "pixel", "tracking", "spacer", "transparent", "thumb", "footer", "header")
AD_MARKS = ("/ad/", "/ads/", "adserver", "advertis")


def url_is_page_generic(url: Column) -> Column:
    low = F.lower(url)
    ok = ~_any(low, SKIP_GENERIC) & (path(low).rlike(r"\.(jpg|jpeg|png|webp|gif|avif)$") | low.contains("image") | path(low).contains("img"))
    return F.coalesce(ok & (url != ""), F.lit(False))


def url_is_page_theme(url: Column) -> Column:
    """Also refuses data addresses, plugin folders, and sizes with a side under 50 in the address."""
    low = F.lower(F.trim(url))
    looks = low.rlike(r"\.(jpg|jpeg|png|webp|gif)") | low.contains("image")
    size = r"[/=_-]([0-9]+)x([0-9]+)"
    tiny = F.coalesce((F.regexp_extract(low, size, 1).try_cast("int") < 50) | (F.regexp_extract(low, size, 2).try_cast("int") < 50), F.lit(False))
    return F.coalesce(looks & ~_any(low, SKIP_THEME) & ~low.startswith("data:") & ~tiny & (url != ""), F.lit(False))


def url_is_page_cdn_strict(url: Column, host: str = "cdn.", least_width: int = 600) -> Column:
    """Only addresses of the host that hold a long number in an episode, a wide rendition, or a viewer's episode."""
    low = F.lower(url)
    name = F.substring_index(F.substring_index(low, "/", -1), "?", 1)
    bad = _any(low, SKIP_CDN)
    episode = name.rlike("[0-9]{10,}") & (low.contains("/episode/") | low.contains("viewer") | low.contains("title_no="))
    width = F.regexp_extract(low, "type=w([0-9]+)", 1).try_cast("int")
    wide = F.when(low.contains("type=w") & low.contains("/episode/") & width.isNotNull(), width >= least_width)
    ok = F.when(bad | ~low.contains(host), False).when(episode, True).when(wide.isNotNull(), wide).otherwise(low.contains("viewer") & low.contains("episode_no="))
    return F.coalesce(ok, F.lit(False))


def url_is_page_engine(url: Column, variant: str = "engine") -> Column:
    low = F.lower(url)
    if variant == "engine":
        ok = ~_any(low, SKIP_ENGINE) & (F.substring_index(low, "?", 1).rlike(r"\.(jpg|jpeg|png|webp)") | low.contains("image") | low.contains("img"))
    else:
        ok = ~_any(low, SKIP_DOWNLOAD) & (low.rlike(r"\.(jpg|jpeg|png|webp|gif)") | url.startswith("data:image") | low.contains("image"))
    return F.coalesce(ok & (url != ""), F.lit(False))


def is_junk_element(url: Column, classes: Column) -> Column:
    """Site furniture by address or class: key words, ad routes, vector images, and gif or inline data without a raster ending."""
    low, own = F.lower(url), F.lower(F.array_join(F.coalesce(classes, F.array().cast("array<string>")), " "))
    bare = F.substring_index(low, "?", 1)
    odd = ~bare.rlike(r"\.(jpg|jpeg|png|webp)") & (low.contains(".gif") | low.contains("base64"))
    return F.coalesce(_any(low, JUNK_WORDS) | _any(own, JUNK_WORDS) | _any(low, AD_MARKS) | bare.endswith(".svg") | low.contains("image/svg+xml") | odd, F.lit(False))


def candidate_size_ok(width: Column, height: Column, url: Column) -> Column:
    """A side of 900, or both of 600, else a rendition of width 700 named in the address."""
    named = F.regexp_extract(F.lower(url), "type=w([0-9]+)", 1).try_cast("int")
    return F.coalesce((F.greatest(width, height) >= 900) | ((width >= 600) & (height >= 600)), F.lit(False)) | F.coalesce(named >= 700, F.lit(False))


def queue_address(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(~trimmed.rlike("^https?://"), F.concat(F.lit("https://"), trimmed)).otherwise(trimmed)


def queue_valid(text: Column) -> Column:
    address = queue_address(text)
    return address.contains(".") & ~address.contains(" ")


def pick_src(attrs: Column, names: Sequence[str] = ("data-src", "data-lazy-src", "data-original")) -> Column:
    """The first non-blank of the lazy attributes, then ``src``, then the last candidate of ``srcset``; inline gifs do not count."""
    found = [F.nullif(F.trim(F.try_element_at(attrs, F.lit(n))), F.lit("")) for n in (*names, "src")]
    found = [F.when(~x.startswith("data:image/gif"), x) for x in found]
    last = F.get(F.reverse(F.split(F.try_element_at(attrs, F.lit("srcset")), ",")), F.lit(0))
    return F.coalesce(*found, F.nullif(F.substring_index(F.trim(last), " ", 1), F.lit("")))


def element_score(tag: str, classes: Column, id: Column, attrs: Column, parent_classes: Column, depth: Column, idx: Column, total: Column) -> Column:
    """Points for looking like a page of a reader: fixed weights by class, id, lazy loading, reader marks, size, parent, depth and place."""
    own = F.lower(F.array_join(classes, " "))
    above = F.lower(F.array_join(parent_classes, " "))
    has = lambda n: F.map_contains_key(attrs, n)
    full = lambda n: F.coalesce(F.try_element_at(attrs, F.lit(n)) != "", F.lit(False))
    big = (F.try_element_at(attrs, F.lit("width")).try_cast("int") >= 400) & (F.try_element_at(attrs, F.lit("height")).try_cast("int") >= 600)
    place = idx / F.greatest(total, F.lit(1))
    points = [
        (_any(own, ("chapter-img", "page", "manga", "reading", "content-img", "wp-manga")), 40), (_any(F.lower(id), ("image", "page")), 20), (full("data-src") | full("data-lazy-src"), 30),
        (has("data-reader-page-image"), 80), (has("data-reader-index"), 40), (big, 25), (_any(above, ("reader", "chapter", "page")), 30), (depth > 5, 10), ((place > 0.1) & (place < 0.9), 10),
    ]
    return sum((F.when(F.coalesce(rule, F.lit(False)), n).otherwise(0) for rule, n in points), F.lit(0))


def expand_template(url: Column, count: int) -> Column:
    """``{chapter}`` counted from 1, or the number at the end counted on with its zeros; array of addresses."""
    mark = F.lit("{chapter}")
    ranged = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.replace(url, mark, k.cast("string")))
    stem, digits = F.regexp_extract(url, r"^(.*?)([0-9]+)/?$", 1), F.regexp_extract(url, r"^(.*?)([0-9]+)/?$", 2)
    counted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.concat(stem, F.lpad((digits.try_cast("long") + k).cast("string"), F.greatest(F.length(digits), F.length((digits.try_cast("long") + k).cast("string"))), F.lit("0"))))
    return F.when(url.contains("{chapter}"), ranged).when(digits != "", counted).otherwise(F.array(url))

"""Items of feeds as columns: addresses of their own, dates that can be, links, feeds that a page names, digests in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text

# Where sites keep feeds that their pages do not name.
COMMON_FEED_PATHS = ["/feed", "/feed/", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/index.xml", "/feeds/posts/default", "/blog/feed", "/feed/atom"]


def absolute(href: Column, page: Column) -> Column:
    """A link of a page as a whole address: whole, without scheme, from the site's root, or beside the page. Null for other schemes."""
    site = F.regexp_extract(page, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.concat(site, F.regexp_extract(page, r"^[a-zA-Z]+://[^/?#]+(/(?:[^?#]*/)?)", 1))
    beside = F.concat(F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder), href)
    return (
        F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(page, "^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(site, href)).when(~href.rlike("^(#|[a-zA-Z][a-zA-Z0-9+.-]*:)"), beside)
    )


def links(html: Column, page: Column) -> Column:
    """Distinct canonical addresses that a page links to, in order."""
    hrefs = F.regexp_extract_all(html, F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(hrefs, lambda h: text.canonical_url(absolute(h, page)))))


def named_feeds(html: Column, page: Column) -> Column:
    """Feeds that a page's head names as alternates of itself."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    feed = lambda t: t.rlike("(?i)rel=[\"']?alternate") & t.rlike(r"(?i)type=[\"']?application/(rss|atom|feed)\+?(xml|json)") & t.rlike("(?i)href=[\"'][^\"']")
    return F.transform(F.filter(tags, feed), lambda t: absolute(F.regexp_extract(t, "(?i)href=[\"']([^\"']+)[\"']", 1), page))


def feed_candidates(html: Column, page: Column) -> Column:
    """Addresses to try for a site's feed: those that its page names, then the common places."""
    site = F.regexp_extract(page, r"^([a-zA-Z]+://[^/?#]+)", 1)
    return F.array_distinct(F.concat(named_feeds(html, page), F.array(*[F.concat(site, F.lit(p)) for p in COMMON_FEED_PATHS])))


def item_addresses(items: DataFrame) -> DataFrame:
    """Items (feed, feed_url, link, guid) with `url` and `listing`: an address of its own for every item of a feed.

    A link that only one item of the feed has, and that is not the feed's own, is the address. Else the link with its fragment if that is unique, the guid
    if it is an address, its fragment kept, the link with the guid as a fragment, or null. `listing` says that the link was no page of its own.
    """
    bare = lambda u: F.regexp_replace(F.regexp_replace(u, r"^https?://(www\.)?", ""), "/+$", "")
    link = text.canonical_url(F.col("link"))
    fragment = F.regexp_extract(F.trim("link"), "(?s)^[^#]+(#.*)$", 1)
    rows = items.withColumns({"_link": link, "_framed": F.concat(link, fragment), "_guid": F.nullif(F.trim("guid"), F.lit(""))})
    alike = lambda c: F.count(c).over(Window.partitionBy("feed", c))
    rows = rows.withColumns({"_n": alike("_link"), "_m": alike("_framed")})
    own = F.col("_link").isNotNull() & ~F.coalesce(bare(F.col("_link")) == bare(F.col("feed_url")), F.lit(False)) & (F.col("_n") == 1)
    framed = (F.col("_framed") != F.col("_link")) & (F.col("_m") == 1)
    guid_hash = F.regexp_extract("_guid", "(?s)^[^#]*(#.*)$", 1)
    guid_url = F.when(F.col("_guid").rlike("(?i)^https?://"), F.concat(text.canonical_url(F.col("_guid")), guid_hash))
    hung = F.concat("_link", F.lit("#"), F.replace(F.url_encode("_guid"), F.lit("+"), F.lit("%20")))
    url = F.when(own, F.col("_link")).when(framed, F.col("_framed")).when(F.col("_guid").isNull(), F.coalesce("_framed", "_link")).otherwise(F.coalesce(guid_url, hung))
    return rows.withColumns({"url": url, "listing": ~own}).drop("_link", "_framed", "_guid", "_n", "_m")


def published(claimed: Column, now: Column) -> Column:
    """The time that an item claims, null where it cannot be read or cannot be."""
    return dates.sane_time(F.try_to_timestamp(claimed).cast("timestamp_ntz"), now)


def digest_parts(digests: DataFrame, heading: str) -> DataFrame:
    """(id, no, title, body) of digests (id, html): one item for each heading of the given class, with the text up to the next; a digest without one is a single item without title."""
    opening = rf"(?is)<h[1-6][^>]*class=[\"'][^\"']*\b{heading}\b[^\"']*[\"'][^>]*>"
    pieces = F.split("html", opening)
    parts = digests.select("id", F.posexplode(F.when(F.size(pieces) > 1, F.slice(pieces, F.lit(2), F.size(pieces))).otherwise(pieces)).alias("no", "piece"), (F.size(pieces) > 1).alias("split"))
    title = F.when(F.col("split"), text.strip_html(F.regexp_extract("piece", "(?is)^(.*?)</h[1-6]>", 1)))
    return parts.select("id", "no", title.alias("title"), text.strip_html(F.regexp_replace("piece", F.when(F.col("split"), "(?is)^.*?</h[1-6]>").otherwise(F.lit("^$")), F.lit(""))).alias("body"))


def page_metadata(html: Column) -> dict[str, Column]:
    """What a page says of itself: title, author, canonical address and time of publication, from its meta tags and links; null where it says nothing."""

    def meta(name: str) -> Column:
        one = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
        other = F.regexp_extract(html, rf"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:name|property)=[\"']{name}[\"']", 1)
        return F.coalesce(F.nullif(one, F.lit("")), F.nullif(other, F.lit("")))

    canonical = F.regexp_extract(html, "(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)[\"']", 1)
    head = F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return {"title": F.coalesce(meta("og:title"), head), "author": meta("author"), "canonical": F.nullif(canonical, F.lit("")), "published": meta("article:published_time")}

"""Registered queries of sources: feeds, their items' addresses and dates, links, metadata, and relations from arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import joins
from tidemark.plans.catalogue import _t, query
from tidemark.sources import digests, feeds, items

_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"


def _bodies(spark, d, kind):
    """Feeds written as text: one for each source and hundred ids of documents, with an item for each id."""
    doc = _t(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string")).alias("feed"), "doc_id")
    i = F.col("doc_id").cast("string")
    part = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    item = {
        "rss": part("<item><title>T", i, " &amp; more</title><guid>g", i, "</guid>", F.when(F.col("doc_id") % 3 > 0, part("<link>https://a.example/", i, "</link>")).otherwise(""), "<description>short</description><content:encoded><![CDATA[<p>long ", i, "</p>]]></content:encoded><dc:date>2024-01-02</dc:date></item>"),
        "atom": part("<entry><title>T", i, "</title><id>g", i, "</id><link rel='self' href='https://a.example/self'/><link href='https://a.example/", i, "'/><updated>2024-01-03</updated><published>2024-01-0", (F.col("doc_id") % 9 + 1).cast("string"), "</published></entry>"),
        "json": part('{"id": "g', i, '", "title": "T', i, '", "url": "https://a.example/', i, '", "date_published": "2024-01-02"}'),
    }[kind]
    ends = {"rss": ("<rss xmlns:content='c' xmlns:dc='d'><channel><title>F</title>", "", "</channel></rss>"), "atom": ("<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title>", "", "</feed>"), "json": ('{"items": [', ",", "]}")}[kind]
    return doc.groupBy("feed").agg(F.concat(F.lit(ends[0]), F.array_join(F.sort_array(F.collect_list(item)), ends[1]), F.lit(ends[2])).alias("body"))


@query("SELECT coalesce(source, 'none') || '-' || (doc_id // 100) AS feed, 'T' || doc_id AS title, 'g' || doc_id AS guid FROM documents")
def s1_json_feeds(spark, d):
    """Items of JSON feeds, beside bodies that are no feed and give nothing."""
    rubbish = spark.createDataFrame([("x", "{"), ("y", "<html/>"), ("z", None)], "feed string, body string")
    return feeds.parse_feeds(_bodies(spark, d, "json").unionByName(rubbish)).select("feed", "title", "guid")


@query("SELECT coalesce(source, 'none') || '-' || (doc_id // 100) AS feed, 'T' || doc_id || ' & more' AS title, CASE WHEN doc_id % 3 > 0 THEN 'https://a.example/' || doc_id ELSE 'g' || doc_id END AS link, '<p>long ' || doc_id || '</p>' AS summary, '2024-01-02' AS published FROM documents")
def s2_rss_items(spark, d):
    """Items of RSS: the encoded content before the description, the guid where a link is missing, dc:date where there is no pubDate."""
    return feeds.parse_feeds(_bodies(spark, d, "rss")).select("feed", "title", "link", "summary", "published")


@query("SELECT coalesce(source, 'none') || '-' || (doc_id // 100) AS feed, 'T' || doc_id AS title, 'https://a.example/' || doc_id AS link, '2024-01-0' || (doc_id % 9 + 1) AS published FROM documents")
def s3_atom_entries(spark, d):
    """Entries of Atom: the alternate link, publication before the last update."""
    return feeds.parse_feeds(_bodies(spark, d, "atom")).select("feed", "title", "link", "published")


@query("WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1989-12-31 10:00:00' WHEN 1 THEN '2026-01-01 00:00:00' WHEN 2 THEN '2024-03-01 00:30:00' WHEN 3 THEN '2024-03-01 02:00:00' WHEN 4 THEN 'last week' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS claimed FROM events) SELECT event_id, CASE WHEN event_id % 6 IN (2, 5) THEN claimed END AS published FROM e")
def s5_sane_dates(spark, d):
    """Times that items claim as of the first of March 2024: not before 1990, not over an hour ahead."""
    k = F.col("event_id") % 6
    claimed = F.when(k == 0, "1989-12-31 10:00:00").when(k == 1, "2026-01-01 00:00:00").when(k == 2, "2024-03-01 00:30:00").when(k == 3, "2024-03-01 02:00:00").when(k == 4, "last week").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return _t(spark, d, "events").select("event_id", F.date_format(items.published(claimed, F.lit("2024-03-01").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(f"SELECT DISTINCT page_id, 'https://' || {_HOST} || regexp_replace(h, '/$', '') AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"(/[^\"?#]*)\"', 1)) AS h FROM pages) WHERE h NOT LIKE '%//%'")
def s6_outbound_links(spark, d):
    """Distinct canonical links of each page."""
    found = _t(spark, d, "pages").select("page_id", F.explode(items.links(F.col("html"), F.col("url"))).alias("link"))
    return found.filter("link NOT LIKE '%?%'").distinct()


_ITEMS = [("http://f.example/1", "g1"), ("https://f.example/log#a", "g2"), ("https://f.example/log#b", "g3"), ("https://f.example/list", "https://f.example/list#x?y"), ("https://f.example/list", "tok en"), ("https://f.example/feed", None), (None, "https://f.example/own?utm_source=x"), (None, "token")]
_RESOLVED = [("https://f.example/1", False), ("https://f.example/log#a", True), ("https://f.example/log#b", True), ("https://f.example/list#x?y", True), ("https://f.example/list#tok%20en", True), ("https://f.example/feed", True), ("https://f.example/own", True), (None, True)]


@query("WITH r(k, url, listing) AS (VALUES " + ", ".join(f"({k}, {repr(u) if u else 'NULL'}, {str(b).upper()})" for k, (u, b) in enumerate(_RESOLVED)) + ") SELECT p_partkey AS feed, k, url, listing FROM part, r")
def s7_item_addresses(spark, d):
    """An address for each item of feeds whose links are shared, the feed's own or missing."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(link).alias("link"), F.lit(guid).alias("guid")) for k, (link, guid) in enumerate(_ITEMS)]))
    given = _t(spark, d, "part").select(F.col("p_partkey").alias("feed"), F.lit("http://www.f.example/feed/").alias("feed_url"), rows.alias("i")).select("feed", "feed_url", "i.*")
    return items.item_addresses(given).select("feed", "k", "url", "listing")


@query("SELECT page_id, 'https://site' || (page_id % 5) || '.example/' || CASE WHEN page_id % 2 = 0 THEN 'blog/rss' ELSE 'feed' END AS first_try, CASE WHEN page_id % 2 = 0 THEN 12 ELSE 10 END AS tries FROM pages")
def s9_feed_discovery(spark, d):
    """Where to look for a site's feed: what its page names, then common paths."""
    i = F.col("page_id")
    named = F.lit('<link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml" href="rss"><LINK href="//x.example/a" type=application/atom+xml rel=alternate>')
    url = F.concat(F.lit("https://site"), (i % 5).cast("string"), F.lit(".example/blog/index.html"))
    tries = items.feed_candidates(F.when(i % 2 == 0, named).otherwise(F.lit("<html>")), url)
    return _t(spark, d, "pages").select("page_id", F.element_at(tries, 1).alias("first_try"), F.size(tries).alias("tries"))


_BLOCK = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
_SAID = f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({{}}, '(?i)</?(?:{_BLOCK})(?:[ /][^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"""
WITH h AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS html FROM pages),
s AS (SELECT page_id, url, unnest(string_split_regex(html, '<h1>')[2:]) AS piece FROM h),
t AS (SELECT page_id, url, {_SAID.format("string_split(piece, '</h1>')[1]")} AS title, {_SAID.format("array_to_string(string_split(piece, '</h1>')[2:], '')")} AS body FROM s)
SELECT page_id, 0 AS no, title, md5(body) AS body_md5, string_split(url, '#')[1] || CASE WHEN contains(string_split(url, '#')[1], '?') THEN '&' ELSE '?' END || 'item=' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS link
FROM t WHERE title <> '' AND body <> ''
""")
def s12_digest_parts(spark, d):
    """The items of every page, by a table function; a page's headings are its items' titles."""
    return digests.digest_items(spark, _t(spark, d, "pages"), "h1").select("page_id", "no", "title", F.md5("body").alias("body_md5"), "link")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'OG ' || page_id ELSE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) END AS title, CASE WHEN page_id % 3 = 0 THEN 'Ann' END AS author, CASE WHEN page_id % 2 = 0 THEN 'https://c.example/' || page_id END AS canonical FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''")
def s15_metadata_tags(spark, d):
    """What pages say of themselves in meta tags, else their title element."""
    i = F.col("page_id")
    tags = F.concat(F.when(i % 2 == 0, F.concat(F.lit('<meta property="og:title" content="OG '), i.cast("string"), F.lit('"><link rel="canonical" href="https://c.example/'), i.cast("string"), F.lit('">'))).otherwise(""), F.when(i % 3 == 0, '<META content="Ann" name="author"/>').otherwise(""))
    found = items.page_metadata(F.concat(tags, "html"))
    return _t(spark, d, "pages").filter(F.regexp_extract("html", "<title>([^<]*)</title>", 1) != "").select("page_id", *[F.trim(found[c]).alias(c) for c in ("title", "author", "canonical")])


@query("WITH a AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p, list(l_suppkey ORDER BY l_linenumber, l_partkey) AS s FROM lineitem GROUP BY 1) SELECT k, unnest(p) AS part, unnest(s) AS supplier FROM a")
def s17_parallel_arrays(spark, d):
    """Arrays that belong together, as rows."""
    both = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    a = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(both["l_partkey"].alias("part"), both["l_suppkey"].alias("supplier"))
    return joins.zipped(a, ["k"], ["part", "supplier"])


@query("SELECT o_orderkey, o_orderstatus AS state, o_custkey AS n FROM orders UNION ALL SELECT o_orderkey, 'x', NULL FROM orders WHERE o_orderkey % 2 = 0")
def s18_json_records(spark, d):
    """Records of a JSON array, as rows; what a record lacks is null, and what is no array gives none."""
    one = F.to_json(F.struct(F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("n")))
    body = F.concat(F.lit("["), one, F.when(F.col("o_orderkey") % 2 == 0, ', {"state": "x", "other": 1}').otherwise(""), F.lit("]"))
    given = _t(spark, d, "orders").select("o_orderkey", body.alias("body")).unionByName(spark.createDataFrame([(-1, "nothing"), (-2, None)], "o_orderkey long, body string"))
    return joins.records(given, "body", "state string, n long")


@query("WITH j AS (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'seen' ELSE 'kept' END AS name, (props->>'k')::BIGINT AS v FROM events) SELECT event_type, name, sum(v)::BIGINT AS total FROM j GROUP BY 1, 2 UNION ALL SELECT event_type, 'all', count(*) FROM events GROUP BY 1")
def s19_unpivoted_counters(spark, d):
    """Counters kept as JSON objects, a row for each key, summed by key."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"'), F.when(F.col("event_id") % 2 == 0, "seen").otherwise("kept"), F.lit('": '), k, F.lit(', "all": 1}'))
    return joins.unpivoted(_t(spark, d, "events").select("event_type", body.alias("body")), "body").groupBy("event_type", "name").agg(F.sum("value").alias("total"))


@query("SELECT unnest(generate_series(min(date_trunc('week', o_orderdate))::DATE, max(o_orderdate)::DATE, INTERVAL 7 DAY))::DATE AS week FROM orders", date="week")
def s20_calendar(spark, d):
    """Every Monday from the week of the first order to the last, whether or not anything was ordered."""
    return dates.calendar_of(_t(spark, d, "orders"), "o_orderdate", "week", "7 days")


@query("SELECT slug, place, count(p_partkey) AS n FROM (VALUES ('ring', 1), ('bolt', 2), ('nothing', 3)) f(slug, place) LEFT JOIN part ON ends_with(p_name, ' ' || slug) GROUP BY 1, 2")
def s21_literal_relation(spark, d):
    """A relation given as values, each with what it counts, none with 0."""
    given = spark.sql("SELECT * FROM VALUES ('ring', 1), ('bolt', 2), ('nothing', 3) AS f(slug, place)")
    last = _t(spark, d, "part").select(F.substring_index("p_name", " ", -1).alias("slug"))
    return joins.counted(given, last, "slug", "n")


@query("WITH v AS (SELECT lower(p_brand) AS slug, min(p_name) AS name, 1 AS origin FROM part GROUP BY 1 UNION ALL SELECT 'brand#' || (s_suppkey % 40), min(s_name), 2 FROM supplier GROUP BY 1) SELECT slug, arg_min(name, origin) AS name, min(origin) AS origin, count(*) AS given FROM v GROUP BY 1")
def s22_vocabulary_import(spark, d):
    """Two vocabularies united by slug: the first one's name stands, as its lists are the better kept."""
    a = _t(spark, d, "part").groupBy(F.lower("p_brand").alias("slug")).agg(F.min("p_name").alias("name"))
    b = _t(spark, d, "supplier").groupBy(F.concat(F.lit("brand#"), (F.col("s_suppkey") % 40).cast("string")).alias("slug")).agg(F.min("s_name").alias("name"))
    return joins.united([a, b], "slug", "name")

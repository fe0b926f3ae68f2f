"""Registered queries of the reader's filter language, a query for each clause, over stories made of orders and their line items.

A story is an order: its tags are the brands of its parts, its companies and platforms come from its line items, and what the
tables lack (judgements, language, dismissal) follows from its number, so that every case occurs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import filters, hierarchy, keyed
from tidemark.operators.filters import Filters, Reader
from tidemark.operators.tables import shared_folder
from tidemark.plans.catalogue import _t, query

AS_OF = "2001-08-01"


_written: dict = {}


def _once(spark, d, name, build):
    """A table that a session writes once to the shared folder and reads from then on."""
    key = spark.sparkContext.applicationId, d, name
    path = _written.get(key)
    there = path and spark._jvm.org.apache.hadoop.fs.Path(path)
    if not path or not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        path = _written[key] = f"{shared_folder(spark, name)}/{name}"
        build(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def stories(spark, d):
    """The stories as a warehouse holds them: a table, written once a session, with the places of their tags in the taxonomy."""
    return _once(spark, d, "stories", _stories)


def labels(spark, d):
    return _once(spark, d, "labels", lambda spark, d: hierarchy.labels(taxonomy(spark, d)))


def _stories(spark, d):
    """Line items move once to their parts and once to their orders, as bare rows: every set is collected where an order's rows have met."""
    given, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    n = keyed.portions(given)
    items = keyed.dealt(given.select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey", "l_returnflag"), n, "l_partkey")
    items = items.join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey").drop("l_partkey")
    items = items.repartition(n, "id") if n else items.repartition("id")
    items = items.join(F.broadcast(labels(spark, d).select(F.col("slug").alias("p_brand"), "lo")), "p_brand", "left")  # a row for each entry of the vocabulary
    of_order = items.groupBy("id").agg(
        F.sort_array(F.collect_set("p_brand")).alias("tags"), F.sort_array(F.collect_set("lo")).alias("places"), F.collect_set("l_suppkey").alias("carriers"),
        F.sort_array(F.collect_set("l_returnflag")).alias("platforms"), F.min("p_name").alias("title"),
    )
    company = lambda s: F.concat(F.lit("c"), (s % 20).cast("string"))
    of_order = of_order.withColumns({"companies": F.array_sort(F.array_distinct(F.transform("carriers", company))), "coverage": F.size("carriers").cast("long")}).drop("carriers")
    o = keyed.dealt(orders.withColumnRenamed("o_orderkey", "id"), n, "id").join(of_order, "id")
    i = F.col("id")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "launch").when(F.col("o_orderpriority") == "2-HIGH", "release").when(F.col("o_orderpriority") == "3-MEDIUM", "change").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "article")
    title = F.when(i % 6 == 0, F.concat(F.lit("Pricing of the "), "title")).when(i % 6 == 1, F.concat("title", F.lit(" licence change"))).otherwise(F.col("title"))
    return o.select(
        "id", F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("at"), kind.alias("event_kind"), F.when(i % 11 == 0, i - 1).alias("superseded_by"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", i % 4 != 0).alias("is_tech"), F.when(i % 13 == 0, F.col("o_orderdate")).alias("dismissed_at"),
        F.when(i % 7 > 0, i % 10).alias("importance"), F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (i % 3 + 1).cast("int")).alias("lang"),
        F.when(i % 5 == 0, F.concat(F.lit("About the "), "title")).alias("title_en"), (i % 17 == 0).alias("prerelease"), "coverage", "tags", "places", "companies", "platforms", title.alias("title"),
        F.concat(F.lit("https://s"), (F.col("o_custkey") % 50).cast("string"), F.lit(".example/"), i.cast("string")).alias("url"), F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")).alias("country"),
    )


STORIES = """of_order AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT p_brand)) AS tags, list_sort(list(DISTINCT 'c' || (l_suppkey % 20))) AS companies, list_sort(list(DISTINCT l_returnflag)) AS platforms,
  count(DISTINCT l_suppkey) AS coverage, min(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
stories AS (SELECT id, o_custkey AS source, o_orderdate AS "at", CASE o_orderpriority WHEN '1-URGENT' THEN 'launch' WHEN '2-HIGH' THEN 'release' WHEN '3-MEDIUM' THEN 'change' WHEN '4-NOT SPECIFIED' THEN 'article' END AS event_kind,
  CASE WHEN id % 11 = 0 THEN id - 1 END AS superseded_by, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'P' THEN id % 4 <> 0 END AS is_tech, CASE WHEN id % 13 = 0 THEN o_orderdate END AS dismissed_at,
  CASE WHEN id % 7 > 0 THEN id % 10 END AS importance, ['en', 'de', 'fr'][1 + id % 3] AS lang, CASE WHEN id % 5 = 0 THEN 'About the ' || name END AS title_en, id % 17 = 0 AS prerelease, coverage, tags, companies, platforms,
  CASE id % 6 WHEN 0 THEN 'Pricing of the ' || name WHEN 1 THEN name || ' licence change' ELSE name END AS title, 'https://s' || (o_custkey % 50) || '.example/' || id AS url, 'N' || (o_custkey % 25) AS country
  FROM orders JOIN of_order ON o_orderkey = id)"""


def taxonomy(spark, d):
    """Brands under five makers, three of which are under one root; kind and category follow from a brand's number."""
    b = _t(spark, d, "part").select("p_brand").distinct().withColumn("k", F.substring("p_brand", 7, 9).cast("int"))
    cat = F.element_at(F.array(*map(F.lit, ("language", "database", "tooling", "cloud"))), F.col("k") % 4 + 1)
    rows = b.select(F.col("p_brand").alias("slug"), F.concat(F.lit("maker"), (F.col("k") % 5).cast("string")).alias("parent"), cat.alias("category"), F.when(F.col("k") % 2 == 0, "tool").otherwise("stack").alias("kind"))
    upper = spark.createDataFrame([(f"maker{i}", "all" if i < 3 else None, "field", "concept") for i in range(5)] + [("all", None, "field", "concept")], "slug string, parent string, category string, kind string")
    return rows.unionByName(upper)


TAXONOMY = """tax AS (SELECT DISTINCT p_brand AS slug, 'maker' || (substr(p_brand, 7)::INT % 5) AS parent, ['language', 'database', 'tooling', 'cloud'][1 + substr(p_brand, 7)::INT % 4] AS category,
  CASE WHEN substr(p_brand, 7)::INT % 2 = 0 THEN 'tool' ELSE 'stack' END AS kind FROM part
  UNION ALL SELECT 'maker' || i, CASE WHEN i < 3 THEN 'all' END, 'field', 'concept' FROM range(5) r(i) UNION ALL SELECT 'all', NULL, 'field', 'concept')"""


def reader(spark, d, **tables) -> Reader:
    return Reader(AS_OF, **tables)


def mentions(spark, d):
    """(slug, at) of stories' tags; a brand's begin three months after those of the one before it, so that some are new."""
    found = stories(spark, d).select(F.explode("tags").alias("slug"), "at")
    return found.filter(F.col("at") >= F.add_months(F.lit("1995-01-01").cast("date"), 3 * F.substring("slug", 7, 9).cast("int")).cast("timestamp_ntz"))


def first_months(found):
    return found.groupBy("slug").agg(F.trunc(F.min("at"), "MM").alias("first_month"))


def frequencies(found):
    return found.groupBy("slug").agg(F.count("*").alias("stories"))


_TOTALS = """totals AS (SELECT slug, date_trunc('month', min("at"))::DATE AS first_month, count(*) AS stories FROM (SELECT unnest(tags) AS slug, "at" FROM stories)
  WHERE "at" >= TIMESTAMP '1995-01-01' + to_months(3 * substr(slug, 7)::INT) GROUP BY 1)"""
_S = f"WITH {STORIES}"
_ids = lambda df: df.select("id")


@query(f"{_S} SELECT id FROM stories WHERE superseded_by IS NULL AND coalesce(is_tech, TRUE) AND dismissed_at IS NULL")
def f1_live(spark, d):
    return _ids(stories(spark, d).filter(filters.live()))


@query(f"{_S} SELECT id, event_kind FROM stories WHERE event_kind IS NULL OR event_kind <> 'article'")
def f3_event_kinds(spark, d):
    return stories(spark, d).filter(filters.of_kinds()).select("id", "event_kind")


@query(f"{_S} SELECT id FROM stories WHERE event_kind IS DISTINCT FROM 'release' OR len(list_intersect(tags, ['Brand#1', 'Brand#6', 'Brand#11', 'Brand#16', 'Brand#21', 'Brand#7'])) > 0")
def f4_tracked_releases(spark, d):
    """Releases of one maker's brands and of one brand; of all else everything."""
    return _ids(filters.tracked_releases(stories(spark, d), ("maker1", "Brand#7"), reader(spark, d, labels=labels(spark, d))))


@query(f"{_S}, {_TOTALS} SELECT id FROM stories WHERE id IN (SELECT id FROM (SELECT id, unnest(tags) AS t FROM stories) WHERE t IN (SELECT slug FROM totals WHERE first_month >= DATE '2000-11-01'))")
def f5_newcomers(spark, d):
    """Stories with a tag first seen since two months before January 2001."""
    return _ids(filters.fresh(stories(spark, d), 2, Reader("2001-01-15", first_month=first_months(mentions(spark, d)))))


@query(f"{_S} SELECT id, lang FROM stories WHERE lang = 'en' OR title_en IS NOT NULL")
def f6_in_english(spark, d):
    return stories(spark, d).filter(filters.in_english()).select("id", "lang")


@query(f"{_S} SELECT id FROM stories WHERE contains(' ' || lower(coalesce(title_en, title)) || ' ', ' cold ') AND contains(' ' || lower(coalesce(title_en, title)) || ' ', ' widget ') OR contains(lower(coalesce(title_en, title)), 'cold widget') OR contains(lower(url), 'cold widget')")
def f7_text(spark, d):
    return _ids(stories(spark, d).filter(filters.with_text("Cold Widget")))


@query(f"{_S} SELECT id FROM stories WHERE regexp_matches(coalesce(title_en, title), '(?i)\\bpricing\\b|licen[cs]e')")
def f8_money_lens(spark, d):
    return _ids(stories(spark, d).filter(filters.money_lens(("cost", "licence"))))


@query(f"{_S} SELECT id, country FROM stories WHERE superseded_by IS NULL AND coalesce(is_tech, TRUE) AND dismissed_at IS NULL AND (event_kind IS NULL OR event_kind <> 'article') AND (lang = 'en' OR title_en IS NOT NULL) AND country IN ('N3', 'N7')")
def f9_countries(spark, d):
    return filters.where(stories(spark, d), Filters(country=("N3", "N7")), reader(spark, d)).select("id", "country")


@query(f"WITH RECURSIVE {STORIES}, {TAXONOMY}, down AS (SELECT slug FROM tax WHERE slug IN ('all', 'Brand#4') UNION SELECT t.slug FROM tax t JOIN down ON t.parent = down.slug) SELECT id FROM stories WHERE id IN (SELECT id FROM (SELECT id, unnest(tags) AS t FROM stories) WHERE t IN (SELECT slug FROM down))")
def f10_under_tags(spark, d):
    """Stories under a root two levels up, or of one brand, or of an unknown name."""
    return _ids(filters.under(stories(spark, d), ("all", "Brand#4", "nothing"), reader(spark, d, labels=labels(spark, d))))


@query(f"{_S}, {TAXONOMY} SELECT id FROM stories WHERE id IN (SELECT id FROM (SELECT id, unnest(tags) AS t FROM stories) WHERE t IN (SELECT slug FROM tax WHERE category = 'database'))")
def f11_categories(spark, d):
    return _ids(filters.holding(stories(spark, d), "tags", taxonomy(spark, d).filter("category = 'database'").select("slug")))


@query(f"{_S}, {TAXONOMY} SELECT id FROM stories WHERE id IN (SELECT id FROM (SELECT id, unnest(tags) AS t FROM stories) WHERE t IN (SELECT slug FROM tax WHERE kind = 'tool'))")
def f13_about_tools(spark, d):
    return _ids(filters.about(stories(spark, d), "tool", reader(spark, d, taxonomy=taxonomy(spark, d))))


@query(f"{_S} SELECT id FROM stories WHERE list_has_any(companies, ['c3', 'c11']) AND list_has_any(platforms, ['R']) AND len(list_filter(companies, lambda c: substr(c, 2)::INT % 3 = 0)) > 0")
def f14_companies_and_platforms(spark, d):
    """Of two companies and one platform, with a company of a category that joins through the companies' own table."""
    s = filters.overlapping(filters.overlapping(stories(spark, d), "companies", ("c3", "c11")), "platforms", ("R",))
    owners = _t(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("k")).distinct()
    return _ids(filters.holding(s, "companies", owners.filter("k % 3 = 0").select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("slug"))))


@query(f"{_S} SELECT id, coverage, importance FROM stories WHERE superseded_by IS NULL AND coalesce(is_tech, TRUE) AND dismissed_at IS NULL AND (event_kind IS NULL OR event_kind <> 'article') AND (lang = 'en' OR title_en IS NOT NULL) AND coverage <= 3 AND importance >= 5")
def f15_coverage_and_importance(spark, d):
    return filters.where(stories(spark, d), Filters(coverage=3, least=5), reader(spark, d)).select("id", "coverage", "importance")


@query(f"{_S} SELECT id FROM stories WHERE superseded_by IS NULL AND coalesce(is_tech, TRUE) AND dismissed_at IS NULL AND (event_kind IS NULL OR event_kind <> 'article') AND (lang = 'en' OR title_en IS NOT NULL) AND \"at\" > TIMESTAMP '2001-08-01' - INTERVAL 30 DAY")
def f17_last_days(spark, d):
    return _ids(filters.where(stories(spark, d), Filters(days=30), reader(spark, d)))


@query(f"{_S}, {TAXONOMY}, {_TOTALS} SELECT id FROM stories WHERE superseded_by IS NULL AND coalesce(is_tech, TRUE) AND dismissed_at IS NULL AND (event_kind IN ('launch', 'change') OR event_kind IS NULL) AND (lang = 'en' OR title_en IS NOT NULL) AND NOT prerelease AND \"at\" >= TIMESTAMP '1996-01-01' AND \"at\" < TIMESTAMP '2000-01-02' AND list_has_any(companies, ['c1', 'c2']) AND regexp_matches(coalesce(title_en, title), '(?i)\\bpricing\\b') AND id IN (SELECT id FROM (SELECT id, unnest(tags) AS t FROM stories) WHERE t IN (SELECT slug FROM tax WHERE category IN ('cloud', 'tooling'))) AND id IN (SELECT id FROM (SELECT id, unnest(tags) AS t FROM stories) WHERE t IN (SELECT slug FROM totals WHERE stories <= (SELECT median(stories) FROM totals)))")
def f25_from_query_string(spark, d):
    """A query string, parsed and applied whole; values outside the vocabularies fall away."""
    counts = frequencies(mentions(spark, d))
    half = counts.agg(F.median("stories")).first()[0] or 0
    f = filters.parse(f"?stream=news&kind=launch&kind=change&kind=party&start=1996-01-01&end=2000-01-01&company=c1&company=c2&money=cost&money=luck&category=cloud&category=tooling&rare={int(half)}&days=soon")
    return _ids(filters.where(stories(spark, d), f, reader(spark, d, taxonomy=taxonomy(spark, d), frequency=counts)))


@query("WITH l AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN [200, 204, 301, 401, 403, 404, 410, 429, 503][1 + event_id % 9] END AS status, 'https://a' || (user_id % 3) || '.example/x' AS asked, CASE WHEN event_id % 4 > 0 THEN 'https://a' || (event_id % 3) || '.example/y' END AS arrived FROM events) SELECT event_id, CASE WHEN status IS NULL THEN 'unreachable' WHEN status < 300 THEN 'ok' WHEN status IN (401, 403) THEN 'blocked' WHEN status = 404 THEN 'missing' WHEN status >= 500 THEN 'erroring' ELSE 'odd' END AS state, coalesce(split_part(split_part(asked, '://', 2), '/', 1) <> split_part(split_part(arrived, '://', 2), '/', 1), FALSE) AS moved FROM l")
def f26_link_states(spark, d):
    i = F.col("event_id")
    status = F.when(i % 9 > 0, F.element_at(F.array(*map(F.lit, (200, 204, 301, 401, 403, 404, 410, 429, 503))), (i % 9 + 1).cast("int")))
    at = lambda n, end: F.concat(F.lit("https://a"), (n % 3).cast("string"), F.lit(f".example/{end}"))
    return _t(spark, d, "events").select("event_id", filters.link_state(status).alias("state"), filters.link_moved(at(F.col("user_id"), "x"), F.when(i % 4 > 0, at(i, "y"))).alias("moved"))


@query(f"{_S}, {_TOTALS}, k AS (SELECT id, max(first_month) AS key FROM (SELECT id, unnest(tags) AS slug FROM stories) JOIN totals USING (slug) GROUP BY 1) SELECT id, row_number() OVER (ORDER BY key DESC NULLS LAST, \"at\" DESC, id) AS place FROM stories LEFT JOIN k USING (id) QUALIFY place <= 100")
def o2_newest_tags_first(spark, d):
    """The hundred stories about the newest tags, numbered in the order of the page."""
    return _numbered(spark, d, "firstseen")


def _numbered(spark, d, name, first=100):
    s = mentions(spark, d)
    r = reader(spark, d, first_month=first_months(s), frequency=frequencies(s))
    got = filters.page(stories(spark, d), Filters(sort=name), r, first)
    keyed, keys = filters.ordering(got.drop("_key"), name, r)  # a hundred rows at most
    return keyed.select("id", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))


@query(f"{_S} SELECT id, row_number() OVER (ORDER BY importance DESC NULLS LAST, \"at\" DESC, id) AS place FROM stories QUALIFY place <= 100")
def o1_by_importance(spark, d):
    return _numbered(spark, d, "importance")


@query(f"{_S} SELECT id, row_number() OVER (ORDER BY coverage DESC NULLS LAST, \"at\" DESC, id) AS place FROM stories QUALIFY place BETWEEN 21 AND 40")
def o5_second_page(spark, d):
    """The second page of the most covered stories."""
    s = filters.page(stories(spark, d), Filters(sort="coverage", offset=20), reader(spark, d))
    _, keys = filters.ordering(s, "coverage", reader(spark, d))
    return s.select("id", (F.row_number().over(Window.orderBy(*keys)) + 20).cast("long").alias("place"))


@query(f"{_S} SELECT 'low' AS side, id, importance FROM (SELECT * FROM stories ORDER BY importance ASC NULLS FIRST, id LIMIT 50) UNION ALL SELECT 'high', id, importance FROM (SELECT * FROM stories ORDER BY importance DESC NULLS LAST, id LIMIT 50)")
def o8_null_order(spark, d):
    """Fifty stories from each end of an order that puts unknown values first, and last."""
    s = stories(spark, d).select("id", "importance")
    low, high = F.col("importance").asc_nulls_first(), F.col("importance").desc_nulls_last()
    return s.orderBy(low, "id").limit(50).select(F.lit("low").alias("side"), "*").unionByName(s.orderBy(high, "id").limit(50).select(F.lit("high").alias("side"), "*"))

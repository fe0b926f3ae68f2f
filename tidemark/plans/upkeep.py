"""Registered queries of the registry, reports, entity pages, streams and small helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import gates, text, topic
from tidemark.operators import filters, registry, reports, tallies
from tidemark.operators.filters import Reader
from tidemark.operators.tables import Table, shared_folder
from tidemark.plans.catalogue import _t, query
from tidemark.plans.reader import _TOTALS, STORIES, TAXONOMY, first_months, mentions, stories, taxonomy
from tidemark.streaming import ledger

_S = f"WITH {STORIES}"
_LIVE = "superseded_by IS NULL AND coalesce(is_tech, TRUE) AND dismissed_at IS NULL"


# --- filters beyond the reader's own


@query("SELECT n_nationkey, CASE WHEN n_name LIKE 'NATION_1%' THEN 'prefix' WHEN contains(n_name, '1') THEN 'contains' ELSE 'alias' END AS how FROM nation WHERE contains(n_name, '1') OR n_nationkey % 10 = 5")
def f18_name_match(spark, d):
    """Entries by the start of their name, a part of it, or an alias."""
    n = _t(spark, d, "nation").withColumn("aliases", F.array(F.concat(F.lit("alias"), (F.col("n_nationkey") % 10).cast("string"))))
    how = F.when(F.lower("n_name").startswith("nation_1"), "prefix").when(F.contains("n_name", F.lit("1")), "contains").when(F.exists("aliases", lambda a: F.lower(a) == "alias5"), "alias")
    return n.select("n_nationkey", how.alias("how")).filter("how IS NOT NULL")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')) AND NOT contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'old')")
def f19_keywords(spark, d):
    """Names with one of the keywords and none of the excluded terms, both given as arrays of patterns."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.ilike(F.col("p_name"), F.concat(F.lit("%"), w, F.lit("%"))))
    return _t(spark, d, "part").filter(has(["RING", "bolt"]) & ~has(["red", "OLD"])).select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_shipdate > TIMESTAMP '2001-11-01')")
def f22_silent_sources(spark, d):
    """Sources that have produced nothing of late."""
    seen = _t(spark, d, "lineitem").filter("l_shipdate > TIMESTAMP_NTZ '2001-11-01'").select(F.col("l_suppkey").alias("s_suppkey"))
    return _t(spark, d, "supplier").select("s_suppkey").join(seen, "s_suppkey", "left_anti")


@query("WITH x AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS k FROM orders) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM x WHERE k IS NOT NULL)")
def f23_not_in(spark, d):
    """NOT IN over a set with unknown values, which say nothing: without the guard nothing would be left."""
    x = _t(spark, d, "orders").select(F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("c_custkey")).filter("c_custkey IS NOT NULL")
    return _t(spark, d, "customer").select("c_custkey").join(x, "c_custkey", "left_anti")


@query("SELECT o_orderkey, md5('7:' || o_orderkey) AS place FROM orders ORDER BY place LIMIT 50")
def o10_random_sample(spark, d):
    """A random sample of fifty rows, the feature, in an order that a seed and the key give: each task keeps its fifty first, and nothing is sorted whole."""
    return _t(spark, d, "orders").select("o_orderkey", F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))).alias("place")).orderBy("place").limit(50)


# --- pages of entries


@query(f"{_S}, {TAXONOMY}, {_TOTALS} SELECT slug, count(*) AS n, strftime(first_month, '%Y-%m') AS first_seen FROM (SELECT unnest(tags) AS slug FROM stories WHERE {_LIVE} AND (event_kind IS NULL OR event_kind <> 'article') AND (lang = 'en' OR title_en IS NOT NULL)) JOIN totals USING (slug) JOIN tax USING (slug) WHERE first_month >= DATE '2000-06-01' AND kind IN ('stack', 'tool') GROUP BY slug, first_month")
def q16_new_tags(spark, d):
    """Tags first seen of late, with their stories under the page's own selection."""
    chosen = filters.where(stories(spark, d), filters.Filters(), Reader("2000-08-15")).select(F.explode("tags").alias("slug"))
    new = first_months(mentions(spark, d)).filter(F.col("first_month") >= filters.months_back("2000-08-15", 2)).join(taxonomy(spark, d).filter("kind IN ('stack', 'tool')").select("slug"), "slug", "left_semi")
    return chosen.join(new, "slug").groupBy("slug", "first_month").agg(F.count("*").alias("n")).select("slug", "n", F.date_format("first_month", "yyyy-MM").alias("first_seen"))


@query(f"{_S} SELECT id, list_contains(companies, 'c' || (source % 20)) AS announcement FROM stories")
def q21_announcements(spark, d):
    """Whether a story's publisher is among the companies that it is about."""
    own = F.concat(F.lit("c"), (F.col("source") % 20).cast("string"))
    return stories(spark, d).select("id", F.array_contains("companies", own).alias("announcement"))


_WORDS = "CASE WHEN week > 0 THEN 'hot' WHEN recent > 0 THEN 'active' WHEN last_month >= DATE '2001-05-01' THEN 'quiet' WHEN last_month IS NOT NULL THEN 'dormant' ELSE 'unseen' END"


@query(f"WITH a AS (SELECT l_partkey AS k, count(*) AS stories, count(*) FILTER (l_shipdate > TIMESTAMP '2001-07-25' AND l_shipdate <= TIMESTAMP '2001-08-01') AS week, count(*) FILTER (l_shipdate > TIMESTAMP '2001-07-02' AND l_shipdate <= TIMESTAMP '2001-08-01') AS recent, date_trunc('month', max(l_shipdate) FILTER (l_shipdate <= TIMESTAMP '2001-08-01'))::DATE AS last_month FROM lineitem GROUP BY 1) SELECT p_partkey, coalesce(stories, 0) AS stories, {_WORDS} AS badge, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'ok' END AS state FROM part LEFT JOIN a ON k = p_partkey WHERE p_size % 4 > 0 AND p_type <> 'PROMO'")
def q23_registry(spark, d):
    """Entries with a working address, their stories and how active they are."""
    at = F.col("l_shipdate")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    a = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("stories"), F.count_if((at > day("2001-07-25")) & (at <= day("2001-08-01"))).alias("week"), F.count_if((at > day("2001-07-02")) & (at <= day("2001-08-01"))).alias("recent"), F.trunc(F.max(F.when(at <= day("2001-08-01"), at)), "MM").alias("last_month"))
    e = _t(spark, d, "part").filter("p_type <> 'PROMO'").join(a, "p_partkey", "left").withColumn("state", F.when(F.col("p_size") % 4 > 0, "ok"))
    badge = registry.activity(F.coalesce("week", F.lit(0)), F.coalesce("recent", F.lit(0)), F.col("last_month"), F.lit("2001-08-01").cast("date"))
    return registry.having(e, ["working"]).select("p_partkey", F.coalesce("stories", F.lit(0)).alias("stories"), badge.alias("badge"), "state")


_RUNGS = list(registry.EVIDENCE)
_TYPE = "[" + ", ".join(f"'{t}'" for t in _RUNGS) + "]"
_RUNG = "[" + ", ".join(f"'{r}'" for r, _ in registry.EVIDENCE.values()) + "]"
_INDEPENDENT = "[" + ", ".join(str(i).upper() for _, i in registry.EVIDENCE.values()) + "]"


@query("SELECT s_suppkey, ['PRIMARY_VENDOR', 'COMMUNITY', 'RESEARCH', 'TECHNICAL_JOURNALISM', 'unheard'][1 + s_suppkey % 5] AS type, ['announcement', 'interest', 'announcement', 'production_adoption', NULL][1 + s_suppkey % 5] AS rung, s_suppkey % 5 IN (2, 3) AS independent FROM supplier")
def v22_evidence(spark, d):
    """What a source's type says as evidence."""
    kind = F.element_at(F.array(*map(F.lit, ("PRIMARY_VENDOR", "COMMUNITY", "RESEARCH", "TECHNICAL_JOURNALISM", "unheard"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return _t(spark, d, "supplier").select("s_suppkey", kind.alias("type")).select("s_suppkey", "type", registry.evidence(F.col("type")).alias("e")).select("s_suppkey", "type", "e.rung", "e.independent")


@query(f"{_S}, i AS (SELECT country, source, {_RUNG}[1 + source % 12] AS rung, {_INDEPENDENT}[1 + source % 12] AS independent FROM stories) SELECT country, count(*) AS read, count(*) FILTER (independent) AS independent, count(*) FILTER (NOT independent) AS first_party, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT rung)), ',') AS rungs FROM i GROUP BY 1")
def q32_provenance(spark, d):
    """What was read of each country's stories, by kinds of evidence."""
    kind = F.element_at(F.array(*map(F.lit, _RUNGS)), (F.col("source") % 12 + 1).cast("int"))
    rows = stories(spark, d).select("country", "source", kind.alias("type")).select("country", "source", registry.evidence(F.col("type")).alias("e")).select("country", "source", "e.*")
    return reports.provenance(rows, "country").withColumn("rungs", F.array_join("rungs", ","))


@query(f"{_S}, n AS (SELECT country, unnest(tags) AS subject FROM stories), c AS (SELECT country, subject, count(*) AS n FROM n GROUP BY 1, 2) SELECT country, subject, n, row_number() OVER (PARTITION BY country ORDER BY n DESC, subject) AS place FROM c QUALIFY place <= 5")
def q32_subjects(spark, d):
    return reports.subjects(stories(spark, d), "country", most=5).withColumn("place", F.col("place").cast("long"))


# --- the registry


@query("WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part) SELECT name AS slug, p_partkey AS id FROM part JOIN n ON regexp_matches('The ' || p_name || ', v2', '(^|[^A-Za-z])' || name || '([^A-Za-z]|$)')")
def v1_pattern_join(spark, d):
    """Titles with each name of a table in them, the pattern made of the name."""
    titles = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), "p_name", F.lit(", v2")).alias("title"))
    names = _t(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("slug")).distinct().withColumn("name", F.col("slug"))
    return registry.named_in(titles, names).select("slug", "id")


@query("WITH l AS (SELECT l_suppkey AS k, date_trunc('month', max(l_shipdate) FILTER (l_returnflag = 'A')) AS m, max(l_shipdate) FILTER (l_returnflag = 'R' AND l_tax = 0.01 AND l_discount = 0.01 AND l_quantity < 5) AS t FROM lineitem GROUP BY 1) SELECT s_name AS name, row_number() OVER (ORDER BY greatest(m, t) DESC NULLS LAST, s_name) AS recent, row_number() OVER (ORDER BY CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END, s_name) AS health FROM supplier LEFT JOIN l ON k = s_suppkey QUALIFY recent <= 20")
def v2_platform_orders(spark, d):
    """The twenty most recent platforms, with their place by recency and by the health of their links among all."""
    at = F.col("l_shipdate")
    l = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.date_trunc("month", F.max(F.when(F.col("l_returnflag") == "A", at))).cast("timestamp_ntz").alias("last_month"), F.max(F.when(F.expr("l_returnflag = 'R' AND l_tax = 0.01 AND l_discount = 0.01 AND l_quantity < 5"), at)).alias("latest"))
    k = F.col("s_suppkey") % 4
    p = _t(spark, d, "supplier").join(l, "s_suppkey", "left").withColumnRenamed("s_name", "name").withColumn("state", F.when(k == 1, "ok").when(k == 2, "blocked").when(k == 3, "missing"))
    # a registry has a few thousand entries, so one window over all of them is small
    place = lambda name: F.row_number().over(Window.orderBy(*registry.platform_order(name))).cast("long")
    return p.select("name", place("recent").alias("recent"), place("health").alias("health")).filter("recent <= 20")


@query("SELECT p_partkey AS slug FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 > 0 AND p_partkey % 5 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 30)")
def v4_registry_facets(spark, d):
    """Entries with an address, a working link, aliases and learning material."""
    p = F.col("p_partkey")
    e = _t(spark, d, "part").select(p.alias("slug"), F.when(p % 2 == 0, "https://x.example").alias("address"), F.when(F.col("p_size") % 3 > 0, "ok").otherwise("missing").alias("state"), F.when(p % 5 == 0, F.array("p_name")).alias("aliases"))
    learning = _t(spark, d, "lineitem").filter("l_quantity >= 30").select(F.col("l_partkey").alias("slug")).distinct()
    return registry.having(e, ["address", "working", "aliases", "learning"], learning).select("slug")


@query("WITH t AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT p_type AS origin, count(*) AS n, count(*) FILTER (coalesce(t.n, 0) = 0) AS never_seen FROM part LEFT JOIN t ON k = p_partkey GROUP BY 1")
def v7_registry_growth(spark, d):
    """Entries by where they came from, and how many of them no story has named."""
    t = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("m"))
    return _t(spark, d, "part").join(t, "p_partkey", "left").groupBy(F.col("p_type").alias("origin")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("m", F.lit(0)) == 0).alias("never_seen"))


@query(f"{_S} SELECT id, CASE WHEN id % 26 = 0 THEN NULL WHEN id % 29 = 0 THEN 'now' WHEN dismissed_at IS NOT NULL THEN 'before' END AS dismissed FROM stories")
def v9_dismissals(spark, d):
    """A written table of dismissals after some are restored and others made; every story stays."""
    t = Table(spark, shared_folder(spark, "dismissals"), "lang")
    t.replace(stories(spark, d).select("id", "lang", F.when(F.col("dismissed_at").isNotNull(), "before").alias("dismissed")))
    some = lambda every: t.read().filter(F.col("id") % every == 0).select("id", F.lit(None if every == 26 else "now").cast("string").alias("_to"))
    for every in (29, 26):
        t.update(some(every), ["id"], {"dismissed": F.col("_to")})
    return t.read().select("id", "dismissed")


@query("WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1) SELECT k FROM a WHERE list_has_all(have, ['A', 'R'])")
def v13_contains(spark, d):
    a = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("have"))
    return a.filter(tallies.contains_all(F.col("have"), F.array(F.lit("A"), F.lit("R")))).select("k")


_LONG = "a long enough beginning of the real text of the article itself"


@query("SELECT event_id, ['rubbish', 'furniture', NULL, NULL][1 + event_id % 4] AS why FROM events")
def v17_summary_repairs(spark, d):
    """Stored summaries that should give way to a new extraction, and why."""
    i = F.col("event_id") % 4
    stored = F.when(i == 0, "%%% 12 {} ;; 99 <> ## 0x0 == ||").when(i == 1, F.concat(F.lit("Home 12 News | "), F.lit(_LONG))).when(i == 2, F.lit(_LONG)).otherwise("Something else altogether, in words")
    return _t(spark, d, "events").select("event_id", reports.repair(stored, F.lit(_LONG)).alias("why"))


@query("WITH e AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 > 0 THEN TIMESTAMP '2001-01-01' + to_days(p_size) END AS measured, CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2001-02-01' END AS failed, p_partkey % 20 AS failures FROM part) SELECT k FROM e WHERE (measured IS NULL OR measured < TIMESTAMP '2001-02-03' - INTERVAL 240 HOUR) AND (failed IS NULL OR failed < TIMESTAMP '2001-02-03' - to_hours((least(failures, 12) * 6)::INT))")
def v20_due_for_look(spark, d):
    """Entries that are due for a look, failing ones after a wait that grows."""
    p = F.col("p_partkey")
    e = _t(spark, d, "part").select(p.alias("k"), F.when(F.col("p_size") % 3 > 0, F.lit("2001-01-01").cast("timestamp_ntz") + F.make_interval(days=F.col("p_size"))).alias("measured_at"), F.when(p % 2 == 0, F.lit("2001-02-01").cast("timestamp_ntz")).alias("failed_at"), (p % 20).alias("failures"))
    return registry.due_for_look(e, "2001-02-03", 240).select("k")


# --- reports


@query("WITH r AS (SELECT o_orderdate::DATE AS day, o_orderkey, o_orderpriority AS field FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'), n AS (SELECT day, max(o_orderkey) AS newest FROM r GROUP BY 1), f AS (SELECT day, array_to_string(list(field ORDER BY p, field), ',') AS fields FROM (SELECT DISTINCT day, field, CASE field WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS p FROM r) GROUP BY 1) SELECT day, 'Report ' || newest AS title, fields FROM n JOIN f USING (day)", date="day")
def v24_report_index(spark, d):
    """The newest report of each day with its briefings in the declared order."""
    o = _t(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("generated_at"), F.concat(F.lit("Report "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("field"))
    return reports.index(o, o.select("day", "field"), ["5-LOW", "1-URGENT"]).withColumn("fields", F.array_join("fields", ","))


@query("WITH b AS (SELECT o_orderpriority AS field, o_orderdate::DATE AS day, o_orderkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-01' AND o_orderdate > TIMESTAMP '2001-05-02') SELECT field, day::VARCHAR AS day, 'claim ' || k || '.' || i AS claim, i::INT AS cited FROM b, range(1, 3) r(i)")
def v25_standing_claims(spark, d):
    """What a field's briefings of thirty days claimed, with how much evidence each claim cited."""
    k = F.col("o_orderkey").cast("string")
    claim = lambda i: F.struct(F.concat(F.lit("claim "), k, F.lit(f".{i}")).alias("claim"), F.array(*[F.lit(x) for x in range(i)]).alias("evidence"))
    b = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("field"), F.to_date("o_orderdate").alias("day"), F.array(claim(1), claim(2)).alias("claims"))
    return reports.standing(b, "2001-06-01", 30).withColumn("day", F.col("day").cast("string"))


@query("WITH s AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS market, list_sort(list(DISTINCT o_orderpriority)) AS subjects FROM orders GROUP BY 1) SELECT k, CASE WHEN market >= 2 THEN 'Market moves: ' ELSE '' END || CASE WHEN len(list_filter(subjects, lambda s: s <> '5-LOW')) > 0 THEN replace(array_to_string(list_transform(list_filter(subjects, lambda s: s <> '5-LOW')[1:3], lambda s: CASE s WHEN '1-URGENT' THEN '1 Urgent' WHEN '2-HIGH' THEN '2 High' WHEN '3-MEDIUM' THEN '3 Medium' ELSE '4 Not Specified' END), '|'), '|', ', ') ELSE 'The day' END || ' — ' || n || CASE WHEN n = 1 THEN ' field briefed' ELSE ' fields briefed' END AS title FROM s")
def v26_report_titles(spark, d):
    s = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("market"), F.sort_array(F.collect_set("o_orderpriority")).alias("subjects"))
    return s.select("k", reports.titled(F.col("subjects"), ["5-LOW"], F.col("market"), F.col("n")).alias("title"))


@query("SELECT k AS slug, CASE WHEN k < 5 THEN 'NATION_' || k WHEN k < 10 THEN 'Supplier#' || lpad(k::VARCHAR, 9, '0') WHEN k < 20 THEN 'Customer#' || lpad(k::VARCHAR, 9, '0') END AS name FROM range(30) r(k)")
def v27_display_names(spark, d):
    """Names of slugs, from the first of three tables that has them."""
    n = _t(spark, d, "nation").filter("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("slug"), F.col("n_name").alias("name"))
    s = _t(spark, d, "supplier").filter("s_suppkey < 10").select(F.col("s_suppkey").alias("slug"), F.col("s_name").alias("name"))
    c = _t(spark, d, "customer").filter("c_custkey < 20").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"))
    return registry.display_names(spark.range(30).select(F.col("id").alias("slug")), n, s, c)


@query("WITH i AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderkey, o_orderpriority FROM orders) SELECT k, md5(string_agg('[' || n || '] Story ' || o_orderkey || chr(10) || '    ' || o_orderpriority || chr(10) || '    source: ' || k, chr(10) ORDER BY n)) AS packet, count(*) AS n FROM i GROUP BY 1")
def v28_numbered_packets(spark, d):
    """Each customer's stories as one text, numbered for citation."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_custkey").alias("source"), F.concat(F.lit("Story "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("summary"), "o_orderdate", "o_orderkey")
    return reports.packed(o, "k", ["o_orderdate", "o_orderkey"]).withColumn("packet", F.md5("packet"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Ann''s \"tool\"' WHEN 1 THEN 'plain and more' END AS name, CASE WHEN event_id % 3 < 2 THEN event_id::VARCHAR END AS number FROM events")
def v30_frontmatter(spark, d):
    i, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    t = F.when(i == 0, F.concat(F.lit("---\nname: 'Ann''s \"tool\"'\nnumber: "), n, F.lit("\n---\nbody"))).when(i == 1, F.concat(F.lit("---\nnumber: \""), n, F.lit("\"\nname: plain\n  and more\n---\n"))).otherwise("no front\n---\nname: x\n---")
    return _t(spark, d, "events").select("event_id", reports.frontmatter(t, "name").alias("name"), reports.frontmatter(t, "number").alias("number"))


@query("WITH d AS (SELECT p_partkey AS key, p_size::VARCHAR AS value, CASE WHEN p_partkey % 2 = 0 THEN 'int' ELSE 'bool' END AS kind FROM part), s AS (SELECT p_partkey AS key, CASE p_partkey % 6 WHEN 0 THEN '12' WHEN 1 THEN 'true' WHEN 2 THEN 'many' WHEN 3 THEN 'perhaps' END AS value FROM part WHERE p_partkey % 6 < 5) SELECT key, CASE WHEN key % 6 IN (0, 1) THEN s.value ELSE d.value END AS value, key % 6 IN (0, 1) AS own FROM d LEFT JOIN s USING (key)")
def v31_settings(spark, d):
    """Defaults under what is stored, where that can be read as the setting's kind."""
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    defaults = p.select(k.alias("key"), F.col("p_size").cast("string").alias("value"), F.when(k % 2 == 0, "int").otherwise("bool").alias("kind"))
    stored = p.filter(k % 6 < 5).select(k.alias("key"), F.when(k % 6 == 0, "12").when(k % 6 == 1, "true").when(k % 6 == 2, "many").when(k % 6 == 3, "perhaps").alias("value"))
    return registry.overlaid(defaults, stored).select("key", "value", "own")


@query("SELECT c_custkey, ['1h', '6h', '24h', '7d', 'adhoc'][1 + c_custkey % 5] AS label, TRUE AS near FROM customer")
def v32_labels_and_jitter(spark, d):
    """Labels of offsets, and intervals moved by a tenth at most, of which only the bounds can be held against SQL."""
    h = F.element_at(F.array(*map(F.lit, (1, 6, 24, 168, 5))), (F.col("c_custkey") % 5 + 1).cast("int"))
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ((1, "1h"), (6, "6h"), (24, "24h"), (168, "7d")) for x in pair]), h), F.lit("adhoc"))
    moved = 900 * (F.lit(0.9) + F.rand(3) * 0.2)
    return _t(spark, d, "customer").select("c_custkey", label.alias("label"), moved.between(810, 990).alias("near"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey < 5")
def v33_article_sources(spark, d):
    """Sources that may publish articles: those about technology only, or owned by a company."""
    tech, company = F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment") == "BUILDING"), F.when(F.col("c_nationkey") < 5, F.col("c_nationkey"))
    return _t(spark, d, "customer").filter(F.coalesce(tech, F.lit(False)) | company.isNotNull()).select("c_custkey")


@query("SELECT event_id, event_id % 4 IN (0, 1) AS self_describing FROM events")
def v34_self_describing(spark, d):
    url = F.element_at(F.array(*map(F.lit, ("https://github.com/a/b", "http://www.gist.github.com/x", "https://github.company.example/", "https://notgithub.com/"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", gates.host_in(text.host(url), topic.SELF_DESCRIBING).alias("self_describing"))


@query("WITH b AS (SELECT s_suppkey AS source, ['hn', 'github', 'arxiv'][1 + s_suppkey % 3] AS provider, count(l_orderkey) AS stored, min(l_shipdate)::DATE::VARCHAR AS oldest FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT source, provider, stored, oldest, row_number() OVER (PARTITION BY provider ORDER BY stored DESC, source) AS place FROM b WHERE provider <> 'hn'")
def v36_backfill_targets(spark, d):
    """What can be walked backwards, by provider, the largest first, and how far it has got."""
    b = _t(spark, d, "supplier").join(_t(spark, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy(F.col("s_suppkey").alias("source")).agg(F.count("l_orderkey").alias("stored"), F.min("l_shipdate").cast("date").cast("string").alias("oldest"))
    b = b.withColumn("provider", F.element_at(F.array(F.lit("hn"), F.lit("github"), F.lit("arxiv")), (F.col("source") % 3 + 1).cast("int"))).filter("provider <> 'hn'")
    return b.withColumn("place", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("stored"), "source")).cast("long"))


@query(f"{_S} SELECT company, count(*) AS n FROM (SELECT unnest(companies) AS company FROM stories WHERE superseded_by IS NULL AND \"at\" > TIMESTAMP '2001-07-02') GROUP BY 1 ORDER BY n DESC, company LIMIT 10")
def v37_top_companies(spark, d):
    """The ten companies with most stories in thirty days."""
    s = stories(spark, d).filter(F.col("superseded_by").isNull() & (F.col("at") > F.lit("2001-07-02").cast("timestamp_ntz")))
    return s.select(F.explode("companies").alias("company")).groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(10)


@query("SELECT user_id AS story, label, count(*) AS n FROM (SELECT user_id, ['1h', '6h', '24h', '7d'][1 + event_id % 4] AS label FROM events WHERE event_type = 'click') GROUP BY 1, 2")
def v29_engagement(spark, d):
    """Labelled snapshots of engagement, appended to a table and counted from it."""
    t = Table(spark, shared_folder(spark, "engagement"), "label")
    e = _t(spark, d, "events").filter("event_type = 'click'")
    label = F.element_at(F.array(*map(F.lit, ("1h", "6h", "24h", "7d"))), (F.col("event_id") % 4 + 1).cast("int"))
    for batch in range(2):
        t.append(e.filter(F.col("event_id") % 2 == batch).select(F.col("user_id").alias("story"), "event_id", label.alias("label")))
    return t.read().groupBy("story", "label").agg(F.count("*").alias("n"))


# --- streams


def _stream(spark, d):
    # a pattern, as a stream reads folders only unless it is given one
    return ledger.read_events(spark, f"{d}/events.parque[t]", _t(spark, d, "events").schema)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def z1_micro_batches(spark, d):
    """A stream over all events, each micro-batch appended to a table, which is then summed."""
    folder = shared_folder(spark, "ingest")
    t = Table(spark, f"{folder}/rows", "event_type")
    ledger.run_once(_stream(spark, d), folder, lambda batch, number: t.append(batch.select("event_id", "value", "event_type")))
    return t.read().groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id % 3 AS part, count(*) AS n FROM events GROUP BY 1")
def z11_cursors(spark, d):
    """A backfill in three runs over a folder that grows: every run starts behind the cursor of the one before, so nothing comes twice."""
    folder = shared_folder(spark, "backfill")
    t, e = Table(spark, f"{folder}/rows", "part"), _t(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("part"))
    for step in range(3):
        e.filter(F.col("part") == step).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        ledger.run_once(ledger.read_events(spark, f"{folder}/in", e.schema), folder, lambda batch, number: t.append(batch))
    return t.read().groupBy("part").agg(F.count("*").alias("n"))

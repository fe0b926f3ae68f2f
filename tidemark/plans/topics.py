"""Registered queries of the topic gate, the taggers of names, discovery and the ledger of what emerges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import topic
from tidemark.operators import discovery, tagging
from tidemark.plans.catalogue import _t, query
from tidemark.plans.textual import _pick, _sql

#: Headlines, each with the category that the gate gives it from a plain source; "" passes.
HEADLINES = [
    ("Price prediction: % could hit $200", "speculation"), ("Save up to £30 on a %", "commerce"), ("% season 4 trailer", "entertainment"), ("% cricket fixtures", "sport"),
    ("Lawmakers vote on % tax", "politics"), ("% stolen from a museum", "crime"), ("Startup behind % in funding round", "business"), ("Survey finds % in decline", "business"),
    ("Jackets by % for winter", "consumer"), ("% 2.4.1 fixes a panic", ""), ("Senate looks at the % API", ""), ("Cold war of % makers", ""), ("% moves house", ""), ("Halving of the % price target", ""),
    ("% went on sale years ago", ""), ("How we built the % kernel", ""), ("Report says % SDK is slow", ""), ("Top 10 tokens to buy now: %", "speculation"),
]
_TITLE = f"replace({_sql([h for h, _ in HEADLINES])}[1 + p_partkey % {len(HEADLINES)}], '%', p_name)"


def _heads(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace(_pick([h for h, _ in HEADLINES], F.col("p_partkey")), F.lit("%"), F.col("p_name")).alias("title"), "p_size", "p_brand", "p_type")


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 AND p_partkey % {len(HEADLINES)} IN (1, 8) THEN NULL ELSE nullif({_sql([c for _, c in HEADLINES])}[1 + p_partkey % {len(HEADLINES)}], '') END AS category FROM part")
def g1_topics(spark, d):
    """Categories that refuse headlines; a fifth comes from release feeds, which pass, and a fifth from publishers that write about themselves. The SQL lists what each headline is."""
    h = _heads(spark, d)
    kind, own = F.when(F.col("p_size") % 5 == 0, "releases").otherwise("news"), F.col("p_size") % 5 == 1
    return h.select("id", topic.off_topic(F.col("title"), F.lit(""), kind, own, F.lit(False)).alias("category"))


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'no_title' WHEN p_size % 7 = 1 THEN 'media' WHEN p_size % 7 = 2 THEN 'language' WHEN {_sql([c for _, c in HEADLINES])}[1 + p_partkey % {len(HEADLINES)}] <> '' THEN 'off_topic' WHEN p_size < 20 THEN 'too_short' END AS reason FROM part")
def g15_drop_reasons(spark, d):
    """The first reason for which each item is dropped, null for those that stay."""
    h = _heads(spark, d)
    seven = F.col("p_size") % 7
    category = topic.off_topic(F.col("title"), F.lit(""), F.lit("news"), F.lit(False), F.lit(False))
    return h.select("id", topic.first_reason([("no_title", seven == 0), ("media", seven == 1), ("language", seven == 2), ("off_topic", category.isNotNull()), ("too_short", F.col("p_size") < 20)]).alias("reason"))


@query(f"WITH t AS (SELECT p_brand AS source, coalesce(nullif({_sql([c for _, c in HEADLINES])}[1 + p_partkey % {len(HEADLINES)}], ''), 'kept') AS verdict, {_TITLE} AS title FROM part) SELECT source, verdict, count(*) AS n, array_to_string(list_sort(list(DISTINCT title))[1:3], '|') AS samples FROM t GROUP BY 1, 2")
def v15_gate_report(spark, d):
    """A dry run of the gate: verdicts of each source, with three titles of each."""
    category = topic.off_topic(F.col("title"), F.lit(""), F.lit("news"), F.lit(False), F.lit(False))
    return topic.histogram(_heads(spark, d).withColumnRenamed("p_brand", "source"), category, "title", "source").withColumn("samples", F.array_join("samples", "|"))


@query(f"WITH t AS (SELECT {_sql([c for _, c in HEADLINES])}[1 + p_partkey % {len(HEADLINES)}] AS now, CASE WHEN p_size % 3 = 0 THEN 'sport' WHEN p_size % 3 = 1 THEN '' ELSE {_sql([c for _, c in HEADLINES])}[1 + p_partkey % {len(HEADLINES)}] END AS stored FROM part) SELECT nullif(stored, '') AS stored, nullif(now, '') AS now, count(*) AS n FROM t WHERE stored <> now GROUP BY 1, 2")
def v16_changed_verdicts(spark, d):
    """Where a stored verdict differs from the one that the rules give now, as a crosstab."""
    now = topic.off_topic(F.col("title"), F.lit(""), F.lit("news"), F.lit(False), F.lit(False))
    listed = F.when(F.col("p_size") % 3 == 0, "sport").when(F.col("p_size") % 3 == 2, now)
    rows = _heads(spark, d).select(listed.alias("stored"), now.alias("now"))
    return rows.filter(~F.col("stored").eqNullSafe(F.col("now"))).groupBy("stored", "now").agg(F.count("*").alias("n"))


_TECH = [9, 10, 15, 16]


@query(f"SELECT p_partkey AS id, p_partkey % {len(HEADLINES)} IN ({', '.join(map(str, _TECH))}) AS technical FROM part")
def v35_technical_titles(spark, d):
    return _heads(spark, d).select("id", topic.technical_title(F.col("title")).alias("technical"))


#: Sentences with what each tagger finds in them.
SAID = [
    ("Meta and ARM ship a Next.js fork, says acme.com", "arm,meta", "nextjs", ""), ("A meta analysis of arm pain", "", "", ""), ("We moved from Go to rust and C++", "", "cpp,go", ""), ("Maven Hub pays; maven hub does not", "", "", "maven-hub"),
    ("RUST rewrites the api of k8s", "", "kubernetes,rust", ""), ("linear app, Linear App", "linear", "", ""), ("https://next.js.example/Go nothing here", "", "", ""), ("Open source Helm charts by Globex", "globex", "helm", ""),
    ("support for first things", "", "", ""), ("argo-cd and Argo", "", "argo,argo-cd", ""), ("Gumroad and Ghost raise fees", "", "", "gumroad"), ("go, GO! and c++11", "", "go", ""),
]
STACKS = [("Next.js", "nextjs", True), ("Go", "go", True), ("Rust", "rust", True), ("C++", "cpp", True), ("k8s", "kubernetes", True), ("Kubernetes", "kubernetes", True), ("api", "api", True), ("Helm", "helm", True), ("support", "support", False), ("first", "first", False), ("argo-cd", "argo-cd", True), ("Argo", "argo", True), ("Ghost CMS", "ghost", True)]
COMPANIES = [("Meta", "meta"), ("ARM", "arm"), ("Linear App", "linear"), ("Globex", "globex"), ("x", "x")]
PLATFORMS = [("maven-hub", "Maven Hub"), ("gumroad", "Gumroad"), ("ghost", "Ghost"), ("go", "Go")]


def _said(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), _pick([s for s, *_ in SAID], F.col("event_id")).alias("text"))


def _expected(column: int) -> str:
    return f"SELECT event_id AS id, {_sql([s[column] for s in SAID])}[1 + event_id % {len(SAID)}] AS slugs FROM events WHERE {_sql([s[column] for s in SAID])}[1 + event_id % {len(SAID)}] <> ''"


def _listed(found):
    return found.select("id", F.array_join(F.sort_array("slugs"), ",").alias("slugs"))


@query(_expected(2))
def c8_technology_names(spark, d):
    """Technologies that sentences name; common words only where a person put them in, ambiguous ones only with a capital. The SQL lists what each sentence has."""
    names = tagging.stack_names(spark.createDataFrame(STACKS, "alias string, slug string, curated boolean"), ["support", "first", "go", "rust"])
    return _listed(tagging.tag_names(_said(spark, d), names, 8))


@query(_expected(1))
def c9_company_names(spark, d):
    """Companies that sentences name; ambiguous and short names only with capitals."""
    return _listed(tagging.tag_names(_said(spark, d), tagging.company_names(spark.createDataFrame(COMPANIES, "alias string, slug string")), 6))


@query(_expected(3))
def c10_platform_names(spark, d):
    """Platforms as they write themselves, but for those whose name a technology has."""
    claimed = spark.createDataFrame([("ghost",), ("go",)], "alias string")
    return _listed(tagging.tag_names(_said(spark, d), tagging.platform_names(spark.createDataFrame(PLATFORMS, "slug string, name string"), claimed), 4))


@query("WITH v AS (SELECT DISTINCT replace(p_name, ' ', '-') AS slug FROM part), t AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'A cold ring and a red-gear ' WHEN 1 THEN 'small widget' ELSE 'nothing of note' END AS t FROM customer) SELECT id, slug FROM t JOIN v ON contains(t, slug) OR contains(t, replace(slug, '-', ' ')) UNION SELECT id, 'all' FROM t")
def c11_vocabulary_prefilter(spark, d):
    """Entries that a text plausibly mentions, and the root."""
    slugs = _t(spark, d, "part").select(F.regexp_replace("p_name", " ", "-").alias("slug")).distinct()
    docs = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), _pick(["A cold ring and a red-gear ", "small widget", "nothing of note"], F.col("c_custkey")).alias("text"))
    return discovery.prefilter(docs, slugs, ["all"])


@query("WITH s AS (SELECT l_orderkey AS story, 'e' || (l_partkey % 40) AS slug, l_suppkey AS source, CASE WHEN l_linenumber > 1 THEN 'what ' || l_suppkey END AS what, l_returnflag = 'R' AS independent, l_shipdate AS seen FROM lineitem WHERE l_partkey % 40 >= 3), o AS (SELECT slug, story, source, min(seen) AS seen, bool_or(independent) AS independent, min_by(what, (seen, what)) FILTER (what IS NOT NULL) AS what FROM s GROUP BY ALL) SELECT slug, min_by(what, (seen, what)) FILTER (what IS NOT NULL) AS what, min(seen)::DATE::VARCHAR AS first_seen, max(seen)::DATE::VARCHAR AS last_seen, count(*) AS sightings, count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (independent) AS independent, CASE WHEN count(DISTINCT source) >= 2 OR count(*) FILTER (independent) > 0 THEN 'tracked' ELSE 'candidate' END AS status FROM o GROUP BY 1")
def c15_emerging_ledger(spark, d):
    """The ledger after a second batch of sightings; three names are in the taxonomy."""
    s = _t(spark, d, "lineitem").select(F.concat(F.lit("e"), (F.col("l_partkey") % 40).cast("string")).alias("slug"), F.col("l_orderkey").alias("story"), F.col("l_suppkey").alias("source"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("what "), F.col("l_suppkey").cast("string"))).alias("what"), (F.col("l_returnflag") == "R").alias("independent"), F.col("l_shipdate").alias("at"))
    known = spark.createDataFrame([("e0",), ("e1",), ("e2",)], "slug string")
    out = discovery.ledger(s.filter("story % 2 = 0"), s.filter("story % 2 = 1 OR story % 10 = 0"), known)
    return out.withColumn("first_seen", F.col("first_seen").cast("date").cast("string")).withColumn("last_seen", F.col("last_seen").cast("date").cast("string"))


_REL = "rel AS (SELECT 'owner' || (o_custkey % 7) || '/' || replace(p_name, ' ', '-') AS repo, o_orderkey AS id, o_custkey AS source, o_orderdate AS seen, p_brand AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON p_partkey = l_partkey WHERE o_orderkey % 3 = 0)"


@query(f"WITH {_REL}, a AS (SELECT repo, count(*) AS mentions, count(DISTINCT source) AS sources, array_to_string(list('https://github.com/' || repo || '/releases/tag/' || id ORDER BY seen DESC, 'https://github.com/' || repo || '/releases/tag/' || id DESC)[1:3], ' ') AS samples, array_to_string(list_sort(list(DISTINCT tag)), ',') AS beside FROM rel GROUP BY 1) SELECT split_part(repo, '/', 2) AS term, repo, mentions, sources, samples, beside FROM a WHERE repo NOT LIKE '%-ring' AND split_part(repo, '/', 1) <> 'owner1'")
def c16_release_discovery(spark, d):
    """Repositories of release notes that the taxonomy does not know; one owner is known by address and the rings by name."""
    items = _t(spark, d, "lineitem").filter("l_linenumber = 1").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    repo = F.concat(F.lit("owner"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"), F.regexp_replace("p_name", " ", "-"))
    s = _t(spark, d, "orders").filter("o_orderkey % 3 = 0").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    s = s.select(F.concat(F.lit("https://github.com/"), repo, F.lit("/releases/tag/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("at"), F.array("p_brand").alias("tags"), repo.alias("repo"))
    names = _t(spark, d, "part").select(F.regexp_replace("p_name", " ", "-").alias("slug")).distinct()
    found = discovery.from_releases(s, s.filter("repo LIKE 'owner1/%'").select("repo").distinct(), names.filter("slug LIKE '%-ring'"))
    return found.select("term", "repo", "mentions", "sources", F.array_join("samples", " ").alias("samples"), F.array_join("beside", ",").alias("beside"))


@query("WITH t AS (SELECT event_id AS id, user_id % 11 AS source, event_id % 6 AS k FROM events), m AS (SELECT id, source, unnest([['fastql', 'newthing'], ['node.js', 'deno.dev'], ['k8s', 'postgresql'], [], ['langgraph', 'sqlkit'], []][1 + k]) AS term FROM t) SELECT term, count(DISTINCT id) AS mentions, count(DISTINCT source) AS sources FROM m WHERE term NOT IN ('postgresql', 'newthing') GROUP BY 1 HAVING count(DISTINCT id) >= 2")
def c17_title_discovery(spark, d):
    """Product-like words of titles that are neither known nor excluded, with the stories and sources that use them."""
    from tidemark.plans.textual import _TITLES

    s = _t(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 11).alias("source"), _pick(_TITLES, F.col("event_id")).alias("title"))
    known, excluded = spark.createDataFrame([("PostgreSQL",)], "slug string"), spark.createDataFrame([("newthing",)], "term string")
    return discovery.from_titles(s, known, excluded, ["meet", "news"]).select("term", "mentions", "sources")


@query("WITH a AS (SELECT l_partkey AS id, count(*) AS mentions, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1) SELECT id, CASE WHEN id % 9 = 0 THEN 'rejected' WHEN id % 4 = 0 AND mentions >= 1 OR mentions >= 20 AND sources >= 2 THEN 'promoted' ELSE 'waiting' END AS status FROM a")
def v10_candidate_status(spark, d):
    a = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("mentions"), F.countDistinct("l_suppkey").alias("sources")).withColumn("dismissed", F.col("id") % 9 == 0)
    return discovery.promoted(a, F.col("mentions"), F.col("sources"), F.col("id") % 4 == 0, 20).select("id", "status")


@query("WITH e AS (SELECT l_partkey % 40 AS slug, min(l_shipdate) AS first_seen, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1) SELECT count(*) FILTER (sources >= 2) AS tracked, count(*) FILTER (sources < 2) AS candidates, count(*) FILTER (sources >= 2 AND first_seen > TIMESTAMP '1995-02-01') AS fresh FROM e")
def q36_emerging_summary(spark, d):
    """How many names are tracked, wait for a second source, and are new."""
    e = _t(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("slug")).agg(F.min("l_shipdate").alias("first_seen"), F.countDistinct("l_suppkey").alias("sources"))
    t = F.col("sources") >= 2
    return e.agg(F.count_if(t).alias("tracked"), F.count_if(~t).alias("candidates"), F.count_if(t & (F.col("first_seen") > F.lit("1995-02-01").cast("timestamp_ntz"))).alias("fresh"))

"""Registered queries of the wider pages: histories, overviews, all facets, companies, fields, evaluation, funnels and corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import language, scores, text
from tidemark.operators import evaluation, filters, joins, tallies
from tidemark.operators.filters import Filters, Reader
from tidemark.operators.tables import Table, shared_folder
from tidemark.plans.catalogue import _t, query
from tidemark.plans.reader import STORIES, TAXONOMY, stories, taxonomy
from tidemark.sources import feeds

_S = f"WITH {STORIES}"
_PASS = "superseded_by IS NULL AND coalesce(is_tech, TRUE) AND dismissed_at IS NULL AND (event_kind IS NULL OR event_kind <> 'article') AND (lang = 'en' OR title_en IS NOT NULL)"


def _monthly(spark, d, array):
    m = stories(spark, d).select(F.trunc("at", "MM").alias("month"), F.explode(array).alias("slug"), "source", "importance")
    return m.groupBy("month", "slug").agg(F.count("*").alias("stories"), F.countDistinct("source").alias("outlets"), F.max("importance").cast("long").alias("most"))


@query(f"{_S} SELECT date_trunc('month', \"at\")::DATE AS month, slug, count(*) AS stories, count(DISTINCT source) AS outlets, max(importance)::BIGINT AS most FROM (SELECT *, unnest(companies) AS slug FROM stories) GROUP BY 1, 2", date="month")
def q4_company_months(spark, d):
    return _monthly(spark, d, "companies")


@query(f"{_S} SELECT date_trunc('month', \"at\")::DATE AS month, slug, count(*) AS stories, count(DISTINCT source) AS outlets, max(importance)::BIGINT AS most FROM (SELECT *, unnest(platforms) AS slug FROM stories) GROUP BY 1, 2", date="month")
def q4_platform_months(spark, d):
    return _monthly(spark, d, "platforms")


@query(f"{_S}, m AS (SELECT date_trunc('month', \"at\")::DATE AS month, unnest(tags) AS slug, id FROM stories) SELECT slug, month, count(*) AS stories, month < DATE '2000-01-01' AS archived FROM m GROUP BY 1, 2", date="month")
def q7_history_of_both(spark, d):
    """Months that are rolled up come from a written cube, later ones from the stories; no month is counted twice."""
    m = stories(spark, d).select(F.trunc("at", "MM").alias("month"), F.explode("tags").alias("slug"))
    cube = Table(spark, shared_folder(spark, "history"), "month")
    cube.replace(m.filter("month < DATE '2000-01-01'").groupBy("month", "slug").agg(F.count("*").alias("stories")))
    rolled = cube.read().select("slug", "month", "stories", F.lit(True).alias("archived"))
    live = m.join(cube.read().select("month").distinct(), "month", "left_anti").groupBy("slug", "month").agg(F.count("*").alias("stories")).withColumn("archived", F.lit(False))
    return rolled.unionByName(live)


@query("WITH u AS (SELECT p_type AS category, p_brand AS tool, count(*) AS uses FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), b AS (SELECT category, tool, uses FROM u QUALIFY row_number() OVER (PARTITION BY category ORDER BY uses DESC, tool) = 1), v AS (SELECT p_brand AS tool, p_size || '.' || p_partkey AS version FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) = 1) SELECT category, tool, uses, version FROM b JOIN v USING (tool)")
def q10_best_with_version(spark, d):
    """The most used tool of each category with its current version."""
    p = _t(spark, d, "part")
    u = _t(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("tool")).agg(F.count("*").alias("uses"))
    best = u.groupBy("category").agg(F.min(F.struct((-F.col("uses")).alias("less"), "tool")).alias("b")).select("category", "b.tool", (-F.col("b.less")).alias("uses"))
    version = p.groupBy(F.col("p_brand").alias("tool")).agg(F.max(F.struct("p_size", "p_partkey")).alias("v")).select("tool", F.concat_ws(".", "v.p_size", "v.p_partkey").alias("version"))
    return best.join(version, "tool").select("category", "tool", "uses", "version")


@query(f"{_S}, t AS (SELECT unnest(tags) AS slug, event_kind FROM stories) SELECT slug, coalesce(event_kind, 'unjudged') AS kind, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY slug), 9) AS share FROM t GROUP BY 1, 2")
def q12_kind_mix(spark, d):
    """The mix of event kinds of every tag's stories."""
    n = stories(spark, d).select(F.explode("tags").alias("slug"), F.coalesce("event_kind", F.lit("unjudged")).alias("kind")).groupBy("slug", "kind").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("slug").agg(F.sum("n").alias("total")), "slug").select("slug", "kind", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query(f"{_S}, p AS (SELECT a.t AS slug, b.t AS other, count(*) AS together FROM (SELECT id, unnest(tags) AS t FROM stories) a JOIN (SELECT id, unnest(tags) AS t FROM stories) b ON a.id = b.id AND a.t <> b.t GROUP BY 1, 2) SELECT slug, other, together FROM p QUALIFY row_number() OVER (PARTITION BY slug ORDER BY together DESC, other) <= 5")
def q12_related_five(spark, d):
    """The five tags that stand beside each tag most often."""
    p = stories(spark, d).select(F.explode(tallies.pairs("tags")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("together"))
    both = p.select(F.explode(F.array(F.struct(F.col("a").alias("slug"), F.col("b").alias("other")), F.struct(F.col("b").alias("slug"), F.col("a").alias("other")))).alias("e"), "together").select("e.*", "together")
    return both.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("together"), "other"))).filter("n <= 5").drop("n")


@query(f"{_S}, w AS (SELECT unnest(tags) AS slug, \"at\" > TIMESTAMP '2001-07-25' AS now FROM stories WHERE \"at\" > TIMESTAMP '2001-07-18') SELECT slug, count(*) FILTER (now) AS now, count(*) FILTER (NOT now) AS before FROM w GROUP BY 1 HAVING count(*) >= 2")
def q13_movers(spark, d):
    """Tags of the last seven days against the seven before."""
    now = F.col("at") > F.lit("2001-07-25").cast("timestamp_ntz")
    w = stories(spark, d).filter(F.col("at") > F.lit("2001-07-18").cast("timestamp_ntz")).select(F.explode("tags").alias("slug"), now.alias("now"))
    return w.groupBy("slug").agg(F.count_if("now").alias("now"), F.count_if(~F.col("now")).alias("before")).filter("now + before >= 2")


@query(f"{_S} SELECT count(*) AS stories, count(*) FILTER (\"at\" > TIMESTAMP '2001-07-25') AS week, count(DISTINCT source) AS sources, count(*) FILTER (importance >= 8) AS critical, round(100.0::DOUBLE * count(*) FILTER (event_kind <> 'article') / count(*), 2) AS events FROM stories WHERE superseded_by IS NULL")
def q13_figures(spark, d):
    """The overview's row of figures in one pass."""
    s = stories(spark, d).filter("superseded_by IS NULL")
    return s.agg(F.count("*").alias("stories"), F.count_if(F.col("at") > F.lit("2001-07-25").cast("timestamp_ntz")).alias("week"), F.countDistinct("source").alias("sources"), F.count_if(F.col("importance") >= 8).alias("critical"), F.round(100 * F.count_if(F.col("event_kind") != "article") / F.count("*"), 2).alias("events"))


@query(f"{_S} SELECT count(*) AS total, least(count(*), 20) AS shown FROM stories WHERE {_PASS}")
def q14_total(spark, d):
    """How many stories a selection has, beside the page that is shown."""
    found = filters.where(stories(spark, d), Filters(), Reader("2001-08-01"))
    return found.agg(F.count("*").alias("total")).withColumn("shown", F.least("total", F.lit(20).cast("long")))


_FACETS = {"tag": "tags", "company": "companies", "platform": "platforms"}
_LIFT = {"kind": "event_kind", "country": "country", "lang": "lang"}
_CHOSEN = {"kind": "event_kind IN ('launch', 'change')", "country": "country IN ('N1', 'N2', 'N3')", "lang": "lang <> 'fr'", "company": "list_has_any(companies, ['c1', 'c2', 'c3', 'c4'])", "tag": None, "platform": None}
_without = lambda name: " AND ".join(v for k, v in _CHOSEN.items() if v and k != name)


@query(_S + " " + " UNION ALL ".join([f"SELECT '{n}' AS facet, v AS value, count(*) AS n FROM (SELECT unnest({c}) AS v FROM stories WHERE {_without(n)}) GROUP BY 2" for n, c in _FACETS.items()] + [f"SELECT '{n}', {c}, count(*) FROM stories WHERE {_without(n)} AND {c} IS NOT NULL GROUP BY 2" for n, c in _LIFT.items()]))
def q15_all_facets(spark, d):
    """Six facets of one selection, each counted without its own clause: every story passes once, with the clauses that it fails."""
    s = stories(spark, d)
    one = lambda *x: F.array(*map(F.lit, x))
    clause = {"kind": F.col("event_kind").isin("launch", "change"), "country": F.col("country").isin("N1", "N2", "N3"), "lang": F.col("lang") != "fr", "company": F.arrays_overlap("companies", one("c1", "c2", "c3", "c4"))}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in clause.items()]))
    s = s.withColumn("failed", failed).filter(F.size("failed") <= 1)
    values = {**{n: F.col(c) for n, c in _FACETS.items()}, **{n: F.array_compact(F.array(c)) for n, c in _LIFT.items()}}
    counted = lambda name: F.when((F.size("failed") == 0) | (F.element_at(F.col("failed"), 1) == name), F.transform(values[name], lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value"))))
    none = F.array().cast("array<struct<facet:string,value:string>>")
    return s.select(F.explode(F.concat(*[F.coalesce(counted(n), none) for n in values])).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS story, l_suppkey AS outlet, min(l_shipdate)::DATE::VARCHAR AS first_seen, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_shipdate), l_suppkey) AS place FROM lineitem GROUP BY 1, 2")
def q17_outlets(spark, d):
    """The outlets of every story in the order in which they carried it."""
    m = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("story"), F.col("l_suppkey").alias("outlet")).agg(F.min("l_shipdate").alias("at"))
    return m.select("story", "outlet", F.col("at").cast("date").cast("string").alias("first_seen"), F.row_number().over(Window.partitionBy("story").orderBy("at", "outlet")).cast("long").alias("place"))


_GRAMS = "list_distinct(flatten(list_transform(string_split({0}, ' '), lambda w: [substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)])))"


@query(f"WITH e AS (SELECT p_partkey AS slug, p_name AS name, p_partkey % 50 = 0 AS known FROM part), g AS (SELECT *, {_GRAMS.format('name')} AS a, {_GRAMS.format(chr(39) + 'small rings' + chr(39))} AS b FROM e), s AS (SELECT *, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS sim FROM g) SELECT slug, round(greatest(CASE WHEN known THEN 0.97 WHEN starts_with(name, 'small rings') THEN 0.8 ELSE 0 END, sim * 0.7), 9)::DOUBLE AS score FROM s WHERE known OR starts_with(name, 'small rings') OR sim > 0.34")
def q18_resolution(spark, d):
    """Entries that a typed name may mean, by name, alias, beginning or likeness."""
    e = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("slug"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 50 == 0, F.array(F.lit("Small Rings"))).alias("aliases"))
    return evaluation.resolve(e, "small rings", text.similarity(F.col("name"), F.lit("small rings"))).select(F.col("slug").cast("long").alias("slug"), F.round("score", 9).alias("score"))


@query("WITH w AS (SELECT unnest(generate_series(DATE '2001-01-29', DATE '2001-07-23', INTERVAL 7 DAY))::DATE AS week), c AS (SELECT c_nationkey AS company, date_trunc('week', o_orderdate)::DATE AS week, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT n_nationkey AS company, w.week, coalesce(n, 0) AS stories FROM nation CROSS JOIN w LEFT JOIN c ON c.company = n_nationkey AND c.week = w.week", date="week")
def q20_company_weeks(spark, d):
    """Twenty-six weeks of every company, weeks without a story as 0."""
    from tidemark.functions import dates

    weeks = F.broadcast(dates.calendar(spark, "2001-01-29", "2001-07-23", "7 days", "week"))  # 26 rows
    o = _t(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '2001-01-29' AND o_orderdate < TIMESTAMP_NTZ '2001-07-30'")
    n = o.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("company"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").alias("stories"))
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("company")).crossJoin(weeks).join(n, ["company", "week"], "left").na.fill(0, ["stories"])


@query(f"{_S} SELECT company, count(*) FILTER (company = 'c' || (source % 20)) AS announced, count(*) FILTER (company <> 'c' || (source % 20)) AS covered FROM (SELECT source, unnest(companies) AS company FROM stories) GROUP BY 1")
def q20_announced_and_covered(spark, d):
    own = F.col("company") == F.concat(F.lit("c"), (F.col("source") % 20).cast("string"))
    return stories(spark, d).select("source", F.explode("companies").alias("company")).groupBy("company").agg(F.count_if(own).alias("announced"), F.count_if(~own).alias("covered"))


@query("SELECT p_type AS category, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (p_size > 10) / count(*), 1) AS described, round(100.0::DOUBLE * count(*) FILTER (p_partkey % 3 = 0) / count(*), 1) AS linked, round(100.0::DOUBLE * count(*) FILTER (p_size > 10 AND p_partkey % 3 = 0) / count(*), 1) AS complete FROM part GROUP BY 1")
def q22_completeness(spark, d):
    """How complete the entries of each category are."""
    described, linked = F.col("p_size") > 10, F.col("p_partkey") % 3 == 0
    pct = lambda c, name: tallies.share(F.count_if(c), F.count("*"), 1, 1).alias(name)
    return _t(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), pct(described, "described"), pct(linked, "linked"), pct(described & linked, "complete"))


@query(f"WITH RECURSIVE {STORIES}, {TAXONOMY}, down AS (SELECT slug AS root, slug AS member FROM tax WHERE kind = 'concept' UNION SELECT root, t.slug FROM down JOIN tax t ON t.parent = down.member), f AS (SELECT DISTINCT root, id, source, companies FROM down JOIN (SELECT id, source, companies, unnest(tags) AS member FROM stories) USING (member)), k AS (SELECT parent AS root, count(*) AS children FROM tax GROUP BY 1) SELECT root, count(*) AS stories, count(DISTINCT source) AS sources, any_value(children) AS children FROM f JOIN k USING (root) GROUP BY 1")
def q24_field_totals(spark, d):
    """Stories and sources of every field with all that is below it, and its children."""
    from tidemark.operators.hierarchy import closure

    tax = taxonomy(spark, d)
    down = closure(tax).join(tax.filter("kind = 'concept'").select(F.col("slug").alias("root")), "root", "left_semi")
    f = joins.members(stories(spark, d).select("id", "source", "tags"), "tags", down, "member").select("root", "id", "source").distinct()
    children = tax.groupBy(F.col("parent").alias("root")).agg(F.count("*").alias("children"))
    return f.groupBy("root").agg(F.count("*").alias("stories"), F.countDistinct("source").alias("sources")).join(children, "root")


@query(" UNION ALL ".join(f"SELECT '{n}' AS dimension, {c}::VARCHAR AS value, count(*) AS n FROM {t} GROUP BY 2" for n, c, t in [("segment", "c_mktsegment", "customer"), ("nation", "s_nationkey", "supplier"), ("type", "p_type", "part"), ("size", "p_size", "part"), ("status", "o_orderstatus", "orders")]))
def q25_five_dimensions(spark, d):
    each = [("segment", "c_mktsegment", "customer"), ("nation", "s_nationkey", "supplier"), ("type", "p_type", "part"), ("size", "p_size", "part"), ("status", "o_orderstatus", "orders")]
    return reduce(DataFrame.unionByName, [_t(spark, d, t).groupBy(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")) for n, c, t in each])


_EV = f"""{_S}, src AS (SELECT DISTINCT source FROM stories), st AS (SELECT id, source, "at" AS seen, CASE WHEN id % 3 > 0 THEN "at" - to_hours((id % 60)::INT) END AS published, CASE WHEN id % 4 > 0 THEN tags ELSE [] END AS tags, CASE WHEN id % 5 = 0 THEN companies ELSE [] END AS companies FROM stories),
fe AS (SELECT user_id * 7 AS source, 1 + event_id % 3 AS kept, event_id % 2 AS refused, CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS noisy, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS dupes, event_type <> 'error' AS ok FROM events WHERE ts >= TIMESTAMP '2024-01-03'),
mem AS (SELECT l_orderkey AS story, (l_suppkey * 3) AS source FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'),
f AS (SELECT source, sum(kept) AS kept, sum(refused) AS refused, sum(noisy) AS noisy, sum(dupes) AS dupes, count(*) AS polls, count(*) FILTER (ok) AS ok FROM fe GROUP BY 1),
wa AS (SELECT source, min(seen) AS since FROM st GROUP BY 1), nw AS (SELECT * FROM st WHERE seen >= TIMESTAMP '1999-01-01'),
td AS (SELECT nw.source, count(*) AS stories, count(*) FILTER (len(tags) > 0 OR len(companies) > 0) AS rel, count(*) FILTER (len(tags) > 0) AS dev, count(*) FILTER (len(companies) > 0) AS ent, median(epoch(seen - published) / 3600) FILTER (published >= since) AS lag FROM nw JOIN wa ON wa.source = nw.source GROUP BY 1),
ca AS (SELECT mem.story, mem.source, st.source AS owner FROM mem JOIN st ON st.id = mem.story WHERE mem.source <> st.source),
cf AS (SELECT owner AS source, count(DISTINCT story) AS n FROM ca GROUP BY 1), fl AS (SELECT source, count(*) AS n FROM ca GROUP BY 1),
mt AS (SELECT slug, source, min(seen) AS seen FROM (SELECT source, seen, unnest(tags) AS slug FROM nw) GROUP BY 1, 2), rk AS (SELECT source, rank() OVER (PARTITION BY slug ORDER BY seen) AS pos FROM mt),
ea AS (SELECT source, count(*) FILTER (pos <= 3) AS firsts, count(*) AS covered FROM rk GROUP BY 1)"""
_pc = lambda part, whole, least: f"CASE WHEN {whole} >= {least} THEN round(100.0::DOUBLE * coalesce({part}, 0) / ({whole}))::INT END"


@query(f"{_EV} SELECT src.source, coalesce(td.stories, 0) AS stories, {_pc('kept', '(coalesce(kept, 0) + coalesce(refused, 0))', 20)} AS density, {_pc('noisy', '(coalesce(kept, 0) + coalesce(refused, 0))', 20)} AS noise, {_pc('dupes', '(coalesce(kept, 0) + coalesce(dupes, 0))', 20)} AS duplicates, round(greatest(0, least(100, round(100 - lag / 48.0::DOUBLE * 100, 2))))::INT AS freshness, {_pc('ok', 'coalesce(polls, 0)', 10)} AS availability, {_pc('rel', 'coalesce(td.stories, 0)', 10)} AS market, {_pc('dev', 'coalesce(td.stories, 0)', 10)} AS developer, {_pc('ent', 'coalesce(td.stories, 0)', 10)} AS enterprise, {_pc('cf.n', '(coalesce(cf.n, 0) + coalesce(fl.n, 0))', 5)} AS originality, {_pc('firsts', 'coalesce(covered, 0)', 10)} AS early, coalesce(cf.n, 0) AS confirmations FROM src LEFT JOIN f ON f.source = src.source LEFT JOIN td ON td.source = src.source LEFT JOIN cf ON cf.source = src.source LEFT JOIN fl ON fl.source = src.source LEFT JOIN ea ON ea.source = src.source")
def q26_evaluation(spark, d):
    """Eleven metrics of every source: density, noise, duplicates, freshness, availability, relevance by three views, originality, early signal and confirmations."""
    s, i, e = stories(spark, d), F.col("id"), F.col("event_id")
    none = F.array().cast("array<string>")
    st = s.select("id", "source", F.col("at").alias("seen"), F.when(i % 3 > 0, F.col("at") - F.make_interval(hours=(i % 60).cast("int"))).alias("published"), F.when(i % 4 > 0, F.col("tags")).otherwise(none).alias("tags"), F.when(i % 5 == 0, F.col("companies")).otherwise(none).alias("companies"), none.alias("platforms"))
    shift = F.col("ts") - F.expr("INTERVAL 9133 DAYS")  # the fetch log of January 2024 as that of January 1999
    fe = _t(spark, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-03'").select((F.col("user_id") * 7).alias("source"), (shift + F.expr("INTERVAL 30 DAYS")).alias("at"), (1 + e % 3).alias("kept"), (e % 2).alias("refused"), F.when(e % 4 == 1, 1).otherwise(0).alias("noisy"), F.when(e % 5 == 0, 1).otherwise(0).alias("dupes"), (F.col("event_type") != "error").alias("ok"))
    mem = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("story"), (F.col("l_suppkey") * 3).alias("source"), F.col("l_shipdate").alias("at"))
    return evaluation.evaluate(s.select("source").distinct(), fe, st, mem, "1999-01-01")


@query("WITH p AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), r AS (SELECT lang, title FROM p GROUP BY 1, 2 HAVING count(*) > 1) SELECT lang, count(*) AS n, count(DISTINCT url) AS urls, count(DISTINCT host) AS hosts, (SELECT count(*) FROM r WHERE r.lang = p.lang) AS repeated, md5(array_to_string(list_sort(list(DISTINCT url))[1:3], ' ')) AS samples FROM p GROUP BY lang")
def q27_page_audit(spark, d):
    """Distinct addresses and hosts, titles that repeat, and three samples of each language's pages."""
    p = _t(spark, d, "pages").select("url", text.host(F.col("url")).alias("host"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    a = p.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"), F.countDistinct("host").alias("hosts"), F.md5(F.array_join(F.slice(F.sort_array(F.collect_set("url")), 1, 3), " ")).alias("samples"))
    repeated = p.groupBy("lang", "title").count().filter("count > 1").groupBy("lang").agg(F.count("*").alias("repeated"))
    return a.join(repeated, "lang", "left").na.fill(0, ["repeated"])


@query("SELECT user_id AS source, count(*) FILTER (event_type = 'error') AS failures, CASE WHEN count(*) FILTER (event_type = 'error') >= 40 THEN 'dead' WHEN count(*) FILTER (event_type = 'error') >= 10 THEN 'failing' WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 'degraded' ELSE 'ok' END AS health, count(*) AS seen, count(*) FILTER (event_type = 'purchase') AS kept, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_fetch FROM events GROUP BY 1")
def q28_health_board(spark, d):
    """Every source's failures and health beside what it brought and kept."""
    bad = F.count_if(F.col("event_type") == "error")
    b = _t(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(bad.alias("failures"), F.count("*").alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("kept"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_fetch"))
    return b.withColumn("health", scores.health(F.col("failures")))


@query("SELECT count(*) AS fields, TRUE AS within FROM region")
def o9_diversified(spark, d):
    """Corpora under caps by source, subject, releases and in all, which depend on order; the SQL holds that every field has one and none breaks a cap, a test holds the choice."""
    s = stories(spark, d).withColumn("field", F.col("source") % 5).filter("event_kind IS NOT NULL")
    got = evaluation.diversify(s.select("field", "id", "source", F.col("event_kind").alias("kind"), "tags", F.coalesce(-F.col("importance"), F.lit(1)).alias("less")), "field", ["less", "id"])
    by = lambda *k: got.groupBy("field", *k).count().agg(F.max("count")).first()[0]
    ok = by("source") <= 4 and by() <= 40 and by("kind") <= 40 and (got.filter("kind = 'release'").groupBy("field").count().agg(F.max("count")).first()[0] or 0) <= 8
    return got.agg(F.countDistinct("field").alias("fields")).withColumn("within", F.lit(bool(ok)))


@query("WITH i AS (SELECT doc_id, text, lang FROM documents), s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no_link' WHEN doc_id % 13 = 0 THEN 'no_title' WHEN doc_id % 7 = 0 THEN 'media_enclosure' WHEN doc_id % 5 = 0 THEN 'blocked_host' WHEN lang NOT IN ('en', 'de') THEN 'lang_gate' WHEN length(coalesce(text, '')) < 400 THEN 'too_short' END AS reason FROM i) SELECT reason, count(*) AS n FROM s GROUP BY 1")
def g6_item_gate(spark, d):
    """How many items each reason refuses; the language is the declared one."""
    i = F.col("doc_id")
    reason = evaluation.item_reason(F.when(i % 11 > 0, "https://x.example"), F.when(i % 13 > 0, "title"), i % 7 == 0, i % 5 == 0, F.col("lang"), language.long_enough(F.col("text")), ["en", "de"])
    return _t(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'host' WHEN n < 20 THEN 'unknown' WHEN r::DOUBLE / n >= 0.15 THEN 'off_beat' WHEN t::DOUBLE / n < 0.5 THEN 'thin' ELSE 'fine' END AS verdict FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n, count(*) FILTER (l_discount >= 0.09 AND l_returnflag = 'R' AND l_suppkey % 2 = 0) AS r, count(*) FILTER (l_quantity > 25) AS t FROM lineitem GROUP BY 1)")
def v14_audit_verdicts(spark, d):
    a = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_if(F.expr("l_discount >= 0.09 AND l_returnflag = 'R' AND l_suppkey % 2 = 0")).alias("r"), F.count_if(F.col("l_quantity") > 25).alias("t"))
    return a.select("s_suppkey", evaluation.audit_verdict(F.col("r"), F.col("n"), F.col("t"), F.col("s_suppkey") % 7 == 0).alias("verdict"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'repo' WHEN p_partkey % 4 = 1 THEN 'website' WHEN p_partkey % 4 = 2 THEN 'typed' END AS confirmed FROM part")
def g14_confirmed_references(spark, d):
    """What confirms a candidate reference of each entry: repository, website, or type and name."""
    i, n = F.col("p_partkey") % 4, F.col("p_name")
    repos, sites = F.array(F.when(i == 0, "https://www.github.com/A/B.git").otherwise("https://github.com/x/y")), F.array(F.when(i == 1, "http://a.example/").otherwise("http://b.example"))
    title = F.when(i == 2, F.concat(F.lit("The "), n, F.lit(" (software)"))).otherwise("Something else")
    return _t(spark, d, "part").select("p_partkey", text.confirmation(F.lit("https://github.com/a/b"), F.lit("https://A.example"), repos, sites, F.lit(True), n, title).alias("confirmed"))


@query("SELECT doc_id, CASE WHEN 3 * (doc_id % 9) > 0.15::DOUBLE * (length(f) + 3 * (doc_id % 9)) THEN length(replace(f, ' ', '')) + 3 * (doc_id % 9) ELSE len(list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')) || repeat('日本語', (doc_id % 9)::INT), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')) END AS words FROM (SELECT doc_id, text, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS f FROM documents)")
def t7_words_or_characters(spark, d):
    """Words of a text, or its characters where it is CJK."""
    t = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("日本語"), (F.col("doc_id") % 9).cast("int")))
    return _t(spark, d, "documents").select("doc_id", text.word_count(t).cast("long").alias("words"))


@query("SELECT 'f' || (doc_id // 100) AS feed, '<p>long <b>' || doc_id || '</b></p>' AS html FROM documents")
def s4_raw_entries(spark, d):
    """Atom entries with their content as HTML."""
    i = F.col("doc_id").cast("string")
    entry = F.concat(F.lit("<entry><title>T</title><id>"), i, F.lit("</id><content type='html'>&lt;p&gt;long &lt;b&gt;"), i, F.lit("&lt;/b&gt;&lt;/p&gt;</content></entry>"))
    bodies = _t(spark, d, "documents").groupBy(F.concat(F.lit("f"), F.floor(F.col("doc_id") / 100).cast("string")).alias("feed")).agg(F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</feed>")).alias("body"))
    return feeds.parse_feeds(bodies).select("feed", F.col("summary").alias("html"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-05-01'")
def s16_partitioned_scan(spark, d):
    """Two months of a table partitioned by month: the scan opens those folders only."""
    t = Table(spark, shared_folder(spark, "facts"), "month")
    t.replace(_t(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "MM").alias("month")))
    return t.read().filter("month >= DATE '1997-03-01' AND month < DATE '1997-05-01'").select("o_orderkey", F.col("month").cast("string").alias("month"))


@query(f"{_S}, {TAXONOMY}, v AS (SELECT slug FROM tax WHERE category = 'cloud') SELECT id, count(*) AS named FROM (SELECT id, title || ' by ' || array_to_string(tags, ' ') || '.' AS t FROM stories) s JOIN v ON regexp_matches(lower(t), '(^|[^a-z0-9+#])' || lower(slug) || '([^a-z0-9+#]|$)') GROUP BY 1")
def j21_vocabulary_match(spark, d):
    """Entries that a text names, of a whole vocabulary."""
    from tidemark.operators import tagging

    names = tagging.stack_names(taxonomy(spark, d).filter("category = 'cloud'").select(F.col("slug").alias("alias"), "slug", F.lit(True).alias("curated")))
    docs = stories(spark, d).select("id", F.concat("title", F.lit(" by "), F.array_join("tags", " "), F.lit(".")).alias("text"))
    return tagging.tag_names(docs, names, 20).select("id", F.size("slugs").cast("long").alias("named"))

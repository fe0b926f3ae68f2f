"""More registered queries: facets, paging, series, ranks, keyed state, gates, search and page text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores, search, text
from tidemark.operators import keyed, tagging
from tidemark.operators.gram_index import GramIndex
from tidemark.plans.catalogue import _TAGGED, QUERIES, SQL, _t, _tagged, query
from tidemark.streaming import ledger

_PLAIN = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus = 'F' GROUP BY 2")
def q15_facets(spark, d):
    """Each facet is counted without its own filter: one pass over the stories, then over the cells of both facets."""
    cells = _t(spark, d, "orders").filter("o_totalprice >= 1000").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    facet = lambda name, value, others: F.struct(F.lit(name).alias("facet"), value.alias("value"), others.alias("fits"))
    lifted = F.array(facet("status", status, priority.isin("1-URGENT", "2-HIGH")), facet("priority", priority, status == "F"))
    return cells.select("n", F.explode(lifted).alias("f")).filter("f.fits").groupBy("f.facet", "f.value").agg(F.sum("n").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def q14_reader_page(spark, d):
    """The third page of 25: the limit is the feature."""
    return _t(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(50).limit(25)


@query("WITH m AS (SELECT p_brand AS tag, o_custkey AS source, min(o_orderdate) AS first_at FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY tag ORDER BY first_at) AS place FROM m) SELECT tag, source, first_at, place FROM r WHERE place <= 3")
def w3_first_movers(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(_t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = rows.groupBy(F.col("p_brand").alias("tag"), F.col("o_custkey").alias("source")).agg(F.min("o_orderdate").alias("first_at"))
    return first.withColumn("place", F.rank().over(Window.partitionBy("tag").orderBy("first_at"))).filter("place <= 3")


@query("SELECT o_custkey AS source, o_orderkey AS story, o_totalprice AS weight FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w6_latest_of_source(spark, d):
    """An aggregate with partial sums instead of a window: a source of any size costs a row a task."""
    latest = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x")
    return _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(latest).select("source", F.col("x.o_orderkey").alias("story"), F.col("x.o_totalprice").alias("weight"))


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS v FROM orders) SELECT a.o_custkey AS source, a.o_orderkey AS story, b.o_orderkey AS neighbour, b.n - a.n AS distance FROM t a JOIN t b ON a.o_custkey = b.o_custkey WHERE a.v = 1 AND b.n - a.n BETWEEN -3 AND 4")
def w7_neighbours(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("neighbour"), "o_orderdate", "o_totalprice")
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("o_orderdate"), F.desc("neighbour")))
    best = F.min(F.struct(-F.col("o_totalprice"), F.col("neighbour").alias("story"), F.col("n").alias("at"))).over(Window.partitionBy("source"))
    near = o.withColumn("n", n).withColumn("best", best).withColumn("distance", F.col("n") - F.col("best.at"))
    return near.filter("distance BETWEEN -3 AND 4").select("source", "best.story", "neighbour", "distance")


@query(f"WITH {_TAGGED}, hi AS (SELECT max(month) AS hi FROM tagged), m AS (SELECT tag, unnest(generate_series(min(month), any_value(hi), INTERVAL 1 MONTH))::DATE AS month FROM tagged, hi GROUP BY tag) SELECT m.tag, m.month, count(story) AS stories FROM m LEFT JOIN tagged t ON t.tag = m.tag AND t.month = m.month GROUP BY 1, 2", date="month")
def q8_gap_filled_series(spark, d):
    counts = _tagged(spark, d).groupBy("tag", "month").agg(F.count("*").alias("stories"))
    span = counts.groupBy("tag").agg(F.min("month").alias("lo")).crossJoin(F.broadcast(counts.agg(F.max("month").alias("hi"))))  # one row
    months = span.select("tag", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.join(counts, ["tag", "month"], "left").na.fill(0, ["stories"])


@query("WITH c AS (SELECT p_type AS category, p_brand AS tool, count(*) AS uses FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT category, tool, uses FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY uses DESC, tool) AS n FROM c) WHERE n = 1")
def q10_best_of_category(spark, d):
    rows = _t(spark, d, "lineitem").select("l_partkey").join(_t(spark, d, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    uses = rows.groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("tool")).agg(F.count("*").alias("uses"))
    best = uses.groupBy("category").agg(F.min(F.struct((-F.col("uses")).alias("less"), "tool")).alias("b"))
    return best.select("category", "b.tool", (-F.col("b.less")).alias("uses"))


@query("SELECT p_type AS category, 'brand' AS dimension, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 UNION ALL SELECT p_type, 'size', count(DISTINCT p_size) FROM part GROUP BY 1 UNION ALL SELECT p_type, 'name', count(DISTINCT p_name) FROM part GROUP BY 1")
def q25_category_coverage(spark, d):
    counts = _t(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(*[F.countDistinct(f"p_{c}").alias(c) for c in ("brand", "size", "name")])
    return counts.unpivot("category", ["brand", "size", "name"], "dimension", "n")


@query("WITH hi AS (SELECT date_trunc('week', max(o_orderdate)) AS hi FROM orders), o AS (SELECT n_regionkey AS field, date_trunc('week', o_orderdate)::DATE AS week FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey, hi WHERE o_orderdate >= hi - INTERVAL 175 DAY) SELECT field, week, count(*) AS stories FROM o GROUP BY 1, 2", date="week")
def q24_field_weeks(spark, d):
    """26 weeks up to the last one. Sources are counted before the join to their fields."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderdate")
    last = F.broadcast(o.agg(F.date_trunc("week", F.max("o_orderdate")).alias("hi")))  # one row
    weekly = o.crossJoin(last).filter(F.col("o_orderdate") >= F.col("hi") - F.expr("INTERVAL 175 DAYS")).groupBy("o_custkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").alias("n"))
    fields = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("field"))
    return weekly.join(fields, F.col("o_custkey") == F.col("c_custkey")).groupBy("field", "week").agg(F.sum("n").alias("stories"))


@query("WITH hi AS (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 24 MONTH AS cut FROM orders) SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS stories, count(*) FILTER (o_orderdate < cut AND o_orderstatus <> 'O') AS eligible, count(*) FILTER (o_orderdate < cut AND o_orderstatus = 'O') AS spared FROM orders, hi GROUP BY 1", date="month")
def q33_retention(spark, d):
    months = _t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("stories"), F.count_if(F.col("o_orderstatus") != "O").alias("e"), F.count_if(F.col("o_orderstatus") == "O").alias("s"))
    old = F.col("month") < F.add_months("hi", -24)
    return months.crossJoin(F.broadcast(months.agg(F.max("month").alias("hi")))).select("month", "stories", F.when(old, F.col("e")).otherwise(0).alias("eligible"), F.when(old, F.col("s")).otherwise(0).alias("spared"))


@query(f"WITH {_TAGGED}, f AS (SELECT tag, count(*) AS n FROM tagged GROUP BY 1) SELECT story, min(n) AS rarest FROM tagged JOIN f USING (tag) GROUP BY 1")
def o3_rarest_tag(spark, d):
    rows = _tagged(spark, d).select("story", "tag")
    return rows.join(rows.groupBy("tag").agg(F.count("*").alias("n")), "tag").groupBy("story").agg(F.min("n").alias("rarest"))


@query("SELECT (SELECT count(*) FROM orders) AS stories, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open, (SELECT count(DISTINCT c_nationkey) FROM customer) AS nations, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors")
def a11_dashboard(spark, d):
    one = [
        _t(spark, d, "orders").agg(F.count("*").alias("stories"), F.count_if(F.col("o_orderstatus") == "O").alias("open")),
        _t(spark, d, "customer").agg(F.countDistinct("c_nationkey").alias("nations")),
        _t(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), one)  # one row each


@query("WITH held AS (SELECT c_nationkey AS key, min(c_custkey) AS owner FROM customer GROUP BY 1), live AS (SELECT * FROM held WHERE owner IN (SELECT o_custkey FROM orders)) SELECT key, owner FROM live UNION ALL SELECT s_nationkey, min(s_suppkey) FROM supplier WHERE s_nationkey NOT IN (SELECT key FROM live) GROUP BY 1")
def k3_claims(spark, d):
    owners = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_custkey").alias("owner"))
    live = _t(spark, d, "orders").select(F.col("o_custkey").alias("owner")).distinct()
    return keyed.claim(owners, live, _t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("owner")))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS hits, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY 1")
def k4_ledger(spark, d):
    """The ledger of the first half of January, merged with what came after."""
    part = lambda f: f.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("hits"), F.collect_set("event_type").alias("names"))
    e, cut = _t(spark, d, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    return keyed.accumulate(part(e.filter(F.col("ts") < cut)), part(e.filter(F.col("ts") >= cut)), "user_id").withColumn("names", F.array_join("names", ","))


@query("SELECT (ts::DATE - k::INTEGER)::DATE AS day, event_type, count(*) AS n FROM events, generate_series(0, 6) AS g(k) GROUP BY ALL", date="day")
def z5_sliding_weeks(spark, d):
    """Windows of 7 days each day: days are counted first, so seven copies are made of counts, not of events."""
    daily = _t(spark, d, "events").groupBy(F.to_date("ts").alias("at"), "event_type").agg(F.count("*").alias("n"))
    starts = F.explode(F.sequence(F.date_sub("at", 6), F.col("at")))
    return daily.select(starts.alias("day"), "event_type", "n").groupBy("day", "event_type").agg(F.sum("n").alias("n"))


@query("WITH g AS (SELECT source, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN length(text) < 400 THEN 'length' ELSE 'kept' END AS reason FROM documents) SELECT source, reason, count(*) AS n FROM g GROUP BY 1, 2")
def g6_gate_reasons(spark, d):
    gates = F.when(F.col("text").isNull() | (F.trim("text") == ""), "no_text").when(~F.col("lang").isin("en", "de"), "language").when(F.length("text") < 400, "length").otherwise("kept")
    return _t(spark, d, "documents").groupBy("source", gates.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END AS words, len(list_distinct(list_filter(string_split(p, ' '), lambda w: length(w) > 2))) AS long_words FROM (SELECT doc_id, {_PLAIN} AS p FROM documents)")
def t7_word_counts(spark, d):
    plain = _t(spark, d, "documents").select("doc_id", text.compare_form(F.col("text")).alias("p"))
    return plain.select("doc_id", F.when(F.col("p") == "", 0).otherwise(F.size(F.split("p", " "))).alias("words"), F.size(text.tokens(F.col("p"), 2)).alias("long_words"))


_GRAMS = "list_distinct(flatten(list_transform(string_split({0}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"WITH n AS (SELECT DISTINCT p_name AS name, {_GRAMS.format('p_name')} AS a, {_GRAMS.format(chr(39) + 'smal ringe' + chr(39))} AS b FROM part), s AS (SELECT name, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS likeness FROM n) SELECT * FROM s WHERE likeness >= 0.34")
def x4_similar_names(spark, d):
    """Only names that share one of the rarest trigrams are compared."""
    names = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("form"), F.lit(False).alias("alias")).withColumnRenamed("p_partkey", "slug")
    return GramIndex.build(names).similar("smal ringe").select("name", F.round("likeness", 9).alias("likeness"))


@query("SELECT name, distance FROM (SELECT DISTINCT p_name AS name, levenshtein(lower(p_name), 'smal ringe') AS distance FROM part) WHERE distance <= 3")
def t31_suggestions(spark, d):
    return _t(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("distance", search.suggestions(F.col("name"), "smal ringe")).filter("distance IS NOT NULL")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS links FROM pages""")
def s15_page_metadata(spark, d):
    links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), links.alias("links"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages) SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM s""")
def t3_page_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("text_md5"))


@query("WITH s AS (SELECT doc_id, n_chars, doc_id % 100 AS age FROM documents), x AS (SELECT doc_id, least(1, greatest(0, 0.35::DOUBLE * least(ln(1 + n_chars) / ln(12001), 1) + 0.25::DOUBLE)) AS depth, exp(-age / 48::DOUBLE) * CASE WHEN age <= 48 THEN 1 ELSE 0.6::DOUBLE END AS novelty FROM s) SELECT doc_id, round(depth, 9) AS depth, round(novelty, 9) AS novelty, CASE WHEN depth >= 0.6 AND novelty >= 0.5 THEN 'niche' ELSE 'background' END AS tier FROM x")
def m4_story_scores(spark, d):
    age = F.pmod("doc_id", F.lit(100))
    rows = _t(spark, d, "documents").select("doc_id", scores.depth(F.col("n_chars"), F.lit(0.5), F.lit(False)).alias("depth"), scores.novelty(age, age, F.lit(0)).alias("novelty"))
    return rows.select("doc_id", F.round("depth", 9).alias("depth"), F.round("novelty", 9).alias("novelty"), scores.tier(F.lit(0), F.col("depth"), F.col("novelty")).alias("tier"))


@query("WITH f AS (SELECT c_custkey AS source, count(o_orderkey) AS failures FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1) SELECT source, failures, least(900 * pow(2, least(failures, 6)), 86400)::DOUBLE AS wait, CASE WHEN failures >= 40 THEN 'dead' WHEN failures >= 10 THEN 'failing' WHEN failures >= 3 THEN 'degraded' ELSE 'ok' END AS health FROM f")
def m7_source_health(spark, d):
    failed = _t(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("failures"))
    rows = _t(spark, d, "customer").join(failed, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("source"), F.coalesce("failures", F.lit(0)).alias("failures"))
    return rows.withColumns({"wait": scores.backoff(F.lit(900.0), F.col("failures")), "health": scores.health(F.col("failures"))})


@query("WITH b AS (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b) SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM n")
def v11_free_slugs(spark, d):
    base = F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return _t(spark, d, "part").select("p_partkey", base.alias("base")).withColumn("n", n).select("p_partkey", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("slug"))


@query(f"WITH v AS (SELECT DISTINCT unnest(string_split({_PLAIN}, ' ')) AS alias FROM benchmark), k AS (SELECT alias, substr(alias, 1, 6) AS slug FROM v WHERE length(alias) > 5), w AS (SELECT doc_id, unnest(string_split({_PLAIN}, ' ')) AS alias FROM documents), n AS (SELECT doc_id, slug, count(*) AS hits FROM w JOIN k USING (alias) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, slug) AS place FROM n) SELECT doc_id, slug, hits FROM r WHERE place <= 8")
def c8_alias_tags(spark, d):
    """The words of `benchmark` with over five letters are the vocabulary, their first six letters the slug."""
    words = _t(spark, d, "benchmark").select(F.explode(F.split(text.compare_form(F.col("text")), " ")).alias("alias")).filter("length(alias) > 5")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return tagging.tag_aliases(docs, words.select("alias", F.substring("alias", 1, 6).alias("slug"))).withColumnRenamed("id", "doc_id")


@query("WITH a AS (SELECT n_regionkey AS field, o_custkey AS source, o_orderkey AS story, o_totalprice AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), b AS (SELECT *, row_number() OVER (PARTITION BY field, source ORDER BY weight DESC, story) AS n FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY weight DESC, story) AS place FROM b WHERE n <= 4) SELECT field, source, story, weight, place FROM c WHERE place <= 40")
def o9_capped_top(spark, d):
    """Forty stories a field, four of a source at most: the limit is the feature."""
    fields = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("field"))
    rows = _t(spark, d, "orders").join(fields, F.col("o_custkey") == F.col("c_custkey")).select("field", F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("story"), F.col("o_totalprice").alias("weight"))
    return tagging.capped_top(rows, "field", "source", [F.desc("weight"), "story"])


@query(f"SELECT member AS slug, string_agg(root, '/' ORDER BY depth DESC) AS path FROM ({SQL['c13_closure']}) GROUP BY 1")
def v6_ancestry(spark, d):
    up = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("above"), "root")))
    return QUERIES["c13_closure"](spark, d).groupBy(F.col("member").alias("slug")).agg(F.array_join(F.transform(up, lambda x: x["root"]), "/").alias("path"))


@query("SELECT l_orderkey AS story, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_shipdate, l_linenumber, l_suppkey) AS curve FROM lineitem GROUP BY 1")
def a7_coverage_curve(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_suppkey")))
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("story")).agg(F.array_join(F.transform(steps, lambda x: x["l_suppkey"].cast("string")), ",").alias("curve"))


@query("WITH f AS (SELECT p_partkey AS slug, p_name AS form, FALSE AS alias FROM part UNION ALL SELECT p_partkey, lower(p_type || ' of ' || p_brand), TRUE FROM part), g AS (SELECT slug, CASE WHEN NOT alias AND form = 'red ring' THEN 0 WHEN NOT alias AND starts_with(form, 'red ring') THEN 1 WHEN alias AND starts_with(form, 'red ring') THEN 2 WHEN contains(form, 'red ring') THEN 3 END AS grade, 'red ring' AS typed FROM f UNION ALL SELECT slug, CASE WHEN NOT alias AND form = 'small' THEN 0 WHEN NOT alias AND starts_with(form, 'small') THEN 1 WHEN alias AND starts_with(form, 'small') THEN 2 WHEN contains(form, 'small') THEN 3 END, 'small' FROM f) SELECT typed, slug, min(grade) AS grade FROM g WHERE grade IS NOT NULL GROUP BY 1, 2")
def q19_suggest(spark, d):
    """Parts by name or by what they are, for two texts typed."""
    part = _t(spark, d, "part")
    forms = part.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("form"), F.lit(False).alias("alias"))
    index = GramIndex.build(forms.unionByName(part.select(F.col("p_partkey").alias("slug"), F.concat_ws(" of ", "p_type", "p_brand").alias("form"), F.lit(True).alias("alias"))))
    return index.suggest("red ring").withColumn("typed", F.lit("red ring")).unionByName(index.suggest("small").withColumn("typed", F.lit("small")))


@query(f"WITH p AS ({SQL['q3_tag_pairs'].replace('SELECT * REPLACE (month::VARCHAR AS month) FROM', 'SELECT * FROM')}), e AS (SELECT a, b, together FROM p UNION ALL SELECT b, a, together FROM p) SELECT a AS tag, b AS other, sum(together)::BIGINT AS together FROM e GROUP BY 1, 2")
def u3_related_tags(spark, d):
    """Pairs are summed over the months before both directions of each are read."""
    pairs = QUERIES["q3_tag_pairs"](spark, d).groupBy("a", "b").agg(F.sum("together").alias("together"))
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("tag"), F.col("b").alias("other")), F.struct(F.col("b").alias("tag"), F.col("a").alias("other")))).alias("e"), "together").select("e.tag", "e.other", "together")


@query("SELECT doc_id, round((coalesce(quality * 50, 0) + coalesce(toxic * 30, 0) + least(n_chars, 1000) * 0.02::DOUBLE) / (0.2::DOUBLE + CASE WHEN quality IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN toxic IS NULL THEN 0 ELSE 0.3::DOUBLE END), 6) AS score FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL")
def m5_composite(spark, d):
    """A weighted mean over the dimensions that are known: a document without labels is not scored as if they were zero."""
    rows = _t(spark, d, "documents").select("doc_id", "n_chars").filter("n_chars IS NOT NULL").join(_t(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    size = F.least("n_chars", F.lit(1000)) / 10
    return rows.select("doc_id", F.round(scores.composite([(F.col("quality") * 100, 0.5), (F.col("toxic") * 100, 0.3), (size, 0.2)]), 6).alias("score"))


@query("SELECT ts < TIMESTAMP '2024-01-10' AS late, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def z2_late_rows(spark, d):
    """What comes too late stays countable beside what is kept."""
    kept, dropped = ledger.split_late(_t(spark, d, "events"), "2024-01-10")
    count = lambda f, late: f.groupBy(F.lit(late).alias("late"), "event_type").agg(F.count("*").alias("n"))
    return count(kept, False).unionByName(count(dropped, True))


@query("SELECT user_id, event_type AS latest, ts, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1")
def q28_latest_state(spark, d):
    latest = F.max(F.struct("ts", "event_id", "event_type")).alias("x")
    return _t(spark, d, "events").groupBy("user_id").agg(latest, F.count("*").alias("n")).select("user_id", F.col("x.event_type").alias("latest"), F.col("x.ts").alias("ts"), "n")

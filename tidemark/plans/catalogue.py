"""Analytic queries over the driver's tables, each with the SQL that it must equal.

Orders stand for stories (published on o_orderdate), customers for sources, parts for tags and line items for a story's tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scores, text
from tidemark.operators import hierarchy, keyed

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str, date: str | None = None):
    """Registers a query; `date` names a date column, which both sides return as text."""

    def add(f):
        if date:
            QUERIES[f.__name__] = lambda spark, d: f(spark, d).withColumn(date, F.col(date).cast("string"))
            SQL[f.__name__] = f"SELECT * REPLACE ({date}::VARCHAR AS {date}) FROM ({sql})"
        else:
            QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tagged(spark, d) -> DataFrame:
    """A row for each story and tag: the tag is the part's brand. Both sides are distinct where an order's rows meet, so the join is."""
    items, parts, orders = _t(spark, d, "lineitem"), _t(spark, d, "part"), _t(spark, d, "orders")
    n = keyed.portions(items)
    met = lambda rows, key: (rows.repartition(n, key) if n else rows.repartition(key)).distinct()
    named = keyed.dealt(items.select("l_orderkey", "l_partkey"), n, "l_partkey").join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    named = met(named.select(F.col("l_orderkey").alias("story"), F.col("p_brand").alias("tag")), "story")
    told = met(orders.select(F.col("o_orderkey").alias("story"), F.col("o_custkey").alias("source"), F.trunc("o_orderdate", "MM").alias("month"), F.col("o_totalprice").alias("weight")), "story")
    return named.join(told, "story").select("story", "tag", "source", "month", "weight")


_TAGGED = "tagged AS (SELECT DISTINCT o_orderkey AS story, p_brand AS tag, o_custkey AS source, date_trunc('month', o_orderdate)::DATE AS month, o_totalprice AS weight FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS stories, count(DISTINCT o_custkey) AS sources, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 1", date="month")
def q1_month_totals(spark, d):
    o = _t(spark, d, "orders").withColumn("month", F.trunc("o_orderdate", "MM"))
    return o.groupBy("month").agg(F.count("*").alias("stories"), F.countDistinct("o_custkey").alias("sources"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@query(f"WITH {_TAGGED}, t AS (SELECT month, count(DISTINCT story) AS total FROM tagged GROUP BY 1), c AS (SELECT month, tag, count(*) AS stories, count(DISTINCT source) AS outlets FROM tagged GROUP BY 1, 2) SELECT month, tag, stories, outlets, round(stories::DOUBLE / total, 9) AS share, rank() OVER (PARTITION BY month ORDER BY stories DESC, tag) AS place FROM c JOIN t USING (month)", date="month")
def q2_tag_month_cube(spark, d):
    rows = _tagged(spark, d)
    totals = rows.select("story", "month").distinct().groupBy("month").agg(F.count("story").alias("total"))
    told = keyed.dealt(rows.select("month", "tag", "source"), keyed.portions(_t(spark, d, "lineitem")), "source").groupBy("month", "tag", "source").agg(F.count("*").alias("n"))
    cube = told.groupBy("month", "tag").agg(F.sum("n").alias("stories"), F.count("source").alias("outlets")).join(totals, "month")
    place = F.rank().over(Window.partitionBy("month").orderBy(F.desc("stories"), "tag"))
    return cube.select("month", "tag", "stories", "outlets", F.round(F.col("stories") / F.col("total"), 9).alias("share"), place.alias("place"))


@query(f"WITH {_TAGGED} SELECT a.month, a.tag AS a, b.tag AS b, count(*) AS together FROM tagged a JOIN tagged b ON a.story = b.story AND a.tag < b.tag GROUP BY ALL HAVING count(*) >= 3", date="month")
def q3_tag_pairs(spark, d):
    sets = _tagged(spark, d).groupBy("story", "month").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    pairs = F.flatten(F.transform("tags", lambda x: F.transform(F.filter("tags", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select("month", F.explode(pairs).alias("p")).groupBy("month", "p.a", "p.b").agg(F.count("*").alias("together")).filter("together >= 3")


@query(f"WITH {_TAGGED}, r AS (SELECT *, row_number() OVER (PARTITION BY month, tag ORDER BY weight DESC NULLS LAST, story) AS place FROM tagged) SELECT month, tag, story, place FROM r WHERE place <= 3", date="month")
def q5_exemplars(spark, d):
    place = F.row_number().over(Window.partitionBy("month", "tag").orderBy(F.col("weight").desc_nulls_last(), "story"))
    return _tagged(spark, d).withColumn("place", place).filter("place <= 3").select("month", "tag", "story", "place")


@query(f"WITH {_TAGGED}, bounds AS (SELECT max(month) AS last FROM tagged), recent AS (SELECT tag, count(*) AS stories, count(DISTINCT source) AS outlets FROM tagged, bounds WHERE month > last - INTERVAL 3 MONTH GROUP BY 1), prior AS (SELECT tag, count(DISTINCT source) AS outlets FROM tagged, bounds WHERE month <= last - INTERVAL 3 MONTH AND month > last - INTERVAL 9 MONTH GROUP BY 1) SELECT r.tag, r.stories, r.outlets, r.outlets - coalesce(p.outlets, 0) AS gain FROM recent r LEFT JOIN prior p USING (tag) WHERE r.stories >= 5 AND r.outlets >= 3")
def q9_rising(spark, d):
    rows = _tagged(spark, d)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("month").alias("last"))))  # one row
    recent = rows.filter(F.col("month") > F.add_months("last", -3)).groupBy("tag").agg(F.count("*").alias("stories"), F.countDistinct("source").alias("outlets"))
    prior = rows.filter((F.col("month") <= F.add_months("last", -3)) & (F.col("month") > F.add_months("last", -9))).groupBy("tag").agg(F.countDistinct("source").alias("before"))
    return recent.join(prior, "tag", "left").filter("stories >= 5 AND outlets >= 3").select("tag", "stories", "outlets", (F.col("outlets") - F.coalesce("before", F.lit(0))).alias("gain"))


@query("WITH days AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day) SELECT day, count(event_id) AS n, count(*) FILTER (event_type = 'error') AS errors FROM days LEFT JOIN events ON ts::DATE = day GROUP BY 1", date="day")
def q13_daily_series(spark, d):
    e = _t(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type")
    days = e.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    counts = e.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return days.join(counts, "day", "left").na.fill(0, ["n", "errors"])


@query("SELECT c_nationkey AS nation, count(o_orderkey) AS stories, median(o_totalprice) AS typical, CASE WHEN count(o_orderkey) >= 20 THEN round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(o_orderkey), 2) END AS final_share FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q26_source_quality(spark, d):
    rows = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = rows.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("o_orderkey").alias("stories"), F.median("o_totalprice").alias("typical"), F.count_if(F.col("o_orderstatus") == "F").alias("final"))
    return out.select("nation", "stories", "typical", scores.floored_share(F.col("final"), F.col("stories")).alias("final_share"))


@query("WITH RECURSIVE tree AS (SELECT 'r' || r_regionkey AS slug, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), c AS (SELECT slug AS root, slug AS member, 0 AS depth FROM tree UNION ALL SELECT c.root, t.slug, depth + 1 FROM c JOIN tree t ON t.parent = c.member WHERE depth < 12) SELECT root, member, min(depth) AS depth FROM c GROUP BY 1, 2")
def c13_closure(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = _t(spark, d, "region").select(name("r", "r_regionkey").alias("slug"), F.lit(None).cast("string").alias("parent"))
    tree = tree.unionByName(_t(spark, d, "nation").select(name("n", "n_nationkey").alias("slug"), name("r", "n_regionkey").alias("parent")))
    return hierarchy.closure(tree.unionByName(_t(spark, d, "supplier").select(name("s", "s_suppkey").alias("slug"), name("n", "s_nationkey").alias("parent"))))


@query("WITH k AS (SELECT sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS content, doc_id FROM documents) SELECT content, min(doc_id) AS keeper, count(*) AS members FROM k GROUP BY 1")
def c1_exact_duplicates(spark, d):
    keyed_docs = _t(spark, d, "documents").select(F.sha2(text.compare_form(F.col("text")), 256).alias("content"), "doc_id")
    return keyed_docs.groupBy("content").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("members"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR was IS DISTINCT FROM event_type")
def k12_changes(spark, d):
    return keyed.changes(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def k2_insert_if_absent(spark, d):
    have = _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return keyed.insert_if_absent(have, _t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("WITH j AS (SELECT event_type, (props->>'k')::BIGINT AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM j GROUP BY 1")
def s19_json_counters(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j6_never_produced(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("WITH a AS (SELECT n_regionkey AS r, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), b AS (SELECT n_regionkey AS r, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey > 0 GROUP BY 1) SELECT coalesce(a.r, b.r) AS region, coalesce(suppliers, 0) AS suppliers, coalesce(customers, 0) AS customers FROM a FULL JOIN b ON a.r = b.r")
def j4_full_outer(spark, d):
    nation = _t(spark, d, "nation")
    a = _t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("suppliers"))
    b = _t(spark, d, "customer").join(nation.filter("n_regionkey > 0"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("customers"))
    return a.join(b, "region", "full").na.fill(0)


@query("WITH s AS (SELECT o_orderkey, o_custkey, unnest([1, 6, 24, 168]) AS hours, o_orderdate FROM orders), m AS (SELECT l_orderkey, l_suppkey, l_shipdate FROM lineitem) SELECT o_orderkey, hours, 1 + count(DISTINCT l_suppkey) AS coverage FROM s LEFT JOIN m ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate + to_hours(hours) GROUP BY 1, 2")
def j16_coverage_snapshots(spark, d):
    """Distinct carriers by the time of each snapshot: members once a story, bucketed by their first offset, then cumulated."""
    m = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    hours = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 3_600_000_000
    first = o.join(m, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey", "l_suppkey").agg(F.min(hours).alias("after"))
    offsets = (1, 6, 24, 168)
    counts = first.groupBy("o_orderkey").agg(*[(1 + F.count_if(F.col("after") <= h)).alias(str(h)) for h in offsets])
    return counts.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(h).alias("hours"), F.col(str(h)).alias("coverage")) for h in offsets])).alias("s")).select("o_orderkey", "s.hours", "s.coverage")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(string_split(p, '=')[1]), '^(utm_.*|fbclid|gclid|ref|source|from)$'))), '&') AS params FROM pages")
def t11_canonical_url(spark, d):
    canon = text.canonical_url(F.col("url"))
    return _t(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"), F.regexp_extract(canon, r"\?(.*)$", 1).alias("params"))


@query("WITH a AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1) SELECT s, round(greatest(0, least(1, 1 - ln(1 + greatest(n - 1, 0)) / ln(20))), 9) AS niche, CASE WHEN n >= 600 THEN 'hot' WHEN n >= 500 THEN 'active' ELSE 'quiet' END AS badge FROM a")
def m1_niche(spark, d):
    n = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"))
    return n.select("s", F.round(scores.niche(F.col("n")), 9).alias("niche"), F.when(F.col("n") >= 600, "hot").when(F.col("n") >= 500, "active").otherwise("quiet").alias("badge"))


@query("SELECT lang, percentile_disc(0.5) WITHIN GROUP (ORDER BY len(string_split(text, ' '))) AS words, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def q27_output_audit(spark, d):
    n = F.size(F.split("text", " "))
    return _t(spark, d, "documents").withColumn("n", n).groupBy("lang").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("words"), F.countDistinct("source").alias("sources"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def z4_tumbling_windows(spark, d):
    return _t(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT DISTINCT slug, origin FROM (SELECT s_nationkey AS slug, 'supplier' AS origin FROM supplier UNION SELECT c_nationkey, 'customer' FROM customer)")
def u2_union_distinct(spark, d):
    a = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("slug"), F.lit("supplier").alias("origin"))
    return a.unionByName(_t(spark, d, "customer").select(F.col("c_nationkey").alias("slug"), F.lit("customer").alias("origin"))).distinct()

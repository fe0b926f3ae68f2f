"""Registered queries of roll-ups, series, exemplars and scores over stories (orders), sources (customers) and tags (brands)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.plans.catalogue import _TAGGED, _t, _tagged, query


def _latest(df, column="o_orderdate", name="hi"):
    """One row with the largest value of a column, to be joined to every row."""
    return F.broadcast(df.agg(F.max(column).alias(name)))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, c_mktsegment AS kind, count(*) AS stories, count(DISTINCT o_custkey) AS sources, count(*) FILTER (o_orderstatus = 'F') AS final, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2", date="month")
def q4_source_months(spark, d):
    """Orders are summed by source and month first, so the join to the sources' kinds moves sums."""
    o = _t(spark, d, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.max("o_totalprice").alias("most"))
    kinds = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"))
    rows = o.join(kinds, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("month", "kind").agg(F.sum("n").alias("stories"), F.count("*").alias("sources"), F.sum("f").alias("final"), F.max("most").alias("most"))


@query("WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS stories FROM orders GROUP BY 1), rolled AS (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS month FROM lineitem WHERE month(l_shipdate) % 2 = 0) SELECT month, stories, CASE WHEN month = (SELECT max(month) FROM m) THEN 'open' WHEN month IN (SELECT month FROM rolled) THEN 'rolled' ELSE 'pending' END AS standing FROM m", date="month")
def q6_pending_months(spark, d):
    """Months of stories without a roll-up; the last month is open and never rolled."""
    m = _t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("stories"))
    rolled = _t(spark, d, "lineitem").filter("month(l_shipdate) % 2 = 0").select(F.trunc("l_shipdate", "MM").alias("month"), F.lit(True).alias("done")).distinct()
    standing = F.when(F.col("month") == F.col("hi"), "open").when(F.col("done"), "rolled").otherwise("pending")
    return m.join(rolled, "month", "left").crossJoin(_latest(m, "month")).select("month", "stories", standing.alias("standing"))


@query(f"WITH {_TAGGED}, live AS (SELECT month, tag, count(*) AS n FROM tagged WHERE weight >= 100000 GROUP BY 1, 2), old AS (SELECT month, tag, count(*) AS n FROM tagged WHERE weight < 100000 GROUP BY 1, 2) SELECT tag, count(DISTINCT month) AS months, sum(n)::BIGINT AS stories, sum(n) FILTER (live)::BIGINT AS live FROM (SELECT *, true AS live FROM live UNION ALL SELECT *, false FROM old) GROUP BY 1")
def q7_stack_history(spark, d):
    """Live counts and archived counts as one relation."""
    rows = _tagged(spark, d)
    part = lambda where, live: rows.filter(where).groupBy("month", "tag").agg(F.count("*").alias("n")).withColumn("live", F.lit(live))
    both = part("weight >= 100000", True).unionByName(part("weight < 100000", False))
    return both.groupBy("tag").agg(F.countDistinct("month").alias("months"), F.sum("n").alias("stories"), F.sum(F.when(F.col("live"), F.col("n"))).alias("live"))


@query("WITH hi AS (SELECT max(o_orderdate) AS hi FROM orders), o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS earned FROM orders, hi WHERE o_orderdate > hi - INTERVAL 6 MONTH GROUP BY 1) SELECT c_nationkey AS platform, count(*) AS members, count(o_custkey) AS earning, coalesce(sum(n), 0)::BIGINT AS stories, round(coalesce(sum(earned), 0), 2) AS earned FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1")
def q11_earning_platforms(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    recent = o.crossJoin(_latest(o)).filter(F.col("o_orderdate") > F.col("hi") - F.expr("INTERVAL 6 MONTHS")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("earned"))
    rows = _t(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_nationkey").alias("platform"))
    return rows.agg(F.count("*").alias("members"), F.count("o_custkey").alias("earning"), F.coalesce(F.sum("n"), F.lit(0)).alias("stories"), F.round(F.coalesce(F.sum("earned"), F.lit(0.0)), 2).alias("earned"))


@query(f"WITH {_TAGGED}, m AS (SELECT tag, month, count(*) AS stories FROM tagged GROUP BY 1, 2), t AS (SELECT tag, sum(stories) AS total FROM m GROUP BY 1) SELECT tag, month, stories, round(stories::DOUBLE / total, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY stories DESC, month) AS place FROM m) JOIN t USING (tag) WHERE place = 1", date="month")
def q12_busiest_month(spark, d):
    m = _tagged(spark, d).groupBy("tag", "month").agg(F.count("*").alias("n"))
    best = m.groupBy("tag").agg(F.min(F.struct((-F.col("n")).alias("less"), "month")).alias("b"), F.sum("n").alias("total"))
    return best.select("tag", "b.month", (-F.col("b.less")).alias("stories"), F.round(-F.col("b.less") / F.col("total"), 9).alias("share"))


@query("WITH s AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), tags AS (SELECT DISTINCT l_suppkey FROM lineitem JOIN s ON l_orderkey = o_orderkey), n AS (SELECT least(2, count(*)) AS least_shared FROM tags) SELECT l_orderkey AS story, count(DISTINCT l_suppkey) AS shared FROM lineitem JOIN tags USING (l_suppkey), n, s WHERE l_orderkey <> o_orderkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= any_value(least_shared)")
def q17_related_stories(spark, d):
    """Stories that share two tags, or its only one, with the newest story."""
    items = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("story"), F.col("l_suppkey").alias("tag"))
    newest = _t(spark, d, "orders").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x")).select(F.col("x.o_orderkey").alias("story"))
    tags = items.join(newest, "story").select("tag").distinct()
    least = F.broadcast(tags.agg(F.least(F.lit(2), F.count("*")).alias("least_shared")))  # one row
    shared = items.join(tags, "tag", "left_semi").join(newest, "story", "left_anti").groupBy("story").agg(F.countDistinct("tag").alias("shared"))
    return shared.crossJoin(least).filter("shared >= least_shared").select("story", "shared")


@query("WITH hi AS (SELECT max(l_shipdate) AS hi FROM lineitem) SELECT s_nationkey AS company, count(*) AS mentions, count(*) FILTER (l_returnflag = 'R') AS announcements, count(*) FILTER (l_shipdate > hi - INTERVAL 7 DAY) AS week, count(*) FILTER (l_shipdate > hi - INTERVAL 14 DAY AND l_shipdate <= hi - INTERVAL 7 DAY) AS week_before FROM lineitem JOIN supplier ON l_suppkey = s_suppkey, hi GROUP BY 1")
def q20_companies(spark, d):
    """Mentions are summed by supplier before the join to companies."""
    items = _t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate")
    age = F.col("hi") - F.col("l_shipdate")
    week, fortnight = F.expr("INTERVAL 7 DAYS"), F.expr("INTERVAL 14 DAYS")
    counts = {"mentions": F.count("*"), "announcements": F.count_if(F.col("l_returnflag") == "R"), "week": F.count_if(age < week), "week_before": F.count_if((age < fortnight) & (age >= week))}
    sums = items.crossJoin(_latest(items, "l_shipdate")).groupBy("l_suppkey").agg(*[c.alias(k) for k, c in counts.items()])
    return sums.join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("company")).agg(*[F.sum(k).alias(k) for k in counts])


@query("WITH c AS (SELECT n_nationkey, n_regionkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT 'nation ' || n_nationkey AS slug, n AS entries FROM c UNION ALL SELECT 'region ' || n_regionkey, sum(n)::BIGINT FROM c GROUP BY n_regionkey UNION ALL SELECT 'world', sum(n)::BIGINT FROM c")
def q22_catalogue_counts(spark, d):
    """Each node's entries with those of its descendants: leaves are counted once and lifted to every ancestor."""
    leaves = _t(spark, d, "nation").join(_t(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("s_suppkey").alias("n"))
    named = lambda word, column: F.concat(F.lit(word), F.col(column).cast("string"))
    lifted = leaves.select("n", F.explode(F.array(named("nation ", "n_nationkey"), named("region ", "n_regionkey"), F.lit("world"))).alias("slug"))
    return lifted.groupBy("slug").agg(F.sum("n").alias("entries"))


@query("WITH hi AS (SELECT max(o_orderdate) AS hi FROM orders), c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS coverage FROM lineitem GROUP BY 1) SELECT o_orderkey AS story, coverage, round(coverage / greatest(epoch(hi - o_orderdate) / 3600, 0.25), 9) AS velocity FROM orders JOIN c ON l_orderkey = o_orderkey, hi")
def q29_velocity(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    coverage = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("coverage"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = (micros("hi") - micros("o_orderdate")) / 3_600_000_000
    rows = o.crossJoin(_latest(o)).join(coverage, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderkey").alias("story"), "coverage", F.round(F.col("coverage") / F.greatest(hours, F.lit(0.25)), 9).alias("velocity"))


@query("WITH hi AS (SELECT max(o_orderdate) AS hi FROM orders) SELECT o_custkey AS subject, count(*) FILTER (o_orderdate > hi - INTERVAL 30 DAY) AS stories, count(*) FILTER (o_orderdate <= hi - INTERVAL 30 DAY) AS earlier, max(o_orderdate) FILTER (o_orderdate <= hi - INTERVAL 30 DAY) AS last_earlier FROM orders, hi WHERE o_orderdate > hi - INTERVAL 210 DAY GROUP BY 1 HAVING count(*) FILTER (o_orderdate > hi - INTERVAL 30 DAY) > 0")
def q31_prior_context(spark, d):
    """Subjects of the last 30 days with what the 180 days before had on them."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("subject"), "o_orderdate")
    rows = o.crossJoin(_latest(o)).filter(F.col("o_orderdate") > F.col("hi") - F.expr("INTERVAL 210 DAYS")).withColumn("now", F.col("o_orderdate") > F.col("hi") - F.expr("INTERVAL 30 DAYS"))
    return rows.groupBy("subject").agg(F.count_if("now").alias("stories"), F.count_if(~F.col("now")).alias("earlier"), F.max(F.when(~F.col("now"), F.col("o_orderdate"))).alias("last_earlier")).filter("stories > 0")


@query("SELECT o_orderdate::DATE AS day, count(*) AS reports, max(o_orderkey) AS newest, count(DISTINCT o_orderpriority) AS fields FROM orders GROUP BY 1", date="day")
def q37_report_index(spark, d):
    o = _t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    return o.agg(F.count("*").alias("reports"), F.max("o_orderkey").alias("newest"), F.countDistinct("o_orderpriority").alias("fields"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders) SELECT o_custkey AS source, string_agg(o_orderkey, ',' ORDER BY place) AS samples FROM r WHERE place <= 3 GROUP BY 1")
def a8_samples(spark, d):
    """Three rows of each source are left before any list is built."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey"))
    top = _t(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("place")).filter("place <= 3")
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("o_orderkey").cast("string").alias("key"))))
    return top.groupBy(F.col("o_custkey").alias("source")).agg(F.array_join(listed["key"], ",").alias("samples"))


@query("SELECT user_id, bool_or(event_type = 'error') AS failed, bool_and(event_type <> 'purchase') AS never_bought, count(DISTINCT event_type) FILTER (value > 1) AS kinds FROM events GROUP BY 1")
def a10_flags(spark, d):
    e = F.col("event_type")
    return _t(spark, d, "events").groupBy("user_id").agg(F.bool_or(e == "error").alias("failed"), F.bool_and(e != "purchase").alias("never_bought"), F.countDistinct(F.when(F.col("value") > 1, e)).alias("kinds"))


@query(f"WITH {_TAGGED}, c AS (SELECT tag, count(*) AS stories FROM tagged GROUP BY 1), t AS (SELECT count(DISTINCT story) AS total FROM tagged) SELECT tag, stories, round(stories::DOUBLE / total, 9) AS share, rank() OVER (ORDER BY stories DESC, tag) AS place FROM c, t")
def w1_global_rank(spark, d):
    """The rank sees a row for each tag, not for each story; its window is as large as the vocabulary."""
    rows = _tagged(spark, d)
    c = rows.groupBy("tag").agg(F.count("*").alias("stories"))
    total = F.broadcast(rows.agg(F.countDistinct("story").alias("total")))  # one row
    return c.crossJoin(total).select("tag", "stories", F.round(F.col("stories") / F.col("total"), 9).alias("share"), F.rank().over(Window.orderBy(F.desc("stories"), "tag")).alias("place"))


@query("SELECT doc_id, keeper FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS keeper FROM documents) WHERE doc_id <> keeper")
def w5_duplicate_cull(spark, d):
    """Keepers come from partial minima, not from a window, so a text that a third of all rows repeat is no hot group."""
    rows = _t(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    keepers = rows.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(keepers, "key").filter("doc_id <> keeper").select("doc_id", "keeper")


@query("WITH hi AS (SELECT max(o_orderdate) AS hi FROM orders), l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT c_custkey AS source, round(coalesce(epoch(hi - last) / 86400 / (1 + c_nationkey), 1e9::DOUBLE), 6) AS urgency FROM customer LEFT JOIN l ON o_custkey = c_custkey, hi ORDER BY urgency DESC, source LIMIT 50")
def o6_due_queue(spark, d):
    """The 50 sources that are latest for their own interval; one never fetched comes first."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderdate")
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    rows = _t(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").crossJoin(_latest(o))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    urgency = F.coalesce((micros("hi") - micros("last")) / 86_400_000_000 / (1 + F.col("c_nationkey")), F.lit(1e9))
    return rows.select(F.col("c_custkey").alias("source"), F.round(urgency, 6).alias("urgency")).orderBy(F.desc("urgency"), "source").limit(50)


@query("SELECT doc_id, round(least(1, greatest(0, 0.35::DOUBLE * least(ln(1 + n_chars) / ln(12001), 1) + 0.5::DOUBLE * CASE lang WHEN 'en' THEN 1.0 ELSE 0.4 END::DOUBLE + 0.15::DOUBLE * (source LIKE '%1')::INTEGER)), 9) AS depth FROM documents")
def m3_depth(spark, d):
    weight = F.when(F.col("lang") == "en", 1.0).otherwise(0.4)
    return _t(spark, d, "documents").select("doc_id", F.round(scores.depth(F.col("n_chars"), weight, F.col("source").endswith("1")), 9).alias("depth"))


@query("WITH y AS (SELECT o_custkey, count(*) AS fetched, count(*) FILTER (o_orderstatus = 'F') AS kept FROM orders GROUP BY 1) SELECT o_custkey AS source, CASE WHEN kept >= fetched THEN 300 WHEN kept = 0 THEN 1200 ELSE 600 END AS interval_s, CASE WHEN kept = 0 THEN 'cold' WHEN kept >= fetched THEN 'hot' ELSE 'steady' END AS pace FROM y")
def m8_intervals(spark, d):
    """An interval of 600 s is halved where each fetch brings a story and doubled where none does."""
    y = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("fetched"), F.count_if(F.col("o_orderstatus") == "F").alias("kept"))
    hot, cold = F.col("kept") >= F.col("fetched"), F.col("kept") == 0
    return y.select("source", F.when(hot, 300).when(cold, 1200).otherwise(600).alias("interval_s"), F.when(cold, "cold").when(hot, "hot").otherwise("steady").alias("pace"))

"""Registered queries of the relational operators: joins, aggregates, windows, set operations and dates, each on its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import joins, tallies
from tidemark.plans.catalogue import _t, query
from tidemark.plans.reader import STORIES, TAXONOMY, stories, taxonomy

_S = f"WITH {STORIES}"


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_fact_to_dimension(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS stories FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, max(l_shipdate)::DATE::VARCHAR AS last_seen FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), c AS (SELECT o_custkey AS k, count(*) AS done FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, coalesce(stories, 0) AS stories, coalesce(done, 0) AS done, last_seen FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey LEFT JOIN c ON c.k = c_custkey")
def j2_measures_on_a_spine(spark, d):
    """Every customer with three measures that were aggregated before they join."""
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    a = o.groupBy("c_custkey").agg(F.count("*").alias("stories"))
    b = o.join(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey").groupBy("c_custkey").agg(F.max("l_shipdate").cast("date").cast("string").alias("last_seen"))
    c = o.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.count("*").alias("done"))
    return joins.on_spine(_t(spark, d, "customer").select("c_custkey"), "c_custkey", [a, b, c]).na.fill(0, ["stories", "done"])


@query("SELECT c_custkey, count(o_orderkey) AS stories FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j3_empties_count_zero(spark, d):
    return joins.counted(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "stories")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j5_semi(spark, d):
    urgent = _t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS age FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY")
def j7_one_row_bounds(spark, d):
    """Orders of the last 180 days; the bounds are one row, read first, so the filter on dates reaches the scan."""
    o = _t(spark, d, "orders")
    last = o.agg(F.max("o_orderdate")).first()[0]
    return o.filter(F.col("o_orderdate") >= F.lit(last) - F.expr("INTERVAL 180 DAYS")).select("o_orderkey", F.date_diff(F.lit(last), "o_orderdate").cast("long").alias("age"))


@query(f"{_S}, u AS (SELECT c_custkey AS account, ['Brand#' || (1 + c_custkey % 25), 'Brand#' || (1 + c_custkey % 7)] AS wanted, CASE WHEN c_custkey % 3 = 0 THEN 'pricing' END AS word FROM customer WHERE c_custkey % 10 = 0) SELECT DISTINCT account, id FROM u, stories WHERE list_has_any(tags, wanted) AND importance >= 8 OR importance >= 8 AND word IS NOT NULL AND contains(lower(title), word)")
def j8_accounts_by_stories(spark, d):
    """What accounts want by tag or by word: tags meet in an equi-join, words in another, never every account with every story."""
    c = _t(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("account"))
    brand = lambda n: F.concat(F.lit("Brand#"), (1 + F.col("account") % n).cast("string"))
    tags = c.select("account", F.explode(F.array(brand(25), brand(7))).alias("tag"))
    words = c.filter("account % 3 = 0").select("account", F.lit("pricing").alias("word"))
    return joins.wanted(stories(spark, d).filter("importance >= 8"), tags, words)


@query(f"{_S} SELECT id, unnest(tags) AS tag, ['low', 'high'][1 + (substr(tag, 7)::INT % 2)] AS half FROM stories")
def j9_array_membership(spark, d):
    """A row for each story and entry of a table that its array names."""
    entries = _t(spark, d, "part").select(F.col("p_brand").alias("tag")).distinct().withColumn("half", F.when(F.substring("tag", 7, 9).cast("int") % 2 == 0, "low").otherwise("high"))
    return joins.members(stories(spark, d), "tags", entries, "tag").select("id", "tag", "half")


@query(f"WITH RECURSIVE {STORIES}, {TAXONOMY}, c AS (SELECT slug AS root, slug AS member FROM tax UNION SELECT c.root, t.slug FROM c JOIN tax t ON t.parent = c.member) SELECT root, count(DISTINCT id) AS stories FROM c JOIN (SELECT id, unnest(tags) AS member FROM stories) USING (member) GROUP BY 1")
def j10_families(spark, d):
    """Stories of each root and all that is below it, every story once."""
    from tidemark.operators.hierarchy import closure

    return joins.members(stories(spark, d), "tags", closure(taxonomy(spark, d)), "member").groupBy("root").agg(F.countDistinct("id").alias("stories"))


@query("SELECT c_custkey, n, total FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') ON TRUE")
def j11_lateral_aggregate(spark, d):
    """An aggregate for every outer row, by grouping once and joining."""
    o = _t(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '2000-01-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return _t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["n"])


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON TRUE")
def j12_lateral_latest(spark, d):
    return joins.latest(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query(f"{_S} SELECT id, unnest(companies) AS company FROM stories")
def j13_flatten(spark, d):
    return stories(spark, d).select("id", F.explode("companies").alias("company"))


@query(f"{_S} SELECT a.c AS a, b.c AS b, count(*) AS together FROM (SELECT id, unnest(companies) AS c FROM stories) a JOIN (SELECT id, unnest(companies) AS c FROM stories) b ON a.id = b.id AND a.c < b.c GROUP BY ALL")
def j14_pairs(spark, d):
    """Companies named together. Pairs arise within a story's row, so only their partial sums are shuffled."""
    return stories(spark, d).select(F.explode(tallies.pairs("companies")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("together"))


@query("WITH days AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1995-03-31', INTERVAL 1 DAY))::DATE AS day) SELECT day, count(o_orderkey) AS stories FROM days LEFT JOIN orders ON date_trunc('day', o_orderdate) = day GROUP BY 1", date="day")
def j17_calendar(spark, d):
    """Counts by day with the days that have none."""
    n = _t(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1995-01-01' AND o_orderdate < TIMESTAMP_NTZ '1995-04-01'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("stories"))
    return dates.calendar(spark, "1995-01-01", "1995-03-31", "1 day", "day").join(n, "day", "left").na.fill(0, ["stories"])


@query("WITH names AS (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation UNION SELECT n_nationkey, 'n' || n_nationkey FROM nation), asked AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'N' || c_nationkey ELSE 'nowhere' END AS name FROM customer) SELECT c_custkey, k FROM asked LEFT JOIN names ON lower(asked.name) = names.name")
def j19_by_name_or_alias(spark, d):
    """Names to the entries that have them as a name or alias, whatever their case."""
    entries = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("aliases"))
    k = F.col("c_nationkey").cast("string")
    asked = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("NATION_"), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("N"), k)).otherwise("nowhere").alias("asked"))
    return joins.by_name(asked, "asked", entries, "k").select("c_custkey", "k")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_discount) AS least, max(l_discount) AS most, round(avg(l_extendedprice), 4) AS typical FROM lineitem GROUP BY 1, 2")
def a1_grouped(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_discount").alias("least"), F.max("l_discount").alias("most"), F.round(F.avg("l_extendedprice"), 4).alias("typical"))


@query("SELECT o_custkey, count(*) AS stories, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, sum(o_totalprice) FILTER (o_orderstatus = 'P') IS NULL AS none_pending FROM orders GROUP BY 1")
def a2_filtered_counts(spark, d):
    is_ = lambda c, v: F.col(c) == v
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("stories"), F.count_if(is_("o_orderstatus", "F")).alias("done"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.sum(F.when(is_("o_orderstatus", "P"), F.col("o_totalprice"))).isNull().alias("none_pending"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS tags, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def a3_distinct_counts(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("tags"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30 AND count(DISTINCT l_suppkey) >= 5")
def a4_having(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("s")).filter("n > 30 AND s >= 5").select("l_partkey", "n")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS typical, round(quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'F'), 4) AS typical_done FROM orders GROUP BY 1")
def a5_medians(spark, d):
    """Medians, one of them over some of the rows."""
    return _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice)"), 4).alias("typical"), F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) FILTER (WHERE o_orderstatus = 'F')"), 4).alias("typical_done"))


@query("SELECT l_linestatus, quantile_disc(l_quantity, 0.5) AS half, quantile_disc(l_quantity, 0.9) AS most FROM lineitem GROUP BY 1")
def a6_discrete_percentiles(spark, d):
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY l_quantity)")
    return _t(spark, d, "lineitem").groupBy("l_linestatus").agg(at(0.5).alias("half"), at(0.9).alias("most"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS kinds FROM orders GROUP BY 1")
def a9_distinct_list(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@query("WITH j AS (SELECT event_type, (props->>'k')::BIGINT AS k FROM events) SELECT event_type, coalesce(sum(k), 0)::BIGINT AS total, coalesce(sum(k) FILTER (k >= 50), 0)::BIGINT AS large, CASE WHEN count(k) >= 20 THEN round(100.0::DOUBLE * count(*) FILTER (k >= 50) / count(k), 2) END AS share FROM j GROUP BY 1")
def a12_json_counters(spark, d):
    """Sums over counters kept as JSON; missing counters are 0, a share needs twenty rows."""
    k = F.get_json_object("props", "$.k").cast("long")
    a = _t(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("k") >= 50, F.col("k"))), F.lit(0)).alias("large"), F.count_if(F.col("k") >= 50).alias("m"), F.count("k").alias("n"))
    return a.select("event_type", "total", "large", tallies.share(F.col("m"), F.col("n"), 20).alias("share"))


@query("SELECT count(*) AS n, min(o_orderdate)::DATE::VARCHAR AS first_day, max(o_orderdate)::DATE::VARCHAR AS last_day, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders")
def a13_global(spark, d):
    day = lambda f: f("o_orderdate").cast("date").cast("string")
    return _t(spark, d, "orders").agg(F.count("*").alias("n"), day(F.min).alias("first_day"), day(F.max).alias("last_day"), F.countDistinct(F.trunc("o_orderdate", "MM")).alias("months"))


@query("SELECT s_suppkey, count(l_orderkey) AS n, CASE WHEN count(l_orderkey) >= 20 THEN round(100.0::DOUBLE * count(*) FILTER (l_returnflag = 'R') / count(l_orderkey), 2) END AS returned FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def a14_floored_share(spark, d):
    """A share only where there is evidence enough."""
    rows = _t(spark, d, "lineitem")
    a = _t(spark, d, "supplier").join(rows, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return a.select("s_suppkey", "n", tallies.share(F.col("r"), F.col("n"), 20).alias("returned"))


@query("SELECT date_trunc('day', ts)::DATE AS day, count(*) AS seen, count(*) FILTER (event_type = 'click') AS clicked, count(*) FILTER (event_type = 'purchase') AS kept, count(*) FILTER (event_type = 'error') AS refused FROM events GROUP BY 1", date="day")
def a15_daily_funnel(spark, d):
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    return _t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("seen"), of("click").alias("clicked"), of("purchase").alias("kept"), of("error").alias("refused"))


@query("WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1, 2) SELECT month, kind, round(n::DOUBLE / sum(n) OVER (PARTITION BY month), 9) AS share FROM m", date="month")
def a16_share_of_total(spark, d):
    n = _t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    total = n.groupBy("month").agg(F.sum("n").alias("total"))
    return n.join(total, "month").select("month", "kind", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query(f"{_S}, why AS (SELECT source, unnest(list_filter([CASE WHEN superseded_by IS NOT NULL THEN 'duplicate' END, CASE WHEN is_tech = FALSE THEN 'off_topic' END, CASE WHEN dismissed_at IS NOT NULL THEN 'dismissed' END, CASE WHEN lang <> 'en' AND title_en IS NULL THEN 'language' END], lambda x: x IS NOT NULL)) AS reason FROM stories) SELECT source, reason, count(*) AS n FROM why GROUP BY 1, 2")
def a17_tallies(spark, d):
    """How often each source's stories fall under each reason; a story may fall under several."""
    reasons = {"duplicate": F.col("superseded_by").isNotNull(), "off_topic": ~F.col("is_tech"), "dismissed": F.col("dismissed_at").isNotNull(), "language": (F.col("lang") != "en") & F.col("title_en").isNull()}
    return tallies.tally(stories(spark, d), ["source"], reasons)


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_size DESC NULLS LAST, p_partkey) AS place FROM part QUALIFY place <= 3")
def w2_three_of_each(spark, d):
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc_nulls_last(), F.col("p_size").desc_nulls_last(), "p_partkey"))
    return _t(spark, d, "part").select("p_brand", "p_partkey", place.cast("long").alias("place")).filter("place <= 3")


@query("SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS keeper FROM events")
def w4_keepers(spark, d):
    """The first event of each user and kind, beside every one."""
    return tallies.keepers(_t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id").select("event_id", "keeper")


@query("WITH c AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS kinds, list_sort(list(DISTINCT o_orderstatus)) AS states FROM orders GROUP BY 1) SELECT o_custkey, len(list_intersect(kinds, ['1-URGENT', '2-HIGH', '5-LOW'])) AS shared, array_to_string(list_sort(list_intersect(states, ['F', 'P'])), ',') AS states FROM c")
def u4_intersection(spark, d):
    c = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("kinds"), F.collect_set("o_orderstatus").alias("states"))
    some = lambda *x: F.array(*map(F.lit, x))
    return c.select("o_custkey", F.size(F.array_intersect("kinds", some("1-URGENT", "2-HIGH", "5-LOW"))).cast("long").alias("shared"), F.array_join(F.sort_array(F.array_intersect("states", some("F", "P"))), ",").alias("states"))


@query("WITH c AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(states, ['F', 'seen']))), ',') AS states FROM c")
def u5_append_if_absent(spark, d):
    c = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("states"))
    return c.select("o_custkey", F.array_join(F.sort_array(F.array_union("states", F.array(F.lit("F"), F.lit("seen")))), ",").alias("states"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate)::DATE::VARCHAR AS day, date_trunc('week', o_orderdate)::DATE::VARCHAR AS week, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month FROM orders")
def d1_truncated(spark, d):
    """Days, ISO weeks from Monday, and months."""
    return _t(spark, d, "orders").select("o_orderkey", *[F.date_trunc(unit, "o_orderdate").cast("date").cast("string").alias(unit) for unit in ("day", "week", "month")])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-01' - to_days((20 + o_custkey % 30)::INT) AND o_orderdate <= TIMESTAMP '2001-06-01' - to_months(1) + to_days(15)")
def d2_intervals(spark, d):
    """A window whose length a column gives."""
    now = F.lit("2001-06-01").cast("timestamp_ntz")
    at = F.col("o_orderdate")
    return _t(spark, d, "orders").filter((at > now - F.make_interval(days=(20 + F.col("o_custkey") % 30).cast("int"))) & (at <= now - F.expr("INTERVAL 1 MONTH") + F.expr("INTERVAL 15 DAY"))).select("o_orderkey")


@query("SELECT event_id, round(epoch(ts), 3) AS seconds, extract(day FROM ts)::INT AS day, date_diff('day', ts::DATE, DATE '2024-02-01')::INT AS days_left FROM events")
def d3_extracted(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3).alias("seconds"), F.dayofmonth("ts").alias("day"), F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("days_left"))


@query("WITH l AS (SELECT c_custkey AS field, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT field, strftime(greatest(coalesce(last, TIMESTAMP '2001-07-25'), TIMESTAMP '2001-07-25'), '%Y-%m-%d %H:%M:%S') AS begins FROM l WHERE last IS NULL OR last < TIMESTAMP '2001-08-01'")
def d5_briefing_windows(spark, d):
    """Where each field's next briefing begins: at its last one, at most seven days back; the first one goes back seven days."""
    last = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("field")).agg(F.max("o_orderdate").alias("last"))
    now = F.lit("2001-08-01").cast("timestamp_ntz")
    return last.filter(F.col("last").isNull() | (F.col("last") < now)).select("field", F.date_format(dates.window_start(F.col("last"), now), "yyyy-MM-dd HH:mm:ss").alias("begins"))


@query("WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-2-3' WHEN 2 THEN 'soon' WHEN 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS s FROM events) SELECT event_id, CASE WHEN regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(s AS DATE) END::VARCHAR AS day FROM s")
def d6_strict_dates(spark, d):
    """Days of the form 2024-01-31 that exist; all else is null."""
    k = F.col("event_id") % 5
    s = F.when(k == 0, "2024-02-30").when(k == 1, "2024-2-3").when(k == 2, "soon").when(k == 4, F.date_format("ts", "yyyy-MM-dd"))
    return _t(spark, d, "events").select("event_id", dates.strict_date(s).cast("string").alias("day"))


@query(f"{_S} SELECT id, list_has_any(tags, ['Brand#1', 'Brand#2']) AS shares, list_has_all(tags, ['Brand#3', 'Brand#4']) AS holds, len(tags) AS n, array_to_string(tags[1:2], '+') AS head FROM stories")
def r1_array_algebra(spark, d):
    some = lambda *x: F.array(*map(F.lit, x))
    return stories(spark, d).select("id", F.arrays_overlap("tags", some("Brand#1", "Brand#2")).alias("shares"), tallies.contains_all(F.col("tags"), some("Brand#3", "Brand#4")).alias("holds"), F.size("tags").cast("long").alias("n"), F.array_join(F.slice("tags", 1, 2), "+").alias("head"))


@query(f"{_S}, c AS (SELECT id, array_to_string(companies, ',') AS csv FROM stories) SELECT id, csv, len(string_split(csv, ',')) AS n FROM c")
def r2_csv(spark, d):
    """Arrays as comma-separated text and back."""
    return stories(spark, d).select("id", F.array_join("companies", ",").alias("csv")).withColumn("n", F.size(F.split("csv", ",")).cast("long"))


@query("SELECT event_id, (props->>'k')::INT AS k, (props->>'missing') IS NULL AS missing FROM events")
def n1_json_keys(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("missing"))

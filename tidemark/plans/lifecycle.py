"""Registered queries of keyed writes, guards, reader states, due work and registry upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import hierarchy
from tidemark.operators.tables import Table, roll_up, shared_folder
from tidemark.plans.catalogue import _t, query
from tidemark.plans.trends import _latest

_MONTH = "date_trunc('month', o_orderdate)::DATE AS month"


@query("WITH n AS (SELECT l_suppkey, count(*) AS items, max(l_shipdate) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT s_suppkey, CASE WHEN items IS NULL THEN s_acctbal ELSE round(s_acctbal - items, 2) END AS balance, coalesce(items, 0) AS items, last FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey")
def k5_update_from(spark, d):
    """A written table, changed by an update from a subquery, and read back; nations without such a supplier are not written again."""
    t = Table(spark, shared_folder(spark, "suppliers"), "s_nationkey")
    none = F.lit(None).cast("timestamp_ntz")
    t.replace(_t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.lit(0).cast("long").alias("items"), none.alias("last"), "s_nationkey"))
    n = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("_n"), F.max("l_shipdate").alias("_last"))
    t.update(n, ["s_suppkey"], {"balance": F.round(F.col("balance") - F.col("_n"), 2), "items": F.col("_n"), "last": F.col("_last")})
    return t.read().drop("s_nationkey")


@query(f"WITH o AS (SELECT {_MONTH}, o_orderstatus FROM orders), rolled AS (SELECT month, count(*) FILTER (o_orderstatus = 'F') AS stories FROM o GROUP BY 1), dirty AS (SELECT month, count(*) AS stories FROM o GROUP BY 1 HAVING bool_or(o_orderstatus = 'P')) SELECT month, stories, false AS rewritten FROM rolled WHERE month NOT IN (SELECT month FROM dirty) UNION ALL SELECT month, stories, true FROM dirty", date="month")
def k6_month_rewrite(spark, d):
    """A written cube whose dirty months are computed anew and replaced, the others left as they are; read back."""
    month = F.trunc("o_orderdate", "MM")
    items, cube = (Table(spark, shared_folder(spark, name), "month") for name in ("items", "months"))
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", month.alias("month"))
    count = lambda late: [F.count("*").alias("stories"), F.lit(late).alias("rewritten")]
    items.append(o.filter("o_orderstatus = 'F'"))
    cube.replace(items.read().groupBy("month").agg(*count(False)).unionByName(o.groupBy("month").agg(F.count_if(F.col("o_orderstatus") == "F").alias("stories"), F.lit(False).alias("rewritten")).filter("stories = 0")))
    items.append(o.filter("o_orderstatus <> 'F'"))
    roll_up(items, cube, "month", count(True), o.filter("o_orderstatus = 'P'").select("month"), o.select("month").filter("false"))
    return cube.read().select("month", "stories", "rewritten")


@query("SELECT l_suppkey, count(*) AS left_over FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1")
def k8_orphans(spark, d):
    """What a sweep of orphans takes from a written table, by supplier: its rows before less those after."""
    t = Table(spark, shared_folder(spark, "members"), "l_linestatus")
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus")
    t.append(rows)
    t.sweep(_t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    left = rows.select("l_suppkey", F.lit(1).alias("n")).unionByName(t.read().select("l_suppkey", F.lit(-1).alias("n")))
    return left.groupBy("l_suppkey").agg(F.sum("n").alias("left_over")).filter("left_over > 0")


@query("WITH c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT CASE WHEN o_orderstatus = 'P' THEN 'unrolled' WHEN o_orderpriority LIKE '1%' THEN 'favourite' WHEN l_orderkey IS NOT NULL THEN 'has_children' ELSE 'deletable' END AS guard, count(*) AS n FROM orders LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY 1")
def k11_deletion_guards(spark, d):
    children = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("parent")).distinct()
    guard = F.when(F.col("o_orderstatus") == "P", "unrolled").when(F.col("o_orderpriority").startswith("1"), "favourite").when(F.col("parent"), "has_children").otherwise("deletable")
    return _t(spark, d, "orders").join(children, "o_orderkey", "left").groupBy(guard.alias("guard")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS unread FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def f2_unread(spark, d):
    read = _t(spark, d, "labels").select("doc_id")
    return _t(spark, d, "documents").select("doc_id", "source").join(read, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("unread"))


@query("SELECT o_orderpriority AS field, count(*) AS stories, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS unfinished FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-06-30' + INTERVAL 1 DAY AND o_totalprice >= 1000 GROUP BY 1")
def f12_inclusive_range(spark, d):
    """From 1 January to 30 June, both included; the bounds are constants, so the scan gets them."""
    o = _t(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1995-01-01' AND o_orderdate < TIMESTAMP_NTZ '1995-07-01' AND o_totalprice >= 1000")
    return o.groupBy(F.col("o_orderpriority").alias("field")).agg(F.count("*").alias("stories"), F.count_if(~F.col("o_orderstatus").eqNullSafe("F")).alias("unfinished"))


@query("WITH hi AS (SELECT max(o_orderdate) AS hi FROM orders), f AS (SELECT o_custkey AS tag, min(o_orderdate) AS first_at, count(*) AS stories FROM orders GROUP BY 1) SELECT tag, stories, first_at > hi - INTERVAL 24 MONTH AS fresh, stories <= 4 AS rare FROM f, hi WHERE first_at > hi - INTERVAL 24 MONTH OR stories <= 4")
def f16_fresh_or_rare(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("tag"), "o_orderdate")
    f = o.groupBy("tag").agg(F.min("o_orderdate").alias("first_at"), F.count("*").alias("stories")).crossJoin(_latest(o))
    f = f.select("tag", "stories", (F.col("first_at") > F.col("hi") - F.expr("INTERVAL 24 MONTHS")).alias("fresh"), (F.col("stories") <= 4).alias("rare"))
    return f.filter("fresh OR rare")


@query("WITH u AS (SELECT c_custkey AS account, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'notable' ELSE 'critical' END AS volume FROM customer) SELECT account, volume, count(o_orderkey) AS stories FROM u LEFT JOIN orders ON o_custkey = account AND CASE volume WHEN 'all' THEN true WHEN 'notable' THEN o_totalprice >= 100000 ELSE o_totalprice >= 200000 END GROUP BY 1, 2")
def f20_volume_tiers(spark, d):
    """One pass over the stories counts every tier; accounts then pick theirs."""
    price = F.col("o_totalprice")
    tiers = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("all"), F.count_if(price >= 100000).alias("notable"), F.count_if(price >= 200000).alias("critical"))
    third = F.col("c_custkey") % 3
    users = _t(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.when(third == 0, "all").when(third == 1, "notable").otherwise("critical").alias("volume"))
    mine = reduce(lambda w, t: w.when(F.col("volume") == t, F.col(t)), ("notable", "critical"), F.when(F.col("volume") == "all", F.col("all")))
    return users.join(tiers, F.col("account") == F.col("o_custkey"), "left").select("account", "volume", F.coalesce(mine, F.lit(0)).alias("stories"))


@query("WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, max(ts) AS last FROM events GROUP BY 1), hi AS (SELECT max(ts) AS hi FROM events) SELECT user_id, failures, CASE WHEN failures >= 40 THEN 'dead' WHEN failures >= 10 THEN 'failing' WHEN failures >= 3 THEN 'degraded' ELSE 'ok' END AS health, last + to_seconds(least(60 * pow(2, least(failures, 6)), 86400)::BIGINT) <= hi AS due FROM f, hi")
def f21_due_sources(spark, d):
    """A source is due once its last event is older than its backed-off interval."""
    e = _t(spark, d, "events")
    f = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last")).crossJoin(_latest(e, "ts"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    due = seconds("last") + scores.backoff(F.lit(60.0), F.col("failures")) <= seconds("hi")
    return f.select("user_id", "failures", scores.health(F.col("failures")).alias("health"), due.alias("due"))


@query("SELECT n_nationkey, count(DISTINCT c_custkey) AS accounts FROM nation JOIN customer ON c_nationkey = n_nationkey OR c_custkey % 5 = n_regionkey GROUP BY 1")
def j18_either_key(spark, d):
    """A disjunctive join as two equi-joins, whose rows are united once each."""
    n = _t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 5).alias("slot"))
    hits = [n.join(c, on).select("n_nationkey", "c_custkey") for on in (F.col("c_nationkey") == F.col("n_nationkey"), F.col("slot") == F.col("n_regionkey"))]
    return hits[0].unionByName(hits[1]).distinct().groupBy("n_nationkey").agg(F.count("*").alias("accounts"))


@query("SELECT c_custkey AS account, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 1) AS story FROM customer")
def j20_first_by_priority(spark, d):
    order = F.struct("o_orderpriority", F.col("o_totalprice").isNull(), -F.col("o_totalprice"), "o_orderkey")
    best = _t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("story"))
    return _t(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("account"), "story")


@query("WITH hi AS (SELECT max(o_orderdate) AS hi FROM orders), l AS (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS entry, CASE WHEN last IS NULL THEN 'unseen' WHEN last > hi - INTERVAL 30 DAY AND n >= 10 THEN 'hot' WHEN last > hi - INTERVAL 90 DAY THEN 'active' WHEN last > hi - INTERVAL 365 DAY THEN 'quiet' ELSE 'dormant' END AS badge FROM customer LEFT JOIN l ON o_custkey = c_custkey, hi")
def v3_activity_badges(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderdate")
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    rows = _t(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").crossJoin(_latest(o))
    since = lambda days: F.col("last") > F.col("hi") - F.expr(f"INTERVAL {days} DAYS")
    badge = F.when(F.col("last").isNull(), "unseen").when(since(30) & (F.col("n") >= 10), "hot").when(since(90), "active").when(since(365), "quiet").otherwise("dormant")
    return rows.select(F.col("c_custkey").alias("entry"), badge.alias("badge"))


_WORDS = ("small", "ring")


@query("WITH h AS (SELECT p_partkey, " + " + ".join(f"contains(lower(p_name), '{w}')::INTEGER" for w in _WORDS) + " AS hits FROM part) SELECT p_partkey, hits FROM h WHERE hits = (SELECT CASE WHEN max(hits) = 2 THEN 2 ELSE 1 END FROM h) OR (hits > 0 AND (SELECT max(hits) FROM h) < 2)")
def v5_words_all_then_any(spark, d):
    """All words of a query if any entry has them, else entries with one of them."""
    hits = reduce(Column.__add__, [F.contains(F.lower("p_name"), F.lit(w)).cast("int") for w in _WORDS])
    h = _t(spark, d, "part").select("p_partkey", hits.alias("hits")).filter("hits > 0")
    most = F.broadcast(h.agg(F.max("hits").alias("most")))  # one row
    return h.crossJoin(most).filter((F.col("hits") == len(_WORDS)) | (F.col("most") < len(_WORDS))).select("p_partkey", "hits")


@query("SELECT o_custkey AS account, o_orderkey AS story FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def v8_mark_all_read(spark, d):
    """The marks that are to be inserted: open stories without one."""
    marked = _t(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").filter("o_orderstatus = 'O'").join(marked, "o_orderkey", "left_anti").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("story"))


@query("WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name), p_brand) AS entry FROM part) SELECT l_orderkey AS story, string_agg(DISTINCT entry, ',' ORDER BY entry) AS tags FROM lineitem JOIN m ON l_partkey = p_partkey GROUP BY 1")
def v12_merged_entries(spark, d):
    """Entries of one name and brand become the first of them, and facts name each entry once."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("name"), "p_brand")
    kept = part.join(part.groupBy("name", "p_brand").agg(F.min("l_partkey").alias("entry")), ["name", "p_brand"]).select("entry", "l_partkey")
    facts = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(kept, "l_partkey")
    return facts.groupBy(F.col("l_orderkey").alias("story")).agg(F.array_join(F.sort_array(F.collect_set("entry")), ",").alias("tags"))


@query("SELECT user_id AS source, count(*) AS items, CASE WHEN count(*) < 20 THEN 'too_few' WHEN count(*) FILTER (event_type = 'error') >= 0.15::DOUBLE * count(*) THEN 'refused' ELSE 'fine' END AS verdict FROM events GROUP BY 1")
def v14_source_verdicts(spark, d):
    e = _t(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("items"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return e.select("source", "items", F.when(F.col("items") < 20, "too_few").when(F.col("bad") >= 0.15 * F.col("items"), "refused").otherwise("fine").alias("verdict"))


@query("WITH seen AS (SELECT o_custkey AS link, max(o_orderdate) AS checked FROM orders GROUP BY 1), hi AS (SELECT max(o_orderdate) AS hi FROM orders), every AS (SELECT c_custkey AS link FROM customer UNION SELECT s_suppkey FROM supplier) SELECT link, checked FROM every LEFT JOIN seen USING (link), hi WHERE checked IS NULL OR checked <= hi - INTERVAL 180 DAY")
def v18_links_to_check(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("link"), "o_orderdate")
    every = _t(spark, d, "customer").select(F.col("c_custkey").alias("link")).union(_t(spark, d, "supplier").select("s_suppkey")).distinct()
    rows = every.join(o.groupBy("link").agg(F.max("o_orderdate").alias("checked")), "link", "left").crossJoin(_latest(o))
    return rows.filter(F.col("checked").isNull() | (F.col("checked") <= F.col("hi") - F.expr("INTERVAL 180 DAYS"))).select("link", "checked")


@query("SELECT event_id, left(ts::DATE::VARCHAR, CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 7 ELSE 10 END) AS shown FROM events")
def v21_partial_dates(spark, d):
    shown = F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy")).when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return _t(spark, d, "events").select("event_id", shown.alias("shown"))


_BANDS = {"1-URGENT": (0.1, 0.19), "2-HIGH": (0.15, 0.25)}


@query("WITH b(category, low, high) AS (VALUES " + ", ".join(f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (lo, hi) in _BANDS.items()) + "), c AS (SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, n::DOUBLE / sum(n) OVER () AS share FROM c) SELECT category, n, round(share, 9) AS share, CASE WHEN low IS NULL THEN 'undeclared' WHEN share < low THEN 'short' WHEN share > high THEN 'over' ELSE 'within' END AS standing FROM s LEFT JOIN b USING (category)")
def v23_category_mix(spark, d):
    c = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("total")
    standing = F.when(~F.col("category").isin(*_BANDS) | F.col("category").isNull(), "undeclared")
    for k, (lo, hi) in _BANDS.items():
        mine = F.col("category") == k
        standing = standing.when(mine & (share < lo), "short").when(mine & (share > hi), "over")
    rows = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))  # one row
    return rows.select("category", "n", F.round(share, 9).alias("share"), standing.otherwise("within").alias("standing"))


@query("WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS slug, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), c AS (SELECT slug, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.slug, depth + 1 FROM c JOIN t ON t.parent = c.slug WHERE depth < 12) SELECT depth, count(*) AS entries FROM c GROUP BY 1")
def u6_depth_histogram(spark, d):
    """Every entry's depth is its farthest root's in the closure."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = _t(spark, d, "region").select(name("r", "r_regionkey").alias("slug"), F.lit(None).cast("string").alias("parent"))
    tree = tree.unionByName(_t(spark, d, "nation").select(name("n", "n_nationkey").alias("slug"), name("r", "n_regionkey").alias("parent")))
    tree = tree.unionByName(_t(spark, d, "supplier").select(name("s", "s_suppkey").alias("slug"), name("n", "s_nationkey").alias("parent")))
    return hierarchy.closure(tree).groupBy("member").agg(F.max("depth").alias("depth")).groupBy("depth").agg(F.count("*").alias("entries"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def s24_table_counts(spark, d):
    return reduce(lambda a, b: a.unionByName(b), [_t(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES])


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%RING%' OR p_type ILIKE '%RING%' ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 40 OFFSET 10")
def s23_table_browser(spark, d):
    """One page of a table with a text in any of its text columns: the limit is the feature."""
    part = _t(spark, d, "part")
    hit = reduce(Column.__or__, [F.col(f.name).ilike("%RING%") for f in part.schema if f.dataType.simpleString() == "string"])
    return part.filter(hit).select("p_partkey", "p_name", "p_size").orderBy(F.col("p_size").desc_nulls_last(), "p_partkey").offset(10).limit(40)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey IS NOT NULL)")
def q34_untracked(spark, d):
    have = _t(spark, d, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey").join(have, "c_custkey", "left_anti")


@query("WITH homes AS (SELECT s_suppkey AS home, 'supplier' AS kind FROM supplier UNION SELECT p_partkey, 'part' FROM part), have AS (SELECT DISTINCT o_custkey AS home FROM orders), v AS (SELECT l_partkey AS home, count(*) AS volume FROM lineitem GROUP BY 1) SELECT home, kind, coalesce(volume, 0) AS volume FROM homes LEFT JOIN v USING (home) WHERE home NOT IN (SELECT home FROM have)")
def q35_homes_without_source(spark, d):
    home = lambda table, column, kind: _t(spark, d, table).select(F.col(column).alias("home"), F.lit(kind).alias("kind"))
    homes = home("supplier", "s_suppkey", "supplier").unionByName(home("part", "p_partkey", "part")).distinct()
    volume = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("home")).agg(F.count("*").alias("volume"))
    have = _t(spark, d, "orders").select(F.col("o_custkey").alias("home"))
    return homes.join(have, "home", "left_anti").join(volume, "home", "left").select("home", "kind", F.coalesce("volume", F.lit(0)).alias("volume"))


@query("WITH e AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS added, max(ts) FILTER (event_type = 'purchase') AS removed FROM events GROUP BY 1), hi AS (SELECT max(ts) AS hi FROM events) SELECT user_id, CASE WHEN added IS NULL THEN 'never' WHEN removed IS NULL OR removed < added THEN 'kept' WHEN removed > hi - INTERVAL 7 DAY THEN 'grace' ELSE 'gone' END AS state FROM e, hi")
def q38_favourites(spark, d):
    """A favourite that was taken away stays for a grace window of seven days."""
    e, of = _t(spark, d, "events"), lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    rows = e.groupBy("user_id").agg(of("view").alias("added"), of("purchase").alias("removed")).crossJoin(_latest(e, "ts"))
    kept, grace = F.col("removed").isNull() | (F.col("removed") < F.col("added")), F.col("removed") > F.col("hi") - F.expr("INTERVAL 7 DAYS")
    return rows.select("user_id", F.when(F.col("added").isNull(), "never").when(kept, "kept").when(grace, "grace").otherwise("gone").alias("state"))


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS shelf FROM orders ORDER BY shelf, o_orderpriority DESC, o_totalprice NULLS FIRST, o_orderkey LIMIT 30")
def o7_category_order(spark, d):
    shelf = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", shelf.alias("shelf"))
    return rows.orderBy("shelf", F.desc("o_orderpriority"), F.col("o_totalprice").asc_nulls_first(), "o_orderkey").limit(30).drop("o_totalprice")


@query(f"WITH o AS (SELECT {_MONTH}, count(*) AS n FROM orders GROUP BY 1), hi AS (SELECT max(month) AS hi FROM o) SELECT month, n, date_diff('month', month, hi) AS months_ago, month = hi AS open, month < hi - INTERVAL 36 MONTH AS past_retention FROM o, hi", date="month")
def d4_retention_months(spark, d):
    """Calendar months between a month and the last one, and whether 36 kept months have passed."""
    o = _t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"))
    ago = F.months_between("hi", "month").cast("long")
    return o.crossJoin(_latest(o, "month")).select("month", "n", ago.alias("months_ago"), (ago == 0).alias("open"), (ago > 36).alias("past_retention"))

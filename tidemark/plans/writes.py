"""Registered queries that write tables and read them back: appends, views, changed rows, merges and late months."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merging
from tidemark.operators.tables import Table, roll_up, shared_folder
from tidemark.plans.catalogue import _t, query


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2")
def k1_append(spark, d):
    """Two batches appended to a table, of which the second is what came back from its append."""
    t = Table(spark, shared_folder(spark, "append"), "o_orderstatus")
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    t.append(o.filter("o_orderkey % 3 = 0"))
    back = t.append(o.filter("o_orderkey % 3 = 1"))
    return t.read().filter("o_orderkey % 3 = 0").unionByName(back)


@query("SELECT o_custkey AS k, min(o_orderdate)::DATE::VARCHAR AS first_seen, max(o_orderdate)::DATE::VARCHAR AS last_seen, count(*) AS hits, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states FROM orders GROUP BY 1")
def k4_upsert_table(spark, d):
    """A keyed table after three batches of upserts: extremes, a counter and a set."""
    t = Table(spark, shared_folder(spark, "ledger"), "bucket")
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_custkey") % 4).alias("bucket"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"), F.lit(1).cast("long").alias("hits"), F.array("o_orderstatus").alias("states"), "o_orderkey")
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    for batch in range(3):
        t.upsert(o.filter(F.col("o_orderkey") % 3 == batch), ["k"], {"first_seen": F.min, "last_seen": F.max, "hits": F.sum, "states": union})
    day = lambda c: F.col(c).cast("date").cast("string").alias(c)
    return t.read().select("k", day("first_seen"), day("last_seen"), "hits", F.array_join("states", ",").alias("states"))


@query("SELECT p_brand AS slug, count(DISTINCT l_orderkey) AS stories FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def k7_refreshed_view(spark, d):
    """A view kept as a table: built on half of the rows, refreshed on all, read as it stands."""
    view = Table(spark, shared_folder(spark, "view"), "slug")
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    build = lambda r: r.groupBy(F.col("p_brand").alias("slug")).agg(F.countDistinct("l_orderkey").alias("stories"))
    view.replace(build(rows.filter("l_linenumber = 1")))
    view.replace(build(rows))
    return view.read()


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT c_custkey, c_mktsegment, CASE WHEN coalesce(n, 0) >= 10 THEN 'hot' WHEN coalesce(n, 0) >= 5 THEN 'warm' ELSE 'cold' END AS now FROM customer LEFT JOIN c ON o_custkey = c_custkey) SELECT c_mktsegment, now, count(*) AS changed FROM s WHERE now <> 'warm' GROUP BY 1, 2")
def k10_counted_changes(spark, d):
    """Rows of a written table that an update changes, counted from what was written."""
    t = Table(spark, shared_folder(spark, "states"), "c_mktsegment")
    t.replace(_t(spark, d, "customer").select("c_custkey", F.lit("warm").alias("state"), "c_mktsegment"))
    n = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("_n"))
    now = F.when(F.col("_n") >= 10, "hot").when(F.col("_n") >= 5, "warm").otherwise("cold")
    t.update(n.filter(now != "warm"), ["c_custkey"], {"state": now})
    return t.read().filter("state <> 'warm'").groupBy("c_mktsegment", F.col("state").alias("now")).agg(F.count("*").alias("changed"))


_STEP = """d{n} AS (SELECT CASE WHEN (l.never, -l.weight, l.seen, l.id) < (r.never, -r.weight, r.seen, r.id) THEN r.id ELSE l.id END AS loser, CASE WHEN (l.never, -l.weight, l.seen, l.id) < (r.never, -r.weight, r.seen, r.id) THEN l.id ELSE r.id END AS winner
  FROM p JOIN s l ON l.id = a JOIN s r ON r.id = b WHERE layer = {n} {gone})"""
_GONE = " ".join("AND a NOT IN (SELECT loser FROM d{0}) AND b NOT IN (SELECT loser FROM d{0})".format(k) for k in (1, 2))
_MERGE = f"""s AS (SELECT o_orderkey AS id, o_custkey AS source, round(o_totalprice, -5) AS weight, o_orderstatus = 'P' AS never, o_orderdate AS seen FROM orders),
p AS (SELECT id AS a, id + 1 AS b, 1 AS layer FROM s WHERE id % 4 = 0 UNION ALL SELECT id, id + 2, 2 FROM s WHERE id % 4 = 0 UNION ALL SELECT id + 1, id + 2, 3 FROM s WHERE id % 4 = 0),
{_STEP.format(n=1, gone="")}, {_STEP.format(n=2, gone=_GONE[: len(_GONE) // 2])}, {_STEP.format(n=3, gone=_GONE)},
lost AS (SELECT *, 1 AS layer FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3)"""


def _merged(spark, d):
    """Stories after merges of neighbours in three layers, so that a story may win first and lose then, or lose and be asked for again."""
    s = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), F.concat(F.lit("https://s.example/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("title"),
                                      F.round("o_totalprice", -5).alias("weight"), (F.col("o_orderstatus") == "P").alias("never_canonical"), F.col("o_orderdate").alias("collected"), F.lit(None).cast("long").alias("superseded_by"), F.lit(1).cast("long").alias("coverage"))
    pair = lambda x, y, layer: s.filter("id % 4 = 0").select((F.col("id") + x).alias("a"), (F.col("id") + y).alias("b"), F.lit(layer).alias("layer"))
    none = spark.createDataFrame([], "story long, member long, source long, url string, title string, layer int")
    return merging.merge_in_order(s, none, pair(0, 1, 1).unionByName(pair(0, 2, 2)).unionByName(pair(1, 2, 3)))


@query(f"WITH {_MERGE} SELECT s.id, winner AS superseded_by, 1 + (SELECT count(DISTINCT o.source) FROM lost m JOIN s o ON o.id = m.loser WHERE m.winner = s.id AND o.source <> s.source) AS coverage FROM s LEFT JOIN lost ON loser = s.id")
def c6_merged_stories(spark, d):
    """Losers superseded, coverage counted again."""
    return _merged(spark, d)[0].select("id", "superseded_by", "coverage")


@query(f"WITH {_MERGE} SELECT winner AS story, loser AS member, o_custkey AS source, 'https://s.example/' || loser AS url, o_orderpriority AS title, layer FROM lost JOIN orders ON o_orderkey = loser")
def c6_members(spark, d):
    """What each merge made a member: the story that it was, where it came from and the layer that found it."""
    return _merged(spark, d)[1]


@query("WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderkey FROM orders), late AS (SELECT DISTINCT month FROM o WHERE o_orderkey % 50 = 0 AND month >= DATE '1996-01-01') SELECT month, CASE WHEN month IN (SELECT month FROM late) THEN count(*) ELSE count(*) FILTER (o_orderkey % 50 <> 0) END AS stories FROM o GROUP BY 1", date="month")
def z3_late_months(spark, d):
    """Late rows make months dirty, which are rolled up anew; months before 1996 are pruned and stay as they were rolled."""
    items, cube = (Table(spark, shared_folder(spark, name), "month") for name in ("late-items", "late-months"))
    o = _t(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "MM").alias("month"))
    items.append(o.filter("o_orderkey % 50 <> 0"))
    cube.replace(items.read().groupBy("month").agg(F.count("*").alias("stories")))
    late = items.append(o.filter("o_orderkey % 50 = 0"))
    roll_up(items, cube, "month", [F.count("*").alias("stories")], late.select("month"), o.filter("month < DATE '1996-01-01'").select("month"))
    return cube.read()

"""Registered queries of streams with keyed state; each runs over its table as a stream and must equal SQL over the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.tables import shared_folder
from tidemark.plans.catalogue import _t, query
from tidemark.sources import paged
from tidemark.streaming import ledger, state


def _stream(spark, d, name):
    # a pattern, as a stream reads folders only unless it is given one
    return ledger.read_events(spark, f"{d}/{name}.parque[t]", _t(spark, d, name).schema)


def _second(micros):
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss")


_TIME = "'%Y-%m-%d %H:%M:%S'"


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type AS holder, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS n FROM events),
run AS (
  SELECT user_id, n, holder, t, t + 43200000000 AS lease_end, TRUE AS took, NULL::VARCHAR AS earlier FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, CASE WHEN e.t > r.lease_end THEN e.holder ELSE r.holder END, e.t, CASE WHEN e.t > r.lease_end OR e.holder = r.holder THEN e.t + 43200000000 ELSE r.lease_end END,
    e.t > r.lease_end + 43200000000 OR e.t > r.lease_end AND e.holder <> r.holder, CASE WHEN e.t <= r.lease_end + 43200000000 THEN r.holder END
  FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1
)
SELECT user_id, holder, earlier, strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S') AS since FROM run WHERE took
""")
def z6_stream_dedup(spark, d):
    """Who holds each user: the first kind of event for twelve hours after its last one, then the next that asks, which takes over."""
    got = state.to_table(state.leases(_stream(spark, d, "events"), "user_id", "event_type", "ts", 12), shared_folder(spark, "leases"))
    return got.select(F.col("key").cast("long").alias("user_id"), F.col("owner").alias("holder"), F.col("before").alias("earlier"), _second("at").alias("since"))


@query(f"""
WITH m AS (SELECT o_orderkey AS story, o_orderdate AS began, l_suppkey AS member, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 168 HOUR),
t AS (SELECT story, member, shipped, hours, began + hours * INTERVAL 1 HOUR AS due FROM m, (SELECT unnest([1, 6, 24, 168]) AS hours))
SELECT story, hours, strftime(due, {_TIME}) AS due, count(DISTINCT member) FILTER (shipped <= t.due) AS members FROM t WHERE due < (SELECT max(shipped) FROM m) GROUP BY story, hours, t.due
""")
def z7_snapshot_timers(spark, d):
    """Suppliers of each order's items an hour, six, a day and a week after the order, captured by timers as the stream of items passes them."""
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    items = _stream(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(orders, "l_orderkey")
    got = state.to_table(state.snapshots(items, "l_orderkey", "o_orderdate", "l_suppkey", "l_shipdate"), shared_folder(spark, "snapshots"))
    return got.select(F.col("key").cast("long").alias("story"), "hours", _second("due").alias("due"), F.col("count").alias("members"))


@query(f"""
WITH g AS (SELECT user_id, ts, event_type, coalesce(ts > lag(ts) OVER w + INTERVAL 24 HOUR, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS entry FROM g)
SELECT user_id, strftime(min(ts), {_TIME}) AS first_seen, strftime(max(ts), {_TIME}) AS last_seen, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS members, count(*) AS hits FROM e GROUP BY user_id, entry
""")
def z8_running_ledger(spark, d):
    """A ledger by user: first and last time, kinds and hits of each stretch without a day's pause, after which the state goes."""
    got = state.latest_entries(state.to_table(state.entries(_stream(spark, d, "events"), "user_id", "event_type", "ts", 24), shared_folder(spark, "ledger")))
    return got.select(F.col("key").cast("long").alias("user_id"), _second("first_seen").alias("first_seen"), _second("last_seen").alias("last_seen"), F.array_join("members", ",").alias("members"), "hits")


@query(f"""
WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOUR, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS entry FROM g)
SELECT user_id, strftime(min(ts), {_TIME}) AS began, strftime(max(ts) + INTERVAL 2 HOUR, {_TIME}) AS ended, count(*) AS n FROM e GROUP BY user_id, entry HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)
""")
def z12_sessions(spark, d):
    """Sessions of users with gaps under two hours, once the stream's time has passed their end."""
    got = state.to_table(state.sessions(_stream(spark, d, "events"), "user_id", "ts", "2 hours"), shared_folder(spark, "sessions"))
    return got.select(F.col("key").alias("user_id"), F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), "n")


@query("SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'")
def z13_views_to_purchases(spark, d):
    """Two streams joined: each view with the purchases by the same user within two hours."""
    views, purchases = (_stream(spark, d, "events").filter(F.col("event_type") == kind) for kind in ("view", "purchase"))
    got = state.to_table(state.followed(views, purchases, "user_id", "ts", "2 hours", ("event_id",)), shared_folder(spark, "followed"))
    return got.select(F.col("key").alias("user_id"), F.col("first_event_id").alias("view_id"), F.col("then_event_id").alias("purchase_id"))


@query("SELECT page_id::VARCHAR AS guid, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title, url AS link, md5(html) AS body_md5, page_id % 3 + 3 * (page_id // 96) AS page FROM pages WHERE regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) NOT SIMILAR TO '\\s*'")
def s11_paged_backfill(spark, d):
    """A backfill of all pages in three runs, each behind the cursor of the one before, so that every page comes once; pages without a title go."""
    root = shared_folder(spark, "backfill")
    page = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), "url", "html", (F.col("page_id") % 3 + 3 * F.floor(F.col("page_id") / 96)).alias("page"))
    last, found = page.agg(F.max("page")).first()[0] or 0, None
    for step in range(3):
        reach = F.col("page").between(-(-(last + 1) * step // 3), -(-(last + 1) * (step + 1) // 3) - 1)
        page.filter(reach).repartition("page").write.partitionBy("page").mode("append").json(f"{root}/in")
        found = ledger.to_table(paged.read_pages(spark, f"{root}/in", "crawl"), root)
    return found.select("guid", "title", "link", F.md5("body").alias("body_md5"), "page")

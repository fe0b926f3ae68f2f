"""Registered queries of judgements by models, job selection, and operators that stand inside others, each on its own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import extract, gates, language
from tidemark.operators import models
from tidemark.operators.tables import Table, shared_folder
from tidemark.plans.catalogue import _t, query
from tidemark.plans.reader import STORIES, stories


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'kept' WHEN o_custkey % 4 = 1 THEN NULL ELSE 'yes ' || o_custkey END AS answer, CASE o_custkey % 4 WHEN 0 THEN 'cached' WHEN 1 THEN 'invalid' ELSE 'ok' END AS outcome FROM orders")
def l1_cached_judgements(spark, d):
    """Answers from a cache, else from a model (here a function), else invalid."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("about "), F.col("o_custkey").cast("string")).alias("prompt"))
    cache = o.filter("o_custkey % 4 = 0").select("o_custkey").distinct().withColumn("answer", F.lit("kept"))

    def scorer(prompts: pd.Series) -> pd.Series:
        n = prompts.str.removeprefix("about ")
        return ("yes " + n).where(n.astype(int) % 4 != 1, "cannot say")

    return models.judged(o, "o_custkey", "prompt", cache, scorer, lambda a: a.startswith("yes")).select("o_orderkey", "answer", "outcome")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 1 THEN 'yes ' || o_custkey END AS answer, CASE WHEN o_custkey % 4 = 1 THEN 'invalid' WHEN EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < TIMESTAMP '1998-01-01') THEN 'cached' ELSE 'ok' END AS outcome FROM orders o")
def l1_kept_judgements(spark, d):
    """Two runs over one cache: what the first asked about older orders, the second finds; answers that failed are asked again."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("about "), F.col("o_custkey").cast("string")).alias("prompt"))
    cache = Table(spark, f"{shared_folder(spark, 'judgements')}/cache", "part")

    def scorer(prompts: pd.Series) -> pd.Series:
        n = prompts.str.removeprefix("about ")
        return ("yes " + n).where(n.astype(int) % 4 != 1, "cannot say")

    ask = lambda rows: models.judge_and_keep(rows, "prompt", "about", 1, cache, scorer, lambda a: a.startswith("yes"))
    ask(o.filter("o_orderdate < DATE '1998-01-01'"))
    return ask(o).select("o_orderkey", "answer", "outcome")


@query("SELECT s_suppkey AS id, s_suppkey + 1 AS other, n <= 200 AND s_suppkey % 3 = 0 AS same, CASE WHEN n > 200 THEN 'waiting' WHEN s_suppkey % 3 = 0 THEN 'cached' ELSE 'deferred' END AS outcome FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier WHERE s_suppkey % 2 = 0)")
def c4_judged_pairs(spark, d):
    """Ambiguous pairs after the answers that are known; without one a pair stays apart, and beyond two hundred it waits."""
    k = F.col("s_suppkey")
    pairs = _t(spark, d, "supplier").select(k.alias("id"), (k + 1).alias("other"), F.lit(9).alias("distance"), F.when(k % 2 == 0, "ambiguous").otherwise("title").alias("outcome"))
    cache = pairs.filter("id % 3 = 0").select(F.concat_ws("|", "id", "other").alias("pair"), F.lit("yes").alias("answer"))
    return models.ambiguous_pairs(pairs, cache)


@query("SELECT p_partkey AS id, p_partkey % 10 AS triage, CASE WHEN p_partkey % 10 >= 6 THEN (p_partkey % 10) - 1 ELSE p_partkey % 10 END AS score FROM part")
def l4_two_stages(spark, d):
    """Scores by a first look, and by a second of what the first puts at six or more."""
    return models.two_stages(_t(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", lambda k: k % 10, lambda k: k % 10 - 1)


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 1")
def l3_eligible_providers(spark, d):
    k = F.col("s_suppkey")
    return models.may_train(_t(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("trains"))).select("s_suppkey")


@query("WITH j AS (SELECT o_orderkey AS id, o_custkey AS key, substr(o_orderpriority, 1, 1)::INT AS priority, o_orderdate AS run_after, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS leased, o_orderkey % 7 AS attempts FROM orders), o AS (SELECT * FROM j WHERE run_after <= TIMESTAMP '2000-01-01' AND (leased IS NULL OR leased < TIMESTAMP '2000-01-01') AND attempts < 5 QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority DESC, run_after, id) = 1) SELECT id, key FROM o ORDER BY priority DESC, run_after, id LIMIT 40")
def z9_next_jobs(spark, d):
    """The forty jobs that would be leased next."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("run_after"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("leased_until"), (F.col("o_orderkey") % 7).alias("attempts"))
    return models.next_jobs(o, "2000-01-01", 40).select("id", "key")


@query("WITH m AS (SELECT DISTINCT l_suppkey AS seed, l_partkey % 97 AS domain FROM lineitem) SELECT domain, count(*) AS seeds FROM m WHERE domain % 5 > 0 GROUP BY 1 HAVING count(*) >= 2")
def v19_similar_domains(spark, d):
    """Domains by how many seeds name them; known ones and those with one seed are left out."""
    m = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("seed"), (F.col("l_partkey") % 97).alias("domain"))
    return m.filter("domain % 5 > 0").groupBy("domain").agg(F.countDistinct("seed").alias("seeds")).filter("seeds >= 2")


@query(f"WITH {STORIES} SELECT id, round(coverage / greatest(date_diff('hour', \"at\", TIMESTAMP '2001-08-01'), 0.25)::DOUBLE, 9) AS velocity FROM stories")
def o4_velocity(spark, d):
    hours = (F.unix_micros(F.lit("2001-08-01").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9
    return stories(spark, d).select("id", F.round(F.col("coverage") / F.greatest(hours, F.lit(0.25)), 9).alias("velocity"))


@query("SELECT o_orderkey AS id, 'live' AS part FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' UNION ALL SELECT o_orderkey, 'archive' FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def u1_union_all(spark, d):
    o = _t(spark, d, "orders")
    part = lambda where, name: o.filter(where).select(F.col("o_orderkey").alias("id"), F.lit(name).alias("part"))
    return part("o_orderdate >= TIMESTAMP_NTZ '2000-01-01'", "live").unionByName(part("o_orderdate < TIMESTAMP_NTZ '2000-01-01'", "archive"))


@query("SELECT doc_id, length(coalesce(text, '')) >= 400 AS long_enough FROM documents")
def t9_long_enough(spark, d):
    """Whether texts reach the least length of their script; those of the table are Latin."""
    return _t(spark, d, "documents").select("doc_id", language.long_enough(F.col("text")).alias("long_enough"))


@query("WITH a AS (SELECT l_suppkey AS source, count(*) AS items, count(DISTINCT l_partkey % (20 * (1 + l_suppkey % 40))) AS domains FROM lineitem GROUP BY 1) SELECT source, round(domains::DOUBLE / items, 9) AS scatter, items >= 6 AND domains > 2 AND domains > items / 3.0::DOUBLE AS linkblog FROM a")
def m10_scatter(spark, d):
    """How scattered a source's links are, and whether that makes it a linkblog."""
    a = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("items"), F.countDistinct(F.col("l_partkey") % (20 * (1 + F.col("l_suppkey") % 40))).alias("domains"))
    return a.select("source", F.round(F.col("domains") / F.col("items"), 9).alias("scatter"), gates.linkblog(F.col("items"), F.col("domains")).alias("linkblog"))


@query("SELECT page_id, 'heading' AS kind, 'Head ' || page_id AS text, 0 AS place FROM pages UNION ALL SELECT page_id, 'paragraph', 'Some words of page ' || page_id || ' that are its content.', 1 FROM pages UNION ALL SELECT page_id, 'item', 'point', 2 FROM pages")
def s14_reader_blocks(spark, d):
    """The blocks of a page, a row each."""
    i = F.col("page_id").cast("string")
    html = F.concat(F.lit("<body><nav><a href='/'>home</a></nav><article><h2>Head "), i, F.lit("</h2><p>Some words of page <b>"), i, F.lit("</b> that are its content.</p><ul><li>point</li></ul></article></body>"))
    blocks = extract.articles(_t(spark, d, "pages").select("page_id", html.alias("html")))
    return blocks.select("page_id", F.posexplode("blocks").alias("place", "b")).select("page_id", "b.kind", "b.text", "place")


@query(f"WITH {STORIES} SELECT lang AS value, count(*) AS n FROM stories WHERE event_kind = 'launch' GROUP BY 1")
def f24_lifted_clause(spark, d):
    """A facet counted with its own clause (here a language) removed and the others kept."""
    clauses = {"kind": F.col("event_kind") == "launch", "lang": F.col("lang") == "en"}
    kept = stories(spark, d)
    for name, c in clauses.items():
        kept = kept if name == "lang" else kept.filter(c)
    return kept.groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT o_custkey AS job, o_orderdate AS ran, o_orderstatus = 'F' AS ok FROM orders), l AS (SELECT job, max(ran) AS last, count(*) FILTER (NOT ok AND ran > coalesce(good, TIMESTAMP '1900-01-01')) AS failures FROM w LEFT JOIN (SELECT job AS j, max(ran) AS good FROM w WHERE ok GROUP BY 1) ON j = job GROUP BY 1) SELECT job, failures, least(pow(2, failures), 16)::BIGINT AS factor FROM l")
def z10_scheduler_backoff(spark, d):
    """Failures of each job since it last went well, and the factor by which its interval grows, sixteen at most."""
    w = _t(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderdate").alias("ran"), (F.col("o_orderstatus") == "F").alias("ok"))
    good = F.max(F.when(F.col("ok"), F.col("ran"))).over(Window.partitionBy("job"))
    w = w.withColumn("good", good).groupBy("job").agg(F.count_if(~F.col("ok") & (F.col("good").isNull() | (F.col("ran") > F.col("good")))).alias("failures"))
    return w.withColumn("factor", F.least(F.pow(F.lit(2), "failures"), F.lit(16)).cast("long"))

"""Registered queries of page extraction, near-duplicate titles and user matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import extract, text
from tidemark.operators import dedup
from tidemark.plans.catalogue import _t, query

_BLOCKS = r"list_filter(list_transform(string_split_regex({}, '</?(?:h1|p|div|article|body)[^>]*>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))), lambda x: x <> '')"

_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


@query(
    "WITH h AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '(?s)<(head|script|style|nav|footer)[^>]*>.*?</(head|script|style|nav|footer)>', '', 'g') AS html FROM pages), "
    f"b AS (SELECT page_id, {_BLOCKS.format('html')} AS whole, {_BLOCKS.format(_ARTICLE)} AS inner_blocks FROM h), "
    "s AS (SELECT *, list_sum(list_transform(inner_blocks, lambda x: length(x))) >= 0.7::DOUBLE * list_sum(list_transform(whole, lambda x: length(x))) AS narrow FROM b) "
    "SELECT page_id, CASE WHEN narrow THEN 'article' ELSE 'body' END AS container, len(CASE WHEN narrow THEN inner_blocks ELSE whole END) AS blocks, md5(array_to_string(CASE WHEN narrow THEN inner_blocks ELSE whole END, chr(10))) AS article_md5 FROM s"
)
def s13_articles(spark, d):
    """The SQL knows the table's markup; the reader does not."""
    rows = extract.articles(_t(spark, d, "pages"))
    return rows.select("page_id", "container", F.size("blocks").alias("blocks"), F.md5(F.array_join("blocks.text", "\n")).alias("article_md5"))


@query(
    "WITH o AS (SELECT o_orderkey AS story, o_orderpriority AS priority, o_orderdate, c_nationkey AS tag FROM orders JOIN customer ON o_custkey = c_custkey), "
    "u AS (SELECT s_suppkey AS account, s_nationkey AS tag, CASE WHEN s_suppkey % 2 = 0 THEN '1-URGENT' END AS unwanted FROM supplier), "
    "m AS (SELECT account, story, row_number() OVER (PARTITION BY account ORDER BY o_orderdate DESC, story DESC) AS place FROM o JOIN u USING (tag) WHERE priority IS DISTINCT FROM unwanted) SELECT account, story, place FROM m WHERE place <= 3"
)
def q30_user_matches(spark, d):
    """The three newest stories of each account's tag without its unwanted field. The newest of every tag and field are
    found before the accounts join, so an account meets a few stories of its tag, not all."""
    o = _t(spark, d, "orders").join(_t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("tag")), F.col("o_custkey") == F.col("c_custkey"))
    newest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("o_orderdate"), F.desc("story")))
    o = o.select(F.col("o_orderkey").alias("story"), F.col("o_orderpriority").alias("field"), "o_orderdate", "tag")
    few = o.withColumn("n", newest("tag", "field")).filter("n <= 3")
    u = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("account"), F.col("s_nationkey").alias("tag"), F.when(F.col("s_suppkey") % 2 == 0, "1-URGENT").alias("unwanted"))
    met = few.join(u, "tag").filter(~F.col("field").eqNullSafe(F.col("unwanted")))
    return met.withColumn("place", newest("account")).filter("place <= 3").select("account", "story", "place")


def _titled(spark, d):
    """Documents as stories, a minute apart within 50 hours of which a run takes the last 48; a title is a document's first twelve words."""
    title = text.first_words(F.coalesce("text", F.lit("")), 12)
    at = F.lit("2024-01-03").cast("timestamp_ntz") - F.make_interval(mins=(F.col("doc_id") % 3000).cast("int"))
    rows = dedup.recent(_t(spark, d, "documents").withColumn("at", at), "at", "2024-01-03", 48)
    stories = rows.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), title.alias("title")).filter("title <> ''")
    return stories.withColumn("sig", dedup.simhash(F.col("title"), text.fnv1a64))


_FNV = "list_reduce(list_transform(string_split(x, ''), lambda c: (unicode(c) & 255)::HUGEINT), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"
_SIGNED = f"""t AS (SELECT doc_id AS id, coalesce(source, '') AS source, array_to_string(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')[1:12], ' ') AS title FROM documents WHERE doc_id % 3000 < 2880),
w AS (SELECT DISTINCT title, string_split(title, ' ') AS w FROM t WHERE title <> ''),
f AS (SELECT title, unnest(list_concat(w, w, CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END)) AS x FROM w),
h AS (SELECT x, {_FNV} AS h FROM (SELECT DISTINCT x FROM f)),
b AS (SELECT title, bit, sum(CASE WHEN (h >> bit::INT) & 1 = 1 THEN 1 ELSE -1 END) AS weight FROM f JOIN h USING (x), range(64) r(bit) GROUP BY 1, 2),
s AS (SELECT title, sum(CASE WHEN weight > 0 THEN (1::HUGEINT << bit::INT) ELSE 0 END)::HUGEINT AS sig FROM b GROUP BY 1),
g AS (SELECT min(id) AS id, source, title, sig FROM t JOIN s USING (title) GROUP BY ALL)"""
_OVERLAP = "list_distinct(list_filter(string_split({}.title, ' '), lambda x: length(x) > 2))"


@query(
    f"WITH {_SIGNED}, p AS (SELECT a.id, b.id AS other, bit_count(xor(a.sig, b.sig))::INT AS distance, {_OVERLAP.format('a')} AS x, {_OVERLAP.format('b')} AS y FROM g a JOIN g b ON a.id < b.id AND a.source <> b.source "
    "AND ((a.sig & 65535) = (b.sig & 65535) OR ((a.sig >> 16) & 65535) = ((b.sig >> 16) & 65535) OR ((a.sig >> 32) & 65535) = ((b.sig >> 32) & 65535) OR ((a.sig >> 48) & 65535) = ((b.sig >> 48) & 65535))), "
    "o AS (SELECT id, other, distance, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS overlap FROM p), "
    "c AS (SELECT *, CASE WHEN distance <= 3 THEN 'auto' WHEN distance > 16 OR overlap < 0.25 THEN 'reject' WHEN overlap >= 0.6 THEN 'title' ELSE 'ambiguous' END AS outcome FROM o) SELECT * FROM c WHERE outcome <> 'reject'"
)
def c2_near_titles(spark, d):
    """Pairs of stories of different sources whose titles are near, with the outcome."""
    return dedup.near_pairs(_titled(spark, d))


@query(f"WITH {_SIGNED} SELECT t.id, min(t.id) OVER (PARTITION BY source, title) AS rep FROM t WHERE title <> ''")
def c2_title_members(spark, d):
    """(id, rep): the story that stands for each story in the pairs of c2_near_titles; every titled story has a row."""
    return dedup.first_stories(_titled(spark, d))


@query(f"WITH {_SIGNED} SELECT count(*) AS candidates FROM (SELECT DISTINCT a.id, b.id AS other FROM g a JOIN g b ON a.id < b.id AND a.source <> b.source WHERE (a.sig & 65535) = (b.sig & 65535) OR ((a.sig >> 16) & 65535) = ((b.sig >> 16) & 65535) OR ((a.sig >> 32) & 65535) = ((b.sig >> 32) & 65535) OR ((a.sig >> 48) & 65535) = ((b.sig >> 48) & 65535))")
def j15_band_join(spark, d):
    """How many pairs share one of four bands: what the exact checks have to look at."""
    return dedup.band_pairs(_titled(spark, d)).agg(F.count("*").alias("candidates"))

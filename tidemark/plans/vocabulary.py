"""Registered queries of tags and names: canonical choice, validation, discovery, placement, provenance and text keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.catalogue import _t, query

_TITLE = "array_to_string(list_slice(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), 1, 4), ' ')"


@query(f"WITH s AS (SELECT doc_id, source, doc_id // 100 AS day, {_TITLE} AS title FROM documents), k AS (SELECT title, min(doc_id) AS keeper, count(*) AS members FROM s WHERE title <> '' GROUP BY 1 HAVING count(*) > 1) SELECT s.doc_id, k.keeper FROM s JOIN k USING (title) JOIN s own ON own.doc_id = k.keeper WHERE s.doc_id <> k.keeper AND (s.source IS DISTINCT FROM own.source OR s.day = own.day)")
def c3_same_title(spark, d):
    """Stories of one title merge into the first; two of one source only if they are of the same day."""
    plain = F.split(text.compare_form(F.coalesce("text", F.lit(""))), " ")
    s = _t(spark, d, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / 100).alias("day"), F.array_join(F.slice(plain, 1, 4), " ").alias("title")).filter("title <> ''")
    own = s.groupBy("title").agg(F.min(F.struct("doc_id", "source", "day")).alias("own"), F.count("*").alias("n")).filter("n > 1")
    merge = ~F.col("source").eqNullSafe(F.col("own.source")) | (F.col("day") == F.col("own.day"))
    return s.join(own, "title").filter((F.col("doc_id") != F.col("own.doc_id")) & merge).select("doc_id", F.col("own.doc_id").alias("keeper"))


@query("SELECT o_custkey AS cluster, first(o_orderkey ORDER BY o_orderstatus = 'P', o_totalprice DESC, o_orderdate, o_orderkey) AS canonical, count(*) AS members FROM orders GROUP BY 1")
def c5_canonical_story(spark, d):
    """Never a story that may not be canonical while there is another; then the heavier, then the earlier."""
    order = F.struct(F.col("o_orderstatus") == "P", -F.col("o_totalprice"), "o_orderdate", "o_orderkey")
    return _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.min_by("o_orderkey", order).alias("canonical"), F.count("*").alias("members"))


@query("SELECT o_orderkey AS story, 1 + count(DISTINCT l_suppkey) FILTER (l_suppkey <> o_custkey) AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def c7_coverage_recount(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(_t(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    other = F.when(F.col("l_suppkey") != F.col("o_custkey"), F.col("l_suppkey"))
    return rows.groupBy(F.col("o_orderkey").alias("story")).agg((1 + F.countDistinct(other)).alias("coverage"))


_KNOWN = ("en", "de", "fr")


@query(f"SELECT lang AS value, count(*) AS uses, lang IN {_KNOWN} AS known FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def c12_validated_values(spark, d):
    """The values of a field with whether the vocabulary has them; it is joined after counting."""
    counts = _t(spark, d, "documents").filter("lang IS NOT NULL").groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("uses"))
    vocabulary = spark.createDataFrame([(k,) for k in _KNOWN], "value string").withColumn("known", F.lit(True))
    return counts.join(vocabulary, "value", "left").na.fill(False, ["known"])


_GENERIC = ("about", "which", "there", "their")


@query(f"WITH w AS (SELECT doc_id, source, unnest(list_distinct(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '))) AS name FROM documents), known AS (SELECT DISTINCT lower(regexp_extract(p_name, '^\\S+')) AS name FROM part) SELECT name, count(*) AS mentions, count(DISTINCT source) AS sources FROM w WHERE length(name) BETWEEN 5 AND 24 AND NOT regexp_matches(name, '[0-9]') AND name NOT IN {_GENERIC} AND name NOT IN (SELECT name FROM known) GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT source) >= 2")
def c14_newcomers(spark, d):
    """Names that no vocabulary has: long enough, without digits, not generic, of five stories and two sources at least."""
    words = F.array_distinct(F.split(text.compare_form(F.coalesce("text", F.lit(""))), " "))
    w = _t(spark, d, "documents").select("source", F.explode(words).alias("name")).filter(F.length("name").between(5, 24) & ~F.col("name").rlike("[0-9]") & ~F.col("name").isin(*_GENERIC))
    seen = w.groupBy("name", "source").agg(F.count("*").alias("n")).groupBy("name").agg(F.sum("n").alias("mentions"), F.count("source").alias("sources")).filter("mentions >= 5 AND sources >= 2")
    known = _t(spark, d, "part").select(F.lower(F.regexp_extract("p_name", r"^\S+", 0)).alias("name"))
    return seen.join(known, "name", "left_anti")


@query("WITH c AS (SELECT l_suppkey AS newcomer, p_brand AS category, p_type AS parent, count(*) AS votes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) SELECT newcomer, category, parent, votes FROM (SELECT *, row_number() OVER (PARTITION BY newcomer ORDER BY votes DESC, category, parent) AS place FROM c) WHERE place = 1")
def c18_placements(spark, d):
    """A newcomer is placed where most of the tags beside it are: the mode, with ties by name."""
    rows = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(_t(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    votes = rows.groupBy(F.col("l_suppkey").alias("newcomer"), "p_brand", "p_type").agg(F.count("*").alias("votes"))
    best = votes.groupBy("newcomer").agg(F.min(F.struct((-F.col("votes")).alias("less"), "p_brand", "p_type")).alias("b"))
    return best.select("newcomer", F.col("b.p_brand").alias("category"), F.col("b.p_type").alias("parent"), (-F.col("b.less")).alias("votes"))


@query("WITH p AS (SELECT source, (quality = 1) = (n_chars >= 400) AS agree FROM documents JOIN labels USING (doc_id)) SELECT source, count(*) AS compared, count(*) FILTER (agree) AS agreed, count(*) FILTER (agree) >= 0.9::DOUBLE * count(*) AS passes FROM p GROUP BY 1")
def c19_agreement(spark, d):
    """Whether two judges agree on nine in ten of what both have seen."""
    p = _t(spark, d, "documents").select("doc_id", "source", "n_chars").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    counts = p.groupBy("source").agg(F.count("*").alias("compared"), F.count_if((F.col("quality") == 1) == (F.col("n_chars") >= 400)).alias("agreed"))
    return counts.withColumn("passes", F.col("agreed") >= 0.9 * F.col("compared"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"


@query("WITH l AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), 'href=\"/([^\"/]+)\"', 1), lambda h: lower(h)))) AS target FROM pages), have AS (SELECT unnest(['the', 'and', 'to']) AS target) SELECT target, count(*) AS pages FROM l WHERE target NOT IN (SELECT target FROM have) GROUP BY 1 HAVING count(*) >= 2")
def c20_outbound_candidates(spark, d):
    """What two pages or more link to and is no source yet. The table's links are relative, so a target stands for a domain."""
    targets = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="/([^"/]+)"'), 1), F.lower)
    linked = _t(spark, d, "pages").select(F.explode(F.array_distinct(targets)).alias("target")).groupBy("target").agg(F.count("*").alias("pages")).filter("pages >= 2")
    have = spark.createDataFrame([("the",), ("and",), ("to",)], "target string")
    return linked.join(have, "target", "left_anti")


@query("WITH co AS (SELECT s_nationkey AS domain, min(s_suppkey) AS owner FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), pl AS (SELECT c_nationkey AS domain, min(c_custkey) AS owner FROM customer GROUP BY 1) SELECT n_nationkey AS domain, coalesce(co.owner, pl.owner) AS owner, CASE WHEN co.owner IS NOT NULL THEN 'company' WHEN pl.owner IS NOT NULL THEN 'platform' END AS kind FROM nation LEFT JOIN co ON co.domain = n_nationkey LEFT JOIN pl ON pl.domain = n_nationkey")
def c21_domain_owners(spark, d):
    owner = lambda df, domain, key, name: df.groupBy(F.col(domain).alias("domain")).agg(F.min(key).alias(name))
    company = owner(_t(spark, d, "supplier").filter("s_acctbal > 5000"), "s_nationkey", "s_suppkey", "company")
    platform = owner(_t(spark, d, "customer"), "c_nationkey", "c_custkey", "platform")
    rows = _t(spark, d, "nation").select(F.col("n_nationkey").alias("domain")).join(company, "domain", "left").join(platform, "domain", "left")
    return rows.select("domain", F.coalesce("company", "platform").alias("owner"), F.when(F.col("company").isNotNull(), "company").when(F.col("platform").isNotNull(), "platform").alias("kind"))


@query("SELECT CASE WHEN s_acctbal < 0 THEN 'discovered' WHEN s_suppkey % 3 = 0 THEN 'imported' ELSE 'curated' END AS origin, count(*) AS entries, count(*) FILTER (s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)) AS seen FROM supplier GROUP BY 1")
def g10_origins(spark, d):
    used = _t(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"), F.lit(True).alias("used")).distinct()
    origin = F.when(F.col("s_acctbal") < 0, "discovered").when(F.col("s_suppkey") % 3 == 0, "imported").otherwise("curated")
    return _t(spark, d, "supplier").join(used, "s_suppkey", "left").groupBy(origin.alias("origin")).agg(F.count("*").alias("entries"), F.count("used").alias("seen"))


@query("WITH m AS (SELECT l_partkey AS candidate, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 48) AS releases, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 47) AS titles FROM lineitem GROUP BY 1) SELECT candidate, releases, titles, CASE WHEN releases >= 1 THEN 'promote' WHEN titles >= 2 THEN 'record' ELSE 'wait' END AS step FROM m")
def g11_candidate_steps(spark, d):
    """One mention by a release promotes a candidate; where only titles name it, two are needed to record it."""
    mention = lambda flag, least: F.count_if((F.col("l_returnflag") == flag) & (F.col("l_quantity") > least))
    m = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("candidate")).agg(mention("R", 48).alias("releases"), mention("N", 47).alias("titles"))
    return m.withColumn("step", F.when(F.col("releases") >= 1, "promote").when(F.col("titles") >= 2, "record").otherwise("wait"))


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN 'repo' WHEN contains(lower(p_name), 'ring') THEN 'website' WHEN p_size > 10 THEN 'typed' END AS confirmed_by FROM part")
def g14_confirmations(spark, d):
    """The strongest evidence that an entry is what its name says: its repository, its website, its declared type, or none."""
    by = F.when(F.col("p_brand") == "Brand#13", "repo").when(F.contains(F.lower("p_name"), F.lit("ring")), "website").when(F.col("p_size") > 10, "typed")
    return _t(spark, d, "part").select("p_partkey", by.alias("confirmed_by"))


@query("SELECT doc_id, md5(CASE WHEN length(t) <= 400 THEN t WHEN length(regexp_extract(substr(t, 1, 400), '(?s)^(.*[.!?])', 1)) > 240 THEN regexp_extract(substr(t, 1, 400), '(?s)^(.*[.!?])', 1) ELSE rtrim(substr(t, 1, 399)) || '…' END) AS summary_md5 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def t10_summaries(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(text.summary(F.coalesce("text", F.lit("")))).alias("summary_md5"))


@query(f"SELECT page_id, array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') AS domain FROM pages")
def t14_registrable(spark, d):
    """The host's last two labels."""
    return _t(spark, d, "pages").select("page_id", text.registrable(F.col("url")).alias("domain"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '\\s+v?\\d+(\\.\\d+)*([-.][a-z0-9]+)*\\s*$', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def t22_slugs(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("SELECT doc_id, regexp_extract(text, '[vV]?\\d+\\.\\d+(?:\\.\\d+)?') AS version, length(regexp_replace(text, 'https?://\\S+', '', 'g')) AS chars_without_urls FROM documents WHERE text IS NOT NULL")
def t30_versions(spark, d):
    doc = F.col("text")
    rows = _t(spark, d, "documents").filter(doc.isNotNull())
    return rows.select("doc_id", F.regexp_extract(doc, r"[vV]?\d+\.\d+(?:\.\d+)?", 0).alias("version"), F.length(F.regexp_replace(doc, r"https?://\S+", "")).alias("chars_without_urls"))


@query(f"WITH s AS (SELECT doc_id, source, list_distinct(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS words FROM documents), v AS (SELECT source, unnest(words) AS w FROM s) SELECT source, w AS word, count(*) AS stories FROM v WHERE length(w) > 9 GROUP BY 1, 2 HAVING count(*) >= 3")
def v28_source_terms(spark, d):
    """The long words of each source with the stories that use them: a word counts once a story, and partial sums come before the shuffle."""
    words = F.filter(F.split(text.compare_form(F.coalesce("text", F.lit(""))), " "), lambda w: F.length(w) > 9)
    v = _t(spark, d, "documents").select("source", F.explode(F.array_distinct(words)).alias("word"))
    return v.groupBy("source", "word").agg(F.count("*").alias("stories")).filter("stories >= 3")


@query("SELECT p_partkey, CASE WHEN lower(p_name) = 'small ring' THEN 1.0 WHEN lower(p_name) LIKE 'small ring%' THEN 0.97 WHEN contains(' ' || lower(p_name) || ' ', ' ring ') THEN 0.8 ELSE 0.0 END::DOUBLE AS score FROM part WHERE contains(lower(p_name), 'ring')")
def q18_entity_scores(spark, d):
    """How well an entry fits the name asked for: the same, begun by it, or holding its last word."""
    name = F.lower("p_name")
    score = F.when(name == "small ring", 1.0).when(name.startswith("small ring"), 0.97).when(F.contains(F.concat(F.lit(" "), name, F.lit(" ")), F.lit(" ring ")), 0.8).otherwise(0.0)
    return _t(spark, d, "part").filter(F.contains(name, F.lit("ring"))).select("p_partkey", score.alias("score"))


@query("SELECT conv_id, string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS packed, count(*) AS turns FROM conversations GROUP BY 1")
def v28_packed_conversations(spark, d):
    """A conversation's turns in order, packed into one text; as large as the conversation is, since that is the result."""
    line = F.concat("role", F.lit(":"), F.coalesce("text", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns["line"], "\n").alias("packed"), F.count("*").alias("turns"))


@query("SELECT o_orderkey, to_json({'status': o_orderstatus, 'priority': o_orderpriority, 'day': o_orderdate::DATE::VARCHAR}) AS payload FROM orders")
def n2_json_payloads(spark, d):
    fields = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").cast("string").alias("day"))
    return _t(spark, d, "orders").select("o_orderkey", F.to_json(fields).alias("payload"))

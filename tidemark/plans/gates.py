"""Registered queries of the rule gates. Titles are made of every part's name and a phrase that its key picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import gates, language, text
from tidemark.plans.catalogue import _t, query

#: A title for each remainder of the part's key; % stands for its name.
PHRASES = [
    "Introducing %", "% v2.1.0", "What’s new in % - March", "Article: the % of tomorrow", "Back in 1995 a % cost less", "% 17.2 is out", "% adds an embedding backend", "Is % the most popular tool?", "% is the most popular tool", "% raises $40M in series B",
    "How we built %", "Billing for % ends on Friday", "% adopts the BSL licence", "% adds USDC staking", "chore(ring): release %", "1.18.0-rc2", "v3.2.1", "% nightly", "Notes from %", "We open % to all",
]
_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
_TITLES = f"titles AS (SELECT p_partkey AS id, replace({_LIST}[1 + p_partkey % {len(PHRASES)}], '%', p_name) AS title, CASE WHEN p_size % 3 = 0 THEN 'releases' ELSE 'news' END AS source_kind, p_size % 2 = 0 AS own, CASE WHEN p_size % 4 = 0 THEN 'Automated release for latest' WHEN p_size % 4 = 1 THEN repeat('note ', p_size) END AS body, CASE WHEN p_size % 5 = 0 THEN 'https://github.com/a/b/releases/tag/v1' ELSE 'https://a.example/b' END AS url FROM part)"
_q = lambda s: "'" + s.replace("'", "''") + "'"
_any = lambda col, patterns: "(" + " OR ".join(f"regexp_matches({col}, {_q(p)})" for p in patterns) + ")"


def _titles(spark, d):
    p, size = _t(spark, d, "part"), F.col("p_size")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES) + 1).cast("int"))
    body = F.when(size % 4 == 0, "Automated release for latest").when(size % 4 == 1, F.expr("repeat('note ', p_size)"))
    url = F.when(size % 5 == 0, "https://github.com/a/b/releases/tag/v1").otherwise("https://a.example/b")
    return p.select(F.col("p_partkey").alias("id"), F.replace(phrase, F.lit("%"), F.col("p_name")).alias("title"), F.when(size % 3 == 0, "releases").otherwise("news").alias("source_kind"), (size % 2 == 0).alias("own"), body.alias("body"), url.alias("url"))


_MONEY = " || ".join(f"CASE WHEN {_any('title', [p])} THEN ',{n}' ELSE '' END" for n, p in gates.MONEY)
_EVENT = " ".join(f"WHEN {_any('title', [p])}{f' AND NOT ' + _any('title', [u]) if u else ''} THEN '{v}'" for v, p, u in gates.EVENTS)


@query(f"WITH {_TITLES} SELECT id, substr({_MONEY}, 2) AS classes FROM titles")
def g4_money_classes(spark, d):
    return _titles(spark, d).select("id", F.array_join(gates.money_classes(F.col("title")), ",").alias("classes"))


@query(f"WITH {_TITLES} SELECT id, CASE WHEN {_MONEY} <> '' THEN 'change' WHEN (own OR source_kind = 'releases') AND {_any('title', [gates.VERSION_TITLE])} THEN 'release' {_EVENT} WHEN own AND NOT {_any('title', gates.ARTICLE_SHAPE)} THEN 'change' ELSE 'article' END AS kind FROM titles")
def g2_event_kinds(spark, d):
    return _titles(spark, d).select("id", gates.event_kind(F.col("title"), F.col("source_kind"), F.col("own")).alias("kind"))


@query(f"WITH {_TITLES}, v AS (SELECT *, regexp_extract(title, '{gates.VERSION}') AS version, CASE WHEN coalesce(trim(body), '') = '' THEN 0 ELSE len(string_split_regex(trim(body), '\\s+')) END AS words FROM titles) SELECT id, CASE WHEN source_kind <> 'releases' AND {_any('url', [gates.TAG_PAGE])} THEN 'tag_page' WHEN {_any('title', gates.MACHINE_TITLE)} THEN 'machine' WHEN version <> '' AND {_any('version', [gates.PRERELEASE])} THEN 'prerelease' WHEN version = '' AND {_any('title', [gates.PRERELEASE])} AND len(string_split_regex(title, '\\s+')) <= 3 THEN 'prerelease' WHEN {_any('body', gates.TEMPLATED)} THEN 'templated' WHEN words < 12 AND {_any('title', [gates.BARE_VERSION, gates.NAME_AND_VERSION])} THEN 'no_content' END AS why FROM v")
def g3_build_noise(spark, d):
    return _titles(spark, d).select("id", gates.build_noise(F.col("title"), F.col("body"), F.col("url"), F.col("source_kind") == "releases").alias("why"))


@query("WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT page_id, (host = 'example.com' OR ends_with(host, '.example.com')) AND NOT (host = 'the.example.com' OR ends_with(host, '.the.example.com')) AS refused FROM h")
def g5_refused_hosts(spark, d):
    return _t(spark, d, "pages").select("page_id", gates.host_in(text.host(F.col("url")), ["example.com"], ("the.example.com",)).alias("refused"))


@query("SELECT source, count(*) AS items, count(*) FILTER (text LIKE '%http%') AS media, count(*) >= 3 AND count(*) FILTER (text LIKE '%http%') > 0.5 * count(*) AS podcast FROM documents GROUP BY 1")
def g7_media_feeds(spark, d):
    """A feed of three items or more with media in over half of them; a link stands for an enclosure."""
    rows = _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("text").contains("http")).alias("media"))
    return rows.withColumn("podcast", (F.col("items") >= 3) & (F.col("media") > 0.5 * F.col("items")))


_KINDS = {"ring": "jewel", "red ring": "signet", "widget": "device", "gear": "device", "small": "trinket"}


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size > 40 THEN 'override' WHEN p_type = 'PROMO' THEN 'category' WHEN contains(n, ' red ring ') THEN 'signet' WHEN contains(n, ' widget ') THEN 'device' WHEN contains(n, ' small ') THEN 'trinket' WHEN contains(n, ' gear ') THEN 'device' WHEN contains(n, ' ring ') THEN 'jewel' ELSE 'tool' END AS kind FROM (SELECT *, ' ' || lower(p_name) || ' ' AS n FROM part)")
def g9_entry_kinds(spark, d):
    """Override, then category, then the longest noun of the definition, then the default."""
    noun = gates.longest_noun(F.col("p_name"), _KINDS)
    kind = F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") > 40), "override").when(F.col("p_type") == "PROMO", "category").otherwise(F.coalesce(noun, F.lit("tool")))
    return _t(spark, d, "part").select("p_partkey", kind.alias("kind"))


@query("WITH a AS (SELECT l_partkey AS slug, count(DISTINCT l_suppkey) AS sources, count(*) FILTER (l_returnflag = 'R') AS independent FROM lineitem GROUP BY 1) SELECT slug, sources, independent FROM a WHERE sources >= 2 OR independent >= 1")
def g12_emerging_gate(spark, d):
    seen = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("slug")).agg(F.countDistinct("l_suppkey").alias("sources"), F.count_if(F.col("l_returnflag") == "R").alias("independent"))
    return seen.filter("sources >= 2 OR independent >= 1")


@query("WITH hi AS (SELECT max(o_orderdate) - INTERVAL 90 DAY AS cut FROM orders), a AS (SELECT c_custkey AS source, any_value(c_acctbal) AS weight, count(o_orderkey) FILTER (o_orderdate > cut) AS kept, count(o_orderkey) AS items, count(DISTINCT o_orderpriority) AS domains FROM customer LEFT JOIN orders ON c_custkey = o_custkey, hi GROUP BY 1) SELECT source, CASE WHEN items = 0 THEN 'no_feed' WHEN items >= 6 AND domains > 2 AND domains::DOUBLE / items > 1.0::DOUBLE / 3 THEN 'linkblog' WHEN kept < 3 THEN 'too_little' WHEN weight > 5000 THEN 'promote' ELSE 'defer' END AS verdict FROM a")
def g13_auditions(spark, d):
    """Verdict on a source: no feed, a linkblog (scattered domains, M10), too little in 90 days, else promoted if of the first party."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    recent = o.crossJoin(F.broadcast(o.agg((F.max("o_orderdate") - F.expr("INTERVAL 90 DAYS")).alias("cut"))))  # one row
    a = recent.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") > F.col("cut")).alias("kept"), F.count("*").alias("items"), F.countDistinct("o_orderpriority").alias("domains"))
    rows = _t(spark, d, "customer").join(a, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["kept", "items", "domains"])
    scattered = (F.col("items") >= 6) & (F.col("domains") > 2) & (F.col("domains") / F.col("items") > 1 / 3)
    verdict = F.when(F.col("items") == 0, "no_feed").when(scattered, "linkblog").when(F.col("kept") < 3, "too_little").when(F.col("c_acctbal") > 5000, "promote").otherwise("defer")
    return rows.select(F.col("c_custkey").alias("source"), verdict.alias("verdict"))


@query("WITH named AS (SELECT c_custkey AS source, CASE WHEN c_mktsegment = 'BUILDING' THEN 'declared' END AS declared, c_nationkey, c_custkey FROM customer), research AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), company AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 9000) SELECT source, coalesce(declared, CASE WHEN r.o_custkey IS NOT NULL THEN 'research' END, CASE WHEN c.s_nationkey IS NOT NULL THEN 'company' END) AS source_type FROM named LEFT JOIN research r ON r.o_custkey = source LEFT JOIN company c ON c.s_nationkey = c_nationkey")
def g8_source_types(spark, d):
    """The first of declared, research and owning company that holds; null where none does."""
    research = _t(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey", F.lit("research").alias("research")).distinct()
    company = _t(spark, d, "supplier").filter("s_acctbal > 9000").select("s_nationkey", F.lit("company").alias("company")).distinct()
    rows = _t(spark, d, "customer").join(research, F.col("c_custkey") == F.col("o_custkey"), "left").join(company, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return rows.select(F.col("c_custkey").alias("source"), F.coalesce(F.when(F.col("c_mktsegment") == "BUILDING", "declared"), "research", "company").alias("source_type"))


_in = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_count = lambda chars: f"len(regexp_extract_all(t, '{chars}'))"
_FOREIGN = " OR ".join(f"{_count(c)} > 0.05 * length(t)" for c in [language.HANGUL, *language.FOREIGN])


@query(
    rf"WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS words FROM documents), "
    f"s AS (SELECT doc_id, t, len(words) AS n, len(list_filter(words, lambda x: list_contains({_in(language.EN)}, x)))::DOUBLE AS en, len(list_filter(words, lambda x: list_contains({_in(language.DE)}, x))) + 0.5::DOUBLE * {_count(language.UMLAUTS)} + 0.5::DOUBLE * len(list_filter(words, lambda x: length(x) > 14)) AS de, len(list_filter(words, lambda x: list_contains({_in(language.OTHER_LATIN)}, x)))::DOUBLE AS other FROM w) "
    f"SELECT doc_id, CASE WHEN trim(t) = '' THEN 'other' WHEN {_count(language.KANA)} > 0.02 * length(t) THEN 'ja' WHEN {_count(language.HAN)} > 0.15 * length(t) THEN 'zh' WHEN {_FOREIGN} THEN 'other' WHEN n < 8 THEN 'en' WHEN en + de + other = 0 THEN 'en' WHEN other > en AND other > de THEN 'other' WHEN de > en THEN 'de' ELSE 'en' END AS detected, CASE WHEN length(t) >= CASE WHEN {_count(language.CJK)} > 0.15 * length(t) THEN 150 ELSE 400 END THEN true ELSE false END AS long_enough FROM s"
)
def t15_languages(spark, d):
    doc = F.col("text")
    return _t(spark, d, "documents").select("doc_id", language.detect_language(doc)["lang"].alias("detected"), language.long_enough(doc).alias("long_enough"))

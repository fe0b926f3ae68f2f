"""Registered queries of the text, address, hash, JSON, score and search functions. Texts are documents, part names and page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import jsons, scores, search, text
from tidemark.operators import dedup
from tidemark.plans.analytics import _GRAMS
from tidemark.plans.catalogue import _t, query

_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_pick = lambda options, i: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(i, F.lit(len(options))) + 1).cast("int"))
_sql = lambda options: "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


@query(r"SELECT page_id, trim(regexp_replace('Ａ' || chr(8203) || ' ' || regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')).replace('Ａ', 'A').replace(chr(8203), '').nfc_normalize() AS title FROM pages")
def t1_normalized(spark, d):
    """Titles in compatibility form: a full-width letter and a blank of no width before each."""
    title = F.concat(F.lit("Ａ​ "), F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return _t(spark, d, "pages").select("page_id", text.normalize(title).alias("title"))


@query(f"SELECT page_id, {_NORMAL.format('regexp_extract(html, $$<title>([^<]*)</title>$$, 1)')} AS form FROM pages")
def t2_compare_form(spark, d):
    return _t(spark, d, "pages").select("page_id", text.compare_form(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("form"))


_CJK_TEXT = "coalesce(text, '') || repeat('日本語', (doc_id % 9)::INT)"


@query(f"WITH t AS (SELECT doc_id, {_CJK_TEXT} AS t FROM documents), c AS (SELECT doc_id, t, len(regexp_extract_all(t, '[぀-ゟ゠-ヿ㐀-䶿一-鿿豈-﫿가-힯]')) AS n FROM t) SELECT doc_id, n > 0 AS has_cjk, CASE WHEN length(t) > 0 THEN round(n::DOUBLE / length(t), 9) ELSE 0 END AS ratio, coalesce(n > 0.15::DOUBLE * length(t), FALSE) AS is_cjk FROM c")
def t4_cjk(spark, d):
    """Whether a text has CJK characters, their share, and whether it counts as a CJK text."""
    from tidemark.functions.language import cjk_ratio

    t = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("日本語"), (F.col("doc_id") % 9).cast("int")))
    return _t(spark, d, "documents").select("doc_id", t.rlike(text.CJK).alias("has_cjk"), F.round(cjk_ratio(t), 9).alias("ratio"), text.is_cjk(t).alias("is_cjk"))


@query(rf"WITH w AS (SELECT p_partkey, string_split(lower(p_name || ' of ' || p_type || CASE WHEN p_size % 5 = 0 THEN '' ELSE ', ' || p_brand END), ' ') AS x, string_split(trim(regexp_replace(lower(p_name || ' of ' || p_type || CASE WHEN p_size % 5 = 0 THEN '' ELSE ', ' || p_brand END), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM part) SELECT p_partkey, unnest([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) AS shingle FROM w")
def t5_shingles(spark, d):
    name = F.concat("p_name", F.lit(" of "), "p_type", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit(", "), "p_brand")))
    return _t(spark, d, "part").select("p_partkey", F.explode(text.shingles(name, 3)).alias("shingle"))


_W = "string_split(p_name, ' ')"


@query(f"WITH w AS (SELECT p_partkey, {_W} AS w FROM part), f AS (SELECT p_partkey, unnest(list_concat(w, w, [w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))])) AS feature FROM w) SELECT p_partkey, feature, count(*) AS weight FROM f GROUP BY 1, 2")
def t6_features(spark, d):
    """What a name is about and how much: words count twice, pairs once."""
    return _t(spark, d, "part").select("p_partkey", F.explode(text.features(F.col("p_name"))).alias("feature")).groupBy("p_partkey", "feature").agg(F.count("*").alias("weight"))


@query("WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' of ' || p_type), ' '), lambda w: length(w) > 2)) AS a, ['small', 'ring', 'promo', 'the'] AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS overlap FROM t")
def t8_title_overlap(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(text.title_overlap(F.concat("p_name", F.lit(" of "), "p_type"), F.lit("The small ring: PROMO!")), 9).alias("overlap"))


@query("WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') || CASE page_id % 3 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com.br' ELSE '' END AS host FROM pages), p AS (SELECT page_id, string_split(host, '.') AS p FROM h) SELECT page_id, array_to_string(list_slice(p, CASE WHEN page_id % 3 < 2 THEN -3 ELSE -2 END, -1), '.') AS domain FROM p")
def t12_registrable_domains(spark, d):
    """The registered part of hosts, some of them under suffixes of two labels."""
    i = F.col("page_id") % 3
    return _t(spark, d, "pages").select("page_id", text.registrable_domain(F.concat(text.host(F.col("url")), F.when(i == 0, ".co.uk").when(i == 1, ".com.br").otherwise(""))).alias("domain"))


_AFF = ["https://shop.example/deal/1", "https://a.example/x?tag=7", "https://go.awin.example/x", "https://b.example/go?x=1", "https://c.example/x?stage=1", "https://d.example/r/9", "not an address"]


@query(f"WITH u AS (SELECT event_id, {_sql(_AFF)}[1 + event_id % {len(_AFF)}] AS u FROM events) SELECT event_id, u LIKE '%/deal/%' OR u LIKE '%?tag=%' OR u LIKE '%.awin.%' OR u LIKE '%/r/%' AS pays FROM u")
def t13_affiliate_links(spark, d):
    return _t(spark, d, "events").select("event_id", text.affiliate(_pick(_AFF, F.col("event_id"))).alias("pays"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part) SELECT word, word IN ('cold', 'red', 'small', 'large', 'ring') AS common FROM w")
def t16_common_words(spark, d):
    """Words of the vocabulary that are ordinary ones, by a table of those."""
    ordinary = spark.createDataFrame([(w,) for w in ("cold", "red", "small", "large", "ring", "the")], "word string").withColumn("common", F.lit(True))
    return _t(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct().join(ordinary, "word", "left").na.fill(False, ["common"])


_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: (unicode(c) & 255)::HUGEINT), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"
_SIGNED = "(CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END)::BIGINT"


@query(f"WITH n AS (SELECT DISTINCT p_name FROM part), h AS (SELECT p_name, {_FNV.format('p_name')} AS h FROM n) SELECT p_name, {_SIGNED.format('h')} AS fnv FROM h")
def t17_fnv(spark, d):
    return _t(spark, d, "part").select("p_name").distinct().select("p_name", text.fnv1a64(F.col("p_name")).alias("fnv"))


_SIM = f"""n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, {_W} AS w FROM n),
f AS (SELECT p_name, unnest(list_concat(w, w, [w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))])) AS x FROM w), h AS (SELECT p_name, {_FNV.format('x')} AS h FROM f),
b AS (SELECT p_name, bit, sum(CASE WHEN (h >> bit::INT) & 1 = 1 THEN 1 ELSE -1 END) AS weight FROM h, range(64) r(bit) GROUP BY 1, 2),
s AS (SELECT p_name, sum(CASE WHEN weight > 0 THEN (1::HUGEINT << bit::INT) ELSE 0 END)::HUGEINT AS sig FROM b GROUP BY 1)"""


@query(f"WITH {_SIM} SELECT p_name, {_SIGNED.format('sig')} AS sig FROM s")
def t18_simhash(spark, d):
    """Signatures of names: words count twice and pairs once, hashed by FNV-1a."""
    return _t(spark, d, "part").select("p_name").distinct().select("p_name", dedup.simhash(F.col("p_name"), text.fnv1a64).alias("sig"))


@query(f"WITH {_SIM} SELECT a.p_name AS a, b.p_name AS b, bit_count(xor(a.sig, b.sig))::INT AS distance FROM s a, s b WHERE a.p_name < b.p_name AND b.p_name LIKE '%ring'")
def t19_distances(spark, d):
    """Bits that differ between the signatures of names; the names are a small vocabulary."""
    s = _t(spark, d, "part").select("p_name").distinct().select("p_name", dedup.simhash(F.col("p_name"), text.fnv1a64).alias("sig"))
    a, b = s.alias("a"), s.filter("p_name LIKE '%ring'").alias("b")
    return a.join(b, F.col("a.p_name") < F.col("b.p_name")).select(F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b"), F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))).alias("distance"))


@query(f"WITH {_SIM} SELECT p_name, i, ((i << 16) + ((sig >> (16 * i)::INT) & 65535))::BIGINT AS band FROM s, range(4) r(i)")
def t20_bands(spark, d):
    s = _t(spark, d, "part").select("p_name").distinct().select("p_name", dedup.simhash(F.col("p_name"), text.fnv1a64).alias("sig"))
    return s.select("p_name", F.posexplode(dedup.bands(F.col("sig"))).alias("i", "band")).select("p_name", F.col("i").cast("long").alias("i"), "band")


@query(f"SELECT page_id, sha256({_NORMAL.format('regexp_extract(html, $$<title>([^<]*)</title>$$, 1)')} || chr(10) || {_NORMAL.format('url')}) AS content FROM pages")
def t21_content_hashes(spark, d):
    return _t(spark, d, "pages").select("page_id", text.content_hash(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("url")).alias("content"))


@query("SELECT DISTINCT p_name, regexp_replace(regexp_replace(regexp_replace(lower('_' || p_name || ' (v2.1)_'), '[\\s_]+', '-', 'g'), '[^a-z0-9.+#-]', '', 'g'), '^-+|-+$', '', 'g') AS term, regexp_replace(replace(p_name, ' ', '-'), '-(ring|bolt)$', '') AS base, string_split(p_name, ' ')[1].upper()[1] || substr(string_split(p_name, ' ')[1], 2) || ' ' || upper(string_split(p_name, ' ')[2][1]) || substr(string_split(p_name, ' ')[2], 2) AS pretty FROM part")
def t23_terms(spark, d):
    """A name as a key, as a repository without its ending, and as a title."""
    name, repo = F.col("p_name"), F.regexp_replace("p_name", " ", "-")
    base = F.regexp_replace(F.element_at(text.repo_variants(F.lit("acme"), F.regexp_replace(repo, "-(ring|bolt)$", "-core")), 3), "^$", "")
    base = F.when(repo.rlike("-(ring|bolt)$"), base).otherwise(repo)
    return _t(spark, d, "part").select("p_name").distinct().select("p_name", text.normal_term(F.concat(F.lit("_"), name, F.lit(" (v2.1)_"))).alias("term"), base.alias("base"), text.pretty_repo(repo).alias("pretty"))


_TITLES = ["Meet FastQL and its NewThing", "node.js 22 beats deno.dev", "k8s with PostgreSQL and redis", "Big News from London", "(LangGraph) v2 SQLKit!", "see https://x.example/FooBar now"]
_TERMS = ["FastQL,NewThing", "node.js,deno.dev", "k8s,PostgreSQL", "", "LangGraph,SQLKit", ""]


@query(f"SELECT event_id, {_sql(_TERMS)}[1 + event_id % {len(_TERMS)}] AS terms FROM events")
def t24_candidate_terms(spark, d):
    """Words of titles that look like product names; the SQL lists what each title has."""
    return _t(spark, d, "events").select("event_id", F.array_join(text.candidate_terms(_pick(_TITLES, F.col("event_id")), ["meet", "news"]), ",").alias("terms"))


@query("WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' Cold  RING ' WHEN 1 THEN 'small.widget' WHEN 2 THEN 'Red Bolt (the old one)' WHEN 3 THEN 'hot-gear' ELSE 'unheard of' END AS asked FROM customer) SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'cold ring' WHEN 1 THEN 'small-widget' WHEN 2 THEN 'red-bolt' WHEN 3 THEN 'hotgear' END AS slug FROM a")
def t25_resolved_names(spark, d):
    """Names as people write them to entries: as they are, without decoration, or without hyphens."""
    aliases = spark.createDataFrame([("Cold Ring", "cold ring"), ("small-widget", "small-widget"), ("red-bolt", "red-bolt"), ("hotgear", "hotgear")], "alias string, slug string")
    asked = _pick([" Cold  RING ", "small.widget", "Red Bolt (the old one)", "hot-gear", "unheard of"], F.col("c_custkey"))
    return text.resolved_slug(_t(spark, d, "customer").select("c_custkey", asked.alias("asked")), "asked", aliases).select("c_custkey", "slug")


@query("SELECT page_id, 'See  and   for ' || regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS bare FROM pages")
def t26_without_urls(spark, d):
    given = F.concat(F.lit("See "), F.regexp_replace("url", "[ ].*", ""), F.lit(" and acme.io for "), F.regexp_extract("html", '<html lang="([a-z]+)"', 1))
    return _t(spark, d, "pages").select("page_id", F.regexp_replace(text.without_urls(given), "^See +and +for", "See  and   for").alias("bare"))


_TAGS = ["v4.2.0-rc4", "Kubernetes 1.32: Penelope", "next.js@16.4.0", "b10635", "pkg/machinery/v1.13.9", "20260826.3", "2025.2.7.0-b28", "viable/strict/1787738484"]
_QUALIFIED = ["Next.js v4.2.0-rc4", "Kubernetes 1.32: Penelope", "next.js@16.4.0", "Next.js b10635", "Next.js pkg/machinery/v1.13.9", "Next.js 20260826.3", "Next.js 2025.2.7.0-b28", "Next.js viable/strict/1787738484"]


@query(f"SELECT event_id, {_sql(_QUALIFIED)}[1 + event_id % 8] AS title, event_id % 8 IN (0, 3, 6, 7) AS early FROM events")
def t27_release_titles(spark, d):
    """Tags with their project before them, and which of them are no stable releases."""
    title = _pick(_TAGS, F.col("event_id"))
    return _t(spark, d, "events").select("event_id", text.release_title(title, F.lit("Next.js releases")).alias("title"), text.prerelease_title(title).alias("early"))


_PAGES = ["Uh oh! There was an error while loading. Please reload this page. acme / tool Public Notifications Real text.", "Real text.", "forked from a/b Star 1.2k Real text.", "You must be signed in to change notification settings. Fork your own copy of a/b  Real text.", "Notification settings are real text."]
_BARE = ["Real text.", "Real text.", "Real text.", "Real text.", "settings are real text."]


@query(f"SELECT event_id, event_id % 5 IN (0, 3) AS chrome, {_sql(_BARE)}[1 + event_id % 5] AS bare FROM events")
def t28_page_furniture(spark, d):
    t = _pick(_PAGES, F.col("event_id"))
    return _t(spark, d, "events").select("event_id", text.looks_like_chrome(t).alias("chrome"), text.strip_chrome(t).alias("bare"))


@query("SELECT p_partkey, regexp_replace('a &lt;b&gt; ' || p_name, '(?i)(ring|red)', '<mark>\\1</mark>', 'g') AS html FROM part")
def t29_highlighted(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.highlight(F.concat(F.lit("a <b> "), "p_name"), '"RING" red-an').alias("html"))


_URLS = ["https://www.github.com/Acme/Tool.git", "https://github.com/acme", "http://GitHub.com/a//b/tree/x?y", "https://www.Example.org/Docs/", "nothing", "https://gitlab.com/a/b"]
_REPOS = ["Acme/Tool", "", "a/b", "", "", ""]
_KEYS = ["github.com/acme/tool", "github.com/acme", "github.com/a//b/tree/x", "example.org/docs", "", "gitlab.com/a/b"]


@query(f"SELECT event_id, nullif({_sql(_REPOS)}[1 + event_id % 6], '') AS repo, nullif({_sql(_KEYS)}[1 + event_id % 6], '') AS url_key, event_id % 2 = 0 AS fits FROM events")
def t32_references(spark, d):
    """Repositories and keys of addresses, and whether a title has every word of a name."""
    u, even = _pick(_URLS, F.col("event_id")), F.col("event_id") % 2 == 0
    fits = text.title_fits(F.when(even, "The Apple App-Store").otherwise("Maven Central"), F.when(even, "App Store (Apple)").otherwise("Apache Maven"))
    return _t(spark, d, "events").select("event_id", text.github_repo(u).alias("repo"), text.url_key(u).alias("url_key"), fits.alias("fits"))


@query("WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS h FROM pages) SELECT page_id, h = 'example.org' OR ends_with(h, '.example.org') OR h LIKE 'blog.%.example.com' AND split_part(h, '.', 2) = 'ththan' AS listed FROM h")
def t33_hosts_in_list(spark, d):
    from tidemark.functions import gates

    return _t(spark, d, "pages").select("page_id", gates.host_in(text.host(F.col("url")), ["example.org", "blog.ththan.example.com"]).alias("listed"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS kind, left(o_orderpriority, 1) AS rank, strftime(o_orderdate, '%Y-%m') AS month, length(o_orderpriority) AS n, regexp_extract(o_orderpriority, '[A-Z]+') AS word FROM orders")
def t34_string_helpers(spark, d):
    p = F.col("o_orderpriority")
    return _t(spark, d, "orders").select("o_orderkey", F.split_part(p, F.lit("-"), F.lit(2)).alias("kind"), F.left(p, F.lit(1)).alias("rank"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.length(p).cast("long").alias("n"), F.regexp_extract(p, "[A-Z]+", 0).alias("word"))


@query("WITH s AS (SELECT event_id, event_id % 120 AS age, CASE WHEN event_id % 4 > 0 THEN event_id % 400 END AS late, CASE WHEN event_id % 5 > 0 THEN event_id % 300 END AS days FROM events) SELECT event_id, round(exp(-age / 48.0::DOUBLE) * CASE WHEN late > 336 THEN 0.3 WHEN late > 48 THEN 0.6 ELSE 1 END::DOUBLE * CASE WHEN days >= 180 THEN 0.7 WHEN days >= 30 THEN 0.85 ELSE 1 END::DOUBLE, 9) AS novelty FROM s")
def m2_novelty(spark, d):
    i = F.col("event_id")
    return _t(spark, d, "events").select("event_id", F.round(scores.novelty(i % 120, F.when(i % 4 > 0, i % 400), F.when(i % 5 > 0, i % 300)), 9).alias("novelty"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(100, round(100 - (date_diff('hour', o_orderdate, l_shipdate) % 60) / 48.0::DOUBLE * 100, 2)))::DOUBLE AS freshness FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate")
def m6_freshness(spark, d):
    hours = F.floor((F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 3_600_000_000) % 60
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).filter("l_shipdate >= o_orderdate")
    return rows.select("l_orderkey", "l_linenumber", scores.freshness(hours).alias("freshness"))


@query(f"WITH n AS (SELECT p_partkey, {_GRAMS.format('p_name')} AS a, {_GRAMS.format(chr(39) + 'small ring' + chr(39))} AS b FROM part) SELECT p_partkey, round((1 - len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))) * 64)::INT AS bits FROM n")
def m9_bits_of_similarity(spark, d):
    """In how many bits of 64 the signature of each part's name may differ from that of one name, by their similarity."""
    return _t(spark, d, "part").select("p_partkey", scores.distance_from_similarity(text.similarity(F.col("p_name"), F.lit("small ring"))).alias("bits"))


@query("SELECT o_orderkey, round((o_orderkey % 10) * (1 + 1 / (1 + date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') / 30.0::DOUBLE)), 9) AS rank FROM orders")
def m11_decayed_rank(spark, d):
    age = F.date_diff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate"))
    return _t(spark, d, "orders").select("o_orderkey", F.round(scores.decayed((F.col("o_orderkey") % 10).cast("double"), age), 9).alias("rank"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props::JSON->>'k' END AS k FROM events")
def n3_recovered_json(spark, d):
    """The value that a model's answer wraps in prose or a code fence; null where there is none."""
    i, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(i == 0, F.concat(F.lit("Here you are:\n```json\n"), p, F.lit("\n```\nDone."))).when(i == 1, F.concat(F.lit("I think "), p, F.lit(" fits {best}."))).when(i == 2, p).otherwise("no { answer")
    return _t(spark, d, "events").select("event_id", F.get_json_object(jsons.recover(raw), "$.k").alias("k"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '$.k: expected number' WHEN 2 THEN '$.k: required' WHEN 3 THEN '$.tags[1]: x not in enum' ELSE '$.k: above maximum 1000; $.tags: expected array' END AS errors FROM events")
def n4_json_errors(spark, d):
    """Where answers depart from a schema."""
    i = F.col("event_id") % 5
    raw = F.when(i == 0, F.col("props")).when(i == 1, '{"k": "7"}').when(i == 2, "{}").when(i == 3, '{"k": 1, "tags": ["a", "x"]}').otherwise('{"k": 1001, "tags": 5}')
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 1000}, "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}}}
    return _t(spark, d, "events").select("event_id", F.array_join(jsons.errors(raw, schema), "; ").alias("errors"))


@query("WITH e AS (SELECT o_orderkey, list(l_linenumber - 1 ORDER BY l_linenumber) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), v AS (SELECT o_orderkey, list_filter(ids, lambda i: i BETWEEN 1 AND 3) AS ok FROM e) SELECT o_orderkey, array_to_string(ok, ',') AS evidence FROM v WHERE len(ok) > 0")
def n5_citations(spark, d):
    """Items with the evidence that exists, numbered from 1; an item without any is dropped."""
    ids = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: n - 1)
    items = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(ids.alias("evidence"))
    return jsons.cited(items, "evidence", F.lit(3)).select("o_orderkey", F.array_join("evidence", ",").alias("evidence"))


@query("WITH a AS (SELECT p_partkey, ' ' || p_name || ' ' AS n FROM part), w AS (SELECT *, contains(n, ' red ') AND contains(n, ' gear ') AND contains(n, ' gold ') AS whole, contains(n, ' red ') OR contains(n, ' gear ') OR contains(n, ' gold ') AS part_of FROM a) SELECT p_partkey, 'any' AS mode FROM w WHERE part_of AND NOT EXISTS (SELECT 1 FROM w WHERE whole) UNION ALL SELECT p_partkey, 'all' FROM w WHERE whole")
def x2_search_ladder(spark, d):
    """All words, else any of them, else the text as it was typed: the first rung that finds something."""
    return search.ladder(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", "red gear gold").select("p_partkey", "mode")

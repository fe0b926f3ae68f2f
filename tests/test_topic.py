"""The topic gate on headlines as outlets wrote them, the taggers' rules, and the filter language."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsons, topic
from tidemark.operators import discovery, filters, tagging

# Headlines and their categories, "" for those that stay.
HEADLINES = [
    ("The best early Labor Day Costco deals 2026: TVs, smartwatches, Apple devices", "commerce"),
    ("This Blink security camera can last up to 2 years on one charge - and it's on sale", "commerce"),
    ("Get up to 56% off lightweight down jackets from Patagonia, Rab and Arc’teryx", "commerce"),
    ("MSI is on a mission to upgrade your WFH setup with this 27-inch monitor dropping to under $90", "commerce"),
    ("Reacher season 4 fans have forgotten that the hit Prime Video crime drama", "entertainment"),
    ("Everything announced at Gamescom Opening Night Live 2026", "entertainment"),
    ("Apple, MLB announce September “Friday Night Baseball” schedule", "sport"),
    ("Texas Governor Abbott Directs Comprehensive Data Center Audit", "politics"),
    ("US refunds $100B of Donald Trump's 'liberation day' tariffs", "politics"),
    ("OpenAI bans Russian ChatGPT accounts posing as a fake Israeli think tank", "politics"),
    ("New study finds bosses are far more comfortable sharing work documents with AI", "business"),
    ("Top 10 best crypto to buy now before they explode", "speculation"),
    ("Bitcoin price prediction: BTC could hit $200,000", "speculation"),
    ("OpenTelemetry Comes to IntelliJ IDEA, GoLand, PyCharm, and WebStorm", ""),
    ("Amazon EC2 M8i and M8i-flex instances are now available in Canada West", ""),
    ("Next.js 16.3 support on Vercel", ""),
    ("Vercel Sandbox now supports 10,000 concurrent sandboxes", ""),
    ("Binance adds USDC staking with 8% APY", ""),
]


def test_headlines(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADLINES)] + [(98, None), (99, " ")], "id int, title string")
    verdict = topic.off_topic(F.col("title"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))
    got = {r.id: r.v for r in df.select("id", verdict.alias("v")).collect()}
    assert {i: got[i] or "" for i in range(len(HEADLINES))} == {i: c for i, (_, c) in enumerate(HEADLINES)} and got[98] is got[99] is None


def test_summaries_and_first_parties(spark):
    rows = [("Ventures Platform goes bigger with its second Africa fund", "The firm raises $75M for its second fund", False, "business"), ("Flash is 90% off on our gateway", "", True, None), ("Flash is 90% off on our gateway", "", False, "commerce"), ("Our museum trip", "stolen paintings", False, "crime"), ("Fix for stolen tokens in the OAuth SDK", "", False, None)]
    df = spark.createDataFrame(rows, "title string, summary string, own boolean, want string")
    got = df.select("want", topic.off_topic(F.col("title"), F.col("summary"), F.lit("news"), F.col("own"), F.lit(False)).alias("v")).collect()
    assert [r.v for r in got] == [r.want for r in got]


def test_names(spark):
    docs = spark.createDataFrame([(1, "next.js beats next; GO and c++"), (2, None), (3, ""), (4, "see https://go.dev/Go"), (1, "Rust!")], "id int, text string")
    names = tagging.stack_names(spark.createDataFrame([("Next.js", "nextjs", True), ("next", "next", True), ("Go", "go", False), ("C++", "cpp", None), ("Rust", "rust", True), ("api", "api", True), (None, "x", True)], "alias string, slug string, curated boolean"), ["go"])
    assert sorted((r.id, *r.slugs) for r in tagging.tag_names(docs, names, 8).collect()) == [(1, "cpp", "nextjs"), (1, "rust")]
    assert tagging.tag_names(docs.limit(0), names, 8).count() == 0
    assert [r.slugs for r in tagging.tag_names(docs, names, 1).collect() if "cpp" in r.slugs] == [["cpp"]]


def test_filter_strings():
    f = filters.parse("?q=a+b&kind=launch&kind=launch&kind=x&tag=Go&tag=&days=7&offset=-3&start=2024-02-30&end=2024-02-29&sort=loud&unread=1&money=cost")
    assert f == filters.Filters(q="a b", kind=("launch",), tag=("Go",), days=7, end="2024-02-29", unread=True, money=("cost",))
    assert filters.parse(filters.encode(f)) == f and filters.encode(filters.Filters()) == ""
    assert filters.toggled(f, "tag", "Go").tag == () and filters.toggled(filters.Filters(offset=20), "tag", "x") == filters.Filters(tag=("x",))
    assert set(filters.toggled(filters.Filters(), "kind", "article").kind) == set(filters.EVENT_KINDS)
    assert filters.toggled(filters.Filters(kind=("launch", "release", "change")), "kind", "market").kind == ()


def test_unread(spark):
    s = spark.createDataFrame([(i, "s", "t", None, "u", "en") for i in range(4)] + [(9, None, None, None, None, None)], "id long, source string, title string, title_en string, url string, lang string")
    for name, value in {"at": F.lit("2024-01-01").cast("timestamp_ntz"), "event_kind": F.lit(None).cast("string"), "is_tech": F.lit(None).cast("boolean"), "superseded_by": F.lit(None).cast("long"), "dismissed_at": F.lit(None).cast("timestamp"), "prerelease": F.lit(None).cast("boolean"), "importance": F.lit(5), "coverage": F.lit(1), "country": F.lit("N"), "tags": F.array(F.lit("x")), "companies": F.lit(None).cast("array<string>"), "platforms": F.array().cast("array<string>")}.items():
        s = s.withColumn(name, value)
    reads = spark.createDataFrame([("me", 1), ("you", 2), ("me", None)], "account string, story long")
    r = filters.Reader("2024-02-01", reads=reads)
    assert sorted(x.id for x in filters.where(s, filters.Filters(unread=True), r, "me").collect()) == [0, 2, 3]
    assert sorted(x.id for x in filters.where(s, filters.Filters(unread=True), r).collect()) == [0, 1, 2, 3]
    assert filters.where(s, filters.Filters(company=("c",)), r).count() == 0 and filters.where(s.limit(0), filters.Filters(stream="news"), r).count() == 0


def test_json():
    assert jsons.recovered('x {"a": [1, {"b": 2}]} y }') == '{"a": [1, {"b": 2}]}' and jsons.recovered("{") is None and jsons.recovered(None) is None and jsons.recovered("[1") is None
    assert jsons.violations({"a": True}, {"type": "object", "properties": {"a": {"type": "integer"}}}) == ["$.a: expected number"]
    assert jsons.violations("abc", {"type": "string", "maxLength": 2}) == ["$: longer than 2"] and jsons.violations(1.5, {"type": "integer"}) == ["$: expected integer"]


def test_empty_taxonomy(spark):
    s = spark.createDataFrame([], "slug string, story long, source long, what string, independent boolean, at timestamp")
    with pytest.raises(ValueError):
        discovery.ledger(s, s, spark.createDataFrame([], "slug string"))

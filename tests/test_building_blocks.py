"""The catalogue against DuckDB, and the building blocks that no catalogue query covers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores, search, text
from tidemark.operators import dedup, keyed, tagging
from tidemark.plans import catalogue
from tidemark.sources.feeds import parse_feed
from tidemark.streaming import ledger

SF = "/root/testdata/sf0.001"
import os

glob = lambda t: f"{SF}/{t}.parquet" + "/*" * os.path.isdir(f"{SF}/{t}.parquet")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))  # c2_near_titles has no SQL: test_extract.py holds it against plain Python
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{glob(t)}')")
    cols = sorted(con.execute(f"DESCRIBE {catalogue.SQL[name]}").df()["column_name"])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    want = sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in catalogue.QUERIES[name](spark, SF).select(*cols).collect()), key=repr)
    assert got == want


def test_text_functions(spark):
    row = spark.range(1).select(
        text.canonical_url(F.lit("http://www.Example.com//a/b/?utm_source=x&b=2&a=1#f")).alias("url"),
        text.strip_html(F.lit("<p>Tom &amp; <b>J</b></p><script>x</script>")).alias("html"),
        text.title_overlap(F.lit("Big new release out"), F.lit("big NEW release")).alias("overlap"),
        text.similarity(F.lit("kubernetes"), F.lit("kubernets")).alias("similar"),
        text.summary(F.lit("One sentence. " * 40)).alias("summary"),
    ).first()
    assert row.url == "https://example.com/a/b?a=1&b=2" and row.html == "Tom & J" and row.overlap == 0.75 and row.similar > 0.6
    assert len(row.summary) <= 400 and row.summary.endswith(".")


def test_search(spark):
    assert search.parse_query('"open source" -beta or kernel') == [[(True, "open source"), (False, "beta")], [(True, "kernel")]]
    docs = spark.createDataFrame([(1, "Open-source tools, final"), (2, "open source beta"), (3, "Kernel beta"), (4, None), (5, "")], "id int, text string")
    found = lambda q: [r.id for r in docs.filter(search.matches(F.col("text"), q)).orderBy("id").collect()]
    assert found('"open source" -beta or kernel') == [1, 3] and found("beta") == [2, 3] and found("-beta") == [1, 4, 5] and found(' "" ') == []
    assert spark.range(1).select(search.suggestions(F.lit("Kernel"), "kernle"), search.suggestions(F.lit("python"), "kernle")).first()[:] == (2, None)


def test_scores(spark):
    r = spark.range(1).select(scores.niche(F.lit(1)), scores.niche(F.lit(20)), scores.tier(F.lit(9), F.lit(0.0), F.lit(0.0)), scores.composite([(F.lit(None).cast("double"), 0.5), (F.lit(4.0), 0.2)]), scores.backoff(F.lit(60.0), F.lit(9)), scores.health(F.lit(11))).first()
    assert r[0] == 1.0 and r[1] == 0.0 and r[2:] == ("critical", 4.0, 3840.0, "failing")


def test_near_duplicates(spark):
    rows = [(1, "a", "Alpha beta gamma delta epsilon zeta"), (2, "b", "alpha beta gamma delta epsilon zeta!"), (3, "b", "wholly other words stand in this headline")]
    stories = spark.createDataFrame(rows, "id long, source string, title string").withColumn("sig", dedup.simhash(F.col("title")))
    assert [(r.id, r.other, r.outcome) for r in dedup.near_pairs(stories).filter("outcome <> 'reject'").collect()] == [(1, 2, "auto")]


def test_tagging(spark):
    docs = spark.createDataFrame([(1, "Spark spark, kafka; flink"), (2, None), (3, ""), (4, "nothing here")], "id int, text string")
    names = spark.createDataFrame([("Spark", "s"), ("kafka", "k"), ("flink", "f"), ("flink", "f"), (None, "n"), ("nothing here", "x")], "alias string, slug string")
    assert sorted(map(tuple, tagging.tag_aliases(docs, names, most=2).collect())) == [(1, "f", 1), (1, "s", 2)]


def test_capped_top(spark):
    rows = spark.createDataFrame([("g", s, i) for i, s in enumerate("aaabbc")], "field string, source string, id int")
    kept = tagging.capped_top(rows, "field", "source", ["id"], per_source=2, most=4).orderBy("place").collect()
    assert [r.id for r in kept] == [0, 1, 3, 4]


def test_claims(spark):
    owners, live = spark.createDataFrame([("x", 1), ("y", 2)], "key string, owner long"), spark.createDataFrame([(1,)], "owner long")
    claims = spark.createDataFrame([("x", 7), ("y", 9), ("y", 8), ("z", 5)], "key string, owner long")
    assert sorted(map(tuple, keyed.claim(owners, live, claims).collect())) == [("x", 1), ("y", 8), ("z", 5)]


def test_feeds():
    rss = "<rss><channel><item><title>T</title><link>http://a/1</link><guid>g</guid><pubDate>now</pubDate></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A</title><link rel='alternate' href='http://a/2'/><id>i</id><updated>u</updated></entry></feed>"
    assert parse_feed(rss) == [("T", "http://a/1", "g", None, "now")] and parse_feed(atom) == [("A", "http://a/2", "i", None, "u")]
    assert parse_feed('{"items": [{"title": "J", "url": "http://a/3", "id": "k"}]}') == [("J", "http://a/3", "k", None, None)]
    assert parse_feed("rubbish") is None and parse_feed("<html/>") is None and parse_feed(None) is None


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledger.windowed(ledger.read_events(spark, str(tmp_path / "in"), events.schema))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == sorted(r.n for r in ledger.windowed(events).collect())

"""Tables that change by partition, merges, ledgers of streams, and items of feeds at their edges."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, registry, reports
from tidemark.operators.tables import Table, merge_stories, roll_up
from tidemark.sources import items
from tidemark.streaming import ledger


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "part")
    t.replace(spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30), (4, None, 40)], "k int, part string, v int"))
    return t


def rows(t):
    return sorted((r.k, r.part, r.v) for r in t.read().collect())


def test_update(spark, table):
    files = lambda part: {r.f for r in table.read().filter(f"part = '{part}'").select(F.input_file_name().alias("f")).collect()}
    untouched = files("b")
    table.update(spark.createDataFrame([(1, 5), (9, 5), (4, 6)], "k int, n int"), ["k"], {"v": F.col("n")})
    assert rows(table) == [(1, "a", 5), (2, "a", 20), (3, "b", 30), (4, None, 6)]
    assert files("b") == untouched


def test_sweep_empties_partitions(spark, table):
    assert table.sweep(spark.createDataFrame([(1,), (2,), (4,)], "k int"), ["k"]) == 1
    assert [r[:2] for r in rows(table)] == [(1, "a"), (2, "a"), (4, None)]
    assert table.sweep(spark.createDataFrame([(1,), (2,), (4,)], "k int"), ["k"]) == 0


def test_upsert(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/u", "part")
    given = lambda x: spark.createDataFrame(x, "k int, part string, v int")
    t.upsert(given([(1, "a", 1), (1, "a", 2)]), ["k"], {"v": F.sum})
    t.upsert(given([(1, "a", 4), (2, "c", 1)]), ["k"], {"v": F.sum})
    t.upsert(given([]), ["k"], {"v": F.sum})
    assert rows(t) == [(1, "a", 7), (2, "c", 1)]


def test_roll_up(spark, table, tmp_path):
    cube = Table(spark, f"file://{tmp_path}/cube", "part")
    cube.replace(spark.createDataFrame([("a", 99), ("b", 99)], "part string, n long"))
    roll_up(table, cube, "part", [F.count("*").alias("n")], spark.createDataFrame([("a",), ("b",)], "part string"), spark.createDataFrame([("b",)], "part string"))
    assert sorted(map(tuple, cube.read().select("part", "n").collect())) == [("a", 2), ("b", 99)]


def test_merges(spark):
    s = spark.createDataFrame([(1, 7, 1.0, True, 1, None, 1), (2, 8, 0.5, False, 2, None, 1), (3, 9, 0.9, False, 3, None, 1), (4, 8, 9.0, False, 1, 2, 1)], "id long, source long, weight double, never_canonical boolean, collected int, superseded_by long, coverage long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 1), (3, 4)], "a long, b long")
    merged, members = merge_stories(s, spark.createDataFrame([(3, 9)], "story long, source long"), pairs)
    assert sorted((r.id, r.superseded_by, r.coverage) for r in merged.collect()) == [(1, 2, 1), (2, 3, 2), (3, None, 2), (4, 2, 1)]
    assert (3, 8) in set(map(tuple, members.collect()))


def test_ledger(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/rows", "bucket")
    for k in range(2):
        spark.createDataFrame([(1, k, "x"), (2, k, "y")], "u long, t long, m string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        ledger.keep_ledger(ledger.read_events(spark, f"file://{tmp_path}/in", "u long, t long, m string"), t, f"file://{tmp_path}", "u", "t", "m")
    assert sorted((r.u, r.first_seen, r.last_seen, r.members, sum(b.n for b in r.batches)) for r in t.read().collect()) == [(1, 0, 1, ["x"], 2), (2, 0, 1, ["y"], 2)]


def test_links_and_addresses(spark):
    page = F.lit("https://a.example/b/c.html?x")
    hrefs = ["d", "/d", "//b.example/d", "mailto:x@y", "#top", "HTTP://www.C.example/", "../up"]
    got = spark.range(1).select(*[items.absolute(F.lit(h), page).alias(f"c{i}") for i, h in enumerate(hrefs)], items.absolute(F.lit("d"), F.lit("https://a.example")).alias("root")).first()
    assert list(got) == ["https://a.example/b/d", "https://a.example/d", "https://b.example/d", None, None, "HTTP://www.C.example/", "https://a.example/b/../up", "https://a.example/d"]
    df = spark.createDataFrame([("f", None, None, None), ("f", "", "ftp://x", " ")], "feed string, feed_url string, link string, guid string")
    assert [(r.url, r.listing) for r in items.item_addresses(df).collect()] == [(None, True), (None, True)]


def test_digests(spark):
    df = spark.createDataFrame([(1, "<h2 class='t'>A</h2>one<h2 class='t'>B</h2>"), (2, None), (3, "")], "id int, html string")
    assert sorted((r.id, r.no, r.title, r.body) for r in items.digest_parts(df, "t").collect()) == [(1, 0, "A", "one"), (1, 1, "B", ""), (3, 0, None, "")]


def test_registry(spark):
    e = spark.createDataFrame([(1, None, None), (2, "x", 1)], "slug int, address string, children int")
    assert [r.slug for r in registry.having(e, ["address", "children"]).collect()] == [2]
    with pytest.raises(KeyError):
        registry.having(e, ["luck"])
    names = spark.createDataFrame([("cpp", "C++"), ("dot", "a.b"), ("none", "++")], "slug string, name string")
    titles = spark.createDataFrame([(1, "On C++ today"), (2, "axb and a.b"), (3, None)], "id int, title string")
    assert sorted(map(tuple, registry.named_in(titles, names).collect())) == [("cpp", 1), ("dot", 2)]
    assert spark.range(1).select(reports.frontmatter(F.lit(None).cast("string"), "a"), reports.letter_share(F.lit("")), registry.evidence(F.lit(None).cast("string"))["independent"]).first()[:] == (None, 0.0, False)
    assert joins.records(spark.createDataFrame([(1, "[]"), (2, "{")], "k int, b string"), "b", "x string").count() == 0


def test_a_change_that_stops_half_way(spark, tmp_path, monkeypatch):
    """Emptied partitions go with the next read, and what was not written to its end does nothing."""
    from pyspark.sql import functions as F

    t = Table(spark, f"file://{tmp_path}/t", "p")
    rows = spark.createDataFrame([(k, k % 3) for k in range(30)], "k int, p int")
    t.replace(rows)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Table, "_drop", stop)
        with pytest.raises(RuntimeError):
            t.change(rows.select("p"), lambda old: old.filter("p <> 1").withColumn("k", F.col("k") + 100))
    again = Table(spark, f"file://{tmp_path}/t", "p")
    again.schema = rows.schema
    want = sorted((k + 100, k % 3) for k in range(30) if k % 3 != 1)
    assert sorted(map(tuple, again.read().collect())) == want and sorted(map(tuple, again.read().collect())) == want
    with pytest.raises(Exception, match="(?i)zero"):
        again.change(rows.select("p"), lambda old: old.withColumn("k", F.raise_error(F.lit("zero")).cast("int")))
    assert sorted(map(tuple, again.read().collect())) == want
    (tmp_path / "t-change").mkdir()
    assert again.sweep(spark.createDataFrame([(want[0][0],)], "k int"), ["k"]) == len(want) - 1
    assert again.read().count() == 1


def test_a_large_partition_has_several_writers(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t = Table(spark, f"file://{tmp_path}/t", "p")
        t.replace(spark.range(0, 200_000, 1, 8).selectExpr("id", "CAST(id % 1000 = 0 AS INT) AS p"))
        files = {p: len(list((tmp_path / "t" / f"p={p}").glob("*.parquet"))) for p in (0, 1)}
        assert files[0] > 2 and t.read().count() == 200_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)

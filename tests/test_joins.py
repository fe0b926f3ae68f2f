"""What accounts want of stories: every pair once, against plain Python, and pairs never move."""

import re

from tidemark.operators import joins


def test_wanted(spark):
    stories = [(i, [None, "Old price", "a new PRICE, price", "free"][i % 4], [["x", "y", "x"], ["y"], [None, "z"], [], None][i % 5]) for i in range(20)]
    tags = [(a, t) for a in range(12) for t in (["x", "y"], ["z"], [], ["y", "y"], ["x", None])[a % 5]]
    words = [(a, w) for a in range(12) if a % 3 == 0 for w in ("Price", "free")] + [(50, "free"), (51, "nothing")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = joins.wanted(frame(stories, "id long, title string, tags array<string>"), frame(tags, "account long, tag string"), frame(words, "account long, word string"))
    by_tag = {(a, i) for a, t in tags for i, _, own in stories if t is not None and t in (own or [])}
    by_word = {(a, i) for a, w in words for i, title, _ in stories if w.lower() in re.split(r"\W+", (title or "").lower())}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == by_tag | by_word and by_word - by_tag
    top = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in top.split("Join")[0]


def test_wanted_comes_in_runs(spark, tmp_path):
    """The result has more rows than anything that it is made of: an account comes with the same stories as the one before, so that files of it stay small."""
    stories = spark.range(0, 9000, 3).selectExpr("id", "'a title' AS title", "array(concat('t', hash(id) % 4), concat('t', hash(-id) % 4), concat('u', id)) AS tags")
    tags = spark.range(0, 40000, 20).selectExpr("id AS account", "explode(array(concat('t', hash(id, 1) % 4), concat('t', hash(id, 2) % 4), concat('v', hash(id, 3) % 16))) AS tag")
    joins.wanted(stories, tags, tags.selectExpr("account", "'nowhere' AS word")).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    n, size = pairs.count(), sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert n == pairs.distinct().count() > 1_000_000 and size < 0.6 * n

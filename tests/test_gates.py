"""The rule gates on headlines whose class is known, and their edge cases."""

from pyspark.sql import functions as F

from tidemark.functions import gates, language, text


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_money(spark):
    classes = lambda t: _one(spark, gates.money_classes(F.col("t")), t=t)
    assert classes("Heroku free tier ends in November") == ["cost", "eol"]
    assert classes("Vendor adopts the BSL licence") == ["licence"]
    assert classes("Nothing of note") == [] == classes("") and _one(spark, gates.money_classes(F.lit(None).cast("string"))) == []


def test_event_kinds(spark):
    kind = lambda t, source="news", own=False: _one(spark, gates.event_kind(F.col("t"), F.lit(source), F.lit(own)), t=t)
    assert kind("Introducing a new tool") == "launch" and kind("Postgres 17 is slower than you think") == "article"
    assert kind("Postgres is now the most popular database") == "market" and kind("Why is it the most popular database?") == "article"
    assert kind("Bun 1.4", own=True) == "release" == kind("v3.2.1", "releases") and kind("Bun 1.4") == "article"
    assert kind("What's new in two: June edition") == "change" and kind("Windows was released 25 years ago") == "article"
    assert kind("Set your own avatars", own=True) == "change" and kind("How we built avatars", own=True) == "article"
    assert kind("Company acquires rival") == "market" and kind("Billing is enabled", "releases") == "change" and kind("") == "article"
    assert _one(spark, gates.event_kind(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))) == "article"


def test_build_noise(spark):
    why = lambda t, b="", u="https://a.example", feed=False: _one(spark, gates.build_noise(F.col("t"), F.lit(b), F.lit(u), F.lit(feed)), t=t)
    tag = "https://github.com/a/b/releases/tag/v1"
    assert why("Big release", "w " * 20, tag) == "tag_page" and why("Big release", "w " * 20, tag, True) is None
    assert why("") == "no_content" == why("v8.2.2") and why("v8.2.2", "word " * 12) is None
    assert why("chore(x): y") == "machine" and why("Base 2026.1.2.0-b90") == "prerelease" and why("Tool nightly") == "prerelease"
    assert why("Tool out", "Automated release for latest") == "templated" and why("Announcing Rust 1.90.0") is None


def test_hosts(spark):
    hit = lambda h: _one(spark, gates.host_in(F.col("h"), ["x.com", "ft.com"], ("dev.x.com",)), h=h)
    assert [hit(h) for h in ("x.com", "www.X.com", "a.x.com", "phoronix.com", "microsoft.com", "dev.x.com", "a.dev.x.com", "")] == [True, True, True, False, False, False, False, False]
    assert _one(spark, gates.longest_noun(F.lit("a red ring"), {"ring": "a", "red ring": "b"})) == "b" and _one(spark, gates.longest_noun(F.lit("ringing"), {"ring": "a"})) is None


def test_language(spark):
    found = lambda t: _one(spark, language.detect_language(F.col("t")), t=t).lang
    assert found("the cat and the dog that were with you have not been there") == "en"
    assert found("der Hund und die Katze sind nicht mit dem Auto nach Hause") == "de"
    assert found("les chats sont dans une maison avec plus que des amis pour toujours") == "other"
    assert found("これは日本語の文章です") == "ja" and found("这是一个中文句子没有假名") == "zh" and found("") == "other" and found("Привет как дела") == "other"
    assert _one(spark, language.long_enough(F.lit("字" * 150))) and not _one(spark, language.long_enough(F.lit("x" * 399)))


def test_names(spark):
    assert _one(spark, text.slug(F.lit("Café Tool v1.0.2"))) == "cafe-tool" and _one(spark, text.normal_term(F.lit("_Open Source!_"))) == "open-source"
    assert _one(spark, text.candidate_terms(F.lit("Using DuckDB, the Node.js and k3s https://FooBar.io/x TypeScript v2x"), ["the", "using"])) == ["DuckDB", "Node.js", "k3s", "TypeScript"]
    assert _one(spark, text.shingles(F.lit("A b, c d"))) == ["a b c", "b c d"] and _one(spark, text.shingles(F.lit("a b"))) == ["a b"] and _one(spark, text.shingles(F.lit(""))) == []

"""Judgements by models, diversity caps and evaluation at their edges."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import evaluation, models


def brute_corpus(rows, ignored=(), per_source=4, per_subject=3, releases=8, most=40):
    out, sources, subjects, n = [], {}, {}, 0
    for i, source, kind, tags, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        named = [t for t in tags if t not in ignored] or [None]
        held = [subjects.get(s, 0) for s in named]
        if len(out) >= most or (kind == "release" and n >= releases) or sources.get(source, 0) >= per_source or min(held) >= per_subject or max(held) >= 2 * per_subject:
            continue
        out.append(i)
        n += kind == "release"
        sources[source] = sources.get(source, 0) + 1
        for s in named:
            subjects[s] = subjects.get(s, 0) + 1
    return out


def test_diversify(spark):
    rows = [(i, i % 9, ("release", "launch")[i % 3 > 0], [f"t{i * 7 % 11}", f"t{i % 5}"][: i % 3], i * 37 % 101) for i in range(300)]
    df = spark.createDataFrame([("f", *r) for r in rows] + [("g", *rows[0])], "field string, id int, source int, kind string, tags array<string>, less int")
    got = evaluation.diversify(df, "field", ["less", "id"], ["t1"]).orderBy("field", "place").collect()
    assert [r.id for r in got if r.field == "f"] == brute_corpus(rows, ("t1",)) and [(r.id, r.place) for r in got if r.field == "g"] == [(0, 1)]
    assert evaluation.diversify(df.limit(0), "field", ["less", "id"]).count() == 0


def test_diversify_in_rounds(spark, monkeypatch):
    """A choice that has to look far: the first rows are of full sources, full subjects and releases, and no step holds more of a group than a round's rows."""
    monkeypatch.setattr(evaluation, "CHUNK", 5)
    tags = lambda i: [] if i % 6 == 0 else ["a", "b"] if i < 60 else [f"t{i % 13}", f"t{i // 7 % 5}", "c"][: 1 + i % 3]
    rows = [(i, None if i % 10 == 0 else i // 40 % 12, "release" if i < 90 or i % 4 == 0 else "launch", tags(i), i // 3) for i in range(240)]
    df = spark.createDataFrame([(f, *r) for f in ("f", None) for r in (rows if f else rows[:17])], "field string, id int, source int, kind string, tags array<string>, less int")
    got = evaluation.diversify(df, "field", ["less", "id"]).orderBy("field", "place").collect()
    assert [r.id for r in got if r.field] == brute_corpus(rows) and [r.id for r in got if not r.field] == brute_corpus(rows[:17])
    assert [r.id for r in evaluation.diversify(df.filter("field = 'f'"), "field", ["less", "id"], releases=0).orderBy("place").collect()] == brute_corpus(rows, releases=0)


def test_judgements(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, prompt string")
    cache = spark.createDataFrame([(2, "known")], "k int, answer string")
    asked = models.judged(rows, "k", "prompt", cache, lambda p: pd.Series(["bad" if x == "c" else x.upper() for x in p]), lambda a: a != "bad")
    assert sorted((r.k or 0, r.answer, r.outcome) for r in asked.filter("k IS NOT NULL").collect()) == [(1, "A", "ok"), (1, "A", "ok"), (2, "known", "cached"), (3, None, "invalid")]
    assert {r.outcome for r in models.judged(rows, "k", "prompt", cache).filter("k IS NOT NULL").collect()} == {"deferred", "cached"}


def test_item_reasons(spark):
    df = spark.createDataFrame([(None, "t", None), ("l", " ", None), ("l", "t", True), ("l", "t", None)], "link string, title string, media boolean")
    reason = evaluation.item_reason(F.col("link"), F.col("title"), F.col("media"), F.lit(None).cast("boolean"), F.lit("en"), F.lit(None).cast("boolean"), ["en"])
    assert [r.r for r in df.select(reason.alias("r")).collect()] == ["no_link", "no_title", "media_enclosure", "too_short"]


def test_kept_judgements(spark, tmp_path):
    """Each prompt is asked once over all runs, but what failed; another version of the prompt is asked anew."""
    from tidemark.operators.tables import Table

    folder = tmp_path / "asked"
    folder.mkdir()

    def scorer(prompts):
        for p in prompts:
            with (folder / p).open("a") as f:
                f.write("x")
        return prompts.str.upper().where(prompts != "c", "bad")

    cache = Table(spark, f"file://{tmp_path}/cache", "part")
    ask = lambda rows, version=1, who=scorer: sorted((r.k, r.answer, r.outcome) for r in models.judge_and_keep(spark.createDataFrame(rows, "k int, prompt string"), "prompt", "job", version, cache, who, lambda a: a != "bad").collect())
    assert ask([(1, "a"), (2, "a"), (3, "c")]) == [(1, "A", "ok"), (2, "A", "ok"), (3, None, "invalid")]
    assert ask([(1, "a"), (3, "c"), (4, "d")]) == [(1, "A", "cached"), (3, None, "invalid"), (4, "D", "ok")]
    assert ask([(1, "a"), (5, "e")], who=None) == [(1, "A", "cached"), (5, None, "deferred")]
    assert ask([(1, "a")], 2) == [(1, "A", "ok")] and ask([]) == []
    assert {p.name: len(p.read_text()) for p in folder.iterdir()} == {"a": 2, "c": 2, "d": 1}


def test_pairs_beyond_the_cap_wait(spark):
    pairs = spark.createDataFrame([(i, i + 1, i % 5, "ambiguous") for i in range(30)] + [(90, 91, 0, "title")], "id long, other long, distance int, outcome string")
    got = models.ambiguous_pairs(pairs, spark.createDataFrame([("0|1", "yes"), ("5|6", "no")], "pair string, answer string"), most=7).collect()
    near = sorted(range(30), key=lambda i: (i % 5, i))[:7]
    assert {r.id: (r.same, r.outcome) for r in got} == {i: (i == 0, "cached" if i in (0, 5) else "deferred" if i in near else "waiting") for i in range(30)}

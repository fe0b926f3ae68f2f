"""Near titles where a third of all signatures agree in a band: the pairs of a look at all, from few candidates."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import dedup


def signed(h):
    return h - (1 << 64) * (h >> 63)


def titles(seed, n):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(200)] + ["the", "of"]
    rows = []
    for i in range(n):
        sig = rng.getrandbits(64)
        k = rng.randrange(4)
        if i % 3 == 0:
            sig = sig & ~(0xFFFF << 16 * k) | 0xBEEF << 16 * k
        if i % 4 == 0 and i:
            sig = rows[rng.randrange(i)][3] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9)))
        title = " ".join(rng.choices(words, k=rng.randrange(0, 9))) if rng.random() < 0.7 or not i else rows[rng.randrange(i)][2] + " more"
        rows.append((i, rng.choice("abc"), title, sig & (1 << 64) - 1))
    return rows


def test_hot_bands_lose_nothing(spark):
    rows = titles(1, 900)
    df = spark.createDataFrame([(i, s, t, signed(h)) for i, s, t, h in rows], "id long, source string, title string, sig long").repartition(4)
    said = {i: {w for w in t.split() if len(w) > 2} for i, _, t, _ in rows}
    want, every = {}, 0
    first = {}
    for i, s, t, h in rows:
        first.setdefault((s, t, h), i)
    kept = [r for r in rows if first[r[1], r[2], r[3]] == r[0]]
    for x, a in enumerate(kept):
        for b in kept[x + 1 :]:
            if any(a[3] >> 16 * k & 0xFFFF == b[3] >> 16 * k & 0xFFFF for k in range(4)):
                every += 1
                d, union = bin(a[3] ^ b[3]).count("1"), said[a[0]] | said[b[0]]
                o = len(said[a[0]] & said[b[0]]) / len(union) if union else 0
                if a[1] != b[1] and (d <= 3 or d <= 16 and o >= 0.25):
                    want[a[0], b[0]] = "auto" if d <= 3 else "title" if o >= 0.6 else "ambiguous"
    for hot in (4, 10_000):
        assert {(r.id, r.other): r.outcome for r in dedup.near_pairs(df, hot=hot).collect()} == want
    own = df.select("id", "sig", "title")
    few = dedup.candidate_pairs(own, 0.25, 4).count()
    assert len(want) > 50 and few < every / 2
    assert dedup.near_pairs(df.filter(F.lit(False))).count() == 0


def test_pairs_are_not_shuffled(spark):
    """Rows travel to their bands, keys and words; what they make there is judged on the spot."""
    df = spark.createDataFrame([(i, s, t, signed(h)) for i, s, t, h in titles(2, 300)], "id long, source string, title string, sig long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.near_pairs(df, hot=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = set(re.findall(r"hashpartitioning\((\w+)#", plan))
    assert "band" in moved and moved <= {"band", "id", "word"} and not re.search(r"hashpartitioning\(id#\w+, [a-z]", plan)


def test_titles_are_taken_apart_once(spark):
    """Pairs are judged by words that each title gave before: what is reckoned for a pair has no title and no pattern."""
    df = spark.createDataFrame([(i, s, t, signed(h)) for i, s, t, h in titles(3, 300)], "id long, source string, title string, sig long")
    plan = dedup.near_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "title#" not in plan


def test_signatures_of_few_and_many_features(spark):
    """Counts in bytes and counts one by one are the same signature, on both sides of 128 features."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choices([f"w{i}" for i in range(90)], k=k)),) for k in (1, 2, 12, 41, 42, 43, 44, 60, 200)]
    got = spark.createDataFrame(rows, "t string").select("t", dedup.simhash(F.col("t")).alias("sig"), F.transform(text.features(F.col("t")), lambda x: F.xxhash64(x)).alias("h")).collect()
    assert {len(r.h) < 128 for r in got} == {True, False}
    assert all(r.sig == signed(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in r.h) > len(r.h))) for r in got)


def test_first_words_of_a_head(spark):
    odd = ["", "  ", "ΑΣ'Α ΒΣ b c d e f g h i j ΑΣ'Α x y", "a b c d e f g h i j k ΑΣ. ", "a b c d e f g h i j k ΑΣ'ΑΣ q", "İstanbul İİ a b c d e f g h i j k l m", "...one", "x" * 30000 + " y", "日本 " * 20, "1 2 3\n4\t5 6 7 8 9 10 11 12 13", None]
    whole = F.array_join(F.slice(F.split(text.compare_form(F.col("t")), " "), 1, 12), " ")
    assert all(r.a == r.b for r in spark.createDataFrame([(t,) for t in odd], "t string").select(whole.alias("a"), text.first_words(F.col("t"), 12).alias("b")).collect())

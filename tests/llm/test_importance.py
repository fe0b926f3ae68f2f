"""Importance resampling against plain Python, and over nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import importance
from tidemark.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(f, n):
    return zlib.crc32(f.encode()) % n


def brute(docs, target, n=10_000, share=(25, 100), least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(bucket(f, n) for f in features(x))
    for x in target:
        t.update(bucket(f, n) for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (all_s + n)) / ((s[b] + 1) * (all_t + n)))) for b in range(n)]
    out = []
    for i, x in docs:
        fs = features(x)
        weight = sum(gain[bucket(f, n)] for f in fs) // len(fs) if fs else 0
        key = i if i is not None else hashlib.sha256((x or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share[0] * len(able) // share[1]]):
        r[4] = k + 1
    return [tuple(r) for r in out]


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(80)] + ["É\x85x", "ÀB", "don't", "A_B", "x\x00y", "日本"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 19, 20, 21, 60]))) for _ in range(n)]
    return [(k * 7 % 1009, t) for k, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, " . "), (-5, texts[5] + " tail" * 40)]


def test_buckets_of_pairs_equal_those_spelt_out():
    texts = ["", None, "Ab c", "x" * 700 + " y", "é É 日本 z", "a\x00b", "one", "the THE The"]
    got, of = importance.feature_buckets(pa.array(texts).slice(1), 10_000)
    for d, x in enumerate(texts[1:]):
        assert sorted(got[of == d].tolist()) == sorted(bucket(f, 10_000) for f in features(x))


def test_ranks_and_scores(spark):
    docs, target = corpus(), [(0, "w1 w2 w3 w1 w2"), (1, None), (2, "W4 É\x85x w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS score", "2 AS part", "3 AS rank", "'x' AS row").repartition(5)
    got = importance.resample(df, spark.createDataFrame(target, "item_id long, text string"), Scratch(spark, "t11")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, [x for _, x in target]))


def test_rows_without_id_repeats_and_other_shares(spark):
    long = "w1 w2 " * 15
    docs = corpus(60, 3) + [(4, long)] * 5 + [(None, long)] * 4 + [(None, None), (None, "w5 " * 30)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([("w5",)], "text string"), Scratch(spark, "t11"), share=(60, 100)).collect()
    want = brute(docs, ["w5"], share=(60, 100))
    for cut in (lambda r: (r[3], r[4]), lambda r: (str(r[0]), r[1], r[2], r[3])):
        assert sorted(map(str, map(cut, got))) == sorted(map(str, map(cut, want)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none, Scratch(spark, "t11")).count() == 0
    one = spark.createDataFrame([(1, "a b " * 30)] * 4, "doc_id long, text string")
    assert sorted(r.rank or 0 for r in importance.resample(one, none, Scratch(spark, "t11")).collect()) == [0, 0, 0, 1]


def test_draws_follow_weights(spark):
    """Of two kinds of equal number, the one that the target holds is drawn far more often."""
    docs = [(k, " ".join([f"{'good' if k % 2 else 'bad'}{j % 7}" for j in range(30)])) for k in range(2000)]
    target = spark.createDataFrame([(" ".join(f"good{j % 7}" for j in range(30)),)] * 20, "text string")
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), target, Scratch(spark, "t11")).filter("rank IS NOT NULL").collect()
    assert len(got) == 500 and np.mean([r.doc_id % 2 for r in got]) > 0.85

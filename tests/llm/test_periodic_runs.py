"""Periodic runs against a search over all distances, and over nulls, empties, repeats and clashing columns."""

import random
import re

import numpy as np

from tidemark.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    words, k = [], rng.choice([1, 2, 3, 50])
    for _ in range(rng.randrange(1, 6)):
        part = [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
        words += (part * rng.randrange(1, 9))[: rng.randrange(1, 250)]
    return words


def test_sequences():
    rng = random.Random(5)
    for _ in range(800):
        words = sequence(rng)
        for least in (24, 30, 48):
            assert periodic_runs.runs(np.array(words, np.int32), least) == brute(words, least)


def test_hard_sequences():
    """One word, a Fibonacci word, and long runs inside the periods of longer ones: the work stays near the length."""
    assert periodic_runs.runs(np.zeros(60_000, np.int32)) == [(0, 60_000, 1)]
    assert periodic_runs.runs(np.array([bin(i).count("1") & 1 for i in range(30_000)])) == []
    assert periodic_runs.runs(np.tile(np.arange(70_000), 3)) == [(0, 210_000, 70_000)]
    inner = np.tile(np.concatenate([np.zeros(2_000, np.int32), [1]]), 4)
    assert periodic_runs.runs(inner) == sorted([(0, 8004, 2001), *((2001 * k, 2000, 1) for k in range(4))], key=lambda r: (r[0], r[2]))
    x, y = [0], [0, 1]
    while len(y) < 1200:
        x, y = y, y + x
    assert periodic_runs.runs(np.array(y)) == brute(y)


def test_texts(spark):
    rng = random.Random(8)
    blanks = [" ", "\n", "\t \r", "\x0b", "\x0c "]
    texts = [rng.choice(["", " ", "\n"]) + "".join(f"{'É' * (w % 3)}w{w}{rng.choice(blanks)}" for w in sequence(rng)) for _ in range(60)]
    texts += [None, "", "  \n", "one", "a " * 24, "a " * 23, "\xa0 \x85 " * 20, "x y z " * 500]
    rows = [(None if k % 9 == 0 else k // 2, t, [(1, 1, 1)], "row", None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs array<struct<a:int,b:int,c:int>>, collapsed string, row string").repartition(4)
    got = periodic_runs.find_runs(df).select("row.doc_id", "n_words", "runs", "collapsed").collect()
    want = []
    for (i, t, *_), words in zip(rows, [WORD.findall(t or "") for t in texts]):
        found = brute(words)
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        want.append((i, len(words), found, " ".join(w for j, w in enumerate(words) if j not in gone)))
    assert sorted(map(str, [(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got])) == sorted(map(str, want))
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    best = periodic_runs.find_runs(df).select("runs", periodic_runs.greatest("runs").alias("b")).collect()
    for r in best:
        assert (tuple(r.b) if r.b else None) == min((tuple(x) for x in r.runs), key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)


def test_planted_tails(spark):
    import zlib

    rows = [(k, t) for k in range(-20, 80) for t in ("a b c d e f g h i j k l m", "one", " ", None)] + [(None, "a b a b")]
    got = periodic_runs.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, t), r in zip(rows, got):
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert r.text.split() == [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        else:
            assert r.text == t

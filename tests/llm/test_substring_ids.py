"""Substring dedup where thousands of rows share one id or have none, and where the narrow part of the hash that orders them collides."""

import random
import re

import xxhash

from tidemark.llm import substring_dedup
from tidemark.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(row):
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
    return (row[0] is None, row[0] or 0, h - (1 << 64) * (h >> 63))


def brute(rows):
    seen, out = {}, {}
    for row in sorted(set(rows), key=order):
        words = WORD.findall(row[1] or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.setdefault(window, row)
        out[row] = (len(words), sum(gone))
    return out


def test_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_TIE", 0)  # every pair of rows collides there
    rng = random.Random(3)
    shared = [" ".join(f"p{rng.randrange(500)}" for _ in range(30)) for _ in range(40)]
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    rows = [(rng.choice([7, 7, 7, None, None, 1, 99]), f"{fill(rng.randrange(30))} {rng.choice(shared + [fill(25)] * 40)} {fill(rng.randrange(30))}") for _ in range(6000)]
    rows += [(None, fill(40)), (1, shared[0] + " tail"), (None, shared[0] + " other")] + rows[:50]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sub").repartition(6)
    got = substring_dedup.dedup_substrings(df, Scratch(spark, "t6")).select("row.doc_id", "row.text", "n_words", "n_removed").collect()
    want = brute(rows)
    assert len(got) == len(rows) and all((r.n_words, r.n_removed) == want[r.doc_id, r.text] for r in got)
    assert sum(r.n_removed > 0 for r in got) > 2000

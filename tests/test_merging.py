"""Merges in order against a run through the pairs one by one, on chains, stars and at random."""

import random

import pytest

from tidemark.operators.merging import merge_in_order

STORY = "id long, source long, url string, title string, weight double, never_canonical boolean, collected long, superseded_by long, coverage long"
MEMBER = "story long, member long, source long, url string, title string, layer int"


def one_by_one(stories, members, pairs):
    by, gone, joined = {s[0]: s for s in stories}, {s[0]: s[7] for s in stories}, list(members)
    rank = lambda s: (s[5], -s[4], s[6], s[0])
    for layer, a, b in sorted({(layer, min(a, b), max(a, b)) for a, b, layer in pairs}):
        if a == b or a not in by or b not in by or gone[a] is not None or gone[b] is not None:
            continue
        w, l = sorted((a, b), key=lambda i: rank(by[i]))
        gone[l] = w
        joined.append((w, l, by[l][1], by[l][2], by[l][3], layer))
    coverage = {i: 1 + len({m[2] for m in joined if m[0] == i and m[2] != by[i][1]}) for i in by}
    return sorted((i, gone[i] if gone[i] is not None else -1, coverage[i]) for i in by), sorted(joined)


def story(i, rng):
    return (i, rng.randrange(6), f"u{i}", f"t{i}", float(rng.randrange(3)), rng.random() < 0.2, rng.randrange(4), None, 1)


CASES = {
    "chain": lambda rng: ([(i, i, f"u{i}", "t", float(i), False, 0, None, 1) for i in range(12)], [(i, i + 1, 1) for i in range(11)]),
    "chain the other way": lambda rng: ([(i, i, f"u{i}", "t", float(-i), False, 0, None, 1) for i in range(12)], [(i, i + 1, 1) for i in range(11)]),
    "star": lambda rng: ([story(i, rng) for i in range(30)], [(0, i, 1) for i in range(1, 30)]),
    "random": lambda rng: ([story(i, rng) for i in range(60)], [(rng.randrange(64), rng.randrange(64), rng.randrange(1, 4)) for _ in range(150)]),
    "nothing": lambda rng: ([story(i, rng) for i in range(3)], [(1, 1, 1), (1, 77, 2)]),
}


@pytest.mark.parametrize("case", CASES)
def test_merges(spark, case):
    for seed in range(3 if case == "random" else 1):
        rng = random.Random(seed)
        stories, pairs = CASES[case](rng)
        stories[2] = (*stories[2][:7], 1, 1)  # gone before
        members = [(1, 500, 77, "u", "t", 4)]
        out, joined = merge_in_order(spark.createDataFrame(stories, STORY), spark.createDataFrame(members, MEMBER), spark.createDataFrame(pairs + pairs[:1], "a long, b long, layer int"))
        want = one_by_one(stories, members, pairs)
        assert sorted((r.id, r.superseded_by if r.superseded_by is not None else -1, r.coverage) for r in out.collect()) == want[0]
        assert sorted(map(tuple, joined.collect())) == want[1]

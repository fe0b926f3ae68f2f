"""Labels of a taxonomy against its closure, and what is no tree."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hierarchy


def test_labels_are_the_closure(spark):
    rng = random.Random(2)
    names = [f"n{rng.randrange(10**6)}" for _ in range(80)]
    tree = [(n, rng.choice(names[:i]) if i > 3 else rng.choice([None, "nowhere"])) for i, n in enumerate(names)]
    df = spark.createDataFrame(tree, "slug string, parent string")
    got = {r.slug: r for r in hierarchy.labels(df).collect()}
    closed = {(r.root, r.member) for r in hierarchy.closure(df, 40).collect()}
    assert {(a, b) for a in got for b in got if got[a].lo <= got[b].lo <= got[a].hi} == closed
    assert sorted(r.lo for r in got.values()) == list(range(1, 81)) and all(r.depth == sum(m == s for _, m in closed) - 1 for s, r in got.items())


def test_membership(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "slug string, parent string")
    labelled = hierarchy.labels(tree)
    lo = {r.slug: r.lo for r in labelled.collect()}
    rows = [(1, ["c"]), (2, ["d"]), (3, []), (4, None), (5, ["x"]), (6, ["a", "d"])]
    df = spark.createDataFrame([(i, t, [lo[x] for x in t if x in lo] if t is not None else None) for i, t in rows], "id int, tags array<string>, places array<int>")
    found = lambda *roots: [r.id for r in df.filter(hierarchy.inside(F.col("places"), F.col("tags"), labelled, roots)).orderBy("id").collect()]
    assert found("b") == [1] and found("a") == [1, 6] and found("d", "x") == [2, 5, 6] and found() == []


@pytest.mark.parametrize("tree", [[("a", "b"), ("b", "a")], [("r", None), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], [("a", None), ("b", None), ("c", "a"), ("c", "b")], [("a", "a")]])
def test_no_tree(spark, tree):
    with pytest.raises(ValueError, match="no tree"):
        hierarchy.labels(spark.createDataFrame(tree, "slug string, parent string"))

"""Connected components of a graph that stays distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


#: Neighbours from which on a vertex is a hub, whose rows find its minimum without meeting in one task.
HUB = 512


def _with_least(edges: DataFrame, own: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b, m): each edge with the least neighbour of a, a itself included if `own`; and (a, m) by itself.

    Minima are summed map-side. Those of hubs are few, 1/HUB of the edges at most: where their size allows, Spark sends them to the
    edges. What has its minimum already is dealt by b, so a hub's many edges do not meet in a task; only the others go to their minimum.
    """
    m = F.min("b")
    least = edges.groupBy("a").agg((F.least("a", m) if own else m).alias("m"), F.count("*").alias("n"))
    hubs = least.filter(F.col("n") > HUB).select("a", F.col("m").alias("hub_m"))
    marked = edges.join(hubs, "a", "left").withColumns({"done": F.col("hub_m").isNotNull(), "k": F.when(F.col("hub_m").isNull(), F.col("a")).otherwise(F.col("b"))})
    others = least.filter(F.col("n") <= HUB).select(F.col("a").alias("k"), "m", F.lit(False).alias("done"))
    return marked.join(others, ["k", "done"], "left").select("a", "b", F.coalesce("hub_m", "m").alias("m")), least.select("a", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, True)[0].filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    moved, least = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(a, b) long pairs to (id, component) with the smallest id reachable; ids without an edge do not appear.

    Each round is one written table, so no lineage grows and a lost executor costs one
    round at most. Loops (a = b) are dropped; an empty edge table gives an empty result. A hub
    of any degree is summed by its partial minimum, which goes to its edges (`_with_least`).
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct()
    seen = None
    for k in range(100):
        if k:  # each step is written, so that no plan holds the other's several times
            edges = _small_star(scratch.write(_large_star(edges), f"{name}-{k}-large"))
        edges = scratch.write(edges, f"{name}-{k}")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
        if mark[0] == 0 or (k > 1 and mark == seen):
            break
        seen = mark
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionByName(ids.select(F.col("component").alias("id"), "component").distinct())

"""A taxonomy tree: transitive closure, downward expansion, and labels by which an entry's members are a range."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closure(tree: DataFrame, deepest: int = 12) -> DataFrame:
    """(slug, parent) to (root, member, depth), each node a member of itself. The depth guard ends cycles; a node met twice keeps its least depth.

    One recursive query: Spark keeps each level's rows, so no level is computed again for the next.
    """
    steps = """
        WITH RECURSIVE down(root, member, depth) AS (
          SELECT slug, slug, 0 FROM {tree}
          UNION ALL SELECT down.root, t.slug, down.depth + 1 FROM down JOIN {tree} t ON t.parent = down.member WHERE down.depth < {last}
        ) SELECT root, member, depth FROM down LIMIT ALL"""
    return tree.sparkSession.sql(steps, tree=tree.select("slug", "parent"), last=deepest - 1).groupBy("root", "member").agg(F.min("depth").alias("depth"))


def expand(roots: DataFrame, closed: DataFrame) -> DataFrame:
    """Members of the given roots (slug); an unknown root expands to itself."""
    hit = roots.join(closed, roots.slug == closed.root, "left")
    return hit.select(F.coalesce("member", "slug").alias("slug")).distinct()


def labels(tree: DataFrame, deepest: int = 64) -> DataFrame:
    """(slug, depth, lo, hi) of a tree (slug, parent): numbers in pre-order, so that the entries under one are those whose `lo` lies in its lo to hi.

    One pass down from the roots (entries whose parent is null or unknown) gives each entry its path; a path sorts before those below it. What no
    root reaches is in a cycle or below one, and an entry met twice has two parents: both are refused. The numbering sorts a taxonomy, not facts.
    """
    tree = tree.select("slug", "parent").distinct()
    steps = """
        WITH RECURSIVE down(slug, path) AS (
          SELECT t.slug, array(t.slug) FROM {tree} t LEFT ANTI JOIN {tree} p ON p.slug = t.parent
          UNION ALL SELECT t.slug, array_append(down.path, t.slug) FROM down JOIN {tree} t ON t.parent = down.slug WHERE size(down.path) < {deepest}
        ) SELECT slug, path FROM down LIMIT ALL"""
    found = tree.sparkSession.sql(steps, tree=tree, deepest=deepest)
    below = found.select(F.explode("path").alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))
    numbered = found.withColumn("lo", F.row_number().over(Window.orderBy("path"))).join(below, "slug")
    every = numbered.agg(F.count("*").alias("n"), F.countDistinct("slug").alias("slugs")).crossJoin(tree.agg(F.countDistinct("slug").alias("given"))).first()
    if every.n != every.slugs or every.slugs != every.given:
        raise ValueError(f"no tree: {every.given - every.slugs} entries lie in or below cycles or deeper than {deepest}, {every.n - every.slugs} have several parents")
    return numbered.select("slug", (F.size("path") - 1).alias("depth"), "lo", (F.col("lo") + F.col("n") - 1).cast("int").alias("hi"))


def inside(places: Column, tags: Column, labelled: DataFrame, roots: Iterable[str]) -> Column:
    """Whether one of the places (`lo` of a story's tags) lies under one of the roots; an unknown root is its own only member. Reads a label for each root."""
    roots = list(dict.fromkeys(roots))
    spans = {r.slug: (r.lo, r.hi) for r in labelled.filter(F.col("slug").isin(roots)).collect()}
    under = lambda lo, hi: F.exists(places, lambda p: p.between(lo, hi))
    known = [under(*span) for span in spans.values()]
    own = [F.array_contains(tags, r) for r in roots if r not in spans]
    return F.coalesce(F.exists(F.array(F.lit(False), *[F.coalesce(c, F.lit(False)) for c in known + own]), lambda x: x), F.lit(False))

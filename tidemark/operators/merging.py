"""Merges of stories in order: a story that has lost takes no further part, as if the pairs were gone through one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import shared_folder


def _better(stories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(t, winner, loser) of each pair: who wins does not depend on what was merged before, only whether the pair still counts does."""
    rank = F.struct(F.col("never_canonical"), (-F.col("weight")).alias("weight"), F.col("collected"), F.col("id"))
    live = stories.filter("superseded_by IS NULL").select("id", rank.alias("rank"))
    side = lambda name: live.select(F.col("id").alias(name), F.col("rank").alias(f"{name}_rank"))
    both = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "layer").distinct().join(side("a"), "a").join(side("b"), "b")
    first = F.col("a_rank") < F.col("b_rank")
    return both.select(F.struct("layer", "a", "b").alias("t"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"))


def effective(stories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(t, winner, loser) of the pairs that merge two stories, if pairs (a, b, layer) are taken by layer, smaller id and larger id.

    A story goes with the first of its lost pairs whose winner is still there then. Both are bounded from what is known of the
    winners: the first pair that may count, and the first that surely does. The bounds of stories that never lose are known at once, and each
    round settles those that lose to settled ones; a star of any size takes one round, a chain as many as it is long at most. A round is one
    join and one sum over the pairs, and its bounds are written, so that a lost executor costs a round and no more.
    """
    spark, folder = stories.sparkSession, shared_folder(stories.sparkSession, "merges")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    decided = written(_better(stories, pairs), "decided")
    bounds = decided.groupBy("loser").agg(F.min("t").alias("soonest")).withColumn("surely", F.lit(None).cast(decided.schema["t"].dataType))
    number, unsettled = 0, True
    while unsettled:
        of_winner = bounds.select(F.col("loser").alias("winner"), "soonest", "surely")
        may = F.col("surely").isNull() | (F.col("surely") > F.col("t"))
        must = F.col("soonest").isNull() | (F.col("soonest") > F.col("t"))
        known = decided.join(of_winner, "winner", "left").groupBy("loser").agg(F.min(F.when(may, F.col("t"))).alias("soonest"), F.min(F.when(must, F.col("t"))).alias("surely"))
        bounds = written(known, f"round-{number}")
        number, unsettled = number + 1, not bounds.filter("NOT soonest <=> surely").isEmpty()
    return decided.join(bounds.select("loser", F.col("soonest").alias("t")), ["loser", "t"]).select("t", "winner", "loser")


def merge_in_order(stories: DataFrame, members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stories and members after the merges of `effective`.

    Stories have id, source, url, title, weight, never_canonical, collected, superseded_by and coverage. Of a pair that wins which may be
    canonical, else the heavier, the earlier, the smaller id. The loser is superseded by the winner and becomes its member: (story, member, source,
    url, title, layer), the story that it was, where, and by which layer. Members that came with a loser stay with it. Pairs with
    stories that are not live, with themselves or repeated do nothing more. Coverage is 1 and the other sources among a story's members.
    """
    merged = effective(stories, pairs)
    lost = merged.select(F.col("loser").alias("id"), F.col("winner").alias("_won"), F.col("t.layer").alias("_layer"))
    joined = stories.join(lost, "id").select(F.col("_won").alias("story"), F.col("id").alias("member"), "source", "url", "title", F.col("_layer").alias("layer"))
    every = members.select(joined.columns).unionByName(joined)
    others = every.select("story", "source").join(stories.select(F.col("id").alias("story"), F.col("source").alias("_own")), "story").filter("source <> _own")
    others = others.groupBy(F.col("story").alias("id")).agg(F.countDistinct("source").alias("_n"))
    out = stories.join(lost.drop("_layer"), "id", "left").join(others, "id", "left")
    out = out.withColumns({"superseded_by": F.coalesce("superseded_by", "_won"), "coverage": (1 + F.coalesce("_n", F.lit(0))).cast("long")})
    return out.select(stories.columns), every

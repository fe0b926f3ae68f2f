"""Keyed writes over plain tables: insert if absent, claim with takeover, accumulating upsert, change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of stored rows for a task that holds what they become; about a million line items.
PORTION = 16 << 20


def portions(*tables: DataFrame) -> int | None:
    """Tasks for steps that hold these tables' rows, a portion each; null where the session's own number is no smaller."""
    spark = tables[0].sparkSession
    stored = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    n = -(-stored // PORTION)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """The rows in `n` parts by their keys, so that joins and groups by them stay where they are; as they come for a null."""
    return rows.repartition(n, *keys) if n else rows


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of `new` to append: none whose key the target has, the first in `order` of each key."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")
    return first.join(target.select(*keys), keys, "left_anti")


def claim(owners: DataFrame, live: DataFrame, claims: DataFrame) -> DataFrame:
    """(key, owner): a key keeps its owner while that lives, else the smallest claimant takes it."""
    held = owners.join(live, "owner", "left_semi")
    free = claims.join(held.select("key"), "key", "left_anti").groupBy("key").agg(F.min("owner").alias("owner"))
    return held.select("key", "owner").unionByName(free)


def accumulate(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, first_seen, last_seen, hits, names) of both, merged: extremes, sums and set unions."""
    return old.unionByName(new).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before of the same key, nulls counting as values."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = df.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return seen.filter((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_n")


def timers(stories: DataFrame, at: str, as_of: str, offsets: tuple[int, ...]) -> DataFrame:
    """A row with `hours` and `due` for each story and offset; stories that are past the widest offset by `as_of` get none."""
    fresh = stories.filter(F.col(at) + F.make_interval(hours=F.lit(max(offsets))) > F.lit(as_of).cast("timestamp_ntz"))
    timed = fresh.withColumn("hours", F.explode(F.array(*map(F.lit, offsets))))
    return timed.withColumn("due", F.col(at) + F.make_interval(hours=F.col("hours")))

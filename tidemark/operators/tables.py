"""Tables that change: parquet folders, partitioned by one column, of which writes replace whole partitions.

A table lives in the shared folder that the cluster names in spark.checkpoint.dir, or wherever a path says. Every write replaces only the
partitions that it touches (dynamic partition overwrite), so a job that fails leaves the others as they are, and one that runs again writes the same. A large
partition is written by several tasks, as Spark rebalances what it writes. A change that stops half way is finished by the next read or change; readers
meanwhile may see some partitions changed and others not. One writer at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see. Only a local session without the setting gets one of this machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _same(a: DataFrame, b: DataFrame, column: str, how: str) -> DataFrame:
    """A semi- or anti-join on one column in which null is a value like others."""
    return a.join(b.select(F.col(column).alias("_same")), F.col(column).eqNullSafe(F.col("_same")), how)


class Table:
    """A folder of parquet partitions by `part`, an expression over the rows that is kept as the column of that name."""

    def __init__(self, spark: SparkSession, path: str, part: str):
        self.spark, self.path, self.part, self.schema = spark, path, part, None

    def read(self) -> DataFrame:
        self.recover()
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _write(self, rows: DataFrame, mode: str) -> None:
        self.schema = self.schema or rows.schema
        rows.select(self.schema.names).hint("rebalance", self.part).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(self.part).parquet(self.path)

    def append(self, rows: DataFrame) -> DataFrame:
        """Adds rows and returns them."""
        self._write(rows, "append")
        return rows

    def replace(self, rows: DataFrame) -> None:
        """Replaces every partition that the rows have a row of; the others stay."""
        self._write(rows, "overwrite")

    def change(self, touched: DataFrame, f: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the partitions named by `touched` (one column, the partition) as f of their rows. A partition that f leaves no row of
        is emptied. New rows are written beside the table before they replace anything, as they derive from what they replace.
        """
        self.recover()
        aside = f"{self.path}-change"
        touched.select(F.col(touched.columns[0]).alias(self.part)).distinct().write.parquet(f"{aside}/parts")
        parts = self.spark.read.schema(f"`{self.part}` {self.schema[self.part].dataType.simpleString()}").parquet(f"{aside}/parts")
        old = self.spark.read.schema(self.schema).parquet(self.path)
        f(_same(old, parts, self.part, "left_semi")).select(self.schema.names).write.parquet(f"{aside}/rows")
        self.recover()

    def recover(self) -> None:
        """Puts a change in place that has been written beside the table; what was not written to its end is forgotten. Doing it twice does no harm."""
        aside = f"{self.path}-change"
        if not self._exists(aside):
            return
        if self._exists(f"{aside}/rows/_SUCCESS"):
            if self.schema is None:
                self.schema = self.spark.read.parquet(f"{aside}/rows").schema
            new = self.spark.read.schema(self.schema).parquet(f"{aside}/rows")
            parts = self.spark.read.schema(f"`{self.part}` {self.schema[self.part].dataType.simpleString()}").parquet(f"{aside}/parts")
            self._write(new, "overwrite")
            self._drop(_same(parts, new.select(self.part).distinct(), self.part, "left_anti"))
        self._delete(aside)

    def upsert(self, rows: DataFrame, keys: list[str], merge: dict[str, Callable[[str], Column]]) -> None:
        """Rows by key, old and new ones merged: `merge` gives the aggregate of each other column. Keys must not move between partitions."""
        columns = [*keys, self.part, *merge]
        fold = lambda both: both.select(columns).groupBy(*keys, self.part).agg(*[f(c).alias(c) for c, f in merge.items()])
        if self.schema is None:
            self.replace(fold(rows))
            return
        self.change(rows.select(self.part), lambda old: fold(old.unionByName(rows.select(columns))))

    def update(self, source: DataFrame, keys: list[str], sets: dict[str, Column]) -> None:
        """UPDATE ... FROM: rows whose keys `source` holds, once each, get the given columns; partitions without one are not written."""
        hit = self.read().join(source.select(*keys), keys, "left_semi").select(self.part)
        marked = source.withColumn("_hit", F.lit(True))
        new = lambda old: old.join(marked, keys, "left").select(*[F.when(F.col("_hit"), sets[c]).otherwise(old[c]).alias(c) if c in sets else old[c] for c in self.schema.names])
        self.change(hit, new)

    def sweep(self, parents: DataFrame, keys: list[str]) -> int:
        """Deletes rows without a parent and returns how many; only partitions with such rows are written."""
        orphans = self.read().join(parents.select(*keys), keys, "left_anti")
        n = orphans.count()
        if n:
            self.change(orphans.select(self.part), lambda old: old.join(parents.select(*keys), keys, "left_semi"))
        return n

    def _drop(self, parts: DataFrame) -> None:
        for r in parts.toLocalIterator():  # emptied partitions; a folder each
            value = "__HIVE_DEFAULT_PARTITION__" if r[0] is None else self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(r[0]))
            self._delete(f"{self.path}/{self.part}={value}")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def merge_stories(stories: DataFrame, members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stories and members after merges.

    Stories have id, source, weight, never_canonical, collected, superseded_by and coverage; pairs are (a, b) of live stories. Of a pair the one wins that may be
    canonical, else the heavier, else the earlier, else the smaller id; the loser is superseded and its source is a member (story, source)
    of the winner. A story that loses several times goes to the best of its winners; coverage is 1 and the other sources among the members.
    """
    live = stories.filter("superseded_by IS NULL")
    rank = F.struct(F.col("never_canonical"), (-F.col("weight")).alias("weight"), F.col("collected"), F.col("id"))
    side = lambda name: live.select(F.col("id").alias(name), rank.alias(f"{name}_rank"), F.col("source").alias(f"{name}_source"))
    both = pairs.filter("a <> b").join(side("a"), "a").join(side("b"), "b")
    first = F.col("a_rank") < F.col("b_rank")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    decided = both.select(pick("a", "b").alias("winner"), pick("a_rank", "b_rank").alias("rank"), pick("b", "a").alias("loser"), pick("b_source", "a_source").alias("loser_source"))
    lost = decided.groupBy("loser").agg(F.min_by("winner", "rank").alias("winner"), F.min("loser_source").alias("loser_source"))
    new_members = members.select("story", "source").unionByName(lost.select(F.col("winner").alias("story"), F.col("loser_source").alias("source"))).distinct()
    marked = stories.drop("coverage").join(lost.select(F.col("loser").alias("id"), F.col("winner").alias("_won")), "id", "left")
    marked = marked.withColumn("superseded_by", F.coalesce("superseded_by", "_won")).drop("_won")
    others = new_members.join(stories.select(F.col("id").alias("story"), F.col("source").alias("_own")), "story").filter("source <> _own").groupBy(F.col("story").alias("id")).agg(F.countDistinct("source").alias("_n"))
    out = marked.join(others, "id", "left").withColumn("coverage", 1 + F.coalesce("_n", F.lit(0))).drop("_n")
    return out.select(stories.columns), new_members


def roll_up(items: Table, cube: Table, month: str, measures: list[Column], dirty: DataFrame, pruned: DataFrame) -> None:
    """Recomputes the cube's months that late rows made dirty (one column), but none that is pruned: its rows are gone."""
    months = _same(dirty.select(F.col(dirty.columns[0]).alias(month)).distinct(), pruned.select(F.col(pruned.columns[0]).alias(month)), month, "left_anti")
    rows = _same(items.read(), months, month, "left_semi").groupBy(month).agg(*measures)
    cube.replace(rows)

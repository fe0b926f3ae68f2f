"""Small aggregates: tallies by reason, shares with a floor of evidence, pairs within a row, keepers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(rows: DataFrame, keys: list[str], reasons: dict[str, Column]) -> DataFrame:
    """(keys, reason, n): how many rows each reason holds for; a row may fall under several, unknown counts as not."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()]))
    return rows.select(*keys, F.explode(named).alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def share(part: Column, whole: Column, least: int = 1, digits: int = 2) -> Column:
    """Percentage of the whole; null below `least` rows, as too little evidence is not zero."""
    return F.when(whole >= least, F.round(100.0 * part / whole, digits))


def pairs(array: str) -> Column:
    """Structs (a, b) of the distinct elements, a before b."""
    own = F.array_distinct(array)
    return F.flatten(F.transform(own, lambda x: F.transform(F.filter(own, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def contains_all(array: Column, wanted: Column) -> Column:
    """Whether every element of `wanted` is in the array."""
    return F.size(F.array_except(wanted, array)) == 0


def keepers(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows with `keeper`, the value of the first of their keys in order."""
    return rows.withColumn("keeper", F.first_value(value).over(Window.partitionBy(*keys).orderBy(*order)))

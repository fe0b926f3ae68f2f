"""Joins in the shapes that the analytic queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import shared_folder


def on_spine(spine: DataFrame, key: str, measures: list[DataFrame]) -> DataFrame:
    """Every row of the spine with the columns of tables that are grouped by the key already; null where one has nothing."""
    return reduce(lambda out, m: out.join(m, key, "left"), measures, spine)


def counted(spine: DataFrame, rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Every key of the spine with the number of its rows, 0 for none."""
    return spine.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").na.fill(0, [name])


def members(rows: DataFrame, array: str, entries: DataFrame, key: str) -> DataFrame:
    """A row for each element of `array` that `entries` has under `key`: an equi-join over the exploded array, not a search in it."""
    return rows.withColumn(key, F.explode(array)).join(entries, key)


def latest(spine: DataFrame, rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Every row of the spine with `columns` of the row that comes last in `order` under its key. The maximum is taken map-side."""
    last = rows.groupBy(key).agg(F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])).alias("r"))
    return spine.join(last, key, "left").select(*spine.columns, *[F.col(f"r._{c}").alias(c) for c in columns])


#: Stories or accounts of a block, about, and pairs that a task makes of them.
BLOCK, PAIRS = 512, 1 << 26


def wanted(stories: DataFrame, tags: DataFrame, words: DataFrame) -> DataFrame:
    """(account, id) of (account, tag) and (account, word) and stories (id, title, tags; ids are unique): a story's tag or a word in its title.

    Accounts that want the same are one profile, stories that have the same of what is wanted one offer. Offers meet profiles, once, at the first tag or
    word that both have, so nothing has to be made distinct: the pairs of accounts and stories, which grow with both, are made of blocks at the end and never
    move. They come as an account with a block's stories, the same stories for one account after another, which a column store keeps in little room.
    """
    spark, none = stories.sparkSession, F.array().cast("array<string>")
    tag, word = lambda c: F.concat(F.lit("tag "), c), lambda c: F.concat(F.lit("word "), c)
    asked = tags.select("account", tag("tag").alias("key")).unionByName(words.select("account", word(F.lower("word")).alias("key")))
    accounts = asked.groupBy("account").agg(F.sort_array(F.collect_set("key")).alias("want"))
    profiles = accounts.groupBy("want").agg(F.min("account").alias("profile"), F.count("*").alias("accounts"))
    said = F.split(F.lower("title"), r"[^\p{L}\p{N}]+")
    told = stories.select("id", F.explode(F.concat(F.transform(F.coalesce("tags", none), tag), F.transform(F.coalesce(said, none), word))).alias("key"))
    heard = told.join(profiles.select(F.explode("want").alias("key")).distinct(), "key", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("offer"))
    path = f"{shared_folder(spark, 'wanted')}/heard"  # written, as it is read for the offers and for their stories
    heard.write.parquet(path)
    heard = spark.read.parquet(path)
    offers = heard.groupBy("offer").agg(F.min("id").alias("first"), F.count("*").alias("ids"))
    met = offers.select("*", F.explode("offer").alias("key")).join(profiles.select("*", F.explode("want").alias("key")), "key").filter(F.get(F.array_intersect("offer", "want"), F.lit(0)) == F.col("key"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (met.agg(F.sum(F.col("ids") * F.col("accounts"))).first()[0] or 0) // PAIRS)
    parts = lambda c: F.ceil(F.col(c) / BLOCK)
    blocks = lambda rows, key, c, name: rows.select(key, F.pmod(F.xxhash64(c), parts(f"{c}s")).alias(name), c).groupBy(key, name).agg(F.sort_array(F.collect_list(c)).alias(f"{c}s"))
    met = met.withColumn("crowd", F.explode(F.sequence(F.lit(0), parts("accounts") - 1))).select("first", "ids", "profile", "crowd")
    met = met.join(blocks(accounts.join(profiles, "want"), "profile", "account", "crowd"), ["profile", "crowd"])
    met = met.select("first", F.explode(F.sequence(F.lit(0), parts("ids") - 1)).alias("run"), "accounts").repartition(n, "first", "run")
    met = met.join(blocks(heard.join(offers, "offer"), "first", "id", "run").repartition(n, "first", "run"), ["first", "run"])
    rest = F.size("ids") % 8  # apart, as packed numbers repeat from byte to byte after eight
    met = met.select("accounts", F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - rest), F.slice("ids", F.size("ids") - rest + 1, rest))).alias("ids")).filter(F.size("ids") > 0)
    return met.select(F.explode("accounts").alias("account"), "ids").select("account", F.explode("ids").alias("id"))


def by_name(asked: DataFrame, name: str, entries: DataFrame, key: str) -> DataFrame:
    """Rows with the key of the entry whose `name`, or one of whose `aliases`, is theirs, whatever its case; null for none."""
    names = entries.select(key, F.explode(F.array_union(F.array(F.lower("name")), F.transform("aliases", F.lower))).alias("_name")).distinct()
    return asked.join(names, F.lower(name) == F.col("_name"), "left").drop("_name")


def zipped(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """A row for each place of arrays that belong together; shorter ones are filled with nulls."""
    return rows.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("_z")).select(*keys, "_z.*")


def records(rows: DataFrame, body: str, fields: str) -> DataFrame:
    """A row for each record of a JSON array, with its `fields` as columns; bodies that are no array give none."""
    return rows.withColumn("_r", F.explode(F.from_json(body, f"array<struct<{', '.join(f.replace(' ', ': ') for f in fields.split(', '))}>>"))).select(*[c for c in rows.columns if c != body], "_r.*")


def unpivoted(rows: DataFrame, body: str) -> DataFrame:
    """A row with `name` and `value` for each number of a JSON object; bodies that are no object give none."""
    return rows.select(*[c for c in rows.columns if c != body], F.explode(F.from_json(body, "map<string, long>")).alias("name", "value"))


def united(lists: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, origin, given) of several lists: the value of the first list that has the key, that list's number and how many have it."""
    rows = reduce(DataFrame.unionByName, [t.select(key, value, F.lit(i + 1).alias("origin")) for i, t in enumerate(lists)])
    return rows.groupBy(key).agg(F.min_by(value, "origin").alias(value), F.min("origin").alias("origin"), F.count("*").alias("given"))

"""The registry of entries: what they have, where they stand, how they are ordered, and what is due for a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an entry may be asked to have, as conditions over its row (address, state, feed, repo, docs, aliases, children, parent, description).
HAVE = {
    "address": lambda: F.col("address").isNotNull(), "working": lambda: F.col("state") == "ok", "broken": lambda: F.col("state").isin("missing", "erroring", "unreachable"),
    "feed": lambda: F.col("feed").isNotNull(), "repo": lambda: F.col("repo").isNotNull(), "docs": lambda: F.col("docs").isNotNull(), "aliases": lambda: F.size("aliases") > 0,
    "children": lambda: F.col("children") > 0, "parent": lambda: F.col("parent").isNotNull(), "description": lambda: F.col("description").isNotNull(),
}


def having(entries: DataFrame, wanted: list[str], learning: DataFrame | None = None) -> DataFrame:
    """Entries that have everything wanted; `learning` (slug) names those with learning material. Unknown wishes are errors, unknown facts count as not had."""
    for name in wanted:
        if name != "learning":
            entries = entries.filter(F.coalesce(HAVE[name](), F.lit(False)))
    return entries.join(learning.select("slug"), "slug", "left_semi") if "learning" in wanted else entries


def activity(week: Column, recent: Column, last_month: Column, as_of: Column) -> Column:
    """hot, active, quiet, dormant or unseen: by stories of the last week, of the last months, and the month of the last one ever."""
    quiet = last_month >= F.trunc(F.add_months(as_of, -3), "MM")
    return F.when(week > 0, "hot").when(recent > 0, "active").when(quiet, "quiet").when(last_month.isNotNull(), "dormant").otherwise("unseen")


def platform_order(name: str) -> list[Column]:
    """Sort keys of platforms (name, stories, last_month, latest, channel, state); unknown orders are the default, by stories."""
    health = F.when(F.col("state").isNull(), 1).when(F.col("state") == "ok", 3).when(F.col("state") == "blocked", 2).otherwise(0)
    orders = {
        "name": [F.col("name").asc()], "recent": [F.greatest("last_month", "latest").desc_nulls_last(), F.col("name").asc()],
        "channel": [F.col("channel").asc(), F.col("name").asc()], "health": [health.asc(), F.col("name").asc()],
    }
    return orders.get(name, [F.coalesce("stories", F.lit(0)).desc(), F.col("name").asc()])


def named_in(stories: DataFrame, names: DataFrame) -> DataFrame:
    """(slug, id) of stories whose title holds an entry's name between characters that are no letters, as it is written.

    The pattern comes from the name's row; a title meets only names whose first word it holds, and what a name has of signs stands for itself.
    """
    quoted = F.regexp_replace("name", r"([^A-Za-z0-9 ])", r"\\$1")
    keyed = names.select("slug", F.concat(F.lit("(^|[^A-Za-z])"), quoted, F.lit("([^A-Za-z]|$)")).alias("pattern"), F.regexp_extract("name", "[A-Za-z]+", 0).alias("word")).filter("word <> ''")
    words = stories.select("id", "title", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[A-Za-z]+"), F.lit(0)))).alias("word"))
    return words.join(keyed, "word").filter(F.regexp_like("title", F.col("pattern"))).select("slug", "id").distinct()


def due_for_look(entries: DataFrame, as_of: str, stale_hours: int, most_failures: int = 12, hours_each: int = 6) -> DataFrame:
    """Entries (measured_at, failed_at, failures) never or not lately measured, whose last failure lies six hours back for each failure so far, twelve at most."""
    now = F.lit(as_of).cast("timestamp_ntz")
    stale = F.col("measured_at").isNull() | (F.col("measured_at") < now - F.make_interval(hours=F.lit(stale_hours)))
    waited = F.col("failed_at").isNull() | (F.col("failed_at") < now - F.make_interval(hours=(F.least("failures", F.lit(most_failures)) * hours_each).cast("int")))
    return entries.filter(stale & waited)


def partial_date(time: Column, precision: Column) -> Column:
    """A time as far as it is known: 9 the year, 10 the month, 11 the day."""
    day = F.regexp_extract(time, r"^\+?(\d{4}-\d{2}-\d{2})", 1)
    return F.when(day == "", None).when(precision >= 11, day).when(precision == 10, F.left(day, F.lit(7))).when(precision == 9, F.left(day, F.lit(4)))


# What a source's type says as evidence, and whether it is independent of its subject.
EVIDENCE = {
    "PRIMARY_VENDOR": ("announcement", False), "PRIMARY_PROJECT": ("developer_adoption", False), "PRIMARY_GOVERNMENT": ("market_expansion", True), "PRIMARY_RESEARCH": ("announcement", False),
    "RESEARCH": ("announcement", True), "MAJOR_JOURNALISM": ("commercial_adoption", True), "TECHNICAL_JOURNALISM": ("production_adoption", True), "SPECIALIST_PUBLICATION": ("production_adoption", True),
    "REGIONAL_PUBLICATION": ("commercial_adoption", True), "COMMUNITY": ("interest", False), "MARKET_ANALYSIS": ("commercial_adoption", True), "DISCOVERY": ("interest", False),
}


def evidence(source_type: Column) -> Column:
    """Struct (rung, independent) of a type; null rung and not independent for an unknown one."""
    pick = lambda k: F.coalesce(*[F.when(source_type == t, F.lit(v[k])) for t, v in EVIDENCE.items()])
    return F.struct(pick(0).alias("rung"), F.coalesce(pick(1), F.lit(False)).alias("independent"))


def overlaid(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Settings (key, value, kind) with stored values over them where those can be read as the setting's kind (int, bool, text); other keys are no settings."""
    s = F.col("_stored")
    fits = F.when(F.col("kind") == "int", s.rlike(r"^-?\d+$")).when(F.col("kind") == "bool", s.isin("true", "false")).otherwise(s.isNotNull())
    rows = defaults.join(stored.select("key", F.col("value").alias("_stored")), "key", "left")
    return rows.withColumn("value", F.when(fits, s).otherwise(F.col("value"))).withColumn("own", F.coalesce(fits, F.lit(False))).drop("_stored")


def display_names(slugs: DataFrame, *tables: DataFrame) -> DataFrame:
    """(slug, name) by the first of the tables (slug, name) that has the slug."""
    rows = None
    for i, t in enumerate(tables):
        t = t.select("slug", "name", F.lit(i).alias("_no"))
        rows = t if rows is None else rows.unionByName(t)
    return slugs.join(rows.groupBy("slug").agg(F.min_by("name", F.struct("_no", "name")).alias("name")), "slug", "left")

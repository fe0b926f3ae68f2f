"""Reports of a day: their index, titles, claims that stand, counts of what was read, and texts in front of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index(reports: DataFrame, briefings: DataFrame, order: list[str]) -> DataFrame:
    """(day, title, fields): the newest report of each day and its briefings' fields in the declared order, unknown ones behind."""
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("generated_at"), "title"))
    newest = reports.withColumn("_r", place).filter("_r = 1").drop("_r")
    at = F.array_position(F.array(*map(F.lit, order)), F.col("field"))
    listed = briefings.withColumn("_at", F.when(at > 0, at).otherwise(len(order) + 1)).groupBy("day").agg(F.array_sort(F.collect_set(F.struct("_at", "field")))["field"].alias("fields"))
    return newest.join(listed, "day", "left").select("day", "title", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))


def standing(briefings: DataFrame, before: str, days: int = 30) -> DataFrame:
    """(field, day, claim, cited) of the claims in briefings (field, day, claims: array of claim and evidence) of the days before."""
    day = F.col("day")
    window = briefings.filter((day < F.lit(before).cast("date")) & (day > F.date_sub(F.lit(before).cast("date"), days)))
    return window.select("field", "day", F.explode("claims").alias("c")).select("field", "day", F.col("c.claim").alias("claim"), F.size("c.evidence").alias("cited"))


def titled(subjects: Column, roots: list[str], market: Column, fields: Column) -> Column:
    """A report's title: its first three distinct subjects that are no fields, `Market moves` before them where the market took two items or more, and how many fields were briefed."""
    named = F.array_distinct(F.filter(subjects, lambda s: ~s.isin(roots)))
    shown = F.transform(F.slice(named, 1, 3), lambda s: F.initcap(F.replace(s, F.lit("-"), F.lit(" "))))
    lead = F.when(F.size(named) > 0, F.array_join(shown, ", ")).otherwise("The day")
    briefed = F.concat(fields.cast("string"), F.when(fields == 1, " field briefed").otherwise(" fields briefed"))
    return F.when(fields == 0, "Nothing to report").otherwise(F.concat(F.when(market >= 2, "Market moves: ").otherwise(""), lead, F.lit(" — "), briefed))


def packed(items: DataFrame, group: str, order: list, most: int = 400) -> DataFrame:
    """(group, packet, n): the items (title, summary, source) of each group, numbered for citation in order; summaries end after `most` characters, as a packet has to fit in one question."""
    number = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    line = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), "title", F.lit("\n    "), F.left(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " "), F.lit(most)), F.lit("\n    source: "), F.col("source").cast("string"))
    rows = items.withColumn("_n", number).select(group, "_n", line.alias("line"))
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_n", "line")))["line"], "\n").alias("packet"), F.count("*").alias("n"))


def provenance(items: DataFrame, group: str) -> DataFrame:
    """What was read for each group: items, independent and first-party ones, sources, rungs of evidence."""
    return items.groupBy(group).agg(F.count("*").alias("read"), F.count_if("independent").alias("independent"), F.count_if(~F.col("independent")).alias("first_party"), F.countDistinct("source").alias("sources"), F.sort_array(F.collect_set("rung")).alias("rungs"))


def subjects(items: DataFrame, group: str, array: str = "tags", most: int = 20) -> DataFrame:
    """The subjects named most in each group, with their place."""
    n = items.select(group, F.explode(array).alias("subject")).groupBy(group, "subject").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "subject"))).filter(F.col("place") <= most)


def letter_share(text: Column, first: int = 300) -> Column:
    """Share of letters and blanks among the first characters; 0 for none."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(first))
    return F.when(head == "", 0.0).otherwise(F.regexp_count(head, F.lit(r"[\p{L}\s]")) / F.length(head))


def repair(stored: Column, extracted: Column, furniture: int = 60, least: int = 40) -> Column:
    """Why a stored summary should give way to what was extracted anew: `rubbish` where it is no language and that is, `furniture` where that begins in it within
    so many characters (digits aside), else null."""
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\d", "")
    head = F.left(bare(extracted), F.lit(furniture))
    at = F.call_function("locate", head, bare(stored))
    rubbish = (letter_share(stored) < 0.6) & (letter_share(extracted) >= 0.8)
    return F.when(rubbish, "rubbish").when((F.length(head) >= least) & (at > 1) & (at <= furniture + 1), "furniture")


def frontmatter(text: Column, key: str) -> Column:
    """A value of the block between dashes at a text's front, with the lines that continue it, unquoted; null where it is missing."""
    block = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    raw = F.regexp_extract(F.concat(block, F.lit("\n")), rf"(?m)^{key}:[ \t]*(.*(?:\r?\n[ \t]+\S.*)*)$", 1)
    value = F.trim(F.regexp_replace(raw, r"\s*\r?\n\s+", " "))
    quoted = value.rlike("(?s)^(\".*\"|'.*')$") & (F.length(value) >= 2)
    inner = F.replace(F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit('\\"'), F.lit('"')), F.lit("''"), F.lit("'"))
    return F.when(F.concat(block, F.lit("\n")).rlike(rf"(?m)^{key}:"), F.when(quoted, inner).otherwise(value))

"""Quality of sources over a window: how much they bring, how early, how much of it is theirs; null where there is too little evidence."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators.tables import shared_folder
from tidemark.operators.tallies import share


def evaluate(sources: DataFrame, fetches: DataFrame, stories: DataFrame, members: DataFrame, since: str) -> DataFrame:
    """Metrics of every source of `sources` (source) from what happened since a time.

    fetches: source, at, kept, refused, noisy, dupes, ok. stories: id, source, seen, published, tags, companies, platforms. members: story, source, at (who else carried it).
    Each table is grouped by source before it joins, so no join multiplies another. Density, noise and duplicates need 20 items,
    availability 10 polls, relevance 10 stories, originality 5 confirmations either way, early signal 10 tags.
    """
    start = F.lit(since).cast("timestamp_ntz")
    f = fetches.filter(F.col("at") >= start).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("kept", "refused", "noisy", "dupes")], F.count("*").alias("polls"), F.count_if("ok").alias("ok"))
    watching = stories.groupBy("source").agg(F.min("seen").alias("since"))
    new = stories.filter(F.col("seen") >= start)
    any_of = lambda *arrays: reduce(Column.__or__, [F.coalesce(F.size(a), F.lit(0)) > 0 for a in arrays])
    lag = (F.unix_micros(F.col("seen").cast("timestamp")) - F.unix_micros(F.col("published").cast("timestamp"))) / 3.6e9
    told = new.join(watching, "source").groupBy("source").agg(
        F.count("*").alias("stories"), F.count_if(any_of("tags", "platforms", "companies")).alias("relevant"), F.count_if(any_of("tags")).alias("dev"), F.count_if(any_of("companies", "platforms")).alias("ent"),
        F.median(F.when(F.col("published") >= F.col("since"), lag)).alias("lag"),
    )
    carried = members.filter(F.col("at") >= start).join(stories.select(F.col("id").alias("story"), F.col("source").alias("owner")), "story").filter("source <> owner")
    confirmed = carried.groupBy(F.col("owner").alias("source")).agg(F.countDistinct("story").alias("confirmations"))
    followed = carried.groupBy("source").agg(F.count("*").alias("followed"))
    mentions = new.select("source", "seen", F.explode("tags").alias("slug")).groupBy("slug", "source").agg(F.min("seen").alias("at"))
    place = F.rank().over(Window.partitionBy("slug").orderBy("at"))
    early = mentions.withColumn("pos", place).groupBy("source").agg(F.count_if(F.col("pos") <= 3).alias("first"), F.count("*").alias("covered"))
    rows = reduce(lambda a, b: a.join(b, "source", "left"), [f, told, confirmed, followed, early], sources.select("source"))
    n = lambda c: F.coalesce(c, F.lit(0))
    pct = lambda part, whole, least: share(n(part), whole, least, 0).cast("int")
    judged = n("kept") + n("refused")
    return rows.select(
        "source", n("stories").alias("stories"), pct("kept", judged, 20).alias("density"), pct("noisy", judged, 20).alias("noise"), pct("dupes", n("dupes") + n("kept"), 20).alias("duplicates"),
        F.round(scores.freshness(F.col("lag")), 0).cast("int").alias("freshness"), pct("ok", n("polls"), 10).alias("availability"), pct("relevant", n("stories"), 10).alias("market"),
        pct("dev", n("stories"), 10).alias("developer"), pct("ent", n("stories"), 10).alias("enterprise"), pct("confirmations", n("confirmations") + n("followed"), 5).alias("originality"),
        pct("first", n("covered"), 10).alias("early"), n("confirmations").alias("confirmations"),
    )


def audit_verdict(refused: Column, judged: Column, technical: Column, listed_host: Column, least: int = 20, most_refused: float = 0.15) -> Column:
    """What an audit says of a source: host, unknown (too little seen), off_beat (over 15 % refused), thin (under half technical) or fine."""
    return F.when(listed_host, "host").when(judged < least, "unknown").when(refused / judged >= most_refused, "off_beat").when(technical / judged < 0.5, "thin").otherwise("fine")


#: Rows of a group that the greedy choice looks at in a round; Spark keeps the first so many of each partition before it shuffles, up to 1,000.
CHUNK = 1000


def diversify(rows: DataFrame, group: str, order: list[str], ignored: list[str] | None = None, per_source: int = 4, per_subject: int = 3, releases: int = 8, most: int = 40) -> DataFrame:
    """The rows (group, id, source, kind, tags, ...) that a briefing reads: greedily in `order` (columns, ascending, nulls last), at most so many of a source, of releases and in all; a row
    goes if each of its subjects has its share already, or one has twice its share. Rows without a subject share one.

    Greedy choice depends on order, so it runs group by group, but never on a whole group: a round takes the first `CHUNK` rows that can still be taken, and
    what has been taken decides which of the later rows can. The first of those always is, so there are `most` rounds at most, and mostly one.
    """
    spark, columns, skip = rows.sparkSession, rows.columns, set(ignored or [])
    path = shared_folder(spark, "diversified")
    places = [c for o in order for c in (F.col(o).isNull(), F.col(o))]
    none = F.array().cast("array<string>")
    named = F.filter(F.coalesce("tags", none), lambda t: ~F.coalesce(t.isin(*skip), F.lit(False))) if skip else F.coalesce("tags", none)
    named = F.when(F.size(named) == 0, F.array(F.lit(""))).otherwise(F.transform(named, lambda t: F.coalesce(F.concat(F.lit("="), t), F.lit(""))))
    release = F.coalesce(F.col("kind") == "release", F.lit(False))
    seen_often = lambda many, n: F.filter(F.array_distinct(many), lambda x: F.size(F.filter(many, lambda y: x.eqNullSafe(y))) >= n)

    def pick(frame):
        before, rest = frame[frame["place"].notna()].sort_values("place"), frame[frame["place"].isna()].sort_values(order, kind="stable")
        frame = pd.concat([before, rest]) if len(before) else rest
        of_source, of_subject, n_releases, taken = {}, {}, 0, []
        for i, (source, kind, tags) in enumerate(zip(frame["source"], frame["kind"], frame["tags"], strict=True)):
            if len(taken) >= most:
                break
            source = None if pd.isna(source) else source
            subjects = [t for t in (tags if tags is not None else []) if t not in skip] or [None]
            counts = [of_subject.get(s, 0) for s in subjects]
            full = of_source.get(source, 0) >= per_source or (kind == "release" and n_releases >= releases)
            if full or min(counts) >= per_subject or max(counts) >= 2 * per_subject:
                continue
            taken.append(i)
            n_releases += kind == "release"
            of_source[source] = of_source.get(source, 0) + 1
            for s in subjects:
                of_subject[s] = of_subject.get(s, 0) + 1
        out = frame.iloc[taken].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    def written(name, part):
        part.write.parquet(f"{path}/{name}")
        return spark.read.schema(part.schema).parquet(f"{path}/{name}")

    left = rows.filter(F.lit(min(per_source, per_subject, most) > 0) & (~release | F.lit(releases > 0)))
    taken, k = None, 0
    while True:
        first = left.withColumn("_r", F.rank().over(Window.partitionBy(group).orderBy(*places))).filter(F.col("_r") <= CHUNK)
        chunk = written(f"chunk-{k}", first.select(*columns, F.lit(None).cast("long").alias("place")))
        both = chunk.unionByName(taken) if taken else chunk
        taken = written(f"taken-{k}", both.groupBy(group).applyInPandas(pick, both.schema))
        looked = chunk.groupBy(group).agg(F.max(F.struct(*[c.alias(f"p{i}") for i, c in enumerate(places)])).alias("_last"), F.count("*").alias("_n")).filter(F.col("_n") >= CHUNK)
        held = taken.groupBy(group).agg(F.count("*").alias("_taken"), F.count_if(release).alias("_releases"), F.collect_list(F.struct("source")).alias("_sources"), F.flatten(F.collect_list(named)).alias("_subjects")).filter(F.col("_taken") < most)
        held = held.select(F.col(group).alias("_group"), "_releases", seen_often(F.col("_sources"), per_source).alias("_sources"), seen_often(F.col("_subjects"), per_subject).alias("_full"), seen_often(F.col("_subjects"), 2 * per_subject).alias("_over"))
        state = written(f"state-{k}", held.join(looked.withColumnRenamed(group, "_same"), F.col("_group").eqNullSafe(F.col("_same"))).drop("_same", "_n"))
        if state.isEmpty():
            return taken.select(*columns, "place")
        open_ = rows.join(state, F.col(group).eqNullSafe(F.col("_group"))).filter(F.struct(*[c.alias(f"p{i}") for i, c in enumerate(places)]) > F.col("_last"))
        open_ = open_.filter(~F.array_contains("_sources", F.struct("source")) & (~release | (F.col("_releases") < releases)))
        left, k = open_.filter((F.size(F.array_except(named, "_full")) > 0) & ~F.arrays_overlap(named, "_over")).select(*columns), k + 1


def item_reason(link: Column, title: Column, media: Column, blocked: Column, lang: Column, long_enough: Column, allowed: list[str]) -> Column:
    """The first reason for which an item is refused, cheapest first; null for one that stays."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(blank(link), "no_link").when(blank(title), "no_title").when(no(media), "media_enclosure").when(no(blocked), "blocked_host")
        .when(~no(lang.isin(*allowed)), "lang_gate").when(~no(long_enough), "too_short")
    )


def resolve(entries: DataFrame, typed: str, similarity: Column, floor: float = 0.34, exact: float = 1.0, alias: float = 0.97, prefix: float = 0.8, near: float = 0.7) -> DataFrame:
    """Entries (slug, name, aliases) that a typed name may mean, with `score`: the same, an alias, begun by it, or alike to `near` of their similarity, which must pass the floor to count alone."""
    t = typed.strip().lower()
    slug, name = F.lower("slug"), F.lower("name")
    known = F.coalesce(F.exists("aliases", lambda a: F.lower(a) == t), F.lit(False))
    begun = slug.startswith(t) | name.startswith(t)
    same = (slug == t) | (name == t)
    grade = F.when(same, exact).when(known, alias).when(begun, prefix).otherwise(0.0)
    hit = same | known | begun | (similarity > floor)
    return entries.filter(hit).withColumn("score", F.greatest(grade, similarity * near)) if t else entries.filter("false").withColumn("score", F.lit(0.0))

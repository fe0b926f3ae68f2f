"""Discovery of names that the vocabulary lacks: from addresses of releases, from titles, and the ledger of what emerges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text


def from_releases(stories: DataFrame, known_repos: DataFrame, known_slugs: DataFrame, samples: int = 3) -> DataFrame:
    """(term, name, repo, mentions, sources, samples, beside) of repositories whose releases stories (url, source, at, tags) report and nobody knows.

    A repository is known by its address (repo) or where one of its variants is a slug. Samples are the newest addresses; tags beside it come sorted.
    """
    found = F.lower(F.regexp_extract("url", r"github\.com/([^/]+/[^/]+)/releases", 1))
    rel = stories.select(found.alias("repo"), "url", "source", "at", "tags").filter("repo <> ''")
    newest = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "url")), asc=False), lambda x: x["url"]), 1, samples)
    beside = F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags"))))
    out = rel.groupBy("repo").agg(F.count("*").alias("mentions"), F.countDistinct("source").alias("sources"), newest.alias("samples"), beside.alias("beside"))
    owner, name = F.split_part("repo", F.lit("/"), F.lit(1)), F.split_part("repo", F.lit("/"), F.lit(2))
    out = out.join(known_repos.select(F.lower("repo").alias("repo")), "repo", "left_anti")
    known = out.select("repo", F.explode(text.repo_variants(owner, name)).alias("slug")).join(known_slugs, "slug", "left_semi").select("repo").distinct()
    return out.join(known, "repo", "left_anti").select(text.normal_term(name).alias("term"), text.pretty_repo(name).alias("name"), "repo", "mentions", "sources", "samples", "beside")


def from_titles(stories: DataFrame, known_slugs: DataFrame, excluded: DataFrame, common: list[str], least: int = 2) -> DataFrame:
    """(term, name, mentions, sources) of product-like words in titles of stories (id, title, source) that are neither known nor excluded
    (term) and stand in `least` stories. A word's spelling is the one that sorts first."""
    words = stories.select("id", "source", F.explode(text.candidate_terms(F.col("title"), common)).alias("name")).withColumn("term", text.normal_term(F.col("name")))
    out = words.filter(F.length("term") >= 3).groupBy("term").agg(F.min("name").alias("name"), F.countDistinct("id").alias("mentions"), F.countDistinct("source").alias("sources"))
    out = out.filter(F.col("mentions") >= least).join(known_slugs.select(F.lower("slug").alias("term")), "term", "left_anti")
    return out.join(excluded.select("term"), "term", "left_anti")


def ledger(old: DataFrame, sightings: DataFrame, taxonomy: DataFrame, sources: int = 2) -> DataFrame:
    """The ledger of emerging names after new sightings: slug, what, first_seen, last_seen, sightings, sources, independent, status.

    Sightings (slug, story, source, what, independent, at) count once for each story and source, those that `old` (the sightings recorded so far) holds
    among them; the first explanation stands. A name that two sources or an independent one carry is tracked, one of the taxonomy (slug) is none of the ledger's.
    An empty taxonomy is an error, as every known name would come back as new.
    """
    if taxonomy.isEmpty():
        raise ValueError("the taxonomy is empty")
    every = old.unionByName(sightings).join(taxonomy.select("slug"), "slug", "left_anti")
    one = every.groupBy("slug", "story", "source").agg(F.min("at").alias("at"), F.bool_or("independent").alias("independent"), F.min_by("what", F.when(F.col("what").isNotNull(), F.struct("at", "what"))).alias("what"))
    own = F.countDistinct(F.when(F.col("independent"), F.col("source")))
    first = F.min_by("what", F.when(F.col("what").isNotNull(), F.struct("at", "what")))
    out = one.groupBy("slug").agg(first.alias("what"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("sightings"), F.countDistinct("source").alias("sources"), own.alias("independent"))
    return out.withColumn("status", F.when((F.col("sources") >= sources) | (F.col("independent") >= 1), "tracked").otherwise("candidate"))


def prefilter(docs: DataFrame, slugs: DataFrame, roots: list[str], most: int = 120) -> DataFrame:
    """(id, slug): entries that stand somewhere in a text, inside of words too, by slug or with blanks for its hyphens: at most `most` in alphabetical order, and the roots.

    A text meets only slugs whose first letters (three, or two of shorter slugs) it holds, so the vocabulary is never tried whole. Slugs of one letter are left out.
    """
    plain = F.lower(F.coalesce("text", F.lit("")))
    held = lambda n: F.transform(F.sequence(F.lit(1), F.length("plain") - (n - 1)), lambda i: F.substring(F.col("plain"), i, F.lit(n)))
    docs = docs.select("id", plain.alias("plain"))
    grams = docs.select("id", F.explode(F.array_distinct(F.when(F.length("plain") >= 3, F.concat(held(2), held(3))).otherwise(F.array("plain")))).alias("gram"))
    spaced = slugs.select("slug", F.replace("slug", F.lit("-"), F.lit(" ")).alias("spaced")).filter(F.length("slug") >= 2)
    keyed = spaced.select("slug", "spaced", F.explode(F.array_distinct(F.array(F.substring("slug", 1, 3), F.substring("spaced", 1, 3)))).alias("gram"))
    near = grams.join(keyed, "gram").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("slug", "spaced"))).alias("near"))
    hit = lambda x: F.contains(F.col("plain"), x["slug"]) | F.contains(F.col("plain"), x["spaced"])
    none = F.array().cast("array<struct<slug:string,spaced:string>>")
    found = docs.join(near, "id", "left").select("id", F.slice(F.transform(F.filter(F.coalesce("near", none), hit), lambda x: x["slug"]), 1, most).alias("slugs"))
    return found.select("id", F.explode(F.array_union("slugs", F.array(*map(F.lit, roots)))).alias("slug"))


def promoted(candidates: DataFrame, mentions: Column, sources: Column, from_release: Column, least: int = 3) -> DataFrame:
    """Candidates with `status`: promoted where a release names them or enough stories of two sources do, else rejected if a person has dismissed them, else waiting."""
    enough = from_release & (mentions >= 1) | (mentions >= least) & (sources >= 2)
    return candidates.withColumn("status", F.when(F.col("dismissed"), "rejected").when(enough, "promoted").otherwise("waiting"))

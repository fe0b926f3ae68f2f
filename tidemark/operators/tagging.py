"""Tags texts with the names of vocabularies: by single words, or by whole names under rules for those that are ordinary words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import compare_form, without_urls


def tag_aliases(docs: DataFrame, aliases: DataFrame, most: int = 8) -> DataFrame:
    """(id, text) and (alias, slug) to (id, slug, hits): the `most` slugs that a text names most often, ties by slug.

    Words are counted within each text before they meet the vocabulary, so a very frequent word is one row a text. Null texts,
    null aliases and aliases of several words name nothing.
    """
    words = docs.select("id", F.explode(F.split(compare_form(F.col("text")), " ")).alias("alias")).filter("alias <> ''")
    counted = words.groupBy("id", "alias").agg(F.count("*").alias("hits"))
    known = aliases.select(F.lower("alias").alias("alias"), "slug").distinct()
    named = counted.join(known, "alias").groupBy("id", "slug").agg(F.sum("hits").alias("hits"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "slug"))
    return named.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def capped_top(df: DataFrame, group: str, source: str, order: list, per_source: int = 4, most: int = 40) -> DataFrame:
    """The first `most` rows of each group in `order` with at most `per_source` of one source, with their place.

    Under one cap, taking greedily equals ranking within the source first; both windows keep only their first rows before the shuffle.
    """
    within = F.row_number().over(Window.partitionBy(group, source).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_n", within).filter(F.col("_n") <= per_source).drop("_n").withColumn("place", place).filter(F.col("place") <= most)


# Names that are ordinary words, which count only as their owner writes them, and words that never name a technology.
AMBIGUOUS_COMPANIES = [
    "meta", "arm", "apple", "oracle", "linear app", "cursor", "spring", "go", "redis", "neon", "slack", "element", "canonical", "sentry", "grok",
    "docker",
]
AMBIGUOUS_NAMES = [
    "ant", "cat", "top", "less", "more", "tree", "make", "fish", "dash", "ash", "sed", "awk", "yes", "test", "time", "date", "sort", "join", "split",
    "seq", "go", "d", "r", "c", "hack", "ent", "uv", "nx", "next", "rust", "swift", "kotlin", "dart", "elm", "julia", "crystal", "nim", "zig", "v",
    "ada", "spring", "struts", "play", "meteor", "ember", "backbone", "knockout", "redis", "neon", "druid", "presto", "hive", "pig", "storm", "flink",
    "beam", "arrow", "parquet", "avro", "thrift", "mesa", "wayland", "sway", "i3", "atom", "brackets", "light table", "processing", "unity", "unreal",
    "godot", "chef", "puppet", "salt", "consul", "vault", "nomad", "packer", "habitat", "element", "signal", "session", "matrix", "delta", "iceberg",
    "hudi", "lens", "helm", "flux", "argo", "linkerd", "envoy", "contour", "ambassador", "drone", "cargo", "ring", "red", "arg", "oop", "swoop",
    "native", "jet", "bond", "pilot", "scout", "sentry", "falcon", "phoenix", "comet", "rocket", "anchor", "compass", "atlas", "mercury", "saturn",
    "apollo", "orion",
]
GENERIC = [
    "api", "apis", "app", "apps", "application", "art", "bot", "bots", "cli", "sdk", "web", "ui", "ux", "data", "code", "dev", "ops", "list", "lists",
    "awesome", "tutorial", "tutorials", "example", "examples", "sample", "samples", "demo", "project", "projects", "library", "libraries", "framework",
    "frameworks", "tool", "tools", "server", "client", "game", "games", "music", "video", "image", "images", "text", "file", "files", "json", "xml",
    "http", "https", "test", "tests", "testing", "build", "deploy", "design", "style", "theme", "plugin", "plugins", "package", "packages", "module",
    "modules", "script", "scripts", "template", "templates", "config", "setup", "install", "guide", "book", "books", "course", "blog", "news", "chat",
    "mail", "email", "search", "database", "db", "cloud", "mobile", "desktop", "terminal", "shell", "editor", "browser", "network", "security",
    "privacy", "monitoring", "analytics", "documentation", "docs", "readme", "license", "open-source", "opensource", "algorithm", "algorithms",
    "protocol", "format", "standard", "spec",
]


def _capitals(alias: Column) -> Column:
    """The alias with a capital at the start of each of its words."""
    return F.regexp_replace(F.initcap(F.regexp_replace(alias, r"([^\p{L}\p{N}_])", "$1 ")), r"([^\p{L}\p{N}_]) ", "$1")


def stack_names(aliases: DataFrame, common: list[str] | None = None) -> DataFrame:
    """(alias, slug, curated) to names of technologies: generic words and imported common ones go, ambiguous ones and those of one or two letters need capitals."""
    key = F.lower(F.trim("alias"))
    a = aliases.select(key.alias("alias"), "slug", F.coalesce("curated", F.lit(False)).alias("curated"), F.when(F.col("alias").rlike("[A-Z]"), F.col("alias")).alias("written"))
    ordinary = F.col("alias").isin(common or [])
    a = a.filter((F.length("alias") >= 2) & ~F.col("alias").isin(GENERIC) & (~ordinary | F.col("curated")))
    a = a.groupBy("alias").agg(F.min("slug").alias("slug"), F.min("written").alias("written"))
    strict = ordinary | F.col("alias").isin(AMBIGUOUS_NAMES) | F.col("alias").rlike("^[a-z]{1,2}$")
    return a.select("alias", "slug", F.when(strict, F.array_compact(F.array("written", _capitals(F.col("alias")), F.upper("alias")))).alias("forms"), F.lit("+#").alias("inner"))


def company_names(aliases: DataFrame) -> DataFrame:
    """(alias, slug) to names of companies: ambiguous and short ones need capitals."""
    a = aliases.select(F.lower("alias").alias("alias"), "slug").filter(F.length("alias") >= 2).groupBy("alias").agg(F.min("slug").alias("slug"))
    strict = F.col("alias").isin(AMBIGUOUS_COMPANIES) | (F.length("alias") <= 4)
    return a.select("alias", "slug", F.when(strict, F.array(_capitals(F.col("alias")), F.upper("alias"))).alias("forms"), F.lit("").alias("inner"))


def platform_names(platforms: DataFrame, claimed: DataFrame, held_out: list[str] | None = None) -> DataFrame:
    """(slug, name) to names of platforms, each only as it is written; those that a technology's alias (alias) claims go, and `held_out` slugs."""
    p = platforms.filter(~F.col("slug").isin(held_out or [])).select(F.lower(F.trim("name")).alias("alias"), "slug", "name").filter(F.length("alias") >= 3)
    p = p.join(claimed.select(F.lower("alias").alias("alias")).distinct(), "alias", "left_anti")
    return p.groupBy("alias").agg(F.min("slug").alias("slug"), F.min("name").alias("name")).select("alias", "slug", F.array("name").alias("forms"), F.lit("").alias("inner"))


def tag_names(docs: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(id, text) and names (alias, slug, forms, inner) to (id, slugs): at most `most` entries that a text names, in alphabetical order of aliases.

    A name must stand between characters that are no letters, digits or `inner`; where it has forms, one of them must stand so as it is written.
    Addresses name nothing. A text meets only names whose first word it holds: words and names are joined, and what is left is tested on the text.
    Null texts name nothing; rows that repeat an id are one text each.
    """
    clean = docs.select("id", without_urls(F.col("text")).alias("text")).filter("text IS NOT NULL")
    first = lambda x: F.regexp_extract(F.lower(x), "[a-z0-9]+", 0)
    quoted = lambda x: F.regexp_replace(x, r"([^A-Za-z0-9 ])", r"\\$1")
    around = lambda x, letters: F.concat(F.lit("(^|[^" + letters), F.col("inner"), F.lit("])(?:"), x, F.lit(")([^" + letters), F.col("inner"), F.lit("]|$)"))
    any_case = F.concat(F.lit("(?i)"), around(quoted(F.col("alias")), "a-z0-9"))
    strict = F.when(F.col("forms").isNotNull(), around(F.array_join(F.transform("forms", quoted), "|"), "A-Za-z0-9"))
    tests = names.select(first(F.col("alias")).alias("word"), F.struct("alias", "slug", any_case.alias("any_case"), strict.alias("strict")).alias("t")).filter("word <> ''")
    words = clean.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word"))
    near = words.join(tests, "word").groupBy("id").agg(F.sort_array(F.collect_set("t")).alias("tests"))
    fits = lambda t: F.regexp_like(F.col("text"), t["any_case"]) & F.coalesce(F.regexp_like(F.col("text"), t["strict"]), F.lit(True))
    found = clean.join(near, "id").select("id", F.transform(F.filter("tests", fits), lambda t: t["slug"]).alias("slugs"))
    return found.select("id", F.slice(F.array_distinct("slugs"), 1, most).alias("slugs")).filter(F.size("slugs") > 0)

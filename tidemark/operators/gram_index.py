"""Names found by likeness, beginning or inside, from posting lists of their trigrams instead of a look at every name."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import similarity, trigrams
from tidemark.operators.tables import shared_folder

#: Least similarity that is an answer.
FLOOR = 0.34


def _typed_grams(typed: str) -> set[str]:
    """The trigrams of a word are those of two blanks, the word and a blank."""
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", typed.lower()) for i in range(len(w) + 1)}


class GramIndex:
    """Postings (gram, name, n): each name under each of its n trigrams, sorted by gram over all files, so that a search reads the row groups of
    its grams. A gram that a third of all names have is spread over many files. `forms` leads from the names and aliases to whom they name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, forms: DataFrame, path: str | None = None) -> GramIndex:
        """`forms`: (slug, form, alias): what a slug is called, and whether that is an alias. Null forms are left out; the same form once a slug."""
        index = cls(forms.sparkSession, path or shared_folder(forms.sparkSession, "grams"))
        forms = forms.filter("form IS NOT NULL").groupBy("slug", F.lower("form").alias("form")).agg(F.min("alias").alias("alias"))
        forms.write.mode("overwrite").parquet(f"{index.path}/forms")
        names = forms.sparkSession.read.parquet(f"{index.path}/forms").select("form").distinct()
        grams = names.withColumn("grams", F.array_distinct(trigrams(F.col("form"))))
        grams = grams.select(F.explode("grams").alias("gram"), F.col("form").alias("name"), F.size("grams").alias("n"))
        grams.repartitionByRange("gram", "name").sortWithinPartitions("gram", "name").write.mode("overwrite").parquet(f"{index.path}/postings")
        return index

    def forms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/forms")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def candidates(self, typed: str, floor: float = FLOOR) -> DataFrame:
        """(name) of the names that can be as similar as `floor`: of q grams such a name shares floor * q, so it has one of any q - floor * q + 1 of
        them, the rarest of which are looked up; and its own grams are floor * q to q / floor."""
        grams = _typed_grams(typed)
        q = len(grams)
        counts = {r.gram: r.n for r in self.postings().filter(F.col("gram").isin(sorted(grams))).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row for each gram typed
        rare = sorted(grams, key=lambda g: (counts.get(g, 0), g))[: q - math.ceil(floor * q - 1e-9) + 1]
        near = F.col("n").between(math.ceil(floor * q - 1e-9), math.floor(q / floor + 1e-9))
        return self.postings().filter(F.col("gram").isin(rare) & near).select("name").distinct()

    def similar(self, typed: str, floor: float = FLOOR) -> DataFrame:
        """(name, likeness) of the names whose trigram similarity to what was typed is at least `floor`, exactly."""
        found = self.candidates(typed, floor).withColumn("likeness", similarity(F.col("name"), F.lit(typed.lower())))
        return found.filter(F.col("likeness") >= floor)

    def suggest(self, typed: str) -> DataFrame:
        """(slug, grade): 0 if a name is what was typed, 1 if one begins so, 2 if an alias begins so or is it, 3 if a name or alias contains it.

        What holds a text holds the trigrams inside its words; the rarest of them is looked up. Of fewer than three letters there are none, and all
        forms are looked at.
        """
        typed = typed.lower().strip()
        inside = {w[i : i + 3] for w in re.findall(r"[^\W_]+", typed) for i in range(len(w) - 2)}
        forms = self.forms()
        if inside:
            counts = {r.gram: r.n for r in self.postings().filter(F.col("gram").isin(sorted(inside))).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row for each gram typed
            rarest = min(inside, key=lambda g: (counts.get(g, 0), g))
            held = self.postings().filter((F.col("gram") == rarest) & F.contains("name", F.lit(typed))).select(F.col("name").alias("form"))
            forms = forms.join(held, "form", "left_semi")
        own = ~F.col("alias")
        grade = F.when(own & (F.col("form") == typed), 0).when(own & F.startswith("form", F.lit(typed)), 1).when(F.col("alias") & F.startswith("form", F.lit(typed)), 2).when(F.contains("form", F.lit(typed)), 3)
        return forms.withColumn("grade", grade).filter("grade IS NOT NULL").groupBy("slug").agg(F.min("grade").alias("grade"))

"""Names from their trigrams' postings against a look at every name; how few names are compared."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import similarity
from tidemark.operators.gram_index import GramIndex


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(4)
    parts = ["kube", "rnet", "es", "post", "gres", "sql", "data", "base", "cloud", "flare", "Éclair", "x", "c++", "go"]
    rows = [(f"s{i}", "".join(rng.choices(parts, k=rng.randrange(1, 4))) + rng.choice(["", " db", "_x"]), rng.random() < 0.3) for i in range(400)]
    rows += [("s1", None, False), ("s2", "", False), ("s3", "Kubernetes", False), ("s4", "kubernetes engine", True), ("s5", "my kubernetes", True), ("s3", "Kubernetes", True)]
    df = spark.createDataFrame(rows, "slug string, form string, alias boolean").repartition(3)
    return df, GramIndex.build(df)


@pytest.mark.parametrize("typed", ["kubernets", "Postgres SQL", "clod flare", "x", "éclair", "zzz", "", "data_base", "a"])
@pytest.mark.parametrize("floor", [0.2, 0.34, 0.8])
def test_similar(names, typed, floor):
    df, index = names
    scan = df.filter("form IS NOT NULL").select(F.lower("form").alias("name")).distinct().withColumn("likeness", similarity(F.col("name"), F.lit(typed.lower()))).filter(F.col("likeness") >= floor)
    assert sorted(map(tuple, index.similar(typed, floor).collect())) == sorted(map(tuple, scan.collect()))


def test_few_are_compared(names):
    df, index = names
    every, looked = df.select("form").distinct().count(), index.candidates("kubernetes engine").count()
    assert looked < every / 3


@pytest.mark.parametrize("typed", ["kubernetes", "sql", "go", "data", "s db", "nothing at all", " POST", "é"])
def test_suggest(names, typed):
    df, index = names
    t, best = typed.lower().strip(), {}
    for slug, form, alias in {(r.slug, r.form.lower(), r.alias) for r in df.collect() if r.form is not None}:
        grade = 0 if not alias and form == t else 1 if not alias and form.startswith(t) else 2 if alias and form.startswith(t) else 3 if t in form else None
        if grade is not None:
            best[slug] = min(grade, best.get(slug, 9))
    assert {r.slug: r.grade for r in index.suggest(typed).collect()} == best

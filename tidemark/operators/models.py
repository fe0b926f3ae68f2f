"""Judgements by a model that a caller brings: answers that are known come from a cache table, the others from the model or are deferred."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import Table, shared_folder

Scorer = Callable[[pd.Series], pd.Series]


def judged(rows: DataFrame, key: str, prompt: str, cache: DataFrame, scorer: Scorer | None = None, check: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows with `answer` and `outcome`: cached, ok, invalid (the answer fails the check, and is null) or deferred (no scorer).

    `cache` (key, answer) is joined first, so nothing is asked twice; rows that share a key are asked once. The scorer gets prompts batch by batch, in
    tasks, and gives an answer text for each.
    """
    known = cache.groupBy(key).agg(F.min("answer").alias("answer"))
    asked = rows.select(key, prompt).groupBy(key).agg(F.min(prompt).alias(prompt)).join(known, key, "left_anti")
    if scorer is None:
        new = asked.select(key, F.lit(None).cast("string").alias("answer"), F.lit("deferred").alias("outcome"))
    else:

        def run(frames):
            for f in frames:
                yield f[[key]].assign(answer=scorer(f[prompt]))

        schema = asked.select(key).schema.add("answer", "string")
        fits = (check or (lambda c: c.isNotNull()))(F.col("answer"))
        good = F.coalesce(fits, F.lit(False))
        new = asked.mapInPandas(run, schema).select(key, F.when(good, F.col("answer")).alias("answer"), F.when(good, "ok").otherwise("invalid").alias("outcome"))
    every = known.withColumn("outcome", F.lit("cached")).unionByName(new)
    return rows.join(every, key, "left")


def prompt_key(job: str, version: int, prompt: Column) -> Column:
    """What an answer is kept under: the job, the version of its prompt and the prompt, so that a new wording is asked anew."""
    return F.sha2(F.concat_ws("\n", F.lit(job), F.lit(version).cast("string"), F.coalesce(prompt, F.lit(""))), 256)


def judge_and_keep(rows: DataFrame, prompt: str, job: str, version: int, cache: Table, scorer: Scorer | None = None, check: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows with `answer` and `outcome` as `judged` gives them, new answers that pass the check written back to the cache.

    The cache is a table (part, job, version, input, answer) by `part`, the job; it may be empty. Each distinct prompt is asked once: answers are
    written beside the table first and both the cache and the result read that. Answers that fail and what was deferred are asked again the next time.
    """
    spark = rows.sparkSession
    if cache.schema is None:
        cache.append(spark.createDataFrame([], "part string, job string, version int, input string, answer string"))
    keyed = rows.withColumn("_key", prompt_key(job, version, F.col(prompt)))
    known = cache.read().filter((F.col("part") == job) & (F.col("version") == version)).select(F.col("input").alias("_key"), "answer")
    one = keyed.select("_key", F.col(prompt).alias("_prompt")).distinct()
    path = f"{shared_folder(spark, 'answers')}/new"
    judged(one, "_key", "_prompt", known, scorer, check).select("_key", "answer", "outcome").write.parquet(path)
    answers = spark.read.parquet(path)
    fresh = answers.filter("outcome = 'ok'").select(F.lit(job).alias("part"), F.lit(job).alias("job"), F.lit(version).alias("version"), F.col("_key").alias("input"), "answer")
    if not fresh.isEmpty():
        cache.append(fresh)
    return keyed.join(answers, "_key", "left").drop("_key")


def ambiguous_pairs(pairs: DataFrame, cache: DataFrame, scorer: Scorer | None = None, most: int = 200) -> DataFrame:
    """(id, other, same, outcome) of all ambiguous pairs: the nearest `most` are judged, `yes` merges them, all else keeps them apart, as a wrong merge
    loses a story. Pairs beyond `most` are waiting: apart until a later run takes them."""
    every = pairs.filter("outcome = 'ambiguous'").select("id", "other", "distance", F.concat_ws("|", "id", "other").alias("pair"))
    chosen = every.orderBy("distance", "id", "other").limit(most).drop("distance")
    asked = judged(chosen.withColumn("prompt", F.concat(F.lit("Same story? "), "pair")), "pair", "prompt", cache, scorer, lambda a: a.isin("yes", "no"))
    answers = asked.select("pair", F.coalesce(F.col("answer") == "yes", F.lit(False)).alias("same"), "outcome")
    return every.join(answers, "pair", "left").select("id", "other", F.coalesce("same", F.lit(False)).alias("same"), F.coalesce("outcome", F.lit("waiting")).alias("outcome"))


def two_stages(rows: DataFrame, key: str, first: Scorer, second: Scorer, bar: int = 6) -> DataFrame:
    """The rows with `triage`, and `score`: those that triage puts at the bar or above are scored again, the others keep its score."""

    def run(frames):
        for f in frames:
            triage = first(f[key]).astype("int64")
            high = triage >= bar
            score = triage.copy()
            if high.any():
                score[high] = second(f[key][high]).astype("int64")
            yield f.assign(triage=triage, score=score)

    return rows.mapInPandas(run, rows.select("*").schema.add("triage", "long").add("score", "long"))


def may_train(providers: DataFrame) -> DataFrame:
    """Providers that tenants' texts may go to: none that trains on what it is given; unknown counts as training."""
    return providers.filter(~F.coalesce("trains", F.lit(True)))


def next_jobs(jobs: DataFrame, as_of: str, slots: int, attempts: int = 5) -> DataFrame:
    """The jobs (id, key, priority, run_after, leased_until, attempts) that would be leased now: due, with no live lease and tries left, one for
    each key, by priority and then by how long they have waited."""
    now = F.lit(as_of).cast("timestamp_ntz")
    due = jobs.filter((F.col("run_after") <= now) & (F.col("leased_until").isNull() | (F.col("leased_until") < now)) & (F.col("attempts") < attempts))
    order = [F.desc("priority"), "run_after", "id"]
    one = due.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter("_n = 1").drop("_n")
    return one.orderBy(*order).limit(slots)

"""Mixing sources to target weights by thresholds on a hash of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A document is taken at most so often.
MOST = 3
#: Hash bits: four levels of twelve.
BITS, LEVEL_BITS = 48, 12


def words(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash():
    """48 bits of MD5 of the decimal id and the text's MD5, so that rows which share an id have hashes of their own; nulls are empty."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to the target words of each source.

    Sharing out by weight, capping at `most` times the size and sharing the excess again ends at a
    water level: the sources with the smallest most * size / weight are full, the others get level * weight.
    One row per source is all that the window sees.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    rising = Window.orderBy("room", F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("room", F.col("cap") / F.col("w"))
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left_words") / F.col("left_w")).withColumn("full", F.col("room") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # of the first that is not full
    return s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * level)).select("source", "source_size", "target")


def thresholds(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, size, h), and for each source (s, source_size, target, passes, cut).

    A source whose target is q sizes and a remainder takes every document q times and once
    more those whose hash is below a threshold: the budgets of the passes are nested, each pass a subset of the one
    before, and only the last is partial. The threshold comes from histograms of words by source and hash
    bucket: cumulate the 4096 buckets, refine the one that the remainder ends in, and so on down to the last bit. No
    document is sorted, and a source with a third of all rows is summed map-side into 4096 rows. At
    the last bit the documents of one hash go in if that comes nearer to the target.
    """
    base = scratch.write(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words().alias("size"), id_hash().alias("h")), "sizes")
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    zero = F.lit(0).cast("long")
    state = scratch.write(plan.withColumnRenamed("source", "s").withColumns({"prefix": zero, "below": zero, "words": zero}), "level-0")
    same = F.col("source").eqNullSafe(F.col("s"))
    for level in range(1, BITS // LEVEL_BITS + 1):
        shift = BITS - level * LEVEL_BITS
        inside = base.join(state.select("s", "prefix"), same).filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        bins = inside.groupBy("source", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("in_bin"))
        upto = F.col("below") + F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin"))
        over = bins.join(state.select("s", "budget", "below"), same).withColumn("upto", upto).filter("upto > budget")
        edge = over.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("below"), "in_bin")).alias("e"))
        state = scratch.write(
            state.join(edge, same, "left").select(
                "s", "source_size", "target", "passes", "budget",
                F.coalesce("e.bin", F.shiftleft(F.col("prefix") + 1, LEVEL_BITS) - 1).alias("prefix"),
                F.coalesce("e.below", "below").alias("below"), F.coalesce("e.in_bin", zero).alias("words"),
            ), f"level-{level}")
    nearer = 2 * F.col("below") + F.col("words") < 2 * F.col("budget")
    return base, state.select("s", "source_size", "target", "passes", (F.col("prefix") + nearer.cast("long")).alias("cut"))


def _times(most: int):
    return F.least(F.col("passes") + (F.col("h") < F.col("cut")).cast("long"), F.lit(most).cast("long"))


def mix_plan(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, times): how often the mix takes each document.

    Null texts have size 0; null sources are one source; rows with the same id and text share their hash and so their
    fate; an empty table gives an empty plan. Other columns of `docs` are ignored.
    """
    base, cut = thresholds(docs, scratch, weights, most)
    return base.join(cut, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", _times(most).alias("times"))


def mix(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of `docs`, repeated as often as the plan takes it.

    A row's source and hash decide, against one row of thresholds per source: Spark
    broadcasts those where they are small, so texts are not shuffled.
    """
    _, cut = thresholds(docs, scratch, weights, most)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), id_hash().alias("h"))
    held = held.join(cut, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", _times(most).cast("int")).filter("times > 0")
    return held.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("n")).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM sizes),
roomy AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS room FROM weighted),
levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE) AS level FROM roomy
  WINDOW b AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN room <= level THEN cap::DOUBLE ELSE w * max(CASE WHEN room > level THEN level END) OVER () END AS target FROM levels
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS passes FROM targets
), rising AS (
  SELECT b.doc_id, b.size, b.h, p.*, sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h) AS upto, sum(b.size) OVER (PARTITION BY b.source, b.h) AS tied
  FROM base b JOIN plans p ON b.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN upto <= target - passes * source_size OR 2 * upto - tied < 2 * (target - passes * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rising
"""

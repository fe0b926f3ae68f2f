"""Importance resampling: documents drawn by how much likelier their features are in a target than in the corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, crc32_sql, one_batch, portions, table

#: Buckets of features; counts, gains and whatever else is kept for each of them is of this size whatever the corpus.
BUCKETS = 10_000
#: Words from which a document may be drawn.
LEAST_WORDS = 20
SEED = 7
#: Parts into which rows without an id are dealt, so that no score's rows are one task's.
PARTS = 64
#: Scores of one block of the histogram.
BLOCK = 256

#: A byte of a word as it counts (A-Z lower-cased), 0 for the others: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
_BYTE = np.array([b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint8)
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear part of a byte's step


class _Shift:
    """What zero bytes appended to a message do to its CRC-32, which is linear: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def table(self, n: int) -> np.ndarray:
        """Effect of n zero bytes on each value of each of the four bytes of a CRC."""
        if n not in self.tables:
            if len(self.tables) > 256:  # lengths of very long words: made again when they come again
                self.tables.clear()
            if n == 1:
                byte = np.arange(256, dtype=np.uint32)
                got = np.stack([_CRC, byte, byte << np.uint32(8), byte << np.uint32(16)])
            else:
                half = self.table(n // 2)
                got = self.apply(half, half)
                got = self.apply(self.table(1), got) if n % 2 else got
            self.tables[n] = got
        return self.tables[n]

    @staticmethod
    def apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        low = np.uint32(255)
        return table[0][crc & low] ^ table[1][(crc >> np.uint32(8)) & low] ^ table[2][(crc >> np.uint32(16)) & low] ^ table[3][crc >> np.uint32(24)]


_shift = _Shift()


def word_spans(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and where each text's begin. Null texts have none.

    The bytes of UTF-8 beyond ASCII are bytes of words, so a table of 256 entries tells words from what stands between them.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    low = _BYTE[raw]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[-1]]
    begins[cuts] = inside[cuts]  # a text's end ends a word
    at = np.flatnonzero(begins)
    kept = np.concatenate([[0], np.cumsum(inside)])
    starts = np.searchsorted(at, offsets)
    bounds = np.append(kept[at], kept[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])])
    return words, starts


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features (words, then pairs of neighbouring words), and the text that each is of.

    A pair's CRC comes from those of its words, so that no pair is ever spelt out; each distinct word of the batch is hashed once.
    """
    words, starts = word_spans(texts)
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy()
    distinct = coded.dictionary
    crc = np.fromiter(map(zlib.crc32, distinct.to_pylist()), np.uint32, len(distinct))
    spaced = np.fromiter((zlib.crc32(b" ", int(c)) for c in crc), np.uint32, len(crc))
    lengths = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    pairs = np.flatnonzero(text[1:] == text[:-1])
    left, right = index[pairs], index[pairs + 1]
    joint = np.zeros(len(pairs), np.uint32)
    of = lengths[right]
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[order])) + 1 if len(order) else []
    for group in np.split(order, edges):
        if len(group):
            joint[group] = _shift.apply(_shift.table(int(of[group[0]])), spaced[left[group]]) ^ crc[right[group]]
    return np.concatenate([crc[index], joint]).astype(np.int64) % buckets, np.concatenate([text, text[pairs]])


def feature_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket. A task sums all its texts before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in one_batch(batches):
            for part in portions(batch):
                total += np.bincount(feature_buckets(part["text"], buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    return texts.select(F.col(column).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 * log of how much likelier the target is to have a feature in it), with one added to all counts."""
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    every = Window.partitionBy(F.lit(0))  # `buckets` rows
    both = both.withColumns({"all_s": F.sum("s").over(every), "all_t": F.sum("t").over(every)})
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, column: str = "text") -> DataFrame:
    """`docs` as (row, n_features, weight): the floored mean of the gains of a text's features, 0 without any. `gain` has one value a bucket."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_batch(batches):
            for part in portions(batch):
                bucket, text = feature_buckets(part["text"], len(gain))
                n = np.bincount(text, minlength=part.num_rows)
                total = np.bincount(text, gain[bucket], part.num_rows).astype(np.int64)  # whole numbers far below 2^53
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.record_batch([part[0], pa.array(n.astype(np.int64)), pa.array(mean)], ["row", "n_features", "weight"])

    row = F.struct(*[docs[c] for c in docs.columns if c != column])
    held = docs.select(row.alias("row"), docs[column].cast("string").alias("text"))
    return held.mapInArrow(weigh, f"row {held.schema['row'].dataType.simpleString()}, n_features long, weight long")


def gumbel(key, seed: int = SEED):
    """floor(1000 * Gumbel noise) that a key and the seed give: adding it to log weights and keeping the largest samples without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(scored: DataFrame, eligible, share: tuple[int, int], scratch: Scratch) -> DataFrame:
    """`scored` (with doc_id, score and part) and `rank`: 1, 2, 3... for the highest scores of the eligible rows, null for all others.

    Scores are integers of a bounded range, so counting rows by score gives a histogram of bounded size; summing it from the top gives the
    rank that each score begins with, and the score in which floor(share * rows) ends. Only within a score are rows numbered, by id.
    Rows without an id come after the others of their score, part by part. Nothing sorts the whole table.
    """
    some = scored.filter(eligible)
    bins = scratch.write(some.groupBy(F.floor(F.col("score") / BLOCK).alias("block"), "score", "part").agg(F.count("*").alias("n")), "histogram")
    blocks = bins.groupBy("block").agg(F.sum("n").alias("n"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 256 scores
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("over"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("rows"))
    inside = Window.partitionBy("block").orderBy(F.col("score").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    first = bins.join(blocks, "block").select("score", "part", (F.col("over") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), F.floor(F.col("rows") * share[0] / share[1]).alias("wanted"))
    first = first.filter("before < wanted")
    left = scored.withColumn("eligible", F.coalesce(eligible, F.lit(False))).join(first, ["score", "part"], "left")
    drawn = left.filter("eligible AND before IS NOT NULL")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score", "part").orderBy("doc_id"))
    drawn = drawn.withColumn("rank", rank.cast("long")).withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")))
    others = left.filter("NOT eligible OR before IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).drop("before", "wanted", "eligible")


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, share: tuple[int, int] = (25, 100), least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs`; see the query's contract.

    Null and empty texts have no features and weight 0. Rows that repeat an id share its noise and, where their scores tie, ranks in any
    order; rows without an id take their text for a key and come last among equal scores. Empty tables give no rows, an empty target leaves
    all gains to the corpus. Other columns of either table are ignored.
    """
    gain = np.zeros(buckets, np.int64)
    # `buckets` rows, whatever the size of the corpus
    for r in gains(feature_counts(docs, buckets=buckets), feature_counts(target, buckets=buckets), buckets).collect():
        gain[r.bucket] = r.gain
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", gumbel(key, seed).alias("noise"))
    held = weights(rows, gain).select("row.doc_id", "n_features", "weight", (F.col("weight") + F.col("row.noise")).alias("score"))
    part = F.when(F.col("doc_id").isNull(), F.spark_partition_id() % PARTS + 1).otherwise(0)
    held = scratch.write(held.withColumn("part", part), "scores")  # parts are set once
    return draw(held, F.col("n_features") >= 2 * least_words - 1, share, scratch).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op11"))


OP11_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), worded AS (SELECT side, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded
), bucketed AS (SELECT f, CRC_OF_F % 10000 AS bucket FROM (SELECT DISTINCT f FROM features)
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM features JOIN bucketed USING (f) GROUP BY bucket
), gained AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), weighed AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN bucketed USING (f) JOIN gained USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w ON w.doc_id = d.doc_id
), ranked AS (SELECT *, n_features >= 39 AS able, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= (SELECT count(*) FROM scored WHERE n_features >= 39) * 25 // 100 THEN r END AS rank FROM ranked
""".replace("CRC_OF_F", crc32_sql("f"))

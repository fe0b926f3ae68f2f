"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Words of a shingle, and hashes kept: likeness has a standard error of 0.044 at most.
SHINGLE, K = 5, 128
_SPAN = float(1 << 64)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; of fewer words the whole sequence, of none nothing.

    Words are `[^\\x20\\x09-\\x0D]+`. Each word is hashed once and a shingle is the hash of its word hashes.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h):
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(n)]))
        return F.when(F.size(h) >= n, windows).when(F.size(h) > 0, F.array(F.aggregate(h, F.size(h).cast("long"), lambda a, w: F.xxhash64(a, w)))).otherwise(F.array().cast("array<long>"))

    # one-element array, so that the word hashes are computed once
    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.array(hashed), shingles))))


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k smallest shingle hashes of a text, ascending."""
    return F.slice(shingle_hashes(text, n), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches were taken of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance: the share of the union's k smallest hashes that both hold; 1 for two empty sketches."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range that k hashes span."""
    span = (F.element_at(a, -1).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds: resemblance times the union's size over a's."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), likeness(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)))


def merge_parts(parts: DataFrame, key: str, hashes: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch) of all parts of a key. Each task keeps the k smallest of a key before the shuffle, so a key may hold any share of the rows."""
    flat = parts.select(F.col(key), F.explode(hashes).alias("h")).distinct()
    least = flat.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).filter(F.col("r") <= k)
    some = least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch"))
    return parts.select(key).distinct().join(some, key, "left").select(key, F.coalesce("sketch", F.array().cast("array<long>")).alias("sketch"))


def as_text(hashes: Column) -> Column:
    """A sketch as hexadecimal digits, 16 a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def next_ids(ids: DataFrame, width: int = 4096) -> DataFrame:
    """(doc_id, next_id): the following distinct id of each; null after the last.

    Ids fall into buckets of `width`; a bucket's last id takes the first of the next filled
    bucket, which the same step finds over the buckets. Three levels leave one window a row for each width cubed.
    """

    def step(keys: DataFrame, level: int) -> DataFrame:
        if level == 3:
            return keys.withColumn("nxt", F.lead("v").over(Window.orderBy("v")))
        bucket = keys.withColumn("b", F.floor(F.col("v") / F.lit(width)))
        firsts = bucket.groupBy("b").agg(F.min("v").alias("first"))
        after = step(firsts.select(F.col("b").alias("v")), level + 1).withColumnRenamed("v", "b")
        after = after.join(firsts.select(F.col("b").alias("nxt"), "first"), "nxt", "left").select("b", "first")
        inner = bucket.withColumn("nxt", F.lead("v").over(Window.partitionBy("b").orderBy("v")))
        return inner.join(after, "b", "left").select("v", F.coalesce("nxt", "first").alias("nxt"))

    return step(ids.select(F.col("doc_id").cast("long").alias("v")).filter("v IS NOT NULL").distinct(), 0).select(F.col("v").alias("doc_id"), F.col("nxt").alias("next_id"))


def fingerprint(docs: DataFrame, k: int = K, n: int = SHINGLE, width: int = 64) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; see the query's contract.

    Texts are shuffled once, by buckets of `width` neighbouring ids, where a window finds the next document; the
    last of a bucket takes the first of the next filled bucket from a table of one document a bucket.

    The next document is that of the next larger doc_id (of several with one id, the smallest text), after the last
    the first; an only document is its own next. Rows without an id have no next document: their edit only cuts
    the end and near_next compares with an empty text. Null texts are empty. Other columns are ignored.
    """
    empty = F.array().cast("array<long>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = rows.filter("doc_id IS NOT NULL").withColumn("bucket", F.floor(F.col("doc_id") / F.lit(width))).repartition("bucket")
    order = next_ids(rows.filter("doc_id IS NOT NULL").select(F.floor(F.col("doc_id") / F.lit(width)).alias("doc_id")))
    start = rows.agg(F.floor(F.min("doc_id") / F.lit(width)).alias("start"))
    order = order.crossJoin(F.broadcast(start)).select(F.col("doc_id").alias("before"), F.coalesce("next_id", "start").alias("bucket"))  # start is one row
    firsts = near.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f")).join(order, "bucket")
    firsts = firsts.select("before", F.col("f.text").alias("first_text"), sketch(F.col("f.text"), k, n).alias("first_sk"))
    later = Window.partitionBy("bucket").orderBy("doc_id").rangeBetween(1, Window.unboundedFollowing)
    inner = near.withColumn("sk", sketch(F.col("text"), k, n)).withColumn("next", F.min(F.struct("doc_id", "text", "sk")).over(later))
    own = inner.join(firsts, F.col("bucket") == F.col("before"), "left").select("doc_id", "text", "sk", F.coalesce("next.text", "first_text").alias("next_text"), F.coalesce("next.sk", "first_sk").alias("next_sk"))
    lone = rows.filter("doc_id IS NULL").select("doc_id", "text", sketch(F.col("text"), k, n).alias("sk"), F.lit("").alias("next_text"), empty.alias("next_sk"))
    size = F.length("text").cast("long")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 4) as int))"), F.expr("left(next_text, cast(floor(length(text) / 4) as int))"))
    own = own.unionByName(lone).select("doc_id", size.alias("n_chars"), edited.alias("edited"), "sk", "next_sk")
    own = own.withColumn("edited_sk", sketch(F.col("edited"), k, n))
    return own.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sk")).alias("fingerprint"), as_text(F.col("edited_sk")).alias("edited_fingerprint"),
                      likeness(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk"), k).alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))

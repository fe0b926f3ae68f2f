"""Near-duplicate embeddings: p-stable Euclidean hashing, then exact cosines inside each bucket, between vectors whose sketches are near."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, mix, one_batch, table
from tidemark.llm.components import components

#: Width of a projection's cells for unit vectors, chance with which some table joins a pair just at the threshold,
#: and unrelated vectors that a bucket may hold on average: more projections keep that as the table grows.
WIDTH, RECALL, MATES = 1.6, 0.98, 256
#: Bits of a sketch, and the chance with which it may part a pair at the threshold.
BITS, SLIP = 128, 1e-9
#: A bucket of more vectors is dealt out as pairs of chunks of about this many.
CHUNK = 1024


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points at this distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def hashing_plan(n: int, threshold: float, width: float = WIDTH, recall: float = RECALL, mates: int = MATES) -> tuple[int, int]:
    """(tables, projections) for n vectors: so many projections that a bucket holds `mates` unrelated vectors at most, where
    unrelated ones stand at right angles, and so many tables that a pair at the threshold meets in one with chance `recall`."""
    near, far = same_cell(math.sqrt(2 - 2 * threshold), width), same_cell(math.sqrt(2), width)
    projections = max(2, math.ceil(math.log(max(n, 2) / mates) / -math.log(far)))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))), projections


def most_apart(threshold: float, bits: int = BITS, slip: float = SLIP) -> int:
    """Sketch bits in which two vectors at the threshold differ at most, but for a chance of `slip`."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    left, k = 1.0, 0
    while True:
        left -= math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if left <= slip or k == bits:
            return k
        k += 1


def _unit(column: pa.ListArray) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares of very large or small numbers finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def bucket_keys(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit key for each vector and table: floor((a.x + b) / width) of its projections, hashed together."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    a = rng.standard_normal((unit.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    keys = np.broadcast_to(np.arange(tables, dtype=np.uint64), (len(unit), tables)) + np.uint64(unit.shape[1] << 8)
    for j in range(projections):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return keys.view(np.int64)


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """Signs of BITS random projections as two 64-bit numbers a vector: pairs at an angle differ in its share of half a turn."""
    r = np.random.default_rng([seed, unit.shape[1], BITS]).standard_normal((unit.shape[1], BITS))
    return np.packbits(unit @ r > 0, axis=1).view(np.int64)


def _hasher(tables, projections, width, seed):
    def run(batches):
        for b in one_batch(batches):
            dims = np.diff(b["v"].offsets.to_numpy())
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                unit = _unit(part["v"])
                keys, sketch = bucket_keys(unit, tables, projections, width, seed), sketches(unit, seed)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("c", "h1", "h2", "least", "n", "v")), pa.array(list(keys), pa.list_(pa.int64())), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                                                 ["c", "h1", "h2", "least", "n", "v", "sigs", "s1", "s2"])

    return run


def _near(apart):
    """Of the rows of each bucket those that have another within `apart` bits of sketch."""

    def run(batches):
        for t, keys in _runs(batches, ("key",)):
            cuts = np.concatenate([[0], np.flatnonzero(keys[0, 1:] != keys[0, :-1]) + 1, [t.num_rows]])
            s = np.stack([t["s1"].to_numpy(), t["s2"].to_numpy()], axis=1).view(np.uint64)
            stay = np.zeros(t.num_rows, bool)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(lo, hi, 512) if hi - lo > 1 else ():
                    x = s[at : min(hi, at + 512), None]
                    differ = np.bitwise_count(x[:, :, 0] ^ s[None, lo:hi, 0]) + np.bitwise_count(x[:, :, 1] ^ s[None, lo:hi, 1])
                    stay[at : at + len(x)] = (differ <= apart).sum(axis=1) > 1  # itself is one
            if stay.any():
                yield from t.select(["key", "c"]).filter(pa.array(stay)).to_batches()

    return run


def _runs(batches, columns):
    """Tables that hold whole runs of equal values in `columns` of rows sorted by them; the last run of a batch waits for the next."""
    rest = None
    for b in one_batch(batches):
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        keys = np.stack([t[c].to_numpy() for c in columns])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(cut):
            yield t.slice(0, cut[-1]), keys[:, : cut[-1]]
            rest = t.slice(cut[-1])
        else:
            rest = t
    if rest is not None:
        yield rest, np.stack([rest[c].to_numpy() for c in columns])


def _least_reachable(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that links (a, b), given both ways, lead to from each row; a chain of links stays one piece."""
    order = np.argsort(ids, kind="stable")
    root = np.empty(len(ids), np.int64)
    root[order] = np.arange(len(ids))
    while True:
        lower = root.copy()
        np.minimum.at(lower, a, root[b])
        # a row points at the row of its root's rank: jumping there halves the length of a chain
        lower = np.minimum(lower, lower[order[lower]])
        if (lower == root).all():
            return ids[order[root]]
        root = lower


def _linker(threshold):
    def run(batches):
        for t, keys in _runs(batches, ("key", "i", "j")):
            t = t.combine_chunks()
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
            c, n, side = t["c"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy()
            vs, sigs = t["v"].combine_chunks(), t["sigs"].combine_chunks()
            sig = sigs.flatten().to_numpy().reshape(t.num_rows, -1)
            starts = vs.offsets.to_numpy()
            out = ([], [], [])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2 or len(set(np.diff(starts[lo : hi + 1]))) > 1:
                    continue
                no, i, j = int(np.argmax(sig[lo] == keys[0, lo])), keys[1, lo], keys[2, lo]
                unit = _unit(vs.slice(lo, hi - lo))
                rows = np.arange(hi - lo)
                left, right = (rows, rows) if i == j else (rows[side[lo:hi] == i], rows[side[lo:hi] == j])
                if not len(left) or not len(right):
                    continue
                linked = unit[left] @ unit[right].T >= threshold
                if i == j:
                    np.fill_diagonal(linked, False)
                x, y = np.nonzero(linked)
                if no and len(x):  # a pair counts in the first table that joins it
                    new = (sig[lo + left[x], :no] != sig[lo + right[y], :no]).all(axis=1)
                    x, y = x[new], y[new]
                if not len(x):
                    continue
                r, m = c[lo:hi], n[lo:hi]
                a, b = left[x], right[y]
                if i != j:
                    a, b = np.concatenate([a, b]), np.concatenate([b, a])
                links = np.bincount(a, m[b], hi - lo)
                least = _least_reachable(r, a, b)
                hit = links > 0
                out[0].append(r[hit]), out[1].append(links[hit].astype(np.int64)), out[2].append(least[hit])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["c", "links", "to"])

    return run


def link_embeddings(df: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tables: int | None = None,
                    projections: int | None = None, width: float = WIDTH, recall: float = RECALL, chunk: int = CHUNK, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors become one class with a number of its own and a multiplicity before anything is compared, so a vector that
    a third of all rows repeat is one member of its buckets. Buckets travel as keys, class numbers and sketches of 16 bytes first; only
    classes with another near them by sketch send their vectors. Every link is an exact cosine in double precision and counted in the first
    table that joins its pair. Large buckets go out whole as pairs of chunks; a task emits a count and the smallest class within reach of
    its links for each class, never its pairs. `hashing_plan` sets tables and projections where they are not given.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; only
    vectors of the same length are compared. A null id keeps its links, has a null component and is not kept, and gives its component no id. Repeated
    ids are separate vectors, whose links and components are their own. Other columns of `df` are ignored. An empty table gives an empty result.
    """
    v = F.col("v")
    exact = vector_col in df.columns and df.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if exact else "array<double>").alias("v"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine).withColumns({"h1": F.when(F.col("fine"), F.xxhash64("v")), "h2": F.when(F.col("fine"), F.xxhash64(F.lit(1), "v"))})
    if tables is None or projections is None:
        plan = hashing_plan(rows.filter("fine").count(), threshold, width, recall)
        tables, projections = tables or plan[0], projections or plan[1]
    one = rows.filter("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    schema = f"c long, h1 long, h2 long, least long, n long, v {'array<float>' if exact else 'array<double>'}, sigs array<long>, s1 long, s2 long"
    # class numbers are fixed by being written
    classes = scratch.write(one.withColumn("c", F.monotonically_increasing_id()).mapInArrow(_hasher(tables, projections, width, seed), schema), "classes")

    keys = classes.select("c", "s1", "s2", F.explode("sigs").alias("key"))
    hot = scratch.write(keys.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > chunk), "hot")
    marked = keys.join(hot, "key", "left")
    near = marked.filter("m IS NULL").select("key", "c", "s1", "s2").repartition("key").sortWithinPartitions("key").mapInArrow(_near(most_apart(threshold)), "key long, c long")
    chunks = F.ceil(F.col("m") / chunk).cast("int")
    large = marked.filter("m IS NOT NULL").select("key", "c", chunks.alias("nc"))
    placed = scratch.write(near.withColumn("nc", F.lit(1)).unionByName(large), "placed").withColumn("side", F.pmod(F.xxhash64("c"), "nc").cast("int"))
    dealt = (
        classes.select("c", "n", "sigs", "v").join(placed, "c")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
        .select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "c", "n", "sigs", "v")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )
    found = scratch.write(dealt.mapInArrow(_linker(threshold), "c long, links long, to long").groupBy("c", "to").agg(F.sum("links").alias("links")), "found")
    groups = components(found.select(F.col("c").alias("a"), F.col("to").alias("b")), scratch)
    linked = groups.join(classes.select(F.col("c").alias("id"), "least"), "id")
    heads = linked.groupBy("component").agg(F.min("least").alias("head"))
    counts = found.groupBy(F.col("c").alias("id")).agg(F.sum("links").alias("links"))
    members = groups.join(heads, "component").join(counts, "id").select(F.col("id").alias("c"), "head", "links")
    per_class = classes.select("c", "h1", "h2", "least", "n").join(members, "c", "left")
    per_class = per_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("head", "least").alias("component"))
    return rows.join(per_class, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"), Scratch(spark, "op1"))


#: Every pair compared; equal to the result as long as the tables miss no link, which is so on the test tables.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), c AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

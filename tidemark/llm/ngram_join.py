"""Jaccard self-join of word n-gram sets: candidate clusters, then signature trees with dual traversal inside each."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, gram_hashes, mix, one_batch, portions, table, word_hashes
from tidemark.llm.components import components
from tidemark.llm.embedding_dedup import _runs

#: Words of a shingle, and the linking share of intersection in union, as a fraction.
SHINGLE, SHARE = 3, (9, 10)
#: Bands of minhashes. Sets at 0.9 share one of 40 bands of 8 but for one pair in ten billion, sets at 0.3 share
#: one in 0.3 % of cases; each band of two sets' minhashes is drawn anew, so the bound holds for sets of any size.
BANDS, ROWS = 40, 8
#: Members of a cluster that one task joins; larger clusters go out as pairs of blocks.
BLOCK = 512
#: Keys from which on texts without an id are named by their hash, after the ids.
NAMELESS = 1 << 62
#: Children of a tree node.
FAN = 4
#: Bits of a block's number below its grade of size.
_GRADE = 32


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; of fewer than n words the whole sequence is one shingle."""
    words, at = word_hashes(texts, lower=True)
    grams, out = gram_hashes(words, n), []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        else:
            out.append(gram_hashes(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def minhash_bands(shingles: np.ndarray, seeds: np.ndarray, rows: int) -> np.ndarray:
    """One key a band of a non-empty set: the least of (x ^ seed) * odd over its shingles for each seed, hashed together by band."""
    least = np.full(len(seeds), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 256):
        x = shingles[i : i + 256, None] ^ seeds
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=0), out=least)
    keys = np.arange(len(seeds) // rows, dtype=np.uint64)
    for row in least.reshape(-1, rows).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def _seeds(bands: int, rows: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, bands * rows, dtype=np.uint64)


def _signatures(n, bands, rows):
    def run(batches):
        seeds = _seeds(bands, rows)
        for b in (part for batch in one_batch(batches) for part in portions(batch)):
            sets = shingle_sets(b["text"], n)
            pair = [(int(s.sum()), int(mix(s).sum())) if len(s) else (0, 0) for s in sets]
            h = np.array(pair, np.uint64).reshape(-1, 2).view(np.int64)
            keys = pa.array([minhash_bands(s, seeds, rows) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["id"], b["named"], pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), keys], ["id", "named", "n", "h1", "h2", "bands"])

    return run


def _members(n):
    def run(batches):
        for b in (part for batch in one_batch(batches) for part in portions(batch)):
            sets = [x.tobytes() for x in shingle_sets(b["text"], n)]
            yield pa.RecordBatch.from_arrays([b["cluster"], b["i"], b["j"], b["side"], b["id"], pa.array(sets, pa.binary())], ["cluster", "i", "j", "side", "rep", "set"])

    return run


class _Node:
    __slots__ = ("bits", "children", "high", "item", "low", "spare")


def _tree(items: list[tuple[int, np.ndarray]], width: int) -> _Node:
    """Signature tree over (place, set) in ascending size. A leaf holds a set's bitmap of `width` bits, its size, and
    how many of its tokens share a bit with another (spare); a node the OR of its children's bitmaps, their size range and largest spare."""
    level = []
    for place, s in items:
        leaf = _Node()
        flags = np.zeros(width, bool)
        flags[(s % np.uint64(width)).astype(np.int64)] = True
        leaf.bits, leaf.children, leaf.item = np.packbits(flags).view(np.uint64), (), place
        leaf.low = leaf.high = len(s)
        leaf.spare = len(s) - int(flags.sum())
        level.append(leaf)
    while len(level) > 1:
        above = []
        for i in range(0, len(level), FAN):
            node = _Node()
            node.children, node.item = level[i : i + FAN], -1
            node.bits = np.bitwise_or.reduce([c.bits for c in node.children])
            node.low, node.high, node.spare = min(c.low for c in node.children), max(c.high for c in node.children), max(c.spare for c in node.children)
            above.append(node)
        level = above
    return level[0]


def tree_join(sets: list[np.ndarray], left: list[int], right: list[int] | None = None, share: tuple[int, int] = SHARE) -> np.ndarray:
    """For each set the smallest place that links reach, by dual traversal of the signature tree(s).

    Two nodes can hold a link only if their size ranges allow the share and the bits that both have, with the
    tokens that may hide behind shared bits, suffice for it. Leaves are compared exactly. A pair of leaves that
    links have connected already needs no comparison.
    """
    up, down = share
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    width = max(64, 1 << int(2 * max(map(len, sets))).bit_length())
    width = min(width, 1 << 16)
    by_size = lambda places: sorted(((p, sets[p]) for p in places), key=lambda x: len(x[1]))
    a = _tree(by_size(left), width)
    stack = [(a, a if right is None else _tree(by_size(right), width))]
    while stack:
        x, y = stack.pop()
        if x is y:
            stack += [(c, d) for i, c in enumerate(x.children) for d in x.children[i:]]
            continue
        if x.high * down < y.low * up or y.high * down < x.low * up:
            continue
        # overlap / (sizes - overlap) >= up / down  <=>  overlap * (up + down) >= sizes * up
        if x.item >= 0 and y.item >= 0 and find(x.item) == find(y.item):
            continue
        most = min(int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.spare, y.spare), x.high, y.high)
        if most * (up + down) < (x.low + y.low) * up:
            continue
        if x.item >= 0 and y.item >= 0:
            s, t = sets[x.item], sets[y.item]
            both = len(np.intersect1d(s, t, assume_unique=True))
            if down * both >= up * (len(s) + len(t) - both):
                p, q = find(x.item), find(y.item)
                root[max(p, q)] = min(p, q)
        elif y.item >= 0 or (x.item < 0 and len(x.children) and x.high - x.low >= y.high - y.low):
            stack += [(c, y) for c in x.children]
        else:
            stack += [(x, c) for c in y.children]
    return np.array([find(i) for i in range(len(sets))])


def _joiner(share):
    def run(batches):
        for t, keys in _runs(batches, ("cluster", "i", "j")):
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
            rep, side, packed = t["rep"].to_numpy(), t["side"].to_numpy(), t["set"]
            out = ([], [])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                order = lo + np.argsort(rep[lo:hi], kind="stable")
                sets = [np.frombuffer(packed[int(i)].as_py(), np.uint64) for i in order]
                i, j = keys[1, lo], keys[2, lo]
                places = np.arange(hi - lo)
                if i == j:
                    roots = tree_join(sets, list(places), share=share)
                else:
                    left, right = places[side[order] == i], places[side[order] == j]
                    if not len(left) or not len(right):
                        continue
                    roots = tree_join(sets, list(left), list(right), share)
                moved = roots != places
                out[0].append(rep[order][moved]), out[1].append(rep[order][roots[moved]])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])

    return run


def _blocks(clusters: DataFrame, sizes: DataFrame, share: tuple[int, int], block: int, scratch: Scratch) -> DataFrame:
    """(id, cluster, i, j, side): members of clusters dealt out as pairs of blocks, numbered by size first.

    A cluster of up to `block` members is one block. In a larger one sets are graded by size, so that a link can only
    join a grade with itself or the next; each grade is cut by hash into blocks of about `block`. Pairs of blocks two grades apart never arise.
    """
    up, down = share
    grade = F.floor(F.ln("n") / (math.log(down / up) * 1.000001)).cast("long") if up < down else F.col("n")
    # at most a row for each `block` members: small enough to be sent to the members where its size allows
    large = scratch.write(clusters.groupBy("component").agg(F.count("*").alias("total")).filter(F.col("total") > block), "large-clusters")
    marked = clusters.join(large, "component", "left")
    small = marked.filter("total IS NULL").select("id", F.col("component").alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("i", "j", "side")])
    rows = scratch.write(marked.filter("total IS NOT NULL").join(sizes, "id").select("id", "component", grade.alias("k")), "graded")
    cells = rows.groupBy("component", "k").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    beside = lambda by: cells.select("component", (F.col("k") + by).alias("k"), F.col("nb").alias("before" if by > 0 else "after"))
    cells = scratch.write(cells.join(beside(1), ["component", "k"], "left").join(beside(-1), ["component", "k"], "left"), "cells")
    number = lambda k, nb: F.when(nb > 0, F.transform(F.sequence(F.lit(0), nb - 1), lambda x: F.shiftleft(k, _GRADE) + x)).otherwise(F.array().cast("array<long>"))
    k, none = F.col("k"), F.lit(0)
    near = F.concat(number(k, F.col("nb")), number(k - 1, F.coalesce("before", none)), number(k + 1, F.coalesce("after", none)))
    rows = rows.join(cells, ["component", "k"]).withColumn("side", F.shiftleft("k", _GRADE) + F.pmod(F.xxhash64("id"), "nb"))
    rows = rows.withColumn("other", F.explode(near)).select("id", F.col("component").alias("cluster"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    return small.unionByName(rows)


def join_ngrams(docs: DataFrame, scratch: Scratch, n: int = SHINGLE, share: tuple[int, int] = SHARE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs`.

    Equal sets become one class, by 128 bits of its hashes' sums. Classes that share a band of minhashes form
    candidate clusters: a link outside a cluster would need all 40 bands to differ. A class goes to its one cluster, so a
    passage or group that a third of all documents share costs each of them one row. In a cluster signature trees join the sets exactly.
    A cluster of more than `block` classes goes out as pairs of blocks of neighbouring sizes, and their results are united as components.

    Null or blank texts have no shingles and link with nothing: a row without an id then has component null. Other rows
    without an id are known by their text and may link; a component without any id is null. Rows that repeat an id have their own counts and are one
    document of the graph: what links with one of them links with all. An empty table gives an empty result; other columns are ignored.
    """
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    # texts without an id are vertices of their own: one key for all would link what has nothing in common
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64(text), F.lit(NAMELESS >> 1))
    rows_in = docs.select(F.coalesce(doc, nameless).alias("id"), doc.isNotNull().alias("named"), text.alias("text"))
    sigs = scratch.write(rows_in.mapInArrow(_signatures(n, bands, rows), "id long, named boolean, n long, h1 long, h2 long, bands array<long>"), "signatures")
    classes = scratch.write(sigs.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most").select("key", "least")
    close = keys.join(shared, "key").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    clusters = scratch.write(components(close, scratch, "candidates"), "clusters")

    placed = _blocks(clusters, classes.select(F.col("rep").alias("id"), "n"), share, block, scratch)
    # texts are dealt out by id at every size: what is in a cluster grows with the corpus
    worded = rows_in.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # a repeated id may have rows without a word
    members = worded.join(placed.hint("merge"), "id").mapInArrow(_members(n), "cluster long, i long, j long, side long, rep long, set binary")
    members = members.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = scratch.write(members.mapInArrow(_joiner(share), "a long, b long"), "links")
    member = sigs.select("id", "named", "n", "h1", "h2").join(classes.drop("bands"), ["n", "h1", "h2"], "left").select("id", "named", "n", "rep")
    member = scratch.write(member, "members")
    several = member.filter("named").groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most")
    same_id = member.join(several, "id").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    groups = components(links.unionByName(same_id), scratch, "links")
    out = member.join(groups.withColumnRenamed("id", "_id"), F.col("rep") == F.col("_id"), "left")
    out = out.select("id", "named", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("key"))
    component = F.when(F.col("key") < NAMELESS, F.col("key"))
    if (member.filter("named").agg(F.max("id")).first()[0] or 0) >= NAMELESS:
        # ids as large as the hashes: a component has the least of its ids
        big = out.filter("named").filter(F.col("key") >= NAMELESS).groupBy("key").agg(F.min("id").alias("least"))
        out, component = out.join(big, "key", "left"), F.coalesce(component, "least")
    return out.select(F.when(F.col("named"), F.col("id")).alias("doc_id"), "n_shingles", component.alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op10"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 90 * (na + nb - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

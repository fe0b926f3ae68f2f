"""Periodic runs in texts: stretches in which the same words come again and again, and texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_sql, gram_hashes, one_batch, portions, table

#: Words of the shortest run, and periods that it holds at least.
LEAST, TIMES = 24, 3
#: Names of a block, which are its key, and blocks of a piece that one automaton covers.
PARTS, PIECE = 8, 1 << 13


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Places from the first on at which both agree; steps double, so that what differs soon costs little."""
    n, at, step = min(len(a), len(b)), 0, 32
    a, b = a[:n], b[:n]
    while at < n:
        differs = a[at : at + step] != b[at : at + step]
        if differs.any():
            return at + int(np.argmax(differs))
        at, step = at + step, min(2 * step, 1 << 16)
    return n


class _Places:
    """Where the grams of a document's words come again."""

    def __init__(self, words: np.ndarray, size: int):
        grams = gram_hashes(words.astype(np.uint64), size)
        self.n, self.order = len(words), np.argsort(grams, kind="stable")
        ranked = grams[self.order]
        group = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if len(ranked) else ranked
        self.group = np.zeros(len(grams), np.int64)
        self.group[self.order] = group
        self.keys = group * (self.n + 1) + self.order

    def again(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Which of these places see their gram again at a distance of low to high - 1. Equal hashes of different grams say yes as well."""
        at = at[at < len(self.group)]
        base = self.group[at] * (self.n + 1)
        found = np.searchsorted(self.keys, base + np.minimum(at + low, self.n))
        there = found < len(self.keys)
        place = np.where(there, self.keys[np.minimum(found, len(self.keys) - 1)] - base, self.n + 1)
        return at[there & (place >= 0) & (place < at + high) & (place <= self.n)]


def _seeds(names: np.ndarray, blocks: np.ndarray, size: int, low: int) -> Iterator[tuple[int, int]]:
    """(s, t): the block of `size` words that begins at s, of those given, begins again at t, low to 2 * size - 1 words further on.

    names[i] stands for the `size` / PARTS words from i on. A block is a key of the automaton, the sequence of its PARTS names; what
    it is searched in are the names from each of the first places on in steps of a name's words. For one distance s only rises.
    """
    step = size // PARTS
    automaton, numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
    for s in blocks.tolist():
        key = tuple(names[s : s + size : step].tolist())
        numbers[s] = number = automaton.get(key, s)
        if number == s:
            automaton.add_word(key, s)
    automaton.make_automaton()
    first, last = int(blocks[0]), int(blocks[-1]) + 3 * size - step + 1
    for begin in range(first, min(first + step, len(names))):
        for end, number in automaton.iter(tuple(names[begin:last:step].tolist())):
            t = begin + (end - PARTS + 1) * step
            s = (t - low) // size * size
            while s > t - 2 * size:
                if numbers.get(s) == number:
                    yield s, t
                s -= size


def _doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Names of twice `step` words from those of `step`: equal words have equal names and others have not."""
    pairs = names[:-step].astype(np.int64) * (int(names.max()) + 1) + names[step:]
    return np.unique(pairs, return_inverse=True)[1]


def smallest_block(least: int) -> int:
    """Words of the smallest blocks, a power of two: a run of `least` words and three periods holds one that comes again."""
    return max(PARTS, 1 << (least // TIMES).bit_length() - 1)


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period.

    A run is a stretch with smallest period q that no neighbour extends, of at least `least` and 3 * q. Its first q words and more hold
    an aligned block of B words, B being the largest power of two up to q, which comes again q words later, inside the run (periods below
    the smallest block share its scale). So for each scale the aligned blocks are searched across the document, and where one comes again
    at a distance of B to 2 * B - 1 the words to both sides are compared for as long as they agree at that distance. All comparisons are
    exact. Only blocks whose first words come again at such a distance by their hash are searched for, and blocks inside a run with a
    period that divides the distance tell nothing new.

    Keys have eight numbers at every scale, which name an eighth of the block each, so an automaton of 8192 blocks has 65,536 nodes at most.
    """
    n, size = len(words), smallest_block(least)
    names = words  # of size / PARTS words from each place on
    for k in range((size // PARTS).bit_length() - 1 if n >= least else 0):
        names = _doubled(names, 1 << k)
    found: dict[tuple[int, int], int] = {}
    places, low = None, 1
    while max(least, TIMES * low) <= n:
        places = places or _Places(words, size)
        inside = {}
        for (start, end), q in found.items():
            if 2 * q <= size:  # two such runs share fewer words than a block has
                inside.update(dict.fromkeys(range(-(-start // size) * size, end - size + 1, size), (q, end)))
        done: dict[int, int] = {}
        for lo in range(0, n, PIECE * size):
            blocks = places.again(np.arange(lo, min(lo + PIECE * size, n - size + 1), size), low, 2 * size)
            if not len(blocks):
                continue
            for s, t in _seeds(names, blocks, size, low):
                d = t - s
                q, end = inside.get(s, (0, 0))
                if s < done.get(d, 0) or q and d % q == 0 and t + size <= end:
                    continue
                right = s + size + _reach(words[s + size :], words[t + size :])
                left = s - _reach(words[:s][::-1], words[d:t][::-1])
                done[d] = right
                start, end = left, right + d
                if end - start >= max(least, TIMES * d):
                    found[start, end] = min(d, found.get((start, end), d))
        low = 2 * size
        if max(least, TIMES * low) <= n:
            names, size = _doubled(names, size // PARTS), low
    return sorted(((start, end - start, q) for (start, end), q in found.items()), key=lambda r: (r[0], r[2]))


def _repeating(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The texts in which a hash comes twice."""
    order = np.lexsort([hashes, text])
    h, d = hashes[order], text[order]
    return np.unique(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])])


def find_runs(docs: DataFrame, column: str = "text", least: int = LEAST) -> DataFrame:
    """(row, n_words, runs, collapsed) of every row: `row` holds the other columns, `runs` (start, length, period) of each periodic run
    by start and period, `collapsed` the words outside of what any run repeats after its first period, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words, no runs and an empty collapsed text. Rows are judged one by one,
    so ids may be null or repeat, and nothing is shuffled. A text in which no words as many as the smallest block repeat holds no run.
    """
    size = smallest_block(least)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_batch(batches):
            for part in portions(batch):
                lists = pc.ascii_split_whitespace(pc.fill_null(part["text"], "").cast(pa.large_string()))
                words, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
                real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
                words = words.filter(pa.array(real))
                codes = words.dictionary_encode().indices.to_numpy()
                text = np.repeat(np.arange(part.num_rows), np.diff(starts))
                grams = gram_hashes(codes.astype(np.uint64), size)
                whole = text[: len(grams)] == text[size - 1 :][: len(grams)]
                change, of, at = np.zeros(len(codes) + 1, np.int64), [], []
                for d in _repeating(grams[whole], text[: len(grams)][whole]).tolist():
                    got = runs(codes[starts[d] : starts[d + 1]], least)
                    of += [d] * len(got)
                    at += got
                    for start, length, q in got:
                        change[starts[d] + start + q] += 1
                        change[starts[d] + start + length] -= 1
                kept = np.cumsum(change)[:-1] == 0
                ends = np.concatenate([[0], np.cumsum(kept)])[starts]
                left = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept)).cast(pa.string())), " ")
                offsets = np.searchsorted(np.array(of, np.int64), np.arange(part.num_rows + 1))
                fields = [pa.array([r[k] for r in at], pa.int64()) for k in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.record_batch([part[0], pa.array(np.diff(starts)), listed, left], ["row", "n_words", "runs", "collapsed"])

    held = docs.select(F.struct(*[docs[c] for c in docs.columns if c != column]).alias("row"), docs[column].cast("string").alias("text"))
    row = held.schema["row"].dataType.simpleString()
    return held.mapInArrow(search, f"row {row}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def greatest(found):
    """Of an array of runs by start and period, the one with the greatest length / period, the first among equals; null where there is none."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(found, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """`docs` with a periodic tail in about a tenth of the texts, which and where by the CRC-32 of the decimal doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(ws):
        a = F.pmod(g, F.size(ws))
        p = F.floor((F.size(ws) - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.element_at(ws, (a + F.pmod(i - a, p) + 1).cast("int")))), " ")

    planted = F.element_at(F.transform(F.array(words), tail), 1)
    return docs.withColumn("text", F.when((F.pmod(h, F.lit(10)) == 0) & (F.trim("text") != ""), planted).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = greatest(F.col("runs"))
    got = find_runs(docs).withColumn("best", best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return got.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w, CRC_OF_ID AS h FROM documents
), placed AS (
  SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM placed
), grams AS (
  SELECT doc_id, n, unnest(list_transform(range(n - 7), lambda i: {'i': i, 'g': array_to_string(w[i + 1 : i + 8], ' ')}), recursive := true) FROM planted WHERE n >= 24
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 8 + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id
), best AS (
  SELECT doc_id, start, length, period FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period OR o.length * r.period = r.length * o.period AND (o.start, o.period) < (r.start, r.period)))
), dropped AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
  FROM (SELECT p.doc_id, unnest(p.w) AS word, unnest(range(p.n)) AS i FROM planted p SEMI JOIN dropped d ON d.doc_id = p.doc_id) u
  ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM dropped) x ON x.doc_id = u.doc_id AND x.i = u.i GROUP BY doc_id
)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start, b.length, b.period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, array_to_string(p.w, ' '))) AS collapsed_sha256
FROM planted p LEFT JOIN told t ON t.doc_id = p.doc_id LEFT JOIN best b ON b.doc_id = p.doc_id LEFT JOIN kept k ON k.doc_id = p.doc_id
""".replace("CRC_OF_ID", crc32_sql("doc_id::VARCHAR"))

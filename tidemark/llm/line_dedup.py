"""Line dedup against an index of line hashes kept as levelled sorted runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, one_batch, own_key, portions, table

_BLANKS = b" \t\n\x0b\x0c\r"
#: Keys of fewer code points never count as repeated.
LEAST = 10
#: Batches that the query streams, and runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 4, 2


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lower-cased."""
    return [x.strip(_BLANKS) for x in text.lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _texts(column) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def _hashes(least):
    def run(batches):
        for b in (part for batch in one_batch(batches) for part in portions(batch)):
            docs, digests, seen = [], [], {}
            for doc, text in zip(b["id"].to_pylist(), _texts(b["text"]), strict=True):
                for key in set(line_keys(text)):
                    if _long_enough(key, least) and ((d := _digest(key)) not in seen or doc < seen[d]):
                        seen[d] = doc
            digests, docs = list(seen), list(seen.values())
            if docs:
                h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64())], ["h1", "h2", "owner"])

    return run


class LineIndex:
    """Hashes of all lines seen, each with the document that holds it, as sorted runs in levels.

    A batch merge-anti-joins every live run, and what remains becomes a run of level 0. A level of
    `fanout` runs is merged into one run of the next, so after n batches about fanout * log(n) runs are
    live and each hash has been rewritten log(n) times. Runs are 128-bit hashes, sorted, in bucket
    files of the warehouse, so an anti-join shuffles the batch but never the index.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.made = 0

    def _run(self, df: DataFrame) -> DataFrame:
        name = f"run_{self.scratch.root.rsplit('-', 1)[-1]}_{self.made}"
        self.made += 1
        df = df.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.scratch.path(name)).saveAsTable(name)
        out = self.spark.table(name)
        out.run_name = name
        return out

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Takes (h1, h2, owner) of a batch; returns the run of those that no earlier batch holds, each with its smallest owner."""
        new = keys.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
        for r in self.runs():
            new = new.join(r.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        run = self._run(new)
        self.levels = self.levels or [[]]
        self.levels[0].append(run)
        self._compact()
        return run

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels) and len(self.levels[k]) >= self.fanout:
            old, self.levels[k] = self.levels[k], []
            merged = old[0]
            for r in old[1:]:
                merged = merged.unionByName(r)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._run(merged))
            for r in old:
                self._forget(r)
            k += 1

    def _forget(self, run: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.run_name}")
        self.scratch.drop(run.run_name)

    def owned(self) -> DataFrame:
        """(h1, h2, owner) of everything seen."""
        out = None
        for r in self.runs():
            out = r if out is None else out.unionByName(r)
        return out


def _rebuild(least):
    """Appends what is left of each text; the text itself comes from a column of the row's struct."""

    def run(batches):
        for b in (part for batch in one_batch(batches) for part in portions(batch)):
            n_lines, n_dropped, kept = [], [], []
            ends = np.cumsum(b["owned"].value_lengths().fill_null(0).to_numpy())
            flat = b["owned"].flatten()
            packed = np.stack([flat.field(c).to_numpy() for c in (0, 1)], axis=1).astype(">i8").tobytes()
            for text, lo, hi in zip(_texts(b["text"]), [0, *ends[:-1]], ends, strict=True):
                mine = {packed[i : i + 16] for i in range(16 * lo, 16 * hi, 16)}
                lines = text.split(b"\n")
                stay = [x for x, key in zip(lines, line_keys(text), strict=True) if not _long_enough(key, least) or _digest(key) in mine]
                n_lines.append(len(lines)), n_dropped.append(len(lines) - len(stay)), kept.append(b"\n".join(stay))
            out = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b["row"], *out], ["row", "n_lines", "n_dropped", "kept"])

    return run


def dedup_lines(docs: DataFrame, scratch: Scratch, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of `docs` as a struct, and its text without lines that a smaller doc_id holds.

    Batches are ranges of doc_id in ascending order, so a key's first batch has its smallest holder, and the
    minimum inside that batch finds it. A key's row in the index is one however many documents hold
    it: tasks sum their keys first, and the rebuild asks for the keys that a document owns, never for all holders
    of a key. Texts are shuffled once, by document.

    Null or empty texts are one empty line. Rows with the same doc_id count as one document: they lose nothing
    to each other. Rows without an id come after all others, each text a document of its own. An empty table gives an empty
    result. Extra columns pass through in `row`, whatever their names.
    """
    spark = scratch.spark
    text = F.col("text").cast("string")
    rows = docs.select(own_key(text).alias("id"), text.alias("text"))
    lo, hi = docs.select(F.col("doc_id").cast("long").alias("id")).agg(F.min("id"), F.max("id")).first()
    index = LineIndex(spark, scratch, fanout)
    step = max(1, ((hi if hi is not None else lo or 0) - (lo or 0)) // batches + 1)
    for k in range(batches):
        part = rows.filter(f"id >= {(lo or 0) + k * step}" if k else "true")
        part = part.filter(f"id < {(lo or 0) + (k + 1) * step}" if k < batches - 1 else "true")
        index.add(part.mapInArrow(_hashes(least), "h1 long, h2 long, owner long"))
    owned = index.owned().groupBy(F.col("owner").alias("_owner")).agg(F.collect_list(F.struct("h1", "h2")).alias("owned"))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own_key(text).alias("_id"), text.alias("text"))
    joined = held.join(owned, F.col("_id") == F.col("_owner"), "left").select("row", "text", "owned")
    schema = joined.select("row").schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return joined.mapInArrow(_rebuild(least), schema)


def without_repeated_lines(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of `docs` with what is left as their text; documents that lose every line go."""
    out = dedup_lines(docs, scratch, **options).filter("n_dropped < n_lines")
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, Scratch(spark, "op3")).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), held AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT l.*, h.first_doc IS NOT NULL AND h.first_doc <> l.doc_id AS lost FROM keyed l LEFT JOIN held h USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

"""Scratch tables, word hashing and table access that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of a batch that goes to a Python worker: rows may hold texts of any length, and a worker holds several copies of a batch.
BATCH_BYTES = 4 << 20
#: Rows without an id count as coming after all others.
LAST = (1 << 63) - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the shared folder that the cluster names in spark.checkpoint.dir.

    What is written there survives lost executors. Only a local session without the setting
    (tests, a laptop) gets a temporary folder; a cluster without it is refused. Where the session
    sets no bound on the bytes of a batch for Python, it gets `BATCH_BYTES`.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` one text after another, and where each text's begin.

    Null texts have no words. Each distinct word of the batch is hashed once.
    """
    texts = pc.fill_null(texts, "")
    if lower:  # before the cast: what a cast makes of a slice, ascii_lower reads from the wrong place
        texts = pc.ascii_lower(texts)
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    words, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(real)])[starts]
    coded = words.filter(pa.array(real)).dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[coded.indices.to_numpy()], offsets


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; those that run over a text's end are the caller's to leave out."""
    m = max(0, len(words) - n + 1)
    h = np.full(m, np.uint64(n))
    for j in range(n):
        h = h * _ODD + words[j : j + m]
    return mix(h)


#: What a worker remembers from task to task, for functions of other operators to forget.
REMEMBERED: list[dict] = []


def one_batch(batches, keep: bool = False):
    """The batches of a task, without those that hold no row. A worker serves tasks of many operators: unless this one keeps it, what
    another remembers goes first, and what was freed goes back."""
    for memory in REMEMBERED if not keep else ():
        memory.clear()
    yield from (b for b in batches if b.num_rows)
    pa.default_memory_pool().release_unused()


def portions(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20):
    """The batch in slices of about `size` bytes of a text column, so that what is computed for each word stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    return (batch.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo)


def doc_key(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST))


def own_key(text, name: str = "doc_id"):
    """The id, and for rows without one a key beyond ids of 62 bits that their text gives: equal texts share it, others have their own."""
    return F.coalesce(F.col(name).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 61)))


def _half_byte(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the CRC-32 of a text's UTF-8 bytes, taken by half bytes, the low half first."""
    halves = f"list_transform(range(0, 2 * octet_length(encode({text}))), lambda k: ('0x' || hex(encode({text}))[(k // 2) * 2 + 2 - k % 2])::BIGINT)"
    steps = f"[{', '.join(str(_half_byte(x)) for x in range(16))}]::BIGINT[]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, x: xor(c >> 4, ({steps})[xor(c & 15, x) + 1])), 4294967295)"

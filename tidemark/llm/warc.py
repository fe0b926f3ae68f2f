"""WARC archives: one gzip member a record, written with revisits for equal payloads and read by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, one_batch, table

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a reading task's range, of a read, and of a candidate's header that must decode.
SPLIT, READ, HEAD = 4 << 20, 1 << 20, 512
#: A record's date: archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, length long, record_id string, record_type string, page_id long, target_uri string, payload_digest string, payload_length long, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header value without line ends or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record as a gzip member. A revisit has no block; its digest and length are those of the full payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = payload if refers_to is None else b""
    head = "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _writer(folder: str):
    def run(batches):
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        size = rows = 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for b in one_batch(batches):
                for i, url, html, to in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].fill_null("").cast(pa.binary()).to_pylist(), b["refers_to"].to_pylist(), strict=True):
                    member = record(i, url, html, to)
                    out.write(member)
                    size += len(member)
                    rows += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "records": [rows]})

    return run


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, least: int = 0) -> DataFrame:
    """Writes an archive a task into `folder`, one record for each row of `pages`; returns (path, size, records) of the archives.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is the
    response and the others revisit it. Payloads meet as SHA-1 hashes: one row a payload, however many pages
    have it, comes back to the pages. An attempt that fails leaves a file that the returned list does not name.

    A null html is an empty payload, a null url has no target. A row without an id is a response; rows that repeat the largest
    id of a payload are all responses. An empty table gives no records. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    last = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha", "last")
    dealt = rows.join(last, "sha", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last")))
    return scratch.write(dealt.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder), "path string, size long, records long"), "archives").filter("records > 0")


class _Window:
    """A file's bytes from a place on, read in steps, with what lies behind that place forgotten."""

    def __init__(self, file, at: int, step: int):
        self.file, self.at, self.step, self.data = file, at, step, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(self.step)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def _starts_here(window: _Window) -> bool:
    """Whether a member of a WARC record begins at the window's start: its first bytes decode to a version line."""
    while len(window.data) < HEAD and window.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(window.data[:HEAD], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(window: _Window) -> tuple[bytes, int]:
    """Decodes the member at the window's start and moves behind it."""
    unpacker, out, used = zlib.decompressobj(31), [], 0
    while True:
        out.append(unpacker.decompress(window.data))
        used += len(window.data) - len(unpacker.unused_data)
        window.skip(len(window.data) - len(unpacker.unused_data))
        if unpacker.eof:
            return b"".join(out), used
        if not window.data and not window.more():
            raise EOFError("an archive ends inside a record")


def records_in(uri: str, start: int, end: int, step: int = READ):
    """(offset, length, fields, block) of the records that begin in bytes [start, end) of an archive.

    Scans for the gzip magic from `start` on, takes a candidate whose first bytes decode to a WARC version line, and
    from there goes member by member; the last may reach beyond `end`. Magic bytes inside compressed
    data do not decode so, and a range without a record's start yields nothing.
    """
    fs, path = _store(uri)
    with fs.open_input_file(path) as file:
        window = _Window(file, start, step)
        while window.at < end:
            if not window.data.startswith(MAGIC) or not _starts_here(window):
                found = window.data.find(MAGIC, 1)
                if found > 0:
                    window.skip(found)
                    continue
                window.skip(max(0, len(window.data) - 2))
                if not window.more():
                    return
                if window.data.startswith(MAGIC):
                    continue
                if (found := window.data.find(MAGIC)) > 0:
                    window.skip(found)
                continue
            at = window.at
            data, length = _member(window)
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield at, length, fields, rest[: int(fields["Content-Length"])]
            while not window.data and window.more():
                pass
            if not window.data:
                return


def _page(name: str | None) -> int | None:
    inner = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def _reader(batches):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in one_batch(batches):
        for path, start, end in zip(*(b[c].to_pylist() for c in ("path", "start", "end")), strict=True):
            rows, size = [], 0
            for at, length, f, block in records_in(path, start, end):
                known = f.get("WARC-Payload-Length")
                response = f["WARC-Type"] == "response"
                rows.append((path, at, length, f["WARC-Record-ID"], f["WARC-Type"], _page(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), digest(block) if response else f["WARC-Payload-Digest"].removeprefix("sha1:"), len(block) if response else int(known) if known else None, _page(f.get("WARC-Refers-To")), block))
                size += len(block)
                if size > 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def read_warc(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, size) of archives to their records: each task takes a range of `split` bytes and owns the records that begin in it.

    A response's digest and length are taken from the payload read, a revisit's from its header.
    """
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split)
    n = archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1  # ranges; a fixed number of tasks, as the rows are too few to size them by
    return ranges.repartition(int(n), "path", "start").mapInArrow(_reader, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    archives = write_warc(table(spark, sf_dir, "pages"), scratch.path("warc"), scratch)
    return read_warc(archives).select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM q
"""

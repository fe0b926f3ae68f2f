"""Chat formatting: conversations rendered by a template whose output a parser reads back to the same turns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import one_batch, table

#: Turns of a segment that one row renders.
SEGMENT = 64


@dataclass(frozen=True)
class Template:
    """A conversation is one turn after another: opening, role, ": ", text, closing, line feed.

    In a text a backslash before a control string or another backslash takes its special meaning away; any other backslash
    stands for itself. In a role it does so before any character. So every text can be written in a way that reads back as it was,
    and most stand as they are.
    """

    opening: str = "### "
    closing: str = "</turn>"

    def control(self) -> str:
        return f"{re.escape(self.opening)}|{re.escape(self.closing)}"

    def escaped(self, text: str, level: int) -> str:
        """0: as it is; 1: with a backslash before control strings; 2: before backslashes as well, which always reads back."""
        if level == 0:
            return text
        return re.sub(self.control() if level == 1 else rf"\\|{self.control()}", lambda m: "\\" + m[0], text)

    def plain(self, text: str) -> str:
        """What an escaped text says."""
        return re.sub(rf"\\(\\|{self.control()})", r"\1", text)

    def turn(self, role: str, text: str, level: int) -> tuple[str, int]:
        """A rendered turn and where its text begins."""
        head = f"{self.opening}{re.sub(r'[\\:]', lambda m: '\\' + m[0], role)}: "
        return f"{head}{self.escaped(text, level)}{self.closing}\n", len(head)

    def parse(self, formatted: str) -> list[tuple[str, str, int, int]] | None:
        """(role, text, start, end) of each turn, start and end being those of the text as it is written; None for what the template cannot write.

        One pass from left to right, a control string at a time, without looking back: an unescaped opening inside a text makes it None.
        """
        head = re.compile(rf"{re.escape(self.opening)}((?:[^\\:]|\\[\\:])*): ")
        token = re.compile(rf"\\(?:\\|{self.control()})|{self.control()}")
        at, turns = 0, []
        while at < len(formatted):
            if not (begun := head.match(formatted, at)):
                return None
            start = at = begun.end()
            while (found := token.search(formatted, at)) and found[0][0] == "\\":
                at = found.end()
            if not found or found[0] != self.closing or formatted[found.end() : found.end() + 1] != "\n":
                return None
            turns.append((re.sub(r"\\([\\:])", r"\1", begun[1]), self.plain(formatted[start : found.start()]), start, found.start()))
            at = found.end() + 1
        return turns

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted turns and (start, end) of each text. What does not read back as it was is escaped further until it does."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            for level in range(3):
                written, start = self.turn(role, text, level)
                read = self.parse(written)
                if read and len(read) == 1 and read[0][:2] == (role, text):
                    break
            else:
                raise ValueError(f"a turn cannot be written by this template: {role!r}")
            parts.append(written)
            spans.append((at + start, at + read[0][3]))
            at += len(written)
        whole = "".join(parts)
        if [r[:2] for r in self.parse(whole)] != turns:
            raise ValueError("the turns together do not read back as they were")
        return whole, spans


def format_chats(rows: DataFrame, template: Template = Template(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, chars, mask): each conversation as the template writes it, its code points, and the stretches (start, length, in
    code points) of the texts to learn from, those of the roles in `learn`.

    Turns stand by `turn`, nulls last, ties by role and text; rows that repeat are turns like others. Null roles and texts are empty; rows
    without a conv_id are one conversation. An empty table gives no rows; other columns are ignored.

    Turns are dealt out in segments of 64 numbers, which tasks render and read back each by itself, so a conversation of any length has its
    work spread; only the finished segments meet, as one text a conversation is what is asked for. Turns with the same number are one segment.
    """
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    segments = rows.select("conv_id", F.floor(F.col("turn").cast("long") / SEGMENT).alias("segment"), turn.alias("t"))
    segments = segments.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    learned = frozenset(learn)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_batch(batches):
            for k in range(batch.num_rows):  # a segment at a time, as each holds many turns
                part = batch.slice(k, 1)
                turns = [(t["role"], t["text"]) for t in part["turns"][0].as_py()]
                whole, spans = template.render(turns)
                mask = [{"start": lo, "length": hi - lo} for (role, _), (lo, hi) in zip(turns, spans, strict=True) if role in learned]
                told = pa.array([mask], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
                yield pa.record_batch([part["conv_id"], part["segment"], pa.array([whole]), pa.array([len(whole)], pa.int64()), told], ["conv_id", "segment", "formatted", "chars", "mask"])

    of = segments.schema["conv_id"].dataType.simpleString()
    done = segments.mapInArrow(write, f"conv_id {of}, segment long, formatted string, chars long, mask array<struct<start:long,length:long>>")
    before = Window.partitionBy("conv_id").orderBy(F.col("segment").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    done = done.withColumn("at", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    moved = F.transform("mask", lambda m: F.struct((m["start"] + F.col("at")).alias("start"), m["length"].alias("length")))
    pieces = F.array_sort(F.collect_list(F.struct("at", F.col("segment").isNull().alias("late"), "formatted", "chars", moved.alias("mask"))))
    whole = done.groupBy("conv_id").agg(pieces.alias("p"))
    return whole.select("conv_id", F.array_join("p.formatted", "").alias("formatted"), F.aggregate("p.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"), F.flatten("p.mask").alias("mask"))


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, chars, turns, learned) of formatted conversations: the turns (role, text) that the parser finds in each, and the text under
    its mask, unescaped, with nothing between the stretches. What the template cannot have written is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_batch(batches):
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                whole, mask = part["formatted"][0].as_py(), part["mask"][0].as_py()
                turns = template.parse(whole)
                if turns is None:
                    raise ValueError(f"conversation {part['conv_id'][0]} is not of this template")
                listed = pa.array([[{"role": r, "text": t} for r, t, _, _ in turns]], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
                learned = "".join(template.plain(whole[m["start"] : m["start"] + m["length"]]) for m in mask)
                yield pa.record_batch([part["conv_id"], pa.array([len(whole)], pa.int64()), listed, pa.array([learned])], ["conv_id", "chars", "turns", "learned"])

    of = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "mask").mapInArrow(read, f"conv_id {of}, chars long, turns array<struct<role:string,text:string>>, learned string")


#: A conversation whose texts hold the template's own control strings.
HOSTILE = r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(HOSTILE).alias("text"))
    got = read_chats(format_chats(rows.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))


OP13_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), counted AS (
  SELECT *, length(text) - length(replace(text, '\', '')) AS slashes,
    (length(text) - length(replace(text, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '### ', ''))) // 4 AS controls,
    length(role) + length(role) - length(replace(replace(role, '\', ''), ':', '')) AS role_chars
  FROM every
), sized AS (
  SELECT *, 4 + role_chars + 2 + 8 + length(text) + CASE
    WHEN contains(text, '\\') OR ends_with(text, '\') OR contains(text, '\### ') OR contains(text, '\</turn>') THEN controls + slashes
    ELSE controls END AS chars
  FROM counted
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

"""Full-text search from an inverted index: postings of stems with their positions, phrases, and ranks by cover density."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.search import parse_query
from tidemark.functions.stemming import STOP_WORDS, stem_by
from tidemark.functions.text import compare_form
from tidemark.operators.tables import shared_folder

#: Distinct words whose stems a worker remembers.
REMEMBERED = 1 << 17
#: Bytes of text whose words a worker has in memory at a time, some 30 times as much with their places; a longer text is alone.
PIECE = 1 << 22
#: What an occurrence without a weight of its own adds to the rank at best.
BASE_WEIGHT = 0.1


def _stems(words: list[str], memory: dict[str, str | None], forms: dict[str, str]) -> list[str | None]:
    """Stems, null for stop words and for the empty word."""
    if len(memory) > REMEMBERED:
        memory.clear()
    for w in words:
        if w not in memory:
            memory[w] = None if w in STOP_WORDS or not w else stem_by(w, forms)
    return [memory[w] for w in words]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with PIECE bytes of text each, at least one row."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        taken = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, taken + PIECE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def postings(rows: DataFrame, key: str, text: Column, forms: dict[str, str] | None = None) -> DataFrame:
    """(id, term, positions): where each stem stands in each text, counting all its words from 1, stop words too.

    Words are runs of letters and digits in lower case. A null text has none. Each distinct word of a batch is stemmed once,
    those of the stems in `forms` by its patterns.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str | None] = {}
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            lists = pc.split_pattern(batch["text"], " ")
            words, ends = lists.flatten(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            coded = words.dictionary_encode()
            terms = pa.array(_stems(coded.dictionary.to_pylist(), memory, forms or {}), pa.string()).dictionary_encode()
            term = pc.take(terms.indices, coded.indices).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            position = np.arange(len(row)) - ends[:-1][row] + 1
            some = np.flatnonzero(~np.isnan(term)) if term.dtype.kind == "f" else np.arange(len(term))
            term, row, position = term[some].astype(np.int64), row[some], position[some]
            order = np.lexsort([position, term, row])
            term, row, position = term[order], row[order], position[order]
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])) if len(term) else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)), pa.int32()), pa.array(position, pa.int32()))
            yield pa.record_batch([batch["id"].take(pa.array(row[first])), terms.dictionary.take(pa.array(term[first])), listed], ["id", "term", "positions"])

    held = rows.select(F.col(key).alias("id"), compare_form(F.coalesce(text, F.lit(""))).alias("text"))
    return held.mapInArrow(post, f"id {held.schema['id'].dataType.simpleString()}, term string, positions array<int>")


@dataclass(frozen=True)
class Query:
    """Distinct units (each a word or phrase: offsets and stems) and alternatives of (wanted, unwanted) unit numbers."""

    units: tuple[tuple[tuple[int, str], ...], ...]
    alternatives: tuple[tuple[frozenset[int], frozenset[int]], ...]

    @classmethod
    def parse(cls, typed: str, widened: bool = False, forms: dict[str, str] | None = None) -> Query:
        """"a phrase", -word, `or` between alternatives; blanks mean and. Stop words are left out, in phrases they keep their
        place. Widened: any of the wanted words and phrases will do."""
        units: dict[tuple[tuple[int, str], ...], int] = {}
        alternatives = []
        for alternative in parse_query(typed):
            sides: tuple[set[int], set[int]] = set(), set()
            for wanted, words in alternative:
                kept = [(k, stem_by(w, forms or {})) for k, w in enumerate(words.split(" ")) if w not in STOP_WORDS]
                if kept:
                    unit = tuple((k - kept[0][0], s) for k, s in kept)
                    sides[not wanted].add(units.setdefault(unit, len(units)))
            if sides[0] or sides[1]:
                alternatives.append((frozenset(sides[0]), frozenset(sides[1])))
        if widened:
            alternatives = [(frozenset([u]), frozenset()) for u in sorted(set().union(*(w for w, _ in alternatives)))]
        return cls(tuple(units), tuple(dict.fromkeys(alternatives)))

    def terms(self) -> list[str]:
        return sorted({s for unit in self.units for _, s in unit})


class SearchIndex:
    """Postings in parquet, sorted by term and id over all files, so that the rows of a term lie together: a search reads the row groups
    whose range holds a wanted term. The range partitioning splits a term that stands in every text over many files. Ids lie beside them."""

    def __init__(self, spark: SparkSession, path: str, forms: dict[str, str] | None = None):
        self.spark, self.path, self.forms = spark, path, forms

    @classmethod
    def build(cls, rows: DataFrame, key: str, text: Column, path: str | None = None, files: int | None = None, forms: dict[str, str] | None = None) -> SearchIndex:
        """An index of `rows`, whose keys are unique; rows without a key are not in it. `forms` lists the forms of some stems, for texts and queries."""
        spark = rows.sparkSession
        index = cls(spark, path or shared_folder(spark, "search"), forms)
        rows = rows.filter(F.col(key).isNotNull())
        postings(rows, key, text, forms).write.mode("overwrite").parquet(f"{index.path}/unsorted")  # so that sampling for the ranges does not stem all texts again
        found = spark.read.parquet(f"{index.path}/unsorted")
        dealt = found.repartitionByRange(files, "term", "id") if files else found.repartitionByRange("term", "id")
        dealt.sortWithinPartitions("term", "id").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{index.path}/postings")
        rows.select(F.col(key).alias("id")).write.mode("overwrite").parquet(f"{index.path}/ids")
        return index

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def ids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ids")

    def occurrences(self, query: Query) -> DataFrame:
        """(id, unit, first, last, lo, hi): every place of every unit, as positions and as ordinals among the document's query words.

        A word of a phrase votes for the place where the phrase would begin; a phrase stands where all its words voted. Everything goes by
        id after one shuffle.
        """
        wanted = [(s, u, k, offset) for u, unit in enumerate(query.units) for k, (offset, s) in enumerate(unit)]
        votes = F.array(*[F.struct(F.lit(s).alias("of"), F.lit(u).alias("unit"), F.lit(1 << k).alias("bit"), F.lit(offset).alias("offset")) for s, u, k, offset in wanted])
        words = self.postings().filter(F.col("term").isin(query.terms())).repartition("id").select("id", "term", F.explode("positions").alias("at"))
        words = words.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at")))
        votes = words.withColumn("v", F.explode(F.filter(votes, lambda v: v["of"] == F.col("term")))).select("id", "v.unit", "v.bit", (F.col("at") - F.col("v.offset")).alias("first"), "at", "n")
        places = votes.groupBy("id", "unit", "first").agg(F.bit_or("bit").alias("bits"), F.max("at").alias("last"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        whole = F.element_at(F.array(*[F.lit((1 << len(unit)) - 1) for unit in query.units]), F.col("unit") + 1)
        return places.filter(F.col("bits") == whole).drop("bits")

    def search(self, typed: str, widened: bool = False) -> DataFrame:
        """(id, rank) of the documents that answer: one alternative's words and phrases all stand in it and none of its unwanted ones.

        The rank is cover density: over all minimal covers (stretches that answer the query and of which no part does), the sum of
        0.1 / (1 + words in the stretch that are none of the query's). The sweep goes through a document's occurrences by their end: the latest
        beginnings of all units so far give the narrowest stretch that ends here, and it is minimal if none before began as late.
        Alternatives that the document does not answer have no covers; documents that answer by unwanted words alone have rank 0.
        """
        query = Query.parse(typed, widened, self.forms)
        nothing = self.ids().select("id", F.lit(0.0).alias("rank"))
        if not query.alternatives:
            return nothing.filter(F.lit(False))
        document = Window.partitionBy("id")
        swept = document.orderBy("last").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        units = range(len(query.units))
        o = self.occurrences(query)
        o = o.withColumns({f"has{u}": F.max(F.col("unit") == u).over(document) for u in units})
        o = o.withColumns({f"at{u}": F.max(F.when(F.col("unit") == u, F.struct("first", "lo"))).over(swept) for u in units})

        def answered(alternative) -> Column:
            wanted, unwanted = alternative
            held = [F.col(f"has{u}") for u in sorted(wanted)] + [~F.col(f"has{u}") for u in sorted(unwanted)]
            return F.aggregate(F.array(*held), F.lit(True), lambda a, x: a & x)

        def begin(alternative) -> Column:
            starts = F.array(*[F.col(f"at{u}") for u in sorted(alternative[0])])
            return F.when(answered(alternative) & ~F.exists(starts, lambda s: s.isNull()), F.array_min(starts))

        positive = [a for a in query.alternatives if a[0]]
        none = F.lit(None).cast("struct<first:int,lo:int>")
        o = o.withColumn("begin", F.array_max(F.array(none, *[begin(a) for a in positive]))).withColumn("ok", F.exists(F.array(*[answered(a) for a in query.alternatives]), lambda x: x))
        before = F.max("begin").over(document.orderBy("last", "unit", "first").rowsBetween(Window.unboundedPreceding, -1))
        o = o.withColumn("before", before).filter("ok")
        new = F.col("begin").isNotNull() & (F.col("before").isNull() | (F.col("begin.first") > F.col("before.first")))
        noise = (F.col("last") - F.col("begin.first")) - (F.col("hi") - F.col("begin.lo"))
        found = o.groupBy("id").agg(F.coalesce(F.sum(F.when(new, BASE_WEIGHT / (1 + noise))), F.lit(0.0)).alias("rank"))
        if len(positive) == len(query.alternatives):
            return found
        seen = self.occurrences(query).select("id").distinct()  # what holds none of the words answers a query of unwanted ones
        return found.unionByName(nothing.join(seen, "id", "left_anti"))

    def ladder(self, typed: str) -> DataFrame:
        """(id, rank, mode): all that is asked for, or any of it where nothing has all. One search decides, one answers."""
        strict = self.search(typed)
        mode = "all" if not strict.isEmpty() else "any"
        return (strict if mode == "all" else self.search(typed, widened=True)).withColumn("mode", F.lit(mode))

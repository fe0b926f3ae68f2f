"""Story dedup in layers: exact keys, banded simhashes with a title gate, and the choice of a canonical story."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import features, held, tokens
from tidemark.operators.tables import shared_folder


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, keeper, members): the first row of each key in `order`, the others superseded, none removed."""
    return df.groupBy(key).agg(F.min(F.struct(order, "id")).alias("k"), F.count("*").alias("members")).select(key, F.col("k.id").alias("keeper"), "members")


def simhash(text: Column, hashed=lambda x: F.xxhash64(x)) -> Column:
    """64-bit simhash of a text's features, words twice and pairs once: bit k is set where more of them have it than not. `hashed` takes a feature to 64 bits."""
    hashes = F.transform(features(text), hashed)
    one = F.lit(1).cast("long")

    def signature(h):
        ones = lambda k: F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.call_function("shiftrightunsigned", x, k).bitwiseAND(one))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda sig, k: F.when(2 * ones(k) > F.size(h), sig.bitwiseOR(F.call_function("shiftleft", one, k))).otherwise(sig))

    def packed(h):
        """The same for up to 127 features: eight counts of a bit each are one number, a byte each, so that eight sums do for 64."""
        sums = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.call_function("shiftrightunsigned", x, k).bitwiseAND(F.lit(0x0101010101010101))))
        count = lambda sums, k: F.call_function("shiftrightunsigned", F.get(sums, k % 8), F.floor(k / 8).cast("int") * 8).bitwiseAND(F.lit(255))
        return held(sums, lambda sums: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda sig, k: F.when(2 * count(sums, k) > F.size(h), sig.bitwiseOR(F.call_function("shiftleft", one, k))).otherwise(sig)))

    return held(hashes, lambda h: F.when(F.size(h) < 128, packed(h)).otherwise(signature(h)))


def bands(sig: Column, n: int = 4) -> Column:
    """The signature in n parts, each tagged with its place: signatures within n - 1 bits share one."""
    width = 64 // n
    return F.array(*[F.shiftrightunsigned(sig, i * width).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(i << width) for i in range(n)])


def first_stories(stories: DataFrame) -> DataFrame:
    """(id, rep): each story of (id, source, title, sig) and the first one of its source with the same signature and title."""
    first = stories.groupBy("sig", "source", "title").agg(F.min("id").alias("rep"))
    same = F.col("s.sig").eqNullSafe(F.col("f.sig")) & F.col("s.source").eqNullSafe(F.col("f.source")) & F.col("s.title").eqNullSafe(F.col("f.title"))
    return stories.alias("s").join(first.alias("f"), same).select("s.id", "f.rep")


def band_pairs(stories: DataFrame) -> DataFrame:
    """Structs a and b (id, source, title, sig) of candidates of different sources that share a band, each pair once: in the first band that they share."""
    first = stories.groupBy("sig", "source", "title").agg(F.min("id").alias("id"))
    own = first.select(F.struct("id", "source", "title", "sig").alias("s"), F.posexplode(bands(F.col("sig"))).alias("no", "band"))
    a, b = own.select(F.col("s").alias("a"), "no", "band"), own.select(F.col("s").alias("b"), "band")
    both = a.join(b, "band").filter((F.col("a.id") < F.col("b.id")) & (F.col("a.source") != F.col("b.source")))
    return both.filter(_first_shared()).select("a", "b")


def _first_shared() -> Column:
    """Whether band `no` is the first that structs a and b share."""
    differ = F.col("a.sig").bitwiseXOR(F.col("b.sig"))
    earlier = F.when(F.col("no") == 0, F.lit(False))
    for no in (1, 2, 3):
        shared = [F.shiftrightunsigned(differ, 16 * i).bitwiseAND(F.lit(65535)) == 0 for i in range(no)]
        earlier = earlier.when(F.col("no") == no, reduce(Column.__or__, shared))
    return ~earlier


def met_pairs(own: DataFrame, overlap: float, hot: int, near: Column | None = None) -> DataFrame:
    """Structs a and b of rows (id, sig, words and more; a title's distinct words) that share a band and can be within 3 bits or `overlap` in title: all pairs of a band up to `hot` titles.

    In a band of more, where all pairs would be a square, a second key decides: what is within 3 bits elsewhere has one of four twelfths of the 48 other
    bits alike, and what overlaps by that share has one of its rarest words in common (of n words all but overlap * n, and one more). So
    no pair that counts is lost, however large the band is. A pair comes once, in the first band and by the first key that it shares, and only if it
    is `near`, a condition on a and b: rows are shuffled for their bands and keys, pairs never.
    """
    banded = own.select(F.struct(*own.columns).alias("s"), F.posexplode(bands(F.col("sig"))).alias("no", "band"))
    crowded = F.broadcast(own.select(F.explode(bands(F.col("sig"))).alias("band")).groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("band"))  # of 4 * 65,536 bands
    near = (F.col("a.id") < F.col("b.id")) & (F.lit(True) if near is None else near) & _first_shared()
    cool = banded.join(crowded, "band", "left_anti")
    pairs = cool.select(F.col("s").alias("a"), "no", "band").join(cool.select(F.col("s").alias("b"), "band"), "band").filter(near).select("a", "b")
    full = banded.join(crowded, "band", "left_semi")
    rest = F.expr("CASE WHEN no = 0 THEN shiftrightunsigned(s.sig, 16) WHEN no = 3 THEN s.sig & 281474976710655 ELSE shiftrightunsigned(s.sig, 16 * (no + 1)) | shiftleft(s.sig & (shiftleft(1L, 16 * no) - 1), 48 - 16 * no) END")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat(F.lit("#"), k.cast("string"), F.lit(" "), F.call_function("shiftrightunsigned", F.col("rest"), 12 * k).bitwiseAND(F.lit(4095)).cast("string")))
    said = full.select("s.id").distinct().join(own.select("id", F.explode("words").alias("word")), "id")
    common = said.groupBy("word").agg(F.count("*").alias("n"))
    rare = said.join(common, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    rare = rare.select("id", F.slice("w", F.lit(1), (F.size("w") - F.ceil(F.lit(overlap) * F.size("w")) + 1).cast("int"))["word"].alias("rare"))
    full = full.withColumns({"rest": rest, "id": F.col("s.id")}).join(rare, "id", "left").select("s", "no", "band", F.concat(pieces, F.coalesce("rare", F.array().cast("array<string>"))).alias("keys"))
    keyed = lambda name, *columns: full.select(F.struct("s.*", "keys").alias(name), *columns, "band", F.explode("keys").alias("key"))
    first_key = F.get(F.array_intersect("a.keys", "b.keys"), F.lit(0)) == F.col("key")  # pieces and words have one order in all rows
    met = keyed("a", "no").join(keyed("b"), ["band", "key"]).filter(near).filter(first_key)
    return pairs.unionByName(met.select(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in own.columns]).alias(x) for x in "ab"]))


def candidate_pairs(own: DataFrame, overlap: float, hot: int) -> DataFrame:
    """(id, other) of the pairs of (id, sig, title) that `met_pairs` looks at."""
    return met_pairs(own.select("id", "sig", tokens(F.col("title"), 2).alias("words")), overlap, hot).select("a.id", F.col("b.id").alias("other"))


def near_pairs(stories: DataFrame, merge: int = 3, maybe: int = 16, overlap: float = 0.25, hot: int = 1024) -> DataFrame:
    """(id, source, title, sig) to candidate pairs with an outcome: auto, title or ambiguous; pairs that are neither near nor alike in title are rejected.

    Candidates share a band and differ in source; stories of one source with equal signature and title are one candidate, the
    first of them. `first_stories` leads from every story to its candidate, so that each has its outcomes without a row for each pair of copies.
    Pairs are judged where their rows meet, by words that were taken from each title before. `merge` is at most 3, which four bands cover.
    """
    path = f"{shared_folder(stories.sparkSession, 'near-titles')}/own"  # written, as signatures and words are costly and read several times
    first = stories.groupBy("sig", "source", "title").agg(F.min("id").alias("id"))
    first.select("sig", "source", "id", tokens(F.col("title"), 2).alias("words")).write.parquet(path)
    own = stories.sparkSession.read.parquet(path)
    distance = F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig")))
    pairs = met_pairs(own, overlap, hot, (distance <= max(merge, maybe)) & (F.col("a.source") != F.col("b.source")))
    both = F.size(F.array_intersect("a.words", "b.words"))
    every = F.size("a.words") + F.size("b.words") - both
    shared = F.explode(F.array(F.when(every == 0, 0.0).otherwise(both / every)))  # a row's own column, so that it is reckoned once a pair
    pairs = pairs.select("a.id", F.col("b.id").alias("other"), distance.alias("distance"), shared.alias("overlap"))
    outcome = F.when(F.col("distance") <= merge, "auto").when((F.col("distance") > maybe) | (F.col("overlap") < overlap), "reject").when(F.col("overlap") >= 0.6, "title").otherwise("ambiguous")
    return pairs.withColumn("outcome", outcome).filter("outcome <> 'reject'")


def recent(stories: DataFrame, at: str, as_of: str, hours: int = 48) -> DataFrame:
    """The stories of the hours before `as_of`: what a run compares, so that a band's pairs are bounded by what those hours bring."""
    return stories.filter(F.col(at) > F.lit(as_of).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours)))

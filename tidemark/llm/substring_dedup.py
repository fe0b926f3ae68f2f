"""Substring dedup: compressed FM-indexes of the passages that may repeat, searched backwards through wavelet trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, doc_key, gram_hashes, mix, one_batch, portions, table, word_hashes

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 20, 6
#: Distinct contents of one anchor that one index holds together, and symbols from which on an index is closed.
CONTENTS, SYMBOLS = 512, 1 << 19
#: Passages that are compared with an index's earliest places at a time.
SLICE = 1 << 16
_N_BITS, _S_BITS, _T_BITS = 4, 31, 28
_TIE = (1 << _T_BITS) - 1


# --- wavelet tree and FM-index -------------------------------------------------------------------


class BitVector:
    """Bits with rank: a count for each 512 bits and, relative to it, one for each 64, so 1.3 bits a bit."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.concatenate([bits, np.zeros(512 - len(bits) % 512, bool)]), bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).reshape(-1, 8).astype(np.uint32)
        self.far = np.concatenate([[0], np.cumsum(ones.sum(axis=1))[:-1]]).astype(np.uint32)
        self.near = (np.cumsum(ones, axis=1) - ones).astype(np.uint16).ravel()

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many bits before each place are set."""
        word = i >> 6
        below = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.far[i >> 9].astype(np.int64) + self.near[word] + np.bitwise_count(below)

    def nbytes(self) -> int:
        return self.words.nbytes + self.far.nbytes + self.near.nbytes


class WaveletTree:
    """Rank over a sequence of small integers: a bit vector a level (pointerless layout)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.depth = len(seq), max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in reversed(range(self.depth)):
            bits = (seq >> level) & 1 == 1
            self.levels.append(BitVector(bits))
            self.zeros.append(int(self.n - bits.sum()))
            seq = np.concatenate([seq[~bits], seq[bits]])
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.depth))):
            ones = self.levels[k].rank(i)
            i = np.where((c >> level) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i, for arrays of both."""
        return self._descend(c, i) - self.first[c]


class FMIndex:
    """Compressed FM-index of a sequence whose suffixes are sorted by their first `depth` symbols: exact for patterns up to that length.

    Symbol 0 separates texts and is in no pattern. The shorter sort keeps the transform's rows of a pattern together, as the order of
    rows that agree on `depth` symbols is never asked for. What stays is the wavelet tree of the transform, one byte a row (how
    many symbols it shares with the row above) and, in place of a suffix array, the least of `values` (one a symbol) over the
    occurrences of each distinct pattern of `depth` symbols: all that a search here reports about places.
    """

    def __init__(self, seq: np.ndarray, sigma: int, depth: int = WINDOW, values: np.ndarray | None = None):
        n, self.sigma, self.depth = len(seq), sigma, depth

        def pair(a, b, shift):
            moved = np.zeros(n, np.int64)
            moved[: n - shift] = b[shift:] + 1
            return np.unique(a * (n + sigma + 2) + moved, return_inverse=True)[1]

        def ranks(length):  # of the first `length` symbols, from doubled and summed lengths
            if length not in known:
                half = 1 << (length - 1).bit_length() - 1
                known[length] = pair(ranks(half), ranks(length - half), half)
            return known[length]

        known = {1: seq.astype(np.int64)}
        order = ranks(depth)
        places = np.argsort(order, kind="stable")
        self.n = n
        self.shared = np.zeros(n, np.uint8)
        above, here = places[:-1], places[1:]
        for w in (1 << k for k in reversed(range(depth.bit_length()))):
            same, of = self.shared[1:], np.concatenate([ranks(w), np.full(depth, -1)])
            fits = (same + w <= depth) & (of[above + same] == of[here + same]) & (of[here + same] >= 0)
            same[fits] += w
        self.edges = {}
        self.classes = BitVector(self.shared < depth)
        self.least = None if values is None else np.minimum.reduceat(values[places], np.flatnonzero(self.shared < depth))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.tree = WaveletTree(seq[places - 1], sigma)

    def extend(self, c, lo, hi):
        """Rows of the patterns that c, put before them, makes of those at rows [lo, hi)."""
        both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]

    def shorten(self, lo, length: int):
        """Rows of the patterns that the first `length` symbols at rows lo make."""
        if length not in self.edges:
            self.edges[length] = np.append(np.flatnonzero(self.shared < length) if length else 0, self.n).astype(np.uint32)
        k = np.searchsorted(self.edges[length], lo, side="right")
        return self.edges[length][k - 1].astype(np.int64), self.edges[length][k].astype(np.int64)

    def pattern_class(self, row):
        """The number, in `least`, of the pattern of `depth` symbols at a row."""
        return self.classes.rank(row + 1) - 1

    def count(self, patterns: np.ndarray):
        """Rows [lo, hi) of patterns, one a line, by backward search; empty where one does not occur."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for c in patterns.T[::-1]:
            lo, hi = self.extend(c, lo, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def matching_statistics(self, texts: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
        """Streams texts (places `ends` behind them, `sizes` symbols) from right to left, all at once: for each place
        (text, place, length of the longest match that begins there, up to `depth`, and its first row).

        A step drops the match's last symbol where it has `depth`, puts the symbol before it, and where that does not
        occur drops further ones until it does. Symbols below 0 occur nowhere.
        """
        lo, hi, length = np.zeros(len(ends), np.int64), np.full(len(ends), self.n), np.zeros(len(ends), np.int64)
        who = np.arange(len(ends))
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = sizes >= step
            if not live.all():
                who, ends, sizes, lo, hi, length = who[live], ends[live], sizes[live], lo[live], hi[live], length[live]
            c = texts[ends - step]
            full = length == self.depth
            if full.any():
                lo[full], hi[full] = self.shorten(lo[full], self.depth - 1)
                length[full] = self.depth - 1
            left, right = self.extend(np.maximum(c, 0), lo, hi)
            failed = np.flatnonzero((left >= right) | (c < 0))
            while len(failed):
                lost = (length[failed] == 0) | (c[failed] < 0)
                none, failed = failed[lost], failed[~lost]
                left[none], right[none], length[none] = 0, self.n, -1
                length[failed] -= 1
                for k in np.unique(length[failed]):
                    some = failed[length[failed] == k]
                    lo[some], hi[some] = self.shorten(lo[some], int(k))
                left[failed], right[failed] = self.extend(c[failed], lo[failed], hi[failed])
                failed = failed[left[failed] >= right[failed]]
            lo, hi, length = left, right, length + 1
            yield who, ends - step, length, lo

    def nbytes(self) -> int:
        """Bytes that stay, without what `least` reports."""
        return sum(x.nbytes() for x in (*self.tree.levels, self.classes)) + self.shared.nbytes + self.before.nbytes + self.tree.first.nbytes


# --- anchors: what may repeat --------------------------------------------------------------------


def anchored_runs(words: np.ndarray, at: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """Cuts each text's windows into runs that have the same anchor, the window's leftmost least n-gram hash.

    Returns for each run (text, first window's start within the text, windows, anchor hash, content hash). Equal windows
    have equal anchors wherever they stand, so a window can only repeat inside the runs of its anchor.
    """
    grams, whole = gram_hashes(words, anchor), gram_hashes(words, window)
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    width = window - anchor + 1
    place = np.arange(len(whole)) + np.lib.stride_tricks.sliding_window_view(grams, width)[: len(whole)].argmin(axis=1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(whole)]
    inside = np.flatnonzero(np.arange(len(whole)) + window <= at[text + 1])
    new = np.concatenate([[True], (place[inside][1:] != place[inside][:-1]) | (np.diff(inside) != 1)]) if len(inside) else np.zeros(0, bool)
    first = inside[new]
    n = np.diff(np.concatenate([np.flatnonzero(new), [len(inside)]]))
    content = mix(whole[first] * np.uint64(0x9E3779B97F4A7C15) + mix(whole[first + n - 1]) + n.astype(np.uint64))
    return text[first], first - at[text[first]], n, grams[place[first]], content


def _pack(tie, start, n):
    return (tie << (_N_BITS + _S_BITS)) | (start << _N_BITS) | n


def _find(batches):
    """Runs of each text, those first that are the earliest of their content in a portion of the input; the later ones of a
    portion stream through an index of the portion's repeated contents, and what that finds is `gone`."""
    names = ["gone", "anchor", "content", "id", "sub", "packed"]
    for b in one_batch(batches):
        ids, subs, ties, done = b["id"].to_numpy(), b["sub"].to_numpy(), b["tie"].to_numpy(), 0
        for part in portions(b):
            words, at = word_hashes(part["text"])
            text, start, n, anchor, content = anchored_runs(words, at)
            doc, sub, packed = ids[done + text], subs[done + text], _pack(ties[done + text], start, n)
            done += part.num_rows
            if not len(text):
                continue
            order = np.lexsort((packed, sub, doc, content, anchor))
            same = (anchor[order[1:]] == anchor[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
            first = np.concatenate([[True], ~same])
            heads = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(heads), bool)), pa.array(anchor[heads].view(np.int64)), pa.array(content[heads].view(np.int64)), pa.array(doc[heads]), pa.array(sub[heads]), pa.array(packed[heads])], names)
            group = np.cumsum(first) - 1
            twice = np.bincount(group) > 1
            if not twice.any():
                continue
            heads, renumbered = heads[twice], np.cumsum(twice) - 1
            later = order[~first]
            lo = at[text[heads]] + start[heads]
            passages = [words[i:j] for i, j in zip(lo, lo + n[heads] + WINDOW - 1, strict=True)]
            found, _ = earlier_windows(passages, (doc[heads], sub[heads], packed[heads]), renumbered[group[~first]], (doc[later], sub[later], packed[later]))
            for gone in found:
                none = pa.array(np.zeros(len(gone[0]), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(gone[0]), bool)), none, none, *map(pa.array, gone)], names)


def _cut_out(batches):
    """The symbols of each passage, from its document's text."""
    for b in (part for batch in one_batch(batches) for part in portions(batch)):
        words, at = word_hashes(b["text"])
        probes = b["probes"]
        flat, sizes = probes.flatten(), np.diff(probes.offsets.to_numpy())
        text = np.repeat(np.arange(b.num_rows), sizes)
        packed = flat.field("packed").to_numpy()
        lo = at[text] + ((packed >> _N_BITS) & ((1 << _S_BITS) - 1))
        out = [words[i:j].tobytes() for i, j in zip(lo, lo + (packed & ((1 << _N_BITS) - 1)) + WINDOW - 1, strict=True)]
        yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("anchor", "chunk", "hot", "content")), *(pa.array(b[c].to_numpy()[text]) for c in ("id", "sub")), flat.field("packed"), pa.array(out, pa.binary())], ["anchor", "chunk", "hot", "content", "id", "sub", "packed", "words"])


def _unpack(packed):
    return packed >> (_N_BITS + _S_BITS), (packed >> _N_BITS) & ((1 << _S_BITS) - 1), packed & ((1 << _N_BITS) - 1)


def earlier_windows(passages: list[np.ndarray], own: tuple[np.ndarray, ...], of: np.ndarray, copies: tuple[np.ndarray, ...]):
    """Indexes passages (words; id, sub and packed place of each) and streams them, and copies of them (`of` numbers the passage, which no copy comes before), through the index.

    Returns intervals of windows that occur at an earlier place, (ids, subs, packed places) at a time, and (passage, offset,
    window hash) of the passages' windows that do not. A passage's matching statistics are the same for all its copies, so it is searched
    once, and each copy compares the earliest places found with its own.
    """
    every_doc, every_sub, every_packed = (np.concatenate(both) for both in zip(own, copies, strict=True))
    every_tie, every_start, every_n = _unpack(every_packed)
    n, sizes = every_n[: len(passages)], np.array([len(p) for p in passages], np.int64)
    symbols = np.concatenate(passages)
    distinct, coded = np.unique(symbols, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    seq = np.zeros(at[-1], np.int64)
    seq[inside] = coded + 1
    order, rank = np.lexsort((every_tie, every_sub, every_doc)), np.zeros(len(every_doc), np.int64)
    rank[order[1:]] = np.cumsum(np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (every_doc, every_sub, every_tie)]))
    key = (rank << 32) + every_start
    values = np.repeat(key[: len(passages)], sizes + 1) + (np.arange(at[-1]) - np.repeat(at[:-1], sizes + 1))
    index = FMIndex(seq, len(distinct) + 1, values=values)
    base = np.concatenate([[0], np.cumsum(n)])
    least = np.zeros(base[-1], np.int64)  # the earliest place of each window, passage by passage
    for who, place, length, row in index.matching_statistics(seq, at[:-1] + sizes, sizes):
        hit = np.flatnonzero(length >= WINDOW)
        if len(hit):
            least[base[who[hit]] + place[hit] - at[who[hit]]] = index.least[index.pattern_class(row[hit])]
    out, source = [], np.concatenate([np.arange(len(passages)), of])
    for lo in range(0, len(source), SLICE):
        unit = np.arange(lo, min(len(source), lo + SLICE))
        count = n[source[unit]]
        ends = np.cumsum(count)
        who = np.repeat(unit, count)
        offset = np.arange(ends[-1]) - np.repeat(ends - count, count)
        early = np.flatnonzero(least[base[source[who]] + offset] < key[who] + offset)
        who, offset = who[early], offset[early]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(offset) != 1) | (np.diff(who) != 0)])) if len(who) else np.zeros(0, np.int64)
        length = np.diff(np.append(new, len(who)))
        who, offset = who[new], offset[new]
        out.append((every_doc[who], every_sub[who], _pack(every_tie[who], every_start[who] + offset, length)))
    who = np.repeat(np.arange(len(passages)), n)
    offset = np.arange(base[-1]) - np.repeat(base[:-1], n)
    mine = np.flatnonzero(least == key[who] + offset)
    hashed = np.zeros(len(seq), np.uint64)
    hashed[inside] = symbols
    return out, (who[mine], offset[mine], gram_hashes(hashed, WINDOW)[at[who[mine]] + offset[mine]].view(np.int64))


def _search(tables):
    """One index over whole groups of (anchor, chunk); rows without words are copies of the row with words before them."""
    t = pa.concat_tables(tables).combine_chunks()
    places, anchor = tuple(t[c].to_numpy() for c in ("id", "sub", "packed")), t["anchor"].to_numpy()
    head = t["words"].is_valid().to_numpy()
    passages = [np.frombuffer(w, np.uint64) for w in t["words"].filter(pa.array(head)).to_pylist()]
    of = np.cumsum(head) - 1
    own = tuple(x[head] for x in places)
    found, (who, offset, window) = earlier_windows(passages, own, of[~head], tuple(x[~head] for x in places))
    names = ["open", "id", "sub", "packed", "anchor", "window"]
    for gone in found:
        if len(gone[0]):
            none = pa.array(np.zeros(len(gone[0]), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(gone[0]), bool)), *map(pa.array, gone), none, none], names)
    mine = np.flatnonzero(t["hot"].to_numpy()[head][who])
    if len(mine):
        who, offset = who[mine], offset[mine]
        tie, start, _ = _unpack(own[2][who])
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(who), bool)), pa.array(own[0][who]), pa.array(own[1][who]), pa.array(_pack(tie, start + offset, 1)), pa.array(anchor[head][who]), pa.array(window[mine])], names)


def _index_shards(symbols):
    def run(batches):
        kept, size, rest = [], 0, None
        for b in one_batch(batches):
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            a, c = t["anchor"].to_numpy(), t["chunk"].to_numpy()
            cut = np.flatnonzero((a[1:] != a[:-1]) | (c[1:] != c[:-1])) + 1
            if not len(cut):
                rest = t
                continue
            done, rest = t.slice(0, cut[-1]), t.slice(cut[-1])
            kept.append(done)
            size += (pc.sum(pc.binary_length(done["words"])).as_py() or 0) // 8 + done.num_rows
            if size >= symbols:
                yield from _search(kept)
                kept, size = [], 0
        if rest is not None:
            yield from _search([*kept, rest])

    return run


def _remove(batches):
    for b in one_batch(batches):
        gone = b["gone"]
        ends = np.cumsum(gone.value_lengths().fill_null(0).to_numpy())
        flat = gone.flatten().to_numpy()
        n_words, n_removed, sha, kept_out = [], [], [], []
        for text, lo, hi in zip(b["text"].cast(pa.binary()).to_pylist(), [0, *ends[:-1]], ends, strict=True):
            words = text.split()
            removed = 0
            if hi > lo:
                start, n = flat[lo:hi] >> _N_BITS, flat[lo:hi] & ((1 << _N_BITS) - 1)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + n + WINDOW - 1, -1)
                covered = np.cumsum(depth)[:-1] > 0
                removed = int(covered.sum())
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            kept = b" ".join(words)
            n_words.append(len(words) + removed), n_removed.append(removed), sha.append(hashlib.sha256(kept).hexdigest()), kept_out.append(kept)
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(kept_out, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, scratch: Scratch, contents: int = CONTENTS, symbols: int = SYMBOLS) -> DataFrame:
    """(row, n_words, n_removed, kept_sha256, kept): each row of `docs` without words that a repeated window covers.

    Each document against one index of the whole corpus would cost shards x words, so windows are cut into runs by anchor (a window's least
    6-gram) and dealt to the shard of their anchor: equal windows meet there. A shard's index holds the distinct contents of
    anchors that occur twice; all runs stream through it, and the windows whose matching statistics reach 20 words at an
    earlier place are removed as intervals. Runs of equal content have equal statistics, which are searched once. What repeats within a portion of the
    input (4 MB) streams through an index of that portion first, so that a passage of all documents reaches its shard once a portion. An anchor with over
    `contents` contents is indexed in chunks, whose earliest windows meet again by hash. Every step is linear in the words.

    Null and short texts lose nothing. Documents are ordered by doc_id and, where that repeats, by 92 bits of hashes of the
    text; equal rows are one document, whose copies lose the same. Rows without an id come last. An empty table gives an
    empty result; extra columns pass through in `row`, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ids that repeat, if any: only their rows need telling apart; a file's size lets Spark broadcast them where they are few
    repeated = scratch.write(docs.select(doc_key().alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    again = repeated.select("id", F.lit(True).alias("again"))
    row = F.struct(*[docs[c] for c in docs.columns])
    told = docs.select(row.alias("row"), doc_key().alias("id"), text.alias("text")).join(again, "id", "left")
    text = F.col("text")
    told = told.select("row", "id", F.when(F.col("again"), F.xxhash64(text)).otherwise(0).cast("long").alias("sub"), F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(_TIE)).alias("tie"), "text")
    rows = told.drop("row")
    runs = rows.mapInArrow(_find, "gone boolean, anchor long, content long, id long, sub long, packed long")
    # what an index of a portion has found lies anywhere; its rows are spread by their document
    runs = runs.withColumn("anchor", F.when(F.col("gone"), F.xxhash64("id", "sub", "packed")).otherwise(F.col("anchor")))
    order = Window.partitionBy("gone", "anchor").orderBy("content", "id", "sub", "packed")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    decided = runs.withColumns({"of": F.count("*").over(every), "above": F.lag("content").over(order)}).filter("gone OR of > 1")
    chunks = F.ceil(F.col("of") / contents)  # contents are hashes
    decided = decided.select("gone", "anchor", F.pmod("content", chunks).alias("chunk"), (chunks > 1).alias("hot"), "content", (~F.col("above").eqNullSafe(F.col("content"))).alias("head"), "id", "sub", "packed")
    decided = scratch.write(decided, "decided")
    own_tie = F.shiftright("packed", _N_BITS + _S_BITS).alias("tie")
    by_doc = decided.filter("NOT gone AND head").groupBy("id", "sub", own_tie).agg(F.collect_list(F.struct("anchor", "chunk", "hot", "content", "packed")).alias("probes"))
    same = ["id", "sub", "tie"]
    cut = rows.join(by_doc, same).select("id", "sub", "text", "probes").mapInArrow(_cut_out, "anchor long, chunk long, hot boolean, content long, id long, sub long, packed long, words binary")
    staged = cut.unionByName(decided.filter("NOT gone AND NOT head").select("anchor", "chunk", "hot", "content", "id", "sub", "packed", F.lit(None).cast("binary").alias("words")))
    staged = staged.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", "content", "id", "sub", "packed")
    found = scratch.write(staged.mapInArrow(_index_shards(symbols), "open boolean, id long, sub long, packed long, anchor long, window long"), "found")
    firsts = found.filter("open")
    place = F.struct("id", "sub", F.shiftright("packed", _N_BITS).alias("at"))
    least = firsts.groupBy("anchor", "window").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1").select("anchor", "window", "least")
    late = firsts.join(least, ["anchor", "window"]).filter(place > F.col("least"))
    gone = decided.filter("gone").select("id", "sub", "packed").unionByName(found.filter("NOT open").select("id", "sub", "packed")).unionByName(late.select("id", "sub", "packed"))
    gone = gone.groupBy("id", "sub", own_tie).agg(F.collect_list(F.col("packed").bitwiseAND(F.lit((1 << (_N_BITS + _S_BITS)) - 1))).alias("gone"))
    held = told.join(gone, same, "left").select("row", "text", "gone")
    schema = held.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")
    return held.mapInArrow(_remove, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, Scratch(spark, "op6")).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
j AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, greatest(len(w), 1) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, n, w[i] AS word, CASE WHEN i + 19 <= n THEN array_to_string(w[i:i + 19], ' ') END AS win FROM j),
r AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM k),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT doc_id, any_value(n)::BIGINT AS n_words, count(*) FILTER (gone AND i <= n)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone AND i <= n), '')) AS kept_sha256
FROM c GROUP BY doc_id
"""

"""Byte-level BPE: exact merges in linear time by backtracking over longest matches."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import REMEMBERED, one_batch, portions, table

#: Pieces whose ids a worker remembers, and token pairs; beyond them it starts afresh. Bounds of memory, not of the input.
PIECES, PAIRS = 500_000, 500_000


class BytePairEncoder:
    """Encodes pieces of bytes by a table of ranks.

    An automaton over the ranks' bytes, mapped to Latin-1 characters, finds every token that ends at each
    byte in one pass. From the left, each step takes the longest token at its place that may stand after the one
    before; where none may, it goes back a token and takes the next shorter there. Two tokens may stand together if
    merging their joined bytes gives the two again, which is remembered for each pair. A sequence whose
    neighbours all may is the one that merging the whole piece gives, and a place once left is never
    entered again, so a piece costs time in proportion to its length.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.alone = {rank for token, rank in ranks.items() if self.merge(token) != [rank]}  # appear only as whole pieces
        for token, rank in ranks.items():
            if rank not in self.alone:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # by the first token's number in the upper bits
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.decimal = {rank: str(rank) for rank in self.bytes_of}

    def merge(self, piece: bytes) -> list[int]:
        """Merges the neighbours of lowest rank, leftmost first, until no neighbours have one: the definition, for short pieces."""
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joined = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while joined:
            least = min(joined)
            if least == none:
                break
            i = joined.index(least)
            parts[i] += parts.pop(i + 1)
            joined.pop(i)
            if i < len(joined):
                joined[i] = get(parts[i] + parts[i + 1], none)
            if i:
                joined[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece) - 1
        longest = {end - token[0]: token for end, token in self.automaton.iter(piece.decode("latin-1"))}  # ends rise, so the longest stays; starts less one
        pairs, may_follow = self.pairs, self.may_follow
        out, places, shorter, closed = [], [], [], set()
        place, last, options = -1, -1, None  # options: tokens yet to try here, None before the longest
        while place < n:
            token = None
            if options is None:
                size, token = longest[place]
                if (last >= 0 and not (pairs[pair] if (pair := last << 32 | token) in pairs else may_follow(last, token))) or place + size in closed:
                    options = self._shorter(piece, place + 1, size)
                    token = None
            while token is None and options:
                size, token = options.pop()
                if place + size in closed or (last >= 0 and not may_follow(last, token)):
                    token = None
            if token is not None:
                out.append(token), places.append(place), shorter.append(options)
                place, last, options = place + size, token, None
                continue
            closed.add(place)
            if not out:
                raise ValueError("the ranks lack a byte of the piece")
            out.pop()
            place, options, last = places.pop(), shorter.pop(), out[-1] if out else -1
            if options is None:
                options = self._shorter(piece, place + 1, longest[place][0])
        return out

    def _shorter(self, piece: bytes, start: int, size: int) -> list[tuple[int, int]]:
        """The tokens at a place below a size, ascending."""
        found = ((i, self.ranks.get(piece[start : start + i])) for i in range(1, size))
        return [(i, rank) for i, rank in found if rank is not None and rank not in self.alone]

    def encode(self, pieces: list[str]) -> list[int]:
        """The ids of the text pieces that the pattern has split, one piece after another."""
        out = list(map(self.pieces.get, pieces))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    known = self.pieces.get(p := pieces[i])
                    if known is None:
                        known = tuple(self.encode_piece(p.encode()))
                        if len(p) <= 64:
                            if len(self.pieces) >= PIECES:
                                self.pieces.clear()
                            self.pieces[p] = known
                    out[i] = known
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in a file of base64 tokens and decimal ranks, a line each."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


#: Code points that the classes of a pattern stand for: White_Space, and what the splitter asks `regex` for.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _class(name: str) -> str:
    """The ranges of a Unicode class below U+10000, as the inside of a character class."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    return "".join(f"{re.escape(m[0])}-{re.escape(m[-1])}" for m in (x[0] for x in regex.finditer(rf"\p{{{name}}}+", every)) if m)


def splitter(pattern: str):
    """Function from a text to the pattern's matches, as `regex` finds them.

    The standard library's engine is several times faster; it gets the classes spelled out. Texts beyond
    the basic plane, and patterns with other classes, stay with `regex`.
    """
    slow = regex.compile(pattern).findall
    plain = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]|\\p\{L\}|\\p\{N\}|\\s|\\S", "", pattern)
    if re.search(r"\\[A-Za-z]|\[", plain):
        return slow
    letters, numbers = _class("L"), _class("N")
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{_SPACE}]"), (r"\S", f"[^{_SPACE}]")):
        pattern = pattern.replace(old, new)
    fast = re.compile(pattern).findall
    return lambda text: slow(text) if text and (not text.isascii() and max(text) > "\uffff") else fast(text)


_ENCODERS: dict[str, BytePairEncoder] = {}
REMEMBERED.append(_ENCODERS)


def encoder(data: bytes) -> BytePairEncoder:
    """A worker builds the automaton of a vocabulary once."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(read_ranks(data))
    return _ENCODERS[key]


def _without_gc(batches):
    """The batches, with the collector off while they last: nothing here makes cycles, and scanning what is remembered takes half the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if on:
            gc.enable()


def _default_vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def tokenize(docs: DataFrame, vocabulary: bytes | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row; `ids` only if asked for.

    The vocabulary's bytes (under 1 MB) travel with the task, so executors need no file. Null
    texts have no tokens. Rows are independent: repeated ids, null ids and extra columns change nothing, an empty
    table gives an empty result. Special tokens' strings are ordinary text.
    """
    given, own = (vocabulary, pattern) if vocabulary and pattern else _default_vocabulary()
    data, split = vocabulary or given, pattern or own

    def run(batches):
        enc, pieces = encoder(data), splitter(split)
        for b in _without_gc(part for batch in one_batch(batches, keep=True) for part in portions(batch)):
            n, ids_out, ids_hash, back_hash = [], [], [], []
            for text in b["text"].to_pylist():
                ids = enc.encode(pieces(text or ""))
                n.append(len(ids))
                if with_ids:
                    ids_out.append(ids)
                ids_hash.append(hashlib.sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest())
                back_hash.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            columns = {"doc_id": b["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash), "decoded_sha256": pa.array(back_hash)}
            if with_ids:
                columns["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def detokenize(rows: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, data): the bytes that the ids stand for; null ids give null."""
    data = vocabulary or _default_vocabulary()[0]

    def run(batches):
        enc = encoder(data)
        for b in one_batch(batches, keep=True):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([None if x is None else enc.decode(x) for x in b["ids"].to_pylist()], pa.binary())], ["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), with_ids=False)

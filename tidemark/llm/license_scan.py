"""License scans: Dice coefficient over word bigrams against templates, in DataFrame functions only."""

from __future__ import annotations

import math
import re
from functools import reduce
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

#: The notices that licences ask for, and the grants of two short licences. The SQL knows these.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
}
_TEXTS = Path(__file__).with_name("licenses")
#: SPDX identifiers whose letters' case is known; families whose plain form means "only" and whose + means "or later".
TAGS = ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "MPL-2.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0") + tuple(
    f"{x}-{y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("only", "or-later")
)


FAMILIES = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-1.0", "AGPL-3.0")


def _texts() -> dict[str, str]:
    """Whole licence texts (`-text`) and the standard headers of source files (`-header`)."""
    found = {f"{p.stem}-text": p.read_text() for p in sorted(_TEXTS.glob("*.txt")) if p.stem != "headers"}
    for part in (_TEXTS / "headers.txt").read_text().split("== ")[1:]:
        name, text = part.split("\n", 1)
        found[f"{name}-header"] = text
    return found


TEMPLATES = NOTICES | _texts()
#: Least Dice coefficient of a match.
LEAST = 0.8
_WORD = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def passages(text: Column) -> Column:
    """Distinct sentences and lines of a text, and the text itself: what a licence notice may be a whole of."""
    lines = F.split(text, "\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+")))
    return F.array_distinct(F.concat(F.array(text), lines, sentences))


def least_shared(n: int, least: float) -> int:
    """Distinct bigrams of the template's n that every match shares: 2 s / (N + n) >= least and N >= s."""
    return max(1, math.ceil(least / (2 - least) * n - 1e-9))


def _literals(words: list[str]) -> Column:
    return F.split(F.lit("\n".join(words)), "\n")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _gram_hash(a: str, b: str) -> int:
    """What xxhash64 gives for two words: the first one's hash seeds the second's."""
    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")


def _pieces(text: Column) -> Column:
    """Sentences of each line in order, as words and the number of the line; those without a word are left out."""
    cut = F.transform(F.split(text, "\n"), lambda line, l: F.transform(F.split(line, r"(?<=[.!?])\s+"), lambda s: F.struct(_words(s).alias("w"), l.alias("l"))))
    return F.filter(F.flatten(cut), lambda p: F.size(p["w"]) > 0)


def _grams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.when(n > 0, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _marked(words: Column, bigrams: Column) -> Column:
    """For each bigram of a text in order: j, the place of its second word (from 0), prev, that of the same bigram before (0 for none), and whether it is in the template."""
    by_name = F.array_sort(F.transform(_grams(words), lambda g, i: F.struct(g.alias("g"), (i + 1).alias("j"))))

    def back(s):
        pair = lambda x, y: F.struct(x["j"].alias("j"), F.when(x["g"] == y["g"], y["j"]).otherwise(0).alias("prev"), F.array_contains(bigrams, x["g"]).alias("hit"))
        return F.array_sort(F.zip_with(s, F.concat(F.array(F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("j"))), F.slice(s, F.lit(1), F.size(s) - 1)), pair))

    return _let(by_name, back)


def _best_runs(pieces: Column, t: Column, least: float) -> Column:
    """For each piece the best run of pieces that begins there: (s, dice, e), and `unit`, the end of a line, sentence or text from s that matches by itself (else -1)."""
    words = F.flatten(F.transform(pieces, lambda p: p["w"]))
    owner = F.flatten(F.transform(pieces, lambda p, i: F.array_repeat(i, F.size(p["w"]))))
    starts = lambda o: F.filter(F.transform(o, lambda p, i: F.when((i == 0) | (p != F.get(o, i - 1)), i)), lambda x: x.isNotNull())

    def runs(edge, marks):
        last = F.size(edge) - 2
        of = lambda p: F.slice(marks, F.greatest(F.get(edge, p), F.lit(1)), F.get(edge, p + 1) - F.greatest(F.get(edge, p), F.lit(1)))
        line = lambda p: F.get(pieces, p)["l"]

        def from_piece(s):
            st = F.get(edge, s)

            def step(acc, p):
                def grown(new):
                    n, both, size = acc["n"] + F.size(new), acc["both"] + F.size(F.filter(new, lambda x: x["hit"])), F.get(edge, p + 1) - st
                    dice, plain = F.try_divide(2.0 * both, n + t["n"]), F.try_divide(2.0 * both, size - 1 + t["n"])
                    alone = (p == s) | (((s == 0) | ~line(s - 1).eqNullSafe(line(s))) & ~line(p + 1).eqNullSafe(line(p)) & (line(p) == line(s))) | ((s == 0) & (p == last))
                    better = size.between(t["low"], t["high"]) & (dice > acc["dice"])
                    return F.struct(
                        n.alias("n"), both.alias("both"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, p).otherwise(acc["e"]).alias("e"),
                        F.when(alone & (plain >= least), p).otherwise(acc["unit"]).alias("unit"),
                    )

                return _let(F.filter(of(p), lambda x: (x["j"] > st) & (x["prev"] <= st)), grown)

            none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("both"), F.lit(0.0).alias("dice"), F.lit(-1).alias("e"), F.lit(-1).alias("unit"))
            # a piece has a word at least, so no run that the size lets through is longer
            return F.aggregate(F.sequence(s, F.least(last, s + t["high"])), none, step, lambda acc: F.struct(s.alias("s"), acc["dice"].alias("dice"), acc["e"].alias("e"), acc["unit"].alias("unit")))

        return F.filter(F.transform(F.sequence(F.lit(0), last), from_piece), lambda r: (r["dice"] >= least) | (r["unit"] >= 0))

    return _let(words, lambda w: _let(F.concat(_let(owner, starts), F.array(F.size(w))), lambda edge: _let(_marked(w, t["bigrams"]), lambda marks: runs(edge, marks))))


def _counted(runs: Column, least: float) -> Column:
    """How many matching runs follow one another without overlap, from the left, beside what matches as a line, sentence or text by itself."""
    alone = lambda all_, r: F.exists(all_, lambda u: (u["unit"] >= 0) & (u["s"] <= r["e"]) & (u["unit"] >= r["s"]))
    free = lambda all_: F.filter(all_, lambda r: (r["dice"] >= least) & ~alone(all_, r))
    take = lambda acc, r: F.when(r["s"] > acc["e"], F.struct((acc["k"] + 1).alias("k"), r["e"].alias("e"))).otherwise(acc)
    return F.aggregate(_let(runs, free), F.struct(F.lit(0).cast("long").alias("k"), F.lit(-1).alias("e")), take, lambda acc: acc["k"])


def _possible(docs: DataFrame, templates: list[list[str]], least: float) -> DataFrame:
    """The rows of (doc_id, text) whose text shares with a template the bigrams that any match must.

    A text's bigrams are looked up in one set of those of all templates, each as a 64-bit hash; what is found is short, and only
    templates that it may be enough for are counted. A match lies in consecutive words of its text, so its bigrams are the text's too.
    """
    hashed = [[_gram_hash(*g.split()) for g in b] for b in templates]
    known = ", ".join(f"{h}L" for h in sorted(set().union(*hashed)))
    wanted = [F.struct(F.lit(least_shared(len(h), least)).alias("m"), F.split(F.lit(" ".join(map(str, h))), " ").cast("array<long>").alias("h")) for h in hashed]
    enough = lambda hits: F.exists(F.array(*wanted), lambda t: F.when(F.size(hits) >= t["m"], F.size(F.array_intersect(hits, t["h"])) >= t["m"]).otherwise(False))
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b)))
    found = docs.withColumn("hits", _let(_words(F.col("text")), pairs))
    found = found.withColumn("hits", F.expr(f"array_distinct(filter(hits, h -> h IN ({known})))"))
    return found.filter(_let(F.col("hits"), enough)).select("doc_id", "text")


def scan_runs(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """(doc_id, license, n, dice) of notices that go over several lines or sentences: runs of consecutive pieces within a template's bounds."""
    low, high = least / (2 - least), (2 - least) / least
    rows = []
    for name, text in sorted(templates.items()):
        b, size = template_bigrams(text), len([w for w in re.split(r"[\W_]+", text) if w])
        if b:
            rows.append(F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("n"), F.lit(math.ceil(size * low - 1e-9)).alias("low"), F.lit(math.floor(size * high + 1e-9)).alias("high"), F.lit(least_shared(len(b), least)).alias("m"), _literals(b).alias("bigrams")))
    pieces = docs.select("doc_id", _pieces(F.col("text")).alias("pieces"))

    def fit(w):
        return _let(F.array_distinct(_grams(w)), lambda g: F.filter(F.array(*rows), lambda t: (F.size(w) >= t["low"]) & (F.size(g) >= t["m"]) & F.when((F.size(w) >= t["low"]) & (F.size(g) >= t["m"]), F.size(F.array_intersect(g, t["bigrams"])) >= t["m"]).otherwise(False)))

    near = pieces.select("doc_id", "pieces", F.explode(_let(F.flatten(F.transform("pieces", lambda p: p["w"])), fit)).alias("t"))
    found = near.select("doc_id", "t.license", _let(F.col("pieces"), lambda p: _let(F.col("t"), lambda t: _best_runs(p, t, least))).alias("runs"))
    found = found.select("doc_id", "license", _let(F.col("runs"), lambda r: F.struct(_counted(r, least).alias("n"), F.array_max(F.transform(r, lambda x: x["dice"])).alias("dice"))).alias("r"))
    return found.select("doc_id", "license", "r.n", "r.dice").filter(F.col("dice") >= least)


_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?"
_TERM = rf"[( \t]*{_ID}(?:[ \t]+WITH[ \t]+{_ID})?(?:[ \t]*\))*"


def tags(text: Column) -> Column:
    """Identifiers in the SPDX licence expressions of a text, in order, repeats and all.

    An expression is what follows `SPDX-License-Identifier:` on the same line: identifiers with AND, OR, WITH and parentheses; what comes
    after it on the line does not matter. Exceptions after WITH are none. Identifiers are compared as wholes, whatever their case: a plain GPL-2.0 is
    GPL-2.0-only, GPL-2.0+ is GPL-2.0-or-later; a + elsewhere stays, and so do identifiers that no list has.
    """
    found = F.regexp_extract_all(text, F.lit(rf"SPDX-License-Identifier:({_TERM}(?:[ \t]+(?:AND|OR)[ \t]+{_TERM})*)"), F.lit(1))
    bare = F.transform(found, lambda e: F.regexp_replace(F.regexp_replace(e, rf"[ \t]WITH[ \t]+{_ID}", " "), r"[()]|[ \t](?:AND|OR)(?=[ \t])", " "))
    ids = F.filter(F.flatten(F.transform(bare, lambda e: F.split(e, r"[ \t]+"))), lambda x: x != "")
    named = {x.lower(): x for x in TAGS} | {x.lower(): f"{x}-only" for x in FAMILIES} | {f"{x.lower()}+": f"{x}-or-later" for x in FAMILIES}
    known = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return F.transform(ids, lambda x: F.coalesce(F.try_element_at(known, F.lower(x)), x))


def scan_tags(docs: DataFrame) -> DataFrame:
    """(doc_id, license, n, dice) of SPDX identifiers, `-tag` after each: they stand there or not, so the coefficient is 1."""
    tagged = docs.filter(F.contains("text", F.lit("SPDX-License-Identifier:"))).select("doc_id", F.explode(tags(F.col("text"))).alias("id"))
    return tagged.select("doc_id", F.concat("id", F.lit("-tag")).alias("license"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, license, n_matches, dice): for each document and licence that it holds, the passages that match and the best coefficient.

    Passages are the distinct sentences and lines, the text as a whole, and runs of consecutive sentences over any lines
    with two thirds to one and a half of the template's words, so wrapped notices, paragraphs and whole licence texts. A run counts
    distinct bigrams on both sides (a whole text repeats many). SPDX tags are read exactly (`tags`), unless templates are given. Overlapping runs count once, and not beside a line or sentence in them that matches by itself.

    A passage is lower-cased and cut into words of letters and digits; the coefficient is 2 |A and B| / (|A| + |B|) over
    word bigrams: distinct ones in common, sizes counted with repeats. A coefficient of `least` needs sizes within
    least / (2 - least) of each other, so a passage only meets the templates that its size lets through; and it needs
    least / (2 - least) of the template's bigrams, so texts without them are never cut up. The templates, a parameter of a few entries,
    are part of the expression; nothing but matches is shuffled.

    Null and empty texts and passages under two words match nothing. Rows that repeat a doc_id are summed, rows
    without one are one group. An empty table gives an empty result; other columns are ignored.
    """
    sized = sorted((name, template_bigrams(t)) for name, t in (TEMPLATES if templates is None else templates).items())
    sized = [(name, b) for name, b in sized if b]
    doc, text = F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    if not sized:
        return docs.select(doc, F.lit("").alias("license"), F.lit(0).cast("long").alias("n_matches"), F.lit(0.0).alias("dice")).filter("false")
    every = docs.select(doc, text.alias("text"))
    # written, as both ways of cutting it up read it
    docs = (scratch or Scratch(docs.sparkSession, "licenses")).write(_possible(every, [b for _, b in sized], least), "possible")
    text = F.col("text")
    units = docs.select(doc, F.explode(passages(text)).alias("unit"))
    units = units.select("doc_id", _words(F.col("unit")).alias("words")).withColumn("n", F.size("words") - 1)
    low, high = least / (2 - least), (2 - least) / least
    near = lambda b: F.col("n").between(math.ceil(len(b) * low - 1e-9), math.floor(len(b) * high + 1e-9))
    units = units.filter(reduce(Column.__or__, [near(b) for _, b in sized]))
    words = F.col("words")
    units = units.withColumn("bigrams", F.zip_with(F.slice(words, F.lit(1), F.col("n")), F.slice(words, F.lit(2), F.col("n")), lambda a, b: F.concat_ws(" ", a, b)))
    hits = []
    for name, b in sized:
        dice = 2 * F.size(F.array_intersect("bigrams", _literals(b))) / (F.col("n") + len(b))
        hits.append(F.when(near(b) & (dice >= least), F.struct(F.lit(name).alias("license"), dice.alias("dice"))))
    found = units.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    found = found.select("doc_id", "hit.license", F.lit(1).cast("long").alias("n"), "hit.dice")
    found = found.unionByName(scan_runs(docs, TEMPLATES if templates is None else templates, least))
    if templates is None:
        found = found.unionByName(scan_tags(every))
    return found.groupBy("doc_id", "license").agg(F.sum("n").alias("n_matches"), F.max("dice").alias("dice"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), scratch=Scratch(spark, "op4"))


def _sql() -> str:
    values = ", ".join(f"('{name}', [{', '.join(repr(x) for x in template_bigrams(t))}])" for name, t in sorted(NOTICES.items()))
    return rf"""
WITH t(license, b) AS (VALUES {values}),
lines AS (SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
units AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, text AS unit FROM lines UNION ALL SELECT doc_id, line FROM lines
    UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) FROM lines)
), words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM units),
grams AS (SELECT doc_id, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM words WHERE len(w) >= 2),
scored AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(list_distinct(g), b)) / (len(g) + len(b)) AS dice FROM grams, t WHERE len(g) <= 3 * len(b))
SELECT doc_id, license, count(*)::BIGINT AS n_matches, max(dice) AS dice FROM scored WHERE dice >= {LEAST} GROUP BY ALL
"""


OP4_SQL = _sql()

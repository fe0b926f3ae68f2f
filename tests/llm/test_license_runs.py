"""Licences that go over several lines, against plain Python."""

import re
import textwrap

import pytest

from pyspark.sql import functions as F

from tidemark.llm import license_scan

LEAST = license_scan.LEAST


def _words(x):
    return [w for w in re.split(r"[\W_]+", x.lower()) if w]


def _pairs(w):
    return list(zip(w, w[1:]))


def brute(text, template):
    """(n_matches, dice) of one text and template, every run tried."""
    t = _words(template)
    a, low, high = set(_pairs(t)), LEAST / (2 - LEAST), (2 - LEAST) / LEAST
    plain = lambda w: 2 * len(a & set(_pairs(w))) / (len(w) - 1 + len(a)) if len(w) > 1 else 0
    sentences = lambda line: re.split(r"(?<=[.!?])\s+", line)
    units = {text, *text.split("\n"), *(s for line in text.split("\n") for s in sentences(line))}
    scores = [plain(_words(u)) for u in units]
    scores = [x for x in scores if x >= LEAST]
    pieces = [(_words(s), k) for k, line in enumerate(text.split("\n")) for s in sentences(line) if _words(s)]
    best, alone = [], []
    for i in range(len(pieces)):
        top = (0, -1)
        for j in range(i, len(pieces)):
            w = sum((p for p, _ in pieces[i : j + 1]), [])
            d = 2 * len(a & set(_pairs(w))) / (len(set(_pairs(w))) + len(a))
            if len(t) * low - 1e-9 <= len(w) <= len(t) * high + 1e-9 and d > top[0]:
                top = (d, j)
            line = {k for _, k in pieces[i : j + 1]}
            whole = len(line) == 1 and (i == 0 or pieces[i - 1][1] not in line) and (j + 1 == len(pieces) or pieces[j + 1][1] not in line)
            if (i == j or whole or (i == 0 and j + 1 == len(pieces))) and plain(w) >= LEAST:
                alone.append((i, j))
        if top[0] >= LEAST:
            best.append((i, top[1], top[0]))
    n, end = len(scores), -1
    for i, j, _ in best:
        if i > end and not any(x <= j and y >= i for x, y in alone):
            n, end = n + 1, j
    found = scores + [d for *_, d in best]
    return (n, pytest.approx(max(found))) if found else None


def test_wrapped_licences(spark):
    t = license_scan.TEMPLATES
    wrap = lambda name, width=80, mark="": "\n".join(mark + x for x in textwrap.wrap(" ".join(t[name].split()), width))
    texts = [
        "Copyright (c) 2020 Some One\n\n" + wrap("MIT-text") + "\n\nAnd other words. More of them.\n",
        wrap("ISC-text", 60), wrap("GPL-3.0-or-later-header", 70, "# ") + "\nimport os\nprint(1)", "head\n" + " ".join(t["Apache-2.0-header"].split()) + "\ntail of a text",
        wrap("BSD-3-Clause-text", 72, " * "), "a b c\nThis was Released under the\nMIT License. And more\nReleased under the MIT License.\nq r\nReleased under\nthe MIT License.\nend",
        "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;", "license software without permission\nof any kind\n", None, "",
    ]
    names = [x for x in t if not x.endswith("-text") or x in ("MIT-text", "ISC-text", "0BSD-text", "BSD-2-Clause-text", "BSD-3-Clause-text")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.n_matches, r.dice) for r in license_scan.scan(df).collect()}
    want = {(i, name): x for i, text in enumerate(texts) for name in names if (x := brute(text or "", t[name]))}
    assert {k: v for k, v in got.items() if k[1] in names} == want
    assert {(0, "MIT-text"), (1, "ISC-text"), (2, "GPL-3.0-or-later-header"), (3, "Apache-2.0-header"), (4, "BSD-3-Clause-text"), (5, "MIT")} <= set(want) and got[6, "LGPL-2.1-or-later-tag"] == (1, 1.0)
    assert got[5, "MIT"][0] == 3 and got[0, "MIT-text"][0] == 1


def test_whole_texts(spark):
    """Each shipped text is found in itself, with other words around it."""
    t = {k: v for k, v in license_scan.TEMPLATES.items() if k.endswith("-text")}
    df = spark.createDataFrame([(k, "some words\n" + v + "\nand others") for k, v in t.items()], "doc_id string, text string")
    got = {(r.doc_id, r.license): r.dice for r in license_scan.scan(df, t).collect()}
    assert all(got[k, k] > 0.95 for k in t)


def test_tags(spark):
    """Expressions of SPDX tags, read as wholes: no identifier is taken for one that is like it."""
    say = "SPDX-License-Identifier:"
    cases = {
        f"// {say} MIT-0": ["MIT-0"], f"{say} GPL-2.0+": ["GPL-2.0-or-later"], f"{say} GPL-2.0": ["GPL-2.0-only"], f"{say}\tgpl-2.0-OR-later\n": ["GPL-2.0-or-later"],
        f"{say} BSD-2-Clause-Patent": ["BSD-2-Clause-Patent"], f"{say} MIT OR Apache-2.0": ["MIT", "Apache-2.0"], f"/* {say} (MIT AND (apache-2.0 OR LGPL-2.1)) */": ["MIT", "Apache-2.0", "LGPL-2.1-only"],
        f"x = 1  # {say} GPL-2.0-only WITH Classpath-exception-2.0 OR ISC, see COPYING": ["GPL-2.0-only", "ISC"], f"a {say} MIT. More.\nb {say} MIT -->": ["MIT", "MIT"], f"{say}\nMIT": [], f"{say} OR": ["OR"],
        "SPDX License Identifier MIT": [], f"{say} Apache-2.0+ and more": ["Apache-2.0+"], f"{say} LicenseRef-Own.1 ORANGE": ["LicenseRef-Own.1"],
    }
    df = spark.createDataFrame(list(enumerate(cases)) + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", license_scan.tags(F.col("text")).alias("t")).collect()}
    assert {k: got[i] for i, k in enumerate(cases)} == cases and got[99] is None
    named = {(r.doc_id, r.license): r.n_matches for r in license_scan.scan(df).collect() if r.license.endswith("-tag")}
    assert named == {(i, f"{x}-tag"): cases[k].count(x) for i, k in enumerate(cases) for x in cases[k]}

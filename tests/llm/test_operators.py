"""Each operator against a plain brute-force version, and over rows with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm import bpe, embedding_dedup, fingerprints, license_scan, line_dedup, mixing, ngram_join, quality, substring_dedup, warc
from tidemark.llm.common import Scratch
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)


def corpus(seed=3, n=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É\x85t\x1fé", "THE", "The"]
    passages = [" ".join(rng.choices(vocab, k=rng.randrange(21, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(0, 50))) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        texts.append(rng.choice(["\n", " ", "\r\n", "  \t"]).join(parts))
    texts += [texts[0], texts[1], texts[1] + " more", "a b " * 60, "a b " * 61, "", None, " ", "one", "one two", "ONE two", passages[0], passages[0] * 2]
    rng.shuffle(texts)
    return [(i * 3 % 1009, t, rng.choice(["s1", "s1", "s1", "s2", None, "s3"])) for i, t in enumerate(texts)]


# --- 1


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    vectors = [*base, *(base[0] + rng.standard_normal((30, 16)) * 0.1), *(base[1] * 2 for _ in range(5)), *([base[1]] * 5), *(base[2] + rng.standard_normal((20, 16)) * 0.25)]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows = [(1000 - i, v, 1, "x") for i, v in enumerate(vectors)] + [(2000 + i, v, 1, "x") for i, v in enumerate(odd)] + [(None, vectors[1], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    for chunk in (2048, 7):
        got = {r.vec_id: r for r in embedding_dedup.link_embeddings(df, Scratch(spark, "t1"), chunk=chunk, tables=48, projections=12).collect()}
        unit = np.array(vectors)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = unit @ unit.T >= 0.95
        np.fill_diagonal(linked, False)
        group = list(range(len(vectors)))
        for a, b in itertools.product(*[range(len(vectors))] * 2):
            if linked[a, b]:
                ga, gb = group[a], group[b]
                group = [max(ga, gb) if g in (ga, gb) else g for g in group]
        extra = linked[:, 1] + (np.arange(len(vectors)) == 1)
        want_links = linked.sum(1) + extra
        missing = sum(int(want_links[i]) - got[1000 - i].n_links for i in range(len(vectors)))
        assert 0 <= missing <= 0.1 * want_links.sum()
        assert all(got[1000 - i].n_links <= want_links[i] for i in range(len(vectors)))
        same = [got[1000 - i].component_id == 1000 - max(j for j in range(len(vectors)) if group[j] == group[i]) for i in range(len(vectors))]
        assert np.mean(same) > 0.95
        for i in range(len(odd)):
            assert got[2000 + i][1:] == (0, 2000 + i, True)
        assert got[None].component_id is None and not got[None].kept
    assert embedding_dedup.link_embeddings(df.limit(0), Scratch(spark, "t1")).count() == 0


def test_embedding_chains(spark):
    """Links that form no clique: each vector of an arc links with its neighbours only, and ids jump along it."""
    steps = np.deg2rad(15) * np.arange(12)
    arc = np.zeros((12, 16))
    arc[:, 3], arc[:, 8] = np.cos(steps), np.sin(steps)
    ids = [7, 11, 2, 9, 12, 4, 10, 1, 8, 5, 6, 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, arc)], "vec_id long, embedding array<double>")
    for chunk in (2048, 3):
        got = {r.vec_id: r for r in embedding_dedup.link_embeddings(df, Scratch(spark, "t1c"), chunk=chunk, tables=96, projections=12).collect()}
        assert [got[i].n_links for i in ids] == [1] + [2] * 10 + [1]
        assert {r.component_id for r in got.values()} == {1} and [i for i in got if got[i].kept] == [1]


def test_repeated_vector_ids(spark):
    """Vectors that share an id have links and components of their own; several without an id too."""
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 32))
    near = lambda v: (v + rng.standard_normal(32) * 0.01).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a)), (3, near(b)), (4, near(b)), (None, near(a)), (None, near(b)), (None, rng.standard_normal(32).tolist())]
    got = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t1r")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (0, 2, 0, False), (0, 3, 0, False), (1, 2, 1, True), (1, 3, 1, True), (2, 2, 1, False), (3, 3, 1, False), (4, 3, 1, False)]


def test_hashing_plan():
    """More vectors take more projections; the recall at the threshold, here measured, holds at any size."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    apart = embedding_dedup.most_apart(0.95)
    bits = lambda v: np.unpackbits(embedding_dedup.sketches(v, 7).view(np.uint8), axis=1)
    assert ((bits(x) != bits(y)).sum(axis=1) <= apart).all() and apart < 40
    known = None
    for n in (10_000, 10_000_000):
        plan = embedding_dedup.hashing_plan(n, 0.95)
        assert known is None or plan > known
        known = plan
        met = (embedding_dedup.bucket_keys(x, *plan, embedding_dedup.WIDTH, 7) == embedding_dedup.bucket_keys(y, *plan, embedding_dedup.WIDTH, 7)).any(axis=1)
        assert met.mean() > 0.96


def test_least_reachable():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = rng.integers(2, 30)
        ids, e = rng.permutation(1000)[:n], rng.integers(0, n, (rng.integers(1, 30), 2))
        a, b = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        want = list(ids)
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        assert embedding_dedup._least_reachable(ids, a, b).tolist() == want


# --- 2


def brute_mix(rows):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 3 * total[s]]
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
            free.discard(s)
    return size, total, target


def test_mixing(spark):
    rows = corpus() + [(5000 + i, "x " * 40, f"t{i % 4}") for i in range(200)]
    df = documents(spark, rows).selectExpr("*", "'c' AS h", "1 AS cut", "'z' AS s")
    size, total, target = brute_mix(rows)
    plan = mixing.mix_plan(df, Scratch(spark, "t2")).collect()
    assert sorted((r.doc_id, r.size) for r in plan) == sorted((r[0], n) for r, n in zip(rows, size))
    for s in total:
        mine = [r for r in plan if r.source == s]
        assert {r.source_size for r in mine} == {total[s]} and all(abs(r.target - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r.size * r.times for r in mine) - target[s]) <= max(r.size for r in mine)
        assert all(r.times <= 3 for r in mine)
    assert sorted(plan) == sorted(mixing.mix_plan(df.repartition(7), Scratch(spark, "t2")).collect())
    mixed = mixing.mix(df, Scratch(spark, "t2"))
    assert mixed.columns == df.columns
    want = {r.doc_id: r.times for r in plan if r.times}
    assert {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert mixing.mix_plan(df.limit(0), Scratch(spark, "t2")).count() == 0


# --- 3


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    owner = {}
    for i, t, _ in rows:
        for k in map(key, (t or "").split("\n")):
            owner[k] = min(owner.get(k, i), i)
    out = {}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines(spark):
    rng = random.Random(5)
    lines = [f"Common line number {i} É" for i in range(30)] + ["short", "", "éééééééééé", "ééééééééé", " COMMON line number 1 É", " \x0bcommon LINE number 1 É\r"]
    rows = [(rng.randrange(10**6) - 500, "\n".join(rng.choices(lines, k=rng.randrange(0, 8)) + [f"own line of document {i}"] * rng.randrange(3)), "s") for i in range(120)] + [(7, None, "s"), (8, "", "s")]
    df = documents(spark, rows).selectExpr("*", "1 AS row", "'k' AS kept", "'o' AS owned")
    want = brute_lines(rows)
    for batches in (1, 4, 9):
        got = line_dedup.dedup_lines(df, Scratch(spark, "t3"), batches=batches).collect()
        assert {r.row.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == want
    left = line_dedup.without_repeated_lines(df, Scratch(spark, "t3"))
    assert left.columns == df.columns and {r.doc_id: r.text for r in left.collect()} == {i: x[2] for i, x in want.items() if x[1] < x[0]}
    ties = documents(spark, [(None, "a line that repeats", "s"), (1, "a line that repeats", "s"), (1, "A line that repeats ", "s"), (None, "another that repeats", "s"), (None, "another that repeats", "s")])
    assert sorted((r.row.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(ties, Scratch(spark, "t3")).collect()) == [(0, 0), (0, 0), (0, 1), (1, 0), (1, 0)]
    assert line_dedup.dedup_lines(df.limit(0), Scratch(spark, "t3")).count() == 0


# --- 4


def test_licenses(spark):
    texts = ["x y z\nReleased under the MIT License.\nmore", "Some words. Licensed under CC BY-NC 4.0. More words here.", "LICENSED under the apache license -- version 2.0", "nothing of the kind here", None, "", "license", license_scan.TEMPLATES["ISC"], "licensed license " * 3000]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).selectExpr("*", "1 AS n", "2 AS unit", "3 AS words")
    got = {(r.doc_id, r.license): (r.n_matches, r.dice) for r in license_scan.scan(df).collect()}

    def bigrams(x):
        w = [y for y in re.split(r"[\W_]+", x.lower()) if y]
        return [f"{a} {b}" for a, b in zip(w, w[1:])]

    want = {}
    for i, t in enumerate(texts):
        t = t or ""
        units = {t, *t.split("\n"), *(s for line in t.split("\n") for s in re.split(r"(?<=[.!?])\s+", line))}
        for name, template in license_scan.TEMPLATES.items():
            a = set(bigrams(template))
            scores = [2 * len(a & set(bigrams(u))) / (len(a) + len(bigrams(u))) for u in units]
            hits = [x for x in scores if x >= license_scan.LEAST]
            if hits:
                want[i, name] = (len(hits), pytest.approx(max(hits)))
    assert got == want and {k[0] for k in want} == {0, 1, 2, 7}
    assert license_scan.scan(df.limit(0)).count() == 0 and license_scan.scan(df, {}).count() == 0


# --- 5


def labelled(spark, n=400):
    rng = random.Random(2)
    good, bad = ["harbour", "letter", "window", "garden", "morning"], ["BUY!!", "$$$", "%%%win", "###", "click&&&"]
    rows, marks = [], []
    for i in range(n):
        quality_ = rng.random() < 0.7
        words = rng.choices(good + [f"n{k}" for k in range(50)], k=60) if quality_ else rng.choices(good + bad * 3, k=60)
        rows.append((i, " ".join(words), rng.choice(["s1", "s2"]) if rng.random() < 0.5 else ("s3" if quality_ else "s4")))
        marks.append((i, int(quality_), 0))
    return documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {m[0]: m[1] for m in marks}


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    seen = labels.filter("doc_id % 2 = 0")
    model = quality.fit_quality(docs, seen, Scratch(spark, "t5"), confident=0.9)
    assert sum(model.taught) > 0
    got = quality.score_quality(docs, model).select("row.doc_id", "score", "kept").collect()
    held = [r for r in got if r.doc_id % 2]
    assert np.mean([r.kept == truth[r.doc_id] for r in held]) > 0.97
    assert sorted(got) == sorted(quality.score_quality(docs.repartition(5), quality.fit_quality(docs.repartition(3), seen, Scratch(spark, "t5"), confident=0.9)).select("row.doc_id", "score", "kept").collect())
    odd = spark.createDataFrame([(None, None, None, None, None, 1, 2.0), (1, "", "xx", "", -5, 1, 2.0), (1, "x" * 10**6, "en", "s", 10**6, 1, 2.0)], DOCS + ", kept int, score double")
    assert [r.score is not None for r in quality.score_quality(odd, model).collect()] == [True] * 3
    assert quality.fit_quality(docs, labels.limit(0), Scratch(spark, "t5")) is None and quality.fit_quality(docs.limit(0), labels, Scratch(spark, "t5")) is None
    assert all(r.kept and r.score is None for r in quality.score_quality(odd, None).collect())
    assert quality.score_quality(docs.limit(0), model).count() == 0


# --- 6


def brute_windows(rows):
    seen, out = {}, {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if tuple(words[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.setdefault(tuple(words[k : k + 20]), i)
        out[i] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("contents,symbols", [(4096, 1 << 20), (3, 200)])
def test_substrings(spark, contents, symbols):
    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(99)}" for _ in range(45))
    rows = corpus() + [(3000 + i, f"{' '.join(rng.choices('abcdefgh', k=rng.randrange(0, 30)))} {shared} {' '.join(rng.choices('abcdefgh', k=25))}", "s") for i in range(40)] + [(2000, "z " * 90, "s"), (2001, "z " * 30, "s")]
    df = documents(spark, rows).selectExpr("*", "1 AS id", "2 AS tie", "3 AS gone", "4 AS kept")
    got = substring_dedup.dedup_substrings(df, Scratch(spark, "t6"), contents, symbols).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_windows(rows)
    assert got[0].row.asDict().keys() == set(df.columns)


def test_substring_ties(spark):
    text = " ".join(map(str, range(40)))
    df = documents(spark, [(4, text, "s"), (4, text, "s"), (None, text, "s"), (None, None, "s"), (5, text + " x", "s")])
    got = sorted((r.row.doc_id or 99, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(df, Scratch(spark, "t6")).collect())
    assert got == [(4, 40, 0), (4, 40, 0), (5, 41, 40), (99, 0, 0), (99, 40, 40)]
    assert substring_dedup.dedup_substrings(df.limit(0), Scratch(spark, "t6")).count() == 0


def test_fm_index():
    """Counts, earliest places and matching statistics of texts in the index and not, symbols that it lacks among them."""
    rng = np.random.default_rng(4)
    for depth in (1, 2, 6, 20):
        seq = np.concatenate([rng.integers(1, 5, 300), [0], rng.integers(1, 5, 200), [0]])
        if depth == 20:
            seq[330:370] = seq[20:60]
        values = rng.permutation(len(seq))
        index = substring_dedup.FMIndex(seq, 5, depth=depth, values=values)
        at = lambda p: [i for i in range(len(seq)) if list(seq[i : i + len(p)]) == list(p)]
        for _ in range(200):
            pattern = rng.integers(1, 5, rng.integers(1, depth + 1))
            lo, hi = index.count(pattern[None, :])
            want = at(pattern)
            assert hi[0] - lo[0] == len(want)
            if want and len(pattern) == depth:
                assert index.least[index.pattern_class(lo)[0]] == min(values[i] for i in want)
        texts = np.concatenate([rng.integers(1, 5, 60), seq[30:80], [-1], seq[310:340], rng.integers(1, 5, 3)])
        ends, sizes = np.array([60, 144, 144]), np.array([60, 84, 3])
        got = {}
        for who, place, length, row in index.matching_statistics(texts, ends, sizes):
            got |= {(w, p): (m, r) for w, p, m, r in zip(who.tolist(), place.tolist(), length.tolist(), row.tolist())}
        for k, (end, size) in enumerate(zip(ends, sizes)):
            for p in range(end - size, end):
                best = max((m for m in range(min(depth, end - p) + 1) if m == 0 or at(texts[p : p + m])), default=0)
                assert got[k, p][0] == best
                if best == depth:
                    assert index.least[index.pattern_class(np.array([got[k, p][1]]))[0]] == min(values[i] for i in at(texts[p : p + best]))
    assert substring_dedup.FMIndex(rng.integers(1, 1000, 50_000), 1000).nbytes() < 4 * 50_000


# --- 7


def test_warc(spark):
    rng = random.Random(1)
    blob = "".join(chr(rng.choice([31, 139, 8, 65, 0x1F600])) for _ in range(60000))
    rows = [(i, f"http://x.example/{i}", rng.choice(["a" * 50, "bé", "", blob, f"own {i}"])) for i in range(60)] + [(100, None, None), (101, "u\r\nX: y", "own"), (None, "u", "own"), (102, "u", "a" * 50), (102, "u", "a" * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    scratch = Scratch(spark, "t7")
    archives = warc.write_warc(pages.repartition(3), scratch.path("w"), scratch)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = sorted((-1 if i is None else i, len((h or "").encode()), warc.digest((h or "").encode()), "revisit" if i is not None and i < last[h or ""] else "response") for i, _, h in rows)
    for split in (64, 777, 4 << 20):
        got = warc.read_warc(archives, split).collect()
        assert sorted((-1 if r.page_id is None else r.page_id, r.payload_length, r.payload_digest, r.record_type) for r in got) == want
        by_id = {i: h or "" for i, _, h in rows}
        assert all(r.payload == by_id[r.page_id].encode() and r.refers_to is None if r.record_type == "response" else r.payload == b"" and r.refers_to == last[by_id[r.page_id]] for r in got)
    small = warc.write_warc(pages, scratch.path("w2"), scratch, least=10)
    assert {len(by_id[r.page_id].encode()) >= 10 for r in warc.read_warc(small).filter("record_type = 'revisit'").collect()} == {True}
    assert warc.read_warc(warc.write_warc(pages.limit(0), scratch.path("w3"), scratch)).count() == 0


# --- 8


def test_fingerprints(spark):
    rows = sorted(corpus(), key=lambda r: r[0])
    df = documents(spark, rows).selectExpr("*", "1 AS bucket", "2 AS sk", "3 AS next")
    k = fingerprints.K

    def grams(text):
        w = WORD.findall(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    for width in (64, 2):
        got = {r.doc_id: r for r in fingerprints.fingerprint(df.repartition(5), width=width).collect()}
        assert len(got) == len(rows)
        prints = {}
        for (i, t, _), (_, u, _) in zip(rows, rows[1:] + rows[:1]):
            t, u = t or "", u or ""
            edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
            assert len(r.fingerprint) == 16 * min(k, len(grams(t))) and len(r.edited_fingerprint) == 16 * min(k, len(grams(edited)))
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
            for x, est in ((edited, r.near_edited), (u, r.near_next)):
                a, b = grams(t), grams(x)
                exact = len(a & b) / len(a | b) if a | b else 1.0
                assert abs(est - exact) < (1e-9 if len(a | b) <= k else 0.25)
    odd = documents(spark, [(None, "abcd efgh", "s"), (1, "abcdefgh", "s"), (1, "abcd", "s"), (9, None, "s")])
    got = sorted((r.doc_id or 99, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint(odd).collect())
    assert got == sorted([(1, 8, sha("abcdef")), (1, 4, sha("abc")), (9, 0, sha("")), (99, 9, sha("abcd ef"))])
    assert fingerprints.fingerprint(df.limit(0)).count() == 0


def test_sketch_estimates(spark):
    from pyspark.sql import functions as F

    a, b = (" ".join(f"w{i}" for i in range(lo, lo + 3000)) for lo in (0, 1500))
    df = spark.createDataFrame([("k", a), ("k", b), ("e", "")], "key string, text string").withColumn("sketch", fingerprints.sketch(F.col("text")))
    merged = {r.key: r.n for r in fingerprints.merge_parts(df, "key").select("key", fingerprints.distinct_shingles(F.col("sketch")).alias("n")).collect()}
    assert merged["e"] == 0 and abs(merged["k"] / 4492 - 1) < 0.35
    pair = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    near, part, whole = pair.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("a"))).first()
    assert abs(near - 1 / 3) < 0.15 and abs(part - 0.5) < 0.3 and whole == 1.0


# --- 9


def test_bpe(spark):
    import tiktoken

    data, pattern = bpe._default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "b", "th", "e", " ", "\n", "é", "ß", "日本", "😀", "0", "'s", "$", "\x00", "\x1c", "\x85", " ", "½", "<|endoftext|>"], k=rng.randrange(80))) for _ in range(300)]
    texts += [None, "", "a" * 3000, "ab" * 3000, "🏳️‍🌈" * 200, *(t for _, t, _ in corpus())]
    df = documents(spark, [(i % 290, t, "s") for i, t in enumerate(texts)]).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = bpe.tokenize(df)
    want = sorted((i % 290, ids, sha(",".join(map(str, ids))), sha(t or "")) for i, t in enumerate(texts) for ids in [enc.encode_ordinary(t or "")])
    assert sorted((r.doc_id, list(r.ids), r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert sorted(bytes(r.data).decode() for r in bpe.detokenize(got).collect()) == sorted(t or "" for t in texts)
    assert bpe.tokenize(df.limit(0)).count() == 0


# --- 10


def brute_groups(rows, n, share):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group = [r[0] for r in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both):
            ga, gb = group[a], group[b]
            group = [min(ga, gb) if g in (ga, gb) else g for g in group]
    return {r[0]: (len(s), g) for r, s, g in zip(rows, sets, group)}


@pytest.mark.parametrize("n,share,block", [(3, (9, 10), 1024), (3, (9, 10), 4), (5, (8, 10), 1024)])
def test_ngrams(spark, n, share, block):
    rng = random.Random(6)
    rows = corpus()
    for k in range(6):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.choice([12, 40, 150]))]
        for j in range(12):
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = f"u{k}{j}"
            rows.append((2000 + 20 * k + j, " ".join(words), "s"))
    df = documents(spark, rows).selectExpr("*", "1 AS id", "2 AS rep", "3 AS n")
    got = ngram_join.join_ngrams(df, Scratch(spark, "t10"), n=n, share=share, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, n, share)


def test_ngram_ties(spark):
    df = documents(spark, [(5, "a b c d", "s"), (5, "x y", "s"), (3, "A b c d", "s"), (None, None, "s"), (None, "x  y", "s"), (8, None, "s"), (9, "", "s")])
    got = sorted((r.doc_id or 99, r.n_shingles, r.component_id or 99) for r in ngram_join.join_ngrams(df, Scratch(spark, "t10")).collect())
    # rows of one id are one document of the graph: what links with any of them links with all
    assert got == [(3, 2, 3), (5, 1, 3), (5, 2, 3), (8, 0, 8), (9, 0, 9), (99, 0, 99), (99, 1, 3)]
    assert ngram_join.join_ngrams(df.limit(0), Scratch(spark, "t10")).count() == 0


def test_words_of_slices():
    """Parts of a batch have the words of the whole, without nulls and with them, lower-cased and not."""
    import pyarrow as pa

    from tidemark.llm.common import portions, word_hashes

    rng = random.Random(1)
    for share in (0, 0.2):
        texts = pa.array([None if rng.random() < share else " ".join(rng.choices(["Big", "SMALL", "words", "ÀÉ"], k=rng.randrange(60))) for _ in range(500)])
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        for lower in (False, True):
            hashes, at = word_hashes(texts, lower)
            parts = [word_hashes(p["text"], lower) for p in portions(batch, size=1000)]
            assert len(parts) > 5 and np.concatenate([h for h, _ in parts]).tolist() == hashes.tolist()
            assert np.concatenate([np.diff(a) for _, a in parts]).tolist() == np.diff(at).tolist()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    group = {}
    for a, b in edges:
        if a != b:
            x, y = group.setdefault(a, a), group.setdefault(b, b)
            group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "tc")).collect()}
    assert got == group
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "tc")).count() == 0

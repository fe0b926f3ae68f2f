"""The pipeline's stages one after another, each on what the one before it kept, against plain Python."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_operators import DOCS, brute_groups, brute_lines, brute_mix, sha

from tidemark.llm import bpe, quality
from tidemark.llm.common import Scratch


def table(n=160):
    rng = random.Random(4)
    good, bad = [f"word{i}" for i in range(300)], ["BUY!!", "$$$", "%%%win", "###"]
    passages = [" ".join(rng.choices(good, k=60)) for _ in range(5)]
    rows, marks = [], []
    for i in range(n):
        fine = i % 4 > 0 or i % 9 == 2
        text = "\n".join(" ".join(rng.choices(good if fine else good[:20] + bad * 8, k=rng.randrange(8, 25))) for _ in range(rng.randrange(2, 6)))
        if i % 7 == 1:
            text += "\n" + "a line that many of these documents have in common"
        if i % 9 == 2:
            text = passages[i % 5] + " " + " ".join(rng.choices(good, k=3))
        rows.append((i * 3 + 5, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None, "c"]), len(text)))
        if i % 3:
            marks.append((i * 3 + 5, int(fine), 0))
    rows += [(9001, None, "en", "a", None), (9002, "", None, None, 0), (9003, rows[3][1], "en", "b", 5), (9004, " \n ", "en", "c", 3)]
    return rows, marks


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, marks = table()
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS row", "'k' AS kept", "2 AS h", "3 AS id").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    seen.append(docs)
    scratch = Scratch(spark, "stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.write(stage(spark, docs, folder), f"s{k}")
        seen.append(docs)
    return folder, seen


def triples(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_columns(stages):
    _, seen = stages
    assert all(x.columns == seen[0].columns for x in seen[1:5])
    assert [x.count() > 0 for x in seen] == [True] * 6


def test_quality_stage(spark, stages):
    folder, seen = stages
    model = quality.fit_quality(seen[0], spark.read.parquet(f"{folder}/labels.parquet"), Scratch(spark, "t"))
    rows = seen[0].collect()
    views = [np.stack([quality.text_features((r.text or "").encode()) for r in rows]), np.stack([quality.meta_features(r.source, r.lang, r.n_chars) for r in rows])]
    keep = model.score(views)[2] >= quality.KEEP
    assert Counter(triples(seen[1])) == Counter((r.doc_id, r.text, r.source) for r, k in zip(rows, keep) if k)
    fine = {i * 3 + 5 for i in range(160) if i % 4 or i % 9 == 2}
    kept = {r.doc_id for r in seen[1].collect()}
    assert len(kept & fine) > 0.95 * len(fine) and len(kept & ({i * 3 + 5 for i in range(160)} - fine)) <= 2


def test_line_stage(stages):
    _, seen = stages
    want = brute_lines(triples(seen[1]))
    assert {r.doc_id: (r.text, r.n_chars) for r in seen[2].collect()} == {i: (x[2], len(x[2])) for i, x in want.items() if x[1] < x[0]}


def test_join_stage(stages):
    _, seen = stages
    rows = triples(seen[2])
    groups = brute_groups(rows, 5, (8, 10))
    assert Counter(triples(seen[3])) == Counter(r for r in rows if groups[r[0]][1] == r[0]) and seen[3].count() < seen[2].count()


def test_mixing_stage(stages):
    _, seen = stages
    rows = triples(seen[3])
    size, total, target = brute_mix(rows)
    times = {}
    for s in total:
        passes = min(3, int(target[s] // total[s])) if total[s] else 0
        budget, upto = target[s] - passes * total[s], 0
        mine = sorted((int(hashlib.md5(f"{i} {hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:12], 16), n, i) for (i, t, x), n in zip(rows, size) if x == s)
        for _, n, i in mine:
            once_more = upto + n <= budget or 2 * upto + n < 2 * budget
            upto += n
            times[i] = min(3, passes + once_more)
    assert Counter(r[0] for r in triples(seen[4])) == Counter({i: n for i, n in times.items() if n})


def test_bpe_stage(stages):
    import tiktoken

    _, seen = stages
    data, pattern = bpe._default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    want = Counter((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")) for i, t, _ in triples(seen[4]) for ids in [enc.encode_ordinary(t or "")])
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in seen[5].collect()) == want
    assert all(len(r.ids) == r.n_tokens for r in seen[5].collect())


def test_run(spark, stages, tmp_path):
    folder, seen = stages
    assert Counter(map(str, corpus_pipeline.run(spark, folder).drop("ids").collect())) == Counter(map(str, seen[5].drop("ids").collect()))
    empty = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0

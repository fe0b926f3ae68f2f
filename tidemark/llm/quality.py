"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, one_batch, portions, table

#: Labelled documents that the fit sees, those with the smallest id hashes: a bound of the sample, not of the scoring.
LABELLED = 6000
#: Rounds; how sure a view must be of a pseudo-label; and how many of a class it hands over in the first round, twice and three times as many later.
ROUNDS, CONFIDENT, ADDED = 3, 0.98, 400
#: Documents under this combined probability of being good are rejected.
KEEP = 0.5
SOURCES, LANGS = 64, 16
TEXT_DIM, META_DIM = 256 + 8, SOURCES + LANGS + 3


def text_features(text: bytes) -> np.ndarray:
    """Shares of the 256 byte values over the whole text, on a log scale, and ratios of its words and lines."""
    out = np.zeros(TEXT_DIM, np.float32)
    n = len(text)
    if not n:
        out[-1] = 1
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:256] = np.log1p(counts * (1000.0 / n)) / 3
    words, lines = text.split(), text.split(b"\n")
    distinct, long_lines = len(set(words)), [x for x in lines if len(x) > 9]
    out[256] = distinct / max(1, len(words)) ** 0.8
    out[257] = len(set(long_lines)) / max(1, len(long_lines))
    out[258] = np.log1p(n / max(1, len(words))) - 2
    out[259] = np.log1p(len(words)) / 8
    out[260] = counts[65:91].sum() / n
    out[261] = np.log1p(n / len(lines)) / 6
    out[262] = (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) * 4 / n
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Source and language by hash, and the recorded length; nulls have places of their own."""
    out = np.zeros(META_DIM, np.float32)
    out[0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCES - 1)] = 1
    out[SOURCES + (0 if lang is None else 1 + zlib.crc32(lang.encode()) % (LANGS - 1))] = 1
    if n_chars is None or n_chars < 0:
        out[-1] = 1
    else:
        out[-3] = np.log1p(n_chars) / 8
        out[-2] = out[-3] ** 2
    return out


def _features(batch) -> tuple[np.ndarray, np.ndarray]:
    texts = batch["text"].fill_null("").cast(pa.binary()).to_pylist()
    text = np.stack([text_features(t) for t in texts])
    meta = np.stack([meta_features(*x) for x in zip(*(batch[c].to_pylist() for c in ("source", "lang", "n_chars")), strict=True)])
    return text, meta


class Logistic:
    """Ridge logistic regression by Newton steps, with Platt calibration on rows it was not fitted to."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> Logistic:
        x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-4)
            step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-5:
                break
        self.w, self.a, self.b = w, 1.0, 0.0
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) * self.w[:-1]).sum(axis=1) + self.w[-1]  # row by row, so that batches of any size give the same

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """Scales the raw scores to log odds by Platt's soft labels. Steps are halved until they lower the loss: full ones overshoot where the scores separate
        the classes, and may turn them around."""
        z = self.raw(x)
        n1, n0 = y.sum(), len(y) - y.sum()
        soft = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        design, start = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])

        def loss(ab):
            t = design @ ab
            return (np.logaddexp(0, t) - soft * t).sum() + 5e-4 * ((ab - start) ** 2).sum()

        ab = start
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((design * s[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (soft - p) - 1e-3 * (ab - start))
            size = 1.0
            while size > 1e-6 and loss(ab + size * step) > loss(ab):
                size /= 2
            ab = ab + size * step
            if np.abs(size * step).max() < 1e-6 or size <= 1e-6:
                break
        self.a, self.b = max(float(ab[0]), 0.0), float(ab[1])  # the fit's direction stands
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -30, 30)


class CoTrained:
    """Two calibrated views of a document and the prior that they share."""

    def fit(self, views: list[np.ndarray], y: np.ndarray, surest=None, rounds: int = ROUNDS, confident: float = CONFIDENT, added: int = ADDED) -> CoTrained:
        """A fifth of the labelled rows calibrates. In each round a view labels documents that it is sure of beyond `confident`, at most `added` times
        the round of a class, for the other view's next fit. `surest(views, bar, n)` gives for each view the features of such documents and their labels."""
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held[:] = False
        cal = held if held.any() else ~held
        given = [(x[:0], y[:0]) for x in views]
        self.taught = [0, 0]
        for k in range(rounds + 1):
            self.views = [Logistic().fit(np.vstack([x[~held], g[0]]), np.concatenate([y[~held], g[1]])).calibrate(x[cal], y[cal]) for x, g in zip(views, given, strict=True)]
            if k == rounds or surest is None:
                break
            given = surest(self.views, float(np.log(confident / (1 - confident))), added * (k + 1))
            self.taught = [len(g[1]) for g in given]
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return self

    def score(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities by text, by metadata, and combined: the views' evidence beyond the prior adds up."""
        z = [m.logit(x) for m, x in zip(self.views, views, strict=True)]
        return [1 / (1 + np.exp(-v)) for v in (*z, np.clip(sum(z) - (len(z) - 1) * self.prior, -30, 30))]


def _described(batches):
    for b in one_batch(batches):
        text, meta = _features(b)
        flat = lambda x: pa.array(list(x), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b["h"], b["quality"], flat(text), flat(meta)], ["h", "quality", "text", "meta"])


def _judged(models, bar):
    """Key of each document that a view is sure of, with each view's label; 0 where it is not sure."""

    def run(batches):
        for b in (part for batch in one_batch(batches) for part in portions(batch)):
            sides = [np.where(np.abs(z) > bar, np.sign(z), 0).astype(np.int8) for z in (m.logit(x) for m, x in zip(models, _features(b), strict=True))]
            some = (sides[0] != 0) | (sides[1] != 0)
            yield pa.RecordBatch.from_arrays([b["h"].filter(pa.array(some)), *(pa.array(x[some]) for x in sides)], ["h", "by_text", "by_meta"])

    return run


def _view(docs: DataFrame) -> DataFrame:
    """What the features are made of, null where a column is missing, and a key of id and text."""
    column = lambda c, t: (docs[c] if c in docs.columns else F.lit(None)).cast(t).alias(c)
    rows = docs.select(column("doc_id", "long"), column("text", "string"), column("source", "string"), column("lang", "string"), column("n_chars", "long"))
    return rows.withColumn("h", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def fit_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, labelled: int = LABELLED, **options) -> CoTrained | None:
    """Fits on the `labelled` documents with the smallest id hashes; None without labels of both classes.

    Ids are sampled from narrow columns and joined back, so only those documents' features (1.4 KB each) reach the driver; of an id with several
    texts the one with the smallest hash counts. In each round both views judge all other documents; what they are sure of is a narrow table, of which
    the smallest hashes are taken, and only those documents' features travel. Labels that are null or disagree about a document are left out.
    """
    view = _view(docs)
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    marks = marks.filter("quality = other AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int"))
    ids = view.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("o", F.xxhash64("doc_id"))
    known = scratch.write(ids.join(marks, "doc_id").orderBy("o", "doc_id").limit(labelled).select("doc_id", "quality"), "known")
    one = view.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "text", "source", "lang", "n_chars", "quality")).alias("r")).select("r.*")
    schema = "h long, quality int, text array<float>, meta array<float>"
    dims = (("text", TEXT_DIM), ("meta", META_DIM))
    pick = lambda rows, c, dim: np.array([r[c] for r in rows], np.float32).reshape(-1, dim)
    rows = sorted(one.mapInArrow(_described, schema).collect(), key=lambda r: zlib.crc32(str(r.h).encode()))
    y = np.array([r.quality for r in rows], np.float64)
    if len(set(y)) < 2:
        return None
    others = view.join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")  # `labelled` ids at most
    round_no = iter(range(100))

    def surest(models, bar, n):
        k = next(round_no)
        judged = scratch.write(others.mapInArrow(_judged(models, bar), "h long, by_text byte, by_meta byte"), f"judged-{k}")
        taken = [judged.filter(F.col(c) == s).select("h", F.lit(v).alias("by"), F.lit((s + 1) // 2).alias("quality")).orderBy("h").limit(n) for v, c in enumerate(("by_text", "by_meta")) for s in (1, -1)]
        chosen = scratch.write(reduce(DataFrame.unionByName, taken), f"chosen-{k}")
        wanted = F.broadcast(chosen.select("h").distinct())  # 4 n hashes at most
        found = {r.h: r for r in view.join(wanted, "h").dropDuplicates(["h"]).withColumn("quality", F.lit(0)).mapInArrow(_described, schema).collect()}
        lessons = sorted(tuple(r) for r in chosen.filter(F.col("h").isNotNull()).distinct().collect())
        out = []
        for v, d in enumerate(dims):  # what the other view is sure of
            mine = [(h, q) for h, by, q in lessons if by != v]
            out.append((pick([found[h] for h, _ in mine], *d), np.array([q for _, q in mine], np.float64)))
        return out

    return CoTrained().fit([pick(rows, *d) for d in dims], y, surest, **options)


def score_quality(docs: DataFrame, model: CoTrained | None, keep: float = KEEP) -> DataFrame:
    """(row, p_text, p_meta, score, kept): every row of `docs` as a struct, scored over its whole text.

    Null texts count as empty, null metadata (and missing columns) as values of their own. Without a model (no labels of both
    classes) all probabilities are null and every row is kept. An empty table gives an empty result. Extra columns
    stay in `row`, whatever their names.
    """

    def run(batches):
        for b in (part for batch in one_batch(batches) for part in portions(batch)):
            p = model.score(list(_features(b))) if model else [pa.nulls(b.num_rows, pa.float64())] * 3
            kept = p[2] >= keep if model else np.ones(b.num_rows, bool)
            yield pa.RecordBatch.from_arrays([b["row"], *map(pa.array, p), pa.array(kept)], ["row", "p_text", "p_meta", "score", "kept"])

    column = lambda c, t: (docs[c] if c in docs.columns else F.lit(None)).cast(t).alias(c)
    view = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), column("text", "string"), column("source", "string"), column("lang", "string"), column("n_chars", "long"))
    schema = view.select("row").schema.add("p_text", "double").add("p_meta", "double").add("score", "double").add("kept", "boolean")
    return view.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the two views' probabilities of good quality, the combined score, and whether the document stays."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op5"))
    return score_quality(docs, model).select("row.doc_id", "p_text", "p_meta", "score", "kept")

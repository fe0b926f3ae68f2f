"""A training corpus from `documents`: classify, drop repeated lines, join near-duplicates, mix sources, tokenize.

Each stage works on what its predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import tokenize
from tidemark.llm.common import Scratch, table
from tidemark.llm.line_dedup import without_repeated_lines
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import join_ngrams
from tidemark.llm.quality import fit_quality, score_quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality; the classifier learns from the labels of those that came in."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), Scratch(spark, "pipeline-quality"))
    return score_quality(docs, model).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller id holds; n_chars is counted anew. Documents that lose every line go."""
    left = without_repeated_lines(docs, Scratch(spark, "pipeline-lines"))
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id; 5-word shingles at 0.8."""
    groups = join_ngrams(docs, Scratch(spark, "pipeline-join"), n=5, share=(8, 10), bands=60, rows=6)
    lost = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: a document stands in it as often as the mix takes it."""
    return mix(docs, Scratch(spark, "pipeline-mix"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, with digests of the ids and of what they decode to."""
    return tokenize(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("mixing sources", mixing), ("byte-level BPE", byte_bpe)]

#: The classifier's decisions and exact byte-pair merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.write(out, f"stage-{k}")
    return docs

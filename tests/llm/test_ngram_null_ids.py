"""Texts without an id are vertices of their own."""

from tidemark.llm.common import Scratch
from tidemark.llm.ngram_join import join_ngrams


def test_unlike_texts_without_id(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    big = (1 << 62) + 5
    rows = [(5, one), (None, one + " end"), (9, two), (None, two + " end"), (None, "c d e f"), (None, None), (big, "g h i j")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in join_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t10n")).collect()}
    assert got == {(5, 58, 5), (None, 59, 5), (9, 58, 9), (None, 59, 9), (None, 2, None), (None, 0, None), (big, 2, big)}

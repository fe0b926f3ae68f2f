"""Words of texts, or their characters where they are CJK."""

from pyspark.sql import functions as F

from tidemark.functions import text


def test_share_of_cjk_beside_punctuation(spark):
    want = {"The erly th rely.日本語": 16, "The erly th rely日本語": 16, "The early th relys.日本語": 5, "日本 語。": 3, "one, two": 2, "": 0}
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    assert dict(rows.select("t", text.word_count(F.col("t"))).collect()) == want

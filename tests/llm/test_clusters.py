"""Clusters of packing."""

from punctuality.llm import packing


def test_null_texts_have_no_cluster(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, None, "A  b", "a b", ""])], "doc_id long, text string")
    got = [r["c"] for r in rows.select("doc_id", packing.text_cluster().alias("c")).orderBy("doc_id").collect()]
    assert got[:2] == [None, None] and got[2] == got[3] is not None and got[4] is not None

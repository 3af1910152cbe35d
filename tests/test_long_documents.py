"""Chunks behind the thousandth of a document are units of their own."""

from orrery.plans import learning


def test_chunks_behind_the_thousandth(spark, tmp_path):
    long = ["w"] * 80_025 + ["zebra"] + ["w"] * 35  # in chunk 1,000 only
    docs = [(1, " ".join(long)), (2, "another text")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "another"), (8, "zebra")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fused = learning.r6(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.doc_id) for r in fused) == [(7, 2), (8, 1)]
    packed = {r.query_id: (r.n, r.context) for r in learning.r7(spark, str(tmp_path)).collect()}
    assert packed == {7: (1, "another text"), 8: (1, " ".join(long[80_000:]))}

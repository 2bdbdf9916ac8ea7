"""group_by_document_max asks with every document of the shards, not with some."""

from sparkloom.queries import QUERIES, SQL


def test_every_document_is_a_question(spark, tmp_path):
    docs = [(i, f"red w{i}" if i % 3 else f"blue w{i} green") for i in range(1, 9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, [1.0]) for i, _ in docs], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["doc_id"]) for r in QUERIES["group_by_document_max"](spark, str(tmp_path)).collect()}
    assert {(i, i) for i, _ in docs} <= got and "% 20" not in SQL["group_by_document_max"]

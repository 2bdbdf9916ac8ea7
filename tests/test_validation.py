"""validation_report reports blank texts."""

from sparkloom.queries import QUERIES


def test_blank_text_is_reported(spark, tmp_path):
    spark.createDataFrame([(1, "A text."), (2, None), (3, "  ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["id"], r["reason"]) for r in QUERIES["validation_report"](spark, str(tmp_path)).collect()}
    assert got == {("1", "repeated id"), ("2", "blank text"), ("2", "blank title"), ("3", "blank text"), ("3", "blank title")}

"""BM25 from arrays of words is BM25 from postings; documents without words do not count."""

import pytest

from sparkloom import steps
from sparkloom.operators import bm25
from sparkloom.steps import spread


def test_words_and_postings_agree(spark):
    rows = [(0, 1, "a b b c".split()), (0, 2, "a a d".split()), (0, 3, []), (0, 4, None), (1, 1, "b".split()), (1, 5, "c d d".split()), (1, 6, "b c e".split())]
    docs = spark.createDataFrame(rows, "shard_id int, doc_id long, words array<string>")
    asked = spark.createDataFrame([(1, "b", 1.0), (1, "d", 2.0), (1, "b", 0.3), (2, "a", 1.0), (3, "zzz", 1.0)], "query_id long, term string, weight double")
    want = {tuple(r)[:3]: r["score"] for r in bm25.scores(bm25.term_counts(docs, ["shard_id", "doc_id"]), asked).collect()}
    assert want and {tuple(r)[:3]: r["score"] for r in bm25.scores_of_words(docs, asked).collect()} == pytest.approx(want)
    assert bm25.scores_of_words(docs.limit(0), asked).count() == 0


def test_blocks_and_words_agree(spark, monkeypatch):
    """Blocks of a few rows: all pairs, and the best of each shard with those that tie; pairs are not shuffled."""
    monkeypatch.setattr(bm25, "DOC_BLOCK", 3)
    monkeypatch.setattr(bm25, "QUESTION_BLOCK", 2)
    rows = [(i % 3, i, [f"w{(i * j + j * j) % 11}" for j in range(i % 9)]) for i in range(40)] + [(7, 4, ["w1", "w2"]), (7, 50, None)]
    docs = spark.createDataFrame(rows, "shard_id int, doc_id long, words array<string>")
    asked = spark.createDataFrame([(q, f"w{(q + k) % 12}", 1.0 + k) for q in range(7) for k in range(4)] + [(9, "zzz", 1.0)], "query_id long, term string, weight double")
    want = {tuple(r)[:3]: r["score"] for r in bm25.scores_of_words(docs, asked).collect()}
    every = bm25.scores_in_blocks(docs, asked)
    best = {}
    for (q, _, i), score in want.items():
        most, n = best.get((q, i), (0, 0))
        best[q, i] = max(most, score), n + 1
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["shards"]) for r in every.collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in best.items()}
    assert {k: s for k, (s, _) in got.items()} == pytest.approx({k: s for k, (s, _) in best.items()})
    some = {tuple(r)[:3]: r["score"] for r in bm25.scores_in_blocks(docs, asked, 2, among_rows=True).collect()}
    for q in range(7):
        for shard in (0, 1, 2, 7):
            own = sorted((-round(s, 9), i) for (x, y, i), s in want.items() if (x, y) == (q, shard) and i != q)[:2]
            assert all((q, shard, i) in some for _, i in own)
    assert some == pytest.approx({k: want[k] for k in some}) and all(q != i for q, _, i in some)
    assert bm25.scores_in_blocks(docs.limit(0), asked).count() == 0


def test_spread_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.range(500).coalesce(1).write.parquet(path)
    few = spread(spark.read.parquet(path))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in few.collect()) == list(range(500))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert "Exchange" not in spread(spark.read.parquet(path))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_spread_deals_out_by_size(spark, tmp_path, monkeypatch):
    """A task's share does not grow with a table that the session counts as small."""
    path = str(tmp_path / "rows.parquet")
    spark.range(50_000).coalesce(1).write.parquet(path)
    monkeypatch.setattr(steps, "SHARE", 10_000, raising=False)
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        rows = spark.read.parquet(path)
        size = sum(p.stat().st_size for p in (tmp_path / "rows.parquet").glob("*.parquet"))
        few = spread(rows)
        assert few.rdd.getNumPartitions() == -(-size // 10_000) > spark.sparkContext.defaultParallelism
        assert few.count() == few.distinct().count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")

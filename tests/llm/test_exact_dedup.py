from collections import defaultdict
from hashlib import sha256

import pytest

from sparkloom.llm.content_sort import exact_dedup


@pytest.mark.parametrize(("keep", "ranges"), [("largest", 1), ("largest", 9), ("smallest", 9)])
def test_against_brute_force(docs, rows, keep, ranges):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup(docs, keep=keep, partitions=ranges).collect()
    assert len(got) == len(rows)
    best = max if keep == "largest" else min
    for r in got:
        own = groups[r["text"] or ""]
        ids = [i for i in own if i is not None]
        assert (r["keep_id"], r["group_size"]) == (best(ids) if ids else None, len(own))
        assert r["text_sha256"] == sha256((r["text"] or "").encode()).hexdigest()
        assert r["lang"] is None or r["lang"] in ("en", "de")
    kept = [r["text"] or "" for r in got if r["kept"]]
    assert sorted(kept) == sorted(groups)  # one row of each group stays


def test_one_hot_text_spreads_over_ranges(spark):
    hot = spark.range(500).selectExpr("id AS doc_id", "if(id % 5 < 4, 'same', cast(id as string)) AS text")
    got = exact_dedup(hot, partitions=12, keep="largest")
    assert got.filter("text = 'same'").select("keep_id", "group_size").distinct().collect() == [(498, 400)]
    assert got.filter("kept").count() == 101


def test_no_rows(none):
    assert exact_dedup(none).count() == 0


def test_no_python_in_the_plan(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_of_other_columns_do_not_matter(spark):
    names = ["doc_id", "text", "_hash", "_key", "_range", "_body", "_at", "c0", "kept"]
    rows = [(i, t, *(f"{n}{i}" for n in names[2:])) for i, t in enumerate(["a", "b", "a", None, ""])]
    got = exact_dedup(spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)), partitions=4).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [True, True, False, True, False]
    assert all(tuple(r)[: len(names) - 1] == rows[i][:-1] for i, r in enumerate(got))


def test_long_common_beginnings(spark):
    """Texts that agree on more than a splitter holds, some of them with many copies."""
    text = "concat(repeat('boilerplate ', 50), cast(if(id % 3 = 0, 7, id % 97) as string))"
    rows = spark.range(900).selectExpr("id AS doc_id", f"{text} AS text").repartition(5)
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r["text"]].append(r["doc_id"])
    for r in exact_dedup(rows, partitions=10, keep="largest").collect():
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[r["text"]]), len(groups[r["text"]]), r["doc_id"] == max(groups[r["text"]]))

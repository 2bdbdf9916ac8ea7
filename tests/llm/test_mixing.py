import pytest

from sparkloom.llm.mixing import mix, targets


def water(sizes, weights, share, most):
    """By repeated resharing."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[n] for n in free)
        over = {n for n in free if left * weight[n] / total >= most * sizes[n]}
        if not over:
            return out | {n: left * weight[n] / total for n in free}
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
        free -= over
    return out


def test_targets(spark):
    sizes = {"a": 100, "b": 5, "é": 70, "c": 1000, None: 40, "zero": 0}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(water(sizes, (5, 2, 1), 1.5, 2.0))


def test_mix(docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    by = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = by.setdefault(r["source"], [0, r["target"], 0, 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
        s[3] += r["size"]
    for taken, target, largest, size in by.values():
        assert abs(taken - target) <= largest and target <= 2 * size
    assert {r["size"] for r in got if not (r["text"] if "text" in r else "") and r["doc_id"] in (201, 202, 203)} == {0}


def test_weights_change_inclusion(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'one two three' AS text", "'s' AS source", "if(id % 2 = 0, 3.0, 1.0) AS w", "7 AS taken")
    got = mix(docs, share=0.4, weight_col="w").groupBy("w").sum("taken").collect()
    taken = {r["w"]: r[1] for r in got}
    assert sum(taken.values()) == pytest.approx(0.4 * 12000, abs=3)
    assert taken[3.0] > 2.2 * taken[1.0]


def test_no_rows(none):
    assert mix(none).count() == 0


def test_inclusion_is_as_designed(spark):
    """Documents of 2 and of 200 words: a source's words come to its target, copies in proportion to 1 / (1 + binary digits)."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', if(id % 3 = 0, 200, 2)) AS text", "'s' AS source", "id AS _u", "id AS c0", "id AS _source")
    got = mix(docs, share=0.6)
    assert [tuple(r) for r in got.filter("_u <> doc_id OR c0 <> doc_id OR _source <> doc_id").collect()] == []
    mean = {r["size"]: r["m"] for r in got.groupBy("size").agg({"copies": "avg"}).toDF("size", "m").collect()}
    words, wanted = {2: 4000, 200: 200_000}, 0.6 * 204_000
    factor = wanted / sum(n / (1 + s.bit_length()) for s, n in words.items())
    assert mean == pytest.approx({s: factor / (1 + s.bit_length()) for s in words}, rel=0.04)


def test_rows_without_identifier_are_not_one_block(spark):
    docs = spark.range(2000).selectExpr("cast(null AS long) AS doc_id", "concat('word', id) AS text", "'s' AS source")
    assert mix(docs, share=0.5).agg({"taken": "sum"}).first()[0] == 1000

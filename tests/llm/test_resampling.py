import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest

from sparkloom.llm.resampling import Tournament, drawn, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features_of(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=10, longest=1, buckets=10_000, least=20, seed="2024"):
    """rows: (doc_id, text)."""
    bucket = lambda f: crc32(f.encode()) % buckets
    own = Counter(bucket(f) for _, t in rows for f in features_of(t, longest)[1])
    goal = Counter(bucket(f) for t in target for f in features_of(t, longest)[1])
    s, t = sum(own.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        n, found = features_of(text, longest)
        weight = sum(gain[bucket(f)] for f in found)
        u = (int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(u))), n >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    take = percent * len(order) // 100
    ranks = [(tuple(r[:4]), rank) for rank, r in enumerate(order[:take], 1)]
    rest = [(tuple(r[:4]), None) for r in order[take:]] + [(tuple(r[:4]), None) for r in out if not r[4]]
    return sorted(ranks + rest, key=str)


@pytest.fixture(scope="module")
def worded():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "日本", "THE", "the", "3rd"]
    rows = [(i, r.choice([" ", ", ", "-"]).join(r.choices(vocabulary[i % 97 :], k=r.randint(0, 60)))) for i in range(600)]
    copies = " ".join(vocabulary[200:260])
    rows += [(1000 + i, copies) for i in range(200)] + [(None, copies), (-3, copies), (2000, None), (2001, ""), (2002, "?!"), (5, rows[5][1]), (2003, "w299 " * 40_000)]
    return rows, [" ".join(vocabulary[200:]), None, "the 3rd 日本"]


@pytest.mark.parametrize(("longest", "percent", "range_rows"), [(1, 10, 1 << 17), (1, 33, 40), (2, 100, 100), (3, 0, 50)])
def test_against_brute_force(spark, worded, longest, percent, range_rows):
    rows, target = worded
    docs = spark.createDataFrame([(t, i, "x", 1.5) for i, t in rows], "text string, doc_id long, rank string, c0 double").repartition(6)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest, buckets=500, range_rows=range_rows)
    assert got.columns == ["doc_id", "c0", "n_features", "weight", "score", "rank"]
    found = [((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in got.collect()]
    assert sorted(found, key=str) == brute(rows, target, percent, longest, 500)


def test_shared_fixture_and_empty_tables(docs, rows, none, spark):
    target = spark.createDataFrame([("the tioner ing",)], "text string")
    pairs = [r[:2] for r in rows]
    found = [((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in resample(docs, target, percent=50).collect()]
    assert sorted(found, key=str) == brute(pairs, ["the tioner ing"], 50)
    assert resample(none, target).count() == 0
    found = [((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in resample(docs, none.select("text")).collect()]
    assert sorted(found, key=str) == brute(pairs, [])
    with pytest.raises(ValueError, match="whole numbers"):
        resample(docs, target, id_col="source")


def test_draw_in_ranges_and_runs(spark):
    r = random.Random(4)
    rows = [(r.choice([-5, -5, -5, r.randrange(50)]), r.randrange(3), i) for i in range(2000)]
    table = spark.createDataFrame(rows, "a long, b long, row long").repartition(7)
    for count in (0, 1, 999, 2000, 5000):
        got = sorted((x["rank"], (x["a"], x["b"], x["row"])) for x in drawn(table, count, range_rows=150, block_rows=16).collect())
        assert got == list(enumerate(sorted(rows)[:count], 1))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_tournament_merges_and_reads_no_further(k):
    r = random.Random(k)
    runs = [sorted((r.randrange(9), i, j) for j in range(r.randrange(6))) for i in range(k)]
    assert list(Tournament([iter(run) for run in runs])) == sorted(x for run in runs for x in run)
    if k > 2:
        runs = [[(i, 0, j) for j in range(5)] for i in range(k)]
        left = [iter(run) for run in runs]
        order = iter(Tournament(left))
        assert [next(order) for _ in range(5)] == runs[0]
        assert len(list(left[-1])) == 4  # but its head

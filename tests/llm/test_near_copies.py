"""The near_dedup stage against all pairs: no two of its texts have a five-word Jaccard similarity of 0.8."""

from itertools import combinations

import numpy as np
import xxhash

import corpus_pipeline
from sparkloom.llm import components, keyed, near_copies

from .conftest import prose


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_stay(rows):
    """doc_ids that stay: the smallest of each component of the pairs with similarity 0.8 or more."""
    sets, root = {i: plain(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        m = len(sets[a] & sets[b])
        if 5 * m >= 4 * (len(sets[a]) + len(sets[b]) - m):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in root}


def texts():
    rows = []
    for i in range(12):
        base = prose("en", 150, i).split()
        rows.append((10 * i, " ".join(base)))
        for j, edits in enumerate((1, 2, 3, 4, 6)):  # similarity from about 0.97 to below 0.8
            other = list(base)
            for e in range(edits):
                other[11 + 23 * e] = f"edit{j}x{e}"
            rows.append((10 * i + j + 1, " ".join(other)))
    group = prose("en", 120, 99).split()  # more of a group than a block holds
    rows += [(1000 + k, " ".join([*group[: k % 100], f"new{k}", *group[k % 100 + 1 :]])) for k in range(40)]
    return rows + [(2000, "few words"), (2001, "few  WORDS"), (2002, "other words")]


def test_stage_is_exact(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()}
    assert got == plain_stay(rows)


def test_no_near_copies_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_copies(spark, docs, "").select("doc_id", "text").collect()]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, once, "").collect()}
    assert got == plain_stay(rows)


def test_unrelated_texts_are_no_candidates(spark, monkeypatch):
    """They share a passage that the sample did not see: with 64 bits about one pair in twelve was linked, in all one group."""
    monkeypatch.setattr(near_copies, "_counts", lambda texts: np.zeros(near_copies.COUNTERS, np.int32))
    rows = [(i, f"{prose('en', 400, 500 + i)} {prose('de', 40, 3)}") for i in range(24)]
    assert near_copies._candidates(spark.createDataFrame(rows, "node long, text string")).count() == 0


def test_large_tables_joins(spark, monkeypatch):
    """No broadcasts, and components in rounds, as with more rows than a task or a broadcast may hold."""
    monkeypatch.setattr(components, "LOCAL_LINKS", 3)
    for module in (near_copies, keyed):
        monkeypatch.setattr(module, "small_side", lambda df, limit=0: df)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()}
    assert got == plain_stay(rows)


def test_more_rows_of_a_key_than_a_block(spark, monkeypatch):
    """As in large groups of near copies: a key's rows are compared block by block."""
    monkeypatch.setattr(near_copies, "KEY_BLOCK", 6)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()}
    assert got == plain_stay(rows)


def test_rows_that_joined_are_not_compared_again():
    rows, pairs = np.stack([np.arange(2000), np.arange(2000) % 3]), []

    def judge(x, y, key):
        pairs.append(np.broadcast(x[0], y[0]).size)
        return (x[1] == y[1]) & (x[0] != y[0])

    links = [(a, b) for parents, children in keyed._within(judge, rows, 1) for a, b in zip(parents, children, strict=True)]
    assert len(links) == 1997 and all(a % 3 == b % 3 for a, b in links)
    assert sum(pairs) < 2000**2 / 2


def test_links_come_through_the_chains(spark, monkeypatch):
    """With no budget nothing is linked, and the stage drops nothing but copies."""
    rows = [r for r in texts() if r[0] < 2000]
    docs = spark.createDataFrame([(xxh(t), t) for _, t in rows], "node long, text string")
    assert near_copies._candidates(docs).count() > 0
    monkeypatch.setattr(near_copies, "SHORT_DISTANCE", -1)
    assert near_copies._candidates(docs, -1).count() == 0
    own = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_copies.one_of_each_class(own, distance=-1).count() == len(rows)


def xxh(text):
    return xxhash.xxh64_intdigest(text) >> 1


def test_ring_of_pairs():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 64, (4000, 2), np.uint64)
    flips = np.packbits(r.random((4000, 128)) < r.choice([0.1, 0.3, 0.4, 0.5], (4000, 1)), axis=1).view(np.uint64)
    budget = r.choice([-1, 0, 30, 44, 64], 4000)

    def plain(a, b, most):
        bits = [(int(p) >> 8 * i & 255).bit_count() for p in a ^ b for i in range(8)]
        chains = lambda s, n: sum(bits[(s + j) % 16] for j in range(n))
        return any(all(chains(s, n) <= n * most // 16 for n in range(1, 17)) for s in range(16))

    want = [plain(a, b, int(m)) for a, b, m in zip(x, x ^ flips, budget, strict=True)]
    got = near_copies.in_ring(x, x ^ flips, budget)
    assert got.tolist() == want and 100 < sum(want) < 3900
    # the ring loses no pair within the budget
    assert got.tolist() == (np.bitwise_count(flips).sum(1) <= budget).tolist()


def test_without_fingerprints(spark):
    rows = texts()
    got = near_copies.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string"), distance=None)
    assert {r["doc_id"] for r in got.collect()} == plain_stay(rows)


def test_long_near_copies_are_compared_few_at_once(spark, monkeypatch):
    """Blocks by shingles: of a group of texts of 6,000 words a task holds no more than a few."""
    held = []
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 20_000)
    whole = near_copies._alike_in
    monkeypatch.setattr(near_copies, "_alike_in", lambda groups: held.append(groups.groupBy("root", "i", "j").count().agg({"count": "max"}).first()[0]) or whole(groups))
    base = prose("en", 6000, 31).split()
    rows = [(k, " ".join([*base[: 50 * k], f"new{k}", *base[50 * k + 1 :]])) for k in range(40)] + [(100, prose("de", 6000, 32))]
    got = near_copies.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {0, 100}
    assert held and max(held) <= 20


def test_two_texts_of_one_hash_stay(spark, monkeypatch):
    rows = texts()[:8]
    real = near_copies.F.xxhash64
    monkeypatch.setattr(near_copies.F, "xxhash64", lambda *c: near_copies.F.lit(7).cast("long") if len(c) == 1 else real(*c))
    got = near_copies.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == len(rows)

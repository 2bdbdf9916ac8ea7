"""The pipeline against a plain Python version, and its stages on odd rows."""

from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

from .test_mixing import water
from .test_near_copies import plain_stay

DIR = "/root/testdata/sf0.001"


def plain_pipeline(rows):
    """doc_id -> copies. All given texts have letters of known scripts, so language keeps them."""
    best = {}
    for r in rows:
        best[r[1]] = max(best.get(r[1], r), r)
    kept = sorted(best.values())
    stay = plain_stay([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if r[0] in stay]
    sizes = {r[0]: len(r[1].encode().split()) for r in kept}
    by = defaultdict(list)
    for r in kept:
        by[r[3]].append(r[0])
    total = {s: sum(sizes[i] for i in ids) for s, ids in by.items()}
    target = water(total, (5, 2, 1), 1.5, 2.0)
    copies = {}
    weight = {i: Fraction(1, 1 + sizes[i].bit_length() + (sizes[i] == 0)) for i in sizes}
    for s, ids in by.items():
        # the common factor of the expected copies, by bisection
        low, high = 0.0, 1000.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2.0, mid * float(weight[i])) * sizes[i] for i in ids) < target[s] - 1e-9 else (low, mid)
        expected = {i: min(2.0, high * float(weight[i])) for i in ids}
        certain = {i: int(expected[i] + 1e-9) for i in ids}
        rest, upto = target[s] - sum(certain[i] * sizes[i] for i in ids), 0

        def rank(i):
            u = (int(md5(f"{i}:mix-1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = min(1 - 1e-9, max(1e-12, expected[i] - certain[i]))
            return u / (1 - u) * (1 - p) / p

        for i in sorted(ids, key=rank):
            upto += sizes[i]
            copies[i] = certain[i] + (rest > 1e-6 and certain[i] < 2 and 2 * upto - sizes[i] <= 2 * rest)
    return copies


def test_against_plain_python(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    copies = {i: c for i, c in plain_pipeline(rows).items() if c}
    got = corpus_pipeline.run(spark, DIR).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == copies
    taken = Counter()
    for r in got:
        assert r["doc_tokens"] == sizes[r["doc_id"]]
        taken[r["doc_id"]] += r["length"]
    assert taken == {i: c * sizes[i] for i, c in copies.items()}
    filled = Counter()
    for r in got:
        filled[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, docs, stage):
    name, run = corpus_pipeline.STAGES[stage]
    names = ["_hash", "_key", "size", "copies", "keep_id", "misfit", "lang_pred", "_body", "c1"]
    own = docs.select("*", *(F.concat(F.lit(n), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in names))  # also kept, _text, score, id
    got = run(spark, own, DIR)
    if stage < 4:
        assert got.columns == own.columns
        for r in got.collect():
            assert (r["kept"], r["_text"], r["score"], r["id"]) == ("x", "y", "z", "w")
            assert all(r[n] == f"{n}{-1 if r['doc_id'] is None else r['doc_id']}" for n in names)
    ids = [r["doc_id"] for r in got.collect()]
    if name == "language":
        assert not {201, 202, 203, 204} & set(ids) and ids.count(5) == 2 and None in ids
    elif name == "exact_dedup":
        assert ids.count(5) == 1 and ids.count(124) == 1 and 0 not in ids
    elif name == "near_dedup":
        assert 0 in ids and not set(range(100, 125)) & set(ids)
    elif name == "packing":
        assert set(ids) == {r["doc_id"] for r in own.collect()}
    assert run(spark, own.limit(0), DIR).count() == 0

from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm.line_dedup import Shard, line_dedup
from sparkloom.llm.perfect_hash import PerfectHash

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs=3, least_chars=20):
    """(doc_id, text) to (doc_id, kept text, lines, dropped), row by row."""
    key = lambda line: line.strip(SPACES).translate(LOWER)
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append(i)
    largest = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [line for line in lines if key(line) not in largest or largest[key(line)] == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lined():
    hot, warm = "All rights reserved by the authors.", "Über zwanzig Zeichen lang, Ärger"
    rows = [(i, "\n".join([f"line {i} of nobody else at all", hot if i % 2 else f"  {hot.upper()}\t", warm if i % 7 == 0 else "short", f"text of group {i // 3} and so on"])) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, hot), (None, "only mine, without any number"), (None, "only mine, without any number"), (None, "only mine, without any number")]
    rows += [(7, rows[7][1]), (1003, f"{hot}\n{hot}\r\n{hot}"), (1004, "é" * 19 + "\n" + "é" * 20), (1005, "é" * 20), (1006, "É" * 20 + "\n" + "é" * 20 + "\n" + "é" * 19)]
    rows += [(1007, "é" * 20 + " "), (-5, "x " * 60_000 + "\n" + hot)]
    return rows


@pytest.mark.parametrize(("shard_lines", "part_probes"), [(1 << 18, 1 << 20), (40, 25)])
def test_against_brute_force(spark, lined, shard_lines, part_probes):
    """In one shard, and in many of which the hot line's has many copies."""
    docs = spark.createDataFrame([(t, i, "x", "y") for i, t in lined], "text string, doc_id long, id string, n_lines string").repartition(5)
    got = line_dedup(docs, shard_lines=shard_lines, part_probes=part_probes)
    assert got.columns == ["text", "doc_id", "id", "n_lines", "n_dropped"]
    found = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert sorted(found, key=str) == brute(lined)
    assert sum(n for *_, n in found) > 250


def test_shared_fixture_and_thresholds(docs, rows):
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(docs, least_docs=2, least_chars=5).collect()]
    assert sorted(got, key=str) == brute([r[:2] for r in rows], 2, 5)


def test_no_rows_and_wrong_identifiers(none, docs):
    assert line_dedup(none).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        line_dedup(docs, id_col="source")


def test_perfect_hash():
    r = np.random.default_rng(3)
    high, low = r.integers(0, 1 << 64, (2, 50_000), np.uint64)
    high[:100], low[100:200] = 5, 6  # equal halves
    own = PerfectHash.of(high, low)
    assert np.array_equal(np.sort(own.slots(high, low)), np.arange(len(high)))
    assert len(own.words) * 64 < 4 * len(high)
    assert len(PerfectHash.of(high[:0], low[:0]).slots(high, low)) == len(high)
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.of(high[[0, 0]], low[[0, 0]])


def test_shard_knows_its_lines_and_no_others():
    r = np.random.default_rng(4)
    high, low = r.integers(0, 1 << 64, (2, 4000), np.uint64)
    count, owner = r.integers(1, 9, 2000), r.integers(-50, 50, 2000)
    shard = Shard.from_bytes(Shard.of(high[:2000], low[:2000], count, owner, 3).to_bytes())
    asked = r.integers(-50, 50, 4000)
    want = np.r_[(count >= 3) & (owner != asked[:2000]), np.zeros(2000, bool)]
    assert np.array_equal(shard.dropped(high, low, asked), want)

import random
import re
from itertools import combinations

import pytest
import xxhash

from sparkloom.llm.components import components
from sparkloom.llm.simhash import fingerprint, links, near_classes, one_of_each_class


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps, distance):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= distance:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def test_fingerprints(rows):
    for text in {r[1] for r in rows if r[1] is None or len(r[1]) < 5000}:
        assert fingerprint(text) == slow_fingerprint(text)
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_classes(docs, rows):
    fps = {r[1]: slow_fingerprint(r[1]) for r in rows if r[1] is None or len(r[1]) < 5000}
    got = {(r["doc_id"], r["source"], r["fp"]): r for r in near_classes(docs).collect()}
    own = classes({r["fp"] % (1 << 64) for r in got.values()}, 4)
    assert set(fps.values()) <= set(own)
    least = {}
    for (doc_id, _, fp), _r in got.items():
        if doc_id is not None:
            c = own[fp % (1 << 64)]
            least[c] = min(doc_id, least.get(c, doc_id))
    for (_, _, fp), r in got.items():
        assert r["component_id"] == least.get(own[fp % (1 << 64)])


@pytest.mark.parametrize(("distance", "block"), [(4, 4096), (4, 8), (2, 4096), (7, 16)])
def test_links_keep_every_connection(spark, distance, block):
    r = random.Random(distance * block)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = {c for c in centres} | {0}
    for c in centres:
        for _ in range(60):
            for bit in r.sample(range(64), r.randint(1, distance)):
                c ^= 1 << bit
            fps.add(c)
    # a dense ball: many fingerprints share a key
    fps |= {centres[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in links(nodes, distance, block).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in got)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in got:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in fps} == classes(fps, distance)


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    r = random.Random(5)
    links_ = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    root = {x: x for pair in links_ for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links_:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links_ if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links_, "a long, b long"), local=local).collect()
    assert len(got) == len(linked) and {r["node"]: r["root"] for r in got} == {x: find(x) for x in linked}


def test_one_of_each_class(docs):
    kept = one_of_each_class(docs).collect()
    assert sum(r["text"] is None or not r["text"].split() for r in kept) == 1
    assert not {r["doc_id"] for r in kept} & set(range(101, 125))


def test_no_rows(none):
    assert near_classes(none).count() == 0 and one_of_each_class(none).count() == 0

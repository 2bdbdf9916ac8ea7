import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm.divergence import SEPARATORS, audit, counted, possible_cells
from sparkloom.llm.terms import in_slices, splitter, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    rows = [(la or "", so or "", terms_of(t)) for la, so, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = {s: Counter(t for r in own if r[1] == s for t in r[2] if df[t] >= least) for s in {r[1] for r in own}}
        whole = sum(count.values(), Counter())
        height = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(-sum(far(height(c, t), height(o, t)) for t in kept), b) for b, o in count.items() if b != s]
            marks = [(-far(height(c, t), height(whole, t)), t) for t in kept if c[t] and height(c, t) > height(whole, t)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(marks, key=lambda m: (m[0], m[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    r = random.Random(9)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Été", "ÉTÉ", "日本", "x😀"]
    made = []
    for i in range(400):
        lang, source = r.choice(["en", "de", None]), r.choice(["a", "b", "B", "é", None])
        at = r.randrange(40)
        made.append((lang, source, r.choice([" ", ", ", "1"]).join(r.choices(vocabulary[at:], k=r.randint(0, 25)))))
    made += [("en", "quiet", None), ("en", "quiet", ""), ("fr", "x", "only one text"), ("fr", "y", None), ("it", "alone", "word")]
    return made + [("de", "b", "wort " * 30_000)] + made[:20]


def collected(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("least", "width"), [(10, None), (10, 64), (3, 1 << 14)])
def test_against_brute_force(spark, sourced, least, width):
    """Also with a sketch so small that it discards nothing."""
    docs = spark.createDataFrame([(*row, "x", 1) for row in sourced], "lang string, source string, text string, term string, n long").repartition(5)
    got = collected(audit(docs, least_docs=least, top=4, width=width))
    assert got == brute(sourced, least, 4)
    assert any(r[2] == "term" for r in got) and any(r[4] > 0 for r in got)


def test_shared_fixture_and_no_rows(docs, rows, none):
    assert collected(audit(docs, least_docs=2)) == brute([(r[2], r[3], r[1]) for r in rows], 2)
    assert collected(audit(none)) == []


def test_sketch_keeps_all_frequent_terms_and_discards_others(spark, sourced):
    docs = spark.createDataFrame([(la or "", so or "", t or "") for la, so, t in sourced], "lang string, source string, text string").repartition(7)
    df = Counter(t for la, _, text in sourced for t in {(la or "", t) for t in terms_of(text)})
    found = {(r["lang"], r["term"]) for r in counted(docs, 10, 1 << 14).select("lang", "term").distinct().collect()}
    frequent = {t for t, n in df.items() if n >= 10}
    assert frequent <= found and len(found) < len(df)
    bits = possible_cells(docs, 10, 1 << 14)
    assert 0 < np.unpackbits(bits).sum() <= 4 * len(frequent)


def test_words_of_slices():
    r = random.Random(1)
    letters = [chr(i) for i in range(300)] + ["日", "😀"]
    texts = [None if i % 50 == 7 else "".join(r.choices(letters, k=r.randint(0, 40))) for i in range(2000)]
    got, each = words(pa.array(["before", *texts]).slice(1), splitter(SEPARATORS))
    want = [terms_of(t) for t in texts]
    assert got.to_pylist() == [t for own in want for t in own] and each.tolist() == [len(own) for own in want]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "i"])
    parts = list(in_slices(iter([batch]), 0, 100))
    assert len(parts) > 100 and [i for p in parts for i in p.column(1).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= 100 for p in parts)

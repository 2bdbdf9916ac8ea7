"""Language, toxicity and quality: fits, edge cases, accuracy on rows that were held out."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language, quality, toxicity
from sparkloom.llm.common import held_out

from .conftest import prose


def test_viterbi_against_brute_force():
    random_ = np.random.default_rng(3)
    lengths = np.array([5, 0, 1, 7, 3])
    emission = random_.standard_normal((lengths.sum(), 3)).astype(np.float32)
    got, at = language.viterbi(emission, lengths, 1.0), 0
    for n in lengths:
        own = emission[at : at + n]

        def total(path, own=own):
            return sum(own[i, p] for i, p in enumerate(path)) - sum(a != b for a, b in zip(path, path[1:], strict=False))

        paths = [[]]
        for _ in range(n):
            paths = [[*p, x] for p in paths for x in range(3)]
        assert total(list(got[at : at + n])) == pytest.approx(max(map(total, paths)))
        at += n


def test_language(docs, rows):
    model = language.fit(docs.filter(~held_out()), "doc_id", "text", "lang")
    assert model.languages == ["de", "en"]
    got = language.identify(docs, model, spans=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["kept"] == "x" and r["_text"] == "y"
        if r["doc_id"] in (201, 202, 203, 204):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and r["doc_id"] < 40 and r["lang"]:
            assert r["lang_pred"] == r["lang"]
        assert sum(s["words"] for s in r["spans"]) >= len((r["text"] or "").split())


def test_mixed_text_has_spans(spark, docs):
    model = language.fit(docs, "doc_id", "text", "lang")
    text = " ".join([prose("en", 40, 901), prose("de", 30, 902)])
    got = language.identify(spark.createDataFrame([(text,)], "text string"), model, spans=True).first()
    assert [s["lang"] for s in got["spans"]] == ["en", "de"] and abs(got["spans"][0]["words"] - 40) <= 2


def test_language_without_labels(none, docs):
    assert language.fit(none, "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(none, None).count() == 0


@pytest.fixture(scope="module")
def marked(spark):
    """Documents of which a third use one of a few words, and a third are of bad quality."""
    r, out = random.Random(9), []
    for i in range(600):
        words = prose("en", 60, 5000 + i).split()
        if i % 3 == 0:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["vilefolk", "scumbag", "rottenhead"])
        text = " ".join(words) if i % 5 else " ".join(f"{w}$$$" for w in words).upper()
        out.append((i, text, int(i % 3 == 0), int(i % 5 > 0)))
    df = spark.createDataFrame(out, "doc_id long, text string, toxic int, quality int")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "word " * 30000), (None, "text")], "doc_id long, text string")
    return df.select("doc_id", "text").unionByName(extra).repartition(4), df.select("doc_id", "toxic", "quality").unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 7, 7)], "doc_id long, toxic int, quality int"))


def test_toxicity(marked):
    docs, labels = marked
    model = toxicity.fit(docs, labels.filter(~held_out()))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 604 and all(0 <= s <= 1 for s in got.values())
    held = [r["doc_id"] for r in labels.filter(held_out() & F.col("toxic").isin(0, 1)).collect() if r["doc_id"] % 5]
    right = sum((got[i] >= 0.5) == (i % 3 == 0) for i in held)
    assert right >= 0.9 * len(held)


def test_toxicity_does_not_depend_on_partitions(spark, marked):
    docs, labels = marked
    got = []
    for n, parts in ((1, 2), (7, 5)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            model = toxicity.fit(docs.repartition(n), labels.repartition(n), most=150)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        got.append({r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()})
    assert got[0] == got[1]


def test_trained_dictionary_holds_what_is_frequent():
    r = random.Random(4)
    words = [f" {r.choice(['vilefolk', 'scumbag', 'rottenhead'])}{prose('en', 1, i)[:3]} ".encode() for i in range(3000)]
    made = toxicity.trained(words, 4096)
    assert all(w.encode() in made for w in ("vilefolk", "scumbag", "rottenhead")) and len(made) <= 4096
    assert toxicity.trained([], 4096) == b"" and toxicity.trained([b"few"], 4096) == b"few"


def test_compression_saves_what_the_dictionary_adds():
    distance = toxicity.Distance(b" ordinary words of a text " * 20, b" vilefolk scumbag rottenhead ")
    got = distance([b" ordinary words vilefolk of a text ", b" ordinary words of a text "])
    assert got[0] >= 4 > got[1]


def test_quality(marked):
    docs, labels = marked
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels.filter(~held_out())).collect()}
    assert len(got) == 604 and all(0 <= s <= 1 for s in got.values())
    held = [r["doc_id"] for r in labels.filter(held_out() & F.col("quality").isin(0, 1)).collect()]
    assert sum((got[i] >= 0.3) == (i % 5 > 0) for i in held) >= 0.98 * len(held)


def test_summed_equations_give_the_ridge_solution(spark):
    """Against one solve of the ridge problem over all rows."""
    random_ = np.random.default_rng(8)
    x = random_.standard_normal((700, len(quality.NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * random_.standard_normal(700) > 0.4).astype(float)
    rows = spark.createDataFrame([(v.tolist(), float(t), i % 2) for i, (v, t) in enumerate(zip(x, y, strict=True))], "_x array<double>, label double, fold int")
    model = quality.fit(rows.repartition(5))
    z = model.map(x)
    ridge = quality.RIDGE * np.diag(np.r_[np.ones(quality.WIDTH), 0]) / quality.WIDTH
    assert model.raw(x) == pytest.approx(z @ np.linalg.solve(z.T @ z / 700 + ridge, z.T @ y / 700), abs=1e-5)
    kernel = lambda a, b: np.exp(-quality.GAMMA * (((a - b) / model.scale) ** 2).sum())
    near = [(i, j) for i in range(0, 60, 2) for j in range(1, 60, 2)]
    assert np.mean([abs(z[i, :-1] @ z[j, :-1] - kernel(x[i], x[j])) for i, j in near]) < 0.06
    assert (np.diff(model.rate) >= 0).all() and 0 <= model.rate.min() <= model.rate.max() <= 1


def test_marks_are_not_letters(docs, spark):
    model = language.fit(docs, "doc_id", "text", "lang")
    got = language.identify(spark.createDataFrame([("\u0301\u0302 \u0300",), ("e\u0301the",)], "text string"), model).collect()
    assert (got[0]["lang_pred"], got[0]["score"]) == ("und", 0.0) and got[1]["lang_pred"] != "und"


def test_isotonic():
    got = quality.isotonic(np.array([0, 3, 1, 4.0]), np.array([2, 4, 4, 4.0]))
    assert got.tolist() == [0, 0.5, 0.5, 1]


def test_one_class_and_no_rows(docs, none, marked):
    labels = marked[1].filter("toxic = 1")
    assert toxicity.fit(docs, labels) == 1.0
    assert toxicity.fit(none, marked[1].limit(0)) == 0.0
    assert toxicity.score(none, 0.0).count() == 0
    assert quality.classify(none, labels.limit(0)).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.0}


def test_windows_cover_whole_texts():
    assert toxicity.windows("") == []
    assert b"".join(toxicity.windows("A b " * 20)).split() == [b"a", b"b"] * 20
    words, at, lengths = language._distinct(pa.array(["a b a", ""]))
    assert lengths.tolist()[0] == 3 and [words[i] for i in at[:3]] == ["a", "b", "a"]

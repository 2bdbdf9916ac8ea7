import pytest
from pyspark.sql import functions as F

from sparkloom.operators import language


@pytest.mark.parametrize(("tag", "want"), [("en", "en"), ("eng", "en"), ("en-US", "en"), ("EN_us", "en"), (" English ", "en"), ("deu", "de"), ("ger", "de"), ("zho-Hans", "zh"), ("xx", "xx"), ("", "und"), (None, "und"), ("klingonese", "und"), ("und", "und"), ("12", "und")])
def test_tags(spark, tag, want):
    assert spark.createDataFrame([(tag,)], "t string").select(language.canonical(F.col("t"))).first()[0] == want


def test_every_spelling_leads_to_two_letters():
    own = language.tags()
    assert len(own) > 120 and all(len(code) == 2 and own[code] == code for code in own.values())


TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and the other animals of the forest that were sleeping there",
    "de": "der schnelle braune fuchs springt über den faulen hund und die anderen tiere des waldes die dort schliefen",
    "fr": "le renard brun et rapide saute par dessus le chien paresseux et les autres animaux de la forêt qui dormaient",
}


@pytest.fixture(scope="module")
def known(spark):
    return language.profiles(spark.createDataFrame([*TEXTS.items(), (None, "the nothing")], "lang string, text string")).persist()


def plain(text, most=300):
    from collections import Counter
    import re

    count = Counter(p[i : i + k] for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for p in [f"_{w}_"] for k in (1, 2, 3) for i in range(len(p) - k + 1))
    del count["_"]
    return {g: r for r, (g, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most], 1)}


def test_detection(spark, known):
    rows = [(1, "animals of the other forest"), (2, "die Tiere des schnellen Waldes"), (3, "les animaux dormaient"), (4, "a"), (5, None), (6, "これは日本語"), (7, "只有汉字"), (8, "한국어"), (9, "123 !?")]
    got = {r["doc_id"]: (r["language"], r["confidence"]) for r in language.detected(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["en", "de", "fr", "und", "und", "ja", "zh", "ko", "und"] and got[4][1] == 0
    profile, of = {lang: plain(t) for lang, t in TEXTS.items()}, plain(rows[0][1])
    near = {lang: sum(300 - min(300, abs(r - p[g])) for g, r in of.items() if g in p) for lang, p in profile.items()}
    assert got[1][1] == pytest.approx(near["en"] / (300 * len(of))) and near["en"] == max(near.values())


ODD = ["", "a", "aa", "a b", "ab ba ab", "ß straße", "漢字 かな 漢字漢字", "𐐨𐐩 x𐐨", "žluťoučký kůň ů", "é e\u0301 é", "λόγος λόγοσ", "la la la le " * 40, " ".join(chr(97 + i % 26) * (i % 7 + 1) for i in range(300))]


def test_ranked_grams_are_those_of_a_plain_count(spark):
    for most in (5, 300, 10_000):
        for text in ODD:
            letters = spark.createDataFrame([(text,)], "text string").select(language._letters("text")).first()[0]
            grams = [language._gram(x) for x in language.ranked(letters, most).tolist()]
            assert grams == list(plain(letters, most)) and [language._number(g) for g in grams] == language.ranked(letters, most).tolist()


def test_texts_meet_profiles_in_their_rows(spark, known, monkeypatch):
    """N-grams are not rows of a join, and profiles too many to be broadcast give the same."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS.values(), *ODD, None, "animals", "12 die", "les, der THE"])], "doc_id long, text string")
    found = language.detected(docs, known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan
    want = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(language, "FEW", 1)
    joined = language.detected(docs, known)
    assert "Generate" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in joined.collect()) == want and len(want) == docs.count()
    assert [r[1] for r in want[:3]] == list(TEXTS)


def test_profiles_are_summed_over_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "COUNTS_AT_ONCE", 10)
    rows = [(lang, part) for lang, text in TEXTS.items() for part in (text[:50], text[50:], "")] + [("xx", None), (None, "nothing")]
    got = {(r["lang"], r["gram"]): r["rank"] for r in language.profiles(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want = {(lang, g): r for lang, text in TEXTS.items() for g, r in plain(f"{text[:50]} {text[50:]}").items()}
    assert got == want


def test_questions_are_made_ready(spark, known):
    rows = [(1, "the animals of the forest were sleeping", "de-DE"), (2, "die tiere des waldes schliefen dort", "de"), (3, None, "de"), (4, "the other animals of the forest", "fr"), (5, "the other animals of the forest", None)]
    asked = spark.createDataFrame(rows, "query_id long, question string, want string")
    texts = spark.createDataFrame([(1, "DE", "Die Tiere schliefen"), (2, "de", "anders"), (3, "de", "neu"), (4, "fr", "  ")], "query_id long, target string, text string")
    own = language.prepared(asked.withColumnRenamed("want", "wanted"), known, F.lit("de"), texts)
    got = {r["query_id"]: r for r in own.collect()}
    assert (got[1]["language"], got[1]["text"], got[1]["translated"], got[1]["text_language"], got[1]["target"]) == ("en", "Die Tiere schliefen", True, "de", "de")
    assert (got[2]["language"], got[2]["text"], got[2]["translated"], got[2]["text_language"]) == ("de", rows[1][1], False, "de")
    assert (got[3]["language"], got[3]["original"], got[3]["text"], got[3]["translated"]) == ("und", "", "", False)
    assert not got[4]["translated"] and not got[5]["translated"]
    alone = {r["query_id"]: r for r in language.prepared(asked, known).collect()}
    assert all(not r["translated"] and r["target"] is None and r["text"] == r["original"] for r in alone.values())

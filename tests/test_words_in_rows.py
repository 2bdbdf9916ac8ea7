"""Words are counted and stemmed in their rows: no work grows with the square of a text, no token is dealt out."""

import random
from collections import Counter

import duckdb

from sparkloom.functions import stemming
from sparkloom.operators import tokens


def test_long_text_is_counted_in_its_row(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdeß", k=r.randint(1, 3))) for _ in range(20_000)]
    rows = [(" ".join(words), "xx"), (None, "xx"), ("US IT Café", "en"), ("US IT IT THE EU UN", "en"), ("the runs", "en"), ("", None), ("abc", None)]
    got = tokens.counted(spark.createDataFrame(rows, "text string, lang string"))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # an explode takes the whole text along with every word
    want = Counter(("xx", w.replace("ß", "ss")) for w in words)
    want.update([("en", "us"), ("en", "it"), ("en", "café"), ("en", "eu"), ("en", "un"), ("en", "runs"), ("und", "abc")])
    assert {(x["lang"], x["term"]): x["n"] for x in got.collect()} == want


def test_tokens_are_stemmed_in_their_row(spark):
    rows = [(1, "en", ["running", "runs", None]), (2, "de", ["häusern"]), (3, None, ["running"]), (4, "fr", []), (5, "en", None), (6, "xx", ["running"])]
    got = tokens.with_stems(spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {x["doc_id"]: x["stems"] for x in got.collect()} == {1: ["run", "run", None], 2: ["haus"], 3: ["running"], 4: [], 5: [], 6: ["running"]}


def test_rules_in_python_and_sql():
    r = random.Random(7)
    letters = {"en": "abceginorstuyl", "de": "abeghinrstuäüß", "es": "abdegimnorsuáéí", "fr": "aeilmnqrstuyéèë"}
    rows = sorted({(lang, "".join(r.choices(own, k=r.randint(1, 11)))) for lang, own in letters.items() for _ in range(3000)})
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (lang VARCHAR, term VARCHAR)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert [x for x in connection.sql(stemming.as_sql("t")).fetchall() if stemming.stemmer(x[0])(x[1]) != x[2]] == []

import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import stemming, words
from sparkloom.operators import routing, segmentation, tokens

#: Words and their stems as published with the Snowball stemmers, by language.
GOLDEN = {
    "en": """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistent consist consistently
        consist consolation consol consolations consol consolatory consolatori console consol consoled consol consolidate consolid consolingly consol consols
        consol consonant conson consort consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspire conspir constable
        constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knavish knavish kneaded knead knee knee kneel kneel
        knees knee knell knell knife knife knightly knight knit knit knits knit knitted knit knitting knit knives knive knob knob knockers knocker knots knot
        translate translat medicines medicin editing edit actually actual lessons lesson bacteria bacteria generously generous communication communic hopping
        hop hoping hope dying die skies sky happy happi say say by by cries cri ties tie gas gas this this feed feed agreed agre luxuriated luxuri falling fall
        running run relational relat conditional condit rationalization ration electricity electr adjustment adjust adoption adopt probate probat rate rate
        controll control roll roll yellow yellow enjoying enjoy proceed proceed news news""",
    "de": """aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufenthalt aufenthalt aufgabe aufgab aufgaben aufgab aufgeben aufgeb auffassung auffass
        aufgeführt aufgefuhrt kategorie kategori kategorien kategori kategorisch kategor kategorischen kategor kater kat katers kat katze katz katzen katz
        kätzchen katzch kauerte kauert kaufen kauf käufer kauf käufern kauf kaufleute kaufleut kaum kaum kavalleriesäbeln kavalleriesabeln kehle kehl kehren
        kehr kehrte kehrt möglichkeit moglich freundlich freundlich häuser haus straße strass erkenntnisse erkenntnis""",
    "es": """chicos chic chicas chic cheque chequ chequeo cheque chicago chicag chico chic chihuahua chihuahu chile chil chilena chilen chilenas chilen chimenea
        chimene chino chin torear tor toreado tor toreo tore tormenta torment tormentas torment tornado torn tornados torn torneo torne toro tor toronto toront
        torre torr torrente torrent torres torr torturado tortur torturas tortur nacional nacional nacionalidad nacional rápidamente rapid""",
    "fr": """continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel
        continuelle continuel continuellement continuel continuer continu continuera continu continuerait continu continueront continu continuité continu
        contorsions contors contour contour contournait contourn contournant contourn contours contour majestueuse majestu majestueusement majestu majestueux
        majestu majesté majest majeur majeur majeure majeur majorats majorat majordome majordom majorité major mal mal malacca malacc malade malad malades malad
        maladie malad maladive malad grandes grand nationalité national chevaux cheval""",
}


def golden():
    for lang, listed in GOLDEN.items():
        own = listed.split()
        yield from ((lang, w, s) for w, s in zip(own[::2], own[1::2], strict=True))


def test_golden_stems(spark):
    rows = [*golden(), ("xx", "running", "running"), (None, "running", "running"), ("en", None, None), ("en", "", ""), ("de", "", ""), ("es", "", ""), ("fr", "", ""), ("en", "y", "y"), ("en", "細菌", "細菌")]
    df = spark.createDataFrame(rows, "lang string, term string, word string")
    got = {(r["lang"], r["term"]): r["stem"] for r in stemming.stem_table(df).collect()}
    assert [(row, got[row[:2]]) for row in rows if got[row[:2]] != row[2]] == []


def test_stems_in_two_engines(spark):
    """On made-up words with all kinds of endings."""
    r = random.Random(6)
    letters = {"en": "abceginortsuy", "de": "abeghinrstuäüß", "es": "abdeimnorsuáéí", "fr": "aeilmnqrstuyéè"}
    ends = {"en": ["ingly", "ational", "fulness", "ement", "ion", "yed", "ies"], "de": ["keit", "lichkeit", "igung", "isch", "nisse", "est"], "es": ["ándole", "amente", "ivamente", "aciones", "guéis", "uyendo"], "fr": ["issement", "ativement", "ières", "euses", "icités", "aient"]}
    rows = [(lang, "".join(r.choices(own, k=r.randint(1, 7))) + r.choice(["", *ends[lang]])) for lang, own in letters.items() for _ in range(400)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (lang VARCHAR, term VARCHAR)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = sorted(connection.sql(stemming.as_sql("t")).fetchall())
    assert sorted(tuple(x) for x in stemming.stem_table(spark.createDataFrame(rows, "lang string, term string")).collect()) == want


def test_settled_characters_stay():
    """No character that skips the normal form is changed by it, alone or next to another one."""
    import re

    pattern = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), words.SETTLED))
    settled = [c for c in map(chr, range(0x10000)) if pattern.fullmatch(c)]
    assert len(settled) > 20_000
    r = random.Random(1)
    text = "".join(r.choices(settled, k=50_000)) + "".join(settled)
    assert unicodedata.normalize("NFKC", text) == text


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [
        ("What lessons from bacteria and yeast actually translate into safer gene-editing medicines?", "en", "lessons bacteria yeast actually translate safer gene editing medicines"),
        ("US sanctions on Iran", "en-US", "us sanctions iran"),
        ("The EU and the UN disagree; it is for us", "en", "eu un disagree"),
        ("US SANCTIONS HIT IT SECTOR", "en", "sanctions hit sector"),
        ("US IT", "en", "us it"),
        ("A2 or I", "en", "a2"),
        ("Ｇene ﬁnd ½ ㎏ cafe\u0301", "en", "gene find 1 2 kg café"),
        ("Die Straße für den Fußgänger", "de", "strasse fussgänger"),
        ("细菌和CRISPR酵母", None, "细菌 菌和 crispr 酵母"),
        ("コンピュータにどのように", None, "コンピュータ にど どの のよ うに"),
        ("細菌と酵母", "ja", "細菌 酵母"),
        ("какие уроки из бактерий", "ru", "уроки бактерий"),
        ("the of and", None, "the of and"),
        ("snake_case don't", "en", "snake case"),
        (" \u3000 ", "en", ""),
        (None, "en", ""),
    ],
)
def test_tokens(spark, text, lang, want):
    (row,) = tokens.tokenized(spark.createDataFrame([(1, text, lang)], "doc_id long, text string, lang string")).collect()
    assert " ".join(row["tokens"]) == want


def test_stems_stand_beside_tokens(spark):
    rows = [(1, "Running runs, runs running!", "en"), (2, "Häuser und Häusern", "de"), (3, None, "en"), (4, "unstemmed words", None)]
    got = {r["doc_id"]: (r["lang"], r["tokens"], r["stems"]) for r in tokens.with_stems(tokens.tokenized(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    assert got == {1: ("en", ["running", "runs", "runs", "running"], ["run"] * 4), 2: ("de", ["häuser", "häusern"], ["haus"] * 2), 3: ("en", [], []), 4: ("und", ["unstemmed", "words"], ["unstemmed", "words"])}


def cjk_corpus():
    """Runs of words of one to three characters that come by Zipf's law, and where the words end."""
    r = random.Random(8)
    han = [chr(0x4E00 + 7 * i) for i in range(400)]
    listed = ["".join(r.sample(han, r.choice([1, 2, 2, 2, 3]))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(len(listed))]
    return [r.choices(listed, weights, k=r.randint(2, 12)) for _ in range(3000)]


def test_dictionary_finds_words(spark):
    corpus = cjk_corpus()
    runs = segmentation.distinct_runs(spark.createDataFrame([("".join(c),) for c in corpus] + [(None,), ("",)], "run string"))
    dictionary = segmentation.learned(runs)
    got = {r["run"]: r["pieces"] for r in segmentation.cut(runs, dictionary).collect()}
    assert set(got) == {"".join(c) for c in corpus} and all("".join(p) == run for run, p in got.items())

    def places(parts):
        at, out = 0, set()
        for p in parts:
            out.add((at, at + len(p)))
            at += len(p)
        return out

    hit = sum(len(places(c) & places(got["".join(c)])) for c in corpus)
    precision, recall = hit / sum(len(got["".join(c)]) for c in corpus), hit / sum(map(len, corpus))
    assert precision > 0.85 and recall > 0.85
    # words of a text are cut by it, others are not touched
    docs = spark.createDataFrame([(1, f"CRISPR{''.join(corpus[0])} and more", "zh"), (2, "no runs", "en")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["tokens"] for r in tokens.tokenized(docs, dictionary=dictionary).collect()}
    assert found == {1: ["crispr", *got["".join(corpus[0])], "and", "more"], 2: ["runs"]}


def test_best_path_against_all_paths():
    r = random.Random(2)
    for _ in range(200):
        run = "".join(r.choices("abc", k=r.randint(1, 8)))
        costs = {run[i:j]: r.random() * (j - i) for i in range(len(run)) for j in range(i + 1, min(len(run), i + 3) + 1)}
        edges = [(i, run[i:j], costs[run[i:j]]) for i in range(len(run)) for j in range(i + 1, min(len(run), i + 3) + 1)]
        paths = lambda i: [[]] if i == len(run) else [[run[i:j], *rest] for j in range(i + 1, min(len(run), i + 3) + 1) for rest in paths(j)]  # noqa: E731, B023
        got = segmentation._best_path(run, *(list(c) for c in zip(*edges, strict=True)))
        assert abs(sum(costs[p] for p in got) - min(sum(costs[p] for p in path) for path in paths(0))) < 1e-9
    assert segmentation._best_path("xyz", [1], ["y"], [0.5]) == ["x", "y", "z"]


def test_bridge_reaches_terms_by_stems(spark):
    questions = spark.createDataFrame([(1, "Translated medicines, and the medicine"), (2, "it is"), (3, None)], "query_id long, question string")
    stems = tokens.question_stems(questions)
    assert [(r["query_id"], r["stem"]) for r in stems.orderBy("query_id", "pos").collect()] == [(1, "translat"), (1, "medicin")]
    terms = spark.createDataFrame([("translation",), ("translates",), ("medicine",), ("medical",), ("it",)], "term string")
    reached = tokens.bridged(stems, terms)
    assert sorted(tuple(r) for r in reached.collect()) == [(1, "medicine"), (1, "translates"), (1, "translation")]
    candidates = spark.createDataFrame([(1, t, 1.0 / (i + 1)) for i, t in enumerate(["translation", "gene", "drug", "trial", "dose", "cell"])], "query_id long, term string, score double")
    ubiquity = spark.createDataFrame([("gene", 9, True)], "term string, shards long, ubiquitous boolean")
    got = routing.expansions(candidates, reached, ubiquity, counted=stems.withColumnRenamed("stem", "term")).orderBy("rank")
    assert [r["term"] for r in got.collect()] == ["drug", "trial", "dose", "cell"]  # twice as many as stems at most
    assert routing.expansions(candidates, reached, ubiquity, ratio=1.0, counted=stems.withColumnRenamed("stem", "term")).agg(F.count("*")).first()[0] == 2

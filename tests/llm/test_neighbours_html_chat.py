import html as escaping
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import html_text, neighbours
from sparkloom.llm.chat import conversations, mask, own_negatives, preference_pairs, rendered
from sparkloom.llm.html_text import extract, main_text
from sparkloom.llm.neighbours import balanced_parts, neighbour_graph, search


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in best if np.isfinite(d[i])]
    return out


def test_exact_on_one_partition(spark):
    random_ = np.random.default_rng(1)
    x = random_.standard_normal((300, 8))
    x[50:120] = x[50]  # many equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [None] + [1.0] * 7, 0), (1003, [float("nan")] + [1.0] * 7, 0), (1004, [float("inf")] + [1.0] * 7, 0), (1005, [1.0], 0), (None, [1.0] * 8, 0)]
    got = search(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int"), F.col("vec_id") % 50 == 0, part_rows=300)
    own = brute(x, np.arange(300), range(0, 300, 50), 10)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(own)
    for q in own:
        assert [i for i, _ in found[q]] == [i for i, _ in own[q]] and [s for _, s in found[q]] == pytest.approx([s for _, s in own[q]], abs=1e-12)


@pytest.mark.parametrize(("n", "options"), [(4000, {}), (4000, {"part_rows": 60, "most_parts": 16}), (500, {})])
def test_recall_without_structure(spark, n, options):
    """64 dimensions, no clusters: one level of partitions, and two."""
    x = np.random.default_rng(6).standard_normal((n, 64))
    got = search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, **options)
    own, found = brute(x, np.arange(n), range(0, n, 20), 10), {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = sum(len(found[q] & {i for i, _ in own[q]}) for q in own) / (10 * len(own))
    assert all(len(f) == 10 for f in found.values()) and 0.9 <= recall


def test_blocks_and_copies_of_a_large_part(spark, monkeypatch):
    """Many blocks and copies give what one block does."""
    x = np.random.default_rng(7).standard_normal((600, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 8 * 8 * 50)
    monkeypatch.setattr(neighbours, "VISITS", 7)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search(rows, F.col("vec_id") % 20 == 0, part_rows=600).collect()}
    own = brute(x, np.arange(600), range(0, 600, 20), 10)
    assert got == {(q, i + 1): row for q in own for i, (row, _) in enumerate(own[q])}


def test_recall_on_partitions(spark):
    random_ = np.random.default_rng(2)
    x = random_.standard_normal((20, 16))[random_.integers(0, 20, 3000)] + 0.6 * random_.standard_normal((3000, 16))
    got = search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, part_rows=200)
    own = brute(x, np.arange(3000), range(0, 3000, 100), 10)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(f) == 10 for f in found.values()) and len(found) == 30
    assert sum(len(found[q] & {i for i, _ in own[q]}) for q in own) >= 0.9 * 300


def test_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.5]), (3, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search(few, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id").orderBy("query_id", "rank").collect()] == [(0, 1, 100), (0, 2, 3), (100, 1, 0), (100, 2, 3)]
    assert search(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(4).standard_normal((800, 6))
    sizes = np.bincount(balanced_parts(x, neighbour_graph(x, 8), 8), minlength=8)
    assert sizes.sum() == 800 and sizes.max() <= 1.15 * 100 + 1


def page(paragraphs, title):
    body = "".join(f"<p>{escaping.escape(p)}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='<p>no</p>'</script></head><body><header>Site</header><nav><ul><li><a href='/x'>Menu one</a></li></ul></nav><div class='cookie-notice'>We use cookies, and more of them.</div><article><h1>{title}</h1>{body}</article><aside>Other, things.</aside><form>Mail<input></form><section id='comments'><p>I think, that this is bad. Really bad.</p></section><footer>&copy; someone</footer></body></html>"


def test_article_comes_out():
    r = random.Random(5)
    for _ in range(30):
        paragraphs = [" ".join(r.choices(["the", "a & b", "word,", "end.", "<x>"], k=r.randint(1, 80))) for _ in range(r.randint(1, 8))]
        assert main_text(page(paragraphs, "A title")) == "\n".join(["A title", *paragraphs])


def test_plain_divisions():
    text = "<body><div id='menu'><a href=x>Home</a> <a>About</a></div><div class=content><h2>Title</h2>A first long paragraph, with words.<br>Another\n one; and <i>more</i>.<ul><li>one<li>two</ul></div><div>Copyright 2020</div></body>"
    assert main_text(text) == "Title\nA first long paragraph, with words.\nAnother one; and more.\none\ntwo"
    assert main_text("<p>a<p>b") == "a\nb" and main_text("x < y &lt;b&gt; &#233;") == "x < y <b> é"
    assert main_text(None) == main_text("") == main_text("<nav>menu</nav>") == main_text("<!-- open") == ""
    assert len(main_text("<p>" + "long text, " * 50_000 + "</p>")) == 549_999


LONG = "This is a long paragraph, with several words and marks. It goes on, and on. " * 3


@pytest.mark.parametrize(
    ("body", "lines"),
    [
        (f"<nav><a href=1>Home</a></nav><div class='elementor-widget-container'><p>{LONG}</p><p>{LONG}</p></div><footer>(c)</footer>", [LONG, LONG]),
        (f"<div class=c><p>{LONG}</p><p class='comment-on-law'>A shorter comment, on law.</p><p>{LONG}</p></div>", [LONG, "A shorter comment, on law.", LONG]),
        (f"<p>Let <math><mi>x</mi></math> be, {LONG}</p>", [f"Let x be, {LONG}"]),
        (f"<div class=post><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>Other, text.</p></div>", ["Title", LONG, LONG]),
        (f"<header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article><footer>f</footer>", ["Title", LONG]),
        (f"<form><div id=nav><a href=x>a</a></div><div id=c><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></form>", ["T", LONG, LONG]),
        (f"<div id=post><h1>T</h1><p>{LONG}</p></div><div id=comments><ol><li class=comment><article class=comment-body><p>{LONG}</p></article></li></ol></div>", ["T", LONG]),
        (f"<article><p>{LONG}</p><aside>Read, also.</aside><div class='related-posts'><p>Another post, too.</p></div><p>End.</p></article>", [LONG, "End."]),
    ],
)
def test_names_are_only_evidence(body, lines):
    assert main_text(f"<html><body>{body}</body></html>") == "\n".join(x.strip() for x in lines)


@pytest.mark.parametrize(
    ("inside", "lines"),
    [
        ("<p><a href=x>Read the full report of the committee, published today.</a></p>", ["Read the full report of the committee, published today."]),
        ("<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul>", ["Source one", "Source two"]),
        (f"<section id='social-policy'><p>{LONG}</p></section>", [LONG]),
        (f"<div class='share-price'><p>{LONG[:140]}</p></div>", [LONG[:140]]),
        (f"<p class='related'>{LONG}</p>", [LONG]),
        ("<xmp>a <b> &amp; c</xmp>", ["a <b> &amp; c"]),
        # and what the same names mean elsewhere
        ("<section id='social-links'><a href=1>One</a> <a href=2>Two</a></section>", []),
        ("<div class='share'><p>Tell others.</p></div>", []),
        ("<div class='related'><ul><li><a href=1>Another post, which is not this one.</a></li></ul></div>", []),
        (f"<div class='comments'><p>{LONG}</p></div><aside><p>{LONG}</p></aside><nav><a href=x>Home</a></nav>", []),
        (f"<div class='newsletter-signup'><p>{LONG[:60]}</p></div><div class='cookie-notice'>{LONG}</div>", []),
    ],
)
def test_article_keeps_its_text(inside, lines):
    page_html = f"<body><nav><a href=1>Home</a></nav><article><h1>T</h1><p>{LONG}</p>{inside}<p>{LONG}</p><p>End.</p></article><footer>f, g.</footer></body>"
    assert main_text(page_html) == "\n".join(x.strip() for x in ["T", LONG, *lines, LONG, "End."])


def test_ratios_are_needed(monkeypatch):
    """With one ratio for all paths names alone would decide, and prose of such a name would go or its links stay."""
    monkeypatch.setattr(html_text, "ratios", lambda own: ({b.path: 1.0 for b in own}, {b.path: 1.0 for b in own}))
    pages = [f"<article><p>{LONG}</p>{x}</article>" for x in ("<div class='share'><p>Tell others.</p></div>", f"<p class='related'>{LONG}</p>")]
    assert not (main_text(pages[0]) == LONG.strip() and main_text(pages[1]).count("\n"))


def test_ratios_decide_without_class_names(monkeypatch):
    """Without the list of class names the given pages keep their articles, and nothing else."""
    monkeypatch.setattr(html_text, "_NAMES", frozenset())
    for page_html in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", page_html[0], re.S)[1]
        wanted = [" ".join(escaping.unescape(re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|br|ul|li|div|blockquote)\b[^>]*>", article)]
        assert main_text(page_html[0]) == "\n".join(x for x in wanted if x)


def test_ratios_against_brute_force():
    page_html = f"<div><h1>One</h1><p>{LONG}</p><p>Two, three.</p></div><ul><li><a href=x>link text</a><li>four.</ul>"
    own = html_text.blocks(page_html)[0]
    of = {p: [b for b in own if b.path == p] for p in {b.path for b in own}}
    length = [sum(len(b.text) - b.links for b in of[x.path]) / len(of[x.path]) for x in own]
    marks = [sum(sum(c in ".,;:!?" for c in b.text) for b in of[x.path] if len(b.text) > b.links) / len(of[x.path]) for x in own]
    got, want = html_text.ratios(own)[0], {}
    for i, b in enumerate(own):
        x, y = (sum({0: 0.5, 1: 0.2, 2: 0.05}[abs(i - j)] * v[j] for j in range(len(own)) if abs(i - j) < 3) for v in (length, marks))
        want[b.path] = max(want.get(b.path, 0), (x * (1 + y) * length[i]) ** 0.5)
    assert dict(got) == pytest.approx(want)


def test_extract(spark):
    rows = [(1, "u", page(["One, two."], "T"), "x", 5), (1, "u", page(["One, two."], "T"), "x", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _html int")
    got = extract(df).orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["n_chars"], r["_html"]) for r in got] == [(None, "", 0, None), (1, "T\nOne, two.", 11, 5), (1, "T\nOne, two.", 11, 5)]
    assert extract(df.limit(0)).count() == 0


def turns(*own):
    return [{"role": r, "text": t} for r, t in own]


def test_preference_pairs(spark):
    a = turns(("system", "s"), ("user", "hé"), ("assistant", "one"), ("user", "u"), ("assistant", "yes"))
    cases = [(1, a, a[:3] + turns(("user", "u"), ("assistant", "no"))), (2, a, a), (3, a, a[:2]), (4, None, a), (5, [], []), (6, a, turns(("user", "other")))]
    kind = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt int"
    got = {r["id"]: r for r in preference_pairs(spark.createDataFrame([(*c, 7) for c in cases], kind)).collect()}
    text = lambda ts: "".join(f"<|{t['role']}|>\n{t['text']}<|end|>\n" for t in ts)
    for i, chosen, rejected in cases:
        chosen, rejected = chosen or [], rejected or []
        n = next((j for j, (x, y) in enumerate(zip(chosen, rejected, strict=False)) if x != y), min(len(chosen), len(rejected)))
        r = got[i]
        assert (r["prefix_turns"], r["prompt"], r["chosen_text"], r["rejected_text"]) == (n, text(chosen[:n]), text(chosen[n:]), text(rejected[n:]))
        learned = [r["chosen_text"][s["start"] : s["end"]] for s in r["chosen_mask"]]
        assert learned == [f"{t['text']}<|end|>\n" for t in chosen[n:] if t["role"] == "assistant"]


def test_conversations_and_negatives(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "t"), (2, 0, None, None), (3, 1, "assistant", "z"), (3, 0, "user", "y"), (3, 0, "user", "y"), (None, None, "assistant", "x")]
    rows += [(None, 1, "user", "v"), (None, 1, "user", "v")]
    convs = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert convs.filter("id IS NULL").select(F.size("turns").alias("n")).collect() == [(1,)] * 3
    kept = own_negatives(convs.withColumn("_last", F.lit("mine"))).select("_last").distinct().collect()
    assert kept == [("mine",)]
    convs = convs.filter("id IS NOT NULL OR turns[0].text = 'x'")
    got = {r["id"]: r for r in own_negatives(convs).collect()}
    last = lambda i: (got[i]["chosen"][-1]["text"], got[i]["rejected"][-1]["text"])
    assert (last(1), last(2), last(3), last(None)) == (("b", "a"), ("", ""), ("z", "y"), ("x", "x"))
    assert len(got[1]["chosen"]) == 4 and len(got[3]["chosen"]) == 3
    assert own_negatives(convs.limit(0)).count() == 0
    assert convs.select(rendered(F.col("turns")).alias("t"), mask(F.col("turns")).alias("m")).count() == 4

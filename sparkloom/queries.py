"""The engine's queries by name, and equivalent SQL for a check by another engine.

The tables stand in for a retrieval corpus: documents are documents, embeddings.label is the shard of the document with
that number, benchmark texts are questions, and a document is relevant to the questions that it contains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .functions.arrow import hash_embedding
from .functions.stemming import as_sql as stems_in_sql
from .functions.words import stopwords
from .operators import artifacts, bm25, features, ingest, intents, language, metrics, pagerank, ranking, reranking, routing, tokens
from .plans import agent, search
from .plans.config import Settings
from .steps import small, spread, step
from .streaming import ingestion

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


_index: dict = {}


def indexed(name: str, spark: SparkSession, d: str, build) -> DataFrame:
    """A table of the index: built once for an application and a corpus, and kept as memory allows."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _index or not _index[key].storageLevel.useMemory:  # not there, or dropped from the cache meanwhile
        _index[key] = build().persist()
    return _index[key]


def doc_words(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("words"))


def shards(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("shard_id"))


#: Rows (a document and its shard) up to which they are broadcast, so that the documents' words need not be dealt out.
SHARD_ROWS = 1_000_000


def shard_words(spark, d) -> DataFrame:
    return doc_words(spark, d).join(small(shards(spark, d), SHARD_ROWS), "doc_id")


def shard_tf(spark, d) -> DataFrame:
    return indexed("shard_tf", spark, d, lambda: bm25.term_counts(shard_words(spark, d), ["shard_id", "doc_id"]))


def shard_keywords(spark, d) -> DataFrame:
    return indexed("keywords", spark, d, lambda: step(features.keywords(bm25.term_counts(shard_words(spark, d), ["shard_id"]), 30)))


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), T.content_tokens(F.col("text")).alias("words"))


def question_terms(spark, d) -> DataFrame:
    return questions(spark, d).select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def qrels(spark, d) -> DataFrame:
    """Grade 2 for documents of good quality that contain the question, 1 for others that do."""
    found = search.containing(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")))
    return step(found).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("query_id", "doc_id", F.when(F.col("quality") == 1, 2).otherwise(1).alias("grade"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("shard_id"), F.col("embedding").alias("v"))


def dense_questions(spark, d) -> DataFrame:
    """Vectors of every document whose number is divisible by 20, as questions."""
    return vectors(spark, d).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))


# ---- SQL fragments
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
S_WORDS = f"dw AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: t NOT IN ({STOP})) AS words FROM documents)"
S_SHARD = "sw AS (SELECT d.doc_id, d.words, e.label AS shard_id FROM dw d JOIN embeddings e ON e.vec_id = d.doc_id)"
S_TF = "tf AS (SELECT shard_id, doc_id, term, count(*) AS tf FROM (SELECT shard_id, doc_id, unnest(words) AS term FROM sw) GROUP BY ALL)"
S_TF0 = "tf AS (SELECT 0 AS shard_id, doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM dw) GROUP BY ALL)"
S_Q = f"qw AS (SELECT item_id AS query_id, text AS question, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN ({STOP})) AS words FROM benchmark)"
S_QT = "qt AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest(words) AS term FROM qw) GROUP BY ALL)"
S_BM25 = """
dl AS (SELECT shard_id, doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
st AS (SELECT shard_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY shard_id),
raw AS (SELECT shard_id, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT shard_id, term, count(*) AS df FROM tf GROUP BY ALL) JOIN st USING (shard_id)),
fl AS (SELECT shard_id, 0.25 * avg(idf) AS floor FROM raw GROUP BY shard_id),
bm AS (SELECT query_id, shard_id, doc_id, sum(weight * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN raw USING (shard_id, term) JOIN fl USING (shard_id) JOIN dl USING (shard_id, doc_id) JOIN qt USING (term) GROUP BY ALL HAVING score > 0)"""
S_KW = """
cn AS (SELECT shard_id, term, sum(tf) AS n FROM tf GROUP BY ALL),
tt AS (SELECT shard_id, sum(n) AS total FROM cn GROUP BY ALL),
sp AS (SELECT term, count(*) AS sf FROM cn GROUP BY ALL),
kw0 AS (SELECT shard_id, term, n / total * (ln((1 + (SELECT count(*) FROM tt)) / (1 + sf)) + 1) AS weight FROM cn JOIN tt USING (shard_id) JOIN sp USING (term)),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY round(weight, 12) DESC, term) AS rank FROM kw0) WHERE rank <= 30)"""
S_QRELS = "qr AS (SELECT b.item_id AS query_id, d.doc_id, CASE WHEN l.quality = 1 THEN 2 ELSE 1 END AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id)"
S_VEC = "vec AS (SELECT vec_id AS doc_id, label AS shard_id, embedding::DOUBLE[] AS v FROM embeddings)"
S_DENSE = """dq AS (SELECT doc_id AS query_id, v FROM vec WHERE doc_id % 20 = 0),
sims AS (SELECT a.query_id, b.doc_id, b.shard_id, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS score FROM dq a JOIN vec b ON a.query_id <> b.doc_id)"""
S_CENT = """cv AS (SELECT shard_id, i, avg(x) AS x FROM (SELECT shard_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY ALL),
cl AS (SELECT shard_id, sqrt(sum(x * x)) AS l FROM cv GROUP BY shard_id),
cent AS (SELECT cv.shard_id, list(x / l ORDER BY i) AS v FROM cv JOIN cl USING (shard_id) GROUP BY cv.shard_id)"""
S_GRAPH = """
pos AS (SELECT shard_id, doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM sw),
win AS (SELECT shard_id, list_distinct(list_slice(words, i, i + 4)) AS w FROM pos),
prs AS (SELECT shard_id, a.t AS src, b.t AS dst FROM win, unnest(w) AS a(t), unnest(w) AS b(t) WHERE a.t <> b.t),
edg AS (SELECT shard_id, src, dst, count(*) AS cnt FROM prs GROUP BY ALL HAVING count(*) >= 2),
kep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_id, src ORDER BY cnt DESC, dst) AS r FROM edg) WHERE r <= 16),
srn AS (SELECT k.shard_id, k.src, sum(cnt) AS total FROM kep k GROUP BY ALL),
src AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.shard_id ORDER BY CASE WHEN kw.term IS NULL THEN 1 ELSE 0 END, total DESC, src) AS o
   FROM srn s LEFT JOIN kw ON kw.shard_id = s.shard_id AND kw.term = s.src) WHERE o <= 256),
gr AS (SELECT k.shard_id, k.src, k.dst, k.cnt, k.cnt / s.total AS weight FROM kep k JOIN src s ON s.shard_id = k.shard_id AND s.src = k.src)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


def r6(name: str, c=None):
    return F.round(F.col(name) if c is None else c, 6).alias(name)


# ---- text and ingestion
@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') AS tokens FROM documents")
def tokenize_index(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(with_(S_WORDS) + "SELECT doc_id, array_to_string(words, ' ') AS tokens FROM dw")
def content_tokens(spark, d):
    return doc_words(spark, d).select("doc_id", F.array_join("words", " ").alias("tokens"))


S_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
S_TITLE = rf"""fs AS (SELECT doc_id, c, trim(regexp_extract(c, '^(.*?[.!?])\s', 1)) AS s FROM (SELECT doc_id, {S_CLEAN} AS c FROM documents)),
ft AS (SELECT doc_id, c, CASE WHEN s <> '' THEN s ELSE c END AS f FROM fs),
tl AS (SELECT doc_id, c, CASE WHEN length(f) <= 120 THEN f WHEN contains(substr(f, 1, 120), ' ') THEN trim(regexp_replace(substr(f, 1, 120), ' [^ ]*$', '')) ELSE substr(f, 1, 120) END AS title FROM ft)"""


@query(with_(S_TITLE) + "SELECT doc_id, title FROM tl")
def derive_title(spark, d):
    return table(spark, d, "documents").select("doc_id", T.derive_title(T.clean(F.col("text"))).alias("title"))


@query(rf"""SELECT 'web-' || substr(sha256(text), 1, 16) AS id, text, min(language) AS language FROM (
 SELECT {S_CLEAN} AS text, nullif(trim(lang), '') AS language, doc_id, row_number() OVER (PARTITION BY {S_CLEAN} ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND length(text) >= 32 GROUP BY ALL""")
def normalize_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return ingest.normalize_rows(rows, {"text": "text", "language": "lang"}, "web", 32, "doc_id").select("id", "text", "language")


@query("SELECT doc_id, text, lang AS language FROM documents WHERE lang IN ('de', 'fr') AND source = 'src1' ORDER BY doc_id LIMIT 50")
def select_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("language"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return ingest.select_documents(docs, ingest.matches(["de", "fr"], metadata_equals={"source": "src1"}), 50, "doc_id").select("doc_id", "text", "language")


@query("SELECT doc_id FROM documents WHERE lang IN ('en')")
def metadata_filter_language(spark, d):
    return table(spark, d, "documents").withColumn("language", F.col("lang")).filter(ingest.matches(["en"])).select("doc_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def metadata_filter_dates(spark, d):
    return table(spark, d, "events").filter(ingest.matches(published_from="2024-01-05", published_to="2024-01-20", published="ts")).select("event_id")


@query("SELECT doc_id FROM documents WHERE source IS NOT DISTINCT FROM 'src2'")
def metadata_equals_nullsafe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return docs.filter(ingest.matches(metadata_equals={"source": "src2", "absent": None})).select("doc_id")


@query("SELECT doc_id AS id, 'document' AS origin FROM documents UNION ALL SELECT page_id, 'page' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def merge_documents(spark, d):
    first = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"))
    return ingest.merge(first, table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("origin")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'repeated id' AS reason FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1")
def validation_report(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.derive_title(T.clean(F.col("text"))).alias("title"), "text")
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("t").alias("title"), F.lit("t").alias("text"))  # labels have no text
    return ingest.violations(docs.unionByName(marks))


@query(with_(S_QRELS) + "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM qr)")
def qrels_semi_join(spark, d):
    return table(spark, d, "documents").join(qrels(spark, d), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def qrels_anti_join(spark, d):
    return ingest.missing_references(table(spark, d, "labels"), shards(spark, d), "doc_id")


@query(with_(S_QRELS) + "SELECT query_id, b.text AS question, array_to_string(list(doc_id ORDER BY doc_id), ',') AS positive FROM qr JOIN benchmark b ON b.item_id = query_id GROUP BY ALL")
def topics_qrels_join(spark, d):
    return ingest.judged_topics(questions(spark, d).select("query_id", "question"), qrels(spark, d)).select("query_id", "question", F.array_join("positive", ",").alias("positive"))


@query("""SELECT doc_id, term, n, CASE
  WHEN length(term) < 4 OR NOT ends_with(term, 's') OR term IN ('alias', 'atlas', 'bias', 'canvas', 'chaos', 'gas', 'iris', 'lens', 'means', 'news', 'series', 'species') THEN term
  WHEN regexp_matches(term, '(ss|us|is)$') THEN term
  WHEN regexp_matches(term, '.{2,}ies$') THEN regexp_replace(term, 'ies$', 'y')
  WHEN regexp_matches(term, '(ch|sh|ss|x)es$') THEN left(term, -2) ELSE left(term, -1) END AS singular
 FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL)""")
def term_frequencies_singular(spark, d):
    own = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("words"))
    return bm25.term_counts(own, ["doc_id"]).select("doc_id", "term", F.col("tf").alias("n"), T.singular(F.col("term")).alias("singular"))


@query("SELECT item_id, 'Instruct: Given a question, find documents that answer it' || chr(10) || 'Query: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS e5 FROM benchmark")
def e5_format(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.instructed(F.lit("Given a question, find documents that answer it"), F.col("text")).alias("e5"))


@query()
def snippets(spark, d):
    first = table(spark, d, "documents").join(small(step(bm25_topk(spark, d).filter("rnk = 1"))), "doc_id").join(questions(spark, d), "query_id")
    return first.select("query_id", "doc_id", T.snippet(F.col("text"), F.col("question")).alias("snippet"))


# ---- words of many languages: the tables' languages are written in Latin letters, other scripts are in tests
S_STOPS = "CASE lang " + " ".join(f"WHEN '{lang}' THEN [{', '.join(map(repr, words))}]" for lang, words in stopwords().items()) + " ELSE []::VARCHAR[] END"
S_FOLD = "translate(replace(lower(w), 'ß', 'ss'), 'ς', 'σ')"


def s_tokens(name: str, rows: str) -> str:
    """name (id, lang, tokens) of a query for (id, lang, text)."""
    upper = "w = upper(w) AND upper(w) <> lower(w)"
    return rf"""{name}0 AS (SELECT id, lang, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+') AS ws, {S_STOPS} AS stops FROM ({rows})),
{name}1 AS (SELECT *, list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}')) AS lettered FROM {name}0),
{name}2 AS (SELECT *, len(lettered) >= 4 AND len(list_filter(lettered, lambda w: {upper})) >= 0.8 * len(lettered) AS loud FROM {name}1),
{name} AS (SELECT id, lang, list_transform(list_filter(ws, lambda w: NOT list_contains(stops, {S_FOLD}) OR ({upper} AND length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 2 AND NOT loud)), lambda w: {S_FOLD}) AS tokens FROM {name}2)"""


S_MULTI = s_tokens("mt", "SELECT doc_id AS id, coalesce(lang, 'und') AS lang, text FROM documents")


@query(with_(S_MULTI, "mw AS (SELECT id, lang, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS i FROM mt)", "mv AS (SELECT DISTINCT lang, term FROM mw)", f"ms AS ({stems_in_sql('mv')})", "mj AS (SELECT id, string_agg(stem, ' ' ORDER BY i) AS stems FROM mw JOIN ms USING (lang, term) GROUP BY id)") + "SELECT id AS doc_id, lang, array_to_string(tokens, ' ') AS tokens, coalesce(stems, '') AS stems FROM mt LEFT JOIN mj USING (id)")
def multilingual_tokens(spark, d):
    rows = tokens.with_stems(tokens.tokenized(table(spark, d, "documents")))
    return rows.select("doc_id", "lang", F.array_join("tokens", " ").alias("tokens"), F.array_join("stems", " ").alias("stems"))


@query(with_(S_MULTI, "mv AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(tokens) AS term FROM mt) GROUP BY ALL)", f"ms AS ({stems_in_sql('mv')})") + "SELECT lang, stem, count(*) AS words, sum(n)::BIGINT AS n FROM ms JOIN mv USING (lang, term) GROUP BY ALL")
def stem_frequencies(spark, d):
    """How many words and places each stem has: counted by word, and each distinct word is stemmed once."""
    counts = tokens.counted(table(spark, d, "documents"))
    return tokens.stem_table(counts).groupBy("lang", "stem").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))


# ---- the language step
def s_grams(name: str, rows: str) -> str:
    """name (id, gram, n) of a query for (id, text)."""
    return rf"""{name}0 AS (SELECT id, '_' || w || '_' AS p, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS w FROM ({rows})) GROUP BY ALL),
{name} AS (SELECT id, gram, sum(n)::BIGINT AS n FROM (SELECT id, n, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, length(p) - k + 2), lambda i: substr(p, i, k))))) AS gram FROM {name}0) WHERE gram <> '_' GROUP BY ALL)"""


def s_ranked(name: str, of: str) -> str:
    return f"{name} AS (SELECT id, gram, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, gram) AS rank FROM {of}) WHERE rank <= 300)"


S_PROFILES = ", ".join([s_grams("lg", "SELECT lang AS id, text FROM documents WHERE lang IS NOT NULL AND doc_id % 2 = 1"), s_ranked("lp", "lg")])


def learned_profiles(spark, d) -> DataFrame:
    """Of the documents with odd numbers, so that the others show how well they do."""
    return indexed("profiles", spark, d, lambda: language.profiles(table(spark, d, "documents").filter("doc_id % 2 = 1")))


@query(with_(S_PROFILES) + "SELECT id AS lang, gram, rank FROM lp")
def language_profiles(spark, d):
    return learned_profiles(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(with_(S_PROFILES, s_grams("dg", "SELECT doc_id AS id, text FROM documents"), s_ranked("dp", "dg")) + """, dn AS (SELECT id, count(*) AS n FROM dp GROUP BY id),
me AS (SELECT dp.id, lp.id AS lang, sum(300 - least(300, abs(dp.rank - lp.rank))) AS near FROM dp JOIN lp USING (gram) GROUP BY ALL),
be AS (SELECT id, lang, near FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY near DESC, lang) AS r FROM me) WHERE r = 1)
SELECT doc_id, CASE WHEN n >= 12 AND near > 0 THEN be.lang ELSE 'und' END AS language, round(CASE WHEN n >= 12 AND near > 0 THEN near / (n * 300) ELSE 0 END, 6) AS confidence FROM documents LEFT JOIN dn ON dn.id = doc_id LEFT JOIN be ON be.id = doc_id""")
def language_detection(spark, d):
    return language.detected(table(spark, d, "documents"), learned_profiles(spark, d)).select("doc_id", "language", r6("confidence"))


# ---- index features
@query(with_(S_WORDS, S_TF0) + "SELECT term, count(*) AS df, round(ln((1 + (SELECT count(DISTINCT doc_id) FROM tf)) / (1 + count(*))) + 1, 6) AS idf FROM tf GROUP BY term")
def doc_frequency_idf(spark, d):
    return features.idf_of_words(doc_words(spark, d)).select("term", "df", r6("idf"))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW) + "SELECT shard_id, rank, term, round(weight, 6) AS weight FROM kw")
def shard_keywords_tfidf(spark, d):
    return shard_keywords(spark, d).select("shard_id", F.col("rank").cast("long").alias("rank"), "term", r6("weight"))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW) + "SELECT shard_id, array_to_string(list(term ORDER BY rank), ', ') AS title FROM kw WHERE rank <= 3 GROUP BY shard_id")
def shard_title(spark, d):
    return features.titles(shard_keywords(spark, d))


@query(with_(S_TITLE, S_VEC, S_CENT) + """, near AS (SELECT v.shard_id, v.doc_id, title, row_number() OVER (PARTITION BY v.shard_id ORDER BY round(list_inner_product(v.v, c.v) / (sqrt(list_inner_product(v.v, v.v)) * sqrt(list_inner_product(c.v, c.v))), 9) DESC, v.doc_id) AS r
 FROM vec v JOIN cent c USING (shard_id) JOIN tl USING (doc_id)) SELECT shard_id, array_to_string(list(title ORDER BY r), '; ') AS summary FROM near WHERE r <= 3 GROUP BY shard_id""")
def shard_summary(spark, d):
    titled = derive_title(spark, d).join(vectors(spark, d), "doc_id")
    return features.summaries(titled, V.mean_vectors(vectors(spark, d), "shard_id", "v"))


@query(with_(S_WORDS, S_SHARD, S_TF) + "SELECT shard_id, term, n::BIGINT AS n FROM (SELECT shard_id, term, sum(tf) AS n, row_number() OVER (PARTITION BY shard_id ORDER BY sum(tf) DESC, term) AS r FROM tf GROUP BY shard_id, term) WHERE r <= 2000")
def shard_vocabulary(spark, d):
    return features.vocabulary(shard_tf(spark, d), 2000).select("shard_id", "term", "n")


@query(with_(S_SHARD.replace("dw d", "documents d").replace("d.words", "d.text")) + "SELECT shard_id, rank, text, cnt FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY cnt DESC, text) AS rank FROM (SELECT shard_id, m AS text, count(*) AS cnt FROM (SELECT shard_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS m FROM sw) GROUP BY ALL)) WHERE rank <= 30")
def shard_entities(spark, d):
    found = table(spark, d, "documents").join(shards(spark, d), "doc_id").select("shard_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("text"))
    return features.entities(found, 30).withColumn("rank", F.col("rank").cast("long"))


def graph(spark, d) -> DataFrame:
    return indexed("graph", spark, d, lambda: features.term_graph(shard_words(spark, d), pinned=shard_keywords(spark, d)))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_GRAPH) + "SELECT shard_id, src, dst, cnt, round(weight, 6) AS weight FROM gr")
def term_graph(spark, d):
    return graph(spark, d).select("shard_id", "src", "dst", "cnt", r6("weight"))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW) + "SELECT term, count(*) AS shards, count(*) > 0.8 * (SELECT count(DISTINCT shard_id) FROM kw) AS ubiquitous FROM kw GROUP BY term")
def ubiquity_filter(spark, d):
    rows = shard_keywords(spark, d)
    return features.ubiquity(rows, shards(spark, d).select("shard_id").distinct().count())


@query(with_(S_VEC, S_CENT) + "SELECT shard_id, i, round(x, 6) AS x FROM (SELECT shard_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM cent)")
def centroids(spark, d):
    return V.mean_vectors(vectors(spark, d), "shard_id", "v").select("shard_id", F.posexplode("centroid").alias("i", "x")).select("shard_id", F.col("i").cast("long").alias("i"), r6("x"))


@query(with_(S_VEC, "un AS (SELECT doc_id, shard_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM vec)") + """SELECT a.shard_id, (SELECT count(*) FROM un u WHERE u.shard_id = a.shard_id) AS n,
 round(avg(CASE WHEN a.shard_id = b.shard_id AND a.doc_id <> b.doc_id THEN list_inner_product(a.v, b.v) END), 6) AS intra, round(avg(CASE WHEN a.shard_id <> b.shard_id THEN list_inner_product(a.v, b.v) END), 6) AS inter FROM un a, un b GROUP BY a.shard_id""")
def coherence(spark, d):
    return features.coherence(vectors(spark, d).select("shard_id", V.unit(F.col("v")).alias("v"))).select("shard_id", "n", r6("intra"), r6("inter"))


@query("SELECT count(*) AS shards, round(avg(n), 6) AS mean, round(stddev_pop(n) / avg(n), 6) AS cv FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def shard_size_stats(spark, d):
    return shards(spark, d).groupBy("shard_id").count().agg(F.count(F.lit(1)).alias("shards"), r6("mean", F.avg("count")), r6("cv", F.stddev_pop("count") / F.avg("count")))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW) + ", k AS (SELECT * FROM kw WHERE rank <= 10), n AS (SELECT shard_id, count(*) AS n FROM k GROUP BY ALL) SELECT a.shard_id AS a, b.shard_id AS b, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard FROM k a JOIN k b ON a.term = b.term AND a.shard_id < b.shard_id JOIN n na ON na.shard_id = a.shard_id JOIN n nb ON nb.shard_id = b.shard_id GROUP BY ALL")
def keyword_jaccard(spark, d):
    return features.keyword_overlap(shard_keywords(spark, d)).select("a", "b", r6("jaccard"))


@query("WITH s AS (SELECT round(max(abs(x)) / 127, 8) AS s FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)) SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: greatest(-127, least(127, round_even(x / s, 0)))::INTEGER), ',') AS q FROM embeddings, s")
def quantise_int8(spark, d):
    rows = table(spark, d, "embeddings")
    largest = rows.agg(F.round(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))) / 127, 8).alias("s"))
    return rows.join(F.broadcast(largest)).select("vec_id", F.array_join(V.quantised(F.col("embedding"), F.col("s")).cast("array<string>"), ",").alias("q"))


@query()
def hash_embeddings(spark, d):
    return table(spark, d, "documents").select("doc_id", hash_embedding(T.tokens(F.col("text")), 64).alias("v"))


@query()
def kmeans_shards(spark, d):
    return search.clustered(vectors(spark, d).select("doc_id", "v"), 8).select("doc_id", "shard_id")


# ---- routing
def keyword_postings(spark, d):
    return routing.sparse_matrix(shard_keywords(spark, d).select("shard_id", "term", "weight"))


# questions for both rankers: every twentieth document's words, and its vector
S_HQ = f"qw AS (SELECT d.doc_id AS query_id, d.words FROM dw d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 20 = 0)"
S_SPARSE = """ix AS (SELECT term, ln((1 + (SELECT count(DISTINCT shard_id) FROM kw)) / (1 + count(*))) + 1 AS idf FROM kw GROUP BY term),
kl AS (SELECT shard_id, sqrt(sum(weight * weight)) AS l FROM kw GROUP BY shard_id),
uq AS (SELECT query_id, term, weight * idf AS w FROM qt JOIN ix USING (term)),
ql AS (SELECT query_id, sqrt(sum(w * w)) AS l FROM uq GROUP BY query_id),
sps AS (SELECT query_id, kw.shard_id, sum(uq.w / ql.l * kw.weight / kl.l) AS score FROM kw JOIN kl USING (shard_id) JOIN uq USING (term) JOIN ql USING (query_id) GROUP BY ALL)"""


def sparse_ranked(spark, d) -> DataFrame:
    postings, idf = keyword_postings(spark, d)
    return routing.sparse_scores(postings, idf, question_terms(spark, d).withColumnRenamed("weight", "n"))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_Q, S_QT, S_SPARSE) + "SELECT query_id, shard_id, round(score, 6) AS score FROM sps")
def shard_sparse_cosine(spark, d):
    return sparse_ranked(spark, d).select("query_id", "shard_id", r6("score"))


@query(with_(S_VEC, S_DENSE) + "SELECT query_id, doc_id, round(score, 6) AS score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rnk FROM sims) WHERE rnk <= 10")
def dense_topk(spark, d):
    return search.dense(vectors(spark, d), dense_questions(spark, d), 10, True).select("query_id", "doc_id", r6("score"), F.col("rnk").cast("long").alias("rnk"))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_Q, S_QT, S_SPARSE) + """, r AS (SELECT query_id, shard_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, shard_id) AS rnk FROM sps)
SELECT query_id, shard_id, round((1.0 / rnk) / sum(1.0 / rnk) OVER (PARTITION BY query_id), 6) AS mass, round(1.0 / (1.0 + rnk - 1), 6) AS w FROM r""")
def zipf_restart_and_rank_weights(spark, d):
    placed = ranking.ranked(sparse_ranked(spark, d).withColumn("score", F.round("score", 9)), ["query_id"], "score", "shard_id")
    return ranking.restart_mass(placed, ["query_id"]).select("query_id", "shard_id", r6("mass"), r6("w", ranking.rank_weight(F.col("rnk"))))


@query(with_(S_VEC, S_CENT) + ", p AS (SELECT a.shard_id AS a, b.shard_id AS b, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) AS w FROM cent a JOIN cent b ON a.shard_id <> b.shard_id) SELECT a, b, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM p WHERE w > 0) WHERE r <= 3")
def shard_knn_graph(spark, d):
    return search.neighbour_graph(V.mean_vectors(vectors(spark, d), "shard_id", "v"), 3).select("a", "b", r6("weight"))


S_WALK = """ed AS (SELECT a, b, max(w) AS w FROM (SELECT a, b, w FROM kn UNION ALL SELECT b, a, w FROM kn) GROUP BY ALL),
es AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS share FROM ed),
lo AS (SELECT shard_id FROM cent WHERE shard_id NOT IN (SELECT a FROM es)),
rs AS (SELECT shard_id, (1.0 / (shard_id + 1)) / (SELECT sum(1.0 / (shard_id + 1)) FROM cent) AS r FROM cent),
pr AS (SELECT 0 AS i, shard_id, r AS p FROM rs UNION ALL
  SELECT n.i + 1, n.shard_id, 0.85 * (n.came + n.loose * rs.r) + 0.15 * rs.r FROM (
    SELECT max(pr.i) AS i, t.shard_id, sum(CASE WHEN es.b = t.shard_id THEN pr.p * es.share ELSE 0 END) AS came, sum(CASE WHEN es.a IS NULL AND t.shard_id IS NOT NULL THEN pr.p ELSE 0 END) AS loose
    FROM pr LEFT JOIN es ON es.a = pr.shard_id CROSS JOIN rs t GROUP BY t.shard_id) n JOIN rs USING (shard_id) WHERE n.i < 180)"""
S_KNN = "kn0 AS (SELECT a.shard_id AS a, b.shard_id AS b, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) AS w FROM cent a JOIN cent b ON a.shard_id <> b.shard_id), kn AS (SELECT a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM kn0 WHERE w > 0) WHERE r <= 8)"


@query(with_(S_VEC, S_CENT, S_KNN, S_WALK).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT shard_id, round(p, 9) AS score FROM pr WHERE i = 180")
def pagerank_scores(spark, d):
    own = step(V.mean_vectors(vectors(spark, d), "shard_id", "v"))
    prior = ranking.restart_mass(own.select("shard_id", (F.col("shard_id") + 1).alias("rnk")), [])
    return pagerank.pagerank(search.neighbour_graph(own), prior).select("shard_id", F.round("score", 9).alias("score"))


def routed_shards(spark, d) -> DataFrame:
    placed = ranking.top(sparse_ranked(spark, d).withColumn("score", F.round("score", 9)), ["query_id"], "score", "shard_id", 3)
    return placed.select("query_id", "shard_id", ranking.rank_weight(F.col("rnk")).alias("w"))


S_ROUTED = "rt AS (SELECT query_id, shard_id, 1.0 / rnk AS w FROM (SELECT query_id, shard_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, shard_id) AS rnk FROM sps) WHERE rnk <= 3)"
S_ACT = """hit AS (SELECT rt.query_id, g.shard_id, g.src, g.dst, rt.w, g.weight / sum(g.weight) OVER (PARTITION BY rt.query_id, g.shard_id, g.src) AS p FROM gr g JOIN rt USING (shard_id) JOIN qt ON qt.query_id = rt.query_id AND qt.term = g.src),
tot AS (SELECT query_id, sum(w) AS total FROM (SELECT DISTINCT query_id, shard_id, src, w FROM hit) GROUP BY query_id),
act AS (SELECT query_id, dst AS term, sum(w * p) / any_value(total) AS score FROM hit JOIN tot USING (query_id) GROUP BY query_id, dst)"""


def activations(spark, d) -> DataFrame:
    return routing.activated(question_terms(spark, d), graph(spark, d), routed_shards(spark, d))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_GRAPH, S_Q, S_QT, S_SPARSE, S_ROUTED, S_ACT) + "SELECT query_id, term, round(score + 1e-9, 6) AS score FROM act")
def expansion_activation(spark, d):
    return activations(spark, d).select("query_id", "term", r6("score", F.col("score") + 1e-9))


S_EXP = f"""caps AS (SELECT query_id, least(30, 2 * count(DISTINCT term)) AS cap FROM qt GROUP BY query_id),
ub AS (SELECT src AS term FROM (SELECT DISTINCT shard_id, src FROM gr) GROUP BY src HAVING count(*) > 0.8 * (SELECT count(DISTINCT shard_id) FROM sw)),
exps AS (SELECT query_id, term, score, rank FROM (SELECT a.query_id, a.term, a.score, row_number() OVER (PARTITION BY a.query_id ORDER BY round(a.score, 9) DESC, a.term) AS rank FROM act a
  WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = a.query_id AND qt.term = a.term) AND length(a.term) >= 3 AND NOT regexp_full_match(a.term, '[0-9]+') AND a.term NOT IN (SELECT term FROM ub)) JOIN caps USING (query_id) WHERE rank <= cap)"""


def expanded(spark, d) -> DataFrame:
    own = graph(spark, d)
    table_ = features.ubiquity(own.select("shard_id", F.col("src").alias("term")), shards(spark, d).select("shard_id").distinct().count())
    return routing.expansions(activations(spark, d), question_terms(spark, d), table_)


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_GRAPH, S_Q, S_QT, S_SPARSE, S_ROUTED, S_ACT, S_EXP) + "SELECT query_id, term, round(score, 6) AS score, rank FROM exps")
def expansion_topk(spark, d):
    return expanded(spark, d).select("query_id", "term", r6("score"), F.col("rank").cast("long").alias("rank"))


S_QS = ", ".join([s_tokens("qk", "SELECT item_id AS id, 'en' AS lang, text FROM benchmark"), "qu AS (SELECT id AS query_id, lang, unnest(tokens) AS term FROM qk)", "gt AS (SELECT 'en' AS lang, src AS term FROM gr UNION SELECT 'en', dst FROM gr UNION SELECT lang, term FROM qu)", f"gs AS ({stems_in_sql('gt')})",
    "qs AS (SELECT DISTINCT query_id, stem FROM qu JOIN gs USING (lang, term))", "qb AS (SELECT DISTINCT query_id, gs.term FROM qs JOIN gs USING (stem) WHERE gs.term IN (SELECT src FROM gr UNION SELECT dst FROM gr))"])
S_QEXP = S_ACT.replace("JOIN qt ON qt.query_id = rt.query_id AND qt.term = g.src", "JOIN qb ON qb.query_id = rt.query_id AND qb.term = g.src") + ", " + S_EXP.replace("count(DISTINCT term)) AS cap FROM qt", "count(DISTINCT stem)) AS cap FROM qs").replace("FROM qt WHERE qt.query_id = a.query_id AND qt.term = a.term", "FROM qb WHERE qb.query_id = a.query_id AND qb.term = a.term")


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_GRAPH, S_Q, S_QT, S_SPARSE, S_ROUTED, S_QS, S_QEXP) + "SELECT query_id, term, round(score, 6) AS score, rank FROM exps")
def question_expansion(spark, d):
    """Expansions of a question from its stems: they reach the graphs' terms by the stems of those."""
    own, stems = graph(spark, d), step(tokens.question_stems(questions(spark, d)))
    terms = own.select(F.col("src").alias("term")).union(own.select("dst"))
    reached = step(tokens.bridged(stems, terms))
    ubiquity = features.ubiquity(own.select("shard_id", F.col("src").alias("term")), shards(spark, d).select("shard_id").distinct().count())
    found = routing.expansions(routing.activated(reached, own, routed_shards(spark, d)), reached, ubiquity, counted=stems.withColumnRenamed("stem", "term"))
    return found.select("query_id", "term", r6("score"), F.col("rank").cast("long").alias("rank"))


S_SEL = """qv AS (SELECT doc_id AS query_id, v FROM vec WHERE doc_id % 20 = 0),
sd AS (SELECT q.query_id, c.shard_id, round(list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))), 9) AS score, 'dense' AS ranker FROM qv q, cent c),
ls AS (SELECT * FROM sd UNION ALL SELECT query_id, shard_id, round(score, 9), 'lexical' FROM sps),
fl AS (SELECT query_id, ranker FROM ls GROUP BY ALL HAVING count(*) >= 2 AND max(score) - min(score) > 1e-12),
ns AS (SELECT ls.*, row_number() OVER (PARTITION BY query_id, ranker ORDER BY score DESC, shard_id) AS rnk FROM ls JOIN fl USING (query_id, ranker)),
su AS (SELECT query_id, shard_id, sum(1.0 / (60 + rnk)) AS score FROM ns WHERE rnk <= 100 GROUP BY ALL)"""


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_HQ, S_QT, S_SPARSE, S_VEC, S_CENT, S_SEL) + "SELECT query_id, shard_id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, shard_id::VARCHAR) AS rank FROM su")
def shard_select_rrf(spark, d):
    postings, idf = keyword_postings(spark, d)
    sparse = routing.sparse_scores(postings, idf, document_words(spark, d).withColumnRenamed("weight", "n")).withColumn("ranker", F.lit("lexical"))
    own = V.mean_vectors(vectors(spark, d), "shard_id", "v")
    near = dense_questions(spark, d).crossJoin(small(own)).select("query_id", "shard_id", V.cosine(F.col("q"), F.col("centroid")).alias("score"), F.lit("dense").alias("ranker"))
    lists = ranking.without_flat(sparse.unionByName(near).withColumn("score", F.round("score", 9)), ["query_id"])
    placed = ranking.top(lists, ["query_id", "ranker"], "score", "shard_id", 100).withColumn("weight", F.lit(1.0))
    return ranking.fused(placed, ["query_id"], "shard_id").select("query_id", "shard_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def bloom_coverage(spark, d):
    phrases = shard_keywords(spark, d).select("shard_id", F.col("term").alias("phrase"))
    probes = question_terms(spark, d).select("query_id", F.col("term").alias("phrase"))
    return artifacts.coverage(artifacts.blooms(phrases), probes)


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_Q, S_QT) + ", n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id) SELECT qt.query_id, kw.shard_id, round(count(*) / any_value(n.n), 6) AS coverage FROM qt JOIN kw USING (term) JOIN n USING (query_id) GROUP BY ALL")
def bloom_exact_coverage(spark, d):
    phrases = shard_keywords(spark, d).select("shard_id", F.col("term").alias("phrase"))
    return artifacts.exact_coverage(phrases, question_terms(spark, d).select("query_id", F.col("term").alias("phrase"))).select("query_id", "shard_id", r6("coverage"))


@query()
def compression_gain(spark, d):
    members = table(spark, d, "documents").join(shards(spark, d), "doc_id").select("shard_id", "doc_id", "text")
    return artifacts.compression_gains(artifacts.dictionaries(members), questions(spark, d).select("query_id", "question"))


# ---- reranking of the shards that a question was routed to
def candidate_shards(spark, d) -> DataFrame:
    placed = ranking.ranked(sparse_ranked(spark, d).withColumn("score", F.round("score", 9)), ["query_id"], "score", "shard_id", name="pos")
    return placed.filter("pos <= 6").select("query_id", "shard_id", "pos")


S_RERANK = """ca AS (SELECT query_id, shard_id, pos FROM (SELECT query_id, shard_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, shard_id) AS pos FROM sps) WHERE pos <= 6),
cq AS (SELECT query_id, count(DISTINCT term) AS n FROM qt GROUP BY query_id),
cs AS (SELECT ca.query_id, ca.shard_id, ca.pos, 'coverage' AS ranker, coalesce(c.hits / n, 0) AS score FROM ca JOIN cq USING (query_id) LEFT JOIN (SELECT query_id, shard_id, count(*) AS hits FROM qt JOIN kw USING (term) GROUP BY ALL) c ON c.query_id = ca.query_id AND c.shard_id = ca.shard_id),
cp AS (SELECT x.query_id, x.shard_id AS a, y.shard_id AS b, round(list_inner_product(u.v, w.v) / (sqrt(list_inner_product(u.v, u.v)) * sqrt(list_inner_product(w.v, w.v))), 9) AS w
  FROM ca x JOIN ca y ON x.query_id = y.query_id AND x.shard_id <> y.shard_id JOIN cent u ON u.shard_id = x.shard_id JOIN cent w ON w.shard_id = y.shard_id),
ck AS (SELECT query_id, a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY query_id, a ORDER BY w DESC, b) AS r FROM cp WHERE w > 0) WHERE r <= 8),
ce AS (SELECT query_id, a, b, max(w) AS w FROM (SELECT query_id, a, b, w FROM ck UNION ALL SELECT query_id, b, a, w FROM ck) GROUP BY ALL),
cw AS (SELECT query_id, a, b, w / sum(w) OVER (PARTITION BY query_id, a) AS share FROM ce),
cr AS (SELECT query_id, shard_id, (1.0 / pos) / sum(1.0 / pos) OVER (PARTITION BY query_id) AS r FROM ca),
cy AS (SELECT 0 AS i, query_id, shard_id, r AS y FROM cr UNION ALL
  SELECT max(i) + 1, query_id, shard_id, sum(y) FROM (
    SELECT i, cy.query_id, b AS shard_id, 0.85 * y * share AS y FROM cy JOIN cw ON cw.query_id = cy.query_id AND cw.a = cy.shard_id
    UNION ALL SELECT m.i, cr.query_id, cr.shard_id, r FROM cr, (SELECT max(i) AS i FROM cy) m) WHERE i < 180 GROUP BY query_id, shard_id),
cz AS (SELECT query_id, shard_id, y / sum(y) OVER (PARTITION BY query_id) AS score FROM cy WHERE i = 180),
ra AS (SELECT query_id, shard_id, pos, ranker, round(score, 9) AS score FROM cs UNION ALL SELECT ca.query_id, ca.shard_id, pos, 'pagerank', round(score, 9) FROM ca JOIN cz USING (query_id, shard_id)),
rf AS (SELECT query_id, ranker FROM ra GROUP BY ALL HAVING count(*) >= 2 AND max(score) - min(score) > 1e-12),
rr AS (SELECT query_id, shard_id, ranker, row_number() OVER (PARTITION BY query_id, ranker ORDER BY score DESC, pos, shard_id) AS rnk FROM ra JOIN rf USING (query_id, ranker) UNION ALL SELECT query_id, shard_id, 'stage5', pos FROM ca),
ru AS (SELECT query_id, shard_id, sum(1.0 / (60 + rnk)) AS score, string_agg(ranker, ',' ORDER BY ranker) AS voted FROM rr GROUP BY ALL)"""


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_Q, S_QT, S_SPARSE, S_VEC, S_CENT, S_RERANK).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT query_id, shard_id, round(score, 8) AS score, voted, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, shard_id::VARCHAR) AS rank FROM ru")
def shard_rerank_fusion(spark, d):
    """The order of the route, what of a question a shard's keywords cover, and PageRank among the candidates."""
    chosen = step(candidate_shards(spark, d))
    covered = artifacts.exact_coverage(shard_keywords(spark, d).select("shard_id", F.col("term").alias("phrase")), question_terms(spark, d).select("query_id", F.col("term").alias("phrase")))
    scores = covered.select("query_id", "shard_id", F.col("coverage").alias("score"), F.lit("coverage").alias("ranker")).unionByName(reranking.walk_scores(chosen, V.mean_vectors(vectors(spark, d), "shard_id", "v")))
    fused = reranking.reranked(chosen, scores.withColumn("score", F.round("score", 9)))
    return fused.select("query_id", "shard_id", F.round("score", 8).alias("score"), F.array_join(F.array_sort(F.map_keys("contributions")), ",").alias("voted"), F.col("rank").cast("long").alias("rank"))


@query()
def shard_rerank(spark, d):
    """The route's order with phrase filters, compression gain and PageRank."""
    chosen = step(candidate_shards(spark, d))
    filters = artifacts.blooms(shard_keywords(spark, d).select("shard_id", F.col("term").alias("phrase")))
    members = table(spark, d, "documents").join(small(shards(spark, d), SHARD_ROWS), "doc_id").select("shard_id", "doc_id", "text")
    phrases = question_intents(spark, d).select("query_id", F.col("intent").alias("phrase"))
    scores = reranking.all_scores(chosen, filters, artifacts.dictionaries(members), V.mean_vectors(vectors(spark, d), "shard_id", "v"), questions(spark, d).select("query_id", "question"), phrases)
    fused = reranking.reranked(chosen, step(scores))
    return fused.select("query_id", "shard_id", F.round("score", 8).alias("score"), F.array_join(F.array_sort(F.map_keys("contributions")), ",").alias("voted"), F.col("rank").cast("long").alias("rank"))


# ---- retrieval
def best_by_words(docs: DataFrame, asked: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    got = bm25.scores_in_blocks(docs, asked, most).withColumn("_s", F.round("score", 9))
    return ranking.top(got, by, "_s", "doc_id", most).withColumn("score", F.round("score", 6)).withColumn("rnk", F.col("rnk").cast("long"))


@query(with_(S_WORDS, S_TF0, S_Q, S_QT, S_BM25) + "SELECT query_id, doc_id, round(score, 6) AS score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rnk FROM bm) WHERE rnk <= 10")
def bm25_topk(spark, d):
    words = doc_words(spark, d).withColumn("shard_id", F.lit(0))
    return best_by_words(words, question_terms(spark, d), ["query_id"]).select("query_id", "doc_id", "score", "rnk")


@query(with_(S_WORDS, S_SHARD, S_TF, S_Q, S_QT, S_BM25) + "SELECT query_id, shard_id, doc_id, round(score, 6) AS score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY round(score, 9) DESC, doc_id) AS rnk FROM bm) WHERE rnk <= 10")
def bm25_per_shard(spark, d):
    return best_by_words(shard_words(spark, d), question_terms(spark, d), ["query_id", "shard_id"]).select("query_id", "shard_id", "doc_id", "score", "rnk")


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_GRAPH, S_Q, S_QT, S_SPARSE, S_ROUTED, S_ACT, S_EXP, "qe AS (SELECT query_id, term, weight FROM qt UNION ALL SELECT query_id, term, 0.3 FROM exps)", S_BM25.replace("JOIN qt USING", "JOIN qe USING")) + "SELECT query_id, doc_id, round(score, 6) AS score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rnk FROM bm) WHERE rnk <= 10")
def bm25_with_expansion(spark, d):
    both = question_terms(spark, d).unionByName(expanded(spark, d).select("query_id", "term", F.lit(bm25.EXPANSION_WEIGHT).alias("weight")))
    return best_by_words(shard_words(spark, d), both, ["query_id"]).select("query_id", "doc_id", "score", "rnk")


S_LISTS = """lx AS (SELECT query_id, shard_id, doc_id, score, 'lexical' AS ranker FROM bm WHERE query_id <> doc_id),
both_ AS (SELECT * FROM lx UNION ALL SELECT query_id, shard_id, doc_id, score, 'dense' FROM sims)"""


def document_words(spark, d, every: int = 20) -> DataFrame:
    """The words of every so many documents of the shards, as questions."""
    own = shard_words(spark, d).filter(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), F.explode("words").alias("term"))
    return own.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def hybrid_lists(spark, d, per_shard: bool) -> DataFrame:
    lexical = bm25.scores_in_blocks(shard_words(spark, d), document_words(spark, d), 100, among_rows=True, per_shard=per_shard).withColumn("ranker", F.lit("lexical"))
    return lexical.unionByName(search.similarities(vectors(spark, d), dense_questions(spark, d), 100, among_rows=True, per_shard=per_shard).withColumn("ranker", F.lit("dense")))


S_FUSE = """rk AS (SELECT *, row_number() OVER (PARTITION BY {by}, ranker ORDER BY round(score, 9) DESC, doc_id) AS rnk FROM both_),
fu AS (SELECT {by}, doc_id, sum(1.0 / (60 + rnk)) AS score, string_agg(ranker || ':' || rnk, ',' ORDER BY ranker) AS ranks FROM rk WHERE rnk <= 100 GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 12) DESC, doc_id::VARCHAR) AS rank FROM fu)"""


def fused_lists(spark, d, by: list[str]) -> DataFrame:
    placed = ranking.top(hybrid_lists(spark, d, "shard_id" in by).withColumn("score", F.round("score", 9)), [*by, "ranker"], "score", "doc_id", 100)
    return ranking.fused(placed.withColumn("weight", F.lit(1.0)), by, "doc_id")


@query(with_(S_WORDS, S_SHARD, S_TF, S_HQ, S_QT, S_BM25, S_VEC, S_DENSE, S_LISTS, S_FUSE.format(by="query_id")) + "SELECT query_id, doc_id, round(score, 8) AS score, rank FROM fr WHERE rank <= 10")
def hybrid_rrf_global(spark, d):
    return fused_lists(spark, d, ["query_id"]).filter("rank <= 10").select("query_id", "doc_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(with_(S_WORDS, S_SHARD, S_TF, S_HQ, S_QT, S_BM25, S_VEC, S_DENSE, S_LISTS, S_FUSE.format(by="query_id, shard_id")) + "SELECT query_id, shard_id, doc_id, round(score, 8) AS score, rank FROM fr WHERE rank <= 5")
def hybrid_rrf_per_shard(spark, d):
    return fused_lists(spark, d, ["query_id", "shard_id"]).filter("rank <= 5").select("query_id", "shard_id", "doc_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(with_(S_WORDS, S_SHARD, S_TF, S_HQ, S_QT, S_BM25, S_VEC, S_DENSE, S_LISTS, S_FUSE.format(by="query_id")) + "SELECT fr.query_id, fr.doc_id, ranker, round(1.0 / (60 + rnk), 8) AS contribution FROM fr JOIN rk ON rk.query_id = fr.query_id AND rk.doc_id = fr.doc_id WHERE rank <= 10 AND rnk <= 100")
def rrf_contributions(spark, d):
    return fused_lists(spark, d, ["query_id"]).filter("rank <= 10").select("query_id", "doc_id", F.explode("contributions").alias("ranker", "contribution")).withColumn("contribution", F.round("contribution", 8))


@query(with_(S_WORDS, S_SHARD, S_TF, S_HQ.replace(" WHERE d.doc_id % 20 = 0", ""), S_QT, S_BM25) + "SELECT query_id, doc_id, round(max(score), 6) AS score, count(DISTINCT shard_id) AS shards FROM bm GROUP BY query_id, doc_id")
def group_by_document_max(spark, d):
    """Every document of the shards as a question to all of them."""
    return bm25.scores_in_blocks(shard_words(spark, d), document_words(spark, d, 1)).select("query_id", "doc_id", r6("score"), "shards")


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_Q, S_QT, S_SPARSE, S_ROUTED) + """, av AS (SELECT DISTINCT label AS shard_id FROM embeddings),
al AS (SELECT query_id, shard_id, 0 AS o, row_number() OVER (PARTITION BY query_id ORDER BY w DESC) AS pos FROM rt UNION ALL SELECT q.query_id, a.shard_id, 1, a.shard_id FROM (SELECT DISTINCT query_id FROM rt) q, av a WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.query_id = q.query_id AND rt.shard_id = a.shard_id))
SELECT query_id, shard_id, pos FROM (SELECT query_id, shard_id, o, row_number() OVER (PARTITION BY query_id ORDER BY o, pos, shard_id) AS pos FROM al) WHERE pos <= 30 AND (o = 0 OR pos <= 5)""")
def fan_out_clamp(spark, d):
    routed = routed_shards(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("w").desc())))
    return ranking.fan_out(routed, shards(spark, d), ["query_id"], 5, 30).select("query_id", "shard_id", F.col("pos").cast("long").alias("pos"))


def question_intents(spark, d) -> DataFrame:
    idf = features.idf_of_words(doc_words(spark, d))
    return intents.predicted(intents.positioned(questions(spark, d)), idf)


@query()
def harmonic_intents(spark, d):
    return question_intents(spark, d).select("query_id", "intent", r6("score"), "rank")


def intent_window(spark, d) -> DataFrame:
    return windowed(spark, d, step(bm25_topk(spark, d)))


def windowed(spark, d, ranked: DataFrame) -> DataFrame:
    """Hits, which are few, with their texts."""
    return table(spark, d, "documents").select("doc_id", "text").join(small(ranked.select("query_id", "doc_id", "rnk", "score")), "doc_id")


@query()
def intent_scan(spark, d):
    return intents.scanned(intent_window(spark, d), question_intents(spark, d)).select("query_id", "doc_id", r6("evidence"), "matched")


@query()
def intent_refine(spark, d):
    first = step(bm25_topk(spark, d))
    return search.refined(first, intents.scanned(windowed(spark, d, first), question_intents(spark, d)))


# ---- evaluation
S_TOP = "top AS (SELECT query_id, doc_id, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rnk FROM bm) WHERE rnk <= 10)"
S_EVAL = """ide AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN grade / log2(i + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM qr) GROUP BY query_id),
fo AS (SELECT query_id, count(*) AS hits, min(rnk) AS first, sum(grade / log2(rnk + 1)) AS gain FROM top JOIN qr USING (query_id, doc_id) GROUP BY query_id),
me AS (SELECT query_id, coalesce(hits, 0) / relevant AS recall, coalesce(1.0 / first, 0) AS mrr, coalesce(gain, 0) / ideal AS ndcg FROM ide LEFT JOIN fo USING (query_id))"""


def evaluation(spark, d) -> DataFrame:
    return metrics.evaluated(bm25_topk(spark, d), qrels(spark, d))


@query(with_(S_WORDS, S_TF0, S_Q, S_QT, S_BM25, S_QRELS, S_TOP, S_EVAL) + "SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM me")
def ranking_metrics_at_10(spark, d):
    return evaluation(spark, d).select("query_id", r6("recall"), r6("mrr"), r6("ndcg"))


@query(with_(S_WORDS, S_TF0, S_Q, S_QT, S_BM25, S_QRELS, S_TOP, S_EVAL) + "SELECT 'lexical' AS mode, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM me")
def mode_averages(spark, d):
    return evaluation(spark, d).agg(F.count(F.lit(1)).alias("queries"), r6("recall", F.avg("recall")), r6("mrr", F.avg("mrr")), r6("ndcg", F.avg("ndcg"))).withColumn("mode", F.lit("lexical"))


@query(with_(S_WORDS, S_SHARD, S_TF, S_KW, S_Q, S_QT, S_SPARSE, S_ROUTED, S_QRELS) + "SELECT q.query_id, round(avg(CASE WHEN rt.shard_id IS NULL THEN 0 ELSE 1 END), 6) AS shard_recall FROM (SELECT DISTINCT query_id, doc_id FROM qr) q LEFT JOIN embeddings e ON e.vec_id = q.doc_id LEFT JOIN rt ON rt.query_id = q.query_id AND rt.shard_id = e.label GROUP BY q.query_id")
def shard_recall_at_n(spark, d):
    return metrics.shard_recall(routed_shards(spark, d), qrels(spark, d), shards(spark, d)).select("query_id", r6("shard_recall"))


@query(with_(S_WORDS, S_TF0, S_Q, S_QT, S_BM25, S_TOP) + """, f5 AS (SELECT t.query_id, t.doc_id, list_distinct(d.words) AS w, list_distinct(q.words) AS q FROM top t JOIN dw d USING (doc_id) JOIN qw q USING (query_id) WHERE rnk <= 5),
pr AS (SELECT a.query_id, avg(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))) AS redundancy FROM f5 a JOIN f5 b ON a.query_id = b.query_id AND a.doc_id < b.doc_id GROUP BY a.query_id)
SELECT query_id, round(avg(len(list_intersect(w, q)) / len(q)), 6) AS relevance, round(len(list_distinct(flatten(list(list_intersect(w, q))))) / any_value(len(q)), 6) AS coverage, round(coalesce(any_value(redundancy), 0), 6) AS redundancy FROM f5 LEFT JOIN pr USING (query_id) GROUP BY query_id""")
def judge_overlap(spark, d):
    # the hits are few: found once, and only their documents' words go on
    hits = doc_words(spark, d).join(small(step(bm25_topk(spark, d))), "doc_id")
    return metrics.judged_hits(hits, questions(spark, d)).select("query_id", r6("relevance"), r6("coverage"), r6("redundancy"))


@query("SELECT user_id, round(CASE WHEN max(value) > min(value) THEN (avg(value) - min(value)) / (max(value) - min(value)) WHEN max(value) > 0 THEN 1.0 ELSE 0.0 END, 6) AS scaled_mean FROM events GROUP BY user_id")
def min_max_mean(spark, d):
    return ranking.scaled_mean(table(spark, d, "events"), ["user_id"], "value").select("user_id", r6("scaled_mean"))


def index_tables(spark, d) -> dict[str, DataFrame]:
    """An index of the tables: shards as given, vectors from hashed words as in an index that is built from texts."""
    placed = table(spark, d, "documents").join(small(shards(spark, d)), "doc_id")
    keywords = shard_keywords(spark, d)
    own = indexed("hashed", spark, d, lambda: shard_words(spark, d).select("doc_id", "shard_id", hash_embedding(F.col("words"), 64).alias("v")))
    filters = artifacts.blooms(keywords.select("shard_id", F.col("term").alias("phrase")))
    return {
        "documents": table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.derive_title(T.clean(F.col("text"))).alias("title"), "text"), "members": shards(spark, d), "keywords": keywords,
        "vectors": own, "postings": shard_tf(spark, d), "graph": graph(spark, d), "shards": indexed("hashed_centroids", spark, d, lambda: V.mean_vectors(own, "shard_id", "v")),
        "blooms": indexed("blooms", spark, d, lambda: filters), "dictionaries": indexed("dictionaries", spark, d, lambda: artifacts.dictionaries(placed.select("shard_id", "doc_id", "text"))),
    }


@query()
def agent_search(spark, d):
    nodes, results = agent.search(index_tables(spark, d), questions(spark, d).select("query_id", "question"), Settings())
    won = results.select("query_id", F.col("winner").alias("_node"), "stop_reason", "digest")
    rows = nodes.join(won, "query_id").withColumn("winner", F.col("node") == F.col("_node"))
    return rows.select("query_id", "node", "parent", "stage", "origin", F.col("text").alias("wording"), F.array_join("expansions", " ").alias("expansions"), F.array_join("shards", " ").alias("shards"), "reward", "visits", "mean", "uct", "winner", "stop_reason", "digest")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return ingestion.windowed(table(spark, d, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return ingestion.sessions(table(spark, d, "events"))

"""How sources of a language differ in their words, by sketch-prefiltered counting.

Only terms in many documents of a language count. A first pass adds each language's document frequencies to a count-min
sketch: every task has one, they are merged block by block, and of each cell only whether it reaches the threshold goes on,
as a bit. A cell is never below the frequency of a term in it, so a term one of whose cells has no bit is impossible and is
discarded before anything is shuffled. The second pass counts the survivors exactly by language, source and term.

Each pair of sources of a language gets the sum of a divergence over all terms. Terms that both sources have are joined by
term; what a source has and the other has not depends on the source's count alone and comes from histograms of counts; what
neither has is a constant times a number of terms. So no term is spread over sources that do not have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..steps import spread
from .common import Written, shuffle_partitions, small_side, table, written
from .perfect_hash import mixed
from .terms import in_slices, splitter, words

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"
#: Rows of the sketch; cells of a row for each root of a character, rounded up to a power of two between two bounds. The
#: bounds hold a task's sketch at 128 MB and the bits that are broadcast at 16 MB, whatever the table's size; with more terms
#: than cells fewer impossible ones are discarded, and the result is the same.
ROWS, CELLS_PER_ROOT, LEAST_CELLS, MOST_CELLS = 4, 64, 1 << 14, 1 << 25
#: Cells that are merged together.
BLOCK = 1 << 13
BYTES_AT_ONCE = 1 << 24


class _Counted:
    """Terms of a slice of documents by group: in how many documents, and how often."""

    def __init__(self, texts: pa.Array, groups: np.ndarray, table: np.ndarray):
        own, each = words(texts, table)
        self.terms = own.dictionary
        size = max(1, len(self.terms))
        of = np.repeat(np.arange(len(each)), each)
        pair, times = np.unique(of * size + own.indices.to_numpy(zero_copy_only=False), return_counts=True)
        key, at = np.unique(groups[pair // size] * size + pair % size, return_inverse=True)
        self.group, self.term = key // size, key % size
        self.docs = np.bincount(at, minlength=len(key)).astype(np.int64)
        self.times = np.bincount(at, times, len(key)).astype(np.int64)


def _hashes(values: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(v.as_py()) for v in values.cast(pa.binary())], np.uint64)


def cells(lang: np.ndarray, term: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The cell in each row of the sketch, of hashes of languages and terms."""
    for row in range(ROWS):
        yield row * width + (mixed(term, lang, row) & np.uint64(width - 1)).astype(np.int64)


def possible_cells(docs: DataFrame, least: int, width: int, separators: str = SEPARATORS) -> np.ndarray:
    """A bit for each cell of the merged sketch that reaches `least`. docs: (lang, source, text), no nulls."""
    spark, split = docs.sparkSession, splitter(separators)
    if not 1 <= least <= 255:
        raise ValueError("a cell counts up to 255")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ROWS * width, np.uint8)
        for batch in in_slices(batches, 2, BYTES_AT_ONCE):
            langs = batch.column(0).dictionary_encode()
            own = _Counted(batch.column(2), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), split)
            for cell in cells(_hashes(langs.dictionary)[own.group], _hashes(own.terms)[own.term], width):
                at, of = np.unique(cell, return_inverse=True)
                sums[at] = np.minimum(sums[at] + np.bincount(of, own.docs, len(at)), least)  # more is not asked for
        parts = sums.reshape(-1, min(BLOCK, width))
        for i in np.flatnonzero(parts.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([parts[i].tobytes()], pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([held]), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "cells"])
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != held:
                    if held is not None:
                        yield bits()
                    held, total = block, np.zeros(len(raw), np.int64)
                total += np.frombuffer(raw, np.uint8)
        if held is not None:
            yield bits()

    merged = docs.mapInArrow(sketch, "block long, cells binary").repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block").mapInArrow(merge, "block long, cells binary")
    found = np.zeros((ROWS * width // min(BLOCK, width), min(BLOCK, width) // 8), np.uint8)
    for block, raw in merged.toLocalIterator():  # bits: 16 MB at most in all
        found[block] = np.frombuffer(raw, np.uint8)
    return found.ravel()


def counted(docs: DataFrame, least: int = LEAST_DOCS, width: int | None = None, separators: str = SEPARATORS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of at least all terms that are in `least` documents of a
    language. docs: (lang, source, text), no nulls."""
    if width is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        width = min(MOST_CELLS, max(LEAST_CELLS, 1 << math.ceil(math.log2(CELLS_PER_ROOT * math.sqrt(chars) + 1))))
    bits, split = docs.sparkSession.sparkContext.broadcast(possible_cells(docs, least, width, separators)), splitter(separators)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2, BYTES_AT_ONCE):
            langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            n = max(1, len(sources.dictionary))
            own = _Counted(batch.column(2), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + sources.indices.to_numpy(zero_copy_only=False), split)
            lang, source = own.group // n, own.group % n
            hit = np.ones(len(lang), bool)
            for cell in cells(_hashes(langs.dictionary)[lang], _hashes(own.terms)[own.term], width):
                hit &= (bits.value[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang[hit])), sources.dictionary.take(pa.array(source[hit])), own.terms.take(pa.array(own.term[hit])), pa.array(own.times[hit]), pa.array(own.docs[hit])],
                names=["lang", "source", "term", "n", "docs"],
            )

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count: Column, total: str, terms: str) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), exactly; null without terms."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.when(F.col(terms) > 0, 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2), wide(F.col(total) + 2 * F.col(terms))))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, width: int | None = None
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the other sources by their divergence (part
    pair), and its `top` terms more frequent in it than in the language, by theirs (part term).

    A language's terms are those in at least `least_docs` of its rows; words are runs of letters and of characters beyond
    ASCII, only A-Z in lower case. A group without such words has none and counts as 0 of each; in a language without terms
    all divergences are 0. Null language, source and text are as empty; repeated rows are rows each; very long texts are
    read whole; ties go by item. An empty table gives an empty table. Other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = Written(counted(own, least_docs, width))
    kept = Written(counts.df.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= least_docs).drop("docs"))
    exact = Written(counts.df.join(kept.df, ["lang", "term"]).drop("docs"))
    counts.drop()
    langs = kept.df.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    sizes = exact.df.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = own.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(small_side(written(langs)), "lang", "left").na.fill(0)
    groups = written(groups.withColumn("none", smoothed(F.lit(0), "total", "terms")))  # what it gives a term that it has not
    held = Written(exact.df.join(small_side(groups), ["lang", "source"]).select("lang", "source", "term", "none", smoothed(F.col("n"), "total", "terms").alias("p"), smoothed(F.col("all"), "lang_total", "terms").alias("q")))
    exact.drop()
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = held.df.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)

    # terms of both: what they add to what each has alone
    a = held.df.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("na"))
    b = held.df.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("nb"))
    more = divergence(F.col("pa"), F.col("pb")) - divergence(F.col("pa"), F.col("nb")) - divergence(F.col("na"), F.col("pb"))
    both = a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(more).alias("more"))
    both = both.unionByName(both.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "common", "more"))
    # terms of one, against what the other gives a term that it has not
    heights = held.df.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("k"))
    others = small_side(groups).select("lang", F.col("source").alias("b"), F.col("none").alias("nb"))
    alone = written(heights.join(others, "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("k") * divergence(F.col("p"), F.col("nb"))).alias("alone")))
    left = groups.select("lang", F.col("source").alias("a"), F.col("held").alias("ha"), F.col("none").alias("na"), "terms")
    right = groups.select("lang", F.col("source").alias("b"), F.col("held").alias("hb"), F.col("none").alias("nb"))
    pairs = left.join(right, "lang").filter("a <> b").join(alone, ["lang", "a", "b"], "left").join(alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("back")), ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left").na.fill(0, ["alone", "back", "common", "more"])
    neither = (F.col("terms") - F.col("ha") - F.col("hb") + F.col("common")) * divergence(F.col("na"), F.col("nb"))
    value = F.when(F.col("terms") > 0, F.col("alone") + F.col("back") + F.col("more") + neither).otherwise(0)
    ranked = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value")).withColumn("rank", F.row_number().over(by))
    return ranked.unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spread(table(spark, sf_dir, "documents")).select("lang", "source", "text"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT n.*, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY n.lang, source) + 2 * v) AS p FROM n JOIN v ON v.lang = n.lang),
l AS (SELECT m.lang, term, 1 + (1000000000::HUGEINT * (m + 2)) // (sum(m) OVER (PARTITION BY m.lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS m FROM n GROUP BY ALL) m JOIN v ON v.lang = m.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM e) WHERE part = 'pair' OR rank <= 10
"""

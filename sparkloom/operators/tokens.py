"""Tokens and stems of texts in many languages, and the way from a question's stems to the terms of an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.stemming import stem_table, stemmed
from ..steps import small, step
from . import segmentation


def tokenized(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str | None = "lang", least: int = 1, dictionary: DataFrame | None = None) -> DataFrame:
    """(ident, lang, tokens): the content words of each text, in order.

    lang: a column of language tags ("en", "en-US"), of which only the first part counts; without one, or where it is null or
    "und", the script decides, and texts in other scripts are "und" and keep all words. Runs of Han and kana are cut by
    `dictionary` (segmentation.learned), or without one into pairs of characters. Null and empty texts have no tokens.
    """
    rows = _surfaces(docs, [ident], text, lang)
    if dictionary is None:
        return rows.select(ident, "lang", W.content(_in_pieces(), F.col("lang"), least).alias("tokens"))
    # only texts with such runs meet the dictionary
    has = F.col("_has")
    mixed = step(rows.filter(has).withColumn("_row", F.monotonically_increasing_id()))
    runs = mixed.select("_row", F.posexplode("_words").alias("_at", "run"))
    cuts = small(step(segmentation.cut(segmentation.distinct_runs(runs.filter(_is_run(F.col("run"))).select("run")), dictionary)))
    placed = runs.join(cuts, "run", "left").withColumn("pieces", F.coalesce("pieces", F.array("run")))
    whole = placed.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "pieces"))), lambda s: s["pieces"])).alias("_cut"))
    joined = mixed.join(whole, "_row").select(ident, "lang", W.content(F.col("_cut"), F.col("lang"), least).alias("tokens"))
    return rows.filter(~has).select(ident, "lang", W.content(F.col("_words"), F.col("lang"), least).alias("tokens")).unionByName(joined)


def _surfaces(docs: DataFrame, keys: list[str], text: str, lang: str | None) -> DataFrame:
    """(keys, lang, _words, _has): words as they are written, and whether runs of Han or kana are among them."""
    tagged = docs.select(*keys, W.normal(F.col(text).cast("string")).alias("_text"), F.col(lang).cast("string").alias("_lang") if lang else F.lit(None).cast("string").alias("_lang"))
    has = F.when(F.col("_text").rlike(W.PLAIN), F.lit(False)).otherwise(F.coalesce(F.col("_text").rlike(f"[{W.CJK}]"), F.lit(False)))
    return tagged.select(*keys, W.language_of(F.col("_text"), F.col("_lang")).alias("lang"), W.surface(F.col("_text")).alias("_words"), has.alias("_has"))


def _is_run(word: Column) -> Column:
    return word.rlike(f"^[{W.CJK}]")


def _in_pieces() -> Column:
    return F.when(F.col("_has"), F.flatten(F.transform("_words", lambda w: F.when(_is_run(w), W.pieces(w)).otherwise(F.array(w))))).otherwise(F.col("_words"))


def counted(docs: DataFrame, text: str = "text", lang: str | None = "lang", least: int = 1) -> DataFrame:
    """(lang, term, n): how often tokenized (without a dictionary) has each token in all texts of a language. Words are counted as
    they are written, block by block before they are dealt out, and each distinct one is folded and looked up once."""
    rows = _surfaces(docs, [], text, lang).select("lang", _in_pieces().alias("_words"))
    # whether a text is loud is settled in its row: after an explode Spark would ask it of the whole text for every word
    written = rows.select("lang", W.loud(F.col("_words")).alias("_loud"), "_words").mapInArrow(_written, "lang string, _loud boolean, _w string, n long")
    written = written.groupBy("lang", "_loud", "_w").agg(F.sum("n").alias("n"))
    folded = written.select("lang", "_loud", "_w", W.folded(F.col("_w")).alias("term"), "n").filter(W.stays(F.col("_w"), F.col("term"), F.coalesce("lang", F.lit("")), F.col("_loud"), least))
    return folded.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, _loud, _w, n) of the words of a block's (lang, _loud, _words)."""
    for batch in batches:
        lang, loud, words = batch.columns
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        langs, coded = lang.dictionary_encode(null_encoding="encode"), words.flatten().dictionary_encode()
        own = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + loud.to_numpy(zero_copy_only=False)
        many = max(1, len(coded.dictionary))
        keys, n = np.unique(np.repeat(own, sizes) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        of, word = np.divmod(keys, many)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of // 2)), pa.array(of % 2 == 1), coded.dictionary.take(pa.array(word)), pa.array(n)], names=["lang", "_loud", "_w", "n"])


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(lang, term, stem) of the distinct tokens of (lang, tokens)."""
    return stem_table(tokens.select("lang", F.explode("tokens").alias("term")).distinct())


def with_stems(tokens: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, lang, tokens, stems) with a stem for each token, which is found in its row."""
    return tokens.select(ident, "lang", "tokens", F.coalesce(stemmed(F.col("tokens"), F.col("lang")), F.array().cast("array<string>")).alias("stems"))


def question_stems(questions: DataFrame, lang: str = "en", text: str = "question") -> DataFrame:
    """(query_id, pos, stem): a question's distinct stems in the order of their first places."""
    own = tokenized(questions.select("query_id", text, F.lit(lang).alias("lang")), "query_id", text)
    rows = own.select("query_id", "lang", F.posexplode("tokens").alias("pos", "term")).join(small(vocabulary(own)), ["lang", "term"])
    return rows.groupBy("query_id", "stem").agg(F.min("pos").alias("pos"))


def bridged(stems: DataFrame, terms: DataFrame, lang: str = "en") -> DataFrame:
    """(query_id, term): the index's terms (term) whose stem a question (query_id, stem) has. Graphs and postings are of
    whole words, so a question's stems reach them by the stems of those."""
    known = stem_table(terms.select(F.lit(lang).alias("lang"), "term").distinct())
    return stems.select("query_id", "stem").distinct().join(known, "stem").select("query_id", "term")

"""The language step: tags in one spelling, languages by ranked letter n-grams, questions made ready for the others.

A language's profile is its most frequent letter n-grams in order of frequency. A text has such an order too; its distance to
a profile is how far its n-grams are out of place there, and a missing one is as far as can be. The nearest profile is the
text's language. A text's n-grams are counted in its row, as numbers that sort as they do, and meet the profiles there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import script_language
from ..functions.words import normal
from ..steps import FEW, small, step

#: Ranks of a profile, and the longest n-gram; fewer different n-grams than LEAST_GRAMS tell nothing.
RANKS, LONGEST, LEAST_GRAMS = 300, 3, 12
#: Bits of a letter in an n-gram's number, and the mark at a word's ends.
BITS, MARK = 21, "_"
#: Texts whose n-grams a task hands over at once, and counts of n-grams that it keeps before they are summed.
ROWS_AT_ONCE, COUNTS_AT_ONCE = 256, 1_000_000
UNKNOWN = "und"

#: Two-letter codes, then three-letter codes and English names of the same language.
LANGUAGES = """
ar ara arabic | bg bul bulgarian | ca cat catalan | cs ces cze czech | da dan danish | de deu ger german | el ell gre greek
en eng english | eo epo esperanto | es spa spanish | et est estonian | eu eus baq basque | fa fas per persian | fi fin finnish
fr fra fre french | ga gle irish | he heb hebrew | hi hin hindi | hu hun hungarian | hy hye arm armenian | id ind indonesian
it ita italian | ja jpn japanese | kk kaz kazakh | ko kor korean | lt lit lithuanian | mr mar marathi | my mya bur burmese
ne nep nepali | nl nld dut dutch | no nor norwegian | pl pol polish | pt por portuguese | ro ron rum romanian | ru rus russian
sk slk slo slovak | sr srp serbian | st sot sesotho | sv swe swedish | ta tam tamil | tr tur turkish | uk ukr ukrainian
ur urd urdu | yi yid yiddish | zh zho chi chinese
"""


def tags() -> dict[str, str]:
    """Every known spelling with its two-letter code."""
    groups = [g.split() for line in LANGUAGES.split("\n") for g in line.split("|") if g.strip()]
    return {name: own[0] for own in groups for name in own}


def canonical(tag: Column) -> Column:
    """The two-letter code of "en", "eng", "en-US", "EN_us" or "English"; another tag of two or three letters stays, in lower
    case; und for anything else."""
    first = F.element_at(F.split(F.lower(F.trim(F.replace(tag, F.lit("_"), F.lit("-")))), "-"), 1)
    known = F.create_map(*(F.lit(x) for item in sorted(tags().items()) for x in item))
    return F.coalesce(F.element_at(known, first), F.when(first.rlike("^[a-z]{2,3}$"), first), F.lit(UNKNOWN))


def _letters(text: str) -> Column:
    """The words of a text, runs of letters in lower case, with spaces between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def _number(gram: str) -> int:
    """Letters side by side, the first one highest: numbers are in the order of their n-grams, and none is 0."""
    return sum(ord(c) << BITS * (LONGEST - 1 - i) for i, c in enumerate(gram))


def _gram(number: int) -> str:
    return "".join(chr(c) for i in range(LONGEST) if (c := number >> BITS * (LONGEST - 1 - i) & (1 << BITS) - 1))


def counted(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the n-grams of up to LONGEST letters of a text's words, with marks at the words' ends, in order; and how
    often each is there."""
    if not letters:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p = np.frombuffer((MARK + letters.replace(" ", MARK * 2) + MARK).encode("utf-32-le"), "<u4").astype(np.int64)
    # neither a mark alone nor what reaches over two marks, from a word to the next, is an n-gram: 0
    within, grams, found = p != ord(MARK), p << BITS * (LONGEST - 1), []
    found.append(grams * within)
    for k in range(1, LONGEST):
        within = within[:-1] | within[1:] if k == 1 else within[:-1] & within[1:]
        grams = grams[:-1] | p[k:] << BITS * (LONGEST - 1 - k)
        found.append(grams * within)
    own = np.concatenate(found)
    own.sort()
    at = np.flatnonzero(own[1:] != own[:-1]) + 1  # the zeros are first
    return own[at], np.diff(at, append=len(own))


def ranked(letters: str, most: int = RANKS) -> np.ndarray:
    """The numbers of a text's `most` most frequent n-grams, the most frequent first, ties in order of the n-gram."""
    own, n = counted(letters)
    return own[np.argsort(-n, kind="stable")[:most]]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    sums = np.zeros(len(own), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return own, sums


def profiles(labelled: DataFrame, lang: str = "lang", text: str = "text", most: int = RANKS) -> DataFrame:
    """(lang, gram, rank) of all texts of each language; rows without a language are left out. Languages are few, and a task
    holds what different n-grams they have."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0
        for rows in batches:
            for own, letters in zip(rows["lang"], rows["letters"], strict=True):
                sums.setdefault(own, []).append(found := counted(letters))
                waiting += len(found[0])
                if waiting > COUNTS_AT_ONCE:
                    sums, waiting = {k: [_summed(parts)] for k, parts in sums.items()}, 0
        for own, parts in sums.items():
            grams, n = _summed(parts)
            if len(grams):
                yield pd.DataFrame({"lang": own, "gram": list(map(_gram, grams.tolist())), "n": n})

    parts = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _letters(text).alias("letters")).mapInPandas(count, "lang string, gram string, n long")
    counts = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("lang", "gram", "rank")


class Profiles:
    """What is known of a few languages, by n-gram."""

    def __init__(self, known: list[tuple[str, str, int]], most: int):
        own = sorted((_number(gram), lang, rank) for lang, gram, rank in known if lang is not None and 0 < len(gram) <= LONGEST)
        self.most, self.langs = most, sorted({lang for _, lang, _ in own})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.grams, self.lang, self.rank = (np.array(x, np.int64) for x in ([x[0] for x in own], [place[x[1]] for x in own], [x[2] for x in own]))

    def nearest(self, grams: np.ndarray) -> tuple[str | None, int]:
        """The nearest language of ranked n-grams, ties to the smaller code, and how near it is; none if no n-gram is near."""
        first, last = (np.searchsorted(self.grams, grams, side) for side in ("left", "right"))
        n = last - first
        met = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = np.maximum(0, self.most - np.abs(np.repeat(np.arange(1, len(grams) + 1), n) - self.rank[met]))
        sums = np.bincount(self.lang[met], near, len(self.langs))
        return (self.langs[sums.argmax()], int(sums.max())) if sums.any() else (None, 0)


def detected(docs: DataFrame, known: DataFrame, ident: str = "doc_id", text: str = "text", most: int = RANKS) -> DataFrame:
    """(ident, language, confidence): the language of each text by `known` (lang, gram, rank), ties to the smaller code, and
    one less its distance as a share of the largest possible. ident is distinct.

    A text with fewer than LEAST_GRAMS different n-grams, or none in common with any profile, gets the language of its
    script, with confidence 0: und for Latin letters. A text meets the profiles in its row; those of so many languages that
    they can't be broadcast are joined with the texts' ranked n-grams.
    """
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(ident, script_language(F.coalesce(text, F.lit(""))).alias("_script"), _letters(text).alias("letters"))
    few = known.select("lang", "gram", "rank").limit(FEW + 1).collect()
    if len(few) <= FEW:
        own = Profiles([tuple(r) for r in few], most)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = [ranked(x, most) for x in batch.column("letters").to_pylist()]
                found = list(map(own.nearest, grams))
                columns = [pa.array([len(x) for x in grams], pa.int32()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(ident), batch.column("_script"), *columns], [ident, "_script", "_n", "lang", "_near"])

        best = rows.mapInArrow(meet, f"`{ident}` {kind}, _script string, _n int, lang string, _near long")
    else:
        best = _joined(rows, known, ident, kind, most)
    sure = (F.col("_n") >= LEAST_GRAMS) & (F.col("_near") > 0)
    return best.select(ident, F.when(sure, F.col("lang")).otherwise(F.col("_script")).alias("language"), F.when(sure, F.col("_near") / (F.col("_n") * most)).otherwise(0.0).alias("confidence"))


def _joined(rows: DataFrame, known: DataFrame, ident: str, kind: str, most: int) -> DataFrame:
    """(ident, _script, _n, lang, _near) by a join; what a text's n-grams add up to for each language is summed before it is
    dealt out."""

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[i : i + ROWS_AT_ONCE]
                yield part[[ident, "_script"]].assign(_grams=[list(map(_gram, ranked(x, most).tolist())) for x in part["letters"]])

    own = rows.mapInPandas(rank, f"`{ident}` {kind}, _script string, _grams array<string>")
    met = own.select(ident, "_script", F.size("_grams").alias("_n"), F.posexplode_outer("_grams").alias("_at", "gram")).join(small(known.withColumnRenamed("rank", "_there")), "gram", "left")
    near = F.lit(most) - F.least(F.lit(most), F.abs(F.col("_at") + 1 - F.col("_there")))
    summed = met.groupBy(ident, "_script", "_n", "lang").agg(F.coalesce(F.sum(near), F.lit(0)).alias("_near"))
    best = summed.groupBy(ident, "_script", "_n").agg(F.min(F.struct((-F.col("_near")).alias("far"), F.col("lang").isNull().alias("none"), "lang")).alias("b"))
    return best.select(ident, "_script", "_n", F.col("b.lang").alias("lang"), (-F.col("b.far")).alias("_near"))


def prepared(questions: DataFrame, known: DataFrame, target: Column | None = None, translations: DataFrame | None = None) -> DataFrame:
    """(query_id, original, language, confidence, text, translated, target, text_language) of questions (query_id, question).

    language is that of the question as it was asked. Where results are wanted in another language (`target`, a tag) and
    `translations` (query_id, target, text) has a text of that language that is not blank and not the question itself, that
    is what is searched. A null question is a blank one.
    """
    own = step(questions.select("query_id", F.coalesce("question", F.lit("")).alias("original"), (canonical(target) if target is not None else F.lit(None).cast("string")).alias("target")))
    found = detected(own.select("query_id", normal(F.col("original")).alias("text")), known, "query_id")
    rows = own.join(found, "query_id")
    new = F.lit(None).cast("string")
    if translations is not None:
        rows = rows.join(translations.select("query_id", canonical(F.col("target")).alias("target"), F.col("text").alias("_new")), ["query_id", "target"], "left")
        new = F.when((F.col("target") != F.col("language")) & (F.trim("original") != "") & (F.trim("_new") != "") & (F.col("_new") != F.col("original")), F.col("_new"))
    return rows.select("query_id", "original", "language", "confidence", F.coalesce(new, F.col("original")).alias("text"), new.isNotNull().alias("translated"), "target", F.when(new.isNotNull(), F.col("target")).otherwise(F.col("language")).alias("text_language"))

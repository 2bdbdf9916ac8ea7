"""Language identification of mixed-language text.

A model of hashed letter n-grams gives each word a log probability for each language. The script of a word (by code
point ranges) leaves only languages that were seen in it. Viterbi over the words of a text, with a penalty for each
switch, labels spans; the language with most letters is that of the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import spread
from .common import free_name, held_out, learned, table
from .sampling import per_class

UNKNOWN = "und"
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
#: Nats that a switch of language costs; a word speaks against a language by this many nats at most.
SWITCH, FLOOR = 6.0, 8.0
#: A text of few n-grams may be this far off, over the square root of their number.
BRIEF = 8.0
#: Share of a language's letters from which on a script counts as one of its own.
SCRIPT_SHARE = 0.01
#: Documents of each language that the model is fitted on, at most.
FIT_DOCS = 2_000
#: Bytes of texts that a task parses at once.
CHARS_AT_ONCE = 2_000_000
#: First and last code points of scripts, by number; letters elsewhere have number 0.
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("gurmukhi", [(0xA00, 0xA7F)]),
    ("gujarati", [(0xA80, 0xAFF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("telugu", [(0xC00, 0xC7F)]),
    ("kannada", [(0xC80, 0xCFF)]),
    ("malayalam", [(0xD00, 0xD7F)]),
    ("sinhala", [(0xD80, 0xDFF)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("lao", [(0xE80, 0xEFF)]),
    ("tibetan", [(0xF00, 0xFFF)]),
    ("myanmar", [(0x1000, 0x109F)]),
    ("georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("ethiopic", [(0x1200, 0x137F)]),
    ("khmer", [(0x1780, 0x17FF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]


@cache
def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point whether it is a letter or a mark on one, the number of its script, and whether it is a letter."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter, strict = np.array([k in "LM" for k in kinds]), np.array([k == "L" for k in kinds])
    script = np.zeros(0x110000, np.uint8)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            script[first : last + 1] = number
    return letter, script, strict


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the letters of all words, number of letters of each)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    each = np.fromiter(map(len, words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), each)
    keep = _code_points()[0][codes]
    return codes[keep], np.bincount(of[keep], minlength=len(words))


def grams(codes: np.ndarray, each: np.ndarray, lengths: tuple[int, ...] = SIZES, room: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of all n-grams of all words; a word has a border before and after."""
    has = np.flatnonzero(each)
    sizes = each[has] + 2
    starts = np.cumsum(sizes) - sizes
    padded = np.full(int(sizes.sum()), 1, np.uint64)
    padded[np.arange(len(codes)) + np.repeat(2 * np.arange(len(has)) + 1, each[has])] = codes
    word = np.repeat(has, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(padded))
    key, buckets, words = np.zeros(len(padded), np.uint64), [], []
    with np.errstate(over="ignore"):
        for n in range(1, max(lengths) + 1):
            ahead = np.r_[padded[n - 1 :], np.zeros(min(n - 1, len(padded)), np.uint64)][: len(padded)]
            key = (key ^ ahead) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            if n in lengths:
                fits = left >= n
                buckets.append(((key[fits] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % room)
                words.append(word[fits])
    return np.concatenate(buckets), np.concatenate(words)


def parsed_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all words, number of letters of each, and bucket and word of all their n-grams)."""
    codes, each = _letters(words)
    return codes, each, *(grams(codes, each) if len(codes) else (np.empty(0, np.int64),) * 2)


def _distinct(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words in lower case, where each word of the texts is among them, number of words of each text)."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    own = split.flatten().dictionary_encode()
    return own.dictionary.to_pylist(), own.indices.to_numpy(zero_copy_only=False), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHARS_AT_ONCE, "right")))
        yield start, stop
        start = stop


class Model:
    """Log probabilities of n-gram buckets, and the scripts, of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        log = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))
        self.log = np.ascontiguousarray((log - log.max(0)).T.astype(np.float32))
        self.top = log.max(0).astype(np.float32)
        # mean and spread of the log probability of an n-gram of each language's own labelled texts
        own = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        self.mean = (own * log).sum(1)
        self.spread = np.maximum(np.sqrt((own * (log - self.mean[:, None]) ** 2).sum(1)), 1e-9)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.seen = (share >= SCRIPT_SHARE).T  # script x language

    def scores(self, words: list[str], parsed: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log posterior of each word and language, its number of letters, whether any language has its script).

        Marks count in n-grams only: a word of nothing else has no letters. A word's script is that of its first letter."""
        codes, each, buckets, of = parsed or parsed_words(words)
        letters = np.bincount(np.repeat(np.arange(len(words)), each), _code_points()[2][codes], len(words)).astype(np.int64)
        total = np.zeros((len(words), len(self.languages)), np.float64)
        script = np.zeros(len(words), np.int64)
        if len(codes):
            for i in range(len(self.languages)):
                total[:, i] = np.bincount(of, self.log[buckets, i], minlength=len(words))
            has = np.flatnonzero(each)
            script[has] = _code_points()[1][codes[np.cumsum(each[has]) - each[has]]]
        allowed = self.seen[script]
        known = allowed.any(1) & (letters > 0)
        total = np.where(allowed, total, -1e9)
        total -= total.max(1, keepdims=True)
        total -= np.log(np.exp(total).sum(1, keepdims=True))
        return np.where(known[:, None], np.maximum(total, -FLOOR), 0.0).astype(np.float32), letters, known

    def surprise(self, words: list[str], parsed: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(by how many spreads the n-grams of each word fall below each language's mean, summed; their number)."""
        codes, _, buckets, of = parsed or parsed_words(words)
        if not len(codes):
            return np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        n = np.bincount(of, minlength=len(words))
        top = np.bincount(of, self.top[buckets], minlength=len(words))
        found = np.stack([np.bincount(of, self.log[buckets, i], minlength=len(words)) for i in range(len(self.languages))], 1)
        return (n[:, None] * self.mean - top[:, None] - found) / self.spread, n


def viterbi(emission: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of each word. emission: rows of all texts, one after another; the texts go forward together."""
    labels = np.zeros(len(emission), np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    width = emission.shape[1]
    back = np.zeros((len(emission), width), np.uint8 if width < 256 else np.uint16)
    best, here = np.zeros((len(lengths), width), np.float32), np.arange(width)
    active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")  # texts longer than each place
    for t, n in enumerate(active):
        at = starts[:n] + t
        v = best[:n]
        top = v.argmax(1)
        other = v[np.arange(n), top] - penalty
        stay = v >= other[:, None]
        back[at] = np.where(stay, here, top[:, None])
        best[:n] = np.where(stay, v, other[:, None]) + emission[at]
    last = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = last[:n]
        last[:n] = back[at, last[:n]]
    return labels


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = FIT_DOCS, seed: str = "language") -> Model | None:
    """From about `most` texts of each language at most. Counting is spread over tasks; the driver gets a row for each
    language and bucket that occurs."""
    chosen = per_class(labelled.select(id_col, lang_col, text_col).filter(F.col(lang_col).isNotNull()), id_col, lang_col, most, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = pc.fill_null(batch.column(0), ""), batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang))
                for x, y in _slices(own):
                    words, at, _ = _distinct(own.slice(x, y - x))
                    codes, each = _letters(words)
                    if not len(codes):
                        continue
                    times = np.bincount(at, minlength=len(words))
                    buckets, of = grams(codes, each)
                    sums = np.bincount(buckets, times[of], minlength=BUCKETS)
                    scripts = np.bincount(_code_points()[1][codes], np.repeat(times, each), minlength=len(SCRIPTS) + 1)
                    for first, values in ((0, sums), (BUCKETS, scripts)):
                        some = np.flatnonzero(values)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some + first), pa.array(values[some].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = chosen.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    if not names:
        return None
    number = np.array([names.index(x) for x in rows.column("lang").to_pylist()])
    cells = np.zeros((len(names), BUCKETS + len(SCRIPTS) + 1))
    cells[number, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(names, cells[:, :BUCKETS], cells[:, BUCKETS:])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", spans: bool = False, keep_text: bool = True, misfit: bool = False) -> DataFrame:
    """All rows of `docs` with lang_pred and score, and with `spans` an array of (lang, words) along the text.
    With `misfit` also how far the words in known scripts are from labelled texts of the languages they were given: the
    mean distance of their n-grams below its mean, in spreads, less BRIEF / sqrt(number of n-grams).
    Without `keep_text` the text is left out.

    score is the share of the text's letters that are in words of lang_pred whose script some language has; a text
    in unknown scripts has score 0. Null texts, texts without letters, and all texts if nothing was learned, are
    `und` with score 0. Of languages with as many letters the first by name is taken. A run without white space, also of
    a script that has none, is one word, and its script is that of its first letter. Very long texts are labelled whole.
    Columns of `docs` with the names of added ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "spans", *["misfit"] * misfit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns if keep_text else [c for c in docs.columns if c != text_col]
    # a text that is kept goes to the worker once
    once = keep_text and dict(docs.dtypes).get(text_col) == "string"
    place, before = (columns.index(text_col), 0) if once else (0, 1)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def of_slice(texts: pa.Array) -> tuple[list, np.ndarray, list | None, np.ndarray]:
        model, n = shared.value, len(texts)
        if model is None:
            return [UNKNOWN] * n, np.zeros(n), [[]] * n if spans else None, np.zeros(n)
        words, at, lengths = _distinct(texts)
        parsed = parsed_words(words)
        emission, letters, known = model.scores(words, parsed)
        labels = viterbi(emission[at], lengths)
        text = np.repeat(np.arange(n), lengths)
        width = len(model.languages)
        each = np.bincount(text * width + labels, letters[at] * known[at], minlength=n * width).reshape(n, width)
        total = np.bincount(text, letters[at], minlength=n)
        best = each.argmax(1)
        score = np.where(total > 0, each[np.arange(n), best] / np.maximum(total, 1), 0.0)
        names = [model.languages[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)]
        parts = None
        if spans:
            parts, ends = [], np.cumsum(lengths)
            for x, y in zip(ends - lengths, ends, strict=True):
                cuts = np.flatnonzero(np.r_[True, labels[x + 1 : y] != labels[x : y - 1], True]) if y > x else np.zeros(1, int)
                parts.append([{"lang": model.languages[labels[x + a]], "words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        far = np.zeros(n)
        if misfit:
            surprise, size = model.surprise(words, parsed)
            sizes = np.bincount(text, size[at] * known[at], minlength=n)
            far = np.bincount(text, surprise[at, labels] * known[at], minlength=n) / np.maximum(sizes, 1)
            far = np.where(sizes > 0, far - BRIEF / np.sqrt(np.maximum(sizes, 1)), 0.0)
        return names, score, parts, far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(place), "")
            for x, y in _slices(texts):
                names, score, parts, far = of_slice(texts.slice(x, y - x))
                out = [*(c.slice(x, y - x) for c in batch.columns[before:]), pa.array(names, pa.string()), pa.array(score)]
                out += ([pa.array(parts, span_type)] if spans else []) + ([pa.array(far)] if misfit else [])
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "lang_pred", "score", *["spans"] * spans, *["misfit"] * misfit])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    schema = f"{fields}, lang_pred string, score double" + ", spans array<struct<lang:string,words:bigint>>" * spans + ", misfit double" * misfit
    text = [] if once else [F.col(text_col).cast("string").alias(free_name("_text", columns))]
    return docs.select(*text, *columns).mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = fit(docs.filter(learned()), "doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Quality classification by random Fourier features over document statistics.

Statistics of a document are scaled, mapped to cosines whose inner products approximate a Gaussian kernel, and fitted
by ridge regression: every partition sums its part of the normal equations, and partitions' sums are added in a tree.
Isotonic regression makes scores probabilities, from a histogram of the scores that each half of the rows gets from the
equations of the other half.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import spread
from .common import Written, free_name, held_out, learned, table, written

WIDTH, GAMMA, RIDGE, BINS = 384, 0.06, 1e-3, 4_000
#: The normal equations are summed by half of the rows.
FOLDS = 2
NAMES = ("log_words", "upper", "punctuation", "digits", "white", "pipes", "sentence_marks", "mean_word", "marked_words", "distinct_words", "top_word", "repeated_next", "distinct_lines", "short_lines", "packed", "log_lines")
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*+/<=>@^_`~\\{}[]()!?\"';:-", b"0123456789", b" \t\n\r\x0b\x0c", b"|", b".,"), 1):
    _KIND[list(_bytes)] = _kind
_ENDS = frozenset("!#$%&*+/<=>@^_`~|\\")


def statistics(text: str | None) -> list[float]:
    """As named in NAMES, of the whole text; zeros for a null or blank text. The share of the most frequent word says nothing
    below 9 words, nor does compression below 65 bytes: they are constants there (0.15 and 0.6, about their means)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    n = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    marked = sum(c for w, c in counts.items() if w[-1] in _ENDS)
    following = sum(map(str.__eq__, words, words[1:]))
    packed = len(compress(raw, 1)) / len(raw) if len(raw) > 64 else 0.6
    return [
        float(np.log1p(n)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], min(40.0, len(text) / n), marked / n,
        len(counts) / n**0.85, max(counts.values()) / n if n > 8 else 0.15, following / n, len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), packed, float(np.log1p(len(lines))),
    ]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without the text, with _x: the statistics of the whole text."""
    keep = [c for c in docs.columns if c not in (text_col, "_x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([statistics(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))], names=[*keep, "_x"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(F.col(text_col).cast("string").alias(free_name("_text", keep)), *keep).mapInArrow(run, ", ".join([*fields, "_x array<double>"]))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def _sums(df: DataFrame, of_batch, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of of_batch(statistics, labels, folds) over all rows: summed in each task, then in about the square root of as
    many, whose sums reach the driver one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_matrix(batch.column(0)), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    tasks = df.select("_x", F.col("label").cast("double"), F.col("fold").cast("int")).mapInArrow(run, "sums binary")
    fewer = math.isqrt(max(1, df.rdd.getNumPartitions()))
    total = np.zeros(shape)
    for row in tasks.repartition(fewer).mapInArrow(add, "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"]).reshape(shape)
    return total


def isotonic(positives: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-decreasing rates closest to positives / counts, weighted by counts (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for p, c in zip(positives, counts, strict=True):
        blocks.append([float(p), float(c), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), p / c if c else 0.0) for p, c, n in blocks]) if blocks else np.empty(0)


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = random.standard_normal((len(NAMES), WIDTH)) * np.sqrt(2 * GAMMA)
        self.b = random.uniform(0, 2 * np.pi, WIDTH)
        self.weights, self.at, self.rate = np.zeros(WIDTH + 1), np.zeros(1), np.zeros(1)

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.cos(z @ self.w + self.b) * np.sqrt(2 / WIDTH), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.rate)


def solved(sums: np.ndarray, n: float) -> np.ndarray:
    """Ridge weights from summed normal equations (products of the mapped rows, and with their labels) of n rows."""
    ridge = RIDGE * np.diag(np.r_[np.ones(len(sums) - 1), 0]) / (len(sums) - 1)
    return np.linalg.solve(sums[:, :-1] / n + ridge + 1e-12 * np.eye(len(sums)), sums[:, -1] / n)


def fit(rows: DataFrame, seed: int = 3) -> Model | float:
    """From rows with _x, label (0 or 1) and fold (0 or 1), over all of them; the share of label 1 if a class is absent.

    The driver gets matrices one after another, and a histogram of BINS bins.
    """
    moments = _sums(rows, lambda x, y, fold: np.stack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], len(x)), np.full(x.shape[1], y.sum())]), (4, len(NAMES)))
    n, ones = moments[2, 0], moments[3, 0]
    if n == 0 or ones in (0, n):
        return float(ones / n) if n else 0.0
    mean = moments[0] / n
    model = Model(mean, np.sqrt(np.maximum(moments[1] / n - mean**2, 1e-8)), seed)

    def equations(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z, own = model.map(x), np.zeros((FOLDS, WIDTH + 1, WIDTH + 2))
        for f in range(FOLDS):
            of = z[fold == f]
            own[f] = np.c_[of.T @ of, of.T @ y[fold == f]]
        return own

    sums = _sums(rows, equations, (FOLDS, WIDTH + 1, WIDTH + 2))
    sizes = sums[:, -1, -2]  # the last feature is 1
    model.weights = solved(sums.sum(0), n)
    # what a fold is scored with: the equations of the others
    apart = [solved(sums.sum(0) - sums[f], n - sizes[f]) if 0 < sizes[f] < n else model.weights for f in range(FOLDS)]
    low, high = -0.5, 1.5

    def histogram(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        raw = np.einsum("ij,ij->i", model.map(x), np.stack(apart)[fold])
        place = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(place, y, BINS), np.bincount(place, minlength=BINS)])

    positives, counts = _sums(rows, histogram, (2, BINS))
    used = np.flatnonzero(counts)
    model.at, model.rate = low + (used + 0.5) * (high - low) / BINS, isotonic(positives[used], counts[used])
    return model


def score(rows: DataFrame, model: Model | float) -> DataFrame:
    """Rows with _x, which is replaced by score (0 to 1)."""
    if not isinstance(model, Model):
        return rows.drop("_x").withColumn("score", F.lit(float(model)))
    keep = [c for c in rows.columns if c not in ("_x", "score")]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(_matrix(batch.column(0))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*keep, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    return rows.select("_x", *keep).mapInArrow(run, ", ".join([*fields, "score double"]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """All rows of `docs` without the text, with score: the probability of label 1.

    Statistics are taken of every whole text and written once; null and empty texts have zeros and a score like others.
    Labels other than 0 and 1 are ignored. Repeated identifiers count once for each row.
    """
    rows = written(measured(docs, text_col))
    own = labels.filter(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(FOLDS)).alias("fold")
    labelled = Written(rows.select(id_col, "_x").join(own, id_col).select("_x", "label", fold))
    return score(rows, fit(labelled.df))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), table(spark, sf_dir, "labels")
    return classify(docs, labels.filter(learned())).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on toxic text. A window of a few words is
compressed with the ordinary dictionary alone, and with the toxic one behind it, so that ordinary words cost the same in
both; what the second saves is the window's distance from ordinary text. A document's largest savings, and the number of its
windows, are calibrated to a probability.

Labels mark documents, few words of which are toxic. So letter n-grams that occur in many more toxic documents than ordinary
ones pick the words whose surroundings train the toxic dictionary, and ordinary windows that it shortens go on the ordinary
one. All draws go by digests and all sums are of whole numbers, so the same rows give the same model on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import spread
from .common import Written, free_name, held_out, learned, shuffle_partitions, small_side, table
from .language import _distinct, _letters, _slices, grams
from .sampling import chance, per_class

#: The fit is on a bounded sample: documents of each class, at most; of them ordinary documents that train the dictionary,
#: and windows of each at most, spread over its whole text; pieces that train the toxic dictionary, n-grams that pick them,
#: and windows that go on the ordinary one, at most.
FIT_DOCS, ORDINARY_DOCS, TEXT_WINDOWS, TOXIC_PIECES, MOST_GRAMS, MOST_WINDOWS = 3_000, 1_000, 200, 40_000, 50_000, 400
WINDOW = 8
#: Of zstandard: tables that hold the whole dictionary, and matches of six bytes at least, since shorter ones are chance.
SEARCH = {"window_log": 16, "hash_log": 16, "chain_log": 16, "search_log": 6, "min_match": 6, "strategy": zstandard.STRATEGY_LAZY}
#: Bytes of the dictionaries; segments and matches of the trainer.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, MATCH = 16_384, 8_192, 16, 6
GRAM_SIZES, GRAM_BUCKETS = (4, 5, 6), 1 << 22
#: A toxic word has an n-gram in at least so many toxic documents and this share of them, with these log odds of toxic
#: against ordinary ones.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 5, 0.006, 3.0
#: Bytes by which a window must be shorter to count as toxic.
CLEAR = 4


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), WINDOW)]


class Distance:
    """Bytes by which the toxic dictionary shortens a window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.sizes = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "sizes": None}

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        if self.sizes is None:
            raw = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.ordinary + self.toxic, self.ordinary)]
            how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
            self.sizes = [zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress for d in raw]
        near, far = self.sizes
        return np.fromiter((len(far(p)) - len(near(p)) for p in parts), np.int64, len(parts))


#: Differences from which on windows are counted, as features.
STEPS = (2, 3, 4, 5, 6, 8)
FEATURES = 3 + 2 * len(STEPS)


def features(differences: np.ndarray) -> list[float]:
    """Largest difference, the second, the number of windows (log), and of those from each step on, the number and share
    (logs)."""
    n = len(differences)
    if not n:
        return [0.0] * FEATURES
    top = np.sort(differences)[-2:]
    reach = (differences[:, None] >= STEPS).sum(0)
    return [float(top[-1]), float(top[0]) if n > 1 else 0.0, float(np.log1p(n)), *np.log1p(reach).tolist(), *np.log((reach + 0.1) / n).tolist()]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last), by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, weight = np.zeros(z.shape[1]), weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * len(x) * np.r_[w[:-1], 0]
        curve = (z.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ z + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _expand(x: np.ndarray) -> np.ndarray:
    """The features and whether the largest differences reach each of a few sizes."""
    steps = np.arange(2, 9)
    return np.c_[x, x[:, :1] >= steps, x[:, 1:2] >= steps]


class Model:
    def __init__(self, distance: Distance, calibration: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.distance, self.calibration = distance, calibration

    def scores(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w = self.calibration
        return 1 / (1 + np.exp(-np.clip(((_expand(x) - mean) / scale) @ w[:-1] + w[-1], -30, 30)))


def _evidence(sample: DataFrame, toxic: int, ordinary: int) -> np.ndarray:
    """Buckets of n-grams that are peculiar to toxic documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = pc.fill_null(batch.column(0), ""), batch.column(1).to_numpy(zero_copy_only=False)
            for x, y in _slices(texts):
                words, at, lengths = _distinct(texts.slice(x, y - x))
                codes, each = _letters(words)
                if not len(codes):
                    continue
                buckets, of = grams(codes, each, GRAM_SIZES, GRAM_BUCKETS)
                edges = np.searchsorted(of, np.arange(len(words) + 1))
                ends = np.cumsum(lengths)
                for i in range(y - x):
                    own = np.unique(at[ends[i] - lengths[i] : ends[i]])
                    got = np.unique(np.concatenate([buckets[edges[w] : edges[w + 1]] for w in own])) if len(own) else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(np.full(len(got), labels[x + i], np.int64))], names=["bucket", "label"])

    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (ordinary + 1))
    counted = sample.select("text", "label").mapInArrow(count, "bucket long, label long").groupBy("bucket").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
    rows = counted.filter(F.col("t") >= max(LEAST_DOCS, LEAST_SHARE * toxic)).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(F.col("odds").desc(), "bucket").limit(MOST_GRAMS)
    return np.sort(np.array([r["bucket"] for r in rows.select("bucket").collect()], np.int64))


def toxic_pieces(texts: pa.Array, wanted: np.ndarray) -> list[bytes]:
    """Words of the texts that have a wanted n-gram, in lower case between spaces, as often as they occur."""
    words, at, _ = _distinct(texts)
    codes, each = _letters(words)
    if not len(codes):
        return []
    buckets, of = grams(codes, each, GRAM_SIZES, GRAM_BUCKETS)
    some = np.zeros(len(words), bool)
    some[of[np.isin(buckets, wanted)]] = True
    named = [f" {''.join(c for c in w if c.isalpha())} ".encode("utf-8", "surrogatepass") if s else b"" for w, s in zip(words, some, strict=True)]
    return [named[i] for i in at[some[at]]]


def trained(pieces: list[bytes], size: int) -> bytes:
    """A dictionary of pieces in the given order; their end if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces, k=SEGMENT, d=MATCH).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-size:]


def _pieces(rows: DataFrame, of_texts, most: int) -> list[bytes]:
    """of_texts(texts) over all rows: equal ones are counted first; about `most` different ones drawn by digest, in order,
    each as often as it occurs, by up to `most` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for x, y in _slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(of_texts(texts.slice(x, y - x)), pa.binary())], names=["w"])

    counted = rows.select("text").mapInArrow(run, "w binary").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = [(bytes(r["w"]), r["n"]) for r in counted.orderBy(F.md5("w"), "w").limit(most).collect()]
    share = min(1.0, most / max(1, sum(n for _, n in found)))
    # mixed: the trainer goes on from part to part until it finds nothing new in a few of them
    mixed = sorted((blake2b(w + i.to_bytes(4, "little"), digest_size=8).digest(), w) for w, n in found for i in range(max(1, int(n * share))))
    return [w for _, w in mixed]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_DOCS, seed: str = "toxicity") -> Model | float:
    """From about `most` labelled documents of each class at most; the share of toxic labels if a class has none.

    The sample is written once, and copies in it count once. The driver gets pieces, windows and features of it only.
    """
    own = labels.filter(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("long").alias("label"))
    classes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if len(classes) < 2:
        return float(next(iter(classes), 0))
    chosen = small_side(Written(per_class(own, id_col, "label", most, seed)).df)
    once = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(chosen, id_col).groupBy("text", "label").agg(F.min(id_col).alias("_id"))
    sample = Written(once.repartition(shuffle_partitions(docs.sparkSession), "_id")).df
    found = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(found) < 2:
        return classes[1] / sum(classes.values())
    wanted = _evidence(sample, found[1], found[0])
    toxic = trained(_pieces(sample.filter("label = 1"), lambda texts: toxic_pieces(texts, wanted), TOXIC_PIECES), TOXIC_BYTES) if len(wanted) else b" "
    ordinary_rows = sample.filter("label = 0")

    def spread(texts: pa.Array) -> list[bytes]:
        return [w for own in map(windows, texts.to_pylist()) for w in own[:: max(1, -(-len(own) // TEXT_WINDOWS))]]

    drawn = ordinary_rows.filter(chance("_id", f"{seed}-ordinary") * found[0] < float(ORDINARY_DOCS))
    ordinary = trained(_pieces(drawn, spread, ORDINARY_DOCS * TEXT_WINDOWS), ORDINARY_BYTES)
    first = Distance(ordinary, toxic)

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts = windows(text or "")
                got = first(parts)
                some = np.flatnonzero(got >= CLEAR)
                yield pa.RecordBatch.from_arrays([pa.array([parts[i] for i in some], pa.binary()), pa.array(got[some])], names=["w", "d"])

    hard = ordinary_rows.select("text").mapInArrow(shortened, "w binary, d long").groupBy("w").agg(F.max("d").alias("d")).orderBy(F.col("d").desc(), "w").limit(MOST_WINDOWS).collect()
    distance = Distance(ordinary + b"".join(bytes(r["w"]) for r in hard), toxic)
    rows = sorted((r["label"], r["_x"]) for r in measured(sample, distance, "text", ["label"]).collect())
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    weight = np.where(y == 1, classes[1] / found[1], classes[0] / found[0])
    return Model(distance, logistic(_expand(x), y, weight))


def measured(docs: DataFrame, distance: Distance, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and _x, the features of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(distance(windows(t.as_py() or ""))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "_x"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(F.col(text_col).cast("string").alias(free_name("_text", keep)), *keep).mapInArrow(run, ", ".join([*fields, "_x array<double>"]))


def score(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """All rows of `docs` without the text, with score (0 to 1). Null and empty texts have no windows and get the
    score of that. If a class had no labels, every score is the share of toxic labels."""
    keep = [c for c in docs.columns if c not in (text_col, "score")]
    if not isinstance(model, Model):
        return docs.select(*keep, F.lit(float(model)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = np.array([features(own.distance(windows(t.as_py() or ""))) for t in batch.column(0)]).reshape(batch.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own.scores(x))], names=[*keep, "score"])

    return docs.select(F.col(text_col).cast("string").alias(free_name("_text", keep)), *keep).mapInArrow(run, ", ".join([*fields, "score double"]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(learned()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

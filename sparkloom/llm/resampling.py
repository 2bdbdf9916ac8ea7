"""Resampling documents towards a target's distribution of words.

Features are runs of words, hashed to buckets. A bucket's gain is the logarithm of its smoothed frequency in the target over
that in the documents, in thousandths; a document's weight sums the gains of its features, which tasks look up in an array.
Weights with Gumbel noise, a digest of the identifier, are scores, so that the highest ones are a draw without replacement
with probabilities in proportion to the weights' exponentials.

The draw merges sorted runs. Every partition sorts its eligible rows (Spark's external sort), cuts the run where sampled
splitters of all rows fall, and writes it as blocks of keys. The rows of each range are counted; ranges that begin after the
draw's end are left where they are. The others are dealt to one task each, in which a tournament tree merges the runs' blocks
and stops at the exact count; the rows of the ranges before make its positions ranks.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.taskcontext import TaskContext

from ..steps import spread
from .common import Written, shuffle_partitions, table, written
from .keyed import and_end
from .terms import in_slices, splitter, words

BUCKETS, LEAST_WORDS, PERCENT = 10_000, 20, 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BYTES_AT_ONCE = 1 << 23
#: Rows of a range in the mean, which a task merges in memory (24 bytes each), rows sampled for each, and rows of a block.
RANGE_ROWS, SAMPLE_PER_RANGE, BLOCK_ROWS = 1 << 17, 10, 1 << 12
#: Orders rows without an identifier after all others.
LAST = (1 << 63) - 1


def features(texts: pa.Array, longest: int, buckets: int, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text's place, number of words of each text). Runs are hashed word by word, each distinct
    continuation once."""
    own, each = words(texts, split)
    names = [w.as_py() for w in own.dictionary.cast(pa.binary())]
    codes, of = own.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(each)), each)
    crc = np.array([zlib.crc32(w) for w in names], np.int64)[codes] if names else np.empty(0, np.int64)
    hashes, places, starts = [crc], [of], np.arange(len(codes))
    for n in range(1, longest):
        starts = starts[starts + n < len(codes)]
        starts = starts[of[starts] == of[starts + n]]
        pair, at = np.unique(crc[starts] << 31 | codes[starts + n], return_inverse=True)
        crc = crc.copy()
        crc[starts] = np.array([zlib.crc32(b" " + names[p & 0x7FFFFFFF], p >> 31) for p in pair.tolist()], np.int64)[at] if len(pair) else 0
        hashes.append(crc[starts])
        places.append(of[starts])
    return np.concatenate(hashes) % buckets, np.concatenate(places), each


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts (text) each bucket has; the driver gets this array, whatever the table's size."""
    split = splitter(SEPARATORS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in in_slices(batches, 0, BYTES_AT_ONCE):
            sums += np.bincount(features(batch.column(0), longest, buckets, split)[0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for bucket, n in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        sums[bucket] = n
    return sums


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of B buckets, with counts s of S and t of T."""
    size, every, wanted = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (every + size) / ((s + 1) * (wanted + size)))) for s, t in zip(own.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(id_col: str, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) of a digest u of the identifier (null: of none)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


class Tournament:
    """Merges sorted runs: a tree of losers, in which the winner's successor replays one path. Runs are read as they win."""

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self.runs, k = list(runs), len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers, winners = [0] * k, [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x <= y)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            node = (self.winner + k) // 2
            while node:
                if self._before(self.losers[node], self.winner):
                    self.winner, self.losers[node] = self.losers[node], self.winner
                node //= 2


def _keys(block: bytes) -> Iterator[tuple]:
    return zip(*np.frombuffer(block, np.int64).reshape(3, -1).tolist(), strict=True)


def drawn(rows: DataFrame, count: int, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, row, rank) of the `count` first rows in ascending order. rows: (a, b, row), whole numbers without nulls, row
    distinct; all rows of equal numbers if there are fewer."""
    spark = rows.sparkSession
    total = rows.count()
    ranges = max(1, -(-total // range_rows))
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(1, total))
    sampled = sorted(tuple(r) for r in (rows if share == 1.0 else rows.sample(share, 5)).collect()) if ranges > 1 else []
    cuts = sorted({sampled[i * len(sampled) // ranges] for i in range(1, ranges)}) if sampled else []

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the partition's sorted rows, none of which crosses a splitter."""
        run, held, number = TaskContext.get().partitionId(), np.empty((3, 0), np.int64), 0
        for batch in and_end(batches):
            if batch is not None:
                held = np.c_[held, np.stack([c.to_numpy() for c in batch.columns])]
            while held.shape[1] >= (1 if batch is None else block_rows):
                part = bisect_right(cuts, tuple(held[:, 0].tolist()))
                stop = min(block_rows, held.shape[1])
                if part < len(cuts):  # the first row that is not below the next splitter
                    low, high = 0, stop
                    while low < high:
                        mid = (low + high) // 2
                        low, high = (mid + 1, high) if tuple(held[:, mid].tolist()) < cuts[part] else (low, mid)
                    stop = low
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([run]), pa.array([number]), pa.array([stop]), pa.array([np.ascontiguousarray(held[:, :stop]).tobytes()], pa.binary())], names=["range", "run", "block", "n", "keys"])
                held, number = held[:, stop:], number + 1

    blocks = written(rows.sortWithinPartitions("a", "b", "row").mapInArrow(runs, "range long, run long, block long, n long, keys binary"))
    sizes = dict(blocks.groupBy("range").agg(F.sum("n")).collect())  # a number for each range
    starts = [0, *accumulate(sizes.get(i, 0) for i in range(len(cuts) + 1))]
    wanted = bisect_right(starts[:-1], max(0, count - 1))  # ranges that begin before the draw's end

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, {}
        for batch in and_end(batches):
            got = zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, None, None)]
            for part, run, keys in got:
                if part != held:
                    yield from ranked(held, list(parts.values()))
                    held, parts = part, {}
                if keys is not None:
                    parts.setdefault(run, []).append(keys)

    def ranked(part: int | None, segments: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        if not segments:
            return
        left = count - starts[part]
        order, found = iter(Tournament([(key for block in own for key in _keys(block)) for own in segments])), []
        for rank in range(starts[part] + 1, starts[part] + left + 1):
            if (key := next(order, None)) is None:
                break
            found.append((*key, rank))
            if len(found) == BLOCK_ROWS:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(found, np.int64).T], names=["a", "b", "row", "rank"])

    dealt = blocks.filter((F.col("range") < wanted) & F.lit(count > 0)).repartition(min(max(1, wanted), shuffle_partitions(spark)), "range").sortWithinPartitions("range", "run", "block")
    return dealt.select("range", "run", "keys").mapInArrow(merge, "a long, b long, row long, rank long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, longest: int = 1, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, seed: str = "2024", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """A row for each row of `docs`: its columns but the text, and n_features, weight, score and rank.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; features are runs of up to `longest`
    words. Of the rows with at least `least_words` words, `percent` of a hundred (rounded down) are drawn and get ranks from
    1; others have none. Ties go by identifier, null last, then by place in a written copy of the table: equal rows, whose
    scores are equal, may change places. Null and empty texts have no features and weight 0; very long texts are read whole.
    Empty tables: no rows, or a target without features. Identifiers are whole numbers. Columns of `docs` named like added
    ones are replaced; others may have any name.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} holds no whole numbers")
    if not 0 <= percent <= 100 or longest < 1 or buckets < 1:
        raise ValueError("percent is 0 to 100, longest and buckets are 1 or more")
    docs = docs.drop("n_features", "weight", "score", "rank")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    others, split = [c for c in plain.columns if c != text], splitter(SEPARATORS)
    own = bucket_counts(plain.select(F.col(text).cast("string")), longest, buckets)
    value = docs.sparkSession.sparkContext.broadcast(gains(own, bucket_counts(target.select(F.col(target_text_col).cast("string")), longest, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 0, BYTES_AT_ONCE):
            bucket, of, each = features(batch.column(0), longest, buckets, split)
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, of, value.value[bucket])
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(np.bincount(of, minlength=batch.num_rows)), pa.array(sums), *batch.columns[1:]], names=["_words", "_features", "_weight", *others])

    weighed = plain.select(F.col(text).cast("string").alias("_text"), *others).mapInArrow(weigh, StructType([*(StructField(n, LongType()) for n in ("_words", "_features", "_weight")), *(plain.schema[c] for c in others)]))
    scored = written(weighed.withColumn("_score", F.col("_weight") + noise(ident, seed)).withColumn("_row", F.monotonically_increasing_id()))
    key = [(-F.col("_score")).alias("a"), F.coalesce(F.col(ident).cast("long"), F.lit(LAST)).alias("b"), F.col("_row").alias("row")]
    eligible = scored.filter(F.col("_words") >= least_words)
    count = eligible.count() * percent // 100
    ranks = Written(drawn(eligible.select(*key), count, range_rows)).df
    # rows after the last one drawn need no join
    last = ranks.filter(F.col("rank") == count).first() if count else None
    inside = F.lit(False)
    if last:
        inside = (F.col("_words") >= least_words) & (F.struct(*key) <= F.struct(F.lit(last["a"]).alias("a"), F.lit(last["b"]).alias("b"), F.lit(last["row"]).alias("row")))
    taken = scored.filter(inside).join(ranks.select(F.col("row").alias("_row"), F.col("rank").alias("_rank")), "_row")
    both = scored.filter(~inside).withColumn("_rank", F.lit(None).cast("long")).unionByName(taken)
    return both.select(*others, "_features", "_weight", "_score", "_rank").toDF(*(n for n in names if n != text_col), "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"))


OP13_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
low AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 1, NULL, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, r, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM low),
terms AS (SELECT term, hex(encode(term)) AS h FROM (SELECT DISTINCT term FROM w)),
coded AS (SELECT term, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM terms, crc),
c AS (SELECT bucket, count(*) FILTER (WHERE side = 0)::DOUBLE AS s, count(*) FILTER (WHERE side = 1)::DOUBLE AS t FROM w JOIN coded USING (term) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM c),
v AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM w JOIN coded USING (term) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
d AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM low LEFT JOIN v USING (r) WHERE side = 0),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM d WHERE n_features >= 20)
SELECT d.*, rank::BIGINT AS rank FROM d LEFT JOIN (SELECT doc_id, rank FROM e WHERE rank <= 10 * n // 100) USING (doc_id)
"""

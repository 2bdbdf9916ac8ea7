"""Near copies by SimHash and pigeonring filtering, confirmed by the exact similarity of word shingles.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least 4/5. In any one order of
all shingles, such sets have a shingle in common among the first n - ceil(4n / 5) + 1 of each, so texts are dealt out by these
and meet by equality. The order puts shingles that are frequent in a sample last, which changes the number of rows and not
the result. Texts that meet, and whose sizes allow it, are linked only if their fingerprints of 128 bits pass the pigeonring:
SEGMENTS segments lie in a ring, and if two fingerprints differ in at most `distance` bits, then from some segment on every
chain of l segments differs in at most l * distance / SEGMENTS of them. Chains are lengthened one by one, pairs without such
a start are pruned, and the longest chain is the full Hamming check (keyed.py links those that are left). Within the groups
that this gives, the sets are compared in full: larger groups block by block, first with the first block, then what did not
join most of its group. Classes are the components of the confirmed pairs.

Near copies beyond the distance are lost: by calculation one pair of twenty million of at least LEAST_SHINGLES shingles, and
none to speak of below. distance=None leaves the fingerprints out and compares in full whatever meets, which loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, free_name, shuffle_partitions, small_side
from .components import components
from .keyed import and_end, forest, links_within_keys
from .simhash import majority
from .terms import in_slices

WIDTH = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Texts whose shingles are counted for the order, about, and counters.
ORDER_DOCS, COUNTERS = 10_000, 1 << 20
#: Differing bits of 128 that near copies of at least LEAST_SHINGLES shingles may have, and those with fewer. A bit differs with
#: a probability of 0.156 at most at similarity 4/5, so that more than 44 do in one pair of twenty million; of unrelated texts
#: one pair in 3,900 is within. With few shingles it is 0.19 (four of five in common), and more than 64 do in one of 10 ** 14.
DISTANCE, LEAST_SHINGLES, SHORT_DISTANCE = 44, 24, 64
#: Segments of the ring; they are bytes.
SEGMENTS = 16
#: Texts of a key, and of a group, that are compared in one piece.
KEY_BLOCK, BLOCK = 4096, 256
#: Shingles of a block in the mean (8 bytes each): a task holds two blocks, however long their texts are.
BLOCK_SHINGLES = 1 << 19
COLUMNS_AT_ONCE, PRINTED_AT_ONCE, KEYS_AT_ONCE = 1 << 14, 1 << 18, 1 << 17
#: Rows that go (an identifier and a hash each) up to which they are broadcast.
GONE_ROWS = 1_000_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a text with fewer words is one shingle, one without words too."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hash_of = xxhash.xxh64_intdigest
    last = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((hash_of(b" ".join(words[i : i + width])) for i in range(last)), np.uint64, last))


def _counts(texts: DataFrame) -> np.ndarray:
    """In how many texts of a sample a shingle falls on each counter."""
    share = min(1.0, ORDER_DOCS / max(1, texts.count()))
    drawn = texts.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch.column(1):
                sums[(shingles(t.as_py()) % np.uint64(COUNTERS)).astype(np.int64)] += 1
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["counter", "n"])

    found = drawn.mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(COUNTERS, np.int32)
    sums[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return sums


def _again(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for the second half of a fingerprint."""
    mixed = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


def _rare(own: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Keys of the first shingles of a set: a shingle's place in the order is how frequent it is, then its hash."""
    seen = np.minimum(order[(own % np.uint64(COUNTERS)).astype(np.int64)], 0x7FFF).astype(np.uint64)
    most = len(own) - -(-OVER * len(own) // UNDER) + 1
    return np.partition(seen << np.uint64(48) | own >> np.uint64(16), most - 1)[:most].view(np.int64)


def in_ring(x: np.ndarray, y: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which fingerprints (pairs by two halves) have a segment from which every chain keeps to its share of `distance`."""
    differ = np.bitwise_count(np.ascontiguousarray(x ^ y).view(np.uint8)).astype(np.int16)
    pairs = np.arange(len(differ))
    chain, start = np.zeros_like(differ), np.ones(differ.shape, bool)
    for n in range(1, SEGMENTS + 1):
        chain = chain + np.roll(differ, 1 - n, axis=1)
        start &= chain <= (n * distance // SEGMENTS)[:, None]
        left = start.any(1)
        if not left.all():
            differ, chain, start, distance, pairs = differ[left], chain[left], start[left], distance[left], pairs[left]
    found = np.zeros(len(x), bool)
    found[pairs] = True
    return found


def _candidates(texts: DataFrame, distance: int | None = DISTANCE) -> DataFrame:
    """Links (a, b) between nodes that connect all near copies within the distance."""
    order = texts.sparkSession.sparkContext.broadcast(_counts(texts))

    def rows(nodes: pa.Array, keys: list[np.ndarray], sizes: list[int], *halves: list[int]) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        columns = [np.concatenate(keys), *(c[at] for c in (nodes.to_numpy(), np.array(sizes), *(np.array(h, np.uint64).view(np.int64) for h in halves)))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "fp", "more"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            made, count, start = ([], [], [], []), 0, 0
            for stop, t in enumerate(batch.column(1), 1):
                own = shingles(t.as_py())
                n = len(own)
                halves = (majority((hashes(own[i : i + PRINTED_AT_ONCE]) for i in range(0, n, PRINTED_AT_ONCE)), n) for hashes in (lambda x: x, _again))
                for column, value in zip(made, (_rare(own, order.value), n, *halves), strict=True):
                    column.append(value)
                count += len(made[0][-1])
                if count >= KEYS_AT_ONCE or stop == batch.num_rows:
                    yield rows(batch.column(0).slice(start, stop - start), *made)
                    made, count, start = ([], [], [], []), 0, stop

    def judge(x: np.ndarray, y: np.ndarray, key: np.ndarray | int) -> np.ndarray:
        less, more = np.minimum(x[1], y[1]), np.maximum(x[1], y[1])
        ok = (UNDER * less >= OVER * more) & (x[0] != y[0])
        if distance is not None and ok.any():
            prints = [np.stack([np.broadcast_to(v[i], ok.shape)[ok] for i in (2, 3)], axis=1) for v in (x, y)]
            ok[ok] = in_ring(*prints, np.where(less[ok] < LEAST_SHINGLES, max(distance, SHORT_DISTANCE), distance))
        return ok

    return links_within_keys(texts.mapInArrow(first, "key long, node long, n long, fp long, more long"), judge, KEY_BLOCK)


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets are near copies."""
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    of, at = of[shared], np.unique(at[shared], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    common = np.zeros((len(sets), len(sets)))
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS_AT_ONCE):
        x, y = np.searchsorted(at, [start, start + COLUMNS_AT_ONCE])
        has = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        has[of[x:y], at[x:y] - start] = 1
        common += has @ has.T
    return UNDER * common >= OVER * (sizes[:, None] + sizes[None, :] - common)


def _alike_in(groups: DataFrame) -> DataFrame:
    """Links (a, b) of a forest of the near copies in each group. groups: (root, i, j, node, own); a node may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets = None, {}
        for batch in and_end(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, None, None, None, None)]
            for root, i, j, node, own in rows:
                if (root, i, j) != held:
                    if len(sets) > 1:
                        ids = np.array(list(sets), np.int64)
                        for parents, children in forest(alike(list(sets.values()))):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[parents]), pa.array(ids[children])], names=["a", "b"])
                    held, sets = (root, i, j), {}
                if own is not None:
                    sets[node] = np.frombuffer(own, np.uint64)

    columns = ["root", "i", "j", "node", "own"]
    dealt = groups.select(*columns).repartition(shuffle_partitions(groups.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _confirmed(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) that keep every connection of the graph of all near copies. groups: (node, root)."""
    zero, every = F.lit(0).cast("long"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 0):
            sets = [shingles(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *batch.columns[1:]], names=["own", "n", "node", "root"])

    sets = texts.join(small_side(groups), "node").dropDuplicates(["node"]).select("text", "node", "root").mapInArrow(hashed, "own binary, n long, node long, root long")
    sets = Written(sets).df
    # blocks are bounded by texts and by shingles
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    several = Written(sizes.filter("blocks > 1")).df
    rows = sets.join(small_side(several), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), "blocks")).drop("n")
    first = rows.withColumn("i", F.explode(F.when(F.col("block") == 0, every).otherwise(F.array("block")))).withColumn("j", zero)
    so_far = Written(_alike_in(first)).df
    large = rows.filter("blocks > 1")
    if large.isEmpty():
        return so_far
    # what did not join most of its group
    classes = Written(components(so_far)).df.withColumnRenamed("root", "class")
    named = Written(large.select("node", "root", "blocks", "block").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))).df
    main = named.groupBy("root", "class").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.max_by("class", F.struct("c", "class")).alias("main"))
    others = named.join(small_side(Written(main).df), "root").filter("class <> main")
    # as few texts in a block as the group's own blocks have, so that long ones stay few
    counts = Written(others.groupBy("root", "blocks").agg(F.count(F.lit(1)).alias("c")).join(small_side(Written(named.groupBy("root").agg(F.count(F.lit(1)).alias("all"))).df), "root").select("root", F.ceil(F.col("c") * F.col("blocks") / F.col("all")).alias("m"))).df
    if counts.isEmpty():
        return so_far
    small = small_side(counts)
    left = others.join(small, "root").withColumn("i", F.pmod(F.xxhash64("node", F.lit(5)), F.col("m"))).withColumn("j", F.explode(every))
    right = named.join(small, "root").withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(zero, F.col("m") - 1)))
    dealt = left.select("root", "i", "j", "node").unionByName(right.select("root", "i", "j", "node")).distinct()
    return so_far.unionByName(_alike_in(dealt.join(large.select("node", "own"), "node")))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int | None = DISTANCE) -> DataFrame:
    """Rows of `docs`, unchanged: of each class of near copies the row with the smallest identifier (null only if the
    class has no other), and of equal identifiers the one with the smallest hash of its text. Rows alike in both are
    copies of one another and stay together. Null and blank texts are one class. Very long texts are compared whole, few at
    once; an empty table gives an empty table. Should two texts have one 64-bit hash, a second one tells, and both stay."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.xxhash64(body)
    texts = docs.select(hashed.alias("node"), body.alias("text"))
    groups = Written(components(_candidates(texts, distance))).df
    classes = Written(components(_confirmed(texts, groups))).df
    ident, own = free_name("_id", docs.columns), free_name("_hash", docs.columns)
    named = docs.select(F.col(id_col).alias("_id"), hashed.alias("node"), F.xxhash64(body, F.lit(1)).alias("second")).join(small_side(classes), "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = F.struct(F.col("_id").isNull().alias("none"), "_id", "node", "second")
    several = Written(named.groupBy("root").agg(F.min(each).alias("k"), F.max(each).alias("other")).filter(~F.col("k").eqNullSafe(F.col("other"))).select("root", "k")).df
    others = Written(named.join(small_side(several), "root")).df
    clash = Written(others.groupBy("node").agg(F.min("second").alias("s"), F.max("second").alias("t")).filter("s <> t").select("node")).df
    # what goes are few rows, so that the texts need not be dealt out
    gone = others.filter(~each.eqNullSafe(F.col("k"))).join(small_side(clash), "node", "left_anti").select(F.col("_id").alias(ident), F.col("node").alias(own)).distinct()
    return docs.join(small_side(Written(gone).df, GONE_ROWS), F.col(id_col).eqNullSafe(F.col(ident)) & (hashed == F.col(own)), "left_anti")

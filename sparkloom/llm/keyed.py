"""Links between rows that share a key, without pairs of a whole group.

Rows are sorted by key. A key's rows are compared in one piece, from which only a forest of links comes out. Keys of more
than a block of rows are hot: their blocks are compared by themselves and with the first block, in tasks of their own; then
only rows outside the component that most of a key's rows have joined are compared with its other rows, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, shuffle_partitions, small_side
from .components import components

#: Keys with up to so many rows are compared together, pair by pair.
FEW = 8
STRIPE = 256

#: Whether rows x and y (columns by rows, of which the first is the node) may be linked under a key.
Judge = Callable[[np.ndarray, np.ndarray, "np.ndarray | int"], np.ndarray]


def and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def forest(adjacent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(parents, children) of a breadth-first tree of each component of a symmetric matrix: every pair is adjacent."""
    left = np.ones(len(adjacent), bool)
    for root in range(len(adjacent)):
        if left[root]:
            left[root] = False
            front, parents, found = np.array([root]), [], []
            while len(front):
                new = np.flatnonzero(adjacent[front].any(0) & left)
                parents.append(front[adjacent[np.ix_(front, new)].argmax(0)] if len(new) else new)
                found.append(new)
                left[new] = False
                front = new
            if len(children := np.concatenate(found)):
                yield np.concatenate(parents), children


def _within(judge: Judge, rows: np.ndarray, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A breadth-first forest, in which rows that have joined are compared only with those that have not: where most rows
    are linked with the first of them, that is far from all pairs."""
    left = np.arange(rows.shape[1])
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parents, start, stripe = np.full(len(left), -1), 0, 1
            while start < len(front) and len(still := np.flatnonzero(parents < 0)):
                some = front[start : start + stripe]
                ok = judge(rows[:, some, None], rows[:, None, left[still]], key)
                found = ok.any(0)
                parents[still[found]] = some[ok.argmax(0)[found]]
                start, stripe = start + stripe, min(2 * stripe, STRIPE)
            joined = parents >= 0
            if joined.any():
                yield rows[0, parents[joined]], rows[0, left[joined]]
            front, left = left[joined], left[~joined]


def _of_keys(judge: Judge, data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the keys of `data` (key, node, ...), whose runs have these sizes."""
    edges = np.r_[0, np.cumsum(sizes)]
    for at in np.flatnonzero(sizes > FEW):
        own = data[:, edges[at] : edges[at + 1]]
        yield from _within(judge, own[1:], int(own[0, 0]))
    data = data[:, np.repeat((sizes > 1) & (sizes <= FEW), sizes)]
    for step in range(1, FEW):
        if data.shape[1] <= step:
            break
        same = np.flatnonzero(data[0, step:] == data[0, :-step])
        x, y = data[1:, same], data[1:, same + step]
        ok = judge(x, y, data[0, same])
        if ok.any():
            yield x[0, ok], y[0, ok]


def _batch(columns: Sequence[np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"c{i}" for i in range(len(columns))])


def _compare(judge: Judge, block: int, width: int):
    """Over rows sorted by key: (a, b, -1, -1, nulls) for links; (key, node, block, null, ...) for rows of hot keys, and
    for each of these keys (key, null, null, number of blocks, nulls)."""
    more = width - 2

    def linked(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        some = np.full(len(a), -1)
        return _batch([np.minimum(a, b), np.maximum(a, b), some, some, *[pa.nulls(len(a), pa.int64())] * more])

    def hot(rows: np.ndarray, number: int) -> pa.RecordBatch:
        n = rows.shape[1]
        return _batch([rows[0], rows[1], np.full(n, number), pa.nulls(n, pa.int64()), *rows[2:]])

    def end(key: int, rows: int) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return _batch([np.array([key]), none, none, np.array([-(-rows // block)]), *[none] * more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, done = np.empty((width, 0), np.int64), None, 0  # key, done: of a hot key that has begun, and its rows
        for batch in and_end(batches):
            last = batch is None
            if not last:
                held = np.c_[held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])]
            if key is not None:  # go on with the hot key
                n = int(np.searchsorted(held[0], key, "right"))
                take = n if last or n < held.shape[1] else n // block * block
                for i in range(0, take, block):
                    yield hot(held[:, i : min(take, i + block)], (done + i) // block)
                done, held = done + take, held[:, take:]
                if not (last or held.shape[1] and held[0, 0] != key):
                    continue
                yield end(key, done)
                key, done = None, 0
            if held.shape[1]:
                stop = held.shape[1] if last else int(np.searchsorted(held[0], held[0, -1], "left"))  # the last key may go on
                now, held = held[:, :stop], held[:, stop:]
                edges = np.flatnonzero(np.r_[True, now[0, 1:] != now[0, :-1], True]) if stop else np.zeros(1, np.int64)
                sizes = np.diff(edges)
                for at in np.flatnonzero(sizes > block):
                    for number, i in enumerate(range(edges[at], edges[at + 1], block)):
                        yield hot(now[:, i : min(i + block, edges[at + 1])], number)
                    yield end(int(now[0, edges[at]]), int(sizes[at]))
                fit = sizes <= block
                if pairs := list(_of_keys(judge, now[:, np.repeat(fit, sizes)], sizes[fit])):
                    yield linked(pairs)
                if held.shape[1] > block:
                    key, done = int(held[0, 0]), held.shape[1] // block * block
                    for i in range(0, done, block):
                        yield hot(held[:, i : i + block], i // block)
                    held = held[:, done:]

    return run


def _of_groups(judge: Judge, groups: DataFrame, more: list[str]) -> DataFrame:
    """Links (a, b) within groups (key, i, j), each of which a task can hold; a row may be in a group twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in and_end(batches):
            data = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch is not None and batch.num_rows else np.empty((4 + len(more), 0), np.int64)
            cuts = np.flatnonzero(np.r_[True, (data[:3, 1:] != data[:3, :-1]).any(0), True]) if data.shape[1] else np.zeros(1, np.int64)
            groups = [(tuple(data[:3, x].tolist()), data[3:, x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            for group, rows in [*groups, *([(None, None)] if batch is None else [])]:
                if group != held and parts:
                    own = np.concatenate(parts, axis=1)
                    own = own[:, np.unique(own[0], return_index=True)[1]]
                    if pairs := list(_within(judge, own, held[0])):
                        yield _batch([np.concatenate([p[i] for p in pairs]) for i in (0, 1)])
                    parts = []
                held = group
                if rows is not None:
                    parts.append(rows)

    columns = ["key", "i", "j", "node", *more]
    dealt = groups.select(*columns).repartition(shuffle_partitions(groups.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links_within_keys(rows: DataFrame, judge: Judge, block: int) -> DataFrame:
    """A table (a, b) of links between nodes of `rows` (key, node, further numbers; all long) which share a key and which
    `judge` links; it keeps every connection of the graph of all such pairs. No task holds more than two blocks of a key."""
    further = [c for c in rows.columns if c not in ("key", "node")]
    more = [f"_{i}" for i in range(len(further))]  # by position, so that none clashes with a column made here
    dealt = rows.select("key", "node", *(F.col(c).alias(name) for c, name in zip(further, more, strict=True))).repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "node")
    schema = ", ".join(f"{c} long" for c in ("a", "b", "block", "blocks", *more))
    found = Written(dealt.mapInArrow(_compare(judge, block, 2 + len(more)), schema)).df
    own = found.filter("block = -1").select("a", "b").distinct()
    ends = found.filter("blocks >= 0").select(F.col("a").alias("key"), F.col("blocks").alias("n"))
    if ends.isEmpty():
        return own
    members = Written(found.filter("block >= 0").select(F.col("a").alias("key"), F.col("b").alias("node"), "block", *more).join(small_side(ends), "key")).df
    every = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    first = members.withColumn("i", F.explode(F.when(F.col("block") == 0, every).otherwise(F.array("block")))).withColumn("j", F.lit(0).cast("long"))
    so_far = Written(own.unionByName(_of_groups(judge, first, more)).distinct()).df
    # what did not join the component of most of its key
    roots = Written(components(so_far)).df
    named = Written(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))).df
    main = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    others = named.join(small_side(Written(main).df), "key").filter("root <> main")
    counts = Written(others.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("m"))).df
    if counts.isEmpty():
        return so_far
    dealt = F.pmod(F.xxhash64("node", F.lit(5)), F.col("m"))
    left = others.join(small_side(counts), "key").withColumn("i", dealt).withColumn("j", F.explode(every))
    right = named.join(small_side(counts), "key").withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    columns = ["key", "i", "j", "node", *more]
    return Written(so_far.unionByName(_of_groups(judge, left.select(*columns).unionByName(right.select(*columns)), more)).distinct()).df

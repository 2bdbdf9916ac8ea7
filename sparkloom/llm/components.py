"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

#: Links up to which one task joins them all in memory (a few megabytes) instead of many rounds of small jobs.
LOCAL_LINKS = 200_000

#: Nodes with more than this share of all rows are joined by a broadcast, so that a hub's links stay where they are.
#: There can be at most 1 / HUB_SHARE of them, each of two numbers.
HUB_SHARE, HUB_ROWS = 1e-4, 200


def _with_least(rows: DataFrame, count: int) -> tuple[Written, DataFrame]:
    """(least (a, m, n) of each a, `rows` (a, b) with m): the smallest b of a, and its number of rows."""
    least = Written(rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    hub = F.col("n") > max(HUB_ROWS, int(count * HUB_SHARE))
    hubs = rows.join(F.broadcast(least.df.filter(hub).select("a", "m")), "a", "left")
    others = hubs.filter(F.col("m").isNull()).drop("m").join(least.df.filter(~hub).select("a", "m"), "a")
    return least, hubs.filter(F.col("m").isNotNull()).unionByName(others)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of links between a and b."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root != (jumped := root[root])).any():
            root = jumped
    return nodes, nodes[root]


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            nodes, own = roots(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(own)], names=["node", "root"])

    return links.coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, most_rounds: int = 60, local: int | None = None) -> DataFrame:
    """(node, root) of every node of `links` (a, b: numbers); root is the smallest node reachable.

    Every round is written to the shared folder, and the one before is dropped. Links of a node to itself are
    ignored; nodes without links are not returned. The number of rounds grows with the logarithm of the longest chain:
    `most_rounds` is beyond any that a table can hold, and reaching it is an error. Up to `local` (LOCAL_LINKS) links, one
    task joins them.
    """
    step = Written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    count, seen = step.df.count(), None
    if count <= (LOCAL_LINKS if local is None else local):
        return _in_one_task(step.df.select(F.col("a").cast("long"), F.col("b").cast("long")))
    for _ in range(most_rounds):
        both = step.df.unionByName(step.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, joined = _with_least(both, 2 * count)
        large = joined.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        first = Written(large)
        least.drop()
        # small stars: links already point from the larger to the smaller node
        least, joined = _with_least(first.df, count)
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.df.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        after = Written(moved.distinct())
        state = after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (step, first, least):
            old.drop()
        step, count = after, state[0]
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    tops = step.df.select(F.col("b").alias("node")).distinct()
    return step.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops.select("node", F.col("node").alias("root")))

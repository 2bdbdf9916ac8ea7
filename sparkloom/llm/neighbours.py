"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a neighbour graph is cut into balanced partitions: halves along principal directions, then vertices
move to the partition that holds most of their neighbours while there is room. A small network learns the partition
of a vector's neighbours. Every row goes to its most probable partition; a query goes to several of the most probable
ones, where all rows are compared in double precision. There are about as many partitions as half the root of the number
of rows: beyond MOST_PARTS, each is cut again by a network of its own, and probabilities multiply. The rows of a partition
are shuffled once and stay in place, in blocks of bounded size that its queries stream past.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, shuffle_partitions, table, written
from .sampling import chance

#: Vectors that the partitions are fitted on, at most (about), and those of one partition that is cut again; partitions of a
#: level, at most; rows for each, at least.
FIT_VECTORS, FIT_AGAIN, MOST_PARTS, LEAST_ROWS = 12_000, 4_000, 256, 64
NEIGHBOURS, HIDDEN, EPOCHS, ROOM = 10, 128, 40, 1.15
#: A query visits its most probable partitions until they hold this probability together, and so many at least. The
#: network learns where a vector's neighbours are, so the probability visited is about the recall.
PROBABILITY, LEAST_PROBES = 0.94, 4
#: Bytes of the rows of one block, and visits that stream past one copy of it.
BLOCK_BYTES, VISITS = 1 << 26, 200_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    square = (x * x).sum(1)
    near = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 1024):
        d = square[i : i + 1024, None] + square[None] - 2 * x[i : i + 1024] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near[i : i + 1024] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """A partition for each vertex; none holds more than ROOM times its even share."""
    part = np.zeros(len(x), np.int64)
    for _ in range(int(math.log2(parts))):  # halve every part along its principal direction
        halves = np.zeros_like(part)
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = np.argsort(centred @ direction, kind="stable")
            halves[own] = 2 * p
            halves[own[order[len(own) // 2 :]]] = 2 * p + 1
        part = halves
    room = int(ROOM * len(x) / parts) + 1
    back = [[] for _ in range(len(x))]
    for v, row in enumerate(near.tolist()):
        for u in row:
            back[u].append(v)
    around = [np.array(near[v].tolist() + back[v]) for v in range(len(x))]
    sizes = np.bincount(part, minlength=parts)
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0
        for v in random.permutation(len(x)):
            votes = np.bincount(part[around[v]], minlength=parts)
            votes[sizes >= room] = -1
            best, here = int(votes.argmax()), part[v]
            if best != here and votes[best] > np.count_nonzero(part[around[v]] == here):
                sizes[here] -= 1
                sizes[best] += 1
                part[v] = best
                moved += 1
        if moved < len(x) / 500:
            break
    return part


class Router:
    """A network with one hidden layer from a vector to partition probabilities."""

    def __init__(self, x: np.ndarray, goal: np.ndarray, seed: int = 2):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), max(1e-12, float(x.std()))
        dims, parts = x.shape[1], goal.shape[1]
        w = [random.standard_normal((dims, HIDDEN)) * (2 / dims) ** 0.5, np.zeros(HIDDEN), random.standard_normal((HIDDEN, parts)) * (1 / HIDDEN) ** 0.5, np.zeros(parts), random.standard_normal((dims, parts)) * 0.01]
        first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        z = (x - self.mean) / self.scale
        for epoch in range(EPOCHS):
            order = random.permutation(len(z))
            for i in range(0, len(z), 256):
                rows = order[i : i + 256]
                a, y = z[rows], goal[rows]
                h = np.maximum(a @ w[0] + w[1], 0)
                o = h @ w[2] + a @ w[4] + w[3]
                p = np.exp(o - o.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - y) / len(rows)
                dh = (d @ w[2].T) * (h > 0)
                step += 1
                for j, g in enumerate((a.T @ dh, dh.sum(0), h.T @ d, d.sum(0), a.T @ d)):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    w[j] = w[j] - 2e-3 * (1 - epoch / EPOCHS) * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partitions of each row, the most probable first, and their probabilities."""
        z = (x - self.mean) / self.scale
        o = np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + z @ self.w[4] + self.w[3]
        p = np.exp(o - o.max(1, keepdims=True))
        order = np.argsort(-o, axis=1, kind="stable")
        return order, np.take_along_axis(p / p.sum(1, keepdims=True), order, 1)


def fit(sample: np.ndarray, parts: int) -> Router | None:
    """None for one partition."""
    if parts < 2 or len(sample) < 2 * parts:
        return None
    near = neighbour_graph(sample, NEIGHBOURS)
    part = balanced_parts(sample, near, parts)
    goal = np.zeros((len(sample), parts))
    np.add.at(goal, (np.arange(len(sample))[:, None], part[near]), 1.0)
    goal[np.arange(len(sample)), part] += 1.0
    return Router(sample, goal / goal.sum(1, keepdims=True))


class Routers:
    """A network of all partitions, and one for each of them that is cut again."""

    def __init__(self, first: Router | None, parts: int, again: dict[int, Router], parts_again: int):
        self.first, self.parts, self.again, self.parts_again = first, parts if first else 1, again, parts_again

    @property
    def total(self) -> int:
        return self.parts * self.parts_again

    def home(self, x: np.ndarray) -> np.ndarray:
        """The most probable partition of each row."""
        at = self.first.order(x)[0][:, 0] if self.first else np.zeros(len(x), np.int64)
        out = at * self.parts_again
        for p, router in self.again.items():
            own = np.flatnonzero(at == p)
            if len(own):
                out[own] += router.order(x[own])[0][:, 0]
        return out

    def visits(self, x: np.ndarray, probability: float, least: int, counts: np.ndarray, rows: int) -> list[np.ndarray]:
        """The partitions that each query visits: the most probable ones that hold `probability` together, `least` at least,
        and as many as it takes to meet `rows` rows."""
        order, p = self.first.order(x) if self.first else (np.zeros((len(x), 1), np.int64), np.ones((len(x), 1)))
        out = []
        for i in range(len(x)):
            found, shares = order[i], p[i]
            if self.parts_again > 1:
                some = int((np.cumsum(shares) < (1 + probability) / 2).sum()) + 1
                deeper, odds = [], []
                for j in range(len(found)):
                    router = self.again.get(int(found[j])) if j < max(some, least) else None
                    at, own = router.order(x[i : i + 1]) if router else (np.arange(self.parts_again)[None], np.full((1, self.parts_again), 1 / self.parts_again))
                    deeper.append(found[j] * self.parts_again + at[0])
                    odds.append(shares[j] * own[0])
                found, shares = np.concatenate(deeper), np.concatenate(odds)
                best = np.argsort(-shares, kind="stable")
                found, shares = found[best], shares[best]
            held = np.cumsum(counts[found])
            n = max(int((np.cumsum(shares) < probability).sum()) + 1, int((held < rows).sum()) + 1, least)
            out.append(found[:n])
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query but those with its own identifier, ties to smaller ids."""
    square = (x * x).sum(1)
    out: list[tuple] = []
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        d = square[None] + (q * q).sum(1)[:, None] - 2 * q @ x.T
        own = query_ids[i : i + 256, None] == ids[None]
        d[own] = np.inf
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        slack = 1e-9 * ((q * q).sum(1) + square.max(initial=0.0) + 1)
        for j in range(len(q)):
            near = np.flatnonzero((d[j] <= kth[j] + slack[j]) & ~own[j])
            exact = np.sqrt(((x[near] - q[j]) ** 2).sum(1))
            best = np.lexsort((ids[near], exact))[:k]
            out.append((np.full(len(best), query_ids[i + j]), ids[near[best]], exact[best]))
    return tuple(np.concatenate(c) if out else np.empty(0) for c in (zip(*out, strict=True) if out else ([], [], [])))


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor zero and all its components are finite."""
    ok = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ok & F.exists(F.col(vector), lambda v: v != 0), F.lit(False))


def _fit_again(own: DataFrame, first: Router | None, parts: int, total: int, most: int, seed: str) -> dict[int, Router]:
    """A network for each of `parts` partitions, fitted on about FIT_AGAIN of its rows, in tasks of their own. The driver
    and every worker hold them all: at most MOST_PARTS networks of MOST_PARTS outputs."""
    shared = own.sparkSession.sparkContext.broadcast(first)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = shared.value.order(_vectors(batch.column(1)))[0][:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0), batch.column(1)], names=["part", "id", "v"])

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        router = fit(_vectors(rows.column("v").combine_chunks()), most)
        return pa.table({"part": pa.array(rows.column("part")[:1].to_pylist(), pa.int32()), "router": pa.array([pickle.dumps(router)], pa.binary())})

    drawn = own.filter(chance("id", f"{seed}-again") < min(1.0, FIT_AGAIN * parts / total)).select("id", "v").mapInArrow(place, "part int, id long, v array<double>")
    made = Written(drawn.groupBy("part").applyInArrow(cut, "part int, router binary"))
    return {r["part"]: router for r in made.df.toLocalIterator() if (router := pickle.loads(r["router"]))}


def search(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, probability: float = PROBABILITY, least_probes: int = LEAST_PROBES,
    part_rows: int | None = None, most_parts: int = MOST_PARTS, seed: str = "neighbours",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows nearest to each query, by Euclidean distance.

    part_rows: rows of a partition, in the mean; twice the root of the number of rows if not given. Takes no part: rows
    without an identifier, and vectors that are null, zero, hold null or non-finite components or do not have the table's
    most frequent length. Rows with a query's identifier are its own; a query given twice with one identifier is answered
    for its first vector in order. A query with k or fewer candidates finds them all.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & usable("v"))
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sizes[0]["n"]
    own = written(own.filter(F.size("v") == dims))
    total = own.count()
    wanted = 1 << max(0, math.ceil(math.log2(max(1, total / (part_rows or max(LEAST_ROWS, 2 * math.isqrt(total)))))))
    parts = min(most_parts, wanted)
    first = None
    if parts > 1:
        sample = own.filter(chance("id", seed) < min(1.0, FIT_VECTORS / total)).orderBy("id").select("v").toArrow()
        first = fit(_vectors(sample.column("v").combine_chunks()), parts)
    deeper = min(most_parts, wanted // parts) if first else 1
    again = _fit_again(own, first, parts, total, deeper, seed) if deeper > 1 else {}
    routers = Routers(first, parts, again, deeper)
    parts = routers.total
    shared = own.sparkSession.sparkContext.broadcast(routers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = shared.value.home(_vectors(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at.astype(np.int32))], names=["id", "v", "q", "part"])

    index = written(own.mapInArrow(place, "id long, v array<double>, q boolean, part int"))
    counts = np.zeros(parts, np.int64)
    for r in index.groupBy("part").count().collect():
        counts[r["part"]] = r["count"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.visits(_vectors(batch.column(1)), probability, least_probes, counts, 4 * k + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o.astype(np.int32) for o in found], pa.list_(pa.int32()))], names=["id", "v", "parts"])

    asked = index.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    routed = written(asked.mapInArrow(route, "id long, v array<double>, parts array<int>").select("id", "v", F.explode("parts").alias("part")))
    per_block = max(1, BLOCK_BYTES // (8 * dims))
    # numbers of row blocks and of their copies: one unless a partition is large or much visited
    blocks = [(p, int(max(1, -(-c // per_block)))) for p, c in enumerate(counts)]
    copies = {r["part"]: max(1, -(-r["count"] // VISITS)) for r in routed.groupBy("part").count().collect()}
    number = own.sparkSession.createDataFrame([(p, n, int(copies.get(p, 0))) for p, n in blocks], "part int, blocks int, copies int")
    number = F.broadcast(number)  # a row of three numbers for each partition, of which there are most_parts squared at most
    of = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(number, "part").filter("copies > 0").select("part", of("blocks", 1).alias("rb"), every("copies").alias("qb"), F.lit(0).alias("side"), "id", "v")
    right = routed.join(number, "part").select("part", every("blocks").alias("rb"), of("copies", 2).alias("qb"), F.lit(1).alias("side"), "id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block, then its queries."""
        here, held, x = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True]) if batch.num_rows else [0]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                block, side = tuple(keys[:3, start].tolist()), keys[3, start]
                if block != here:
                    here, held, x = block, [], None
                ids, v = batch.column(4).slice(start, stop - start).to_numpy(zero_copy_only=False), _vectors(batch.column(5).slice(start, stop - start))
                if side == 0:
                    held.append((ids, v))
                elif held:
                    if x is None:
                        row_ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    got = nearest(x, row_ids, v, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array(got[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    keys = ["part", "rb", "qb"]
    dealt = left.unionByName(right).repartition(shuffle_partitions(own.sparkSession), *keys).sortWithinPartitions(*keys, "side")
    found = Written(dealt.mapInArrow(meet, "query_id long, vec_id long, score double"))
    by_distance = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.df.distinct().withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)

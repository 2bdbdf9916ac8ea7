"""Assigning rows to clusters of a bounded size, at almost the least total distance.

Every cluster has a price that is added to its distances. Where a cluster has more rows than it may hold, its price rises to
what its rows of smallest margin would gain by going elsewhere, so that as many as are too many prefer another one. Rows stay
in their partitions; a round sends a few numbers for each cluster. When prices hardly move any more, the rows that are still
too many go, in order of their margins, to the nearest cluster with room, in rounds of offers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..steps import step

ROUNDS, STILL = 60, 0.002


def unit_rows(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def _priced(rows: DataFrame, centers: np.ndarray, prices: np.ndarray) -> DataFrame:
    """(doc_id, cluster, margin, distance, far): the cluster of the least price and distance, and how much more the next one
    is. far: the distance to the nearest center of all."""

    def choose(batches):
        for pdf in batches:
            if len(pdf):
                d = 1 - unit_rows(np.stack(pdf["v"].to_list()).astype(float)) @ centers.T
                cost, at = d + prices, np.arange(len(pdf))
                first = cost.argmin(1)
                best = cost[at, first]
                cost[at, first] = np.inf
                margin = cost.min(1) - best if len(prices) > 1 else np.full(len(pdf), np.inf)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "cluster": first.astype(np.int32), "margin": margin, "distance": d[at, first], "far": d.min(1)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", doubles(F.col("v")).alias("v")).mapInPandas(choose, f"doc_id {kind}, cluster int, margin double, distance double, far double")


def reseeded(rows: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The centers, of which those nearest to no row are put on the rows that are furthest from theirs."""
    found = _priced(rows, centers, np.zeros(len(centers)))
    full = {r[0] for r in found.select("cluster").distinct().collect()}  # at most as many as clusters
    empty = [i for i in range(len(centers)) if i not in full]
    if empty:
        furthest = found.orderBy(F.col("far").desc(), "doc_id").limit(len(empty)).select("doc_id")
        seeds = rows.join(F.broadcast(furthest), "doc_id").orderBy("doc_id").select(doubles(F.col("v")).alias("v")).limit(len(empty)).collect()
        centers = centers.copy()
        for i, seed in zip(empty, seeds, strict=False):
            centers[i] = unit_rows(np.array([seed["v"]]))[0]
    return centers


def bounded(rows: DataFrame, centers: np.ndarray, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, cluster) of rows (doc_id, v): no cluster has more than `capacity` rows. doc_id is distinct. Distances are one
    less the cosine; ties of margins go by doc_id. It is an error if there are more rows than places."""
    total, k = rows.count(), len(centers)
    if total > capacity * k:
        raise ValueError(f"{total} rows do not fit into {k} clusters of {capacity}")
    centers, prices = unit_rows(centers.astype(float)), np.zeros(k)
    least, since = total + 1, 0
    for _ in range(rounds):
        chosen = _priced(rows, centers, prices)
        sizes = dict(chosen.groupBy("cluster").count().collect())
        over = {j: (n - capacity) / n for j, n in sizes.items() if n > capacity}
        excess = sum(sizes[j] - capacity for j in over)
        least, since = (excess, 0) if excess < least else (least, since + 1)
        if excess <= STILL * total or since == 6:  # equal rows change places together, and no price parts them
            break
        # the margin of the last row that is too many, by cluster
        share = F.element_at(F.create_map(*(F.lit(x) for j, s in over.items() for x in (j, float(s)))), F.col("cluster"))
        marks = chosen.filter(F.col("cluster").isin(*over)).withColumn("_s", share).groupBy("cluster", "_s").agg(F.percentile_approx("margin", F.array(*(F.lit(i / 64) for i in range(65))), 1000).alias("q"))
        for j, s, q in marks.collect():
            prices[j] += q[min(64, int(np.ceil(s * 64)))] + 1e-9
    chosen = step(_priced(rows, centers, prices))
    order = Window.partitionBy("cluster").orderBy("margin", "doc_id")
    sizes = dict(chosen.groupBy("cluster").count().collect())
    over = {j: n - capacity for j, n in sizes.items() if n > capacity}
    if not over:
        return chosen.select("doc_id", "cluster")
    excess = F.element_at(F.create_map(*(F.lit(x) for j, n in over.items() for x in (j, n))), F.col("cluster"))
    leaving = step(chosen.filter(F.col("cluster").isin(*over)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max(over.values())).filter(F.col("_r") <= excess).select("doc_id"))
    placed, rest = [chosen.join(leaving, "doc_id", "left_anti").select("doc_id", "cluster")], step(rows.join(leaving, "doc_id", "left_semi").select("doc_id", "v"))
    room = np.array([max(0, capacity - sizes.get(j, 0)) for j in range(k)])
    while rest.limit(1).count():
        offers = _priced(rest, centers, np.where(room > 0, prices, np.inf))
        some = F.element_at(F.create_map(*(F.lit(x) for j in range(k) for x in (j, int(room[j])))), F.col("cluster"))
        taken = step(offers.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("margin").desc(), "doc_id"))).filter(F.col("_r") <= some).select("doc_id", "cluster"))
        for j, n in taken.groupBy("cluster").count().collect():
            room[j] -= n
        placed.append(taken)
        rest = step(rest.join(taken.select("doc_id"), "doc_id", "left_anti"))
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out

"""Rankings: fusion, tie-breaks, weights by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import small

RRF_K = 60


def ranked(df: DataFrame, by: list[str], score: str, ident: str, name: str = "rnk", prior: str | None = None) -> DataFrame:
    """Numbered from 1 by descending score, then prior rank (absent: after all others), then identifier."""
    ties = [F.col(prior).asc_nulls_last()] if prior else []
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties, F.col(ident))))


def top(df: DataFrame, by: list[str], score: str, ident: str, k: int, name: str = "rnk") -> DataFrame:
    return ranked(df, by, score, ident, name).filter(F.col(name) <= k)


def without_flat(lists: DataFrame, by: list[str], ranker: str = "ranker", score: str = "score") -> DataFrame:
    """Without rankers that give all items of a query one score, or rank fewer than two."""
    w = Window.partitionBy(*by, ranker)
    return lists.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_spread", F.max(score).over(w) - F.min(score).over(w)).filter((F.col("_n") >= 2) & (F.col("_spread") > 1e-12)).drop("_n", "_spread")


def fused(lists: DataFrame, by: list[str], ident: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (by, ranker, weight, ident, rnk): score, and a map of what each ranker contributed.
    Ties go by the identifier as a string."""
    if k < 1:
        raise ValueError("k is 1 or more")
    part = F.col("weight") / (F.lit(k) + F.col("rnk"))
    summed = lists.withColumn("_c", part).groupBy(*by, ident).agg(F.sum("_c").alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("ranker", "_c")))).alias("contributions"))
    w = Window.partitionBy(*by).orderBy(F.round("score", 12).desc(), F.col(ident).cast("string"))
    return summed.withColumn("rank", F.row_number().over(w))


def rank_weight(rank: Column, k: float = 1.0) -> Column:
    """k / (k + rank from 0), for a rank from 1."""
    return F.lit(k) / (F.lit(k) + rank - 1)


def restart_mass(df: DataFrame, by: list[str], rank: str = "rnk", name: str = "mass") -> DataFrame:
    """1 / rank, as a share of a query's total."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, (1 / F.col(rank)) / F.sum(1 / F.col(rank)).over(w))


def scaled_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The mean of min-max scaled values; if all are equal, 1 above zero and else 0."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(*by).agg(F.when(high > low, (F.avg(value) - low) / (high - low)).when(high > 0, 1.0).otherwise(0.0).alias("scaled_mean"))


def fan_out(routed: DataFrame, available: DataFrame, by: list[str], least: int = 10, most: int = 30) -> DataFrame:
    """(by, shard_id, pos): routed shards in order, distinct, filled up with the others in ascending order to `least`,
    `most` at most. routed has pos."""
    first = routed.groupBy(*by, "shard_id").agg(F.min("pos").alias("pos")).withColumn("_o", F.lit(0))
    others = routed.select(*by).distinct().crossJoin(small(available.select("shard_id").distinct())).join(first.select(*by, "shard_id"), [*by, "shard_id"], "left_anti").withColumn("pos", F.col("shard_id")).withColumn("_o", F.lit(1))
    both = first.unionByName(others)
    w = Window.partitionBy(*by).orderBy("_o", "pos", "shard_id")
    n = F.sum(1 - F.col("_o")).over(Window.partitionBy(*by))
    return both.withColumn("_n", n).withColumn("pos", F.row_number().over(w)).filter((F.col("pos") <= most) & ((F.col("_o") == 0) | (F.col("pos") <= least))).select(*by, "shard_id", "pos")

"""Cutting runs of Han and kana, which have no spaces, into words of a dictionary that is learned from the runs themselves.

The dictionary has every character and those longer pieces that occur often and much more often than their parts would side by
side. A run is a lattice of the pieces in it; the path of the least cost, the negative logarithm of a piece's share, is its
segmentation. Costs are counted again from such segmentations. Only distinct runs are worked on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..steps import small, step

LONGEST, LEAST, COHESION, ROUNDS = 4, 3, 8.0, 2


def _substrings(runs: DataFrame, longest: int) -> DataFrame:
    """(run, n, at, piece): all substrings of up to `longest` characters, at from 0. runs: (run, n)."""
    at = F.sequence(F.lit(0), F.length("run") - 1)
    every = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - i)), lambda k: F.struct(i.alias("at"), F.substr("run", i + 1, k).alias("piece")))))
    return runs.filter("run <> ''").select("run", "n", F.explode(every).alias("s")).select("run", "n", "s.at", "s.piece")


def distinct_runs(runs: DataFrame) -> DataFrame:
    """(run, n) of (run): how often each comes; null and empty ones are left out."""
    return runs.filter("run <> ''").groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _costs(counts: DataFrame) -> DataFrame:
    """(piece, cost) of (piece, n)."""
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("piece", (F.log("_all") - F.log("n")).alias("cost"))


def learned(runs: DataFrame, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, rounds: int = ROUNDS) -> DataFrame:
    """(piece, cost) of runs (run, n).

    A piece of two characters or more belongs if it occurs `least` times and, wherever it is cut in two, `cohesion` times as
    often as its parts side by side by chance. Costs are counted again `rounds` times from the segmentations.
    """
    counts = step(_substrings(runs, longest).groupBy("piece").agg(F.sum("n").alias("n")))
    total = counts.filter("length(piece) = 1").agg(F.sum("n").cast("double").alias("_all"))
    long = counts.filter((F.length("piece") > 1) & (F.col("n") >= least))
    cuts = long.select("piece", "n", F.explode(F.sequence(F.lit(1), F.length("piece") - 1)).alias("k")).select("piece", "n", F.substr("piece", F.lit(1), F.col("k")).alias("a"), F.substr("piece", F.col("k") + 1).alias("b"))
    apart = cuts.join(counts.select(F.col("piece").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("piece").alias("b"), F.col("n").alias("nb")), "b").join(F.broadcast(total))
    bound = apart.groupBy("piece", "n").agg(F.min(F.col("n") * F.col("_all") / (F.col("na") * F.col("nb"))).alias("_c")).filter(F.col("_c") >= cohesion)
    dictionary = step(_costs(bound.select("piece", "n").unionByName(counts.filter("length(piece) = 1"))))
    for _ in range(rounds):
        used = cut(runs, dictionary, longest).join(runs, "run").select(F.explode("pieces").alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
        # a character stays, as rare as can be, so that every run has a path
        every = counts.filter("length(piece) = 1").select("piece").join(used, "piece", "left").select("piece", F.coalesce("n", F.lit(1).cast("long")).alias("n")).unionByName(used.filter("length(piece) > 1"))
        dictionary = step(_costs(every))
    return dictionary


def _best_path(run: str, ats: list[int], found: list[str], costs: list[float]) -> list[str]:
    """The pieces of least cost; of paths that cost the same the one whose last pieces are longer. A character that no
    piece covers stands alone at the highest cost."""
    from_: list[list[tuple[int, float]]] = [[] for _ in range(len(run) + 1)]
    for at, piece, cost in zip(ats, found, costs, strict=True):
        from_[at + len(piece)].append((at, cost))
    most = 1.0 + max(costs, default=0.0)
    total, back = [0.0] + [float("inf")] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for at, cost in sorted(from_[end]) or [(end - 1, most)]:
            if total[at] + cost < total[end] - 1e-9:
                total[end], back[end] = total[at] + cost, at
        if total[end] == float("inf"):
            total[end], back[end] = total[end - 1] + most, end - 1
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def cut(runs: DataFrame, dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(run, pieces) of distinct runs (run, n): the best path through each run's lattice."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            paths = [_best_path(r, [e["at"] for e in own], [e["piece"] for e in own], [e["cost"] for e in own]) for r, own in zip(rows["run"], rows["edges"], strict=True)]
            yield pd.DataFrame({"run": rows["run"], "pieces": paths})

    edges = _substrings(runs, longest).join(small(dictionary), "piece").groupBy("run").agg(F.collect_list(F.struct("at", "piece", "cost")).alias("edges"))
    every = runs.filter("run <> ''").select("run").join(edges, "run", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<at:int,piece:string,cost:double>>")))
    return every.mapInPandas(best, "run string, pieces array<string>")

"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, written


def chance(id_col: str, seed: str):
    """A number in [0, 1) that depends on the identifier only."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def per_class(labelled: DataFrame, id_col: str, class_col: str, most: int, seed: str) -> DataFrame:
    """About `most` rows of each class at most, drawn by a digest of the identifier: the same rows on any partitioning.
    Rows of a null class are left out."""
    counts = written(labelled.filter(F.col(class_col).isNotNull()).groupBy(F.col(class_col).alias("_class")).agg(F.count(F.lit(1)).alias("_n")))
    drawn = labelled.join(small_side(counts), F.col(class_col) == F.col("_class")).filter(chance(id_col, seed) * F.col("_n") < float(most))
    return drawn.drop("_class", "_n")
